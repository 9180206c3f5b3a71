"""Toxicity by maximum-scoring segments of token log-odds (operator 3).

Fit, on a bounded sample of labelled documents (``max_labelled`` rows, least hash of the id first;
exact copies count once):

* units are words and their leading 4, 5 and 6 bytes, so inflected forms share evidence, as far as two documents have them. Each unit's
  log-odds between toxic and other documents have an informative Dirichlet prior, proportional to
  the unit's pooled count; a unit counts only as far as its log-odds are ``z`` standard deviations
  from nought;
* a token scores as its strongest unit, or ``-drift`` if none counts;
* segments of toxic scores in clean text follow an extreme-value law: lambda solves
  sum p(s) exp(lambda s) = 1 over the scores of clean training text, K comes from how many
  segments clean text has;
* a document's evidence is the sum of -ln E over its segments with E < 1; a logistic curve turns it into a
  probability. The curve is cross-fitted: each of ``FOLDS`` folds is rated by weights of the other folds.
  A smaller z is taken as long as it makes the labels of the folds likelier, as it does with few labels; a
  curve without slope is never used while there are units.

Scoring is one pass over all whole texts: the linear-time scan for all maximal scoring segments
goes over the tokens with positive scores only, as sums between them come from one running sum.
The model is at most ``max_units`` numbers, whatever the corpus.

Defined results: null and empty texts score as documents without evidence; rows that repeat each
get a row; a null id is scored like any other, is in no fold (``held_out`` false) and teaches nothing, as
labels of null ids are ignored; an empty table has no rows; extra columns are ignored; null labels are ignored, of several labels of one id the highest counts; without any
label, or with one class only, every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered, prefix_hash, rest, restored, small_batches, stage, texts_of, window_hash, word_spans

STEMS = (4, 5, 6)
FOLDS = 5
CELLS = [f"n{y}_{fold}" for fold in range(FOLDS) for y in (0, 1)]
COUNTS = "unit long, " + ", ".join(f"{c} long" for c in CELLS)
#: What z falls back to in turn.
LOOSER = (2.0, 1.5, 1.0, 0.5)
SCORES = "doc_id long, evidence double, n_tokens long, segments array<struct<first:long,last:long,score:double,e_value:double>>"


@dataclass
class Model:
    units: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    drift: float = 0.5
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    offset: float = -3.0


def remainder(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def units_of(text: str) -> list[np.ndarray]:
    """Hashes of each token's units: the word first, then stems (0 where the word is no longer)."""
    data = np.frombuffer(lowered(text), np.uint8)
    s, e = word_spans(data)
    if not len(s):
        return [np.empty(0, np.int64)] * (1 + len(STEMS))
    h = prefix_hash(data)
    out = [window_hash(h, s, e).view(np.int64)]
    for k in STEMS:
        out.append(np.where(e - s > k, window_hash(h, s, np.minimum(s + k, e)).view(np.int64) ^ k, 0))
    return out


def token_scores(text: str, model: Model) -> np.ndarray:
    units = units_of(text)
    best = np.zeros(len(units[0]))
    if len(model.units):
        for u in units:
            at = np.minimum(np.searchsorted(model.units, u), len(model.units) - 1)
            w = np.where(model.units[at] == u, model.weights[at], 0.0)
            best = np.where(np.abs(w) > np.abs(best), w, best)
    return np.where(best == 0, -model.drift, best)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in linear time."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # [first, last, sum before, sum after]
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i, float(total[i]), float(total[i + 1])]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new, j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


def evidence(scores: np.ndarray, model: Model) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Sum of -ln E over the significant segments, and those segments."""
    if not len(scores):
        return 0.0, []
    found = []
    for a, b, s in segments(scores):
        e = model.k * len(scores) * np.exp(-min(model.lam * s, 600.0))
        if e < 1:
            found.append((a, b, float(s), float(e)))
    return float(sum(-np.log(max(e, 1e-260)) for *_, e in found)), found


def _weights(counts: DataFrame, totals: np.ndarray, parts: list[list[int]], z: float, prior: float, max_units: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part, a list of folds: units whose smoothed log-odds differ from nought in the counts of these folds.

    The formulas run on arrays within tasks: as columns, all parts' together make plans that outweigh the data in the driver.
    """
    names = [f"w{k}" for k in range(len(parts))]

    def weigh(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            cells, out = pdf[CELLS].to_numpy(float), {"unit": pdf["unit"].to_numpy(np.int64)}
            for name, folds in zip(names, parts, strict=True):
                (n0, n1), (total0, total1) = (tuple(x[..., [2 * f + y for f in folds]].sum(axis=-1) for y in (0, 1)) for x in (cells, totals))
                if not total0 or not total1:
                    out[name] = np.zeros(len(pdf))
                    continue
                on = n0 + n1 > 1
                n0, n1 = np.where(on, n0, 1.0), np.where(on, n1, 1.0)
                a, a0 = (n0 + n1) * prior, (total0 + total1) * prior
                odds = np.log((n1 + a) / (total1 + a0 - n1 - a)) - np.log((n0 + a) / (total0 + a0 - n0 - a))
                sd = np.sqrt(1 / (n1 + a) + 1 / (n0 + a))
                out[name] = np.where(on, np.sign(odds) * np.maximum(0.0, np.abs(odds) - z * sd), 0.0)
            out["most"] = np.max([np.abs(out[n]) for n in names], axis=0, initial=0.0)
            yield pd.DataFrame(out)[out["most"] > 0.1]

    found = counts.mapInPandas(weigh, "unit long, " + ", ".join(f"{n} double" for n in names) + ", most double")
    rows = found.orderBy(F.desc("most"), "unit").limit(max_units).toPandas().sort_values("unit")
    unit = rows["unit"].to_numpy(np.int64)
    return [(unit[on], w[on]) for w in (rows[n].to_numpy(float) for n in names) for on in (np.abs(w) > 0.1,)]


def _null_law(stats: pd.DataFrame, drift: float, model: Model) -> None:
    """lambda and K from the scores of clean training text (histogram rows: score, tokens, segments)."""
    s, n = stats["score"].to_numpy(float), stats["tokens"].to_numpy(float)
    top = max([1.0, *model.weights.tolist()])
    s, n = np.append(s, [top, -drift]), np.append(n, [1.0, 1.0])  # smoothing: one strongest token
    p = n / n.sum()
    low, high = 1e-6, 50.0
    if (p * s).sum() < 0:
        for _ in range(80):
            mid = (low + high) / 2
            if (p * np.exp(np.minimum(mid * s, 600))).sum() < 1:
                low = mid
            else:
                high = mid
        model.lam = low
    else:
        model.lam = 0.2
    m, seg = n.sum(), stats["segment"].to_numpy(float)
    weight = stats["segments"].to_numpy(float)
    s0 = np.quantile(np.repeat(seg, weight.astype(int)), 0.5) if weight.sum() else top
    count = float(weight[seg >= s0].sum()) + 1.0
    model.k = float(np.clip(count * np.exp(min(model.lam * s0, 600)) / m, 1e-12, 10.0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below nought) and offset of the logistic curve, lightly regularised."""
    a, b = 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum() - 0.01 * (b + 2)])
        q = p * (1 - p)
        h = np.array([[(q * x * x).sum() + 0.01, (q * x).sum()], [(q * x).sum(), q.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(0.0, a + step[0]), b + step[1]
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 24_000, max_units: int = 200_000, z: float = 3.0, prior: float = 0.05, drift: float = 0.5, hold_out: tuple[int, int] = (4, 2)) -> Model:
    """Learns from rows of labels whose crc32(doc_id as text) modulo hold_out[0] isn't hold_out[1]."""
    model = Model(drift=drift)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(remainder("doc_id", hold_out[0]) != hold_out[1])
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    sample = known.withColumn("key", F.xxhash64("doc_id")).orderBy("key", "doc_id").limit(max_labelled).withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int"))
    rows = sample.select("doc_id", "y", "fold").toPandas()  # at most max_labelled rows
    model.offset = float(np.log((rows["y"].sum() + 0.5) / (len(rows) - rows["y"].sum() + 0.5)))
    if rows["y"].nunique() < 2:
        return model
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(rows.astype("int64"), "doc_id long, y long, fold long"))  # bounded by max_labelled
    train = texts_of(docs).join(chosen, "doc_id").withColumn("h", F.xxhash64("text"))
    train = train.groupBy("h").agg(F.min_by(F.struct("text", "y", "fold"), "doc_id").alias("r")).select("r.*")
    return _fit(stage(train, "toxic-train"), model, spark, max_units, z, prior, drift)  # stored, as every round reads it: cached plans are repeated in each plan above them


def _fit(train: DataFrame, model: Model, spark: SparkSession, max_units: int, z: float, prior: float, drift: float) -> Model:
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 150):
                part = pdf.iloc[at : at + 150]
                units, kind = [], []
                for text, y, fold in zip(part["text"], part["y"], part["fold"], strict=True):
                    u = np.unique(np.concatenate(units_of(text)))
                    units.append(u)
                    kind.append(np.full(len(u), int(y > 0) + 2 * int(fold)))
                if not units:
                    continue
                u, inv = np.unique(np.concatenate(units), return_inverse=True)
                table = np.bincount(inv * len(CELLS) + np.concatenate(kind), minlength=len(CELLS) * len(u)).reshape(-1, len(CELLS))
                keep = u != 0
                yield pd.DataFrame({"unit": u[keep], **{c: table[keep, i] for i, c in enumerate(CELLS)}})

    counts = stage(train.mapInPandas(count, COUNTS).groupBy("unit").agg(*[F.sum(c).cast("int").alias(c) for c in CELLS]).where(" + ".join(CELLS) + " > 1"), "toxic-units")
    totals = np.array([x or 0 for x in counts.agg(*[F.sum(c) for c in CELLS]).first()], float)

    def laws(models: list[Model]) -> None:
        """Extreme-value laws: a clean document counts for one model that learned from it (of several, that of the fold after its own)."""
        shared = spark.sparkContext.broadcast(models)

        def seen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                rows = []
                for text, fold in zip(pdf["text"], pdf["fold"], strict=True):
                    k = (int(fold) + 1) % len(shared.value)
                    s = token_scores(text, shared.value[k])
                    v, n = np.unique(np.round(s, 1), return_counts=True)
                    rows += [(k, float(a), int(b), 0.0, 0) for a, b in zip(v, n)]
                    rows += [(k, 0.0, 0, float(np.round(x, 1)), 1) for *_, x in segments(s)]
                yield pd.DataFrame(rows, columns=["k", "score", "tokens", "segment", "segments"])
            rest()

        law = train.where("y = 0").mapInPandas(seen, "k int, score double, tokens long, segment double, segments long")
        law = law.groupBy("k", "score", "segment").agg(F.sum("tokens").alias("tokens"), F.sum("segments").alias("segments")).toPandas().sort_values(["k", "score", "segment"])
        for k, m in enumerate(models):
            _null_law(law[law["k"] == k], drift, m)

    def rated(models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
        """Evidence and label of every document, by the model of its fold."""
        shared = spark.sparkContext.broadcast(models)

        def rate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                of = (shared.value[int(fold) % len(shared.value)] for fold in pdf["fold"])
                yield pd.DataFrame({"x": [evidence(token_scores(t, m), m)[0] for t, m in zip(pdf["text"], of)], "y": (pdf["y"] > 0).astype("int64").to_numpy()})

        xy = train.mapInPandas(rate, "x double, y long").toPandas().sort_values(["x", "y"])  # at most max_labelled rows
        return np.minimum(xy["x"].to_numpy(float), 60.0), xy["y"].to_numpy(float)

    best = None
    everything = list(range(FOLDS))
    for now in (z, *[x for x in LOOSER if x < z]):
        found = _weights(counts, totals, [[f for f in everything if f != fold] for fold in everything] + [everything], now, prior, max_units)
        units, weights = found.pop()
        folds = [Model(units=u, weights=w, drift=drift) for u, w in found]
        if not all((w > 0).any() for w in (weights, *(m.weights for m in folds))):
            continue
        laws(folds)
        x, y = rated(folds)
        slope, offset = _logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        fit_now = float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        if best is not None and fit_now <= best:
            break
        best, model.units, model.weights, model.slope, model.offset = fit_now, units, weights, slope, offset
    laws([model])
    if model.slope <= 0.01 and len(model.units):  # no fold tells the others' classes apart: the curve of the weights' own documents, less steep
        slope, offset = _logistic(*rated([model]))
        model.slope, model.offset = max(slope / 2, 0.1), offset
    return model


def probability(model: Model, spark: SparkSession, text_col: str = "text") -> Column:
    """The score as a column, for filters over tables with columns of their own."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    total = F.pandas_udf(lambda texts: texts.map(lambda t: evidence(token_scores(t or "", shared.value), shared.value)[0]).astype(float), "double")
    return 1 / (1 + F.exp(-(F.least(total(F.col(f"`{text_col}`").cast("string")), F.lit(60.0)) * model.slope + model.offset)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence, n_tokens, segments) of every row; segments count tokens from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in parts:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                s = token_scores(text, m)
                x, found = evidence(s, m)
                rows.append((key, x, len(s), [{"first": a, "last": b, "score": c, "e_value": e} for a, b, c, e in found]))
            yield pd.DataFrame(rows, columns=["doc_id", "evidence", "n_tokens", "segments"])

    rated = texts_of(docs, id_col, text_col).mapInPandas(rate, SCORES)
    logit = F.least(F.col("evidence"), F.lit(60.0)) * model.slope + model.offset
    return restored(rated).withColumn("score", 1 / (1 + F.exp(-logit)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = score(docs, model)
    return rated.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("segments").cast("long").alias("n_segments"))
