"""Secrets in texts: three fixed patterns, and two character Markov models compared by their likelihood ratio.

Everything is column expressions: no Python runs on rows. Spark has no function that tells where all matches of
a pattern are, but the pieces between them and the matches themselves, interleaved, tell it: a match begins
where the pieces and matches before it end. Running sums over an array go in two steps, over groups of GROUP
entries and then over the groups, so a text with a great many matches takes no time that grows with their square.

The models are first-order chains over characters. What the patterns find is the sample of random strings, the
other long words are that of ordinary identifiers; both are counted over all texts, as distinct strings, so copies
of a document weigh little. The table of log ratios (characters by characters) is all that comes to the driver.
A further long word is a secret if it is likelier by `odds` under the chain of random strings.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns. A hex or access match that is too short can't hide a longer one, so the least lengths are part
#: of these two; a short assignment can (it may hold the next one's word), so its length is tested afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "markov")
#: What a long word is made of, and the characters that the chains tell apart: the first stands for a word's begin.
WORD_CHARS = "A-Za-z0-9+/_=-"
ALPHABET = "^" + "".join(map(chr, (*range(65, 91), *range(97, 123), *range(48, 58)))) + "+/_=-."
GROUP = 64
#: Array elements are numbered from 0 here, so F.get and not F.element_at.
SPAN = "struct<start: bigint, place: int, end: bigint, value: string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it and however plans are merged."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], start: int) -> Column:
    """For each entry what entries up to it combine to; combine is associative and start changes nothing."""
    zero, none = F.lit(start).cast("long"), F.array().cast("array<bigint>")

    def scan(items: Column, first: Column) -> Column:
        """(last, all) over a short array."""
        return F.aggregate(items, F.struct(first.alias("last"), none.alias("all")), lambda acc, x: let(combine(acc["last"], x), lambda y: F.struct(y.alias("last"), F.concat(acc["all"], F.array(y)).alias("all"))))

    def grouped(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(GROUP))
        return F.transform(starts, lambda a: F.slice(v, a, F.lit(GROUP)))

    def over(groups: Column) -> Column:
        sums = F.transform(groups, lambda g: F.aggregate(g, zero, combine))
        return let(scan(sums, zero)["all"], lambda ends: F.flatten(F.transform(groups, lambda g, i: scan(g, F.when(i > 0, F.get(ends, i - 1)).otherwise(zero))["all"])))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(let(grouped(v), over)))


def occurrences(text: Column, pattern: str, place: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of a pattern's matches from left to right (code points, end exclusive); a null text has none."""
    empty = F.array().cast(f"array<{SPAN}>")
    begin = lambda pieces, found: running(F.transform(found, lambda m, i: (F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)).cast("long")), lambda a, b: a + b, 0)

    def spans(both: Column) -> Column:
        found = both["found"]
        made = let(begin(both["pieces"], found), lambda at: F.transform(found, lambda m, i: F.struct(F.get(at, i).alias("start"), F.lit(place).alias("place"), (F.get(at, i) + F.length(m)).alias("end"), m.alias("value"))))
        return F.filter(made, lambda s: keep(s["value"])) if keep else made

    split = let(F.split(text, pattern, -1), lambda pieces: F.when(F.size(pieces) > 1, let(F.struct(pieces.alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), spans)).otherwise(empty))
    return F.coalesce(split, empty).cast(f"array<{SPAN}>")


def assigned(match: Column) -> Column:
    """The value in a match of ASSIGN."""
    return F.regexp_extract(match, ASSIGN, 2)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns by start, then kind."""
    of = (occurrences(text, ASSIGN, 0, lambda m: F.length(assigned(m)) >= ASSIGN_CHARS), occurrences(text, ACCESS, 1), occurrences(text, HEX, 2))
    return F.array_sort(F.concat(*of))


def apart(words: Column, spans: Column) -> Column:
    """Those of the words, sorted by start, that touch none of the spans, in one pass over both in order."""
    least, most = -1, (1 << 62)

    def kept(both: Column) -> Column:
        base = lambda x: x["place"] < len(KINDS) - 1
        before = running(F.transform(both, lambda x: F.when(base(x), x["end"]).otherwise(F.lit(least).cast("long"))), lambda a, b: F.greatest(a, b), least)
        after = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(base(x), x["start"]).otherwise(F.lit(most).cast("long")))), lambda a, b: F.least(a, b), most))
        return let(F.struct(before.alias("before"), after.alias("after")), lambda e: F.filter(both, lambda x, i: ~base(x) & (F.get(e["before"], i) <= x["start"]) & (F.get(e["after"], i) >= x["end"])))

    return F.when((F.size(spans) == 0) | (F.size(words) == 0), words).otherwise(let(F.array_sort(F.concat(spans, words)), kept))


def texts(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


# --- the chains ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Chains:
    """Log ratios in thousandths, random by ordinary, of a character after another: rows by the one before."""

    ratio: tuple[int, ...]

    def score(self, word: Column) -> Column:
        """The log likelihood ratio of a word of the alphabet's characters, in thousandths."""
        table = F.split(F.lit(",".join(map(str, self.ratio))), ",").cast("array<int>")  # folded into one literal
        codes = F.transform(F.split(F.concat(F.lit(ALPHABET[0]), word), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        pair = lambda c: lambda acc, i: acc + F.get(table, F.get(c, i - 1) * len(ALPHABET) + F.get(c, i))
        return let(codes, lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0).cast("long"), pair(c)))


def samples(docs: DataFrame, min_chars: int = 6) -> DataFrame:
    """(word, random, weight) of all texts (text, base): distinct strings that the patterns found, and other words.

    An ordinary word weighs one for each doubling of its count. Words that the patterns also found aren't ordinary.
    """
    value = F.when(F.col("span.place") == 0, assigned(F.col("span.value"))).otherwise(F.col("span.value"))
    found = docs.select(F.explode("base").alias("span")).select(value.alias("word")).distinct()
    words = docs.select(F.explode(F.split("text", f"[^{WORD_CHARS}]+")).alias("word")).where(F.length("word") >= min_chars)
    counted = words.groupBy("word").agg(F.count("*").alias("n")).where(~F.col("word").rlike(f"{HEX}|{ACCESS}"))
    other = counted.join(found, "word", "left_anti").select("word", F.lit(False).alias("random"), F.length(F.bin("n")).cast("long").alias("weight"))
    return found.select("word", F.lit(True).alias("random"), F.lit(1).cast("long").alias("weight")).unionByName(other)


def fit(labelled: DataFrame) -> Chains:
    """Chains from labelled strings (word, random, weight), each smoothed by one for every character.

    Characters outside ALPHABET and null words are left out; a class without samples is uniform.
    """
    chars = F.filter(F.split(F.concat(F.lit(ALPHABET[0]), F.translate("word", ALPHABET[0], "")), ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    pairs = F.explode(let(chars, lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.struct(F.get(c, i - 1).alias("a"), F.get(c, i).alias("b")))))
    counts = labelled.where("word is not null").select("random", "weight", pairs.alias("p")).where("p.b is not null").groupBy("random", "p.a", "p.b").agg(F.sum("weight").alias("n"))
    n = {(r["random"], r["a"], r["b"]): r["n"] for r in counts.collect()}  # twice the alphabet's square at most
    size, total = len(ALPHABET) - 1, {}
    for (kind, a, _), k in n.items():
        total[kind, a] = total.get((kind, a), 0) + k
    log = lambda kind, a, b: math.log((n.get((kind, a, b), 0) + 1) / (total.get((kind, a), 0) + size))
    return Chains(tuple(round(1000 * (log(True, a, b) - log(False, a, b))) for a in ALPHABET for b in ALPHABET))


def with_spans(docs: DataFrame, chains: Chains, min_chars: int = 16, odds: float = 10_000.0) -> DataFrame:
    """Adds `spans`, the base spans and those of words that the chains call random, to rows (text, base).

    A word is a longest run of WORD_CHARS of at least min_chars characters that touches no base span.
    """
    least = round(1000 * math.log(odds))
    words = occurrences(F.col("text"), f"[{WORD_CHARS}]{{{min_chars},}}", 3, lambda w: chains.score(w) >= least)
    return docs.withColumn("spans", let(words, lambda w: F.array_sort(F.concat(F.col("base"), apart(w, F.col("base"))))))


def scan(docs: DataFrame, min_chars: int = 16, odds: float = 10_000.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row, arrays of spans with their values; chains come from the same texts.

    Null and empty texts have no spans. Ids, null or repeated, are only carried along; repeated rows have the same
    spans each. Other columns don't pass. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = rows.withColumn("base", base_spans(F.col("text")))
    return with_spans(found, fit(samples(found)), min_chars, odds).select("doc_id", "base", "spans")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda place: F.size(F.filter("base", lambda s: s["place"] == place)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(texts(F.col("base")), 256).alias("base_sha256"), texts(F.col("spans")).alias("spans"))
