"""The pipeline's stages: what each keeps, and that columns stay."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as P

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(3, 8))) for _ in range(500)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    item = prose(30)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 10 == 0
        docs.append((i, prose(60) + (" grumbo zubbel flarnish grumbo" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, docs[1][1]), (1001, docs[1][1].replace(" ", "  ", 1) + " z"), (1002, prose(20) + " " + item + " " + prose(20)), (1003, "x\n" + docs[2][1]), (1004, None), (1005, "")]
    table = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, dict(docs)


def test_stages(spark, world):
    sf, texts = world
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for _, step in P.STAGES[:-1]:
        docs = step(spark, docs, sf)
        assert docs.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic = {i for i in range(0, 400, 10)}
    assert set(seen[0]) == set(texts) - toxic
    assert 1000 not in seen[1] and seen[1][1003] == "x" and seen[1][5] == texts[5]
    assert 1001 not in seen[2] and {1, 1004, 1005} <= set(seen[2])
    assert set(seen[2]) - set(seen[3]) == {1002}


def test_run(spark, world):
    sf, _ = world
    out = P.run(spark, sf).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 1024 and 1002 not in set(out.doc_id) and 0 not in set(out.doc_id)


def test_near_copies_with_shared_ids_and_odd_columns(spark):
    """Ids that several texts share, null ids and texts, repeated rows, and columns named like those the stages use."""
    a, b, c = prose(40), prose(40), prose(40)
    rows = [(1, a), (1, b), (2, a), (None, b), (None, c), (3, a), (3, a), (4, None), (4, None), (5, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, 7, 8, 9, "x") for i, t in rows], "doc_id long, text string, kept int, doc_key int, first_key int, __doc string")
    out = P.keep_one_of_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in out.collect()), key=str) == sorted([(1, a), (1, b), (None, c), (4, None), (4, None), (5, ""), (None, " ")], key=str)
    lines = P.remove_repeated_lines(spark, docs.withColumn("raw_lines", docs.kept), "")
    assert lines.columns == [*docs.columns, "raw_lines"]
    # Rows equal in id and text are one document; the first copies in order of ids (null first) stay.
    assert sorted(((r[0], r[1]) for r in lines.collect()), key=str) == sorted([(None, b), (None, c), (1, a), (4, None), (4, None), (5, ""), (None, " ")], key=str)
    none = docs.limit(0)
    assert P.keep_one_of_near_copies(spark, none, "").count() == 0 and P.remove_repeated_lines(spark, none, "").count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
