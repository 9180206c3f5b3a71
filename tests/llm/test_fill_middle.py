"""Fill-in-middle against a plain version, and exact ways back."""

from __future__ import annotations

import hashlib
import re

import pytest

from gridloom.llm.fill_middle import SQL, FillMiddle, op11_fill_middle, restore, transform

TEXTS = [
    (0, "one\ntwo\nthree"), (1, None), (2, ""), (3, "\n"), (4, "a\n\n\nb\r\nc\n"), (5, "no end"), (6, "has <M> in it\nand more"), (7, "é ü\x85\n日本\n" * 40), (None, "no id\nof its own\n"), (8, "same\nrow\n"), (8, "same\nrow\n"),
    (-9, "below\nzero"), (9, "ends with <\nS>\n<P\n"), (10, "x" * 300_000), (11, "y\n" * 60_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in TEXTS], "doc_id long, text string, n long, output string").repartition(3)


def plain(i, t, rate=100, spm=50):
    t = t or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    if t == "" or re.search("<[PSM]>", t) or h3 % 100 >= rate:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < spm:
        return i, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return i, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (50, 50), (0, 50), (100, 0), (100, 100)])
def test_transform(docs, rate, spm):
    got = [tuple(r) for r in transform(docs, FillMiddle(rate=rate, spm_rate=spm)).collect()]
    assert sorted(got, key=repr) == sorted((plain(i, t, rate, spm) for i, t in TEXTS), key=repr)


def test_way_back(spark, docs):
    done = restore(transform(docs)).collect()
    assert sorted(((r["doc_id"], r["restored"]) for r in done), key=repr) == sorted(((i, t or "") for i, t in TEXTS), key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert restore(transform(empty)).count() == 0


def test_other_units_and_marks(docs):
    how = FillMiddle(unit=r"[^ ]*[ ]|[^ ]+", marks=("[pre]", "[suf]", "[mid]"), salt="s")
    done = restore(transform(docs, how), how).collect()
    assert sorted(((r["doc_id"], r["restored"]) for r in done), key=repr) == sorted(((i, t or "") for i, t in TEXTS), key=repr)
    assert {r["n"] for r in done if r["doc_id"] == 6} == {5}


def test_what_could_be_read_in_two_ways_is_refused():
    for marks in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("<P>", "x<P>y", "z"), ("", "x", "y"), ("ab", "bc", "d")):
        with pytest.raises(ValueError, match="taken for"):
            FillMiddle(marks=marks)
    with pytest.raises(ValueError, match="at least a character"):
        FillMiddle(unit="a*")
    with pytest.raises(ValueError, match="not an output"):
        FillMiddle().restore("plain text", "psm")


def test_long_text_is_linear():
    assert FillMiddle().borders("z\n" * 1_500_000)[-1] == 3_000_000


def test_query_and_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = op11_fill_middle(spark, sf).toPandas(), con.execute(SQL).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ([tuple(None if x != x else x for x in r) for r in d[sorted(d.columns)].sort_values("doc_id").itertuples(index=False)] for d in (got, want))
    assert a == b
    assert (got["restored_sha256"] == [hashlib.sha256(t.encode()).hexdigest() for t in spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").loc[got["doc_id"], "text"]]).all()
