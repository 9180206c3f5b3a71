"""Delimited files in splits against the csv module over whole files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridloom import sinks
from gridloom.sources import cells as C
from gridloom.sources import delimited as D
from gridloom.streaming import files


def plain(content):
    value = lambda v: v if isinstance(v, str) else None if v != v else float(v)  # noqa: E731  nan becomes null
    return [(r, len(row), [(c, value(v)) for c, v in enumerate(row, 1) if v is not None]) for r, row in enumerate(C.csv_rows(content), 1)]


def told(rows):
    out = {}
    for x in rows.collect():
        out.setdefault(x["file"].rsplit("/", 1)[-1], []).append((x["r"], x["width"], [(c["c"], c["s"] if c["kind"] == "s" else c["d"]) for c in x["cells"]]))
    return {k: sorted(v) for k, v in out.items()}


def test_ends_inside():
    import csv
    import io

    rng = random.Random(1)
    for _ in range(4000):
        line = "".join(rng.choice('a",\r"') for _ in range(rng.randint(0, 9)))
        # a marker on the next line stands in a row of its own only if the line ended outside quotes
        rows = list(csv.reader(io.StringIO(line + "\nZ", newline="")))
        assert D.ends_inside(line.encode(), False) == (rows[-1] != ["Z"]), line
        rows = list(csv.reader(io.StringIO('"' + line + "\nZ", newline="")))
        assert D.ends_inside(line.encode(), True) == (rows[-1] != ["Z"]), line


def contents():
    rng = random.Random(2)
    values = ["", "a", "12", " 3.5", 'x"y', "two\nlines", "q\"q", "a\r\nb", ",", "長い\n値,", "  in", "1_000", "nan"]

    def field(v, q):
        return '"' + v.replace('"', '""') + '"' if q or any(c in v for c in ',\n\r') else v

    def sheet(n, end, chars=None):
        rows = [",".join(field(rng.choice(values), rng.random() < 0.3) for _ in range(rng.randint(1, 5))) for _ in range(n)]
        return end.join(rows)

    yield "plain.csv", sheet(300, "\n").encode()
    yield "crlf.csv", ("﻿" + sheet(300, "\r\n") + "\r\n").encode()
    yield "cp932.csv", (sheet(200, "\n") + "\n支店,表\n").encode("cp932")
    yield "latin.csv", "caf\xe9,\x81\xff\nb,2\n".encode("latin-1")
    yield "late.csv", ("ascii,1\n" * 200 + "東京,2\n").encode("cp932")
    yield "open.csv", (sheet(50, "\n") + '\n"never closed, and\nmore\n').encode()
    yield "trailing.csv", b"a,b\n,,\n\n1,2\n,,,\n\n\n"
    yield "stray.csv", ('5" pipe,a"b\n' * 100 + '"x" y,"z"w"\n"m\nn",o\n').encode()
    yield "wide.csv", (",".join(map(str, range(3000))) + "\n" + '"' + "long\n" * 500 + '",end\n').encode()
    yield "blank.csv", b"\n\n , \n"


@pytest.mark.parametrize("split", ["64", "1000", "128m"])
def test_rows(spark, tmp_path, split):
    want = {}
    for name, content in contents():
        (tmp_path / name).write_bytes(content)
        if p := plain(content):
            want[name] = p
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if split != "128m" else "4194304")
    try:
        got = told(D.read_rows(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(want)
    for name in want:
        assert got[name] == want[name], name


def test_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_SPLITS", 0)
    content = dict(contents())["plain.csv"]
    (tmp_path / "plain.csv").write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert repr(told(D.read_rows(spark, str(tmp_path)))["plain.csv"]) == repr(plain(content))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_csv(spark, frame, tmp_path):
    df = frame([(f"n{i}", None if i % 7 == 0 else i, 'a"b,\n' if i % 5 == 0 else "é") for i in range(500)], "x string, v long, t string").repartition(6)
    sinks.write_one_csv(df, str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_bytes() == sinks.csv_bytes(df) and [p.name for p in tmp_path.iterdir()] == ["one.csv"]
    sinks.write_one_csv(df.limit(0), str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_bytes() == "﻿x,v,t\n".encode()
    bad = df.withColumn("x", F.when(F.col("v") == 499, F.raise_error(F.lit("no"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="no"):
        sinks.write_one_csv(bad, str(tmp_path / "two.csv"))
    assert [p.name for p in tmp_path.iterdir()] == ["one.csv"]


def test_round_trip_and_stream(spark, frame, tmp_path):
    df = frame([(f"n{i}", float(i), "two\nlines" if i % 3 else "one") for i in range(200)], "name string, v double, t string")
    (tmp_path / "in").mkdir()
    sinks.write_one_csv(df, str(tmp_path / "in" / "a.csv"))
    rows = D.read_rows(spark, str(tmp_path / "in"))
    assert rows.count() == 201 and D.cells_of(rows).where("c = 2").agg(F.sum("d")).first()[0] == sum(range(200))
    got = []
    q = files.on_each_batch_of_files(spark, str(tmp_path / "in"), lambda cells, widths, n: got.append((cells.count(), widths.count())), str(tmp_path / "ck"))
    q.awaitTermination()
    assert got == [(603, 201)]
