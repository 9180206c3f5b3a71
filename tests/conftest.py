from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (HERE, os.environ.get("PYTHONPATH")) if p)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A DataFrame with `__row` from rows and a schema."""
    from gridloom.frame import ROW

    def make(rows, schema):
        fields = ", ".join("`{}` {}".format(*f.replace("`", "").rsplit(" ", 1)) for f in schema.split(", "))
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} long, {fields}")

    return make


def rows(df):
    """Rows in order of `__row`, without it."""
    from gridloom.frame import ROW

    ordered = df.orderBy(ROW).drop(ROW) if ROW in df.columns else df
    return [tuple(r) for r in ordered.collect()]
