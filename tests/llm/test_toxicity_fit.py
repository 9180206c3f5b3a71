"""The fit of operator 3: small plans, and weights by the formula."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from gridloom.llm import toxicity


def test_toxicity_plans_stay_small(spark, monkeypatch):
    """What the fit asks Spark for holds neither cached plans nor formulas of all folds."""
    sizes, to_pandas = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: sizes.append(len(self._jdf.queryExecution().toString())) or to_pandas(self))
    rows = [(i, f"good word{i % 7} plain text " + ("grumbo zubbel" if i % 4 == 0 else "calm")) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert len(model.units) and sizes and max(sizes) < 25_000


@pytest.mark.parametrize("z", [0.5, 3.0])
def test_toxicity_weights(spark, z):
    rng, prior = np.random.default_rng(3), 0.05
    cells = rng.integers(0, 30, (50, len(toxicity.CELLS))) * (rng.random((50, len(toxicity.CELLS))) < 0.4)
    counts = spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(cells)], toxicity.COUNTS)
    totals, parts = cells.sum(axis=0).astype(float), [[1, 2, 3, 4], [0, 1, 2, 3, 4]]
    got = toxicity._weights(counts, totals, parts, z, prior, 1000)
    for (units, weights), folds in zip(got, parts):
        want = {}
        n = [[sum(int(row[2 * f + y]) for f in folds) for y in (0, 1)] for row in cells]
        t0, t1 = (sum(x[y] for x in n) for y in (0, 1))
        for unit, (n0, n1) in enumerate(n):
            if n0 + n1 > 1:
                a, a0 = (n0 + n1) * prior, (t0 + t1) * prior
                odds = math.log((n1 + a) / (t1 + a0 - n1 - a)) - math.log((n0 + a) / (t0 + a0 - n0 - a))
                w = math.copysign(max(0.0, abs(odds) - z * math.sqrt(1 / (n1 + a) + 1 / (n0 + a))), odds)
                if abs(w) > 0.1:
                    want[unit] = w
        assert dict(zip(units.tolist(), weights.tolist())) == pytest.approx(want, rel=1e-9) and want
