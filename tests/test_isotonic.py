"""Pooling in chunks equals the single pass."""

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression

from creaseline.operators.isotonic import fit_isotonic, isotonic_blocks


def single_pass(x, y, w):
    order = np.argsort(x, kind="stable")
    blocks = []
    for a, b, c in zip(x[order], y[order], w[order]):
        if blocks and blocks[-1][1] == a:  # equal scores are one point
            blocks[-1][2] += c
            blocks[-1][3] += b * c
        else:
            blocks.append([a, a, c, b * c])
    out = []
    for block in blocks:
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            last = out.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        out.append(block)
    return [(a, b, c, d / c) for a, b, c, d in out]


@pytest.mark.parametrize("shape", ["labels", "falling", "rising", "steps"])
def test_equals_the_single_pass(spark, shape):
    rng = np.random.default_rng(4)
    n = 3000
    x = np.round(rng.uniform(0, 1, n), 3 if shape == "labels" else 9)
    y = {"labels": (rng.uniform(0, 1, n) < x).astype(float), "falling": -x + rng.normal(0, 0.01, n), "rising": x.copy(), "steps": np.floor(x * 5) - x + rng.normal(0, 0.01, n)}[shape]
    w = rng.integers(1, 4, n).astype(float)
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), w.tolist())) + [(None, 1.0, 1.0), (0.5, None, 1.0)], "x double, y double, w double").repartition(6)
    want = single_pass(x, y, w)
    for depth in (200_000, 100):
        got = sorted(tuple(r) for r in isotonic_blocks(rows, "x", "y", "w", depth).collect())
        assert len(got) == len(want)
        assert np.allclose(np.array(got), np.array(want), rtol=1e-9, atol=1e-12)


def test_model_equals_sparks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=2000).round(2)
    y = (rng.uniform(size=2000) < 1 / (1 + np.exp(-x))).astype(float)
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    own = fit_isotonic(rows, "x", "y", "p")
    plain = IsotonicRegression(featuresCol="x", labelCol="y", predictionCol="q").fit(rows)
    both = plain.transform(own.transform(spark.range(-400, 400).selectExpr("id / 100D AS x")))
    assert both.where("abs(p - q) > 1e-9").count() == 0
