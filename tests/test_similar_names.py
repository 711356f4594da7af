"""The edit-distance join against all pairs of a block."""

import random

import pytest
from pyspark.sql import functions as F

from creaseline.functions.text import similarity
from creaseline.operators.similar_names import similar_pairs


def variants(rng, base):
    name = list(base)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(name) + 1)
        what = rng.random()
        if what < 0.4 and name:
            name[min(at, len(name) - 1)] = rng.choice("abcde ")
        elif what < 0.7:
            name.insert(at, rng.choice("abcde"))
        elif len(name) > 1:
            del name[min(at, len(name) - 1)]
    return "".join(name)


@pytest.mark.parametrize("threshold", [88.0, 80.0, 60.0])
def test_equals_all_pairs(spark, threshold):
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 30))).strip() or "a" for _ in range(25)]
    a = [(rng.choice("xy"), variants(rng, rng.choice(bases))) for _ in range(250)] + [(None, "abc"), ("x", None), ("x", "")]
    b = [(rng.choice("xy"), variants(rng, rng.choice(bases))) for _ in range(250)] + [("x", "abc"), (None, "abc")]
    asked, known = spark.createDataFrame(a, "sig string, a string"), spark.createDataFrame(b, "sig string, b string")
    got = {tuple(r) for r in similar_pairs(asked, known, ["sig"], "a", "b", threshold).collect()}
    plain = asked.distinct().join(known.distinct(), "sig").where("a <> '' and b <> ''").withColumn("score", similarity("a", "b"))
    want = {tuple(r) for r in plain.where(F.col("score") >= threshold).select("sig", "a", "b", "score").collect()}
    assert got == want and len(want) > 30


def test_candidates_follow_matches_not_the_block(spark):
    """Two thousand names of one block: only near ones meet."""
    rows = spark.range(2000).selectExpr("'k|singh' AS sig", "concat('k ', sha2(cast(id as string), 256), ' singh') AS a")
    out = similar_pairs(rows, rows.withColumnRenamed("a", "b"), ["sig"], "a", "b", 88.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and out.count() == 2000
