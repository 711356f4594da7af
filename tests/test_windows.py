"""Chunked timelines against plain windows, with a key that holds most rows, gaps and undated rows, whole and in chunks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creaseline.operators import windows
from creaseline.operators.quantiles import exact_medians
from creaseline.operators.windows import (
    conditional_prior,
    global_row_number,
    last_per_key,
    prior_cumulative,
    prior_rolling,
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(400):
        key = "hot" if rng.random() < 0.6 else rng.choice("abcdefg")
        day = None if rng.random() < 0.05 else f"20{rng.randint(10, 14)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
        data.append((key, day, i, None if rng.random() < 0.1 else float(rng.randint(0, 99)), rng.random() < 0.4))
    df = spark.createDataFrame(data, "k string, d string, match_id long, x double, f boolean")
    return df.withColumn("date", F.to_date("d")).drop("d").repartition(5)


@pytest.fixture(autouse=True, params=[200_000, 40, 6])
def depth_of_chunks(request, monkeypatch):
    monkeypatch.setattr(windows, "ROWS_PER_CHUNK", request.param)
    monkeypatch.setattr(windows, "SAMPLES_PER_CHUNK", 16)


def order():
    return [F.col("date").asc_nulls_last(), F.col("match_id")]


def same(a, b):
    def clean(df):
        cols = sorted(df.columns)
        return sorted(
            (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr
        )

    assert clean(a) == clean(b)


def test_prior_rolling(rows):
    w = Window.partitionBy("k").orderBy(*order()).rowsBetween(-5, -1)
    plain = rows.withColumns({"m": F.avg("x").over(w), "s": F.stddev_samp("x").over(w)})
    same(prior_rolling(rows, ["k"], ["date", "match_id"], {"m": ("avg", "x"), "s": ("stddev_samp", "x")}), plain)


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_conditional_prior(rows, depth):
    got = {r.match_id: r.m for r in conditional_prior(rows, ["k"], ["date", "match_id"], "f", {"m": "x"}, depth).collect()}
    history: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.date is None, r.date or 0, r.match_id)):
        values = [v for v in history.setdefault(r.k, [])[-depth:] if v is not None]
        if values:
            assert got[r.match_id] == pytest.approx(sum(values) / len(values))
        else:
            assert got[r.match_id] is None
        if r.f:
            history[r.k].append(r.x)
    assert len(got) == rows.count()


def test_prior_cumulative(rows):
    w = Window.partitionBy("k").orderBy(*order()).rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.withColumns(
        {"s": F.coalesce(F.sum("x").over(w), F.lit(0.0)), "n": F.count(F.lit(1)).over(w).cast("double")}
    )
    same(prior_cumulative(rows, ["k"], ["date", "match_id"], {"s": F.col("x"), "n": F.lit(1)}), plain)


def test_global_row_number(rows):
    plain = rows.withColumn("rn", F.row_number().over(Window.orderBy(*order())).cast("long"))
    same(global_row_number(rows, ["date", "match_id"]), plain)


def test_last_per_key_takes_last_known_value(rows):
    got = {r.k: r.x for r in last_per_key(rows, ["k"], ["date", "match_id"], ["x"]).collect()}
    ordered = sorted(rows.collect(), key=lambda r: (r.date is None, r.date or 0, r.match_id))
    want = {}
    for r in ordered:
        if r.x is not None:
            want[r.k] = r.x
    assert got == want


def test_exact_medians(rows):
    got = {r.name: r.median for r in exact_medians(rows.withColumn("y", F.col("match_id") % 3), ["x", "y"]).collect()}
    want = rows.select(F.median("x"), F.median(F.col("match_id") % 3)).first()
    assert (got["x"], got["y"]) == tuple(want)


def test_later_matches_do_not_change_features(rows):
    cut = rows.where((F.col("date") < "2012-06-01"))
    full = prior_rolling(rows, ["k"], ["date", "match_id"], {"m": ("avg", "x")}).where(F.col("date") < "2012-06-01")
    same(prior_rolling(cut, ["k"], ["date", "match_id"], {"m": ("avg", "x")}), full)


def test_partition_count_does_not_matter(spark, rows):
    one = prior_rolling(rows.coalesce(1), ["k"], ["date", "match_id"], {"m": ("avg", "x")})
    many = prior_rolling(rows.repartition(17), ["k"], ["date", "match_id"], {"m": ("avg", "x")})
    same(one, many)


def test_empty_tables(spark, rows):
    none = rows.where("false")
    assert prior_rolling(none, ["k"], ["date", "match_id"], {"m": ("avg", "x")}).count() == 0
    assert global_row_number(none, ["date", "match_id"]).count() == 0
    assert exact_medians(none, ["x"]).count() == 0
