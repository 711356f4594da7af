"""Chunks of a timeline are equally deep wherever its rows lie."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creaseline.operators.quantiles import exact_medians
from creaseline.operators.windows import CHUNK, chunk_borders, global_row_number, prior_cumulative, prior_rolling


@pytest.mark.parametrize("case", ["one day", "undated", "outlier", "spread"])
def test_chunks_are_level_whatever_the_places(spark, case):
    """A key with all rows on one day or without dates, and far outliers, are cut as evenly as any other."""
    day = {"one day": "date'2020-01-01'", "undated": "cast(null as date)", "outlier": "date'2020-01-01'", "spread": "date_add(date'2000-01-01', cast(id % 3000 as int))"}[case]
    ident = "if(id = 7, 1000000000000, id)" if case == "outlier" else "id"
    rows = spark.range(20_000).selectExpr("if(id % 10 < 8, 'hot', concat('k', id % 500)) AS k", f"{day} AS date", f"{ident} AS match_id", "cast(id % 7 as double) AS x")
    borders = chunk_borders(rows, ["k"], ["date", "match_id"], 1000)
    cut = borders.apply(rows)
    sizes = [r["count"] for r in cut.where("k = 'hot'").groupBy(CHUNK).count().collect()]
    assert 12 <= len(sizes) <= 20 and max(sizes) <= 1800
    assert cut.where("k <> 'hot'").agg(F.max(CHUNK)).first()[0] == 0
    w = Window.partitionBy("k").orderBy(F.col("date").asc_nulls_last(), "match_id")
    plain = rows.withColumn("s", F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    got = prior_cumulative(rows, ["k"], ["date", "match_id"], {"s": F.col("x")}, borders)
    assert got.exceptAll(plain).count() == 0 and got.count() == 20_000
    last = rows.withColumn("m", F.avg("x").over(w.rowsBetween(-5, -1)))
    assert prior_rolling(rows, ["k"], ["date", "match_id"], {"m": ("avg", "x")}, borders=borders).exceptAll(last).count() == 0


def test_positions_and_medians_with_outliers(spark):
    rows = spark.range(5000).selectExpr("if(id % 1000 = 0, id * 1e12, id) AS x", "cast(id as string) AS s", "date'2020-01-01' AS date", "if(id = 3, 910000000, id) AS match_id")
    borders = chunk_borders(rows, [], ["date", "match_id"], 500)
    sizes = [r["count"] for r in borders.apply(rows).groupBy(CHUNK).count().collect()]
    assert len(sizes) > 5 and max(sizes) < 1000
    placed = global_row_number(rows, ["date", "match_id"], borders=borders)
    assert sorted((r["rn"], r["match_id"]) for r in placed.collect()) == list(enumerate(sorted(r["match_id"] for r in rows.collect()), 1))
    assert exact_medians(rows, ["x"]).first()["median"] == rows.select(F.median("x")).first()[0]
