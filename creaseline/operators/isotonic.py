"""Isotonic regression whose pooling runs in chunks of the score, so that only pooled blocks reach the final fit."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creaseline.operators.windows import CHUNK, chunk_borders
from creaseline.session import cut_lineage

BLOCKS = "lo double, hi double, w double, wy double, _chunk int"


def _pooled(rows: pd.DataFrame) -> pd.DataFrame:
    """Adjacent blocks of one group pooled while the earlier one's mean is not below the later one's."""
    out: list[list] = []
    for lo, hi, w, wy, chunk in rows.sort_values("lo")[["lo", "hi", "w", "wy", CHUNK]].itertuples(index=False):
        block = [lo, hi, w, wy, chunk]
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            last = out.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3], last[4]]
        out.append(block)
    return pd.DataFrame(out, columns=["lo", "hi", "w", "wy", CHUNK])


def isotonic_blocks(rows: DataFrame, x: str, y: str, weight: str | None = None, rows_per_chunk: int | None = None) -> DataFrame:
    """Blocks (lo, hi, w, value) of the non-decreasing weighted least-squares fit of ``y`` on ``x``.

    Equal scores are summed first.  Chunks of the score, equally deep, pool their own violators; then neighbouring
    chunks pool theirs, in pairs that shift from round to round, until no two blocks in the whole order violate.  A
    task holds the blocks of two chunks at most, and the order of pooling does not change the result.  Rows with a
    null, or without weight, do not count.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = rows.select(F.col(x).cast("double").alias("lo"), F.col(y).cast("double").alias("y"), w.alias("w"))
    known = known.where("lo is not null and y is not null and w > 0")
    points = cut_lineage(known.groupBy("lo").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")))
    placed = chunk_borders(points, [], ["lo"], rows_per_chunk).apply(points)
    blocks = placed.select("lo", F.col("lo").alias("hi"), "w", "wy", F.col(CHUNK).cast("int").alias(CHUNK))
    blocks = cut_lineage(blocks.groupBy(CHUNK).applyInPandas(_pooled, BLOCKS))
    shift = 0
    while _violations(blocks):
        # Chunks whose blocks all went into an earlier one are gone; neighbours are those left.
        left = blocks.select(CHUNK).distinct().withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(CHUNK)))
        pair = F.floor((F.col("_place") + shift) / 2)
        blocks = cut_lineage(blocks.join(left, CHUNK).withColumn("_pair", pair).drop("_place").groupBy("_pair").applyInPandas(lambda b: _pooled(b.drop(columns="_pair")), BLOCKS))
        shift = 1 - shift
    return blocks.select("lo", "hi", "w", (F.col("wy") / F.col("w")).alias("value"))


def _violations(blocks: DataFrame) -> bool:
    """Whether a chunk's last block does not lie below the next chunk's first one; one row per chunk is compared."""
    mean = F.col("wy") / F.col("w")
    ends = blocks.groupBy(CHUNK).agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
    before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy(CHUNK))
    return not ends.withColumn("before", before).where("before >= first").isEmpty()


def fit_isotonic(rows: DataFrame, x: str, y: str, output: str, weight: str | None = None) -> IsotonicRegressionModel:
    """Spark's isotonic model, fitted on the two ends of each pooled block instead of on every row."""
    blocks = isotonic_blocks(rows, x, y, weight)
    ends = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    points = blocks.select(F.explode(ends).alias(x), F.col("value").alias(y), (F.col("w") / F.size(ends)).alias("_w"))
    return IsotonicRegression(featuresCol=x, labelCol=y, weightCol="_w", predictionCol=output).fit(points)
