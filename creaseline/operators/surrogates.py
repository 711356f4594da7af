"""Numbers for natural keys, kept in an append-only dictionary: equal keys keep their number over all loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline.operators.buckets import BucketLog
from creaseline.operators.windows import global_row_number
from creaseline.session import cut_lineage

#: Numbers between the starts of two ranges; a range that is full goes on far above all starts.
SPAN, FAR = 10_000_000, 10_000

DICTIONARY = T.StructType([T.StructField("natural", T.StringType()), T.StructField("number", T.LongType())])


def spaced_number(first: int, place: Column) -> Column:
    """The number of the key at a 0-based place of the range that begins at ``first``; ranges never meet."""
    return F.when(place < SPAN, place + first).otherwise(place + first * FAR).cast("long")


def dictionary(spark: SparkSession, path: str) -> BucketLog:
    return BucketLog(spark, path, DICTIONARY, ["natural"])


def surrogate_numbers(names: DataFrame, path: str, first: int, load: int, order: Sequence[str] = ()) -> DataFrame:
    """(natural, number) of every key in ``names`` (natural, and the columns of ``order``).

    Keys that the dictionary below ``path`` lacks are appended to it as load number ``load`` with the next numbers, in
    the given order, then by key.  Numbers are dense and begin at ``first``; they come from counts per chunk and no
    two keys share one.  A load that runs again finds the dictionary as it was before it.  Null keys get none.
    """
    known_keys = dictionary(names.sparkSession, path)
    asked = names.where(F.col("natural").isNotNull()).groupBy("natural")
    asked = cut_lineage(asked.agg(*[F.min(c).alias(c) for c in order]) if order else asked.agg(F.lit(1).alias("_one")))
    known = cut_lineage(known_keys.earlier(asked, load).join(asked.select("natural"), "natural", "left_semi"))
    new = asked.join(known.select("natural"), "natural", "left_anti")
    _, before = known_keys.state(load)
    numbered = global_row_number(new, [*order, "natural"]).select("natural", spaced_number(first, F.col("rn") - 1 + before).alias("number"))
    numbered = cut_lineage(numbered)
    known_keys.append(numbered, load)
    return known.unionByName(numbered)
