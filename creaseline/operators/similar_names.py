"""Exact edit-distance join of names inside blocks, without forming the pairs of a block.

A name within k edits of another one keeps at least one of its k + 1 equal parts unchanged, at most k places away
(the pigeonhole principle).  Parts of the known names are joined with the possible places of such parts in the asked
names; only these candidates are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.functions.text import similarity


def _edits(length: Column, threshold: float) -> Column:
    """Most edits between a name of this length and a partner of at least the similarity, whichever is longer."""
    longest = F.floor(length * 100.0 / threshold + 1e-9)
    return F.floor((100.0 - threshold) / 100.0 * longest + 1e-9).cast("int")


def _part(length: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """0-based start and length of part i of a name cut into equal parts."""
    start = F.floor(i * length / parts)
    return start.cast("int"), (F.floor((i + 1) * length / parts) - start).cast("int")


def similar_pairs(
    asked: DataFrame, known: DataFrame, block: Sequence[str], name: str, other: str, threshold: float
) -> DataFrame:
    """(block, name, other, score) of the names of a block with a similarity of at least ``threshold``, all of them.

    ``asked`` has the columns ``block`` and ``name``, ``known`` ``block`` and ``other``.  Similarity is that of
    `functions.text.similarity`.  Null and empty names, and null blocks, meet nothing.  With a threshold of 50 or
    less, short names may have fewer letters than parts; empty parts then meet all names of their lengths.
    """
    a = asked.select(*block, name).where(F.col(name) != "").distinct().withColumn("_la", F.length(name))
    b = known.select(*block, other).where(F.col(other) != "").distinct().withColumn("_l", F.length(other))
    b = b.withColumn("_parts", _edits(F.col("_l"), threshold) + 1)
    b = b.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    start, length = _part(F.col("_l"), F.col("_parts"), F.col("_i"))
    index = b.select(*block, other, "_l", "_i", F.substr(F.col(other), start + 1, length).alias("_text"))

    # Lengths that a partner of the name may have; for each, every place where one of its parts may stand.
    shortest, longest = F.ceil(F.col("_la") * threshold / 100.0 - 1e-9), F.floor(F.col("_la") * 100.0 / threshold + 1e-9)
    probes = a.withColumn("_l", F.explode(F.sequence(F.greatest(shortest, F.lit(1)).cast("int"), longest.cast("int"))))
    probes = probes.withColumn("_parts", _edits(F.col("_l"), threshold) + 1)
    probes = probes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    probes = probes.withColumn("_shift", F.explode(F.sequence(1 - F.col("_parts"), F.col("_parts") - 1)))
    start, length = _part(F.col("_l"), F.col("_parts"), F.col("_i"))
    at = start + F.col("_shift")
    probes = probes.where((at >= 0) & (at + length <= F.col("_la")))
    probes = probes.select(*block, name, "_l", "_i", F.substr(F.col(name), at + 1, length).alias("_text")).distinct()

    met = probes.join(index, [*block, "_l", "_i", "_text"]).select(*block, name, other).distinct()
    return met.withColumn("score", similarity(name, other)).where(F.col("score") >= threshold)
