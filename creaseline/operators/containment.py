"""Substring joins between two sets of distinct strings, blocked by short character runs.

A string can only contain another one if it contains the other's rarest run of four characters, so the
candidates come from an equi-join on that run and no pair of strings is formed without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.session import stage_table

GRAM = 4


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters of a text at least that long."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))))


def containing_pairs(needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str) -> DataFrame:
    """All (needle, haystack) pairs where the haystack contains the needle."""
    # Both lists are read several times below; written once, their inputs are evaluated once.
    n = stage_table(needles.select(F.col(needle).alias("_needle")).where(F.col("_needle") != "").distinct(), "needles")
    h = stage_table(haystacks.select(F.col(haystack).alias("_hay")).where(F.col("_hay") != "").distinct(), "haystacks")
    index_parts = [
        h.select("_hay", F.explode(_grams(F.col("_hay"), size)).alias("_gram")) for size in range(1, GRAM + 1)
    ]
    index = index_parts[0]
    for part in index_parts[1:]:
        index = index.unionByName(part)
    spread = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_spread"))
    size_of = F.least(F.length("_needle"), F.lit(GRAM))
    starts = F.sequence(F.lit(1), F.length("_needle") - size_of + 1)
    runs = n.select("_needle", F.explode(F.transform(starts, lambda i: F.substr(F.col("_needle"), i, size_of))).alias("_gram"))
    rarest = (
        runs.join(spread, "_gram", "left")
        .groupBy("_needle")
        .agg(F.min(F.struct(F.coalesce("_spread", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_best"))
        .select("_needle", F.col("_best.g").alias("_gram"))
    )
    pairs = rarest.join(index, "_gram").where(F.col("_hay").contains(F.col("_needle")))
    return pairs.select(F.col("_needle").alias(needle), F.col("_hay").alias(haystack))


def loose_name_pairs(asked: DataFrame, known: DataFrame, name: str = "asked", other: str = "known") -> DataFrame:
    """Pairs of normalised names where either contains the other; ``exact`` marks equal names."""
    inside = containing_pairs(asked, known, name, other)
    around = containing_pairs(known, asked, other, name)
    return inside.unionByName(around).distinct().withColumn("exact", F.col(name) == F.col(other))


def venue_token_hits(queries: DataFrame, venues: DataFrame, query: str, venue: str) -> tuple[DataFrame, DataFrame]:
    """((query, _token), (_token, venue)): what a query is asked for by, and the venues that hold each token.

    A query's tokens are its whole text and its words of four letters or more.  Texts are compared in lower case and
    keep their spellings.  Both tables are inverted lists of distinct texts; a word that many queries share ("stadium")
    meets the venues once.
    """
    q = queries.select(F.col(query).alias("_q0"), F.lower(F.trim(query)).alias("_q")).where(F.col("_q") != "").distinct()
    v = venues.select(F.col(venue).alias("_v0"), F.lower(F.trim(venue)).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    tokens = q.select(
        "_q0",
        F.explode(F.array_union(F.array("_q"), F.regexp_extract_all("_q", F.lit("[a-z]{4,}"), F.lit(0)))).alias("_token"),
    )
    hits = containing_pairs(tokens, v, "_token", "_v").join(v, "_v")
    return tokens.select(F.col("_q0").alias(query), "_token"), hits.select("_token", F.col("_v0").alias(venue))


def venue_query_pairs(queries: DataFrame, venues: DataFrame, query: str, venue: str) -> DataFrame:
    """(query, venue) pairs where the venue holds the whole query or any of its words of four letters or more."""
    tokens, hits = venue_token_hits(queries, venues, query, venue)
    return tokens.join(hits, "_token").select(query, venue).distinct()


def best_loose_match(asked: DataFrame, known: DataFrame, name: str = "asked", other: str = "known") -> DataFrame:
    """One known name per asked name: an equal one, else the longest that contains it or lies in it."""
    ranked = loose_name_pairs(asked, known, name, other).groupBy(name).agg(
        F.max(F.struct(F.col("exact"), F.length(other).alias("len"), F.col(other).alias("name"))).alias("_best")
    )
    return ranked.select(name, F.col("_best.name").alias(other))
