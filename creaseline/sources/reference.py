"""Reference tables, official results, records and fixture payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creaseline import schemas
from creaseline.functions.cricket import resolved_batting_first
from creaseline.functions.text import clean_text
from creaseline.operators.buckets import path_exists

TABLES = {
    "squads": schemas.SQUADS, "fixtures": schemas.FIXTURES, "aliases": schemas.ALIASES, "registry": schemas.REGISTRY,
    "identity": schemas.IDENTITY, "bridge": schemas.BRIDGE, "profiles": schemas.PROFILES,
    "bowling_style": schemas.BOWLING_STYLE, "scorecards": schemas.SCORECARDS,
    "scorecard_matches": schemas.SCORECARD_MATCHES,
}


def read_reference(spark: SparkSession, name: str, path: str, line_breaks: bool = False) -> DataFrame:
    """A reference CSV by column name: texts trimmed, numbers coerced, absent columns null.

    A missing optional file gives an empty table of the right shape.  Files are split among tasks; with
    ``line_breaks``, cells may hold line breaks in quotes, and a file is read by one task.
    """
    schema = TABLES[name]
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", "true").option("multiLine", str(line_breaks).lower()).csv(path)
    have = {c.strip(): c for c in raw.columns}

    def cell(field: T.StructField):
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        text = F.trim(F.col(f"`{have[field.name]}`"))
        if isinstance(field.dataType, T.StringType):
            return text.alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.LongType)):
            return F.coalesce(text.try_cast("double").cast(field.dataType), F.lit(0).cast(field.dataType)).alias(field.name)
        return text.try_cast(field.dataType).alias(field.name)

    return raw.select(*[cell(f) for f in schema.fields])


def read_official_results(spark: SparkSession, path: str) -> DataFrame:
    """match_id, winner, team1, team2 with numeric ids; rows without an id are dropped."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.OFFICIAL_RESULTS)
    raw = spark.read.option("header", "true").csv(path)
    if "matchId" not in raw.columns:
        return spark.createDataFrame([], schemas.OFFICIAL_RESULTS)
    texts = [F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("winner", "team1", "team2")]
    return raw.select(F.col("matchId").try_cast("double").cast("long").alias("match_id"), *texts).where(
        F.col("match_id").isNotNull()
    )


def _records(spark: SparkSession, roots: Sequence[str] | str, schema: T.StructType, glob: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
    paths = [roots] if isinstance(roots, str) else list(roots)
    return reader.option("pathGlobFilter", glob).json(paths)


def read_predictions(spark: SparkSession, roots, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) prediction records; a record needs all fields, five batters and three bowlers."""
    rows = _records(spark, roots, schemas.PREDICTION_RECORD, glob)
    return split_predictions(rows)


def split_predictions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.lit(True)
    for f in schemas.PREDICTION_RECORD.fieldNames():
        if f != "pred_extra":
            ok = ok & F.col(f).isNotNull()
    ok = ok & (F.size("pred_top5_bats") == 5) & (F.size("pred_top3_bowls") == 3)
    checked = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return checked.where("_ok").drop("_ok"), checked.where(~F.col("_ok")).drop("_ok")


def read_results(spark: SparkSession, roots, glob: str = "*.json") -> DataFrame:
    return _records(spark, roots, schemas.RESULT_RECORD, glob).where(clean_text("match_key").isNotNull())


def read_reviews(spark: SparkSession, roots, glob: str = "*.json") -> DataFrame:
    return _records(spark, roots, schemas.REVIEW_RECORD, glob).where(clean_text("match_key").isNotNull())


def read_payloads(spark: SparkSession, roots, glob: str = "*.json") -> DataFrame:
    return normalise_payloads(_records(spark, roots, schemas.PAYLOAD, glob))


def normalise_payloads(raw: DataFrame) -> DataFrame:
    """Fixture payloads with both elevens as arrays and the side that bats first.

    An eleven may be a JSON list or a comma text, under either of two names.
    """

    def eleven(*names: str):
        text = F.coalesce(*[clean_text(n) for n in names])
        listed = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
        cells = F.when(text.startswith("["), listed).otherwise(F.split(text, ","))
        cleaned = F.filter(F.transform(cells, lambda x: F.trim(x)), lambda x: x != "")
        return F.coalesce(cleaned, F.array().cast("array<string>"))

    first = resolved_batting_first(
        F.col("toss_winner"), F.col("elected_to"), F.col("team1_name"), F.col("team2_name"), F.col("batting_first")
    )
    return raw.select(
        clean_text("match_id").alias("match_id"), F.trim(F.coalesce("team1_name", F.lit(""))).alias("team1_name"),
        F.trim(F.coalesce("team2_name", F.lit(""))).alias("team2_name"),
        eleven("xi1", "playing_xi_team1").alias("xi1"), eleven("xi2", "playing_xi_team2").alias("xi2"),
        first.alias("batting_first"), F.coalesce(clean_text("pitch_text"), clean_text("pitch_report")).alias("pitch_text"),
        clean_text("venue").alias("venue"), clean_text("notes").alias("notes"), clean_text("match_date").alias("match_date"),
    )
