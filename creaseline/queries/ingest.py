"""Registered queries: delivery files written from the given tables and read back, as batch and as stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from creaseline.queries import views
from creaseline.queries.core import FEATURE_DOUBLES
from creaseline.queries.registry import query, r, rounded
from creaseline.schemas import DELIVERIES
from creaseline.session import ensure_checkpoint_dir
from creaseline.sources import deliveries as src
from creaseline.streaming import drops, timelines

_BALLS = "SELECT DISTINCT match_id, innings, over, ball_in_over, batter, bowler, non_striker, runs_off_bat, extras FROM deliveries"


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest/{uuid.uuid4().hex}/{name}"


def _typed(spark, sf):
    return views.deliveries(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in DELIVERIES.fields])


@query(
    "a03_a04_csv_ingest",
    """SELECT match_id, innings, batting_team, bowling_team, venue, date, competition, count(*) AS balls, sum(runs_off_bat) AS runs, sum(extras) AS extras, CAST(sum(is_wide) AS BIGINT) AS wides, CAST(sum(is_noball) AS BIGINT) AS noballs,
    count(CASE WHEN dismissal_kind <> '' THEN 1 END) AS outs FROM deliveries GROUP BY match_id, innings, batting_team, bowling_team, venue, date, competition""",
)
def _(spark, sf):
    """Half of the matches in a feed dialect, half in a historical one; all read by one ingest."""
    root = _folder(spark, "csv")
    d = _typed(spark, sf)
    feed = d.where("match_id % 2 = 0").selectExpr(
        "match_id", "innings", "over", "ball_in_over", "batter AS batter_id", "non_striker AS non_striker_id", "bowler AS bowler_id",
        "batting_team", "bowling_team", "runs_off_bat AS runs_batter", "extras AS runs_extras",
        "CASE WHEN is_wide = 1 THEN 'wide' WHEN is_noball = 1 THEN 'noball' ELSE '' END AS extras_type", "dismissal_kind <> '' AS wicket",
        "dismissal_kind", "player_dismissed AS batter_out_id", "venue", "date", "competition",
    )
    old = d.where("match_id % 2 = 1").selectExpr(
        "match_id AS matchId", "batter AS batsman", "bowler", "non_striker", "runs_off_bat + extras AS total_runs", "extras",
        "is_wide AS isWide", "is_noball AS isNoBall", "dismissal_kind AS wicket_type", "player_dismissed", "date AS start_date", "venue",
        "batting_team", "bowling_team", "innings", "over", "ball_in_over", "competition",
    )
    for name, rows in (("feed", feed), ("old", old)):
        rows.write.option("header", "true").csv(f"{root}/{name}")
    back = src.csv_deliveries(src.csv_rows(spark, [root]))
    keys = ("innings", "batting_team", "bowling_team", "venue", "date", "competition")
    return back.groupBy(F.col("match_id").try_cast("long").alias("match_id"), *keys).agg(
        F.count(F.lit(1)).alias("balls"), F.sum("runs_off_bat").alias("runs"), F.sum("extras").alias("extras"),
        F.sum("is_wide").alias("wides"), F.sum("is_noball").alias("noballs"), F.count_if(F.col("dismissal_kind") != "").alias("outs"),
    )


@query(
    "b19_match_id_numbers",
    "SELECT match_id, CASE WHEN match_id % 3 = 0 THEN match_id ELSE 909999999 + rank END AS number FROM (SELECT match_id, row_number() OVER (PARTITION BY match_id % 3 = 0 ORDER BY concat('folder', CAST(match_id % 7 AS VARCHAR), '/m', CAST(match_id AS VARCHAR)), match_id) AS rank FROM (SELECT DISTINCT match_id FROM deliveries) x) y",
)
def _(spark, sf):
    rows = views.deliveries(spark, sf).selectExpr(
        "match_id AS original", "CASE WHEN match_id % 3 = 0 THEN CAST(match_id AS STRING) ELSE concat('ipl-', match_id) END AS match_id",
        "concat('folder', match_id % 7, '/m', match_id) AS path", "CAST(ball_in_over AS BIGINT) AS line",
    )
    numbered = src.number_match_ids(rows)
    return numbered.select(F.col("original").alias("match_id"), F.col("match_id").alias("number")).distinct()


#: Balls in a dropped file, about; larger tables come in more files and as many batches.
BALLS_PER_FILE = 500_000


def _repeated_drops(spark, sf):
    """Files in no date order, with the balls of a third of the matches twice in one file and once more in later ones; four batches."""
    drop = _folder(spark, "drop")
    balls, again = _typed(spark, sf), _typed(spark, sf).where("match_id % 3 = 0")
    files = 1 + balls.count() // (6 * BALLS_PER_FILE)
    copies = F.explode(F.when(F.expr("match_id % 3 = 0"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    dealt = balls.repartition(6 * files, F.xxhash64("match_id", "over"))
    dealt.withColumn("_copy", copies).drop("_copy").write.parquet(drop)
    again.repartition(2 * files, F.xxhash64("match_id", "over", "batter")).write.mode("append").parquet(drop)
    return drops.read_drops(spark, drop, files_per_batch=2 * files)


@query("k01_k02_stream_unique_balls", _BALLS)
def _(spark, sf):
    """Delivery files in no date order, a part of the balls twice in one file and again in later files, in several batches."""
    table = _folder(spark, "table")
    drops.append_deliveries(_repeated_drops(spark, sf), table, _folder(spark, "ckpt")).awaitTermination()
    return drops.ball_log(spark, table).read().select(*src.BALL_KEY)


@query(
    "k03_stream_innings_totals",
    """SELECT match_id, innings, sum(runs_off_bat + extras) AS runs, CAST(sum(wicket) AS BIGINT) AS wickets, count(*) AS balls FROM (
    SELECT match_id, innings, over, ball_in_over, batter, bowler, non_striker, runs_off_bat, extras, max(CASE WHEN dismissal_kind <> '' THEN 1 ELSE 0 END) AS wicket FROM deliveries
    GROUP BY match_id, innings, over, ball_in_over, batter, bowler, non_striker, runs_off_bat, extras) x GROUP BY match_id, innings""",
)
def _(spark, sf):
    """The balls of a third of the matches come twice in one file and once more in a later file, and count once."""
    table = _folder(spark, "totals")
    drops.write_innings_totals(_repeated_drops(spark, sf), table, _folder(spark, "ckpt")).awaitTermination()
    return drops.current_innings_totals(spark, table)


def _late_drops(spark, sf):
    """Three batches of files: late matches last, and some of the balls of every fifth match in the batch before their others."""
    drop = _folder(spark, "drop")
    d = _typed(spark, sf)
    part = "CASE WHEN match_id % 5 = 0 AND over < 8 THEN 0 WHEN match_id % 7 = 3 THEN 2 ELSE 1 END"
    files = 1 + d.count() // (3 * BALLS_PER_FILE)
    for k in range(3):
        d.where(f"{part} = {k}").repartition(files, F.xxhash64("match_id", "over", "batter")).write.mode("append").parquet(drop)
    return drops.read_drops(spark, drop, files_per_batch=files)


@query("k04_stream_player_stats", f"SELECT match_key, player_id, role, wickets, {r('runs', 'runs_conceded')} FROM pms", of_unique_balls=True)
def _(spark, sf):
    table, stats = _folder(spark, "table"), _folder(spark, "stats")
    drops.refresh_player_stats(_late_drops(spark, sf), table, stats, _folder(spark, "ckpt"), buckets=8).awaitTermination()
    rows = drops.current_player_stats(spark, stats, buckets=8)
    return rounded(rows.select("match_key", "player_id", "role", "wickets", "runs", "runs_conceded"))


@query(
    "k04_stream_player_features",
    f"SELECT match_id, player_id, team, runs, wickets, is_franchise_match, opponent_team, {r(*FEATURE_DOUBLES)} FROM feat",
    of_unique_balls=True,
)
def _(spark, sf):
    """Features kept up to date while matches come late and grow equal those of a full rebuild."""
    table, root = _folder(spark, "table"), _folder(spark, "timelines")
    rows = timelines.refresh_features(_late_drops(spark, sf), table, root, views.franchises(spark, sf), _folder(spark, "ckpt"), buckets=8)
    rows.awaitTermination()
    return rounded(timelines.current_features(spark, root, buckets=8))
