"""Scorecard lines to player-match rows and to synthetic deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.functions.cricket import bowler_of_dismissal, dismissal_kind_of, dismissed_flag
from creaseline.functions.text import number_or_zero
from creaseline.operators.surrogates import surrogate_numbers
from creaseline.plans.identity import resolve_display_names
from creaseline.plans.stats import match_key
from creaseline.schemas import PLAYER_MATCH

SCORECARD_STATS_BASE = 920_000_000
SCORECARD_MATCH_BASE = 900_000_000


def scorecard_innings_key() -> Column:
    """Natural key of a scorecard innings: match, innings and team as one text."""
    return F.to_json(F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("match", "innings", "team")]))


def scorecard_player_rows(
    cards: DataFrame, aliases: DataFrame, ids: str, load: int = 0, date: str = "2026-02-15", venue: str = "ICC T20 WC 2026"
) -> DataFrame:
    """One batting row per scorecard line with a player; nothing is known about bowling.

    An innings gets a number of its own from the dictionary below ``ids``, which later loads (a higher ``load``) keep.
    """
    lines = cards.where(F.trim(F.coalesce("player", F.lit(""))) != "").withColumn("natural", scorecard_innings_key())
    numbers = surrogate_numbers(lines.select("natural"), ids, SCORECARD_STATS_BASE, load)
    named = resolve_display_names(lines.join(numbers, "natural"), "player", aliases)
    zero = F.lit(0.0)
    day = F.lit(date).cast("date")
    rows = named.select(
        F.col("number").alias("match_id"), "player_id", day.alias("date"), F.lit(venue).alias("venue"),
        F.trim("team").alias("batting_team"), F.lit("unknown").alias("bowling_team"),
        *[number_or_zero(c).alias(c) for c in ("runs", "balls", "fours", "sixes")],
        dismissed_flag(F.col("dismissal")).alias("dismissed"),
        *[zero.alias(c) for c in ("wickets", "balls_bowled", "runs_conceded")],
        number_or_zero("balls").alias("total_balls_faced"), zero.alias("total_balls_bowled"),
        F.lit("batter").alias("role"),
    )
    return rows.withColumn("match_key", match_key(F.col("match_id"), F.col("date"))).select(*PLAYER_MATCH)


def scorecard_deliveries(cards: DataFrame, matches: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One synthetic ball per ball faced: runs spread evenly, the dismissal on the last ball.

    Lines of teams that did not play the match, of unknown matches and of matches already loaded give
    nothing.  All delivery columns exist; what a scorecard cannot tell is null.
    """
    meta = matches.where(F.trim(F.coalesce("group", F.lit(""))) != "").select(
        F.trim("group").alias("_match"),
        (F.coalesce("match_no", F.lit(0)) + SCORECARD_MATCH_BASE).cast("long").alias("match_id"),
        "date", F.trim("venue").alias("venue"), F.trim("team1").alias("_t1"), F.trim("team2").alias("_t2"),
    )
    if existing is not None:
        meta = meta.join(existing.select("match_id").distinct(), "match_id", "left_anti")
    team = F.trim("team")
    opponent = F.when(team == F.col("_t1"), F.col("_t2")).when(team == F.col("_t2"), F.col("_t1"))
    lines = (
        cards.join(meta, F.trim("match") == F.col("_match"))
        .withColumns(
            {
                "_opp": opponent,
                "_runs": number_or_zero("runs").cast("int"),
                "_balls": number_or_zero("balls").cast("int"),
            }
        )
        .where(F.col("_opp").isNotNull() & (F.col("_opp") != "") & (F.col("_balls") > 0))
    )
    balls = lines.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_balls") - 1)))
    share = F.floor(F.col("_runs") / F.col("_balls")) + (F.col("_i") < F.col("_runs") % F.col("_balls")).cast("int")
    kind = dismissal_kind_of(F.col("dismissal"), F.col("_i") == F.col("_balls") - 1)
    player = F.trim("player")
    return balls.select(
        "match_id", "date", "venue", team.alias("batting_team"), F.col("_opp").alias("bowling_team"),
        player.alias("batter"), bowler_of_dismissal(F.col("dismissal")).alias("bowler"),
        F.concat(player, F.lit("_"), F.col("_i").cast("string")).alias("non_striker"),
        share.cast("double").alias("runs_off_bat"), F.lit(0.0).alias("extras"),
        F.lit(0).alias("is_wide"), F.lit(0).alias("is_noball"), kind.alias("dismissal_kind"),
        F.when(kind != "", player).otherwise("").alias("player_dismissed"),
        *[F.lit(None).cast("int").alias(c) for c in ("innings", "over", "ball_in_over")],
        F.lit(None).cast("string").alias("competition"),
    )
