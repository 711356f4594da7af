"""Build diagnostics: role mix, missing teams, matchup coverage and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.operators.windows import with_table_stats


def role_distribution(stats: DataFrame) -> DataFrame:
    return stats.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def missing_team_share(stats: DataFrame) -> DataFrame:
    """Percent of rows without a team on either side."""
    blank = F.lit(False)
    for side in ("batting_team", "bowling_team"):
        blank = blank | F.col(side).isNull() | (F.trim(side) == "")
    return stats.agg((F.avg(blank.cast("double")) * 100.0).alias("pct_missing_teams"))


def leakage_check(features: DataFrame, strength: DataFrame) -> DataFrame:
    """Past opponent strength against the opponent's current top-five sum: correlation and exact-match rate."""
    current = strength.select("match_id", F.col("team").alias("opponent_team"), F.col("top5_runs").alias("now"))
    joined = features.join(current, ["match_id", "opponent_team"], "inner").where(
        F.col("now").isNotNull() & F.col("opponent_past_batting_strength").isNotNull()
    )
    past = F.col("opponent_past_batting_strength")
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(past, F.col("now")).alias("correlation"),
        F.avg((past == F.col("now")).cast("double")).alias("exact_match_rate"),
    )


def strength_win_correlation(matches: DataFrame) -> DataFrame:
    won = (F.col("winner") == "team1").cast("double")
    decided = matches.where(F.col("winner").isin("team1", "team2"))
    return decided.agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(F.col("team1_strength") - F.col("team2_strength"), won).alias("correlation"),
    )


def margin_histogram(team_matches: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width counts of the run margin; empty bins are left out."""
    bounds = team_matches.agg(F.min("margin").alias("lo"), F.max("margin").alias("hi"))
    lo, hi = F.col("_bounds.lo"), F.col("_bounds.hi")
    place = F.when(hi > lo, F.least(F.floor((F.col("margin") - lo) / (hi - lo) * bins), F.lit(bins - 1)))
    return with_table_stats(team_matches, bounds, "_bounds").groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
