"""Match training rows: team aggregates, labels and franchise momentum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.functions.franchise import canonical_franchise, same_franchise
from creaseline.functions.text import clean_text
from creaseline.operators.windows import chunk_window, conditional_prior, drop_prior_rows, with_prior_rows
from creaseline.plans.profiles import NEUTRAL_PROFILE, with_profiles
from creaseline.session import stage_table

MOMENTUM_DEPTH = 5
MOMENTUM_NEUTRAL = 0.5


def team_aggregates(features: DataFrame) -> DataFrame:
    """Pre-match means and strength score per (match, team)."""
    means = features.where(F.col("team").isNotNull()).groupBy("match_id", "team").agg(
        F.avg("form_runs").alias("team_avg_form_runs"),
        F.avg("form_wickets").alias("team_avg_form_wickets"),
        F.avg("strike_rate").alias("team_avg_strike_rate"),
        F.avg("economy").alias("team_avg_economy"),
        F.count("player_id").alias("team_n_players"),
        F.avg("form_runs_ipl").alias("team_avg_form_runs_ipl"),
        F.avg("form_wickets_ipl").alias("team_avg_form_wickets_ipl"),
    )
    runs = F.coalesce("team_avg_form_runs_ipl", "team_avg_form_runs")
    wickets = F.coalesce("team_avg_form_wickets_ipl", "team_avg_form_wickets")
    return means.withColumn("team_strength_score", runs * 0.4 + F.col("team_avg_strike_rate") * 0.3 + wickets * 0.3)


def team_totals(features: DataFrame) -> DataFrame:
    return features.groupBy("match_id", "team").agg(
        F.sum(F.coalesce(F.col("runs"), F.lit(0.0))).alias("team_total_runs")
    )


def _two_sided(teams: DataFrame, columns: list[str]) -> DataFrame:
    """Both team rows of a match side by side in name order, for matches with exactly two teams.

    A match has at most a few team rows, so the side-by-side row is one aggregate over ``match_id``.
    """
    packed = F.struct("team", *columns)
    return (
        teams.groupBy("match_id")
        .agg(F.min(packed).alias("a"), F.max(packed).alias("b"), F.count_distinct("team").alias("n"))
        .where(F.col("n") == 2)
        .select(
            "match_id",
            F.col("a.team").alias("team1_name"),
            F.col("b.team").alias("team2_name"),
            *[F.col(f"{x}.{c}").alias(f"{s}_{c}") for c in columns for x, s in (("a", "team1"), ("b", "team2"))],
        )
    )


def proxy_winners(features: DataFrame) -> DataFrame:
    """Winner by summed player runs for matches with exactly two teams."""
    sides = _two_sided(team_totals(features), ["team_total_runs"])
    r1, r2 = F.col("team1_team_total_runs"), F.col("team2_team_total_runs")
    return sides.withColumn(
        "winner", F.when(r1 > r2, "team1").when(r2 > r1, "team2").otherwise("tie")
    ).select("match_id", "winner")


def match_meta(stats: DataFrame) -> DataFrame:
    """First venue and earliest date per match."""
    return stats.groupBy("match_id").agg(
        F.min_by("venue", F.when(F.col("venue").isNotNull(), F.struct("player_id", "venue"))).alias("venue"),
        F.min("date").alias("match_date"),
    )


def two_team_rows(aggregates: DataFrame) -> DataFrame:
    renamed = aggregates.select(
        "match_id",
        "team",
        F.col("team_strength_score").alias("strength"),
        F.col("team_avg_form_runs").alias("form_runs"),
        F.col("team_avg_form_runs_ipl").alias("form_runs_ipl"),
        F.col("team_avg_strike_rate").alias("strike_rate"),
        F.col("team_avg_economy").alias("economy"),
    )
    return _two_sided(renamed, ["strength", "form_runs", "form_runs_ipl", "strike_rate", "economy"])


def resolve_labels(rows: DataFrame, official: DataFrame, proxy: DataFrame) -> DataFrame:
    """Official winner where it names a side (blank means tie), else the runs proxy, else missing.

    Where rows of a match disagree, the alphabetically first name counts.
    """
    named = official.groupBy("match_id").agg(
        F.min(clean_text("winner")).alias("_official"), F.lit(True).alias("_has_official")
    )
    joined = rows.join(named, "match_id", "left").join(
        proxy.select("match_id", F.col("winner").alias("_proxy")), "match_id", "left"
    )
    has = F.coalesce(F.col("_has_official"), F.lit(False))
    label = (
        F.when(has & F.col("_official").isNull(), "tie")
        .when(has & same_franchise(F.col("_official"), F.col("team1_name")), "team1")
        .when(has & same_franchise(F.col("_official"), F.col("team2_name")), "team2")
    )
    return (
        joined.withColumn("_label", label)
        .withColumns(
            {
                "winner": F.coalesce("_label", "_proxy"),
                "winner_source": F.when(F.col("_label").isNotNull(), "official")
                .when(F.col("_proxy").isNotNull(), "proxy")
                .otherwise("missing"),
            }
        )
        .drop("_official", "_has_official", "_proxy", "_label")
    )


def result_value(winner: Column, side: int) -> Column:
    """1 for a win, 0 for a loss, 0.5 for a tie, null for an unlabelled match."""
    won, lost = ("team1", "team2") if side == 1 else ("team2", "team1")
    return F.when(winner == won, 1.0).when(winner == lost, 0.0).when(winner == "tie", 0.5)


def _team_timeline(matches: DataFrame) -> DataFrame:
    """One row per match and side: franchise, result and whether the match is labelled."""
    sides = F.inline(
        F.array(
            *[
                F.struct(
                    canonical_franchise(f"team{s}_name").alias("franchise"),
                    F.lit(s).alias("side"),
                    result_value(F.col("winner"), s).alias("result"),
                )
                for s in (1, 2)
            ]
        )
    )
    return matches.select("match_id", "match_date", sides).withColumn("labelled", F.col("result").isNotNull())


def with_momentum(matches: DataFrame) -> DataFrame:
    """Win rate of each side over its previous five labelled matches; 0.5 without any."""
    line = conditional_prior(
        _team_timeline(matches), ["franchise"], ["match_date", "match_id", "side"], "labelled",
        {"momentum": "result"}, MOMENTUM_DEPTH,
    )
    sides = line.groupBy("match_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("side") == s, F.col("momentum"))), F.lit(MOMENTUM_NEUTRAL)).alias(
                f"team{s}_momentum"
            )
            for s in (1, 2)
        ]
    )
    return matches.join(sides, "match_id", "left")


def momentum_as_of(fixtures: DataFrame, history: DataFrame) -> DataFrame:
    """Momentum strictly before each fixture's date.

    Fixtures join the team timeline as rows that sort before the matches of their own day, so the
    as-of lookup is a window and not an inequality join.
    """
    played = _team_timeline(history.where(F.col("winner").isin("team1", "team2", "tie"))).select(
        "franchise", "match_date", F.lit(1).alias("kind"), F.col("match_id").alias("row_id"), "side", "result", "labelled"
    )
    asked = fixtures.select(
        F.col("match_date"),
        F.col("fixture_id").alias("row_id"),
        F.inline(
            F.array(
                *[
                    F.struct(canonical_franchise(f"team{s}_name").alias("franchise"), F.lit(s).alias("side"))
                    for s in (1, 2)
                ]
            )
        ),
    ).select(
        "franchise", "match_date", F.lit(0).alias("kind"), "row_id", "side",
        F.lit(None).cast("double").alias("result"), F.lit(False).alias("labelled"),
    )
    line = conditional_prior(
        played.unionByName(asked), ["franchise"], ["match_date", "kind", "row_id", "side"], "labelled",
        {"momentum": "result"}, MOMENTUM_DEPTH,
    ).where(F.col("kind") == 0)
    sides = line.groupBy(F.col("row_id").alias("fixture_id")).agg(
        *[
            F.coalesce(F.max(F.when(F.col("side") == s, F.col("momentum"))), F.lit(MOMENTUM_NEUTRAL)).alias(
                f"team{s}_momentum"
            )
            for s in (1, 2)
        ]
    )
    return fixtures.join(sides, "fixture_id", "left")


MATCH_COLUMNS = (
    "match_id", "team1_name", "team2_name", "team1_strength", "team2_strength", "team1_form_runs",
    "team2_form_runs", "team1_form_runs_ipl", "team2_form_runs_ipl", "team1_strike_rate",
    "team2_strike_rate", "team1_economy", "team2_economy", "team1_total_runs", "team2_total_runs", "venue",
    "match_date", "team1_momentum", "team2_momentum", "winner", "winner_source",
)
PROFILE_COLUMNS = tuple(f"{s}_{c}" for c in NEUTRAL_PROFILE for s in ("team1", "team2"))


def match_rows(
    features: DataFrame, stats: DataFrame, official: DataFrame, profiles: DataFrame | None = None
) -> DataFrame:
    """Match training rows; profile columns are kept when profiles are given."""
    totals = _two_sided(team_totals(features), ["team_total_runs"]).select(
        "match_id",
        F.col("team1_team_total_runs").alias("team1_total_runs"),
        F.col("team2_team_total_runs").alias("team2_total_runs"),
    )
    rows = resolve_labels(two_team_rows(team_aggregates(features)), official, proxy_winners(features))
    rows = rows.join(totals, "match_id", "left").join(match_meta(stats), "match_id", "left")
    # Momentum reads the labelled rows three times.
    rows = with_momentum(stage_table(rows, "labelled_matches"))
    columns = MATCH_COLUMNS
    if profiles is not None:
        rows, columns = with_profiles(rows, profiles), MATCH_COLUMNS + PROFILE_COLUMNS
    return rows.select(*columns)


def team_centric(matches: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Own runs, opponent runs, win flag and margin of one team in every decided match it played."""
    own1 = F.trim("team1_name").isin(*names)
    own2 = F.trim("team2_name").isin(*names)
    r1, r2 = F.col("team1_total_runs"), F.col("team2_total_runs")
    won = (own1 & (F.col("winner") == "team1")) | (own2 & (F.col("winner") == "team2"))
    return (
        matches.where(F.col("winner").isin("team1", "team2") & (own1 | own2))
        .select(
            "match_id",
            "match_date",
            F.when(own1, r1).otherwise(r2).alias("own_runs"),
            F.when(own1, r2).otherwise(r1).alias("opp_runs"),
            won.cast("int").alias("win"),
        )
        .withColumn("margin", F.col("own_runs") - F.col("opp_runs"))
    )


def rolling_win_rate(team_matches: DataFrame, depth: int = 15, minimum: int = 5) -> DataFrame:
    """Win rate over the last ``depth`` matches including the current one, per team."""
    order = ["match_date", "match_id"]
    frame = chunk_window(["team"], order).rowsBetween(-(depth - 1), 0)
    rows = with_prior_rows(team_matches, ["team"], order, ["win"], depth - 1)
    rate = F.when(F.count("win").over(frame) >= minimum, F.avg("win").over(frame))
    return drop_prior_rows(rows.withColumn("win_rate", rate))
