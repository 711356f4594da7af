"""Franchise profiles from innings of the league."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.functions.franchise import canonical_franchise, is_league_row
from creaseline.functions.text import clip
from creaseline.operators.quantiles import exact_medians
from creaseline.operators.windows import with_table_stats
from creaseline.plans.stats import innings_table
from creaseline.session import stage_table

RATIOS = ("bat_first_ratio", "chase_ratio", "pp_bat_ratio", "bowl_first_stingy", "bowl_second_stingy")
DOMINANCE = ("bat_dom", "bowl_dom", "field_dom")
RATIO_LOW, RATIO_HIGH = 0.65, 1.45
BOWL_RUN_OUT_WEIGHT, FIELD_RUN_OUT_WEIGHT = 0.35, 0.25
NEUTRAL_PROFILE = {**{c: 1.0 for c in RATIOS}, **{c: 0.0 for c in DOMINANCE}}


def league_innings(deliveries: DataFrame) -> DataFrame:
    return innings_table(deliveries.where(is_league_row(F.col("competition"))))


def league_baselines(innings: DataFrame) -> DataFrame:
    """One row: mean total of first and second innings and mean powerplay, each at least 1."""

    def mean(value: str, number: int | None = None) -> Column:
        c = F.col(value) if number is None else F.when(F.col("innings") == number, F.col(value))
        return F.greatest(F.avg(c), F.lit(1.0))

    return innings.agg(
        mean("runs", 1).alias("league_1"), mean("runs", 2).alias("league_2"), mean("pp_runs").alias("league_pp")
    )


def team_innings_means(innings: DataFrame) -> DataFrame:
    """Batting, chasing, powerplay, conceding, wicket and run-out means per team in one grouping."""
    stacked = innings.select(
        "innings",
        "runs",
        "pp_runs",
        "wickets",
        "run_outs",
        F.inline(
            F.array(
                F.struct(F.trim("batting_team").alias("team"), F.lit("bat").alias("side")),
                F.struct(F.trim("bowling_team").alias("team"), F.lit("bowl").alias("side")),
            )
        ),
    ).where((F.col("team") != "") & (F.lower("team") != "nan"))

    def of(side: str, value: str, number: int | None) -> Column:
        keep = F.col("side") == side
        if number is not None:
            keep = keep & (F.col("innings") == number)
        return F.when(keep, F.col(value))

    return stacked.groupBy("team").agg(
        F.avg(of("bat", "runs", 1)).alias("mean_runs_bf"),
        F.avg(of("bat", "runs", 2)).alias("mean_runs_chase"),
        F.avg(of("bat", "pp_runs", None)).alias("mean_pp_bat"),
        F.avg(of("bowl", "runs", 1)).alias("mean_conceded_bf"),
        F.avg(of("bowl", "runs", 2)).alias("mean_conceded_chase"),
        F.avg(of("bowl", "wickets", 1)).alias("wk_1"),
        F.avg(of("bowl", "wickets", 2)).alias("wk_2"),
        F.avg(of("bowl", "run_outs", 1)).alias("ro_1"),
        F.avg(of("bowl", "run_outs", 2)).alias("ro_2"),
        F.count(of("bat", "runs", 1)).alias("n_innings_bat_1"),
        F.count(of("bat", "runs", 2)).alias("n_innings_bat_2"),
    )


def clean_ratio(c: Column) -> Column:
    return clip(F.coalesce(c, F.lit(1.0)), RATIO_LOW, RATIO_HIGH)


def team_ratios(means: DataFrame, baselines: DataFrame) -> DataFrame:
    """Ratios to the league, cleaned and clipped, and the raw dominance values."""
    league = F.col("_league")

    def stingy(base: Column, conceded: str) -> Column:
        return F.when(F.col(conceded) > 0, base / F.col(conceded))

    wickets, run_outs = (F.col("wk_1") + F.col("wk_2")) / 2.0, (F.col("ro_1") + F.col("ro_2")) / 2.0
    return with_table_stats(means, baselines, "_league").select(
        "team",
        clean_ratio(F.col("mean_runs_bf") / league["league_1"]).alias("bat_first_ratio"),
        clean_ratio(F.col("mean_runs_chase") / league["league_2"]).alias("chase_ratio"),
        clean_ratio(F.col("mean_pp_bat") / league["league_pp"]).alias("pp_bat_ratio"),
        clean_ratio(stingy(league["league_1"], "mean_conceded_bf")).alias("bowl_first_stingy"),
        clean_ratio(stingy(league["league_2"], "mean_conceded_chase")).alias("bowl_second_stingy"),
        ((F.col("mean_runs_bf") + F.col("mean_runs_chase")) / 2.0).alias("bat_dom_raw"),
        (wickets + run_outs * BOWL_RUN_OUT_WEIGHT).alias("bowl_dom_raw"),
        (wickets + run_outs * FIELD_RUN_OUT_WEIGHT).alias("field_dom_raw"),
        "n_innings_bat_1",
        "n_innings_bat_2",
    )


def with_dominance(ratios: DataFrame) -> DataFrame:
    """Raw values to z-scores over the teams: nulls to the median, flat columns to zero."""
    raws = [f"{d}_raw" for d in DOMINANCE]
    medians = exact_medians(ratios, raws)
    packed = medians.agg(F.map_from_entries(F.collect_list(F.struct("name", "median"))).alias("m"))
    known = with_table_stats(ratios, packed, "_medians")
    filled = known.withColumns({r: F.coalesce(F.col(r), F.col("_medians.m")[r]) for r in raws}).drop("_medians")
    moments = filled.agg(
        *[F.avg(r).alias(f"mean_{r}") for r in raws], *[F.stddev_samp(r).alias(f"sd_{r}") for r in raws]
    )

    def z(raw: str) -> Column:
        sd, mean = F.col("_moments")[f"sd_{raw}"], F.col("_moments")[f"mean_{raw}"]
        score = F.when(sd < 1e-9, F.lit(0.0)).otherwise((F.col(raw) - mean) / sd)
        return F.coalesce(score, F.lit(0.0))

    scored = with_table_stats(filled, moments, "_moments")
    return scored.withColumns({d: z(f"{d}_raw") for d in DOMINANCE}).drop("_moments", *raws)


def merge_franchises(teams: DataFrame) -> DataFrame:
    """Spellings of one franchise merged with weights of innings count plus one."""
    weight = F.col("n_innings_bat_1") + F.col("n_innings_bat_2") + 1.0
    return (
        teams.withColumns({"franchise": canonical_franchise("team"), "_w": weight})
        .groupBy("franchise")
        .agg(
            *[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in (*RATIOS, *DOMINANCE)],
            F.sum("n_innings_bat_1").alias("n_innings_bat_1"),
            F.sum("n_innings_bat_2").alias("n_innings_bat_2"),
        )
    )


def franchise_profiles(deliveries: DataFrame) -> DataFrame:
    innings = league_innings(deliveries)
    # One row per team from here on; written once because medians and moments read it again.
    ratios = stage_table(team_ratios(team_innings_means(innings), league_baselines(innings)), "team_ratios")
    return merge_franchises(with_dominance(ratios))


def with_profiles(rows: DataFrame, profiles: DataFrame, team1: str = "team1_name", team2: str = "team2_name") -> DataFrame:
    """Sixteen profile columns of both sides, neutral values where a franchise is unknown.

    One profile row exists per franchise; the join is left to adaptive execution, which broadcasts the
    table as long as its measured size allows it.
    """
    for side, name in (("team1", team1), ("team2", team2)):
        table = profiles.select(
            F.trim("franchise").alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in NEUTRAL_PROFILE]
        )
        rows = rows.join(table, canonical_franchise(name) == F.col(f"_{side}"), "left").drop(f"_{side}")
        rows = rows.withColumns(
            {f"{side}_{c}": F.coalesce(F.col(f"{side}_{c}"), F.lit(v)) for c, v in NEUTRAL_PROFILE.items()}
        )
    return rows
