"""Scoring of whole fixture tables: elevens, predictions, calibrated totals, win probabilities, records.

Every table is keyed by (fixture_id, side, player_id).  ``by_fixture`` partitions the player rows once;
all later windows and groupings on fixture and side reuse that partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creaseline.functions.cricket import impact_score, potm_score
from creaseline.functions.pitch import MULTIPLIERS, style_wicket_multiplier
from creaseline.functions.text import clip, squeeze
from creaseline.operators.containment import best_loose_match, loose_name_pairs, venue_token_hits
from creaseline.operators.windows import top_per_key
from creaseline.plans.features import strength_by_role
from creaseline.plans.form import UNKNOWN_CONFIDENCE
from creaseline.session import stage_table

XI_SIZE, MAX_SQUAD = 11, 12

# Limits and anchors of innings totals.
ANCHOR_TOTAL, LOW_TOTAL, HIGH_TOTAL, MAX_RUN_SCALE = 165.0, 110.0, 255.0, 6.0
TEAM_MEAN_WEIGHT = 0.45
NOISE_SCALE, NOISE_GAMMA = 0.15, 0.45
ML_WEIGHT, SIM_WEIGHT = 0.6, 0.4
REPORT_LOW, REPORT_HIGH = 0.02, 0.98
SIM_PROXY_SCALE = 22.0
MATCHUP_LOW, MATCHUP_HIGH = 40.0, 220.0
PROFILE_TWEAK_LIMIT = 0.14

SIDE = ("fixture_id", "side")


def finite(c: Column) -> Column:
    """Null, NaN and infinities to zero."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(F.coalesce(d, F.lit(0.0)))


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.exp(-x) + 1.0)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def sim_proxy(runs1: Column, runs2: Column) -> Column:
    return expit((runs1 - runs2) / SIM_PROXY_SCALE)


# --- elevens -------------------------------------------------------------------------------------


def order_sides(fixtures: DataFrame) -> DataFrame:
    """Side 1 bats first: names and elevens swap when ``batting_first`` says team2."""
    swap = F.coalesce(F.col("batting_first") == "team2", F.lit(False))
    pairs = (("team1_name", "team2_name"), ("xi1", "xi2"))
    swapped = {}
    for a, b in pairs:
        swapped[a] = F.when(swap, F.col(b)).otherwise(F.col(a))
        swapped[b] = F.when(swap, F.col(a)).otherwise(F.col(b))
    return fixtures.withColumns({**swapped, "batting_order_swapped": swap})


def add_impact_players(fixtures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixtures with the impact player appended, rejects).

    A side with an impact player must hold exactly eleven names without that player.
    """
    bad = F.lit(False)
    out = {}
    for s in (1, 2):
        xi, impact = F.col(f"xi{s}"), F.trim(f"impact{s}")
        given = F.coalesce(impact != "", F.lit(False))
        bad = bad | (given & ((F.size(xi) != XI_SIZE) | F.array_contains(xi, impact)))
        out[f"xi{s}"] = F.when(given, F.array_append(xi, impact)).otherwise(xi)
    checked = fixtures.withColumn("_bad", bad)
    return checked.where(~F.col("_bad")).withColumns(out).drop("_bad"), checked.where("_bad").drop("_bad")


def eleven_problems(fixtures: DataFrame) -> DataFrame:
    """Rows of sides with a wrong number of names or a repeated name."""
    sides = F.inline(
        F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"xi{s}").alias("xi")) for s in (1, 2)])
    )
    rows = fixtures.select("fixture_id", sides)
    size, distinct = F.size("xi"), F.size(F.array_distinct("xi"))
    problem = (
        F.when(size > MAX_SQUAD, "too many players")
        .when(size < XI_SIZE, "too few players")
        .when(distinct != size, "duplicate player")
    )
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("fixture_id", "side", "problem")


def explode_elevens(fixtures: DataFrame) -> DataFrame:
    """One row per fixture, side and player, with own team, opponent and place in the list."""
    sides = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("side"), F.col(f"xi{s}").alias("xi"),
                    F.col(f"team{s}_name").alias("team"), F.col(f"team{3 - s}_name").alias("opponent"),
                )
                for s in (1, 2)
            ]
        )
    )
    rows = fixtures.select("fixture_id", "venue", sides)
    return rows.select(
        "fixture_id", "venue", "side", "team", "opponent", F.posexplode("xi").alias("_p", "player_id")
    ).select("fixture_id", "venue", "side", "team", "opponent", (F.col("_p") + 1).alias("xi_place"), F.trim("player_id").alias("player_id"))


def by_fixture(players: DataFrame) -> DataFrame:
    return players.repartition("fixture_id")


def missing_history(players: DataFrame, history: DataFrame) -> DataFrame:
    """Players of an eleven without any history row."""
    return players.join(history.select("player_id").distinct(), "player_id", "left_anti").select("fixture_id", "side", "player_id")


# --- player rows for fixtures --------------------------------------------------------------------


def latest_at_venue(players: DataFrame, history: DataFrame, columns: list[str]) -> DataFrame:
    """Newest history row of each player, preferring rows at a ground that matches the fixture's venue.

    History shrinks to the newest row per (player, venue) before any join, and then to the newest row per player and
    token of the asked venues, so no join meets a player's whole history or pairs asked venues with played ones.
    """
    packed = F.struct("date", "match_id", "venue", *columns)
    newest = history.groupBy("player_id", F.col("venue").alias("_hist_venue")).agg(F.max(packed).alias("_row"))
    newest = stage_table(newest, "newest_at_venue")
    overall = newest.groupBy("player_id").agg(F.max("_row").alias("_any"))
    tokens, hits = venue_token_hits(players.select("venue"), newest.select("_hist_venue"), "venue", "_hist_venue")
    by_token = newest.join(hits, "_hist_venue").groupBy("player_id", "_token").agg(F.max("_row").alias("_row"))
    at = (
        players.select("fixture_id", "side", "player_id", "venue").join(tokens, "venue").join(by_token, ["player_id", "_token"])
        .groupBy("fixture_id", "side", "player_id").agg(F.max("_row").alias("_at"))
    )
    joined = players.join(overall, "player_id").join(at, ["fixture_id", "side", "player_id"], "left")
    chosen = joined.withColumn("_row", F.coalesce("_at", "_any"))
    return chosen.select(
        *players.columns, F.col("_row.date").alias("row_date"), F.col("_row.match_id").alias("row_match_id"),
        F.col("_row.venue").alias("row_venue"), F.col("_at").isNotNull().alias("at_venue"),
        *[F.col(f"_row.{c}").alias(c) for c in columns],
    )


def with_latest_opponent_strength(players: DataFrame, past: DataFrame) -> DataFrame:
    """Opponent strength of a fixture from that team's latest past strength, names matched loosely."""
    order = F.struct("date", "match_id")
    latest = past.groupBy(squeeze("team").alias("_known")).agg(
        F.max_by("past_batting_strength", F.when(F.col("past_batting_strength").isNotNull(), order)).alias("_bat"),
        F.max_by("past_bowling_strength", F.when(F.col("past_bowling_strength").isNotNull(), order)).alias("_bowl"),
    )
    latest = stage_table(latest, "latest_strength")
    asked = players.select(squeeze("opponent").alias("_asked")).where(F.col("_asked") != "").distinct()
    matched = best_loose_match(asked, latest.select("_known"), "_asked", "_known").join(latest, "_known").drop("_known")
    joined = players.join(matched, squeeze("opponent") == F.col("_asked"), "left")
    bat = F.coalesce("_bat", "opponent_past_batting_strength")
    bowl = F.coalesce("_bowl", "opponent_past_bowling_strength")
    fresh = strength_by_role(F.coalesce("role", F.lit("allrounder")), bat, bowl)
    return joined.withColumns(
        {
            "opponent_strength": F.when(F.col("_asked").isNotNull(), fresh).otherwise(F.col("opponent_strength")),
            "opponent_past_batting_strength": bat,
            "opponent_past_bowling_strength": bowl,
        }
    ).drop("_asked", "_bat", "_bowl")


def head_to_head(history: DataFrame, opponents: DataFrame, depth: int = 12) -> DataFrame:
    """Mean batting and conceding rate per (player, asked opponent) over the last ``depth`` meetings.

    The last meetings are kept per (player, opponent spelling) first, then pooled over the spellings that
    match the asked name.
    """
    recent_order = [F.col("date").desc_nulls_first(), F.desc("match_id")]
    spelled = history.withColumn("_known", squeeze("opponent_team")).where(F.col("_known") != "")
    recent = top_per_key(spelled, ["player_id", "_known"], recent_order, depth)
    asked = opponents.select(squeeze("opponent").alias("_asked")).where(F.col("_asked") != "").distinct()
    pairs = loose_name_pairs(asked, spelled.select("_known").distinct(), "_asked", "_known").select("_asked", "_known")
    pooled = top_per_key(recent.join(pairs, "_known"), ["player_id", "_asked"], recent_order, depth)
    bat = F.when(F.col("balls") > 0, F.col("runs") / F.col("balls") * 100.0)
    bowl = F.when(F.col("balls_bowled") > 0, F.col("runs_conceded") / F.col("balls_bowled") * 100.0)

    def bounded(rate: Column, fallback: str) -> Column:
        return clip(F.coalesce(F.avg(rate), F.avg(fallback)), MATCHUP_LOW, MATCHUP_HIGH)

    return pooled.groupBy("player_id", "_asked").agg(
        bounded(bat, "batting_matchup_sr").alias("h2h_batting_sr"), bounded(bowl, "bowling_matchup_sr").alias("h2h_bowling_sr")
    )


def with_head_to_head(players: DataFrame, history: DataFrame) -> DataFrame:
    met = head_to_head(history, players)
    joined = players.withColumn("_asked", squeeze("opponent")).join(met, ["player_id", "_asked"], "left")
    return joined.withColumns(
        {
            "batting_matchup_sr": F.coalesce("h2h_batting_sr", "batting_matchup_sr"),
            "bowling_matchup_sr": F.coalesce("h2h_bowling_sr", "bowling_matchup_sr"),
        }
    ).drop("_asked", "h2h_batting_sr", "h2h_bowling_sr")


# --- expected runs and wickets -------------------------------------------------------------------


def shrink_to_team(players: DataFrame, team_mean_weight: float = TEAM_MEAN_WEIGHT) -> DataFrame:
    """Raw predictions pulled towards the side's mean where data confidence is low."""
    side = Window.partitionBy(*SIDE)
    trust = clip(F.coalesce("data_confidence", F.lit(UNKNOWN_CONFIDENCE)), 0.0, 1.0)

    def pulled(c: str) -> Column:
        value = F.coalesce(F.col(c), F.lit(0.0))
        return trust * value + (F.lit(1.0) - trust) * (F.avg(value).over(side) * team_mean_weight)

    return players.withColumns({c: pulled(c) for c in ("pred_runs_raw", "pred_wk_raw")})


def apply_playing_probability(players: DataFrame) -> DataFrame:
    prob = F.coalesce("playing_prob", F.lit(1.0))
    runs, wickets = F.col("pred_runs_raw") * prob, F.col("pred_wk_raw") * prob
    return players.withColumns(
        {
            "predicted_runs": runs,
            "predicted_wickets": wickets,
            "impact_base": impact_score(runs, wickets, F.col("role_encoded")),
        }
    )


def drop_lowest_of_twelve(players: DataFrame, enabled: bool = True) -> DataFrame:
    """Flag the lowest impact player of every side that fields twelve names."""
    side = Window.partitionBy(*SIDE)
    lowest = F.row_number().over(side.orderBy(F.round("impact_base", 9), "xi_place", "player_id"))
    dropped = (F.count(F.lit(1)).over(side) >= MAX_SQUAD) & (lowest == 1)
    return players.withColumn("dropped", dropped if enabled else F.lit(False))


def apply_pitch(players: DataFrame) -> DataFrame:
    """Innings multipliers: side 1 bats in the first innings, side 2 in the second."""
    first = F.col("side") == 1
    runs = F.when(first, F.col("first_innings_runs")).otherwise(F.col("second_innings_runs"))
    wickets = F.when(first, F.col("first_innings_wickets")).otherwise(F.col("second_innings_wickets"))
    out = {c: F.col(c) * runs for c in ("predicted_runs", "pred_runs_raw")}
    out |= {c: F.col(c) * wickets for c in ("predicted_wickets", "pred_wk_raw")}
    return _with_impact(players.withColumns(out))


def apply_venue_style(players: DataFrame) -> DataFrame:
    """Wickets scaled by bowling style and how hard the ground is on spin."""
    mult = style_wicket_multiplier(F.col("bowling_style"), F.col("venue_spin_harshness"))
    out = {c: F.col(c) * mult for c in ("predicted_wickets", "pred_wk_raw")}
    return _with_impact(players.withColumns({"venue_wk_mult": mult, **out}))


def _with_impact(players: DataFrame) -> DataFrame:
    return players.withColumn(
        "impact_base", impact_score(F.col("predicted_runs"), F.col("predicted_wickets"), F.col("role_encoded"))
    )


def expected_players(players: DataFrame, drop_lowest: bool = True) -> DataFrame:
    """Shrinkage, playing probability, the dropped twelfth, pitch and venue style; dropped rows are removed."""
    rows = drop_lowest_of_twelve(apply_playing_probability(shrink_to_team(players)), drop_lowest)
    return apply_venue_style(apply_pitch(rows.where(~F.col("dropped"))))


# --- innings totals ------------------------------------------------------------------------------


def _clip_total(c: Column) -> Column:
    return clip(c, LOW_TOTAL, HIGH_TOTAL)


def _scaled(pair: tuple[Column, Column], scale: Column, when: Column) -> tuple[Column, Column]:
    return tuple(F.when(when, _clip_total(t * scale)).otherwise(t) for t in pair)


def _blend_high_pitch(pair: tuple[Column, Column], mult: Column) -> tuple[Column, Column]:
    """On strong batting pitches both totals move towards 188 to 214."""
    mean, strong = (pair[0] + pair[1]) / 2.0, mult >= 1.35
    excess = mult - 1.14
    goal = F.when(strong, F.least(excess * 35.0, F.lit(18.0)) + 196.0).otherwise(F.least(excess * 35.0, F.lit(14.0)) + 188.0)
    blend = F.least(F.when(strong, F.lit(0.82)).otherwise(F.lit(0.72)), excess * 2.5 + 0.28)
    scale = blend * (goal / F.greatest(mean, F.lit(72.0)) - 1.0) + 1.0
    scale = F.greatest(F.least(scale, F.when(strong, F.lit(1.65)).otherwise(F.lit(1.55))), F.lit(1.0))
    active = (mult >= 1.14) & (mean < F.when(strong, F.lit(185.0)).otherwise(F.lit(178.0)))
    return _scaled(pair, scale, active)


def _lift_batting_venue(pair: tuple[Column, Column], harsh: Column) -> tuple[Column, Column]:
    """Low totals at small grounds move towards the ground's usual total."""
    mean = (pair[0] + pair[1]) / 2.0
    par = harsh * 28.0 + 158.0 + F.least(F.lit(14.0), F.greatest(F.lit(0.0), harsh - 0.35) * 20.0)
    low = (harsh >= 0.35) & (mean < 152.0)
    low_scale = clip(par / F.greatest(mean, F.lit(72.0)), 1.0, 1.55)
    mid_par = harsh * 48.0 + 160.0
    mid = (harsh >= 0.48) & (mean >= 152.0) & (mean < 205.0) & (mean < mid_par - 6.0)
    mid_scale = clip(mid_par / F.greatest(mean, F.lit(80.0)), 1.0, 1.30)
    return _scaled(pair, F.when(low, low_scale).otherwise(mid_scale), low | mid)


def _lift_collapsed(pair: tuple[Column, Column], mult: Column) -> tuple[Column, Column]:
    mean = (pair[0] + pair[1]) / 2.0
    par = clip(mult * ANCHOR_TOTAL, 145.0, 178.0)
    return _scaled(pair, clip(par / F.greatest(mean, F.lit(72.0)), 1.0, 1.62), mean < 132.0)


def innings_targets(fixtures: DataFrame) -> DataFrame:
    """Expected totals per fixture from model totals, or from raw player sums scaled to an anchor.

    Reads raw1, raw2, ml1, ml2 (null without a model), the four multipliers and venue_spin_harshness.
    The stages are separate projections, so each expression stays short.
    """
    has_ml = F.col("ml1").isNotNull() & F.col("ml2").isNotNull()
    mult = (F.col("first_innings_runs") + F.col("second_innings_runs")) / 2.0
    k = F.lit(ANCHOR_TOTAL) / F.greatest((F.col("raw1") + F.col("raw2")) / 2.0, F.lit(45.0))
    start = {
        "target1": _clip_total(F.when(has_ml, F.col("ml1") * F.col("first_innings_runs")).otherwise(k * F.col("raw1"))),
        "target2": _clip_total(F.when(has_ml, F.col("ml2") * F.col("second_innings_runs")).otherwise(k * F.col("raw2"))),
        "calibration_method": F.when(has_ml, "ml_team_total").otherwise("raw_sum_anchor"),
    }
    rows = fixtures.withColumns(start)
    pair = (F.col("target1"), F.col("target2"))

    def step(df: DataFrame, result: tuple[Column, Column]) -> DataFrame:
        return df.withColumns({"target1": result[0], "target2": result[1]})

    rows = step(rows, _blend_high_pitch(pair, mult))
    rows = step(rows, _lift_batting_venue(pair, F.col("venue_spin_harshness")))
    lifted = _lift_collapsed(pair, mult)
    return step(rows, tuple(F.when(has_ml, a).otherwise(b) for a, b in zip(lifted, pair)))


def profile_tweak(fixtures: DataFrame) -> DataFrame:
    """Totals moved by franchise profiles, at most 14 percent; needs the profile columns of both sides."""

    def adjust(bat: int, bowl: int, ratio: str, stingy: str) -> Column:
        a, b = f"team{bat}_", f"team{bowl}_"
        raw = (
            (F.col(a + ratio) - 1.0) * 0.20
            + (F.col(a + "pp_bat_ratio") - 1.0) * 0.10
            - (F.col(b + stingy) - 1.0) * 0.12
            + (F.col(a + "bat_dom") - F.col(b + "bowl_dom")) * 0.04 / 2.5
        )
        return clip(raw, -PROFILE_TWEAK_LIMIT, PROFILE_TWEAK_LIMIT) + 1.0

    return fixtures.withColumns(
        {
            "target1": F.col("target1") * adjust(1, 2, "bat_first_ratio", "bowl_first_stingy"),
            "target2": F.col("target2") * adjust(2, 1, "chase_ratio", "bowl_second_stingy"),
        }
    )


def dynamic_par(players: DataFrame) -> DataFrame:
    """Per side: mean strike rate of the six best batters by expected runs, as a bounded multiplier."""
    side = Window.partitionBy(*SIDE)
    bats = (F.coalesce(F.col("role_encoded"), F.lit(2)) != 1).cast("int")
    marked = players.withColumns({"_bats": bats, "_n": F.sum(bats).over(side)})
    pool = marked.where((F.col("_bats") == 1) | (F.col("_n") < 4))
    six = top_per_key(pool, list(SIDE), [F.round("predicted_runs", 9).desc(), "xi_place", "player_id"], 6)
    mean = F.avg(F.coalesce("strike_rate", F.lit(130.0)))
    return six.groupBy(*SIDE).agg(
        (F.least(F.greatest(mean - 130.0, F.lit(0.0)) * 0.003, F.lit(0.12)) + 1.0).alias("dynamic_mult")
    )


def side_totals(players: DataFrame) -> DataFrame:
    """Summed runs and wickets of both sides, one row per fixture."""

    def of(side: int, c: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col(c)))

    return players.groupBy("fixture_id").agg(
        of(1, "predicted_runs").alias("raw1"), of(2, "predicted_runs").alias("raw2"),
        of(1, "predicted_wickets").alias("wickets_by_1"), of(2, "predicted_wickets").alias("wickets_by_2"),
    )


def innings_wickets(totals: DataFrame) -> DataFrame:
    """Wickets of an innings are the fielding side's, at most ten; the raw sums are kept."""
    return totals.withColumns(
        {
            "pred_wickets_first_innings": F.least("wickets_by_2", F.lit(10.0)),
            "pred_wickets_second_innings": F.least("wickets_by_1", F.lit(10.0)),
        }
    )


def run_scales(fixtures: DataFrame) -> DataFrame:
    """Factor from raw player sums to the target; capped when no model total exists."""

    def scale(s: int) -> Column:
        raw = F.greatest(F.col(f"target{s}") / F.greatest(F.col(f"raw{s}"), F.lit(1e-9)), F.lit(0.0))
        return F.when(F.col("calibration_method") == "raw_sum_anchor", F.least(raw, F.lit(MAX_RUN_SCALE))).otherwise(raw)

    return fixtures.withColumns({"scale1": scale(1), "scale2": scale(2)})


def scale_players(players: DataFrame, scales: DataFrame) -> DataFrame:
    joined = players.join(scales.select("fixture_id", "scale1", "scale2"), "fixture_id")
    k = F.when(F.col("side") == 1, F.col("scale1")).otherwise(F.col("scale2"))
    return _with_impact(
        joined.withColumns({c: F.col(c) * k for c in ("predicted_runs", "pred_runs_raw")}).drop("scale1", "scale2")
    )


# --- leaderboards --------------------------------------------------------------------------------


def top_batters(players: DataFrame, n: int = 5) -> DataFrame:
    """Best batters of a fixture; pure bowlers only when fewer than ``n`` others exist."""
    return _role_aware(players, F.coalesce("role_encoded", F.lit(2)) != 1, "predicted_runs", n)


def top_bowlers(players: DataFrame, n: int = 3) -> DataFrame:
    """Best wicket takers of a fixture; bowlers and allrounders first when at least ``n`` exist."""
    return _role_aware(players, F.coalesce("role_encoded", F.lit(2)).isin(1, 2), "predicted_wickets", n)


def _role_aware(players: DataFrame, eligible: Column, by: str, n: int) -> DataFrame:
    # Rounded keys: the last bits of a sum depend on the order of its terms.
    fixture = Window.partitionBy("fixture_id")
    marked = players.withColumn("_ok", eligible).withColumn("_n", F.sum(F.col("_ok").cast("int")).over(fixture))
    pool = marked.where(F.col("_ok") | (F.col("_n") < n))
    order = [F.round(by, 9).desc(), F.asc("side"), F.asc("xi_place"), F.asc("player_id")]
    return top_per_key(pool, ["fixture_id"], order, n, rank="place").drop("_ok", "_n")


def player_of_match(players: DataFrame) -> DataFrame:
    score = potm_score(F.col("predicted_runs"), F.col("predicted_wickets"), F.col("role_encoded"))
    order = F.struct(F.round(score, 9).alias("s"), -F.col("side"), -F.col("xi_place"))
    return players.groupBy("fixture_id").agg(
        F.max_by("player_id", order).alias("potm"), F.max(score).alias("potm_score")
    )


# --- win probability -----------------------------------------------------------------------------


def roster_metrics(players: DataFrame) -> DataFrame:
    """Mean form, rates and strength of a side."""

    def mean(c: Column | str) -> Column:
        return F.avg(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)))

    base = players.groupBy(*SIDE).agg(
        mean("form_runs").alias("form_runs"), mean("form_wickets").alias("form_wickets"),
        F.avg("form_runs_ipl").alias("_fri"), F.count("form_runs_ipl").alias("_nri"),
        F.avg("form_wickets_ipl").alias("_fwi"), F.count("form_wickets_ipl").alias("_nwi"),
        F.count(F.lit(1)).alias("_n"), mean("strike_rate").alias("strike_rate"), mean("economy").alias("economy"),
    )

    def filled(avg: str, n: str, default: str) -> Column:
        known = F.coalesce(F.col(avg) * F.col(n), F.lit(0.0))
        return (known + F.col(default) * (F.col("_n") - F.col(n))) / F.col("_n")

    rows = base.withColumns(
        {"form_runs_ipl": filled("_fri", "_nri", "form_runs"), "form_wickets_ipl": filled("_fwi", "_nwi", "form_wickets")}
    )
    strength = F.col("form_runs_ipl") * 0.4 + F.col("strike_rate") * 0.3 + F.col("form_wickets_ipl") * 0.3
    return rows.withColumn("strength", strength).drop("_fri", "_nri", "_fwi", "_nwi", "_n")


def roster_rows(metrics: DataFrame) -> DataFrame:
    """Both sides' metrics on one row per fixture, named like match training rows."""
    names = ("strength", "form_runs", "form_runs_ipl", "strike_rate", "economy")
    return metrics.groupBy("fixture_id").agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"team{s}_{c}") for c in names for s in (1, 2)]
    )


def _uniform(digest: Column, part: int) -> Column:
    """Uniform in (0, 1) from eight hex digits of a digest."""
    return (F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def _normal(digest: Column, pair: int) -> Column:
    u, v = _uniform(digest, 2 * pair), _uniform(digest, 2 * pair + 1)
    return F.sqrt(F.ln(u) * -2.0) * F.cos(v * (2.0 * math.pi))


def monte_carlo(players: DataFrame, scales: DataFrame, replicates: int = 100, seed: int = 42, drop_lowest: bool = True) -> DataFrame:
    """Share of replicates in which side 1 scores strictly more.

    Players are scored once; only noise differs between replicates.  Noise comes from a digest of seed,
    fixture, side, player and replicate, so it does not depend on partitioning or retries.  A shared run
    shock would multiply both totals of a replicate alike and cannot change its winner, so none is drawn.
    Reads shrunk raw predictions, playing probability, spread and the run multipliers.
    """
    side = Window.partitionBy(*SIDE)

    def spread(c: str) -> Column:
        median = F.median(c).over(side)
        sd = F.greatest(F.coalesce(F.col(c), median), F.lit(0.0))
        return F.tanh(sd / F.greatest(median, F.lit(1e-6))) * NOISE_GAMMA + 1.0

    means = players.withColumns(
        {
            "_r": F.greatest("pred_runs_raw", F.lit(0.0)), "_w": F.greatest("pred_wk_raw", F.lit(0.0)),
            "_mr": spread("std_runs"), "_mw": spread("std_wickets"),
            "_prob": F.coalesce("playing_prob", F.lit(1.0)),
        }
    ).join(scales.select("fixture_id", "scale1", "scale2"), "fixture_id")
    first = F.col("side") == 1
    factor = F.when(first, F.col("first_innings_runs") * F.col("scale1")).otherwise(
        F.col("second_innings_runs") * F.col("scale2")
    )
    slim = means.select(
        "fixture_id", "side", "player_id", "role_encoded", "_r", "_w", "_prob", factor.alias("_factor"),
        (F.greatest("_r", F.lit(1e-9)) * F.col("_mr") * NOISE_SCALE).alias("_sr"),
        (F.greatest("_w", F.lit(1e-9)) * F.col("_mw") * NOISE_SCALE).alias("_sw"),
    )
    drawn = slim.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn(
        "_d", F.md5(F.concat_ws("|", F.lit(seed), "fixture_id", "side", "player_id", "replicate").cast("binary"))
    )
    runs = F.greatest(F.col("_r") + F.col("_sr") * _normal(F.col("_d"), 0), F.lit(0.0)) * F.col("_prob")
    wickets = F.greatest(F.col("_w") + F.col("_sw") * _normal(F.col("_d"), 1), F.lit(0.0)) * F.col("_prob")
    noisy = drawn.select("fixture_id", "replicate", "side", "_factor", "role_encoded", runs.alias("runs"), wickets.alias("wickets"))
    noisy = noisy.withColumn("impact", impact_score(F.col("runs"), F.col("wickets"), F.col("role_encoded")))

    def kept(s: int) -> Column:
        mine = F.col("side") == s
        value = F.when(mine, F.col("runs") * F.col("_factor"))
        total = F.sum(value)
        if not drop_lowest:
            return total
        n = F.count(value)
        return total - F.when(n >= MAX_SQUAD, F.min_by(value, F.when(mine, F.col("impact")))).otherwise(F.lit(0.0))

    totals = noisy.groupBy("fixture_id", "replicate").agg(kept(1).alias("t1"), kept(2).alias("t2"))
    return totals.groupBy("fixture_id").agg(
        F.avg((F.col("t1") > F.col("t2")).cast("double")).alias("sim_p_team1"), F.count(F.lit(1)).alias("replicates")
    )


def clip_report(p: Column) -> Column:
    return clip(p, REPORT_LOW, REPORT_HIGH)


def blend_probability(ml: Column, sim: Column, w_ml: float = ML_WEIGHT, w_sim: float = SIM_WEIGHT, stack: dict | None = None) -> Column:
    """Raw ensemble probability: learned logit stack if given, else the weighted blend; either input may be null."""
    total = w_ml + w_sim
    a, b = (w_ml / total, w_sim / total) if total > 0 else (w_ml, w_sim)
    both = ml * a + sim * b
    if stack:
        c = stack["coef"]
        both = expit(logit(ml) * c[0] + logit(sim) * c[1] + stack.get("intercept", 0.0))
    return clip(F.coalesce(both, ml, sim), 1e-6, 1.0 - 1e-6)


def ensemble_probability(ml: Column, sim: Column, **weights) -> Column:
    return clip_report(blend_probability(ml, sim, **weights))


def predicted_winner(p: Column, basis_total1: Column, basis_total2: Column, team1: Column, team2: Column) -> Column:
    by_p = F.when(p > 0.5, team1).when(p < 0.5, team2).otherwise("tie")
    by_total = F.when(basis_total1 > basis_total2, team1).when(basis_total2 > basis_total1, team2).otherwise("tie")
    return F.when(p.isNotNull(), by_p).otherwise(by_total)


def six_outcomes(fixtures: DataFrame, batters: DataFrame, bowlers: DataFrame, potm: DataFrame) -> DataFrame:
    """Winner, best bat, best bowl, top five, top three and player of the match per fixture.

    The winner follows the ensemble, else Monte Carlo, else the totals; the basis is reported.  The
    leaderboards hold at most five and three rows per fixture.
    """

    def listed(rows: DataFrame, out: str) -> DataFrame:
        packed = F.sort_array(F.collect_list(F.struct("place", "player_id")))
        return rows.groupBy("fixture_id").agg(F.transform(packed, lambda x: x["player_id"]).alias(out))

    p = F.coalesce("ensemble_p_team1", "sim_p_team1")
    basis = (
        F.when(F.col("ensemble_p_team1").isNotNull(), "hybrid_ensemble")
        .when(F.col("sim_p_team1").isNotNull(), "monte_carlo")
        .otherwise("deterministic_totals")
    )
    winner = predicted_winner(p, F.col("total1"), F.col("total2"), F.col("team1_name"), F.col("team2_name"))
    joined = (
        fixtures.join(listed(batters, "top5"), "fixture_id", "left")
        .join(listed(bowlers, "top3"), "fixture_id", "left")
        .join(potm.select("fixture_id", "potm"), "fixture_id", "left")
    )
    p_winner = F.when(winner == F.col("team1_name"), p).when(winner == F.col("team2_name"), F.lit(1.0) - p)
    return joined.withColumns(
        {
            "winning_team": winner, "p_team1_win": p, "p_team2_win": F.lit(1.0) - p, "p_predicted_winner": p_winner,
            "win_probability_basis": basis, "best_bat": F.get("top5", F.lit(0)), "best_bowl": F.get("top3", F.lit(0)),
        }
    )


def probability_breakdown(fixtures: DataFrame) -> DataFrame:
    """Model, simulation and headline probability side by side, flagged when they differ by ten points."""
    gap = F.abs(F.col("sim_p_team1") - F.col("ml_p_team1"))
    return fixtures.select(
        "fixture_id", "team1_name", "sim_p_team1", "ml_p_team1", F.col("p_team1_win").alias("headline_p"),
        "win_probability_basis", F.coalesce(gap >= 0.10, F.lit(False)).alias("sources_differ"),
    )


def prediction_records(outcomes: DataFrame, used_impact: bool = False, trimmed: bool = True) -> DataFrame:
    """Log records: flat columns, leaderboards padded to five and three names, extras as one JSON cell."""

    def padded(c: str, n: int) -> Column:
        names = F.coalesce(F.col(c), F.array().cast("array<string>"))
        return F.slice(F.concat(names, F.array_repeat(F.lit(""), n)), 1, n)

    extra = F.struct(
        F.col("win_probability_basis"), F.col("ensemble_p_team1"), F.col("sim_p_team1").alias("sim_win_probability_team1"),
        F.col("ml_p_team1").alias("leader_model_p_team1"), F.col("batting_order_swapped"),
        F.struct(*MULTIPLIERS).alias("pitch_multipliers"), F.col("venue_spin_harshness"),
        F.lit("1B" if used_impact and not trimmed else "1A").alias("process_variant"),
        F.lit(used_impact and not trimmed).alias("full_playing_twelve"),
        F.col("total1").alias("pred_first_innings_team_runs"), F.col("total2").alias("pred_second_innings_team_runs"),
        F.col("pred_wickets_first_innings").alias("pred_first_innings_team_wickets"),
        F.col("pred_wickets_second_innings").alias("pred_second_innings_team_wickets"),
        F.struct(
            F.col("calibration_method").alias("method"), F.col("scale1").alias("scale_team1"), F.col("scale2").alias("scale_team2"),
            F.col("raw1").alias("sum_player_runs_before_team1"), F.col("raw2").alias("sum_player_runs_before_team2"),
        ).alias("team_run_calibration"),
    )
    return outcomes.select(
        "match_key", "match_date", "venue", "team1_name", "team2_name", F.lit(True).alias("team1_bats_first"),
        F.coalesce("winning_team", F.lit("")).alias("pred_winner"),
        F.coalesce("p_team1_win", F.lit(0.5)).alias("pred_p_team1_win"),
        F.coalesce("best_bat", F.lit("")).alias("pred_best_bat"), F.coalesce("best_bowl", F.lit("")).alias("pred_best_bowl"),
        padded("top5", 5).alias("pred_top5_bats"), padded("top3", 3).alias("pred_top3_bowls"),
        F.coalesce("potm", F.lit("")).alias("pred_potm"), F.to_json(extra).alias("pred_extra_json"),
    )


def score_fixtures(fixtures: DataFrame, players: DataFrame, replicates: int = 100, drop_lowest: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row per fixture with all outcomes, expected player rows).

    ``fixtures`` carries team names, multipliers, harshness, model totals (ml1, ml2), the model
    probability ``ml_p_team1`` and the profile columns; ``players`` the raw predictions per player.
    """
    ready = by_fixture(players)
    # Totals, par, leaderboards and scaled players all read the expected rows; the simulation and the
    # outcomes read the calibrated fixtures.  Both are written once.
    expected = stage_table(expected_players(ready, drop_lowest), "expected_players")
    totals = innings_wickets(side_totals(expected))
    par = dynamic_par(expected).groupBy("fixture_id").agg(
        *[F.max(F.when(F.col("side") == s, F.col("dynamic_mult"))).alias(f"dynamic{s}") for s in (1, 2)]
    )
    rows = profile_tweak(innings_targets(fixtures.join(totals, "fixture_id").join(par, "fixture_id")))
    rows = run_scales(
        rows.withColumns({f"target{s}": _clip_total(F.col(f"target{s}") * F.coalesce(f"dynamic{s}", F.lit(1.0))) for s in (1, 2)})
    )
    rows = rows.withColumns({f"total{s}": F.col(f"raw{s}") * F.col(f"scale{s}") for s in (1, 2)})
    rows = stage_table(rows, "calibrated_fixtures")
    chance = monte_carlo(shrink_to_team(ready), rows, replicates, drop_lowest=drop_lowest)
    rows = rows.join(chance, "fixture_id", "left").withColumn(
        "ensemble_p_team1", ensemble_probability(F.col("ml_p_team1"), F.col("sim_p_team1"))
    )
    scaled = scale_players(expected, rows)
    return six_outcomes(rows, top_batters(scaled), top_bowlers(scaled), player_of_match(scaled)), scaled
