"""Player features that use only what was known before each match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creaseline.functions.franchise import play_style_scores, role_code
from creaseline.functions.text import clip, lookup_key
from creaseline.operators.quantiles import exact_medians
from creaseline.operators.windows import (
    Borders,
    add_conditional_rolling,
    chunk_borders,
    chunk_window,
    drop_prior_rows,
    keep_one,
    prior_cumulative,
    prior_rolling,
    with_prior_rows,
    with_table_stats,
)
from creaseline.plans.stats import pair_match_table
from creaseline.schemas import PLAYER_FEATURES

TIMELINE = ("date", "match_id")
PAIR = ("batter", "bowler")
FORM_DEPTH = 5
NO_GAP_DAYS, MAX_GAP_DAYS = 180.0, 730.0
MOMENTUM_WEIGHTS = (0.5, 0.3, 0.2)

GLOBALS = {
    "pglobal_avg_runs": "runs",
    "pglobal_avg_wk": "wickets",
    "pglobal_sr": "match_sr",
    "pglobal_econ": "match_econ",
}
VENUE_PRIORS = ("venue_avg_runs_all", "venue_avg_wickets_all", "venue_strike_rate_all", "venue_economy_all")


def own_team(batting_team: Column, bowling_team: Column) -> Column:
    bt = F.trim(F.coalesce(batting_team, F.lit("")))
    return F.when((bt == "") | (F.lower(bt) == "unknown"), F.trim(F.coalesce(bowling_team, F.lit("")))).otherwise(bt)


def opponent_of(team: Column, batting_team: Column, bowling_team: Column) -> Column:
    other = F.when(team == batting_team, bowling_team).when(team == bowling_team, batting_team)
    return F.when(F.trim(other) != "", F.trim(other))


def match_rates() -> dict[str, Column]:
    return {
        "match_sr": F.when(F.col("balls") > 0, F.col("runs") / F.col("balls") * 100.0),
        "match_econ": F.when(F.col("balls_bowled") > 0, F.col("runs_conceded") / (F.col("balls_bowled") / 6.0)),
    }


def with_team_and_rates(stats: DataFrame) -> DataFrame:
    return stats.withColumns(
        {**match_rates(), "team": own_team(F.col("batting_team"), F.col("bowling_team"))}
    )


def with_franchise_flag(stats: DataFrame, franchises: DataFrame) -> DataFrame:
    """Flag matches where either side is a franchise; with an empty franchise table no row is flagged.

    The side pair of a match repeats for every player, so the test runs on distinct team names.
    """
    names = franchises.select(F.trim("team").alias("_f")).where(F.col("_f") != "").distinct()
    bat = names.select(F.col("_f").alias("_fb"))
    bowl = names.select(F.col("_f").alias("_fw"))
    return (
        stats.join(bat, F.trim("batting_team") == F.col("_fb"), "left")
        .join(bowl, F.trim("bowling_team") == F.col("_fw"), "left")
        .withColumn("is_franchise_match", F.col("_fb").isNotNull() | F.col("_fw").isNotNull())
        .drop("_fb", "_fw")
    )


def rolling_features(stats: DataFrame, with_franchise_form: bool = True) -> DataFrame:
    """Form, franchise form and rest days in one chunked timeline per player.

    All frames share one exchange and one sort on (player, month).
    """
    keys, order = ["player_id"], list(TIMELINE)
    flag = "is_franchise_match" if with_franchise_form else None
    rows = with_prior_rows(stats, keys, order, ["runs", "wickets", "match_sr", "match_econ"], FORM_DEPTH, flag)
    if with_franchise_form:
        rows = add_conditional_rolling(
            rows, keys, order, flag, {"form_runs_ipl": "runs", "form_wickets_ipl": "wickets"}, FORM_DEPTH
        )
    line = chunk_window(keys, order)
    prior5 = line.rowsBetween(-FORM_DEPTH, -1)
    zero = F.lit(0.0)

    gap = F.datediff(F.col("date"), F.lag("date", 1).over(line)).cast("double")
    out = {
        "form_runs": F.coalesce(F.avg("runs").over(prior5), zero),
        "form_wickets": F.coalesce(F.avg("wickets").over(prior5), zero),
        "strike_rate": F.coalesce(F.avg("match_sr").over(prior5), zero),
        "economy": F.coalesce(F.avg("match_econ").over(prior5), zero),
        "days_since_prev_match": clip(F.coalesce(gap, F.lit(NO_GAP_DAYS)), 0.0, MAX_GAP_DAYS),
    }
    rows = drop_prior_rows(rows.withColumns(out))
    if with_franchise_form:
        return rows.withColumns(
            {c: F.coalesce(F.col(c), zero) for c in ("form_runs_ipl", "form_wickets_ipl")}
        )
    return rows.withColumns({"form_runs_ipl": F.col("form_runs"), "form_wickets_ipl": F.col("form_wickets")})


def venue_history(stats: DataFrame, totals_from: DataFrame | None = None) -> DataFrame:
    """Totals, match count and rates of the player's earlier matches at the same venue."""
    sums = {
        "venue_runs_sum": F.col("runs"),
        "venue_balls_sum": F.col("balls"),
        "venue_wickets_sum": F.col("wickets"),
        "venue_balls_bowled_sum": F.col("balls_bowled"),
        "venue_runs_conceded_sum": F.col("runs_conceded"),
        "matches_at_venue": F.lit(1),
    }
    rows = prior_cumulative(stats, ["player_id", "venue"], list(TIMELINE), sums, totals_from=totals_from)
    n = F.col("matches_at_venue")
    return rows.withColumns(
        {
            "matches_at_venue": n.cast("long"),
            "real_venue": n > 0,
            "venue_avg_runs": F.when(n > 0, F.col("venue_runs_sum") / n),
            "venue_strike_rate": F.when(
                F.col("venue_balls_sum") > 0, F.col("venue_runs_sum") / F.col("venue_balls_sum") * 100.0
            ),
            "venue_avg_wickets": F.when(n > 0, F.col("venue_wickets_sum") / n),
            "venue_economy": F.when(
                F.col("venue_balls_bowled_sum") > 0,
                F.col("venue_runs_conceded_sum") / (F.col("venue_balls_bowled_sum") / 6.0),
            ),
        }
    )


def venue_matches(stats: DataFrame) -> DataFrame:
    """Per (match, venue, date): sums, player count and rates."""
    m = stats.groupBy("match_id", "venue", "date").agg(
        F.sum("runs").alias("sum_runs"),
        F.sum("balls").alias("sum_balls"),
        F.sum("wickets").alias("sum_wk"),
        F.sum("balls_bowled").alias("sum_bb"),
        F.sum("runs_conceded").alias("sum_rc"),
        F.count("player_id").alias("npl"),
    )
    return m.withColumns(
        {
            "match_sr": F.when(F.col("sum_balls") > 0, F.col("sum_runs") / F.col("sum_balls") * 100.0),
            "match_econ": F.when(F.col("sum_bb") > 0, F.col("sum_rc") / (F.col("sum_bb") / 6.0)),
            "avg_runs_per_player": F.try_divide("sum_runs", "npl"),
            "avg_wk_per_player": F.try_divide("sum_wk", "npl"),
        }
    )


def venue_rates(matches: DataFrame) -> DataFrame:
    """`venue_matches` rows with the mean of per-match rates over earlier matches at the venue."""
    inputs = dict(zip(VENUE_PRIORS, ("avg_runs_per_player", "avg_wk_per_player", "match_sr", "match_econ")))
    sums = {f"s_{o}": F.col(c) for o, c in inputs.items()}
    sums |= {f"n_{o}": F.col(c).isNotNull().cast("int") for o, c in inputs.items()}
    rows = prior_cumulative(matches, ["venue"], list(TIMELINE), sums)
    return rows.withColumns({o: F.try_divide(f"s_{o}", f"n_{o}") for o in VENUE_PRIORS}).drop(*sums)


def one_venue_per_match(rates: DataFrame) -> DataFrame:
    """The first venue row of each match."""
    kept = keep_one(rates.select("match_id", "venue", "date", *VENUE_PRIORS), ["match_id"], [F.col("venue"), F.col("date").asc_nulls_last()])
    return kept.select("match_id", *VENUE_PRIORS)


def venue_league_priors(stats: DataFrame) -> DataFrame:
    """Mean of per-match rates over earlier matches at the venue, one row per match."""
    return one_venue_per_match(venue_rates(venue_matches(stats).where(F.col("venue").isNotNull())))


def player_globals(stats: DataFrame) -> DataFrame:
    """Mean runs, wickets, strike rate and economy per player over the whole history."""
    return stats.groupBy("player_id").agg(*[F.avg(c).alias(n) for n, c in GLOBALS.items()])


def pair_priors(deliveries: DataFrame, match_dates: DataFrame) -> DataFrame:
    """Totals of earlier meetings per (batter, bowler), never reaching into another pair's history.

    Borders come from the balls, which are at least as many as the rows, so that taking them exchanges no pair table.
    """
    pairs = pair_match_table(deliveries).join(match_dates, "match_id", "left")
    places = deliveries.select(
        *[F.trim(c).alias(c) for c in PAIR], *[F.col(c).cast(pairs.schema[c].dataType).alias(c) for c in TIMELINE]
    )
    return pair_history(pairs, chunk_borders(places, PAIR, TIMELINE))


def pair_history(pairs: DataFrame, borders: Borders | None = None) -> DataFrame:
    """Dated (match, batter, bowler) rows with the totals of the pair's earlier rows."""
    rows = prior_cumulative(
        pairs,
        list(PAIR),
        list(TIMELINE),
        {
            "prev_runs": F.col("pruns"),
            "prev_balls": F.col("pballs"),
            "prev_dismissals": F.col("pdism"),
        },
        borders,
    )
    return rows.withColumn(
        "prior_sr", F.when(F.col("prev_balls") > 0, F.col("prev_runs") / F.col("prev_balls") * 100.0)
    )


def matchup_rates(priors: DataFrame) -> DataFrame:
    """Ball-weighted prior strike rate per (match, player), as batter and as bowler.

    A pair row counts for both of its players, so one grouping and one join serve both ends.
    """
    usable = priors.where((F.col("pballs") > 0) & F.col("prior_sr").isNotNull())
    ends = usable.select(
        "match_id",
        "pballs",
        "prior_sr",
        F.inline(
            F.array(
                F.struct(F.col("batter").alias("player_id"), F.lit(True).alias("bats")),
                F.struct(F.col("bowler").alias("player_id"), F.lit(False).alias("bats")),
            )
        ),
    )

    def rate(keep: Column) -> Column:
        balls = F.when(keep, F.col("pballs"))
        return F.try_divide(F.sum(balls * F.col("prior_sr")), F.sum(balls))

    return ends.groupBy("match_id", "player_id").agg(
        rate(F.col("bats")).alias("batting_matchup_sr"), rate(~F.col("bats")).alias("bowling_matchup_sr")
    )


def with_matchups(stats: DataFrame, priors: DataFrame, fallback: str = "pglobal_sr") -> DataFrame:
    return stats.join(matchup_rates(priors), ["match_id", "player_id"], "left").withColumns(matchup_fallback(fallback))


def matchup_fallback(fallback: str = "pglobal_sr") -> dict[str, Column]:
    """Without earlier meetings: the player's mean."""
    return {
        "real_batting_matchup": F.col("batting_matchup_sr").isNotNull(),
        "real_bowling_matchup": F.col("bowling_matchup_sr").isNotNull(),
        "batting_matchup_sr": F.coalesce("batting_matchup_sr", fallback),
        "bowling_matchup_sr": F.coalesce("bowling_matchup_sr", fallback),
    }


def venue_fallback() -> dict[str, Column]:
    """Without own history at the venue: 0.7 player mean and 0.3 venue prior; then the player mean."""
    no_history = ~F.col("real_venue")

    def blend(own: str, prior: str, player: str) -> Column:
        mixed = F.col(player) * 0.7 + F.coalesce(prior, player) * 0.3
        return F.coalesce(F.when(no_history, mixed).otherwise(F.col(own)), F.col(player))

    return {
        "venue_avg_runs": blend("venue_avg_runs", "venue_avg_runs_all", "pglobal_avg_runs"),
        "venue_avg_wickets": blend("venue_avg_wickets", "venue_avg_wickets_all", "pglobal_avg_wk"),
        "venue_strike_rate": blend("venue_strike_rate", "venue_strike_rate_all", "pglobal_sr"),
        "venue_economy": blend("venue_economy", "venue_economy_all", "pglobal_econ"),
        "uses_venue_fallback": no_history,
    }


def team_match_strength(stats: DataFrame, top_n: int = 5) -> DataFrame:
    """Per (match, team): sum of the best ``top_n`` runs and wickets, and the full sums."""
    by_team = Window.partitionBy("match_id", "team")
    ranked = stats.select("match_id", "team", "date", "player_id", "runs", "wickets").withColumns(
        {
            "_r": F.row_number().over(by_team.orderBy(F.desc("runs"), "player_id")),
            "_w": F.row_number().over(by_team.orderBy(F.desc("wickets"), "player_id")),
        }
    )
    return ranked.groupBy("match_id", "team").agg(
        F.sum(F.when(F.col("_r") <= top_n, F.col("runs"))).alias("top5_runs"),
        F.sum(F.when(F.col("_w") <= top_n, F.col("wickets"))).cast("double").alias("top5_wickets"),
        F.sum("runs").alias("sum_runs_all"),
        F.sum("wickets").cast("double").alias("sum_wickets_all"),
        F.min("date").alias("date"),
    )


def team_past_strength(strength: DataFrame) -> DataFrame:
    """Mean of the previous five top-five sums of each team."""
    return prior_rolling(
        strength,
        ["team"],
        list(TIMELINE),
        {
            "past_batting_strength": ("avg", "top5_runs"),
            "past_bowling_strength": ("avg", "top5_wickets"),
        },
    )


_STRENGTHS = ("opponent_past_batting_strength", "opponent_past_bowling_strength", "opponent_strength")


def _join_opponent(rows: DataFrame, past: DataFrame) -> DataFrame:
    # The few teams of a match come as one list, so that rows dealt by match need no exchange by match and team.
    sides = past.groupBy("match_id").agg(
        F.collect_list(F.struct("team", "past_batting_strength", "past_bowling_strength")).alias("_sides")
    )
    joined = rows.withColumn(
        "opponent_team", opponent_of(F.col("team"), F.col("batting_team"), F.col("bowling_team"))
    ).join(sides, "match_id", "left")
    met = F.get(F.filter("_sides", lambda s: s["team"] == F.col("opponent_team")), F.lit(0))
    joined = joined.withColumns({_STRENGTHS[0]: met["past_batting_strength"], _STRENGTHS[1]: met["past_bowling_strength"]}).drop("_sides")
    bat, bowl = F.col(_STRENGTHS[0]), F.col(_STRENGTHS[1])
    return joined.withColumn("opponent_strength", strength_by_role(F.col("role"), bat, bowl))


def strength_by_role(role: Column, bat: Column, bowl: Column) -> Column:
    """A batter meets the opponent's bowling, a bowler its batting, an allrounder both."""
    key = lookup_key(role)
    return F.when(key == "batter", bowl).when(key == "bowler", bat).when(key == "allrounder", (bat + bowl) / 2.0)


def with_opponent_strength(rows: DataFrame, past: DataFrame, means_from: DataFrame | None = None) -> DataFrame:
    """Past strength of the opponent, read by role; gaps take the mean over the table.

    ``means_from`` is a cheaper table with the same players and matches for that mean.
    """
    source = rows if means_from is None else means_from
    slim = source.select("match_id", "team", "batting_team", "bowling_team", "role")
    means = _join_opponent(slim, past).agg(*[F.avg(c).alias(c) for c in _STRENGTHS])
    joined = with_table_stats(_join_opponent(rows, past), means, "_means")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col("_means")[c]) for c in _STRENGTHS}).drop("_means")


def match_dates(stats: DataFrame) -> DataFrame:
    return stats.groupBy("match_id").agg(F.min("date").alias("date"))


def player_features(stats: DataFrame, deliveries: DataFrame, franchises: DataFrame) -> DataFrame:
    """The full feature table, one row per (player, match).

    ``stats`` is read by several branches; pass the written player-match table.
    """
    base = with_franchise_flag(with_team_and_rates(stats), franchises)
    lines = venue_history(rolling_features(base), totals_from=base)
    past = team_past_strength(team_match_strength(base))
    return assembled_features(lines, venue_league_priors(base), pair_priors(deliveries, match_dates(stats)), past, means_from=base)


def assembled_features(lines: DataFrame, venue_priors: DataFrame, pairs: DataFrame, past: DataFrame, means_from: DataFrame) -> DataFrame:
    """Feature table from its histories: player lines, venue priors per match, pair priors and past team strength.

    ``means_from`` has the same players and matches as ``lines`` and gives the means over players and over the table.
    """
    # Means over players come last, so that they need not cross the exchanges by match with every row.
    rows = lines.join(matchup_rates(pairs), ["match_id", "player_id"], "left").join(venue_priors, "match_id", "left")
    rows = with_opponent_strength(rows, past, means_from=means_from).join(player_globals(means_from), "player_id", "left")
    rows = rows.withColumns({**matchup_fallback(), **venue_fallback()})
    rows = rows.withColumns(play_style_scores())
    return rows.withColumn("is_franchise_match", F.col("is_franchise_match").cast("int")).select(*PLAYER_FEATURES)


def reduced_features(stats: DataFrame) -> DataFrame:
    """Fallback when no full feature table exists: form and rates only."""
    rows = rolling_features(with_team_and_rates(stats), with_franchise_form=False)
    return rows.select(
        "match_id", "player_id", "team", "runs", "wickets", "form_runs", "form_wickets", "strike_rate",
        "economy", "form_runs_ipl", "form_wickets_ipl", F.lit(0.0).alias("days_since_prev_match"),
    )


IMPUTED_BY_PLAYER = (
    "venue_avg_runs", "venue_avg_wickets", "venue_strike_rate", "venue_economy", "venue_avg_runs_all",
    "venue_avg_wickets_all", "venue_strike_rate_all", "venue_economy_all", "batting_matchup_sr",
    "bowling_matchup_sr", "opponent_strength", "momentum_runs", "momentum_wickets", "form_runs_ipl",
    "form_wickets_ipl", "days_since_prev_match", "style_bat_aggressive", "style_bat_anchor",
    "style_bowl_economical", "style_bowl_expensive_wicket_taker", "form_runs", "form_wickets",
    "strike_rate", "economy",
)


def impute_by_player(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Null to the player's mean, then to the table mean.

    Means are aggregated and joined back, so a player with very many rows is combined map-side and the
    join can be split by adaptive execution; a window over the player could not.
    """
    means = rows.groupBy("player_id").agg(*[F.avg(c).alias(f"_p_{c}") for c in columns])
    joined = with_table_stats(rows.join(means, "player_id", "left"), rows.agg(*[F.avg(c).alias(c) for c in columns]), "_table")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_p_{c}"), F.col("_table")[c]) for c in columns}
    ).drop("_table", *[f"_p_{c}" for c in columns])


def spread_and_momentum(rows: DataFrame) -> DataFrame:
    """Weighted mean of the last three matches (null unless all exist) and prior-five sample spread."""
    keys, order = ["player_id"], list(TIMELINE)
    line = chunk_window(keys, order)
    prior5 = line.rowsBetween(-FORM_DEPTH, -1)
    first, second, third = MOMENTUM_WEIGHTS
    out = {}
    for name in ("runs", "wickets"):
        lags = [F.lag(name, i).over(line) for i in (1, 2, 3)]
        out[f"momentum_{name}"] = lags[0] * first + lags[1] * second + lags[2] * third
        out[f"std_{name}"] = F.coalesce(F.stddev_samp(name).over(prior5), F.lit(0.0))
    with_prior = with_prior_rows(rows, keys, order, ["runs", "wickets"], FORM_DEPTH)
    return drop_prior_rows(with_prior.withColumns(out))


def player_training_rows(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Features with date and role, momentum, spread and imputed gaps; rows without targets dropped."""
    meta = stats.select("match_id", "player_id", "date", "role")
    rows = features.join(meta, ["match_id", "player_id"], "left").withColumn(
        "role", F.coalesce(lookup_key("role"), F.lit("allrounder"))
    )
    rows = spread_and_momentum(rows.withColumn("role_encoded", role_code(F.col("role"))))
    prepared = impute_by_player(rows, IMPUTED_BY_PLAYER)
    return prepared.where(F.col("runs").isNotNull() & F.col("wickets").isNotNull())


def median_prior_rows(features: DataFrame, player_ids: DataFrame, prior_match_id: int = -999) -> DataFrame:
    """One row of column medians for every listed player that has no feature row yet."""
    numeric = [
        n for n, t in features.dtypes if t in ("double", "int", "bigint", "float") and n != "match_id"
    ]
    medians = exact_medians(features, numeric)
    packed = medians.agg(F.map_from_entries(F.collect_list(F.struct("name", "median"))).alias("m"))
    missing = (
        player_ids.select(F.trim("player_id").alias("player_id"))
        .where(F.col("player_id") != "")
        .distinct()
        .join(features.select(F.trim("player_id").alias("player_id")), "player_id", "left_anti")
    )
    missing = with_table_stats(missing, packed, "_medians")
    values = {n: F.col("_medians.m")[n] for n in numeric}
    texts = {n: F.lit("unknown") for n, t in features.dtypes if t == "string" and n != "player_id"}
    rows = missing.withColumns({**values, **texts, "match_id": F.lit(prior_match_id).cast("long")})
    return rows.select(*[F.col(n).cast(t) if n in numeric else F.col(n) for n, t in features.dtypes])


def prior_stat_rows(priors: DataFrame, prior_date: str = "2026-01-01") -> DataFrame:
    """Player-match rows that go with the median prior rows."""
    return priors.select(
        F.concat(F.col("match_id").cast("string"), F.lit(f"_{prior_date}")).alias("match_key"),
        "match_id",
        "player_id",
        F.lit(prior_date).cast("date").alias("date"),
        F.lit("prior_synthetic").alias("venue"),
        F.lit("unknown").alias("batting_team"),
        F.lit("unknown").alias("bowling_team"),
        F.coalesce("runs", F.lit(15.0)).alias("runs"),
        F.lit(10.0).alias("balls"),
        *[F.lit(0.0).alias(c) for c in ("fours", "sixes", "dismissed")],
        F.coalesce(F.col("wickets").cast("double"), F.lit(0.5)).alias("wickets"),
        F.lit(12.0).alias("balls_bowled"),
        F.lit(30.0).alias("runs_conceded"),
        F.lit(10.0).alias("total_balls_faced"),
        F.lit(12.0).alias("total_balls_bowled"),
        F.lit("allrounder").alias("role"),
    )
