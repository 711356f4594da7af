"""Registered queries: aggregates, profiles, labels, momentum, form, splits and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.functions.franchise import play_style_scores
from creaseline.operators.quantiles import exact_medians
from creaseline.operators.windows import last_per_key
from creaseline.plans import diagnostics, evaluation, features, form, matches, profiles, stats
from creaseline.queries import views
from creaseline.queries.registry import query, r, rounded
from creaseline.session import stage_table


def _team_rates(spark, sf):
    return features.with_team_and_rates(views.player_match(spark, sf))


@query("b17_b18_b21_team_opponent_rates", f"SELECT match_id, player_id, team, bowling_team AS opponent_team, {r('match_sr', 'match_econ')} FROM base")
def _(spark, sf):
    rows = _team_rates(spark, sf)
    opponent = features.opponent_of(F.col("team"), F.col("batting_team"), F.col("bowling_team"))
    return rounded(rows.select("match_id", "player_id", "team", opponent.alias("opponent_team"), "match_sr", "match_econ"))


_STYLE = ("style_bat_aggressive", "style_bat_anchor", "style_bowl_economical", "style_bowl_expensive_wicket_taker")


@query("b22_play_style_scores", f"SELECT match_id, player_id, {r(*_STYLE)} FROM feat")
def _(spark, sf):
    rows = features.rolling_features(_team_rates(spark, sf), with_franchise_form=False)
    return rounded(rows.withColumns(play_style_scores()).select("match_id", "player_id", *_STYLE))


_OPP = ("opponent_past_batting_strength", "opponent_past_bowling_strength", "opponent_strength")


@query("b23_c05_opponent_strength", f"SELECT match_id, player_id, opponent_team, {r(*_OPP)} FROM feat")
def _(spark, sf):
    base = _team_rates(spark, sf)
    past = features.team_past_strength(features.team_match_strength(base))
    return rounded(features.with_opponent_strength(base, past).select("match_id", "player_id", "opponent_team", *_OPP))


@query(
    "c02_venue_prior_join",
    f"SELECT p.match_id, p.player_id, {r(*features.VENUE_PRIORS)} FROM pms p LEFT JOIN venue_prior v ON v.match_id = p.match_id",
)
def _(spark, sf):
    base = _team_rates(spark, sf)
    rows = base.join(features.venue_league_priors(base), "match_id", "left")
    return rounded(rows.select("match_id", "player_id", *features.VENUE_PRIORS))


@query("c03_d05_pair_match_dates", f"SELECT match_id, batter, bowler, {r('pruns')}, pballs, pdism, date FROM pair_match")
def _(spark, sf):
    pairs = stats.pair_match_table(views.deliveries(spark, sf))
    return rounded(pairs.join(features.match_dates(views.player_match(spark, sf)), "match_id", "left"))


_GLOBALS = tuple(features.GLOBALS)


@query("c04_player_globals_join", f"SELECT p.match_id, p.player_id, {r(*_GLOBALS)} FROM pms p LEFT JOIN globals g ON g.player_id = p.player_id")
def _(spark, sf):
    base = _team_rates(spark, sf)
    return rounded(
        base.select("match_id", "player_id").join(features.player_globals(base), "player_id", "left")
    )


@query(
    "c06_matchup_rates",
    f"SELECT match_id, player_id, real_batting_matchup, real_bowling_matchup, {r('batting_matchup_sr', 'bowling_matchup_sr')} FROM blended",
)
def _(spark, sf):
    base = _team_rates(spark, sf)
    rows = base.select("match_id", "player_id").join(features.player_globals(base), "player_id", "left")
    priors = features.pair_priors(views.deliveries(spark, sf), features.match_dates(base))
    return rounded(
        features.with_matchups(rows, priors).select(
            "match_id", "player_id", "real_batting_matchup", "real_bowling_matchup", "batting_matchup_sr", "bowling_matchup_sr"
        )
    )


@query("e18_venue_fallback", f"SELECT match_id, player_id, uses_venue_fallback, {r('venue_avg_runs', 'venue_avg_wickets', 'venue_strike_rate', 'venue_economy')} FROM blended")
def _(spark, sf):
    base = _team_rates(spark, sf)
    rows = features.venue_history(base).join(features.venue_league_priors(base), "match_id", "left")
    rows = rows.join(features.player_globals(base), "player_id", "left").withColumns(features.venue_fallback())
    return rounded(
        rows.select("match_id", "player_id", "uses_venue_fallback", "venue_avg_runs", "venue_avg_wickets", "venue_strike_rate", "venue_economy")
    )


_VM = ("sum_runs", "sum_rc", "match_sr", "match_econ", "avg_runs_per_player", "avg_wk_per_player")


@query("d04_venue_match", f"SELECT match_id, venue, date, sum_balls, sum_wk, sum_bb, npl, {r(*_VM)} FROM venue_match")
def _(spark, sf):
    return rounded(features.venue_matches(_team_rates(spark, sf)))


@query("d06_player_global_means", f"SELECT player_id, {r(*_GLOBALS)} FROM globals")
def _(spark, sf):
    return rounded(features.player_globals(_team_rates(spark, sf)))


_TM = ("top5_runs", "top5_wickets", "sum_runs_all", "sum_wickets_all")


@query("d07_top5_team_sums", f"SELECT match_id, team, date, {r(*_TM)} FROM team_match")
def _(spark, sf):
    return rounded(features.team_match_strength(_team_rates(spark, sf)))


_AGG = (
    "team_avg_form_runs", "team_avg_form_wickets", "team_avg_strike_rate", "team_avg_economy",
    "team_avg_form_runs_ipl", "team_avg_form_wickets_ipl", "team_strength_score",
)


@query("d08_team_aggregates", f"SELECT match_id, team, team_n_players, {r(*_AGG)} FROM agg")
def _(spark, sf):
    return rounded(matches.team_aggregates(views.player_features(spark, sf)))


@query("d09_team_totals", f"SELECT match_id, team, {r('team_total_runs')} FROM totals")
def _(spark, sf):
    return rounded(matches.team_totals(_team_rates(spark, sf)))


@query("d10_proxy_winner", "SELECT match_id, winner FROM proxy")
def _(spark, sf):
    return matches.proxy_winners(_team_rates(spark, sf))


@query("d11_match_meta", "SELECT match_id, min(venue) AS venue, min(date) AS match_date FROM pms GROUP BY match_id")
def _(spark, sf):
    return matches.match_meta(views.player_match(spark, sf))


@query("d12_b11_innings_table", f"SELECT match_id, innings, batting_team, bowling_team, {r('runs', 'pp_runs')}, wickets, run_outs FROM inn")
def _(spark, sf):
    return rounded(stats.innings_table(views.deliveries(spark, sf)))


@query("d13_league_baselines", f"SELECT {r('league_1', 'league_2', 'league_pp')} FROM league")
def _(spark, sf):
    return rounded(profiles.league_baselines(profiles.league_innings(views.deliveries(spark, sf))))


_MEANS = ("mean_runs_bf", "mean_runs_chase", "mean_pp_bat", "mean_conceded_bf", "mean_conceded_chase", "wk_1", "wk_2", "ro_1", "ro_2")


@query("d14_team_innings_means", f"SELECT team, n_innings_bat_1, n_innings_bat_2, {r(*_MEANS)} FROM team_means")
def _(spark, sf):
    return rounded(profiles.team_innings_means(profiles.league_innings(views.deliveries(spark, sf))))


def _ratios(spark, sf):
    innings = profiles.league_innings(views.deliveries(spark, sf))
    return profiles.team_ratios(profiles.team_innings_means(innings), profiles.league_baselines(innings))


@query("d15_team_ratios", f"SELECT team, {r(*profiles.RATIOS)} FROM team_ratio")
def _(spark, sf):
    return rounded(_ratios(spark, sf).select("team", *profiles.RATIOS))


@query("d16_dominance_zscores", f"SELECT team, {r(*profiles.DOMINANCE)} FROM team_dom")
def _(spark, sf):
    ratios = stage_table(_ratios(spark, sf), "team_ratios")
    return rounded(profiles.with_dominance(ratios).select("team", *profiles.DOMINANCE))


_PROF = (*profiles.RATIOS, *profiles.DOMINANCE)


@query("d17_franchise_profiles", f"SELECT franchise, CAST(n_innings_bat_1 AS BIGINT) AS n_innings_bat_1, CAST(n_innings_bat_2 AS BIGINT) AS n_innings_bat_2, {r(*_PROF)} FROM prof")
def _(spark, sf):
    return rounded(profiles.franchise_profiles(views.deliveries(spark, sf)))


@query(
    "d18_career_batting",
    f"""SELECT batter, {r('runs')}, balls, fours, sixes, dismissals, {r('strike_rate')} FROM (
    SELECT batter, sum(runs_off_bat) AS runs, CAST(sum(ball_faced) AS BIGINT) AS balls, CAST(sum(is_four) AS BIGINT) AS fours, CAST(sum(is_six) AS BIGINT) AS sixes,
    CAST(sum(CASE WHEN player_dismissed <> '' AND dismissal_kind <> 'run out' THEN 1 ELSE 0 END) AS BIGINT) AS dismissals, sum(runs_off_bat) / sum(ball_faced) * 100 AS strike_rate
    FROM ind WHERE date >= DATE '2000-01-01' GROUP BY batter) x""",
)
def _(spark, sf):
    return rounded(stats.career_summary(views.deliveries(spark, sf), since="2000-01-01")[0])


@query(
    "d18_career_bowling",
    f"""SELECT bowler, wickets, balls_bowled, {r('runs_conceded', 'overs', 'economy')} FROM (
    SELECT bowler, CAST(sum(CASE WHEN player_dismissed <> '' AND dismissal_kind <> 'run out' THEN 1 ELSE 0 END) AS BIGINT) AS wickets,
    CAST(sum(ball_bowled) AS BIGINT) AS balls_bowled, sum(conceded) AS runs_conceded, sum(ball_bowled) / 6.0 AS overs, sum(conceded) / (sum(ball_bowled) / 6.0) AS economy
    FROM ind WHERE date >= DATE '2000-01-01' GROUP BY bowler) x""",
)
def _(spark, sf):
    return rounded(stats.career_summary(views.deliveries(spark, sf), since="2000-01-01")[1])


@query(
    "d19_innings_totals",
    """SELECT match_id, sum(CASE WHEN innings = 1 THEN conceded END) AS innings1_runs, sum(CASE WHEN innings = 2 THEN conceded END) AS innings2_runs,
    CAST(sum(CASE WHEN innings = 1 THEN (dismissal_kind <> '')::INT END) AS BIGINT) AS innings1_wickets,
    CAST(sum(CASE WHEN innings = 2 THEN (dismissal_kind <> '')::INT END) AS BIGINT) AS innings2_wickets FROM ind GROUP BY match_id""",
)
def _(spark, sf):
    return stats.innings_totals(views.deliveries(spark, sf))


@query(
    "d20_build_counts",
    """SELECT (SELECT count(*) FROM deliveries) AS n_rows, (SELECT count(DISTINCT match_id) FROM deliveries) AS n_matches, count(DISTINCT p) AS n_players FROM (
    SELECT batter AS p FROM deliveries UNION ALL SELECT bowler FROM deliveries UNION ALL SELECT non_striker FROM deliveries
    UNION ALL SELECT player_dismissed FROM deliveries) x WHERE p <> ''""",
)
def _(spark, sf):
    return stats.player_count(views.deliveries(spark, sf))


@query("d20_role_distribution", "SELECT role, count(*) AS n FROM pms GROUP BY role")
def _(spark, sf):
    return diagnostics.role_distribution(views.player_match(spark, sf))


@query(
    "d20_coverage",
    f"""SELECT {r('pct_missing_teams', 'pct_real_bat', 'pct_real_bowl', 'pct_fallback')} FROM (SELECT
    100.0 * avg(CASE WHEN batting_team IS NULL OR bowling_team IS NULL OR batting_team = '' OR bowling_team = '' THEN 1 ELSE 0 END) AS pct_missing_teams,
    100.0 * avg(real_batting_matchup::INT) AS pct_real_bat, 100.0 * avg(real_bowling_matchup::INT) AS pct_real_bowl,
    100.0 * avg(uses_venue_fallback::INT) AS pct_fallback FROM blended) x""",
)
def _(spark, sf):
    base = _team_rates(spark, sf)
    rates = features.matchup_rates(features.pair_priors(views.deliveries(spark, sf), features.match_dates(base)))
    rows = features.venue_history(base).join(rates, ["match_id", "player_id"], "left")

    def pct(c):
        return F.avg(c.cast("double")) * 100.0

    covered = rows.agg(
        pct(F.col("batting_matchup_sr").isNotNull()).alias("pct_real_bat"),
        pct(F.col("bowling_matchup_sr").isNotNull()).alias("pct_real_bowl"),
        pct(~F.col("real_venue")).alias("pct_fallback"),
    )
    return rounded(covered.withColumn("pct_missing_teams", diagnostics.missing_team_share(base).scalar()))


_MEDIANS = (
    "runs", "wickets", "form_runs", "form_wickets", "form_runs_ipl", "form_wickets_ipl", "days_since_prev_match",
    "strike_rate", "economy", "venue_avg_runs", "venue_avg_wickets", "batting_matchup_sr", "bowling_matchup_sr",
    "opponent_strength", "style_bat_aggressive", "style_bat_anchor",
)


@query(
    "d21_column_medians",
    f"SELECT name, {r('median')} FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS name, median(CAST({c} AS DOUBLE)) AS median FROM feat" for c in _MEDIANS)
    + ") x",
)
def _(spark, sf):
    return rounded(exact_medians(views.player_features(spark, sf), list(_MEDIANS)))


@query(
    "d22_leakage_check",
    f"""SELECT n, {r('correlation', 'exact_match_rate', digits=5)} FROM (SELECT count(*) AS n, corr(f.opponent_past_batting_strength, t.top5_runs) AS correlation,
    avg((f.opponent_past_batting_strength = t.top5_runs)::INT) AS exact_match_rate
    FROM feat f JOIN team_match t ON t.match_id = f.match_id AND t.team = f.opponent_team) x""",
)
def _(spark, sf):
    strength = features.team_match_strength(_team_rates(spark, sf))
    return rounded(diagnostics.leakage_check(views.player_features(spark, sf), strength), 5)


@query(
    "d22_strength_win_correlation",
    f"""SELECT n, {r('correlation', digits=5)} FROM (SELECT count(*) AS n, corr(team1_strength - team2_strength, (winner = 'team1')::INT) AS correlation
    FROM mrows WHERE winner IN ('team1', 'team2')) x""",
)
def _(spark, sf):
    return rounded(diagnostics.strength_win_correlation(views.match_rows(spark, sf)), 5)


@query(
    "d29_match_rosters",
    "SELECT match_id, batting_team AS team, string_agg(player_id, ',' ORDER BY player_id) AS players FROM pms GROUP BY match_id, batting_team",
)
def _(spark, sf):
    return form.roster_lists(stats.match_rosters(views.player_match(spark, sf)))


@query("d30_team_centric", f"SELECT match_id, match_date, win, {r('own_runs', 'opp_runs', 'margin')} FROM own_team")
def _(spark, sf):
    return rounded(matches.team_centric(views.match_rows(spark, sf), ("T3",)))


@query(
    "d30_margin_histogram",
    """SELECT CAST(least(floor((margin - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n
    FROM own_team, (SELECT min(margin) AS lo, max(margin) AS hi FROM own_team) b GROUP BY 1""",
)
def _(spark, sf):
    return diagnostics.margin_histogram(matches.team_centric(views.match_rows(spark, sf), ("T3",)))


@query(
    "e17_rolling_win_rate",
    f"""SELECT match_id, team, {r('win_rate')} FROM (SELECT match_id, 'T3' AS team, CASE WHEN count(*) OVER w >= 5 THEN avg(win) OVER w END AS win_rate
    FROM own_team WINDOW w AS (ORDER BY match_date, match_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)) x""",
)
def _(spark, sf):
    rows = matches.team_centric(views.match_rows(spark, sf), ("T3",)).withColumn("team", F.lit("T3"))
    return rounded(matches.rolling_win_rate(rows).select("match_id", "team", "win_rate"))


@query(
    "f12_top_scorers",
    f"SELECT player_id, {r('runs')} FROM (SELECT player_id, sum(runs) AS runs FROM pms WHERE batting_team = 'T3' GROUP BY player_id ORDER BY runs DESC, player_id LIMIT 12) x",
)
def _(spark, sf):
    runs = views.player_match(spark, sf).where(F.col("batting_team") == "T3").groupBy("player_id").agg(F.sum("runs").alias("runs"))
    return rounded(runs.orderBy(F.desc("runs"), "player_id").limit(12))


_SPREAD = ("momentum_runs", "momentum_wickets", "std_runs", "std_wickets")


@query(
    "e08_e09_momentum_spread",
    f"""SELECT match_id, player_id, {r(*_SPREAD)} FROM (SELECT match_id, player_id,
    0.5 * lag(runs, 1) OVER w + 0.3 * lag(runs, 2) OVER w + 0.2 * lag(runs, 3) OVER w AS momentum_runs,
    0.5 * lag(wickets, 1) OVER w + 0.3 * lag(wickets, 2) OVER w + 0.2 * lag(wickets, 3) OVER w AS momentum_wickets,
    coalesce(stddev_samp(runs) OVER p5, 0.0) AS std_runs, coalesce(stddev_samp(wickets) OVER p5, 0.0) AS std_wickets FROM pms
    WINDOW w AS (PARTITION BY player_id ORDER BY date, match_id), p5 AS (PARTITION BY player_id ORDER BY date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) x""",
)
def _(spark, sf):
    rows = views.player_match(spark, sf).select("match_id", "player_id", "date", "runs", "wickets")
    return rounded(features.spread_and_momentum(rows).select("match_id", "player_id", *_SPREAD))


_TRAIN = (*_SPREAD, "form_runs", "strike_rate", "days_since_prev_match", "venue_avg_runs", "opponent_strength", "batting_matchup_sr")


@query("e10_i02_player_training_rows", f"SELECT match_id, player_id, date, role, role_encoded, runs, wickets, {r(*_TRAIN)} FROM train_rows")
def _(spark, sf):
    rows = features.player_training_rows(views.player_features(spark, sf), views.player_match(spark, sf))
    return rounded(rows.select("match_id", "player_id", "date", "role", "role_encoded", "runs", "wickets", *_TRAIN))


@query("e11_franchise_momentum", f"SELECT match_id, {r('team1_momentum', 'team2_momentum')} FROM mrows")
def _(spark, sf):
    return rounded(
        matches.with_momentum(views.match_rows(spark, sf).drop("team1_momentum", "team2_momentum")).select(
            "match_id", "team1_momentum", "team2_momentum"
        )
    )


_FORM = (
    "weighted_avg_runs_last_5", "weighted_avg_wk_last_5", "weighted_avg_runs_last_10",
    "weighted_avg_wk_last_10", "data_confidence",
)


@query("e12_recency_weighted_form", f"SELECT player_id, n_matches_last_5, n_matches_last_10, {r(*_FORM)} FROM form_tab")
def _(spark, sf):
    return rounded(form.recent_form(views.player_match(spark, sf)))


@query(
    "e13_playing_probability",
    f"SELECT player_id, {r('playing_prob')} FROM (SELECT player_id, least(count(DISTINCT match_id) / 5.0, 1.0) AS playing_prob FROM recent WHERE recency <= 5 GROUP BY player_id) x",
)
def _(spark, sf):
    return rounded(form.playing_probability(views.player_match(spark, sf)))


@query("e14_selection_score", f"SELECT team, player_id, role, matches_last_5, matches_last_10, {r('selection_score')} FROM selection")
def _(spark, sf):
    return rounded(form.selection_table(_team_rates(spark, sf)))


_LAST = ("team", "opponent_team", "form_runs", "strike_rate")


@query(
    "e15_latest_row_per_player",
    f"SELECT player_id, team, opponent_team, {r('form_runs', 'strike_rate')} FROM feat QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY date DESC, match_id DESC) = 1",
)
def _(spark, sf):
    dated = views.player_features(spark, sf).join(
        views.player_match(spark, sf).select("match_id", "player_id", "date"), ["match_id", "player_id"], "left"
    )
    return rounded(last_per_key(dated, ["player_id"], ["date", "match_id"], list(_LAST)))


def _decided(spark, sf):
    return views.match_rows(spark, sf).where(F.col("winner").isin("team1", "team2"))


@query("e19_time_split", "SELECT match_id, CASE WHEN rn <= floor(n * (1.0 - 0.2)) THEN 'train' ELSE 'test' END AS part FROM decided")
def _(spark, sf):
    return evaluation.time_split(_decided(spark, sf), date="match_date").select("match_id", "part")


@query(
    "e19_player_time_split",
    """SELECT match_id, player_id, CASE WHEN rn <= floor(n * (1.0 - 0.2)) THEN 'train' ELSE 'test' END AS part
    FROM (SELECT *, row_number() OVER (ORDER BY date, match_id, player_id) AS rn, count(*) OVER () AS n FROM pms) x""",
)
def _(spark, sf):
    rows = views.player_match(spark, sf).select("match_id", "player_id", "date")
    return evaluation.time_split(rows, ties=["player_id"]).select("match_id", "player_id", "part")


@query("e20_block_folds", "SELECT match_id, CAST(ceil(rn * 5 / n) - 1 AS INTEGER) AS fold FROM decided")
def _(spark, sf):
    return evaluation.block_folds(_decided(spark, sf), date="match_date").select("match_id", "fold")


@query(
    "e21_expanding_folds",
    """SELECT match_id, CAST(fold AS INTEGER) AS fold, CASE WHEN rn - 1 < st THEN 'train' ELSE 'validate' END AS role FROM (
    SELECT *, n - s * sz + fold * sz AS st FROM (SELECT *, n // (s + 1) AS sz FROM (SELECT *, least(5, greatest(2, n // 40)) AS s FROM decided) a) b,
    LATERAL (SELECT unnest(range(0, s)) AS fold) f) c WHERE rn - 1 < st + sz""",
)
def _(spark, sf):
    return evaluation.expanding_folds(_decided(spark, sf), date="match_date").select("match_id", "fold", "role")


@query(
    "a19_reduced_features",
    f"SELECT match_id, player_id, team, runs, wickets, {r('form_runs', 'form_wickets', 'strike_rate', 'economy')}, round(form_runs + 1e-9, 6) + 0.0 AS form_runs_ipl, round(form_wickets + 1e-9, 6) + 0.0 AS form_wickets_ipl, CAST(0 AS DOUBLE) AS days_since_prev_match FROM roll",
)
def _(spark, sf):
    return rounded(features.reduced_features(views.player_match(spark, sf)))


@query(
    "c07_date_and_role_join",
    "SELECT match_id, player_id, date, role, CASE role WHEN 'batter' THEN 0 WHEN 'bowler' THEN 1 ELSE 2 END AS role_encoded FROM pms",
)
def _(spark, sf):
    from creaseline.functions.franchise import role_code

    meta = views.player_match(spark, sf).select("match_id", "player_id", "date", "role")
    rows = views.player_features(spark, sf).select("match_id", "player_id").join(meta, ["match_id", "player_id"], "left")
    return rows.withColumn("role_encoded", role_code(F.col("role")))


_SIDES = ("strength", "form_runs", "form_runs_ipl", "strike_rate", "economy")
_SIDE_COLUMNS = tuple(f"team{s}_{c}" for c in _SIDES for s in (1, 2))


@query("c08_two_team_rows", f"SELECT match_id, team1_name, team2_name, {r(*_SIDE_COLUMNS)} FROM labelled")
def _(spark, sf):
    return rounded(matches.two_team_rows(matches.team_aggregates(views.player_features(spark, sf))))


@query("c09_label_resolution", "SELECT match_id, winner, winner_source FROM labelled")
def _(spark, sf):
    f = views.player_features(spark, sf)
    rows = matches.two_team_rows(matches.team_aggregates(f))
    resolved = matches.resolve_labels(rows, views.official_results(spark, sf), matches.proxy_winners(f))
    return resolved.select("match_id", "winner", "winner_source")


@query(
    "a18_match_training_rows",
    f"SELECT match_id, team1_name, team2_name, venue, match_date, winner, winner_source, {r(*_SIDE_COLUMNS, 'team1_total_runs', 'team2_total_runs', 'team1_momentum', 'team2_momentum')} FROM mrows",
)
def _(spark, sf):
    return rounded(views.match_rows_plan(spark, sf).select(*matches.MATCH_COLUMNS))


@query(
    "c10_semi_anti_joins",
    """SELECT 'squad_without_features' AS what, count(*) AS n FROM squads WHERE player_id NOT IN (SELECT player_id FROM pms)
    UNION ALL SELECT 'franchise_rows', count(*) FROM pms WHERE batting_team IN (SELECT team FROM franchises)
    UNION ALL SELECT 'labelled_deliveries', count(*) FROM deliveries WHERE match_id IN (SELECT match_id FROM official)""",
)
def _(spark, sf):
    def count(df, what):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")

    pms = views.player_match(spark, sf)
    names = views.franchises(spark, sf).withColumnRenamed("team", "batting_team")
    return (
        count(views.squads(spark, sf).join(pms, "player_id", "left_anti"), "squad_without_features")
        .unionByName(count(pms.join(names, "batting_team", "left_semi"), "franchise_rows"))
        .unionByName(
            count(views.deliveries(spark, sf).join(views.official_results(spark, sf), "match_id", "left_semi"), "labelled_deliveries")
        )
    )


@query(
    "c11_momentum_as_of",
    f"""WITH asked AS (SELECT match_id AS fixture_id, match_date, 1 AS side, team1_name AS franchise FROM mrows UNION ALL SELECT match_id, match_date, 2, team2_name FROM mrows),
    ranked AS (SELECT a.fixture_id, a.side, m.res, row_number() OVER (PARTITION BY a.fixture_id, a.side ORDER BY m.match_date DESC, m.match_id DESC) AS k
    FROM asked a JOIN mom_line m ON m.franchise = a.franchise AND m.match_date < a.match_date AND m.res IS NOT NULL),
    rate AS (SELECT fixture_id, side, avg(res) AS m FROM ranked WHERE k <= 5 GROUP BY fixture_id, side)
    SELECT match_id AS fixture_id, {r('team1_momentum', 'team2_momentum')} FROM (SELECT f.match_id, coalesce(r1.m, 0.5) AS team1_momentum, coalesce(r2.m, 0.5) AS team2_momentum
    FROM mrows f LEFT JOIN rate r1 ON r1.fixture_id = f.match_id AND r1.side = 1 LEFT JOIN rate r2 ON r2.fixture_id = f.match_id AND r2.side = 2) x""",
)
def _(spark, sf):
    rows = views.match_rows(spark, sf)
    fixtures = rows.select(F.col("match_id").alias("fixture_id"), "match_date", "team1_name", "team2_name")
    return rounded(
        matches.momentum_as_of(fixtures, rows).select("fixture_id", "team1_momentum", "team2_momentum")
    )


@query(
    "c22_profile_join",
    f"""SELECT match_id, {r('team1_bat_first_ratio', 'team2_chase_ratio', 'team1_bat_dom', 'team2_field_dom')} FROM (
    SELECT m.match_id, coalesce(a.bat_first_ratio, 1.0) AS team1_bat_first_ratio, coalesce(b.chase_ratio, 1.0) AS team2_chase_ratio,
    coalesce(a.bat_dom, 0.0) AS team1_bat_dom, coalesce(b.field_dom, 0.0) AS team2_field_dom
    FROM mrows m LEFT JOIN prof a ON a.franchise = m.team1_name LEFT JOIN prof b ON b.franchise = m.team2_name) x""",
)
def _(spark, sf):
    rows = views.match_rows(spark, sf).select("match_id", "team1_name", "team2_name")
    joined = profiles.with_profiles(rows, views.profile_table(spark, sf))
    return rounded(joined.select("match_id", "team1_bat_first_ratio", "team2_chase_ratio", "team1_bat_dom", "team2_field_dom"))


@query(
    "f05_pick_eleven",
    f"SELECT team, player_id, role, {r('selection_score')}, CASE WHEN pick <= 11 THEN 'xi' WHEN place <= 2 THEN 'bench' ELSE 'out' END AS slot FROM picked",
)
def _(spark, sf):
    return rounded(form.pick_eleven(views.scored_selection(spark, sf)).select("team", "player_id", "role", "selection_score", "slot"))


@query(
    "f06_overseas_cap",
    f"""WITH os AS (SELECT p.*, coalesce(s.is_overseas, 0) AS is_overseas, pick <= 11 AS in_xi FROM picked p LEFT JOIN squads s ON s.team = p.team AND s.player_id = p.player_id),
    cnt AS (SELECT *, greatest(sum(CASE WHEN in_xi AND is_overseas = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY team) - 4, 0) AS excess,
    sum(CASE WHEN NOT in_xi AND is_overseas = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY team) AS dom,
    row_number() OVER (PARTITION BY team, in_xi, is_overseas ORDER BY selection_score, player_id DESC) AS low,
    row_number() OVER (PARTITION BY team, in_xi, is_overseas ORDER BY selection_score DESC, player_id) AS high FROM os)
    SELECT team, player_id, is_overseas, {r('selection_score')}, (in_xi AND NOT (is_overseas = 1 AND low <= least(excess, dom))) OR (NOT in_xi AND is_overseas = 0 AND high <= least(excess, dom)) AS in_xi FROM cnt""",
)
def _(spark, sf):
    picked = form.squad_flags(form.pick_eleven(views.scored_selection(spark, sf)), views.squads(spark, sf))
    capped = form.cap_overseas(picked)
    return rounded(
        capped.select(
            "team", "player_id", F.coalesce("is_overseas", F.lit(0)).alias("is_overseas"), "selection_score", (F.col("slot") == "xi").alias("in_xi")
        )
    )


@query(
    "f08_actual_top_batters",
    f"SELECT match_id, batter, {r('runs')}, place FROM (SELECT match_id, batter, sum(runs_off_bat) AS runs, CAST(row_number() OVER (PARTITION BY match_id ORDER BY sum(runs_off_bat) DESC, batter) AS INTEGER) AS place FROM deliveries GROUP BY match_id, batter) x WHERE place <= 5",
)
def _(spark, sf):
    return rounded(stats.top_scorers_per_match(views.deliveries(spark, sf)))


@query(
    "f09_actual_top_bowlers",
    "SELECT * FROM (SELECT match_id, bowler, count(*) AS wickets, CAST(row_number() OVER (PARTITION BY match_id ORDER BY count(*) DESC, bowler) AS INTEGER) AS place FROM deliveries WHERE dismissal_kind <> '' GROUP BY match_id, bowler) x WHERE place <= 3",
)
def _(spark, sf):
    return stats.top_wicket_takers_per_match(views.deliveries(spark, sf))


@query(
    "g06_prior_rows_for_unseen",
    f"SELECT s.player_id, CAST(-999 AS BIGINT) AS match_id, 'unknown' AS team, {r('form_runs', 'strike_rate', 'runs')} FROM squads s, (SELECT median(form_runs) AS form_runs, median(strike_rate) AS strike_rate, median(runs) AS runs FROM feat) m WHERE s.player_id NOT IN (SELECT player_id FROM feat)",
)
def _(spark, sf):
    rows = features.median_prior_rows(views.player_features(spark, sf), views.squads(spark, sf))
    return rounded(rows.select("player_id", "match_id", "team", "form_runs", "strike_rate", "runs"))


@query("b25_team_filter", "SELECT match_id, player_id, batting_team, bowling_team FROM pms WHERE batting_team = 'T3' OR bowling_team = 'T3'")
def _(spark, sf):
    return form.team_rows(views.player_match(spark, sf), "t3").select("match_id", "player_id", "batting_team", "bowling_team")
