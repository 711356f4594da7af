"""Registered queries: prediction log, grading, dashboards, calibration and scorecards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from creaseline.plans import evaluation, predlog, stats
from creaseline.queries import views
from creaseline.queries.oracle import CTES
from creaseline.queries.registry import query, r, rounded
from creaseline.session import ensure_checkpoint_dir
from creaseline.sources import scorecards as cards

CTES.update(
    {
        "plog": """
SELECT match_id, concat('m', CAST(match_id AS VARCHAR)) AS match_key, CASE WHEN match_id % 19 = 0 THEN NULL ELSE md END AS match_date, venue, team1_name, team2_name,
       CASE WHEN p >= 0.5 THEN team1_name ELSE lower(team2_name) END AS pred_winner, p AS pred_p_team1_win,
       concat(team1_name, '_', CAST(match_id % 15 AS VARCHAR)) AS pred_best_bat, concat(team2_name, '_', CAST(match_id % 15 AS VARCHAR)) AS pred_best_bowl,
       concat(team1_name, '_', CAST(match_id % 3 AS VARCHAR)) AS pred_potm,
       CASE WHEN match_id % 8 <> 0 THEN CAST(150 + match_id % 40 AS DOUBLE) END AS pf, CASE WHEN match_id % 8 <> 0 THEN CAST(140 + match_id % 50 AS DOUBLE) END AS ps,
       CASE WHEN match_id % 13 = 0 THEN '' WHEN match_id % 17 = 0 THEN 'No  Result' WHEN r1 = r2 THEN 'Tie' WHEN r1 > r2 THEN team1_name ELSE team2_name END AS actual_winner,
       CASE WHEN match_id % 4 = 0 THEN upper(concat(team1_name, ' ', CAST(match_id % 15 AS VARCHAR))) ELSE concat(team2_name, '_1') END AS actual_top_scorer,
       CASE WHEN match_id % 3 = 0 THEN concat(team2_name, '_', CAST(match_id % 15 AS VARCHAR)) ELSE '' END AS actual_top_wicket_bowler,
       CASE WHEN match_id % 5 = 0 THEN '' ELSE concat(team1_name, '_', CAST(match_id % 4 AS VARCHAR)) END AS official_potm,
       CASE WHEN match_id % 6 <> 0 THEN r1 END AS ar1, CASE WHEN match_id % 6 <> 1 THEN r2 END AS ar2, r1, r2
FROM (SELECT match_id, min(date) AS md, min(venue) AS venue, min(CASE WHEN innings = 1 THEN batting_team END) AS team1_name, min(CASE WHEN innings = 1 THEN bowling_team END) AS team2_name,
             coalesce(sum(CASE WHEN innings = 1 THEN runs_off_bat + extras END), 0) AS r1, coalesce(sum(CASE WHEN innings = 2 THEN runs_off_bat + extras END), 0) AS r2,
             (match_id * 37 % 101) / CAST(100 AS DOUBLE) AS p FROM deliveries GROUP BY match_id) x""",
        "glog": """
SELECT *, CASE WHEN actual_winner = '' THEN NULL WHEN actual_winner = 'No  Result' THEN 'skipped_no_result' ELSE CASE WHEN lower(pred_winner) = lower(actual_winner) THEN 'true' ELSE 'false' END END AS winner_correct,
       CASE WHEN official_potm = '' THEN NULL ELSE CASE WHEN pred_potm = official_potm THEN 'true' ELSE 'false' END END AS potm_correct,
       match_id % 23 <> 0 AS p1, match_id % 7 <> 0 AND actual_winner <> '' AS p2, match_id % 9 = 0 AS p3,
       (abs(ar1 - pf) + abs(ar2 - ps)) / 2.0 AS innings_mae, ar1 - pf AS delta1, ar2 - ps AS delta2 FROM plog""",
        "scored": "SELECT match_id, winner_source, CAST(winner = 'team1' AS INTEGER) AS y, (match_id * 37 % 101) / CAST(100 AS DOUBLE) AS p FROM mrows WHERE winner IN ('team1', 'team2')",
        "cards": """
SELECT concat('G', CAST(match_id AS VARCHAR)) AS match, match_id, innings, batting_team AS team, batter AS player, r, b, f4, f6,
       CASE WHEN o IS NULL THEN 'not out' WHEN o LIKE 'run out%' THEN 'run out (Sub)' ELSE concat('c Keeper b ', split_part(o, '|', 2)) END AS dismissal,
       CASE WHEN o IS NULL OR o LIKE 'run out%' THEN 'Unknown' ELSE split_part(o, '|', 2) END AS bowler_name
FROM (SELECT match_id, innings, batting_team, batter, CAST(sum(runs_off_bat) AS BIGINT) AS r, CAST(sum((is_wide = 0)::INT) AS BIGINT) AS b, CAST(sum((runs_off_bat = 4)::INT) AS BIGINT) AS f4,
             CAST(sum((runs_off_bat = 6)::INT) AS BIGINT) AS f6, max(CASE WHEN dismissal_kind <> '' THEN concat(dismissal_kind, '|', bowler) END) AS o FROM deliveries GROUP BY match_id, innings, batting_team, batter) x""",
    }
)


@query(
    "c26_h21_result_grading",
    f"SELECT match_key, winner_correct, potm_correct, {r('actual_first_innings_team_runs', 'actual_second_innings_team_runs')} FROM (SELECT *, coalesce(ar1, r1) AS actual_first_innings_team_runs, coalesce(ar2, r2) AS actual_second_innings_team_runs FROM glog) x",
)
def _(spark, sf):
    log = views.prediction_log(spark, sf)
    results = log.select("match_key", "actual_winner", "official_potm")
    totals = stats.innings_totals(views.deliveries(spark, sf)).withColumns(
        {
            "match_key": F.concat(F.lit("m"), F.col("match_id").cast("string")),
            "innings1_runs": F.coalesce("innings1_runs", F.lit(0.0)),
            "innings2_runs": F.coalesce("innings2_runs", F.lit(0.0)),
        }
    )
    graded = predlog.apply_results(log, results, totals)
    return rounded(
        graded.select("match_key", "winner_correct", "potm_correct", "actual_first_innings_team_runs", "actual_second_innings_team_runs")
    )


@query(
    "c25_prediction_upsert",
    "SELECT match_key, CASE WHEN match_id % 2 = 1 THEN 'kept' WHEN match_id % 4 = 0 THEN 'forced' ELSE 'added' END AS state FROM plog",
)
def _(spark, sf):
    log = views.prediction_log(spark, sf)
    old = log.where("match_id % 2 = 1 OR match_id % 4 = 0").withColumn("post_notes", F.lit("kept"))
    fresh = log.where("match_id % 4 = 2").withColumn("post_notes", F.lit("added"))
    replaced = log.where("match_id % 4 = 0").withColumn("post_notes", F.lit("forced"))
    added, _ = predlog.upsert_predictions(old, fresh.unionByName(old.where("match_id % 3 = 0").withColumn("post_notes", F.lit("lost"))))
    final, _ = predlog.upsert_predictions(added, replaced, force=True)
    return final.select("match_key", F.col("post_notes").alias("state"))


@query("c27_review_update", "SELECT match_key, match_id % 9 = 0 OR match_id % 2 = 0 AS p3, CASE WHEN match_id % 2 = 0 THEN 'seen' END AS notes FROM plog")
def _(spark, sf):
    log = views.prediction_log(spark, sf)
    reviews = log.where("match_id % 2 = 0").select("match_key", F.lit(" seen ").alias("process3_notes"))
    done = predlog.apply_reviews(log, reviews)
    return done.select("match_key", predlog.step_flags()["p3"].alias("p3"), F.col("process3_notes").alias("notes"))


@query("b29_step_flags", "SELECT match_key, p1, p2, p3 FROM glog")
def _(spark, sf):
    return views.prediction_log(spark, sf).withColumns(predlog.step_flags()).select("match_key", "p1", "p2", "p3")


@query(
    "d23_headline_stats",
    f"""SELECT n_logged, n_with_actual, n_process1, n_process2, n_process3, winner_hits, winner_total, potm_hits, potm_total, innings_mae_n, {r('innings_mae')} FROM (SELECT count(*) AS n_logged, count(CASE WHEN actual_winner <> '' THEN 1 END) AS n_with_actual,
    count(CASE WHEN p1 THEN 1 END) AS n_process1, count(CASE WHEN p2 THEN 1 END) AS n_process2, count(CASE WHEN p3 THEN 1 END) AS n_process3,
    count(CASE WHEN actual_winner <> '' AND winner_correct = 'true' THEN 1 END) AS winner_hits, count(CASE WHEN actual_winner <> '' AND winner_correct IN ('true', 'false') THEN 1 END) AS winner_total,
    count(CASE WHEN actual_winner <> '' AND potm_correct = 'true' THEN 1 END) AS potm_hits, count(CASE WHEN actual_winner <> '' AND potm_correct IN ('true', 'false') THEN 1 END) AS potm_total,
    avg(innings_mae) AS innings_mae, count(innings_mae) AS innings_mae_n FROM glog) x""",
)
def _(spark, sf):
    return rounded(predlog.headline_stats(views.graded_log(spark, sf)))


@query(
    "d24_outcome_counts",
    """SELECT what, state, count(*) AS n FROM (SELECT 'winner' AS what, CASE WHEN actual_winner <> '' AND winner_correct = 'true' THEN 'correct' WHEN actual_winner <> '' AND winner_correct = 'false' THEN 'wrong' ELSE 'pending' END AS state FROM glog
    UNION ALL SELECT 'potm', CASE WHEN actual_winner <> '' AND potm_correct = 'true' THEN 'correct' WHEN actual_winner <> '' AND potm_correct = 'false' THEN 'wrong' ELSE 'pending' END FROM glog) x GROUP BY what, state""",
)
def _(spark, sf):
    return predlog.outcome_counts(views.graded_log(spark, sf))


_SLUG = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-')"


@query(
    "d24_h06_pick_matches",
    f"""SELECT count(CASE WHEN {_SLUG.format('pred_best_bat')} = {_SLUG.format('actual_top_scorer')} THEN 1 END) AS top_bat_match, count(*) AS top_bat_total,
    count(CASE WHEN actual_top_wicket_bowler <> '' AND {_SLUG.format('pred_best_bowl')} = {_SLUG.format('actual_top_wicket_bowler')} THEN 1 END) AS top_bowl_match, count(CASE WHEN actual_top_wicket_bowler <> '' THEN 1 END) AS top_bowl_total
    FROM glog WHERE actual_winner <> ''""",
)
def _(spark, sf):
    return predlog.pick_matches(views.graded_log(spark, sf))


@query(
    "d25_coarse_calibration",
    """SELECT b.bin, coalesce(n, 0) AS n, coalesce(graded, 0) AS graded, coalesce(correct, 0) AS correct, round(100.0 * correct / nullif(graded, 0), 1) AS rate FROM (SELECT CAST(unnest(range(4)) AS INTEGER) AS bin) b LEFT JOIN (
    SELECT CAST(least(floor(pred_p_team1_win * 4), 3) AS INTEGER) AS bin, count(*) AS n, count(CASE WHEN winner_correct IN ('true', 'false') THEN 1 END) AS graded, count(CASE WHEN winner_correct = 'true' THEN 1 END) AS correct
    FROM glog WHERE actual_winner <> '' GROUP BY 1) q ON q.bin = b.bin""",
)
def _(spark, sf):
    return predlog.coarse_calibration(views.graded_log(spark, sf))


@query("d28_innings_errors", f"SELECT match_key, {r('delta1', 'delta2', 'innings_mae')} FROM glog")
def _(spark, sf):
    return rounded(predlog.innings_errors(views.graded_log(spark, sf)).select("match_key", "delta1", "delta2", "innings_mae"))


@query("h17_json_cells", "SELECT match_key, pf, ps, CAST(CASE WHEN match_id % 8 = 0 THEN 0 ELSE 2 END AS INTEGER) AS names FROM plog")
def _(spark, sf):
    log = views.prediction_log(spark, sf)
    totals = predlog.predicted_innings(F.col("pred_extra_json"))
    cell = F.when(F.col("match_id") % 8 == 0, "[broken").otherwise('["a ", "", "b"]')
    return log.select(
        "match_key", totals["pred_first_innings_team_runs"].alias("pf"), totals["pred_second_innings_team_runs"].alias("ps"), F.size(predlog.name_list(cell)).alias("names")
    )


@query(
    "h19_grade_labels",
    f"""SELECT match_key, CASE WHEN actual_winner = '' THEN 'waiting' WHEN winner_correct = 'true' THEN 'right' WHEN winner_correct = 'false' THEN 'wrong' ELSE 'unknown' END AS winner_grade,
    CASE WHEN actual_winner = '' OR actual_top_wicket_bowler = '' THEN 'waiting' WHEN {_SLUG.format('pred_best_bowl')} = {_SLUG.format('actual_top_wicket_bowler')} THEN 'right' ELSE 'wrong' END AS best_bowl_grade,
    CASE WHEN actual_winner = '' THEN 'waiting' WHEN match_id % 4 = 0 THEN 'na' WHEN match_id % 4 = 1 THEN 'right' ELSE 'wrong' END AS top3_grade FROM glog""",
)
def _(spark, sf):
    log = views.graded_log(spark, sf)
    actual = predlog.has_text("actual_winner")
    listed = F.when(F.col("match_id") % 4 == 1, F.array(F.lit(" A"), F.lit("b"), F.lit("C"))).otherwise(F.array(F.lit("c"), F.lit("b"), F.lit("a")))
    from creaseline.functions.text import tri_state

    return log.select(
        "match_key",
        predlog.grade_label(tri_state(F.col("winner_correct")), actual).alias("winner_grade"),
        predlog.pick_grade(F.col("pred_best_bowl"), F.col("actual_top_wicket_bowler"), actual).alias("best_bowl_grade"),
        predlog.ordered_grade(F.col("pred_top3_bowls"), listed, actual, F.col("match_id") % 4 != 0).alias("top3_grade"),
    )


@query(
    "c28_predicted_vs_actual",
    f"""WITH tb AS (SELECT match_id, string_agg(batter, ',' ORDER BY k) AS actual_top5 FROM (SELECT match_id, batter, row_number() OVER (PARTITION BY match_id ORDER BY sum(runs_off_bat) DESC, batter) AS k FROM deliveries GROUP BY match_id, batter) x WHERE k <= 5 GROUP BY match_id),
    tw AS (SELECT match_id, string_agg(bowler, ',' ORDER BY k) AS actual_top3, min(CASE WHEN k = 1 THEN bowler END) AS bw FROM (SELECT match_id, bowler, row_number() OVER (PARTITION BY match_id ORDER BY count(*) DESC, bowler) AS k FROM deliveries WHERE dismissal_kind <> '' GROUP BY match_id, bowler) x WHERE k <= 3 GROUP BY match_id)
    SELECT match_key, actual_top5, actual_top3, CASE WHEN actual_winner = '' THEN 'waiting' WHEN bw IS NULL THEN 'waiting' WHEN {_SLUG.format('pred_best_bowl')} = {_SLUG.format('bw')} THEN 'right' ELSE 'wrong' END AS best_bowl_grade, {r('innings_mae')}
    FROM (SELECT g.* EXCLUDE (innings_mae), actual_top5, actual_top3, bw, (abs(coalesce(ar1, i1) - pf) + abs(coalesce(ar2, i2) - ps)) / 2.0 AS innings_mae FROM glog g LEFT JOIN tb ON tb.match_id = g.match_id LEFT JOIN tw ON tw.match_id = g.match_id
    LEFT JOIN (SELECT match_id, sum(CASE WHEN innings = 1 THEN conceded END) AS i1, sum(CASE WHEN innings = 2 THEN conceded END) AS i2 FROM ind GROUP BY match_id) t ON t.match_id = g.match_id) q""",
)
def _(spark, sf):
    key = F.concat(F.lit("m"), F.col("match_id").cast("string"))
    d = views.deliveries(spark, sf)
    rows = predlog.compare_with_actuals(
        views.graded_log(spark, sf),
        stats.top_scorers_per_match(d).withColumn("match_key", key),
        stats.top_wicket_takers_per_match(d).withColumn("match_key", key),
        stats.innings_totals(d).withColumn("match_key", key),
    )
    return rounded(
        rows.select(
            "match_key", F.array_join("actual_top5", ",").alias("actual_top5"), F.array_join("actual_top3", ",").alias("actual_top3"), "best_bowl_grade", "innings_mae"
        )
    )


@query("f07_latest_entries", "SELECT match_key, match_date FROM plog ORDER BY match_date DESC NULLS LAST, (match_id % 23 <> 0) DESC, match_key DESC LIMIT 8")
def _(spark, sf):
    return predlog.latest_entries(views.prediction_log(spark, sf)).select("match_key", "match_date")


@query(
    "f07_match_options",
    "SELECT match_key AS value, CASE WHEN match_date IS NULL THEN '' ELSE concat(strftime(match_date, '%Y-%m-%d'), ' · ') END || concat(team1_name, ' vs ', team2_name) AS label FROM plog WHERE team1_name IS NOT NULL",
)
def _(spark, sf):
    log = views.prediction_log(spark, sf).where(F.col("team1_name").isNotNull())
    return predlog.match_options(log.unionByName(log.withColumn("match_date", F.lit(None).cast("date"))))


@query(
    "f10_timeline",
    """SELECT match_key, match_date, match_key AS label, round(pred_p_team1_win * 100, 1) AS p_team1_pct, CASE WHEN actual_winner <> '' AND winner_correct = 'true' THEN 'hit' WHEN actual_winner <> '' AND winner_correct = 'false' THEN 'miss' ELSE 'pending' END AS outcome
    FROM glog WHERE match_date IS NOT NULL ORDER BY match_date DESC, match_key DESC LIMIT 20""",
)
def _(spark, sf):
    return predlog.timeline(views.graded_log(spark, sf))


def _scored(spark, sf):
    rows = views.match_rows(spark, sf).where(F.col("winner").isin("team1", "team2"))
    return rows.select(
        "match_id", "winner_source", (F.col("winner") == "team1").cast("int").alias("y"), F.expr("(match_id * 37 % 101) / 100D").alias("p")
    )


@query(
    "d26_reliability_table",
    f"SELECT b.bin, coalesce(n, 0) AS n, {r('mean_p', 'empirical_rate')} FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) b LEFT JOIN (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS empirical_rate FROM scored GROUP BY 1) q ON q.bin = b.bin",
)
def _(spark, sf):
    return rounded(evaluation.reliability_table(_scored(spark, sf), "y", "p"))


_METRIC = """count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))) AS log_loss, avg(((p >= 0.5)::INT = y)::INT) AS accuracy"""


@query("d27_probability_metrics", f"SELECT n, {r('brier', 'log_loss', 'accuracy', digits=5)} FROM (SELECT {_METRIC} FROM scored) x")
def _(spark, sf):
    return rounded(evaluation.probability_metrics(_scored(spark, sf), "y", "p"), 5)


@query("d27_metrics_by_source", f"SELECT winner_source, n, {r('brier', 'log_loss', 'accuracy', digits=5)} FROM (SELECT winner_source, {_METRIC} FROM scored GROUP BY winner_source HAVING count(*) >= 5) x")
def _(spark, sf):
    return rounded(evaluation.probability_metrics(_scored(spark, sf), "y", "p", by="winner_source", minimum=5), 5)


@query(
    "i11_ranking_auc",
    f"""SELECT {r('auc')} FROM (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*) AS auc FROM scored a, scored b WHERE a.y = 1 AND b.y = 0) x""",
)
def _(spark, sf):
    return rounded(evaluation.ranking_auc(_scored(spark, sf), "y", "p"))


@query(
    "i11_regression_metrics",
    f"SELECT n, {r('mae', 'r2')} FROM (SELECT count(*) AS n, avg(abs(ar1 - pf)) AS mae, 1 - sum((ar1 - pf) * (ar1 - pf)) / (var_pop(ar1) * count(*)) AS r2 FROM glog WHERE ar1 IS NOT NULL AND pf IS NOT NULL) x",
)
def _(spark, sf):
    return rounded(evaluation.regression_metrics(views.graded_log(spark, sf), "actual_first_innings_team_runs", "pred_first_innings_team_runs"))


_CARD = ("runs", "balls", "fours", "sixes", "dismissed", "wickets", "balls_bowled", "runs_conceded")


@query(
    "a11_scorecard_player_rows",
    "SELECT player AS player_id, team AS batting_team, 'unknown' AS bowling_team, DATE '2026-02-15' AS date, 'ICC T20 WC 2026' AS venue, 'batter' AS role, CAST(r AS DOUBLE) AS runs, CAST(b AS DOUBLE) AS balls, CAST(f4 AS DOUBLE) AS fours, CAST(f6 AS DOUBLE) AS sixes, CASE WHEN dismissal = 'not out' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS dismissed FROM cards",
)
def _(spark, sf):
    ids = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ids/{uuid.uuid4().hex}"
    rows = cards.scorecard_player_rows(views.scorecards(spark, sf), views.scorecard_aliases(spark, sf), ids)
    return rows.select("player_id", "batting_team", "bowling_team", "date", "venue", "role", "runs", "balls", "fours", "sixes", "dismissed")


@query(
    "a12_scorecard_deliveries",
    """SELECT match_id, batting_team, bowling_team, count(*) AS balls, sum(runs_off_bat) AS runs, count(DISTINCT batter) AS batters, count(CASE WHEN dismissal_kind <> '' THEN 1 END) AS outs, count(CASE WHEN dismissal_kind = 'run out' THEN 1 END) AS run_outs, max(bowler) AS last_bowler, max(runs_off_bat) AS most FROM (
    SELECT 900000000 + c.match_id AS match_id, c.team AS batting_team, CASE WHEN c.team = s.home_team THEN s.away_team ELSE s.home_team END AS bowling_team, c.player AS batter, c.bowler_name AS bowler,
    CAST(r // b + CASE WHEN i < r % b THEN 1 ELSE 0 END AS DOUBLE) AS runs_off_bat, CASE WHEN i < b - 1 OR dismissal = 'not out' THEN '' WHEN dismissal LIKE 'run out%' THEN 'run out' ELSE 'caught' END AS dismissal_kind
    FROM cards c JOIN (SELECT match_no, home_team, CASE WHEN match_no % 9 = 0 THEN 'Nobody' ELSE away_team END AS away_team FROM schedule) s ON s.match_no = c.match_id AND c.match_id % 10 <> 5, LATERAL (SELECT unnest(range(0, c.b)) AS i) n
    WHERE c.b > 0 AND c.team IN (s.home_team, s.away_team)) x GROUP BY match_id, batting_team, bowling_team""",
)
def _(spark, sf):
    loaded = views.fixture_schedule(spark, sf).where("match_no % 10 = 5").select((F.col("match_no") + 900000000).alias("match_id"))
    clean = views.scorecards(spark, sf).withColumn("player", F.replace(F.trim("player"), F.lit(" "), F.lit("_")))
    balls = cards.scorecard_deliveries(clean, views.scorecard_matches(spark, sf), loaded)
    return balls.groupBy("match_id", "batting_team", "bowling_team").agg(
        F.count(F.lit(1)).alias("balls"), F.sum("runs_off_bat").alias("runs"), F.count_distinct("batter").alias("batters"),
        F.count_if(F.col("dismissal_kind") != "").alias("outs"), F.count_if(F.col("dismissal_kind") == "run out").alias("run_outs"),
        F.max("bowler").alias("last_bowler"), F.max("runs_off_bat").alias("most"),
    )
