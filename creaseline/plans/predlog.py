"""Prediction log: upserts, grading and the dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.functions.cricket import is_no_result
from creaseline.functions.text import blank_if_null, clean_text, ordered_slugs_equal, slug, squeeze, tri_state
from creaseline.operators.windows import keep_one

# Columns of the prediction log.
LOG_COLUMNS = (
    "match_key", "match_date", "venue", "team1_name", "team2_name", "team1_bats_first", "pred_winner",
    "pred_p_team1_win", "pred_best_bat", "pred_best_bowl", "pred_top5_bats", "pred_top3_bowls", "pred_potm",
    "pred_extra_json", "actual_winner", "actual_top_scorer", "actual_top_scorer_runs",
    "actual_top_wicket_bowler", "actual_top_wickets", "official_potm", "bbb_match_file", "post_notes",
    "actual_first_innings_team_runs", "actual_second_innings_team_runs", "winner_correct", "potm_correct",
    "logged_at_pre", "logged_at_post", "process3_completed_at", "process3_notes",
)
RESULT_FIELDS = (
    "actual_winner", "actual_top_scorer", "actual_top_scorer_runs", "actual_top_wicket_bowler",
    "actual_top_wickets", "official_potm", "bbb_match_file", "post_notes", "actual_first_innings_team_runs",
    "actual_second_innings_team_runs",
)
COARSE_BINS = ((0.0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1.01))


def upsert_predictions(log: DataFrame, new: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new log, rejected rows): an existing key is kept unless ``force``, which replaces it.

    Among several new rows of one key the latest ``logged_at_pre`` is taken.
    """
    fresh = keep_one(new, ["match_key"], [F.col("logged_at_pre").desc_nulls_last()])
    if force:
        kept = log.join(fresh.select("match_key"), "match_key", "left_anti")
        return kept.unionByName(fresh, allowMissingColumns=True), fresh.limit(0)
    known = log.select("match_key").distinct()
    added = fresh.join(known, "match_key", "left_anti")
    rejected = fresh.join(known, "match_key", "left_semi")
    return log.unionByName(added, allowMissingColumns=True), rejected


def graded(pred: Column, actual: Column) -> Column:
    """Equality after case and space folding; null when either side is blank."""
    p, a = squeeze(F.coalesce(pred, F.lit(""))), squeeze(F.coalesce(actual, F.lit("")))
    return F.when((p != "") & (a != ""), p == a)


def winner_grade(pred: Column, actual: Column, skip_ties: bool = False) -> Column:
    """true / false / skipped_no_result as text; null without an actual winner.

    A logged tie grades as wrong unless ``skip_ties``.
    """
    skip = is_no_result(F.coalesce(actual, F.lit("")))
    if skip_ties:
        skip = skip | (squeeze(F.coalesce(actual, F.lit(""))) == "tie")
    return F.when(skip, "skipped_no_result").otherwise(graded(pred, actual).cast("string"))


def apply_results(
    log: DataFrame, results: DataFrame, innings: DataFrame | None = None, logged_at: Column | None = None,
    skip_ties: bool = False,
) -> DataFrame:
    """Field-wise update of logged matches: only supplied fields change, blank totals come from deliveries."""
    fields = [f for f in RESULT_FIELDS if f in results.columns]
    update = keep_one(results, ["match_key"], [F.asc(f) for f in fields]).select(
        "match_key", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_r_{f}") for f in fields]
    )
    rows = log.join(update, "match_key", "left")
    rows = rows.withColumns({f: F.coalesce(F.col(f"_r_{f}"), F.col(f)) for f in fields})
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    if innings is not None:
        totals = innings.select("match_key", F.col("innings1_runs").alias("_i1"), F.col("innings2_runs").alias("_i2"))
        rows = rows.join(totals, "match_key", "left").withColumns(
            {
                c: F.coalesce(F.col(c), F.when(hit, F.col(i)))
                for c, i in (("actual_first_innings_team_runs", "_i1"), ("actual_second_innings_team_runs", "_i2"))
            }
        ).drop("_i1", "_i2")
    potm = graded(F.col("pred_potm"), F.col("official_potm")).cast("string")
    return rows.withColumns(
        {
            "winner_correct": F.when(
                hit & clean_text("actual_winner").isNotNull(),
                winner_grade(F.col("pred_winner"), F.col("actual_winner"), skip_ties),
            ).otherwise(F.col("winner_correct")),
            "potm_correct": F.when(hit & clean_text("official_potm").isNotNull(), potm).otherwise(F.col("potm_correct")),
            "logged_at_post": F.when(hit, logged_at if logged_at is not None else F.current_timestamp()).otherwise(
                F.col("logged_at_post")
            ),
        }
    ).drop("_hit", *[f"_r_{f}" for f in fields])


def apply_reviews(log: DataFrame, reviews: DataFrame, completed_at: Column | None = None) -> DataFrame:
    update = keep_one(reviews, ["match_key"], [F.asc("process3_notes")]).select(
        "match_key", F.lit(True).alias("_hit"), F.trim("process3_notes").alias("_notes")
    )
    stamp = completed_at if completed_at is not None else F.current_timestamp()
    return (
        log.join(update, "match_key", "left")
        .withColumns(
            {
                "process3_notes": F.coalesce("_notes", "process3_notes"),
                "process3_completed_at": F.when(F.col("_hit"), stamp).otherwise(F.col("process3_completed_at")),
            }
        )
        .drop("_hit", "_notes")
    )


def has_text(column: str) -> Column:
    return clean_text(F.col(column).cast("string")).isNotNull()


def step_flags() -> dict[str, Column]:
    """p1 predicted, p2 result logged with a winner, p3 reviewed."""
    return {
        "p1": has_text("logged_at_pre"),
        "p2": has_text("logged_at_post") & has_text("actual_winner"),
        "p3": has_text("process3_completed_at"),
    }


def innings_errors(log: DataFrame) -> DataFrame:
    """Signed innings deltas (actual minus predicted) and their mean absolute error."""
    d1 = F.col("actual_first_innings_team_runs") - F.col("pred_first_innings_team_runs")
    d2 = F.col("actual_second_innings_team_runs") - F.col("pred_second_innings_team_runs")
    return log.withColumns({"delta1": d1, "delta2": d2, "innings_mae": (F.abs(d1) + F.abs(d2)) / 2.0})


def predicted_innings(extra_json: Column) -> dict[str, Column]:
    """Predicted innings totals out of the extras cell; null when the cell does not parse."""
    extra = F.from_json(extra_json, "map<string,string>", {"mode": "PERMISSIVE"})
    return {
        c: F.try_element_at(extra, F.lit(c)).try_cast("double")
        for c in ("pred_first_innings_team_runs", "pred_second_innings_team_runs")
    }


def name_list(cell: Column) -> Column:
    """Names of a JSON array cell; empty when the cell is blank or broken."""
    parsed = F.from_json(cell, "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def headline_stats(log: DataFrame) -> DataFrame:
    """One row of counts, hits over graded rows and mean innings error."""
    rows = innings_errors(log.withColumns({**step_flags(), "_w": tri_state(F.col("winner_correct")), "_p": tri_state(F.col("potm_correct"))}))
    rows = rows.withColumn("_actual", has_text("actual_winner"))

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0))

    return rows.agg(
        F.count(F.lit(1)).alias("n_logged"),
        count(F.col("_actual")).alias("n_with_actual"),
        count(F.col("p1")).alias("n_process1"),
        count(F.col("p2")).alias("n_process2"),
        count(F.col("p3")).alias("n_process3"),
        count(F.col("_actual") & F.col("_w")).alias("winner_hits"),
        count(F.col("_actual") & F.col("_w").isNotNull()).alias("winner_total"),
        count(F.col("_actual") & F.col("_p")).alias("potm_hits"),
        count(F.col("_actual") & F.col("_p").isNotNull()).alias("potm_total"),
        F.avg("innings_mae").alias("innings_mae"),
        F.count("innings_mae").alias("innings_mae_n"),
    )


def grade_state(correct: Column, has_actual: Column) -> Column:
    state = F.when(correct, "correct").when(~correct, "wrong").otherwise("pending")
    return F.when(has_actual, state).otherwise("pending")


def outcome_counts(log: DataFrame) -> DataFrame:
    """Correct / wrong / pending counts of winner and player of the match."""
    actual = has_text("actual_winner")
    states = F.inline(
        F.array(
            *[
                F.struct(F.lit(k).alias("what"), grade_state(tri_state(F.col(c)), actual).alias("state"))
                for k, c in (("winner", "winner_correct"), ("potm", "potm_correct"))
            ]
        )
    )
    return log.select(states).groupBy("what", "state").agg(F.count(F.lit(1)).alias("n"))


def pick_matches(log: DataFrame) -> DataFrame:
    """How often the best bat and best bowl pick equals the actual one, by slug."""

    def both(p: str, a: str) -> Column:
        return has_text("actual_winner") & has_text(p) & has_text(a)

    def equal(p: str, a: str) -> Column:
        return both(p, a) & (slug(p) == slug(a))

    def count(c: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0))

    bat, bowl = ("pred_best_bat", "actual_top_scorer"), ("pred_best_bowl", "actual_top_wicket_bowler")
    return log.agg(
        count(equal(*bat)).alias("top_bat_match"),
        count(both(*bat)).alias("top_bat_total"),
        count(equal(*bowl)).alias("top_bowl_match"),
        count(both(*bowl)).alias("top_bowl_total"),
    )


def coarse_calibration(log: DataFrame) -> DataFrame:
    """Rows with a result, graded rows and hits per probability quarter."""
    p, correct = F.col("pred_p_team1_win"), tri_state(F.col("winner_correct"))
    place = F.lit(None).cast("int")
    for i, (low, high) in enumerate(COARSE_BINS):
        place = F.when((p >= low) & (p < high), i).otherwise(place)
    binned = log.where(has_text("actual_winner")).select(place.alias("bin"), correct.alias("_c")).where(F.col("bin").isNotNull())
    found = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_c").alias("graded"),
        F.sum(F.coalesce(F.col("_c"), F.lit(False)).cast("long")).alias("correct"),
    )
    every = log.sparkSession.range(len(COARSE_BINS)).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(found, "bin", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n", "graded", "correct")})
    return filled.withColumn("rate", F.round(F.try_divide(F.col("correct") * 100.0, F.col("graded")), 1))


DISPLAY_ORDER = ("match_date", "logged_at_pre", "match_key")


def display_order() -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in DISPLAY_ORDER]


def latest_entries(log: DataFrame, n: int = 8) -> DataFrame:
    """Newest rows by match date, log time and key."""
    return log.orderBy(*display_order()).limit(n)


def match_options(log: DataFrame) -> DataFrame:
    """One (value, label) row per key, taken from its newest entry."""
    newest = keep_one(log.where(has_text("match_key")), ["match_key"], display_order())
    t1, t2, key = blank_if_null("team1_name"), blank_if_null("team2_name"), F.col("match_key")
    tail = F.when((t1 != "") & (t2 != ""), F.concat(t1, F.lit(" vs "), t2)).otherwise(key)
    day = F.date_format(F.col("match_date"), "yyyy-MM-dd")
    label = F.when(day.isNotNull(), F.concat(day, F.lit(" · "), tail)).otherwise(tail)
    return newest.select(key.alias("value"), label.alias("label"))


def timeline(log: DataFrame, n: int = 20) -> DataFrame:
    """Latest ``n`` dated matches in date order with probability percent and outcome."""
    recent = log.where(F.col("match_date").isNotNull()).orderBy(F.desc("match_date"), F.desc("match_key")).limit(n)
    correct = F.when(has_text("actual_winner"), tri_state(F.col("winner_correct")))
    p = F.greatest(F.least(F.coalesce("pred_p_team1_win", F.lit(0.5)), F.lit(1.0)), F.lit(0.0))
    return recent.select(
        "match_key",
        "match_date",
        F.substring("match_key", 1, 22).alias("label"),
        F.round(p * 100, 1).alias("p_team1_pct"),
        F.when(correct, "hit").when(~correct, "miss").otherwise("pending").alias("outcome"),
    ).orderBy("match_date", "match_key")


def grade_label(correct: Column, has_actual: Column) -> Column:
    return F.when(~has_actual, "waiting").when(correct, "right").when(~correct, "wrong").otherwise("unknown")


def ordered_grade(pred: Column, actual: Column, has_actual: Column, comparable: Column) -> Column:
    """Grade of an ordered list: waiting, na when it cannot be compared, else right or wrong."""
    return (
        F.when(~has_actual, "waiting")
        .when(~comparable, "na")
        .when(F.coalesce(ordered_slugs_equal(pred, actual), F.lit(False)), "right")
        .otherwise("wrong")
    )


def pick_grade(pred: Column, actual: Column, has_actual: Column) -> Column:
    known = has_actual & (F.trim(F.coalesce(pred, F.lit(""))) != "") & (F.trim(F.coalesce(actual, F.lit(""))) != "")
    return F.when(~known, "waiting").when(slug(pred) == slug(actual), "right").otherwise("wrong")


def compare_with_actuals(log: DataFrame, top_batters: DataFrame, top_bowlers: DataFrame, innings: DataFrame) -> DataFrame:
    """Log rows beside the actual top five, top three and innings totals of their match, all graded.

    The leaderboards hold at most five and three rows per match, so gathering them is bounded.
    """

    def ordered(rows: DataFrame, player: str, out: str) -> DataFrame:
        packed = F.sort_array(F.collect_list(F.struct("place", player)))
        return rows.groupBy("match_key").agg(F.transform(packed, lambda x: x[player]).alias(out))

    rows = (
        log.join(ordered(top_batters, "batter", "actual_top5"), "match_key", "left")
        .join(ordered(top_bowlers, "bowler", "actual_top3"), "match_key", "left")
        .join(innings.select("match_key", "innings1_runs", "innings2_runs"), "match_key", "left")
    )
    actual = has_text("actual_winner")
    rows = rows.withColumns(
        {
            "actual_first_innings_team_runs": F.coalesce("actual_first_innings_team_runs", "innings1_runs"),
            "actual_second_innings_team_runs": F.coalesce("actual_second_innings_team_runs", "innings2_runs"),
            "winner_grade": grade_label(tri_state(F.col("winner_correct")), actual),
            "potm_grade": grade_label(tri_state(F.col("potm_correct")), actual),
            "top5_grade": ordered_grade(F.col("pred_top5_bats"), F.col("actual_top5"), actual, F.size("actual_top5") >= 5),
            "top3_grade": ordered_grade(F.col("pred_top3_bowls"), F.col("actual_top3"), actual, F.size("actual_top3") >= 3),
            "best_bat_grade": pick_grade(F.col("pred_best_bat"), F.get("actual_top5", F.lit(0)), actual),
            "best_bowl_grade": pick_grade(F.col("pred_best_bowl"), F.get("actual_top3", F.lit(0)), actual),
        }
    )
    return innings_errors(rows)
