"""Cricket-shaped views over the given tables, used as inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creaseline.plans import features, form, matches, profiles, stats
from creaseline.session import set_sizes, stage_table

ROSTER = 15

_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Stage tables are written once per application and input folder, then read by later queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = stage_table(build(), name)
    return _STAGED[key]


def forget_staged() -> None:
    """Start over, so that a timing includes writing the stage tables."""
    _STAGED.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    set_sizes(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries read from order lines: 25 orders make a match, an order line is a ball."""
    lines = table(spark, sf_dir, "lineitem")
    key, m = "l_orderkey", "match_id"
    staged = lines.selectExpr(
        "*", f"{key} div 25 AS {m}", f"CAST(1 + {key} % 2 AS INT) AS innings",
        f"CAST(({key} % 25) * 4 div 5 AS INT) AS over", "l_linenumber AS ball_in_over",
        "CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 1 ELSE 0 END AS is_wide",
        "CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN 1 ELSE 0 END AS is_noball",
        "l_discount < 0.005 AND l_linestatus = 'F' AS out",
    ).selectExpr(
        "*",
        f"make_date(CAST(1995 + ({m} div 84) % 30 AS INT), CAST(1 + ({m} div 7) % 12 AS INT), CAST(1 + {m} * 4 % 28 AS INT)) AS date",
        f"concat('V', {m} % 7) AS venue", f"CASE WHEN {m} % 5 = 0 THEN 'OTHER' ELSE 'IPL' END AS competition",
        f"concat('T', {m} % 10) AS t1", f"concat('T', ({m} % 10 + 1 + ({m} div 10) % 9) % 10) AS t2",
    )
    teams = staged.selectExpr(
        "*", "CASE WHEN innings = 1 THEN t1 ELSE t2 END AS batting_team",
        "CASE WHEN innings = 1 THEN t2 ELSE t1 END AS bowling_team",
    )
    batter = f"concat(batting_team, '_', l_suppkey % {ROSTER})"
    return teams.selectExpr(
        m, "date", "venue", "competition", "batting_team", "bowling_team", f"{batter} AS batter",
        f"concat(bowling_team, '_', l_partkey % {ROSTER}) AS bowler",
        f"concat(batting_team, '_', (l_suppkey + 1) % {ROSTER}) AS non_striker",
        "CAST(CAST(l_quantity AS BIGINT) % 7 AS DOUBLE) AS runs_off_bat",
        "CASE WHEN is_wide = 1 OR is_noball = 1 OR (l_linenumber = 5 AND l_returnflag = 'N') THEN 1D ELSE 0D END AS extras",
        "is_wide", "is_noball",
        "CASE WHEN out THEN element_at(array('caught', 'bowled', 'run out', 'lbw'), CAST(round(l_tax * 100) AS INT) % 4 + 1) ELSE '' END AS dismissal_kind",
        f"CASE WHEN out THEN {batter} ELSE '' END AS player_dismissed",
        "innings", "over", "ball_in_over",
    )


def player_match_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.player_match_stats(deliveries(spark, sf_dir))


def player_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "player_match", lambda: player_match_plan(spark, sf_dir))


def franchises(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = player_match(spark, sf_dir).select(F.col("batting_team").alias("team"))
    return teams.where(~F.col("team").isin("T8", "T9", "unknown")).distinct()


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_franchise_flag(
        features.with_team_and_rates(player_match(spark, sf_dir)), franchises(spark, sf_dir)
    )


def player_features_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.player_features(
        player_match(spark, sf_dir), deliveries(spark, sf_dir), franchises(spark, sf_dir)
    )


def player_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "player_features", lambda: player_features_plan(spark, sf_dir))


def official_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official winners: the higher innings total, blank for every eleventh match, absent for every third."""
    total = F.col("runs_off_bat") + F.col("extras")
    by_match = deliveries(spark, sf_dir).groupBy("match_id").agg(
        F.min(F.when(F.col("innings") == 1, F.col("batting_team"))).alias("tm1"),
        F.min(F.when(F.col("innings") == 2, F.col("batting_team"))).alias("tm2"),
        F.coalesce(F.sum(F.when(F.col("innings") == 1, total)), F.lit(0.0)).alias("i1"),
        F.coalesce(F.sum(F.when(F.col("innings") == 2, total)), F.lit(0.0)).alias("i2"),
    )
    winner = (
        F.when(F.col("match_id") % 11 == 0, "").when(F.col("i1") >= F.col("i2"), F.col("tm1")).otherwise(F.col("tm2"))
    )
    return by_match.where(F.col("match_id") % 3 != 0).select("match_id", winner.alias("winner"))


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "profiles", lambda: profiles.franchise_profiles(deliveries(spark, sf_dir)))


def match_rows_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.match_rows(
        player_features(spark, sf_dir),
        player_match(spark, sf_dir),
        official_results(spark, sf_dir),
        profile_table(spark, sf_dir),
    )


def match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "match_rows", lambda: match_rows_plan(spark, sf_dir))


def squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighteen squad names per team, the last three without any appearance; every third is overseas."""
    keys = table(spark, sf_dir, "customer").selectExpr(
        "concat('T', c_custkey % 10) AS team", "(c_custkey div 10) % 18 AS k"
    )
    named = keys.groupBy("team", "k").agg(F.lit(1).alias("one"))
    return named.select(
        "team",
        F.concat("team", F.lit("_"), F.col("k").cast("string")).alias("player_id"),
        F.when(F.col("k") % 3 == 0, 1).otherwise(0).alias("is_overseas"),
    )


def scored_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection table with scores spread a little by roster number, so that picks do not all tie."""
    rows = features.with_team_and_rates(player_match(spark, sf_dir))
    number = F.element_at(F.split("player_id", "_"), 2).cast("int")
    spread = F.col("selection_score") - F.lit(0.001) * ((number * 7) % 15)
    return form.selection_table(rows).withColumn("selection_score", spread)


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy text cells, as a badly typed file would hold them."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_linenumber AS line", "l_returnflag AS kind",
        """CASE l_linenumber % 4 WHEN 0 THEN 'abc' WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS STRING) WHEN 2 THEN '' END AS num_text""",
        """CASE l_linenumber WHEN 1 THEN ' nan ' WHEN 2 THEN 'None' WHEN 3 THEN '<NA>' WHEN 4 THEN NULL ELSE concat('  ', l_returnflag, ' ') END AS label""",
        """CASE l_linenumber % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2.5' WHEN 3 THEN 'x' ELSE '' END AS flag_text""",
        """CASE l_linenumber % 3 WHEN 0 THEN '2024-01-32' WHEN 1 THEN '2024-02-10' ELSE 'n/a' END AS date_text""",
        """CASE l_linenumber % 4 WHEN 0 THEN ' True' WHEN 1 THEN 'no' WHEN 2 THEN 'YES' ELSE 'maybe' END AS bool_text""",
    )


def raw_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balls of a dialect with component extras and totals as text."""
    text = "CAST(CAST(l_quantity AS BIGINT) % 7 AS STRING)"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey div 25 AS match_id", "l_linenumber AS line",
        f"CASE WHEN l_linenumber % 2 = 0 THEN {text} END AS runs_off_bat",
        f"CASE WHEN l_linenumber % 3 = 0 THEN '1' END AS extras",
        "CASE WHEN l_linenumber = 1 THEN '1' END AS wides", "CASE WHEN l_linenumber = 2 THEN '1' END AS noballs",
        "CASE WHEN l_linenumber = 4 THEN '4' END AS byes", "CASE WHEN l_linenumber = 5 THEN '2' END AS legbyes",
        "CAST(NULL AS STRING) AS penalty", "CAST(CAST(l_quantity AS BIGINT) AS STRING) AS total_runs",
        "CASE WHEN l_linenumber = 6 THEN 'Wide ' WHEN l_linenumber = 7 THEN 'noball' END AS extras_type",
        "CASE WHEN l_linenumber = 3 THEN '1' END AS is_wide", "CASE WHEN l_linenumber = 5 THEN '2' END AS is_noball",
    )


FRANCHISE_SPELLINGS = (
    "'MI', 'Kings XI Punjab', ' punjab kings ', 'Royal Challengers Bengaluru', 'RCB', 'Some New Team', 'SRH', 'Gujarat Titans', 'LSG', 'kkr'"
)


def spelled_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match ids with two franchise spellings each."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS match_id",
        f"element_at(array({FRANCHISE_SPELLINGS}), CAST(o_orderkey % 10 + 1 AS INT)) AS a",
        f"element_at(array({FRANCHISE_SPELLINGS}), CAST(o_custkey % 10 + 1 AS INT)) AS b",
    )


CITIES = "'Bengaluru', 'Mumbai', 'Chennai', 'Delhi', 'Ahmedabad', 'New Chandigarh', 'Pune', ' Jaipur ', 'Lucknow', 'Guwahati'"


def fixture_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scheduled fixture per match: number, date, sides, city and stadium text."""
    by_match = deliveries(spark, sf_dir).groupBy("match_id").agg(
        F.min("date").alias("date"),
        F.min(F.when(F.col("innings") == 1, F.col("batting_team"))).alias("home_team"),
        F.min(F.when(F.col("innings") == 1, F.col("bowling_team"))).alias("away_team"),
    )
    return by_match.selectExpr(
        "match_id AS match_no", "date", "home_team", "away_team",
        f"element_at(array({CITIES}), CAST(match_id % 10 + 1 AS INT)) AS venue_city",
    )


FIRST_NAMES = "'Ravi', 'Virat', 'Rohit', 'Mitchell', 'Jos', 'Kane', 'Sam', 'Thomas'"
LAST_NAMES = "'Sharma', 'Kohli', 'Starc', 'Curran', 'Khan', 'Patel', 'Singh', 'Ali', 'Yadav'"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers read as players: team, full name, initial form, a misspelling and the spelling asked for."""
    named = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS k", "concat('T', c_custkey % 10) AS team",
        f"element_at(array({FIRST_NAMES}), CAST((c_custkey div 10) % 8 + 1 AS INT)) AS first",
        f"element_at(array({LAST_NAMES}), CAST((c_custkey div 80) % 9 + 1 AS INT)) AS last",
    )
    return named.selectExpr(
        "k", "team", "concat(first, ' ', last) AS full_name", "concat(substring(first, 1, 1), ' ', last) AS stats_id",
        "concat(first, ' ', last, last) AS long_name",
        """CASE k % 5 WHEN 0 THEN concat(first, ' ', last) WHEN 1 THEN concat(' ', upper(substring(first, 1, 1)), '. ', last)
           WHEN 2 THEN concat(first, 'e ', last) WHEN 3 THEN concat(substring(first, 1, 1), ' ', last) ELSE upper(concat(first, '  ', last)) END AS asked""",
    )


def named_squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squads by full name; two first names with one initial make a signature ambiguous."""
    p = people(spark, sf_dir).where("k % 7 <> 3")
    return p.groupBy("team", F.col("full_name").alias("player_id")).agg(
        F.max((F.col("k") % 3 == 0).cast("int")).alias("is_overseas")
    )


def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full names as aliases of the initial form, some also of a longer id at another priority."""
    p = people(spark, sf_dir).where("k % 4 <> 1")
    rows = p.selectExpr("stats_id AS canonical_id", "full_name AS alias_string", "'seed' AS source", "1 AS priority").unionByName(
        p.where("k % 8 = 2").selectExpr("concat(stats_id, ' jr') AS canonical_id", "full_name AS alias_string", "'seed' AS source", "5 AS priority")
    )
    return rows.distinct()


def registry_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).where("k % 3 = 0").selectExpr("stats_id AS canonical_id").unionByName(
        people(spark, sf_dir).where("k % 5 = 1").selectExpr("full_name AS canonical_id")
    ).distinct()


REPORTS = (
    "Eden Gardens belter. Last year 199 was the average score batting first. Expect more than 200 when chasing. Fours and sixes everywhere.",
    "Narendra Modi Stadium. Grass and tramlines for fast bowlers to aim at. Average score here 216, economy 10.2 for fast bowlers. High scoring run chase. It is a 200-run ground today.",
    "Flat deck, good for batting.",
    "Arun Jaitley Stadium Delhi. Very high scoring (250, runs galore). Small ground. Last season average first innings ~198 at this ground.",
    "Two-paced pitch with bare patches, turn and grip for the bowlers. Dew may help the chase.",
    "Green grass, seam movement early.",
    "",
)


def _sql_texts(texts) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in texts)


def scored_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fixture per match: sides, stadium, report, toss-free order, model totals and probability."""
    from creaseline.functions.franchise import stadium_of_city

    rows = fixture_schedule(spark, sf_dir).selectExpr(
        "match_no AS fixture_id", "date AS match_date", "home_team AS team1_name", "away_team AS team2_name", "venue_city",
        f"element_at(array({_sql_texts(REPORTS)}), CAST(match_no % 7 + 1 AS INT)) AS pitch_text",
        "CASE WHEN match_no % 6 <> 0 THEN CAST(90 + match_no * 7 % 120 AS DOUBLE) END AS ml1",
        "CASE WHEN match_no % 6 <> 0 THEN CAST(85 + match_no * 11 % 125 AS DOUBLE) END AS ml2",
        "CASE WHEN match_no % 9 <> 0 THEN (match_no * 37 % 101) / 100D END AS ml_p_team1",
    )
    return rows.withColumn("venue", stadium_of_city("venue_city")).drop("venue_city")


def fixture_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole roster of each side with raw predictions read off the players' pre-match form."""
    from pyspark.sql import Window

    from creaseline.functions.franchise import role_code

    stats_rows = player_match(spark, sf_dir).select("match_id", "player_id", "batting_team", "bowling_team", "role", "wickets")
    feats = player_features(spark, sf_dir).select("match_id", "player_id", "form_runs", "form_wickets", "form_runs_ipl", "form_wickets_ipl", "strike_rate", "economy")
    place = F.row_number().over(Window.partitionBy("match_id", "batting_team").orderBy("player_id"))
    rows = stats_rows.join(feats, ["match_id", "player_id"]).withColumn("xi_place", place)
    first = F.concat(F.lit("T"), (F.col("match_id") % 10).cast("string"))
    return rows.select(
        F.col("match_id").alias("fixture_id"), F.when(F.col("batting_team") == first, 1).otherwise(2).alias("side"), "player_id",
        F.col("batting_team").alias("team"), F.col("bowling_team").alias("opponent"), "xi_place", "role",
        role_code(F.col("role")).alias("role_encoded"), "form_runs", "form_wickets", "form_runs_ipl", "form_wickets_ipl", "strike_rate", "economy",
        (F.col("form_runs") * 0.8 + 5.0 + F.col("xi_place") * 0.37).alias("pred_runs_raw"),
        (F.col("form_wickets") * 0.9 + 0.2 + F.col("xi_place") * 0.013).alias("pred_wk_raw"),
        (F.col("form_runs") * 0.5 + F.col("xi_place")).alias("std_runs"), (F.col("form_wickets") * 0.5 + 0.1).alias("std_wickets"),
        ((F.col("xi_place") % 5 + 1) / 5.0).alias("playing_prob"), ((F.col("xi_place") % 10 + 1) / 10.0).alias("data_confidence"),
        F.when(F.col("xi_place") % 3 == 0, "spin").when(F.col("xi_place") % 3 == 1, "pace").otherwise("unknown").alias("bowling_style"),
    )


def priced_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures with pitch multipliers, venue harshness and franchise profiles."""
    from creaseline.functions.pitch import resolve_multipliers, venue_spin_harshness
    from creaseline.operators.distinct import on_distinct

    rows = scored_fixtures(spark, sf_dir)
    priced = on_distinct(
        rows, ["pitch_text", "venue"],
        {**resolve_multipliers(F.col("pitch_text"), F.col("venue")), "venue_spin_harshness": venue_spin_harshness(F.col("venue"))},
    )
    return profiles.with_profiles(priced, profile_table(spark, sf_dir))


def priced_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture players with the multipliers and harshness of their fixture."""
    from creaseline.functions.pitch import MULTIPLIERS

    fixtures = staged(spark, sf_dir, "priced_fixtures", lambda: priced_fixtures(spark, sf_dir))
    players = staged(spark, sf_dir, "fixture_players", lambda: fixture_players(spark, sf_dir))
    return players.join(fixtures.select("fixture_id", *MULTIPLIERS, "venue_spin_harshness"), "fixture_id")


def priced_fixture_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "priced_fixtures", lambda: priced_fixtures(spark, sf_dir))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged prediction per match with its result: blank, no result, tie or the higher innings total."""
    total = F.col("runs_off_bat") + F.col("extras")
    m = deliveries(spark, sf_dir).groupBy("match_id").agg(
        F.min("date").alias("match_date"), F.min("venue").alias("venue"),
        F.min(F.when(F.col("innings") == 1, F.col("batting_team"))).alias("team1_name"),
        F.min(F.when(F.col("innings") == 1, F.col("bowling_team"))).alias("team2_name"),
        F.coalesce(F.sum(F.when(F.col("innings") == 1, total)), F.lit(0.0)).alias("r1"),
        F.coalesce(F.sum(F.when(F.col("innings") == 2, total)), F.lit(0.0)).alias("r2"),
    )
    rows = m.selectExpr(
        "*", "concat('m', match_id) AS match_key", "(match_id * 37 % 101) / 100D AS pred_p_team1_win",
        """CASE WHEN match_id % 13 = 0 THEN '' WHEN match_id % 17 = 0 THEN 'No  Result' WHEN r1 = r2 THEN 'Tie' WHEN r1 > r2 THEN team1_name ELSE team2_name END AS actual_winner""",
    )
    return rows.selectExpr(
        "match_id", "match_key", "CASE WHEN match_id % 19 = 0 THEN NULL ELSE match_date END AS match_date", "venue", "team1_name", "team2_name", "true AS team1_bats_first",
        "CASE WHEN pred_p_team1_win >= 0.5 THEN team1_name ELSE lower(team2_name) END AS pred_winner", "pred_p_team1_win",
        "concat(team1_name, '_', match_id % 15) AS pred_best_bat", "concat(team2_name, '_', match_id % 15) AS pred_best_bowl",
        "array('a', 'b', 'c', 'd', 'e') AS pred_top5_bats", "array('a', 'b', 'c') AS pred_top3_bowls",
        "concat(team1_name, '_', match_id % 3) AS pred_potm",
        "CASE WHEN match_id % 8 = 0 THEN 'broken {' ELSE to_json(named_struct('sims', 100, 'pred_first_innings_team_runs', CAST(150 + match_id % 40 AS DOUBLE), 'pred_second_innings_team_runs', CAST(140 + match_id % 50 AS DOUBLE))) END AS pred_extra_json",
        "actual_winner", "CASE WHEN match_id % 4 = 0 THEN upper(concat(team1_name, ' ', match_id % 15)) ELSE concat(team2_name, '_1') END AS actual_top_scorer",
        "CASE WHEN match_id % 3 = 0 THEN concat(team2_name, '_', match_id % 15) ELSE '' END AS actual_top_wicket_bowler",
        "CASE WHEN match_id % 5 = 0 THEN '' ELSE concat(team1_name, '_', match_id % 4) END AS official_potm",
        "CASE WHEN match_id % 6 <> 0 THEN r1 END AS actual_first_innings_team_runs", "CASE WHEN match_id % 6 <> 1 THEN r2 END AS actual_second_innings_team_runs",
        "CASE WHEN match_id % 23 <> 0 THEN timestamp'2026-01-01 00:00:00' END AS logged_at_pre", "CASE WHEN match_id % 7 <> 0 THEN timestamp'2026-01-02 00:00:00' END AS logged_at_post",
        "CASE WHEN match_id % 9 = 0 THEN timestamp'2026-01-03 00:00:00' END AS process3_completed_at", "CAST(NULL AS STRING) AS process3_notes",
        "CAST(NULL AS STRING) AS winner_correct", "CAST(NULL AS STRING) AS potm_correct", "CAST(NULL AS STRING) AS post_notes",
    )


def graded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its results applied, predicted totals decoded from the extras cell."""
    from creaseline.plans import predlog

    log = prediction_log(spark, sf_dir)
    results = log.select("match_key", "actual_winner", "official_potm")
    stamp = F.col("logged_at_post")
    graded = predlog.apply_results(log, results, logged_at=stamp)
    return graded.withColumns(predlog.predicted_innings(F.col("pred_extra_json")))


def scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecard lines as text cells: one per match, innings and batter."""
    lines = deliveries(spark, sf_dir).groupBy("match_id", "innings", "batting_team", "batter").agg(
        F.sum("runs_off_bat").cast("int").alias("r"), F.sum((F.col("is_wide") == 0).cast("int")).alias("b"),
        F.sum((F.col("runs_off_bat") == 4).cast("int")).alias("f4"), F.sum((F.col("runs_off_bat") == 6).cast("int")).alias("f6"),
        F.max(F.when(F.col("dismissal_kind") != "", F.concat("dismissal_kind", F.lit("|"), "bowler"))).alias("out"),
    )
    return lines.selectExpr(
        "concat('G', match_id) AS match", "concat('inn', innings) AS innings", "batting_team AS team",
        "CASE WHEN r % 5 = 0 THEN concat(' ', replace(batter, '_', ' ')) ELSE batter END AS player",
        "CAST(r AS STRING) AS runs", "CAST(b AS STRING) AS balls", "CAST(f4 AS STRING) AS fours", "CASE WHEN f6 = 0 THEN 'x' ELSE CAST(f6 AS STRING) END AS sixes",
        "CASE WHEN out IS NULL THEN 'not out' WHEN out LIKE 'run out%' THEN 'run out (Sub)' ELSE concat('c Keeper b ', split_part(out, '|', 2)) END AS dismissal",
    )


def scorecard_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture_schedule(spark, sf_dir)
    return rows.selectExpr(
        "CAST(match_no AS INT) AS match_no", "concat('G', match_no) AS group", "date", "venue_city AS venue", "home_team AS team1",
        "CASE WHEN match_no % 9 = 0 THEN 'Nobody' ELSE away_team END AS team2",
    )


def scorecard_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = deliveries(spark, sf_dir).select("batter").distinct()
    return names.selectExpr("batter AS canonical_id", "replace(batter, '_', ' ') AS alias_string", "'seed' AS source", "1 AS priority")
