"""Registered queries: files of every kind written from the given tables and read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creaseline.plans import training
from creaseline.queries import views
from creaseline.queries.ingest import _folder, _typed
from creaseline.queries.models import _split_matches
from creaseline.queries.registry import query
from creaseline.schemas import EXTRA_COMPONENTS
from creaseline.sources import deliveries as src
from creaseline.sources import reference, sinks

_FEED = ("match_id", "innings", "over", "ball_in_over", "batter", "non_striker", "bowler", "runs_off_bat", "extras", "is_wide", "is_noball", "dismissal_kind", "player_dismissed")
_GROUPED = "count(*) AS balls, sum(runs_off_bat) AS runs, sum(extras) AS extras"
#: Texts of a date in the four kinds of files: day first, month first, with the month's name, as eight digits.
_DATE_TEXT = "CASE match_id % 4 WHEN 0 THEN date_format(date, 'dd/MM/yyyy') WHEN 1 THEN date_format(date, 'M-d-yyyy') WHEN 2 THEN date_format(date, 'd MMM yyyy') ELSE date_format(date, 'yyyyMMdd') END"


#: Matches whose records stand in one file, as a JSON array.
RECORDS_PER_FILE, DOCUMENTS_PER_FILE = 500, 100
#: Balls in a file of one kind of date texts, about.
BALLS_PER_FILE = 500_000


def _write_arrays(rows: DataFrame, path: str, per_file: int) -> None:
    """Rows with a ``file`` number as JSON arrays, ``per_file`` numbers in a file; readers of single documents take arrays too.

    A file for each match costs more time than the records in it.
    """
    _write_files(rows.withColumn("file", F.expr(f"file div {per_file}")), path)


def _write_files(rows: DataFrame, path: str) -> None:
    """Rows of each ``file`` number as one JSON array in a folder of its own."""
    columns = [c for c in rows.columns if c != "file"]
    arrays = rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value"))
    arrays.write.partitionBy("file").text(path)


def _grouped(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("balls"), F.sum("runs_off_bat").alias("runs"), F.sum("extras").alias("extras"))


@query(
    "a05_blank_file_defaults",
    f"""SELECT batting_team, bowling_team, venue, date, {_GROUPED} FROM (
    SELECT runs_off_bat, extras, CASE WHEN match_id % 2 = 1 THEN batting_team WHEN innings = 1 THEN 'Home' ELSE 'Away' END AS batting_team,
    CASE WHEN match_id % 2 = 1 THEN bowling_team WHEN innings = 1 THEN 'Away' ELSE 'Home' END AS bowling_team,
    CASE WHEN match_id % 2 = 1 THEN venue ELSE 'Default Ground' END AS venue, CASE WHEN match_id % 2 = 1 THEN date ELSE DATE '2026-03-28' END AS date FROM deliveries) x
    GROUP BY batting_team, bowling_team, venue, date""",
)
def _(spark, sf):
    """Files without teams, venue and date in any row take defaults; a single blank cell in another file does not."""
    root = _folder(spark, "defaults")
    d = _typed(spark, sf)
    blank = d.where("match_id % 2 = 0").select(*_FEED, *[F.lit("").alias(c) for c in ("batting_team", "bowling_team", "venue", "date")])
    blank.write.option("header", "true").csv(f"{root}/blank")
    d.where("match_id % 2 = 1").select(*_FEED, "batting_team", "bowling_team", "venue", "date").write.option("header", "true").csv(f"{root}/full")
    defaults = spark.createDataFrame(
        [(1, "Home", "Away", "Default Ground", "2026-03-28"), (2, "Away", "Home", "Default Ground", "2026-03-28")],
        "innings int, batting_team string, bowling_team string, venue string, date string",
    ).withColumn("date", F.to_date("date"))
    back = src.csv_deliveries(src.csv_rows(spark, [root]), defaults)
    return _grouped(back, "batting_team", "bowling_team", "venue", "date")


@query(
    "a06_a07_nested_match_files",
    f"""SELECT date, venue, competition, batting_team, bowling_team, innings, over, ball_in_over, count(*) AS balls, sum(runs_off_bat) AS runs, sum(extras) AS extras, CAST(sum(is_wide) AS BIGINT) AS wides, CAST(sum(is_noball) AS BIGINT) AS noballs,
    count(CASE WHEN dismissal_kind <> '' THEN 1 END) AS outs, min(batter) AS first_batter, max(player_dismissed) AS last_out FROM (
    SELECT * REPLACE (CASE WHEN contains(lower(competition), 'ipl') THEN 'IPL' ELSE competition END AS competition, CASE WHEN match_id % 9 = 4 THEN '' ELSE bowling_team END AS bowling_team,
    CAST(dense_rank() OVER (PARTITION BY match_id, innings ORDER BY over) - 1 AS INTEGER) AS over, CAST(row_number() OVER (PARTITION BY match_id, innings, over ORDER BY {', '.join(_FEED[3:])}) AS INTEGER) AS ball_in_over) FROM deliveries) x
    GROUP BY date, venue, competition, batting_team, bowling_team, innings, over, ball_in_over""",
)
def _(spark, sf):
    """One nested document per match, a hundred matches in a file; every ninth names three teams, which leaves no opponent."""
    root = _folder(spark, "json")
    # All groupings below hold the file number, so balls dealt by it once cross no further exchange until they are written.
    balls = _typed(spark, sf).withColumn("file", F.expr(f"match_id div {DOCUMENTS_PER_FILE}")).repartition("file")
    wides, noballs = F.col("is_wide").cast("double"), F.col("is_noball").cast("double")
    extras = {"wides": wides, "noballs": noballs, "byes": F.col("extras") - wides - noballs, "legbyes": F.lit(0.0), "penalty": F.lit(0.0)}
    ball = F.struct(
        "batter", "bowler", "non_striker", F.struct(F.col("runs_off_bat").alias("batter"), F.col("extras").alias("extras")).alias("runs"),
        F.struct(*[extras[c].alias(c) for c in EXTRA_COMPONENTS]).alias("extras"),
        F.when(F.col("dismissal_kind") != "", F.array(F.struct(F.col("dismissal_kind").alias("kind"), F.col("player_dismissed").alias("player_out")))).alias("wickets"),
    )
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    place = F.struct(*_FEED[3:])
    overs = balls.groupBy("file", "match_id", "date", "venue", "competition", "innings", "batting_team", "over").agg(listed(F.struct(place.alias("at"), ball.alias("v"))).alias("deliveries"))
    innings = overs.groupBy("file", "match_id", "date", "venue", "competition", "innings", "batting_team").agg(
        listed(F.struct(F.col("over").alias("at"), F.struct("deliveries").alias("v"))).alias("overs")
    )
    team = F.col("batting_team").alias("team")
    docs = innings.groupBy("file", "match_id", "date", "venue", "competition").agg(
        listed(F.struct(F.col("innings").alias("at"), F.struct(team, "overs").alias("v"))).alias("innings"), F.sort_array(F.collect_set("batting_team")).alias("teams")
    )
    teams = F.when(F.col("match_id") % 9 == 4, F.array_append("teams", F.lit("Third"))).otherwise(F.col("teams"))
    info = F.struct(F.array(F.date_add("date", 1).cast("string"), F.col("date").cast("string")).alias("dates"), "venue", teams.alias("teams"), "competition")
    _write_files(docs.select("file", info.alias("info"), "innings"), root)
    back = src.json_deliveries(spark, [root], suffix="txt")
    return back.groupBy("date", "venue", "competition", "batting_team", "bowling_team", "innings", "over", "ball_in_over").agg(
        F.count(F.lit(1)).alias("balls"), F.sum("runs_off_bat").alias("runs"), F.sum("extras").alias("extras"), F.sum("is_wide").alias("wides"),
        F.sum("is_noball").alias("noballs"), F.count_if(F.col("dismissal_kind") != "").alias("outs"), F.min("batter").alias("first_batter"),
        F.max("player_dismissed").alias("last_out"),
    )


@query(
    "a09_rejected_files",
    """SELECT 'cell count' AS reason, count(*) AS n FROM deliveries WHERE ball_in_over = 7 UNION ALL SELECT 'not a delivery file', (SELECT count(DISTINCT c_nationkey) FROM customer)
    UNION ALL SELECT 'not a match document', (SELECT count(*) FROM nation) UNION ALL SELECT 'ambiguous dates', 1 UNION ALL SELECT 'loaded', (SELECT count(*) FROM deliveries WHERE ball_in_over <> 7)""",
)
def _(spark, sf):
    """Ragged lines, files that are no deliveries, broken documents and dates of two readings go to the rejects, the rest loads."""
    root = _folder(spark, "rejects")
    d = _typed(spark, sf).select("match_id", "innings", "over", "ball_in_over", "batter", "bowler", "runs_off_bat", "date")
    cells = [F.col(c).cast("string") for c in d.columns]
    line = F.concat_ws(",", *cells, F.when(F.col("ball_in_over") == 7, "one cell more"))
    plain = d.select(line.alias(",".join(d.columns))).write.option("header", "true").option("sep", "\u0001").option("quote", "")
    plain.csv(f"{root}/balls")
    day, month = F.dayofmonth("date"), F.month("date")
    unclear = d.where((day <= 12) & (month <= 12) & (day != month)).withColumn("date", F.date_format("date", "dd/MM/yyyy"))
    unclear.coalesce(1).write.option("header", "true").csv(f"{root}/unclear")
    views.table(spark, sf, "customer").repartition("c_nationkey").write.partitionBy("c_nationkey").option("header", "true").csv(f"{root}/customers")
    views.table(spark, sf, "nation").repartition("n_nationkey").write.partitionBy("n_nationkey").json(f"{root}/nations")
    rejects = src.rejected_rows(spark, [root]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    loaded = src.csv_deliveries(src.csv_rows(spark, [root])).agg(F.lit("loaded").alias("reason"), F.count(F.lit(1)).alias("n"))
    return rejects.unionByName(loaded)


@query(
    "b04_dates_by_file",
    f"SELECT match_id, date, {_GROUPED} FROM deliveries GROUP BY match_id, date",
)
def _(spark, sf):
    """Four kinds of date texts, each in files of its own; days and months are told apart per file.

    The balls of a match are spread over the files of its kind, so that each file has dates of all kinds of days.
    """
    root = _folder(spark, "dates")
    d = _typed(spark, sf)
    kinds = d.select(*_FEED, F.expr(_DATE_TEXT).alias("start_date"), (F.col("match_id") % 4).alias("kind"))
    parts = 1 + d.count() // (4 * BALLS_PER_FILE)
    dealt = kinds.repartition(4 * parts, "kind", F.pmod(F.xxhash64(*_FEED), F.lit(parts)))
    dealt.write.partitionBy("kind").option("header", "true").csv(root)
    back = src.csv_deliveries(src.csv_rows(spark, [root]))
    return _grouped(back, F.col("match_id").try_cast("long").alias("match_id"), "date")


@query(
    "a10_official_results",
    "SELECT match_id, coalesce(winner, '') AS winner, team1, team2 FROM (SELECT match_no AS match_id, o.winner, home_team AS team1, away_team AS team2 FROM schedule LEFT JOIN official o ON o.match_id = match_no WHERE match_no % 7 <> 2) x",
)
def _(spark, sf):
    """Results with padded names; every seventh id is no number and is dropped."""
    path = _folder(spark, "results")
    rows = views.fixture_schedule(spark, sf).join(views.official_results(spark, sf).select(F.col("match_id").alias("match_no"), "winner"), "match_no", "left")
    rows.selectExpr(
        "CASE WHEN match_no % 7 = 2 THEN concat('m', match_no) WHEN match_no % 7 = 3 THEN concat(match_no, '.0') ELSE CAST(match_no AS STRING) END AS matchId",
        "concat(' ', winner, ' ') AS winner", "concat(home_team, ' ') AS team1", "away_team AS team2",
    ).write.option("header", "true").option("ignoreTrailingWhiteSpace", "false").option("ignoreLeadingWhiteSpace", "false").csv(path)
    return reference.read_official_results(spark, path)


@query(
    "a13_reference_tables",
    """SELECT 'squads' AS name, count(*) AS n, CAST(sum(is_overseas) AS BIGINT) AS numbers, count(DISTINCT team) AS teams FROM (SELECT team, CASE WHEN k % 5 = 4 THEN 0 ELSE k % 2 END AS is_overseas FROM people) s
    UNION ALL SELECT 'fixtures', count(*), CAST(sum(CASE WHEN match_no % 6 = 5 THEN 0 ELSE match_no END) AS BIGINT), count(DISTINCT home_team) FROM schedule UNION ALL SELECT 'bridge', 0, 0, 0""",
)
def _(spark, sf):
    """Squads and fixtures with padded texts, broken numbers and a column missing; an absent file is an empty table."""
    root = _folder(spark, "reference")
    keep = {"ignoreTrailingWhiteSpace": "false", "ignoreLeadingWhiteSpace": "false", "header": "true"}
    people = views.people(spark, sf).selectExpr("concat(' ', team) AS team", "concat(full_name, ' ') AS player_id", "CASE WHEN k % 5 = 4 THEN 'x' ELSE concat(k % 2, '.0') END AS is_overseas")
    people.write.options(**keep).csv(f"{root}/squads")
    schedule = views.fixture_schedule(spark, sf).selectExpr("CASE WHEN match_no % 6 = 5 THEN '?' ELSE CAST(match_no AS STRING) END AS match_no", "date", "concat(home_team, '  ') AS home_team", "away_team")
    schedule.write.options(**keep).csv(f"{root}/fixtures")
    squads, fixtures, bridge = (reference.read_reference(spark, n, f"{root}/{n}") for n in ("squads", "fixtures", "bridge"))

    def counted(name, rows, number, team):
        total = F.coalesce(F.sum(number), F.lit(0)).cast("long")
        return rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), total.alias("numbers"), F.count_distinct(team).alias("teams"))

    both = counted("squads", squads, "is_overseas", "team").unionByName(counted("fixtures", fixtures, "match_no", "home_team"))
    return both.unionByName(counted("bridge", bridge, F.lit(0), "franchise_key")).select(
        "name", "n", F.coalesce("numbers", F.lit(0)).cast("long").alias("numbers"), "teams"
    )


@query(
    "a14_fixture_payloads",
    """SELECT CAST(fixture_id AS VARCHAR) AS match_id, team1_name, team2_name, list_aggregate(xi1, 'string_agg', '|') AS first_eleven, list_aggregate(xi2, 'string_agg', '|') AS second_eleven,
    CASE WHEN fixture_id % 3 = 0 THEN 'team1' WHEN fixture_id % 3 = 1 THEN 'team2' END AS batting_first, concat('report ', fixture_id) AS pitch_text
    FROM (SELECT fixture_id, min(CASE WHEN side = 1 THEN team END) AS team1_name, min(CASE WHEN side = 2 THEN team END) AS team2_name,
    list(player_id ORDER BY xi_place) FILTER (side = 1) AS xi1, list(player_id ORDER BY xi_place) FILTER (side = 2) AS xi2 FROM fp GROUP BY fixture_id) x""",
)
def _(spark, sf):
    """One payload per fixture, many in a file: elevens as a list or a comma text, under either name; toss or batting side."""
    root = _folder(spark, "payloads")
    players = views.fixture_players(spark, sf)

    def listed(s):
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("xi_place", "player_id")))), lambda x: x["player_id"])

    teams = [F.min(F.when(F.col("side") == s, F.col("team"))).alias(f"team{s}_name") for s in (1, 2)]
    rows = players.groupBy("fixture_id").agg(listed(1).alias("a"), listed(2).alias("b"), *teams)
    payload = rows.selectExpr(
        "fixture_id AS file", "CAST(fixture_id AS STRING) AS match_id", "concat(' ', team1_name) AS team1_name", "team2_name",
        "CASE WHEN fixture_id % 2 = 0 THEN a END AS xi1", "CASE WHEN fixture_id % 2 = 1 THEN array_join(a, ' , ') END AS playing_xi_team1",
        "CASE WHEN fixture_id % 2 = 0 THEN concat(array_join(b, ','), ',') END AS playing_xi_team2", "CASE WHEN fixture_id % 2 = 1 THEN b END AS xi2",
        "CASE WHEN fixture_id % 3 = 0 THEN upper(team1_name) END AS toss_winner", "CASE WHEN fixture_id % 3 = 0 THEN 'bat' END AS elected_to",
        "CASE WHEN fixture_id % 3 = 1 THEN 'team2' END AS batting_first",
        "CASE WHEN fixture_id % 4 = 0 THEN concat('report ', fixture_id) END AS pitch_text", "CASE WHEN fixture_id % 4 <> 0 THEN concat('report ', fixture_id) END AS pitch_report",
    )
    _write_arrays(payload, root, RECORDS_PER_FILE)
    back = reference.read_payloads(spark, root, "*.txt")
    return back.select(
        "match_id", "team1_name", "team2_name", F.array_join("xi1", "|").alias("first_eleven"), F.array_join("xi2", "|").alias("second_eleven"), "batting_first", "pitch_text"
    )


@query(
    "a16_record_files",
    """SELECT match_key, CASE WHEN match_id % 5 = 1 OR match_id % 5 = 2 THEN 'rejected' ELSE 'prediction' END AS kind, CAST(NULL AS VARCHAR) AS detail FROM plog
    UNION ALL SELECT match_key, 'result', official_potm FROM plog WHERE match_id % 4 <> 3 UNION ALL SELECT match_key, 'review', concat('seen ', match_id) FROM plog WHERE match_id % 3 = 0""",
)
def _(spark, sf):
    """Files of prediction, result and review records, many in a file; four batters, or no winner, reject a prediction."""
    root = _folder(spark, "records")
    log = views.prediction_log(spark, sf)
    predictions = log.selectExpr(
        "match_id AS file", "match_key", "'2026-01-01' AS match_date", "venue", "team1_name", "team2_name", "team1_bats_first",
        "CASE WHEN match_id % 5 <> 1 THEN pred_winner END AS pred_winner", "pred_p_team1_win", "pred_best_bat", "pred_best_bowl",
        "CASE WHEN match_id % 5 = 2 THEN slice(pred_top5_bats, 1, 4) ELSE pred_top5_bats END AS pred_top5_bats", "pred_top3_bowls", "pred_potm",
        "named_struct('sims', 10) AS pred_extra",
    )
    results = log.selectExpr("match_id AS file", "CASE WHEN match_id % 4 = 3 THEN ' ' ELSE match_key END AS match_key", "official_potm", "match_id * 1.5D AS actual_first_innings_team_runs")
    reviews = log.where("match_id % 3 = 0").selectExpr("match_id AS file", "match_key", "concat('seen ', match_id) AS process3_notes")
    for name, rows in (("pre", predictions), ("post", results), ("review", reviews)):
        _write_arrays(rows, f"{root}/{name}", RECORDS_PER_FILE)
    good, bad = reference.read_predictions(spark, f"{root}/pre", "*.txt")
    none = F.lit(None).cast("string").alias("detail")
    out = good.select("match_key", F.lit("prediction").alias("kind"), none).unionByName(bad.select("match_key", F.lit("rejected").alias("kind"), none))
    out = out.unionByName(reference.read_results(spark, f"{root}/post", "*.txt").select("match_key", F.lit("result").alias("kind"), F.col("official_potm").alias("detail")))
    return out.unionByName(reference.read_reviews(spark, f"{root}/review", "*.txt").select("match_key", F.lit("review").alias("kind"), F.col("process3_notes").alias("detail")))


@query(
    "a17_required_columns",
    """SELECT 'dismissal_kind' AS name, count(CASE WHEN dismissal_kind = '' THEN 1 END) AS n_null, FALSE AS missing FROM deliveries UNION ALL SELECT 'venue', count(CASE WHEN match_id % 4 = 1 THEN 1 END), FALSE FROM deliveries
    UNION ALL SELECT 'batter', 0, FALSE UNION ALL SELECT 'is_noball', NULL, TRUE UNION ALL SELECT 'is_wide', NULL, TRUE UNION ALL SELECT 'player_dismissed', NULL, TRUE""",
)
def _(spark, sf):
    """Missing columns of a written file, and rows without a value in those that are there."""
    path = _folder(spark, "checked")
    d = _typed(spark, sf).withColumn("venue", F.when(F.col("match_id") % 4 == 1, "nan").otherwise(F.col("venue")))
    d.drop("is_wide", "is_noball", "player_dismissed").write.option("header", "true").csv(path)
    back = spark.read.option("header", "true").csv(path)
    nulls = src.null_counts(back).select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_null")) for c in ("dismissal_kind", "venue", "batter")])))
    missing = spark.createDataFrame([(c,) for c in src.missing_columns(back)], "name string")
    return nulls.withColumn("missing", F.lit(False)).unionByName(missing.select("name", F.lit(None).cast("long").alias("n_null"), F.lit(True).alias("missing")))


@query(
    "a18_table_sinks",
    f"""SELECT CAST(coalesce(year(date), 0) AS INTEGER) AS season, {_GROUPED}, min(venue) AS venue FROM (
    SELECT * REPLACE (CASE WHEN match_id % 13 = 5 THEN NULL ELSE date END AS date, CASE WHEN match_id % 13 <> 5 AND year(date) = 1996 THEN 'Moved' ELSE venue END AS venue) FROM deliveries) x GROUP BY 1""",
)
def _(spark, sf):
    """A table by season; writing one season again replaces that season only."""
    path = _folder(spark, "seasons")
    d = _typed(spark, sf).withColumn("date", F.when(F.col("match_id") % 13 != 5, F.col("date")))
    sinks.write_deliveries(d, path)
    sinks.write_deliveries(d.where("year(date) = 1996").withColumn("venue", F.lit("Moved")), path)
    return spark.read.parquet(path).groupBy("season").agg(
        F.count(F.lit(1)).alias("balls"), F.sum("runs_off_bat").alias("runs"), F.sum("extras").alias("extras"), F.min("venue").alias("venue")
    )


@query(
    "i12_model_persistence",
    "SELECT count(*) AS n, count(*) AS equal FROM (SELECT *, row_number() OVER (ORDER BY match_date NULLS LAST, match_id) AS rn, count(*) OVER () AS total FROM mrows WHERE winner IN ('team1', 'team2')) x WHERE rn > floor(total * 0.8)",
)
def _(spark, sf):
    """Innings-total models written and read back give the same predictions on the held-out matches."""
    train, test = _split_matches(spark, sf)
    model, path = training.train_totals(train), _folder(spark, "totals-model")
    training.save_totals(model, path)
    own = model.predict(test).select("match_id", F.col("ml1").alias("a1"), F.col("ml2").alias("a2"))
    again = training.load_totals(path).predict(test).select("match_id", "ml1", "ml2")
    same = F.col("a1").eqNullSafe(F.col("ml1")) & F.col("a2").eqNullSafe(F.col("ml2"))
    return own.join(again, "match_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("equal"))
