"""Registered queries: cell cleaning, flags, names of teams and venues, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.functions import cricket, franchise, text
from creaseline.plans import form, stats
from creaseline.queries import views
from creaseline.queries.oracle import CTES
from creaseline.queries.registry import query, r, rounded
from creaseline.sources import deliveries as src

CTES.update(
    {
        "raw_cells": """
SELECT l_linenumber AS line, l_returnflag AS kind,
  CASE l_linenumber % 4 WHEN 0 THEN 'abc' WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 2 THEN '' END AS num_text,
  CASE l_linenumber WHEN 1 THEN ' nan ' WHEN 2 THEN 'None' WHEN 3 THEN '<NA>' WHEN 4 THEN NULL ELSE concat('  ', l_returnflag, ' ') END AS label,
  CASE l_linenumber % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2.5' WHEN 3 THEN 'x' ELSE '' END AS flag_text,
  CASE l_linenumber % 3 WHEN 0 THEN '2024-01-32' WHEN 1 THEN '2024-02-10' ELSE 'n/a' END AS date_text,
  CASE l_linenumber % 4 WHEN 0 THEN ' True' WHEN 1 THEN 'no' WHEN 2 THEN 'YES' ELSE 'maybe' END AS bool_text
FROM lineitem""",
        "raw_balls": """
SELECT l_orderkey // 25 AS match_id, l_linenumber AS line,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) % 7 AS DOUBLE) END AS runs_off_bat,
  CASE WHEN l_linenumber % 3 = 0 THEN 1.0 END AS extras,
  CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0 END AS wides, CASE WHEN l_linenumber = 2 THEN 1.0 ELSE 0 END AS noballs,
  CASE WHEN l_linenumber = 4 THEN 4.0 ELSE 0 END AS byes, CASE WHEN l_linenumber = 5 THEN 2.0 ELSE 0 END AS legbyes,
  CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS total_runs,
  CASE WHEN l_linenumber = 6 THEN 'wide' WHEN l_linenumber = 7 THEN 'noball' END AS extras_type,
  CASE WHEN l_linenumber = 3 THEN 1 END AS w, CASE WHEN l_linenumber = 5 THEN 1 END AS nb
FROM lineitem""",
        "spelled": f"""
SELECT o_orderkey AS match_id, list_extract([{views.FRANCHISE_SPELLINGS}], CAST(o_orderkey % 10 + 1 AS INTEGER)) AS a,
       list_extract([{views.FRANCHISE_SPELLINGS}], CAST(o_custkey % 10 + 1 AS INTEGER)) AS b FROM orders""",
        "canon": "SELECT * FROM (VALUES "
        + ", ".join(f"('{k}', '{v}')" for k, v in franchise.CANONICAL_FRANCHISES.items())
        + ") t(k, v)",
        "stadiums": "SELECT * FROM (VALUES "
        + ", ".join(f"('{k}', '{v}')" for k, v in franchise.CITY_STADIUMS.items())
        + ") t(city, stadium)",
        "schedule": f"""
SELECT match_id AS match_no, min(date) AS date, min(CASE WHEN innings = 1 THEN batting_team END) AS home_team,
       min(CASE WHEN innings = 1 THEN bowling_team END) AS away_team,
       list_extract([{views.CITIES}], CAST(match_id % 10 + 1 AS INTEGER)) AS venue_city FROM deliveries GROUP BY match_id""",
    }
)


@query(
    "b01_b04_cell_coercion",
    """SELECT line, kind, sum(coalesce(TRY_CAST(num_text AS DOUBLE), 0)) AS num_sum,
    count(CASE WHEN lower(trim(label)) NOT IN ('', 'nan', 'none', '<na>') THEN trim(label) END) AS labels,
    min(CASE WHEN lower(trim(label)) NOT IN ('', 'nan', 'none', '<na>') THEN trim(label) END) AS label,
    CAST(sum(CASE WHEN TRY_CAST(flag_text AS DOUBLE) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS flags,
    count(TRY_CAST(date_text AS DATE)) AS dates, min(TRY_CAST(date_text AS DATE)) AS date FROM raw_cells GROUP BY line, kind""",
)
def _(spark, sf):
    c = views.raw_cells(spark, sf)
    return c.groupBy("line", "kind").agg(
        F.sum(text.number_or_zero("num_text")).alias("num_sum"),
        F.count(text.clean_text("label")).alias("labels"),
        F.min(text.clean_text("label")).alias("label"),
        F.sum(text.flag01("flag_text")).alias("flags"),
        F.count(text.date_or_null("date_text")).alias("dates"),
        F.min(text.date_or_null("date_text")).alias("date"),
    )


@query(
    "b05_b07_extras_and_flags",
    """SELECT match_id, line, sum(coalesce(runs_off_bat, total_runs - coalesce(extras, wides + noballs + byes + legbyes))) AS runs_off_bat,
    sum(CAST(coalesce(extras, wides + noballs + byes + legbyes) AS DOUBLE)) AS extras,
    CAST(sum(CASE WHEN extras_type IS NOT NULL THEN (extras_type = 'wide')::INT ELSE coalesce(w, (wides > 0)::INT) END) AS BIGINT) AS is_wide,
    CAST(sum(CASE WHEN extras_type IS NOT NULL THEN (extras_type = 'noball')::INT ELSE coalesce(nb, (noballs > 0)::INT) END) AS BIGINT) AS is_noball
    FROM raw_balls GROUP BY match_id, line""",
)
def _(spark, sf):
    b = views.raw_balls(spark, sf)
    raw = {c: F.col(c) for c in b.columns}
    typed = b.select("match_id", "line", *[c.alias(n) for n, c in src.delivery_runs(raw).items()])
    return typed.groupBy("match_id", "line").agg(
        *[F.sum(c).alias(c) for c in ("runs_off_bat", "extras", "is_wide", "is_noball")]
    )


@query(
    "b08_present_players",
    "SELECT match_id, count(*) AS n FROM (SELECT match_id, CASE WHEN ball_in_over = 3 THEN ' ' ELSE batter END AS batter, bowler FROM deliveries) x WHERE trim(batter) <> '' AND trim(bowler) <> '' GROUP BY match_id",
)
def _(spark, sf):
    d = views.deliveries(spark, sf).withColumn("batter", F.when(F.col("ball_in_over") == 3, " ").otherwise(F.col("batter")))
    kept = d.where(text.clean_text("batter").isNotNull() & text.clean_text("bowler").isNotNull())
    return kept.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b09_b10_delivery_indicators",
    """SELECT match_id, innings, CAST(sum(ball_faced) AS BIGINT) AS ball_faced, CAST(sum(is_four) AS BIGINT) AS is_four, CAST(sum(is_six) AS BIGINT) AS is_six,
    CAST(sum(batter_out) AS BIGINT) AS batter_out, CAST(sum(ball_bowled) AS BIGINT) AS ball_bowled, CAST(sum(wicket_credit) AS BIGINT) AS wicket_credit, sum(conceded) AS conceded
    FROM ind GROUP BY match_id, innings""",
)
def _(spark, sf):
    rows = stats.delivery_indicators(views.deliveries(spark, sf))
    names = ("ball_faced", "is_four", "is_six", "batter_out", "ball_bowled", "wicket_credit", "conceded")
    return rows.groupBy("match_id", "innings").agg(*[F.sum(c).alias(c) for c in names])


@query(
    "b12_league_filter",
    "SELECT competition, count(*) AS n FROM (SELECT CASE WHEN over = 3 THEN '' WHEN over = 4 THEN 'Indian Premier League' ELSE competition END AS competition FROM deliveries) x WHERE upper(trim(competition)) = 'IPL' OR lower(competition) LIKE '%indian premier%' OR competition = '' GROUP BY competition",
)
def _(spark, sf):
    label = F.when(F.col("over") == 3, "").when(F.col("over") == 4, "Indian Premier League").otherwise(F.col("competition"))
    d = views.deliveries(spark, sf).select(label.alias("competition"))
    return d.where(franchise.is_league_row(F.col("competition"))).groupBy("competition").agg(F.count(F.lit(1)).alias("n"))


@query("b13_b24_b26_roles", "SELECT match_id, player_id, role, CASE role WHEN 'batter' THEN 0 WHEN 'bowler' THEN 1 ELSE 2 END AS role_encoded, CASE WHEN balls > 10 THEN role ELSE 'allrounder' END AS known_role FROM pms")
def _(spark, sf):
    rows = views.player_match(spark, sf).withColumn("role", stats.role_of(F.col("balls"), F.col("balls_bowled")))
    dirty = F.when(F.col("balls") > 10, F.concat(F.lit(" "), F.upper("role"))).otherwise("keeper")
    return rows.select(
        "match_id", "player_id", "role", franchise.role_code(F.col("role")).alias("role_encoded"), franchise.known_role(dirty).alias("known_role")
    )


@query(
    "b14_b15_franchise_names",
    """SELECT match_id, coalesce(c.v, trim(a)) AS franchise_a, coalesce(d.v, trim(b)) AS franchise_b,
    lower(trim(a)) = lower(trim(b)) OR (lower(trim(a)) IN ('kings xi punjab', 'punjab kings') AND lower(trim(b)) IN ('kings xi punjab', 'punjab kings')) AS same
    FROM spelled LEFT JOIN canon c ON c.k = lower(trim(a)) LEFT JOIN canon d ON d.k = lower(trim(b))""",
)
def _(spark, sf):
    return views.spelled_teams(spark, sf).select(
        "match_id",
        franchise.canonical_franchise("a").alias("franchise_a"),
        franchise.canonical_franchise("b").alias("franchise_b"),
        franchise.same_franchise(F.col("a"), F.col("b")).alias("same"),
    )


@query("b20_match_key", "SELECT match_key, count(*) AS n FROM pms GROUP BY match_key")
def _(spark, sf):
    rows = views.player_match(spark, sf).select(stats.match_key(F.col("match_id"), F.col("date")).alias("match_key"))
    return rows.groupBy("match_key").agg(F.count(F.lit(1)).alias("n"))


@query("b27_city_stadium", "SELECT match_no, coalesce(stadium, trim(venue_city)) AS stadium FROM schedule LEFT JOIN stadiums ON city = trim(venue_city)")
def _(spark, sf):
    return views.fixture_schedule(spark, sf).select("match_no", franchise.stadium_of_city("venue_city").alias("stadium"))


@query(
    "b28_fixture_lookups",
    "SELECT 'by_number' AS lookup, match_no, home_team, away_team FROM schedule WHERE match_no = 17 UNION ALL SELECT 'by_date', match_no, home_team, away_team FROM schedule WHERE date = DATE '1996-02-05'",
)
def _(spark, sf):
    fixtures = views.fixture_schedule(spark, sf)
    sides = ("match_no", "home_team", "away_team")
    by_number = fixtures.where(F.col("match_no") == 17).select(F.lit("by_number").alias("lookup"), *sides)
    by_date = fixtures.where(F.col("date") == F.lit("1996-02-05").cast("date")).select(F.lit("by_date").alias("lookup"), *sides)
    return by_number.unionByName(by_date)


@query(
    "b30_finite_features",
    f"SELECT match_id, player_id, {r('x', 'y')} FROM (SELECT match_id, player_id, CASE WHEN balls > 0 THEN runs / balls ELSE 0 END AS x, CASE WHEN balls > 0 THEN ln(1 + runs) ELSE 0 END AS y FROM pms) q",
)
def _(spark, sf):
    from creaseline.plans.scoring import finite

    rows = views.player_match(spark, sf).withColumns(
        {
            "x": F.when(F.col("balls") > 0, F.col("runs") / F.col("balls")).otherwise(F.lit(float("inf"))),
            "y": F.when(F.col("balls") > 0, F.ln(F.col("runs") + 1.0)).otherwise(F.lit(float("nan"))),
        }
    )
    return rounded(rows.select("match_id", "player_id", finite(F.col("x")).alias("x"), finite(F.col("y")).alias("y")))


@query(
    "a08_competition_label",
    """SELECT label, count(*) AS n FROM (SELECT CASE WHEN lower(name) LIKE '%ipl%' OR lower(name) LIKE '%indian premier%' THEN 'IPL' ELSE substr(trim(name), 1, 64) END AS label FROM (
    SELECT CASE match_id % 4 WHEN 0 THEN concat('IPL ', CAST(match_id % 9 AS VARCHAR)) WHEN 1 THEN 'Tata Indian Premier League'
    WHEN 2 THEN concat(' ', repeat('World Trophy ', 7), CAST(match_id % 9 AS VARCHAR)) ELSE '' END AS name FROM deliveries) x) y GROUP BY label""",
)
def _(spark, sf):
    name = F.expr(
        """CASE match_id % 4 WHEN 0 THEN concat('IPL ', match_id % 9) WHEN 1 THEN 'Tata Indian Premier League'
        WHEN 2 THEN concat(' ', repeat('World Trophy ', 7), match_id % 9) ELSE '' END"""
    )
    rows = views.deliveries(spark, sf).select(franchise.competition_label(name).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_LISTS = "SELECT match_id, batting_team AS team, string_agg(player_id, ' , ' ORDER BY player_id) AS players FROM pms GROUP BY match_id, batting_team"


@query(
    "a15_player_list_parse",
    "SELECT match_id, batting_team AS team, count(*) AS n, min(player_id) AS first_player, max(player_id) AS last_player FROM pms GROUP BY match_id, batting_team",
)
def _(spark, sf):
    lists = form.roster_lists(stats.match_rosters(views.player_match(spark, sf)))
    lined = F.concat(F.lit("# squad\n"), F.replace("players", F.lit(","), F.lit(" , ")), F.lit("\n\n  # end"))
    parsed = lists.select("match_id", "team", text.player_list(lined).alias("p"))
    return parsed.select(
        "match_id", "team", F.size("p").cast("long").alias("n"), F.array_min("p").alias("first_player"), F.array_max("p").alias("last_player")
    )


_OUT_TEXT = """CASE match_id % 8 WHEN 0 THEN concat('c Keeper b ', bowler) WHEN 1 THEN 'not out' WHEN 2 THEN 'run out (Sub)' WHEN 3 THEN 'c & b Pandya'
 WHEN 4 THEN 'retired hurt' WHEN 5 THEN '' WHEN 6 THEN concat('lbw b ', bowler, ' , review') ELSE 'hit wicket' END"""


@query(
    "h08_dismissal_texts",
    f"""SELECT text, bowler_name, kind, count(*) AS n, CAST(sum(out_flag) AS DOUBLE) AS outs FROM (SELECT text,
    CASE WHEN text IN ('', 'not out', 'run out (Sub)', 'retired hurt', 'hit wicket') THEN 'Unknown' WHEN text = 'c & b Pandya' THEN 'Pandya' ELSE bowler END AS bowler_name,
    CASE WHEN NOT last THEN '' WHEN text IN ('', 'not out') THEN '' WHEN text = 'run out (Sub)' THEN 'run out' ELSE 'caught' END AS kind,
    CASE WHEN text = 'not out' THEN 0 ELSE 1 END AS out_flag FROM (SELECT {_OUT_TEXT} AS text, bowler, ball_in_over = 6 AS last FROM deliveries) x) y GROUP BY text, bowler_name, kind""",
)
def _(spark, sf):
    rows = views.deliveries(spark, sf).select(F.expr(_OUT_TEXT).alias("text"), (F.col("ball_in_over") == 6).alias("last"))
    parsed = rows.select(
        "text",
        cricket.bowler_of_dismissal(F.col("text")).alias("bowler_name"),
        cricket.dismissal_kind_of(F.col("text"), F.col("last")).alias("kind"),
        cricket.dismissed_flag(F.col("text")).alias("outs"),
    )
    return parsed.groupBy("text", "bowler_name", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("outs").alias("outs"))


@query("h18_tri_state", "SELECT line, v, count(*) AS n FROM (SELECT line, CASE WHEN lower(trim(bool_text)) IN ('true', '1', 'yes') THEN TRUE WHEN lower(trim(bool_text)) IN ('false', '0', 'no') THEN FALSE END AS v FROM raw_cells) x GROUP BY line, v")
def _(spark, sf):
    return views.raw_cells(spark, sf).select("line", text.tri_state("bool_text").alias("v")).groupBy("line", "v").agg(F.count(F.lit(1)).alias("n"))


_TOSS_SQL = """SELECT match_no, home_team AS t1, away_team AS t2, CASE match_no % 5 WHEN 0 THEN home_team WHEN 1 THEN lower(away_team) WHEN 2 THEN 't' WHEN 3 THEN concat(' ', away_team, ' ') ELSE 'nobody' END AS w,
  CASE match_no % 3 WHEN 0 THEN 'bat' WHEN 1 THEN 'Field' ELSE 'bowl' END AS e, CASE match_no % 4 WHEN 0 THEN 'T1' WHEN 1 THEN 'team2' ELSE NULL END AS given FROM schedule"""


@query(
    "h15_h16_toss_and_order",
    f"""SELECT match_no, batting_first, CASE WHEN batting_first = 'team2' THEN t2 ELSE t1 END AS first_side, CASE WHEN batting_first = 'team2' THEN t1 ELSE t2 END AS second_side,
    coalesce(batting_first = 'team2', FALSE) AS swapped FROM (SELECT *, coalesce(CASE WHEN is1 AND NOT is2 THEN CASE WHEN e = 'bat' THEN 'team1' ELSE 'team2' END
    WHEN is2 AND NOT is1 THEN CASE WHEN e = 'bat' THEN 'team2' ELSE 'team1' END END, CASE given WHEN 'T1' THEN 'team1' WHEN 'team2' THEN 'team2' END) AS batting_first FROM (
    SELECT *, contains(lower(t1), lower(trim(w))) AS is1, contains(lower(t2), lower(trim(w))) AS is2 FROM ({_TOSS_SQL}) a) b) c""",
)
def _(spark, sf):
    from creaseline.plans.scoring import order_sides

    rows = views.fixture_schedule(spark, sf).selectExpr(
        "match_no", "home_team AS team1_name", "away_team AS team2_name",
        "CASE match_no % 5 WHEN 0 THEN home_team WHEN 1 THEN lower(away_team) WHEN 2 THEN 't' WHEN 3 THEN concat(' ', away_team, ' ') ELSE 'nobody' END AS w",
        "CASE match_no % 3 WHEN 0 THEN 'bat' WHEN 1 THEN 'Field' ELSE 'bowl' END AS e",
        "CASE match_no % 4 WHEN 0 THEN 'T1' WHEN 1 THEN 'team2' END AS given", "array() AS xi1", "array() AS xi2",
    )
    first = cricket.resolved_batting_first(*[F.col(c) for c in ("w", "e", "team1_name", "team2_name", "given")])
    ordered = order_sides(rows.withColumn("batting_first", first))
    return ordered.select(
        "match_no", "batting_first", F.col("team1_name").alias("first_side"), F.col("team2_name").alias("second_side"), F.col("batting_order_swapped").alias("swapped")
    )


@query(
    "h22_h23_math_and_dates",
    f"""SELECT match_id, player_id, age, day, same_day, {r('log1p', 'back', 'logit', 'expit', 'tanh', 'clipped')} FROM (SELECT match_id, player_id, date_diff('day', date, DATE '2026-01-01') AS age, strftime(date, '%Y-%m-%d') AS day,
    date = DATE '1996-02-05' AS same_day, ln(1 + runs) AS log1p, exp(ln(1 + runs)) - 1 AS back, ln(greatest(least(runs / 50.0, 0.999999), 0.000001) / (1 - greatest(least(runs / 50.0, 0.999999), 0.000001))) AS logit,
    1 / (1 + exp(-runs / 22.0)) AS expit, tanh(runs / 15.0) AS tanh, greatest(least(runs, 40.0), 5.0) AS clipped FROM pms) x""",
)
def _(spark, sf):
    from creaseline.plans.scoring import expit, logit

    p = views.player_match(spark, sf)
    run = F.col("runs")
    rows = p.select(
        "match_id", "player_id",
        F.datediff(F.lit("2026-01-01").cast("date"), "date").cast("long").alias("age"),
        F.date_format("date", "yyyy-MM-dd").alias("day"), (F.col("date") == F.lit("1996-02-05").cast("date")).alias("same_day"),
        F.log1p(run).alias("log1p"), F.expm1(F.log1p(run)).alias("back"), logit(run / 50.0).alias("logit"),
        expit(run / 22.0).alias("expit"), F.tanh(run / 15.0).alias("tanh"), text.clip(run, 5.0, 40.0).alias("clipped"),
    )
    return rounded(rows)


_KEY_SQL = "SELECT DISTINCT innings, over, ball_in_over, match_id, batter, bowler, non_striker, runs_off_bat, extras FROM deliveries"


@query("g02_dedupe_deliveries", _KEY_SQL)
def _(spark, sf):
    return src.dedupe_deliveries(views.deliveries(spark, sf), order=("date", "venue")).select(*src.BALL_KEY)


@query(
    "g02_dedupe_without_innings",
    """WITH p AS (SELECT DISTINCT innings, over, ball_in_over, match_id, batter, bowler, non_striker, runs_off_bat, extras FROM deliveries WHERE over < 10),
    b AS (SELECT match_id, batter, bowler, non_striker, runs_off_bat, extras FROM deliveries WHERE over >= 10 EXCEPT SELECT match_id, batter, bowler, non_striker, runs_off_bat, extras FROM p)
    SELECT match_id, count(*) AS n FROM (SELECT match_id FROM p UNION ALL SELECT match_id FROM b) x GROUP BY match_id""",
)
def _(spark, sf):
    d = views.deliveries(spark, sf).withColumn("innings", F.when(F.col("over") < 10, F.col("innings")))
    return src.dedupe_deliveries(d).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g02_dedupe_mixed_sources",
    """WITH d AS (SELECT DISTINCT innings, over, ball_in_over, match_id, batter, bowler, non_striker, runs_off_bat, extras FROM deliveries)
    SELECT match_id, count(*) AS n FROM (SELECT * FROM d WHERE match_id % 4 <> 0 UNION ALL SELECT DISTINCT NULL, NULL, NULL, match_id, batter, bowler, non_striker, runs_off_bat, extras FROM d WHERE match_id % 4 = 0) x GROUP BY match_id""",
)
def _(spark, sf):
    """One source with places, and one without that has a half of its matches in common with it: below 90 % together."""
    d = views.deliveries(spark, sf)
    full = d.where("match_id % 4 <> 0").withColumn("path", F.lit("full"))
    bare = d.where("match_id % 2 = 0").withColumns({c: F.lit(None).cast(d.schema[c].dataType) for c in src.SHORT_KEY_DROPS})
    rows = full.unionByName(bare.withColumn("path", F.lit("bare")))
    return src.dedupe_deliveries(rows, source=("path",)).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g03_distinct_keep_last",
    "SELECT player_id, venue, match_id, date FROM pms QUALIFY row_number() OVER (PARTITION BY player_id, venue ORDER BY date DESC, match_id DESC) = 1",
)
def _(spark, sf):
    from creaseline.operators.windows import keep_one

    rows = views.player_match(spark, sf).select("player_id", "venue", "match_id", "date")
    return keep_one(rows, ["player_id", "venue"], [F.desc("date"), F.desc("match_id")])


@query(
    "g01_g04_team_sets",
    """SELECT 'all' AS what, t AS name FROM (SELECT batting_team AS t FROM deliveries UNION SELECT bowling_team FROM deliveries) x
    UNION ALL SELECT 'not_franchise', t FROM (SELECT batting_team AS t FROM deliveries EXCEPT SELECT team FROM franchises) y""",
)
def _(spark, sf):
    d = views.deliveries(spark, sf)
    teams = d.select(F.col("batting_team").alias("name")).unionByName(d.select(F.col("bowling_team").alias("name"))).distinct()
    others = d.select(F.col("batting_team").alias("name")).subtract(views.franchises(spark, sf).select(F.col("team").alias("name")))
    return teams.select(F.lit("all").alias("what"), "name").unionByName(others.select(F.lit("not_franchise").alias("what"), "name"))
