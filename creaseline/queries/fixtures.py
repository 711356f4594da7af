"""Registered queries: pitch and venue texts, fixture scoring, win probability and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.functions import cricket, pitch
from creaseline.operators.distinct import on_distinct
from creaseline.plans import features, scoring
from creaseline.queries import views
from creaseline.queries.oracle import CTES
from creaseline.queries.registry import query, r, rounded


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _rule(groups) -> str:
    return "(" + " AND ".join(_has(g) for g in groups) + ")"


def _points(words, weight) -> str:
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN {weight} ELSE 0.0 END" for w in words)


_HIGH = " OR ".join(_rule(g) for g in pitch.HIGH_PAR_RULES)
_LIFT = " + ".join(f"CASE WHEN {_rule(g)} THEN {v} ELSE 0.0 END" for v, g in pitch.PAR_LIFTS)
_HARSH = ", ".join(f"CASE WHEN contains(lower(venue), '{p}') THEN {w} ELSE 0.0 END" for p, w in pitch.VENUE_HARSHNESS)
_NUDGE = "CASE " + " ".join(f"WHEN {_has(w).replace('(t,', '(lower(venue),')} THEN {v}" for v, w in pitch.VENUE_NUDGES) + " ELSE 1.0 END"

CTES.update(
    {
        "fix0": f"""
SELECT match_no AS fixture_id, date AS match_date, home_team AS team1_name, away_team AS team2_name, coalesce(stadium, trim(venue_city)) AS venue,
       list_extract([{views._sql_texts(views.REPORTS)}], CAST(match_no % 7 + 1 AS INTEGER)) AS pitch_text,
       CASE WHEN match_no % 6 <> 0 THEN CAST(90 + match_no * 7 % 120 AS DOUBLE) END AS ml1,
       CASE WHEN match_no % 6 <> 0 THEN CAST(85 + match_no * 11 % 125 AS DOUBLE) END AS ml2,
       CASE WHEN match_no % 9 <> 0 THEN (match_no * 37 % 101) / CAST(100 AS DOUBLE) END AS ml_p_team1
FROM schedule LEFT JOIN stadiums ON city = trim(venue_city)""",
        "pitched": f"""
SELECT *, least((1.0 + 0.07 * score) * lift, 1.85) AS rm, greatest(1.0 - 0.05 * score - 0.03 * greatest(lift - 1.0, 0.0), 0.82) AS wm FROM (
  SELECT *, CAST(greatest(least(s0, 1.0), -1.0) AS DOUBLE) AS score FROM (
    SELECT *, CAST({_points(pitch.BATTING_WORDS, 0.15)} - CASE WHEN contains(t, 'grass') AND NOT contains(t, 'runs') AND NOT contains(t, 'batting') THEN 0.05 ELSE 0.0 END
           - CASE WHEN contains(t, 'bare patch') THEN CASE WHEN high THEN 0.04 ELSE 0.08 END ELSE 0.0 END
           - CASE WHEN high THEN 0.0 ELSE {_points(pitch.BOWLING_WORDS, 0.12)} END AS DOUBLE) AS s0,
           CAST(least({_points(pitch.CHASE_WORDS, 0.012)}, CASE WHEN high THEN 0.06 ELSE 0.04 END) AS DOUBLE) AS chase
    FROM (SELECT *, ({_HIGH}) AS high, CAST(least(1.0 + {_LIFT}, 1.85) AS DOUBLE) AS lift FROM (SELECT *, lower(pitch_text) AS t FROM fix0) a) b) c) d""",
        "fix1": f"""
SELECT *, CASE WHEN n > 1 THEN least(f1 * n, 1.88) ELSE f1 END AS first_innings_runs, CASE WHEN n > 1 THEN least(f2 * n, 1.88) ELSE f2 END AS second_innings_runs FROM (
  SELECT *, CASE WHEN trim(pitch_text) = '' THEN 1.0 ELSE rm END AS f1, CASE WHEN trim(pitch_text) = '' THEN 1.0 ELSE least(rm * (1.0 + chase), 1.88) END AS f2,
         CASE WHEN trim(pitch_text) = '' THEN 1.0 ELSE wm END AS first_innings_wickets,
         CASE WHEN trim(pitch_text) = '' THEN 1.0 ELSE wm * (1.0 - 0.5 * chase) END AS second_innings_wickets,
         CAST({_NUDGE} AS DOUBLE) AS n, CAST(greatest({_HARSH}) AS DOUBLE) AS venue_spin_harshness FROM pitched) x""",
        "fp": """
SELECT match_id AS fixture_id, CASE WHEN batting_team = concat('T', CAST(match_id % 10 AS VARCHAR)) THEN 1 ELSE 2 END AS side, player_id,
       batting_team AS team, bowling_team AS opponent, xi_place, role, CASE role WHEN 'batter' THEN 0 WHEN 'bowler' THEN 1 ELSE 2 END AS role_encoded,
       form_runs, form_wickets, form_runs_ipl, form_wickets_ipl, strike_rate, economy,
       form_runs * 0.8 + 5.0 + xi_place * 0.37 AS p_runs, form_wickets * 0.9 + 0.2 + xi_place * 0.013 AS p_wk,
       form_runs * 0.5 + xi_place AS std_runs, form_wickets * 0.5 + 0.1 AS std_wickets,
       (xi_place % 5 + 1) / 5.0 AS playing_prob, (xi_place % 10 + 1) / 10.0 AS data_confidence,
       CASE xi_place % 3 WHEN 0 THEN 'spin' WHEN 1 THEN 'pace' ELSE 'unknown' END AS bowling_style
FROM (SELECT *, row_number() OVER (PARTITION BY match_id, batting_team ORDER BY player_id) AS xi_place FROM feat) x""",
        "rosters": "SELECT fixture_id, side, CAST(count(*) AS INTEGER) AS n FROM fp GROUP BY fixture_id, side",
        "shrunk": """
SELECT * EXCLUDE (p_runs, p_wk), data_confidence * p_runs + (1 - data_confidence) * 0.45 * avg(p_runs) OVER s AS pred_runs_raw,
       data_confidence * p_wk + (1 - data_confidence) * 0.45 * avg(p_wk) OVER s AS pred_wk_raw
FROM fp WINDOW s AS (PARTITION BY fixture_id, side)""",
        "impacted": """
SELECT *, row_number() OVER (PARTITION BY fixture_id, side ORDER BY round(impact_base, 9), xi_place) = 1 AND count(*) OVER (PARTITION BY fixture_id, side) >= 12 AS dropped FROM (
  SELECT *, predicted_runs + 25.0 * predicted_wickets + CASE WHEN role_encoded = 1 THEN 18.0 * predicted_wickets ELSE 0.0 END AS impact_base FROM (
    SELECT *, pred_runs_raw * playing_prob AS predicted_runs, pred_wk_raw * playing_prob AS predicted_wickets FROM shrunk) a) b""",
        "expected": """
SELECT fixture_id, side, player_id, xi_place, role_encoded, strike_rate, economy, bowling_style, wk_mult,
       predicted_runs * CASE side WHEN 1 THEN first_innings_runs ELSE second_innings_runs END AS predicted_runs,
       predicted_wickets * CASE side WHEN 1 THEN first_innings_wickets ELSE second_innings_wickets END * wk_mult AS predicted_wickets
FROM (SELECT i.*, f.first_innings_runs, f.second_innings_runs, f.first_innings_wickets, f.second_innings_wickets,
             CASE WHEN venue_spin_harshness <= 0 THEN 1.0 ELSE greatest(least(CASE bowling_style WHEN 'spin' THEN 1.0 - 0.24 * venue_spin_harshness
                  WHEN 'pace' THEN 1.0 + 0.07 * venue_spin_harshness ELSE 1.0 END, 1.35), 0.35) END AS wk_mult
      FROM impacted i JOIN fix1 f ON f.fixture_id = i.fixture_id WHERE NOT dropped) x""",
        "sidesum": """
SELECT fixture_id, sum(CASE WHEN side = 1 THEN predicted_runs END) AS raw1, sum(CASE WHEN side = 2 THEN predicted_runs END) AS raw2,
       sum(CASE WHEN side = 1 THEN predicted_wickets END) AS wickets_by_1, sum(CASE WHEN side = 2 THEN predicted_wickets END) AS wickets_by_2
FROM expected GROUP BY fixture_id""",
        "six_bats": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id, side ORDER BY round(predicted_runs, 9) DESC, xi_place) AS k FROM (
  SELECT *, sum((role_encoded <> 1)::INT) OVER (PARTITION BY fixture_id, side) AS nb FROM expected) a WHERE role_encoded <> 1 OR nb < 4) b WHERE k <= 6""",
        "dyn": "SELECT fixture_id, side, 1.0 + least(0.12, 0.003 * greatest(avg(strike_rate) - 130.0, 0.0)) AS dynamic_mult FROM six_bats GROUP BY fixture_id, side",
        "tg0": """
SELECT *, (first_innings_runs + second_innings_runs) / 2.0 AS mult,
       greatest(least(CASE WHEN ml1 IS NOT NULL THEN ml1 * first_innings_runs ELSE 165.0 / greatest((raw1 + raw2) / 2.0, 45.0) * raw1 END, 255.0), 110.0) AS a1,
       greatest(least(CASE WHEN ml1 IS NOT NULL THEN ml2 * second_innings_runs ELSE 165.0 / greatest((raw1 + raw2) / 2.0, 45.0) * raw2 END, 255.0), 110.0) AS a2
FROM fix1 JOIN sidesum USING (fixture_id)""",
        "tg1": """
SELECT *, CASE WHEN act THEN greatest(least(a1 * sc, 255.0), 110.0) ELSE a1 END AS b1, CASE WHEN act THEN greatest(least(a2 * sc, 255.0), 110.0) ELSE a2 END AS b2 FROM (
  SELECT *, greatest(least(1.0 + least(CASE WHEN mult >= 1.35 THEN 0.82 ELSE 0.72 END, 0.28 + (mult - 1.14) * 2.5)
           * (CASE WHEN mult >= 1.35 THEN 196.0 + least(18.0, (mult - 1.14) * 35.0) ELSE 188.0 + least(14.0, (mult - 1.14) * 35.0) END / greatest((a1 + a2) / 2.0, 72.0) - 1.0),
           CASE WHEN mult >= 1.35 THEN 1.65 ELSE 1.55 END), 1.0) AS sc,
         mult >= 1.14 AND (a1 + a2) / 2.0 < CASE WHEN mult >= 1.35 THEN 185.0 ELSE 178.0 END AS act FROM tg0) x""",
        "tg2": """
SELECT *, CASE WHEN lo OR mi THEN greatest(least(b1 * vs, 255.0), 110.0) ELSE b1 END AS c1, CASE WHEN lo OR mi THEN greatest(least(b2 * vs, 255.0), 110.0) ELSE b2 END AS c2 FROM (
  SELECT *, CASE WHEN lo THEN greatest(least((158.0 + h * 28.0 + least(14.0, greatest(0.0, h - 0.35) * 20.0)) / greatest(m, 72.0), 1.55), 1.0)
            ELSE greatest(least((160.0 + h * 48.0) / greatest(m, 80.0), 1.30), 1.0) END AS vs FROM (
    SELECT *, h >= 0.35 AND m < 152.0 AS lo, h >= 0.48 AND m >= 152.0 AND m < 205.0 AND m < 160.0 + h * 48.0 - 6.0 AS mi
    FROM (SELECT *, (b1 + b2) / 2.0 AS m, venue_spin_harshness AS h FROM tg1) x) y) z""",
        "tg3": """
SELECT *, CASE WHEN ml1 IS NOT NULL AND m2 < 132.0 THEN greatest(least(c1 * fs, 255.0), 110.0) ELSE c1 END AS target1,
       CASE WHEN ml1 IS NOT NULL AND m2 < 132.0 THEN greatest(least(c2 * fs, 255.0), 110.0) ELSE c2 END AS target2,
       CASE WHEN ml1 IS NOT NULL THEN 'ml_team_total' ELSE 'raw_sum_anchor' END AS calibration_method FROM (
  SELECT *, greatest(least(greatest(least(165.0 * mult, 178.0), 145.0) / greatest(m2, 72.0), 1.62), 1.0) AS fs FROM (SELECT *, (c1 + c2) / 2.0 AS m2 FROM tg2) x) y""",
        "tg4": """
SELECT t.*, t.target1 * (1.0 + greatest(least(0.20 * (a.bat_first_ratio - 1.0) + 0.10 * (a.pp_bat_ratio - 1.0) - 0.12 * (b.bowl_first_stingy - 1.0) + 0.04 * (a.bat_dom - b.bowl_dom) / 2.5, 0.14), -0.14)) AS tweak1,
       t.target2 * (1.0 + greatest(least(0.20 * (b.chase_ratio - 1.0) + 0.10 * (b.pp_bat_ratio - 1.0) - 0.12 * (a.bowl_second_stingy - 1.0) + 0.04 * (b.bat_dom - a.bowl_dom) / 2.5, 0.14), -0.14)) AS tweak2
FROM tg3 t JOIN prof a ON a.franchise = t.team1_name JOIN prof b ON b.franchise = t.team2_name""",
        "tg5": """
SELECT x.*, raw1 * scale1 AS total1, raw2 * scale2 AS total2 FROM (
  SELECT y.*, CASE WHEN ml1 IS NULL THEN least(final1 / greatest(raw1, 1e-9), 6.0) ELSE final1 / greatest(raw1, 1e-9) END AS scale1,
         CASE WHEN ml1 IS NULL THEN least(final2 / greatest(raw2, 1e-9), 6.0) ELSE final2 / greatest(raw2, 1e-9) END AS scale2 FROM (
    SELECT t.*, greatest(least(tweak1 * d1.dynamic_mult, 255.0), 110.0) AS final1, greatest(least(tweak2 * d2.dynamic_mult, 255.0), 110.0) AS final2
    FROM tg4 t JOIN dyn d1 ON d1.fixture_id = t.fixture_id AND d1.side = 1 JOIN dyn d2 ON d2.fixture_id = t.fixture_id AND d2.side = 2) y) x""",
        "scaled": """
SELECT e.* EXCLUDE (predicted_runs), predicted_runs * CASE side WHEN 1 THEN scale1 ELSE scale2 END AS predicted_runs,
       t.team1_name FROM expected e JOIN tg5 t ON t.fixture_id = e.fixture_id""",
        "mcp": """
SELECT *, CASE side WHEN 1 THEN f1 * scale1 ELSE f2 * scale2 END AS factor,
       0.15 * greatest(greatest(pred_runs_raw, 0.0), 1e-9) * (1 + 0.45 * tanh(greatest(std_runs, 0.0) / greatest(med_r, 1e-6))) AS sr,
       0.15 * greatest(greatest(pred_wk_raw, 0.0), 1e-9) * (1 + 0.45 * tanh(greatest(std_wickets, 0.0) / greatest(med_w, 1e-6))) AS sw
FROM (SELECT s.*, t.first_innings_runs AS f1, t.second_innings_runs AS f2, t.scale1, t.scale2,
             median(std_runs) OVER (PARTITION BY s.fixture_id, side) AS med_r, median(std_wickets) OVER (PARTITION BY s.fixture_id, side) AS med_w
      FROM shrunk s JOIN tg5 t ON t.fixture_id = s.fixture_id) x""",
        "mcd": """
SELECT *, md5(concat('42|', CAST(fixture_id AS VARCHAR), '|', CAST(side AS VARCHAR), '|', player_id, '|', CAST(replicate AS VARCHAR))) AS d
FROM mcp, (SELECT unnest(range(1, 21)) AS replicate) n""",
        "mcn": """
SELECT fixture_id, side, replicate, factor, role_encoded,
       greatest(pred_runs_raw + sr * sqrt(-2.0 * ln(u1)) * cos(v1 * 2.0 * pi()), 0.0) * playing_prob AS runs,
       greatest(pred_wk_raw + sw * sqrt(-2.0 * ln(u2)) * cos(v2 * 2.0 * pi()), 0.0) * playing_prob AS wickets
FROM (SELECT *, (CAST(CAST('0x' || substr(d, 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0 AS u1, (CAST(CAST('0x' || substr(d, 9, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0 AS v1,
             (CAST(CAST('0x' || substr(d, 17, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0 AS u2, (CAST(CAST('0x' || substr(d, 25, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0 AS v2 FROM mcd) x""",
        "mct": """
SELECT fixture_id, replicate, side, sum(runs * factor) - CASE WHEN count(*) >= 12 THEN arg_min(runs * factor, runs + 25.0 * wickets + CASE WHEN role_encoded = 1 THEN 18.0 * wickets ELSE 0.0 END) ELSE 0.0 END AS total
FROM mcn GROUP BY fixture_id, replicate, side""",
        "mc": """
SELECT a.fixture_id, avg((a.total > b.total)::INT) AS sim_p_team1, count(*) AS replicates
FROM mct a JOIN mct b ON a.fixture_id = b.fixture_id AND a.replicate = b.replicate AND a.side = 1 AND b.side = 2 GROUP BY a.fixture_id""",
        "boards": """
SELECT fixture_id, max(CASE WHEN kb = 1 THEN player_id END) AS best_bat, max(CASE WHEN kw = 1 THEN player_id END) AS best_bowl,
       string_agg(CASE WHEN kb <= 5 THEN player_id END, ',' ORDER BY kb) AS top5, string_agg(CASE WHEN kw <= 3 THEN player_id END, ',' ORDER BY kw) AS top3
FROM (SELECT *, CASE WHEN okb OR nb < 5 THEN row_number() OVER (PARTITION BY fixture_id ORDER BY (okb OR nb < 5) DESC, round(predicted_runs, 9) DESC, side, xi_place) END AS kb,
             CASE WHEN okw OR nw < 3 THEN row_number() OVER (PARTITION BY fixture_id ORDER BY (okw OR nw < 3) DESC, round(predicted_wickets, 9) DESC, side, xi_place) END AS kw
      FROM (SELECT *, role_encoded <> 1 AS okb, role_encoded IN (1, 2) AS okw, sum((role_encoded <> 1)::INT) OVER (PARTITION BY fixture_id) AS nb,
                   sum((role_encoded IN (1, 2))::INT) OVER (PARTITION BY fixture_id) AS nw FROM scaled) a) b GROUP BY fixture_id""",
        "potm": """
SELECT fixture_id, player_id AS potm, sc AS potm_score FROM (SELECT *, CASE WHEN role_encoded = 0 THEN 1.1 * predicted_runs + 18.0 * predicted_wickets WHEN role_encoded = 2 THEN 0.45 * predicted_runs + 28.0 * predicted_wickets
       ELSE predicted_runs + 25.0 * predicted_wickets END + CASE WHEN predicted_runs > 50 THEN 10.0 ELSE 0.0 END + CASE WHEN predicted_wickets >= 3 THEN 15.0 ELSE 0.0 END AS sc FROM scaled) x
QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY round(sc, 9) DESC, side, xi_place) = 1""",
        "outcome": """
SELECT t.*, m.sim_p_team1, o.best_bat, o.best_bowl, o.top5, o.top3, p.potm,
       greatest(least(coalesce(0.6 * ml_p_team1 + 0.4 * sim_p_team1, sim_p_team1), 0.98), 0.02) AS ensemble_p_team1
FROM tg5 t JOIN mc m ON m.fixture_id = t.fixture_id JOIN boards o ON o.fixture_id = t.fixture_id JOIN potm p ON p.fixture_id = t.fixture_id""",
    }
)

_MULT = pitch.MULTIPLIERS


@query("h09_h11_pitch_multipliers", f"SELECT fixture_id, {r(*_MULT)} FROM fix1")
def _(spark, sf):
    rows = views.scored_fixtures(spark, sf)
    priced = on_distinct(rows, ["pitch_text", "venue"], pitch.resolve_multipliers(F.col("pitch_text"), F.col("venue")))
    return rounded(priced.select("fixture_id", *_MULT))


@query("h09_high_par_reports", f"SELECT fixture_id, high, {r('lift')} FROM pitched")
def _(spark, sf):
    rows = views.scored_fixtures(spark, sf).select("fixture_id", "pitch_text")
    judged = {"high": pitch.is_high_par(F.col("pitch_text")), "lift": pitch.par_lift(F.col("pitch_text"))}
    return rounded(on_distinct(rows, ["pitch_text"], judged).drop("pitch_text"))


@query("h12_venue_harshness", f"SELECT fixture_id, {r('venue_spin_harshness')} FROM fix1")
def _(spark, sf):
    rows = views.scored_fixtures(spark, sf).select("fixture_id", "venue")
    return rounded(
        on_distinct(rows, ["venue"], {"venue_spin_harshness": pitch.venue_spin_harshness(F.col("venue"))}).drop("venue")
    )


_BOWLERS = ("Rashid Khan", "JJ Bumrah", "R Ashwin", "Rahul Chahar", "Deepak Chahar", "Some Body", "YS Chahal", "Sam Curran", "M Ali")
_MARKED = " OR ".join(f"contains(lower(p), '{m}')" for m in pitch.SPIN_MARKERS)
_PACED = " OR ".join(f"contains(lower(p), '{m}')" for m in pitch.PACE_MARKERS)


@query(
    "h14_bowling_style",
    f"""SELECT style, count(*) AS n FROM (SELECT CASE WHEN k % 13 = 0 THEN 'pace' WHEN {_MARKED} OR p LIKE '% Ashwin' THEN 'spin' WHEN {_PACED} THEN 'pace' ELSE 'unknown' END AS style
    FROM (SELECT c_custkey AS k, list_extract([{views._sql_texts(_BOWLERS)}], CAST(c_custkey % 9 + 1 AS INTEGER)) AS p FROM customer) x) y GROUP BY style""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "customer").selectExpr(
        f"element_at(array({views._sql_texts(_BOWLERS)}), CAST(c_custkey % 9 + 1 AS INT)) AS p",
        "CASE WHEN c_custkey % 13 = 0 THEN ' Pace ' WHEN c_custkey % 13 = 1 THEN 'leg' END AS given",
    )
    styled = on_distinct(rows, ["p", "given"], {"style": pitch.bowling_style(F.col("p"), F.col("given"))})
    return styled.groupBy("style").agg(F.count(F.lit(1)).alias("n"))


def _expected(spark, sf):
    return scoring.expected_players(scoring.by_fixture(views.priced_players(spark, sf)))


@query("j03_confidence_shrinkage", f"SELECT fixture_id, side, player_id, {r('pred_runs_raw', 'pred_wk_raw')} FROM shrunk")
def _(spark, sf):
    rows = scoring.shrink_to_team(scoring.by_fixture(views.priced_players(spark, sf)))
    return rounded(rows.select("fixture_id", "side", "player_id", "pred_runs_raw", "pred_wk_raw"))


@query("j06_f04_impact_and_drop", f"SELECT fixture_id, side, player_id, dropped, {r('predicted_runs', 'predicted_wickets', 'impact_base')} FROM impacted")
def _(spark, sf):
    rows = scoring.shrink_to_team(scoring.by_fixture(views.priced_players(spark, sf)))
    rows = scoring.drop_lowest_of_twelve(scoring.apply_playing_probability(rows))
    return rounded(rows.select("fixture_id", "side", "player_id", "dropped", "predicted_runs", "predicted_wickets", "impact_base"))


@query("j04_j05_pitch_and_style", f"SELECT fixture_id, side, player_id, {r('wk_mult', 'predicted_runs', 'predicted_wickets')} FROM expected")
def _(spark, sf):
    rows = _expected(spark, sf).withColumnRenamed("venue_wk_mult", "wk_mult")
    return rounded(rows.select("fixture_id", "side", "player_id", "wk_mult", "predicted_runs", "predicted_wickets"))


@query(
    "j16_innings_wickets",
    f"SELECT fixture_id, {r('raw1', 'raw2', 'wickets_by_1', 'wickets_by_2', 'pred_wickets_first_innings', 'pred_wickets_second_innings')} FROM (SELECT *, least(wickets_by_2, 10.0) AS pred_wickets_first_innings, least(wickets_by_1, 10.0) AS pred_wickets_second_innings FROM sidesum) x",
)
def _(spark, sf):
    return rounded(scoring.innings_wickets(scoring.side_totals(_expected(spark, sf))))


def _targets(spark, sf):
    totals = scoring.side_totals(_expected(spark, sf))
    return scoring.innings_targets(views.priced_fixture_table(spark, sf).join(totals, "fixture_id"))


@query("j07_innings_targets", f"SELECT fixture_id, calibration_method, {r('target1', 'target2')} FROM tg3")
def _(spark, sf):
    return rounded(_targets(spark, sf).select("fixture_id", "calibration_method", "target1", "target2"))


@query("j08_profile_tweak", f"SELECT fixture_id, {r('target1', 'target2')} FROM (SELECT fixture_id, tweak1 AS target1, tweak2 AS target2 FROM tg4) x")
def _(spark, sf):
    return rounded(scoring.profile_tweak(_targets(spark, sf)).select("fixture_id", "target1", "target2"))


@query("j09_f11_dynamic_par", f"SELECT fixture_id, side, {r('dynamic_mult')} FROM dyn")
def _(spark, sf):
    return rounded(scoring.dynamic_par(_expected(spark, sf)))


_ROSTER = ("form_runs", "form_wickets", "form_runs_ipl", "form_wickets_ipl", "strike_rate", "economy", "strength")


@query(
    "j11_roster_metrics",
    f"""SELECT fixture_id, side, {r(*_ROSTER)} FROM (SELECT *, 0.4 * form_runs_ipl + 0.3 * strike_rate + 0.3 * form_wickets_ipl AS strength FROM (
    SELECT fixture_id, side, avg(form_runs) AS form_runs, avg(form_wickets) AS form_wickets, avg(form_runs_ipl) AS form_runs_ipl, avg(form_wickets_ipl) AS form_wickets_ipl,
    avg(strike_rate) AS strike_rate, avg(economy) AS economy FROM fp GROUP BY fixture_id, side) a) b""",
)
def _(spark, sf):
    return rounded(scoring.roster_metrics(views.priced_players(spark, sf)))


def _scored(spark, sf):
    return scoring.score_fixtures(views.priced_fixture_table(spark, sf), views.priced_players(spark, sf), replicates=20)


@query("j10_scaled_players", f"SELECT fixture_id, side, player_id, {r('predicted_runs')} FROM scaled")
def _(spark, sf):
    return rounded(_scored(spark, sf)[1].select("fixture_id", "side", "player_id", "predicted_runs"))


@query("f01_f02_leaderboards", "SELECT fixture_id, top5, top3 FROM boards")
def _(spark, sf):
    scaled = _scored(spark, sf)[1]

    def listed(rows, out):
        packed = F.sort_array(F.collect_list(F.struct("place", "player_id")))
        return rows.groupBy("fixture_id").agg(F.array_join(F.transform(packed, lambda x: x["player_id"]), ",").alias(out))

    return listed(scoring.top_batters(scaled), "top5").join(listed(scoring.top_bowlers(scaled), "top3"), "fixture_id", "full")


@query("f03_h13_player_of_match", f"SELECT fixture_id, potm, {r('potm_score')} FROM potm")
def _(spark, sf):
    return rounded(scoring.player_of_match(_scored(spark, sf)[1]))


@query("j13_monte_carlo", f"SELECT fixture_id, replicates, {r('sim_p_team1')} FROM mc")
def _(spark, sf):
    rows = _scored(spark, sf)[0]
    return rounded(rows.select("fixture_id", "replicates", "sim_p_team1"))


@query(
    "j14_ensemble_probability",
    f"""SELECT fixture_id, {r('blended', 'stacked', 'ml_only')} FROM (SELECT fixture_id, greatest(least(coalesce(0.6 * ml_p_team1 + 0.4 * s, s), 0.98), 0.02) AS blended, greatest(least(coalesce(ml_p_team1, s), 0.98), 0.02) AS ml_only,
    greatest(least(coalesce(1 / (1 + exp(-(0.1 + 0.8 * ln(greatest(least(ml_p_team1, 0.999999), 0.000001) / (1 - greatest(least(ml_p_team1, 0.999999), 0.000001))) + 0.3 * ln(s / (1 - s))))), s), 0.98), 0.02) AS stacked
    FROM (SELECT *, 1 / (1 + exp(-(coalesce(ml1, 150) - coalesce(ml2, 150)) / 22.0)) AS s FROM fix0) x) y""",
)
def _(spark, sf):
    rows = views.scored_fixtures(spark, sf)
    sim = scoring.sim_proxy(F.coalesce("ml1", F.lit(150.0)), F.coalesce("ml2", F.lit(150.0)))
    ml = F.col("ml_p_team1")
    return rounded(
        rows.withColumn("s", sim).select(
            "fixture_id",
            scoring.ensemble_probability(ml, F.col("s")).alias("blended"),
            scoring.ensemble_probability(ml, F.col("s"), stack={"coef": [0.8, 0.3], "intercept": 0.1}).alias("stacked"),
            scoring.ensemble_probability(ml, F.col("s"), w_ml=1.0, w_sim=0.0).alias("ml_only"),
        )
    )


_OUT = ("total1", "total2", "p_team1_win", "p_predicted_winner")


@query(
    "j15_h24_six_outcomes",
    f"""SELECT fixture_id, winning_team, win_probability_basis, best_bat, best_bowl, potm, {r(*_OUT)}, CASE WHEN greatest(p_team1_win, 1 - p_team1_win) > 0.65 THEN 'HIGH' WHEN greatest(p_team1_win, 1 - p_team1_win) >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
    FROM (SELECT *, CASE WHEN p_team1_win > 0.5 THEN team1_name WHEN p_team1_win < 0.5 THEN team2_name ELSE 'tie' END AS winning_team, CASE WHEN p_team1_win > 0.5 THEN p_team1_win WHEN p_team1_win < 0.5 THEN 1 - p_team1_win END AS p_predicted_winner,
    'hybrid_ensemble' AS win_probability_basis FROM (SELECT *, ensemble_p_team1 AS p_team1_win FROM outcome) a) b""",
)
def _(spark, sf):
    rows = _scored(spark, sf)[0]
    band = cricket.confidence_band(F.greatest(F.col("p_team1_win"), F.lit(1.0) - F.col("p_team1_win")))
    return rounded(
        rows.select("fixture_id", "winning_team", "win_probability_basis", "best_bat", "best_bowl", "potm", *_OUT, band.alias("confidence"))
    )


@query(
    "j18_prediction_records",
    f"""SELECT match_key, pred_winner, pred_best_bat, pred_best_bowl, pred_potm, bats, bowls, {r('pred_p_team1_win', 'pred_first', 'pred_second')} FROM (SELECT concat(CAST(fixture_id AS VARCHAR), '-key') AS match_key,
    CASE WHEN ensemble_p_team1 > 0.5 THEN team1_name WHEN ensemble_p_team1 < 0.5 THEN team2_name ELSE 'tie' END AS pred_winner, best_bat AS pred_best_bat, best_bowl AS pred_best_bowl, potm AS pred_potm, top5 AS bats, top3 AS bowls,
    ensemble_p_team1 AS pred_p_team1_win, total1 AS pred_first, total2 AS pred_second FROM outcome) x""",
)
def _(spark, sf):
    from creaseline.plans.predlog import predicted_innings

    rows = _scored(spark, sf)[0].withColumns(
        {"match_key": F.concat(F.col("fixture_id").cast("string"), F.lit("-key")), "batting_order_swapped": F.lit(False)}
    )
    records = scoring.prediction_records(rows)
    totals = predicted_innings(F.col("pred_extra_json"))
    return rounded(
        records.select(
            "match_key", "pred_winner", "pred_best_bat", "pred_best_bowl", "pred_potm", F.array_join("pred_top5_bats", ",").alias("bats"),
            F.array_join("pred_top3_bowls", ",").alias("bowls"), "pred_p_team1_win",
            totals["pred_first_innings_team_runs"].alias("pred_first"), totals["pred_second_innings_team_runs"].alias("pred_second"),
        )
    )


@query(
    "j21_probability_breakdown",
    f"SELECT fixture_id, team1_name, 'hybrid_ensemble' AS win_probability_basis, coalesce(abs(sim_p_team1 - ml_p_team1) >= 0.1, FALSE) AS sources_differ, {r('sim_p_team1', 'ml_p_team1')}, round(ensemble_p_team1 + 1e-9, 6) + 0.0 AS headline_p FROM outcome",
)
def _(spark, sf):
    return rounded(scoring.probability_breakdown(_scored(spark, sf)[0]))


def _fixture_lists(spark, sf):
    """Fixtures with both rosters as arrays, gathered from the players of each side."""
    players = views.fixture_players(spark, sf)

    def listed(s):
        packed = F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("xi_place", "player_id"))))
        return F.transform(packed, lambda x: x["player_id"])

    lists = players.groupBy("fixture_id").agg(listed(1).alias("xi1"), listed(2).alias("xi2"))
    return views.scored_fixtures(spark, sf).join(lists, "fixture_id")


@query("c24_explode_elevens", "SELECT fixture_id, side, player_id, CAST(xi_place AS INTEGER) AS xi_place, team, opponent FROM fp")
def _(spark, sf):
    return scoring.explode_elevens(_fixture_lists(spark, sf)).select("fixture_id", "side", "player_id", "xi_place", "team", "opponent")


@query(
    "b31_eleven_problems",
    """SELECT fixture_id, side, CASE WHEN k > 12 THEN 'too many players' WHEN k < 11 THEN 'too few players' ELSE 'duplicate player' END AS problem FROM (
    SELECT *, CASE WHEN fixture_id % 10 = 3 THEN least(n, 10) + 1 WHEN fixture_id % 10 = 4 AND side = 2 THEN least(n, 9) ELSE n END AS k FROM rosters) x WHERE k NOT IN (11, 12) OR fixture_id % 10 = 3""",
)
def _(spark, sf):
    rows = _fixture_lists(spark, sf)
    ten = F.col("fixture_id") % 10
    doubled = rows.withColumns(
        {
            "xi1": F.when(ten == 3, F.concat(F.slice("xi1", 1, 10), F.slice("xi1", 1, 1))).otherwise(F.col("xi1")),
            "xi2": F.when(ten == 3, F.concat(F.slice("xi2", 1, 10), F.slice("xi2", 2, 1))).when(ten == 4, F.slice("xi2", 1, 9)).otherwise(F.col("xi2")),
        }
    )
    return scoring.eleven_problems(doubled)


@query(
    "j17_impact_substitutes",
    """SELECT fixture_id, CAST(CASE WHEN fixture_id % 4 = 0 AND c1 = 11 THEN 12 ELSE c1 END AS INTEGER) AS n1, c2 AS n2, fixture_id % 4 = 2 OR (fixture_id % 4 = 0 AND c1 <> 11) AS rejected
    FROM (SELECT f.fixture_id, a.n AS c1, b.n AS c2 FROM fix0 f JOIN rosters a ON a.fixture_id = f.fixture_id AND a.side = 1 JOIN rosters b ON b.fixture_id = f.fixture_id AND b.side = 2) x""",
)
def _(spark, sf):
    four = F.col("fixture_id") % 4
    rows = _fixture_lists(spark, sf).withColumns(
        {"impact1": F.when(four == 0, "Sub Player").when(four == 2, F.get("xi1", F.lit(3))), "impact2": F.lit(None).cast("string")}
    )
    good, bad = scoring.add_impact_players(rows)

    def sized(df, rejected):
        return df.select("fixture_id", F.size("xi1").alias("n1"), F.size("xi2").alias("n2"), F.lit(rejected).alias("rejected"))

    return sized(good, False).unionByName(sized(bad, True))


def _history(spark, sf):
    """History rows with matchup inputs; stadium names give venues that fixtures can match."""
    from creaseline.functions.franchise import stadium_of_city

    stats_rows = views.player_match(spark, sf).select("match_id", "player_id", "date", "balls", "balls_bowled", "runs_conceded")
    rows = views.player_features(spark, sf).join(stats_rows, ["match_id", "player_id"])
    city = F.expr(f"element_at(array({views.CITIES}), CAST(match_id % 10 + 1 AS INT))")
    return rows.withColumn("venue", stadium_of_city(city))


CTES.update(
    {
        "hist": """
SELECT f.*, coalesce(stadium, trim(c)) AS hvenue FROM (SELECT *, list_extract(["""
        + views.CITIES
        + """], CAST(match_id % 10 + 1 AS INTEGER)) AS c FROM feat) f LEFT JOIN stadiums ON city = trim(c)""",
        "vpairs": """
SELECT q.venue, v.hvenue FROM (SELECT DISTINCT venue FROM fix0) q, (SELECT DISTINCT hvenue FROM hist) v
WHERE contains(lower(v.hvenue), lower(trim(q.venue))) OR len(list_filter(regexp_extract_all(lower(q.venue), '[a-z]{4,}'), lambda t: contains(lower(v.hvenue), t))) > 0""",
    }
)


@query(
    "c12_venue_preferred_row",
    f"""WITH newest AS (SELECT player_id, hvenue, max(struct_pack(d := date, m := match_id, v := hvenue, fr := form_runs)) AS b FROM hist GROUP BY player_id, hvenue)
    SELECT fixture_id, side, player_id, b.m AS row_match_id, at_venue, round(b.fr + 1e-9, 6) + 0.0 AS form_runs FROM (
    SELECT fp.fixture_id, fp.side, fp.player_id, coalesce(max(CASE WHEN vp.venue IS NOT NULL THEN n.b END), max(n.b)) AS b, bool_or(vp.venue IS NOT NULL) AS at_venue
    FROM fp JOIN fix0 f ON f.fixture_id = fp.fixture_id JOIN newest n ON n.player_id = fp.player_id LEFT JOIN vpairs vp ON vp.venue = f.venue AND vp.hvenue = n.hvenue GROUP BY fp.fixture_id, fp.side, fp.player_id) x""",
)
def _(spark, sf):
    players = views.fixture_players(spark, sf).select("fixture_id", "side", "player_id").join(
        views.scored_fixtures(spark, sf).select("fixture_id", "venue"), "fixture_id"
    )
    rows = scoring.latest_at_venue(players, _history(spark, sf), ["form_runs"])
    return rounded(rows.select("fixture_id", "side", "player_id", "row_match_id", "at_venue", "form_runs"))


@query(
    "e16_head_to_head",
    f"""SELECT player_id, asked, {r('h2h_batting_sr', 'h2h_bowling_sr')} FROM (SELECT player_id, lower(opponent_team) AS asked,
    greatest(least(coalesce(avg(CASE WHEN balls > 0 THEN runs / balls * 100.0 END), avg(batting_matchup_sr)), 220.0), 40.0) AS h2h_batting_sr,
    greatest(least(coalesce(avg(CASE WHEN balls_bowled > 0 THEN runs_conceded / balls_bowled * 100.0 END), avg(bowling_matchup_sr)), 220.0), 40.0) AS h2h_bowling_sr
    FROM (SELECT *, row_number() OVER (PARTITION BY player_id, opponent_team ORDER BY date DESC, match_id DESC) AS k FROM feat) x WHERE k <= 12 GROUP BY player_id, opponent_team) y""",
)
def _(spark, sf):
    met = scoring.head_to_head(_history(spark, sf), views.player_features(spark, sf).select(F.col("opponent_team").alias("opponent")))
    return rounded(met.withColumnRenamed("_asked", "asked"))


@query(
    "j01_fixture_player_rows",
    f"""WITH newest AS (SELECT player_id, max(struct_pack(d := date, m := match_id, ob := opponent_past_batting_strength, ow := opponent_past_bowling_strength, bm := batting_matchup_sr, wm := bowling_matchup_sr, r := role)) AS b FROM feat GROUP BY player_id),
    tl AS (SELECT team, arg_max(past_batting_strength, struct_pack(d := date, m := match_id)) AS tb, arg_max(past_bowling_strength, struct_pack(d := date, m := match_id)) AS tw FROM team_past WHERE past_batting_strength IS NOT NULL GROUP BY team),
    h2h AS (SELECT player_id, opponent_team, greatest(least(coalesce(avg(CASE WHEN balls > 0 THEN runs / balls * 100.0 END), avg(batting_matchup_sr)), 220.0), 40.0) AS hb,
    greatest(least(coalesce(avg(CASE WHEN balls_bowled > 0 THEN runs_conceded / balls_bowled * 100.0 END), avg(bowling_matchup_sr)), 220.0), 40.0) AS hw
    FROM (SELECT *, row_number() OVER (PARTITION BY player_id, opponent_team ORDER BY date DESC, match_id DESC) AS k FROM feat) x WHERE k <= 12 GROUP BY player_id, opponent_team)
    SELECT fixture_id, side, player_id, {r('opponent_strength', 'batting_matchup_sr', 'bowling_matchup_sr')} FROM (SELECT fp.fixture_id, fp.side, fp.player_id, coalesce(hb, b.bm) AS batting_matchup_sr, coalesce(hw, b.wm) AS bowling_matchup_sr,
    CASE b.r WHEN 'batter' THEN coalesce(tw, b.ow) WHEN 'bowler' THEN coalesce(tb, b.ob) ELSE (coalesce(tb, b.ob) + coalesce(tw, b.ow)) / 2.0 END AS opponent_strength
    FROM fp JOIN newest n ON n.player_id = fp.player_id LEFT JOIN tl ON tl.team = fp.opponent LEFT JOIN h2h h ON h.player_id = fp.player_id AND h.opponent_team = fp.opponent) z""",
)
def _(spark, sf):
    history = _history(spark, sf).join(views.player_match(spark, sf).select("match_id", "player_id", "role"), ["match_id", "player_id"])
    players = views.fixture_players(spark, sf).select("fixture_id", "side", "player_id", "opponent").withColumn("venue", F.lit(None).cast("string"))
    columns = ["opponent_past_batting_strength", "opponent_past_bowling_strength", "batting_matchup_sr", "bowling_matchup_sr", "role", "opponent_strength"]
    rows = scoring.latest_at_venue(players, history, columns)
    past = features.team_past_strength(features.team_match_strength(features.with_team_and_rates(views.player_match(spark, sf))))
    rows = scoring.with_head_to_head(scoring.with_latest_opponent_strength(rows, past), history)
    return rounded(rows.select("fixture_id", "side", "player_id", "opponent_strength", "batting_matchup_sr", "bowling_matchup_sr"))


@query(
    "c23_stat_extras_join",
    f"SELECT match_id, player_id, venue, balls, balls_bowled, {r('runs_conceded')} FROM pms",
)
def _(spark, sf):
    from creaseline.operators.windows import keep_one

    extras = keep_one(
        views.player_match(spark, sf).select("match_id", "player_id", "venue", "balls", "balls_bowled", "runs_conceded"),
        ["match_id", "player_id"], [F.asc_nulls_last("venue")],
    )
    return rounded(views.player_features(spark, sf).select("match_id", "player_id").join(extras, ["match_id", "player_id"], "left"))
