"""Known input and output cases of names, texts, calibration and scoring."""

import pytest
from pyspark.sql import functions as F

from creaseline.functions import cricket, franchise, pitch, text
from creaseline.operators.containment import best_loose_match, venue_query_pairs
from creaseline.plans import features, identity, scoring


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(
    "name,expected",
    [
        ("MI", "Mumbai Indians"),
        ("Kings XI Punjab", "Punjab Kings"),
        ("Royal Challengers Bengaluru", "Royal Challengers Bangalore"),
        ("Some New Team", "Some New Team"),
    ],
)
def test_canonical_franchise(spark, name, expected):
    df = spark.createDataFrame([(name,)], "t string")
    assert one(df.select(franchise.canonical_franchise("t"))) == expected


def test_form_uses_prior_matches_only(spark):
    rows = [("p1", "A", "B", 10, 0, r, 0.0, 0, i, f"2024-01-0{i}") for i, r in ((1, 50.0), (2, 60.0), (3, 70.0))]
    df = spark.createDataFrame(
        rows,
        "player_id string, batting_team string, bowling_team string, balls int, balls_bowled int, runs double, runs_conceded double, wickets int, match_id long, d string",
    ).withColumn("date", F.to_date("d"))
    out = features.rolling_features(features.with_team_and_rates(df), with_franchise_form=False)
    assert [r.form_runs for r in out.orderBy("match_id").collect()] == [0.0, 50.0, 55.0]


def test_squad_resolution_steps(spark):
    squads = spark.createDataFrame(
        [("Kolkata Knight Riders", "Finn Allen", 1), ("Kolkata Knight Riders", "Rinku Singh", 0), ("X", "Ab Cd", 0), ("X", "Ax Cd", 0)],
        "team string, player_id string, is_overseas int",
    )
    bridge = spark.createDataFrame(
        [("kolkata knight riders", "RK Singh", "rk singh", "Rinku Singh")],
        "franchise_key string, stats_player_id string, stats_player_id_norm string, squad_player_name string",
    )
    asked = spark.createDataFrame(
        [("Kolkata Knight Riders", "finn allen"), ("Kolkata Knight Riders", "RK Singh"), ("Kolkata Knight Riders", "Fin Allen"),
         ("Kolkata Knight Riders", "F Allen"), ("X", "A Cd"), ("X", "Ab Cd")],
        "team string, player_id string",
    )
    got = {(r.team, r.player_id): (r.squad_player, r.method) for r in identity.resolve_to_squad(asked, squads, bridge).collect()}
    k = "Kolkata Knight Riders"
    assert got[(k, "finn allen")] == ("Finn Allen", "exact")
    assert got[(k, "RK Singh")] == ("Rinku Singh", "bridge")
    assert got[(k, "Fin Allen")] == ("Finn Allen", "similar")
    assert got[(k, "F Allen")] == (None, "unresolved")
    assert got[("X", "A Cd")] == (None, "unresolved")
    assert got[("X", "Ab Cd")] == ("Ab Cd", "exact")


def test_ensemble_probability_bounds(spark):
    df = spark.createDataFrame([(0.001, 0.001), (0.999, 0.999), (None, 0.4), (0.7, None), (None, None)], "m double, s double")
    got = [r[0] for r in df.select(scoring.ensemble_probability(F.col("m"), F.col("s"))).collect()]
    assert got[:2] == [0.02, 0.98]
    assert got[2:4] == [0.4, 0.7]


def test_venue_and_franchise_matching(spark):
    venues = spark.createDataFrame([("Bharat Ratna Shri Atal Bihari Vajpayee Ekana Cricket Stadium, Lucknow",), ("",)], "v string")
    asked = spark.createDataFrame([("Ekana",), ("Mumbai",), ("",)], "q string")
    assert [(r.q, r.v[:6]) for r in venue_query_pairs(asked, venues, "q", "v").collect()] == [("Ekana", "Bharat")]
    known = spark.createDataFrame([("mumbai indians",), ("delhi capitals",)], "known string")
    asked = spark.createDataFrame([("mumbai",), ("delhi capitals",), ("nobody",)], "asked string")
    got = {r.asked: r.known for r in best_loose_match(asked, known).collect()}
    assert got == {"mumbai": "mumbai indians", "delhi capitals": "delhi capitals"}


BELTER = (
    "Eden Gardens belter. Last year 199 was the average score batting first. "
    "Expect more than 200 when chasing. Fours and sixes everywhere."
)
HIGH_PAR = (
    "Narendra Modi Stadium. Grass and tramlines for fast bowlers to aim at. "
    "Average score here 216, economy 10.2 for fast bowlers. High scoring run chase. It's a 200-run ground today."
)
GALORE = (
    "Arun Jaitley Stadium Delhi. Very high scoring (250, runs galore). "
    "Small ground. Last season average first innings ~198 at this ground."
)


def multipliers(spark, report, venue=None):
    df = spark.createDataFrame([(report, venue)], "t string, v string")
    return df.select(*[c.alias(n) for n, c in pitch.resolve_multipliers(F.col("t"), F.col("v")).items()]).first()


def test_pitch_reports(spark):
    m = multipliers(spark, BELTER)
    assert m.first_innings_runs > 1.4 and m.second_innings_runs > 1.4
    assert multipliers(spark, HIGH_PAR).first_innings_runs > 1.35
    flat = "Flat deck, good for batting."
    assert (
        multipliers(spark, flat, "Narendra Modi Stadium, Ahmedabad").first_innings_runs
        > multipliers(spark, flat).first_innings_runs
    )
    assert multipliers(spark, GALORE, "Arun Jaitley Stadium, Delhi").first_innings_runs > 1.55
    neutral = multipliers(spark, None)
    assert tuple(neutral) == (1.0, 1.0, 1.0, 1.0)


def targets(spark, raw, ml, mult, venue):
    df = spark.createDataFrame(
        [(*[float(x) for x in raw], *ml, *mult, venue)],
        "raw1 double, raw2 double, ml1 double, ml2 double, first_innings_runs double, second_innings_runs double, v string",
    ).withColumn("venue_spin_harshness", pitch.venue_spin_harshness(F.col("v")))
    return scoring.run_scales(scoring.innings_targets(df)).first()


def test_anchor_lifts_low_sums(spark):
    t = targets(spark, (40, 50), (None, None), (1.0, 1.0), None)
    assert t.calibration_method == "raw_sum_anchor"
    assert t.target1 > 100 and t.target2 > 100 and t.scale1 > 1.5 and t.scale2 > 1.5


def test_high_pitch_blends_model_totals(spark):
    m = multipliers(spark, "Belter. 199 average batting first. More than 200 when chasing. Fours and sixes everywhere.")
    t = targets(spark, (40, 50), (118.0, 120.0), (m.first_innings_runs, m.second_innings_runs), None)
    assert t.calibration_method == "ml_team_total" and (t.target1 + t.target2) / 2 > 170


def test_batting_venue_and_floor(spark):
    t = targets(spark, (40, 50), (97.2, 100.8), (1.0, 1.0), "M Chinnaswamy Stadium, Bengaluru")
    assert 150 < (t.target1 + t.target2) / 2 < 200
    t = targets(spark, (40, 50), (119.4, 112.0), (0.983, 0.995), "Some Unknown Ground, Xyz")
    assert (t.target1 + t.target2) / 2 > 145


def test_dynamic_par(spark):
    rows = zip(
        [32.0, 30.0, 28.0, 12.0, 8.0, 4.0, 2.0, 1.0],
        [175.0, 168.0, 160.0, 152.0, 145.0, 140.0, 120.0, 110.0],
        [0, 0, 0, 2, 2, 0, 1, 1],
    )
    df = spark.createDataFrame(
        [(1, 1, i, f"p{i}", r, s, c) for i, (r, s, c) in enumerate(rows)],
        "fixture_id int, side int, xi_place int, player_id string, predicted_runs double, strike_rate double, role_encoded int",
    )
    assert 1.02 < scoring.dynamic_par(df).first().dynamic_mult <= 1.12


def test_impact_favours_bowlers(spark):
    df = spark.createDataFrame([(2.0, 3.0, 1), (30.0, 0.1, 0)], "r double, w double, c int")
    got = [r[0] for r in df.select(cricket.impact_score(F.col("r"), F.col("w"), F.col("c"))).collect()]
    assert got[0] > 77 and got[1] == pytest.approx(32.5)


def test_dismissals_and_names(spark):
    df = spark.createDataFrame(
        [("c Ravindra b Ravindra",), ("c & b Pandya",), ("not out",), ("run out (X)",), ("b Khan, extra",), ("retired hurt",)], "t string"
    )
    got = [r[0] for r in df.select(cricket.bowler_of_dismissal(F.col("t"))).collect()]
    assert got == ["Ravindra", "Pandya", "Unknown", "Unknown", "Khan", "Unknown"]
    names = spark.createDataFrame([("Ｒ．Ｇ.  Sharma",), ("Single",)], "n string")
    rows = names.select(text.normal_name("n").alias("n"), text.name_signature("n").alias("s")).collect()
    assert rows[0].n == "r g sharma"
    assert rows[1].s is None
