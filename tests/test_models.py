"""Models and simulation: closed forms, bounds, persistence and determinism."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creaseline.plans import evaluation, scoring, training


@pytest.fixture(scope="module")
def matches(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        s1, s2, f1, f2 = rng.normal(40, 5), rng.normal(40, 5), rng.normal(25, 4), rng.normal(25, 4)
        edge = (s1 - s2) * 0.25 + rng.normal(0, 1)
        t1, t2 = float(np.clip(150 + 2 * (s1 - 40) + rng.normal(0, 9), 60, 300)), float(np.clip(150 + 2 * (s2 - 40) + rng.normal(0, 9), 60, 300))
        rows.append((i, f"20{10 + i // 40}-0{1 + i % 9}-1{i % 9}", "A", "B", s1, s2, f1, f2, s1 + 80, s2 + 80, 8.0, 8.5, t1, t2, "team1" if edge > 0 else "team2", "official" if i % 3 else "proxy"))
    cols = "match_id long, d string, team1_name string, team2_name string, team1_strength double, team2_strength double, team1_form_runs double, team2_form_runs double, team1_strike_rate double, team2_strike_rate double, team1_economy double, team2_economy double, team1_total_runs double, team2_total_runs double, winner string, winner_source string"
    return spark.createDataFrame(rows, cols).withColumn("date", F.to_date("d")).drop("d").repartition(3)


def test_ridge_equals_closed_form(matches):
    model = training.train_totals(matches)
    rows = training.assembled(training.with_sample_weight(training.winner_features(matches)), training.WINNER_INPUTS)
    data = rows.select("features", "weight", "team1_total_runs").collect()
    x = np.array([r.features.toArray() for r in data])
    w = np.array([r.weight for r in data])
    y = np.log1p(np.array([r.team1_total_runs for r in data]))
    xm, ym = (w[:, None] * x).sum(0) / w.sum(), (w * y).sum() / w.sum()
    xc, yc = x - xm, y - ym
    beta = np.linalg.solve(xc.T @ (w[:, None] * xc) + 2.0 * np.eye(x.shape[1]), xc.T @ (w * yc))
    want = np.expm1(x @ beta + ym - xm @ beta)
    got = np.array([r.ml1 for r in model.predict(rows.drop("features")).select("ml1").collect()])
    assert np.allclose(np.sort(got), np.sort(want), rtol=1e-5)


def test_winner_model_learns_and_persists(spark, matches, tmp_path):
    split = evaluation.time_split(matches)
    train, test = split.where("part = 'train'").drop("part"), split.where("part = 'test'").drop("part")
    assert (train.count(), test.count()) == (128, 32)
    model = training.train_winner(train, trees=15, depth=5)
    scored = model.predict(test)
    m = training.evaluate_winner(scored).where("winner_source = 'all'").first()
    assert m.n == 32 and m.brier < 0.25
    training.save_winner(spark, model, str(tmp_path / "w"))
    again = training.load_winner(spark, str(tmp_path / "w")).predict(test)
    a = sorted(r.ml_p_team1 for r in scored.collect())
    assert a == pytest.approx(sorted(r.ml_p_team1 for r in again.collect()))
    assert all(0.0 <= p <= 1.0 for p in a)


def test_ensemble_bounds_and_persistence(spark, matches, tmp_path):
    rows = training.with_sim_proxy(matches).withColumn("ml_p", F.expr("0.05 + 0.9 * pmod(hash(match_id), 100) / 100"))
    split = evaluation.time_split(rows, minimum=40, min_test=10)
    bundle = training.train_ensemble(split.where("part = 'train'").drop("part"), split.where("part = 'test'").drop("part"))
    out = bundle.predict(rows)
    assert out.where("ensemble_p_team1 < 0.02 OR ensemble_p_team1 > 0.98").count() == 0
    training.save_ensemble(spark, bundle, str(tmp_path / "e"))
    again = training.load_ensemble(spark, str(tmp_path / "e")).predict(rows)
    assert again.join(out.select("match_id", F.col("ensemble_p_team1").alias("e")), "match_id").where("abs(e - ensemble_p_team1) > 1e-12").count() == 0


def test_split_too_small_raises(matches):
    with pytest.raises(Exception, match="at least 20 rows"):
        evaluation.time_split(matches.limit(5)).collect()


def test_short_test_block_is_taken_from_the_end_of_training(matches):
    parts = evaluation.time_split(matches.limit(160), test_frac=0.02, min_test=10).groupBy("part").count().collect()
    counts = {r.part: r["count"] for r in parts}
    assert counts["test"] == 32 and counts["train"] == 156 - 32 and counts[None] == 4


@pytest.fixture(scope="module")
def players(spark):
    rows = []
    for f in range(4):
        for s in (1, 2):
            for i in range(12 if f % 2 else 11):
                rows.append((f, s, i + 1, f"p{s}_{i}", i % 3, 10.0 + i + s * f, 0.3 + 0.05 * i, 5.0 + i, 0.4, 0.8, 1.0, 1.1, 1.2, 0.9, 0.95))
    return spark.createDataFrame(
        rows,
        "fixture_id int, side int, xi_place int, player_id string, role_encoded int, pred_runs_raw double, pred_wk_raw double, std_runs double, std_wickets double, playing_prob double, data_confidence double, first_innings_runs double, second_innings_runs double, first_innings_wickets double, second_innings_wickets double",
    ).withColumns({"bowling_style": F.lit("spin"), "venue_spin_harshness": F.lit(0.5), "strike_rate": F.lit(140.0)})


def test_scaled_players_sum_to_target(spark, players):
    expected = scoring.expected_players(scoring.by_fixture(players))
    totals = scoring.side_totals(expected).withColumns(
        {"ml1": F.lit(160.0), "ml2": F.lit(150.0), "first_innings_runs": F.lit(1.1), "second_innings_runs": F.lit(1.2), "venue_spin_harshness": F.lit(0.5)}
    )
    scales = scoring.run_scales(scoring.innings_targets(totals))
    summed = scoring.side_totals(scoring.scale_players(expected, scales)).join(scales.select("fixture_id", "target1", "target2"), "fixture_id")
    for r in summed.collect():
        assert r.raw1 == pytest.approx(r.target1) and r.raw2 == pytest.approx(r.target2)
    kept = {(r.fixture_id, r.side): r["count"] for r in expected.groupBy("fixture_id", "side").count().collect()}
    assert set(kept.values()) == {11}


def test_simulation_does_not_depend_on_partitioning(spark, players):
    scales = spark.createDataFrame([(f, 1.0, 1.0) for f in range(4)], "fixture_id int, scale1 double, scale2 double")
    a = scoring.monte_carlo(players.coalesce(1), scales, 50).orderBy("fixture_id").collect()
    b = scoring.monte_carlo(players.repartition(9), scales, 50).orderBy("fixture_id").collect()
    assert [(r.fixture_id, r.sim_p_team1) for r in a] == [(r.fixture_id, r.sim_p_team1) for r in b]
    assert {r.replicates for r in a} == {50}
