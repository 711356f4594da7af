"""What is broadcast, exchanged and written stays bounded when tables grow."""

import pytest
from pyspark.sql import functions as F
from test_stream_repeats import balls

from creaseline.operators.buckets import BucketLog
from creaseline.operators.windows import chunk_borders
from creaseline.plans import features, stats, training
from creaseline.queries import files, ingest
from creaseline.session import SIZES, set_sizes
from creaseline.sources import deliveries as src
from creaseline.sources import reference
from creaseline.streaming import drops


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_balls_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    log = drops.ball_log(spark, str(tmp_path / "table"))
    drops._append_new(balls(spark, 1, 6), 0, log)
    appended, write = [], BucketLog.append
    monkeypatch.setattr(BucketLog, "append", lambda self, rows, batch_id: (appended.append(plan(rows)), write(self, rows, batch_id)))
    drops._append_new(balls(spark, 3, 9), 1, log)
    assert "SortMergeJoin" in appended[0] and "Broadcast" not in appended[0]
    assert log.read().count() == 8


def test_balls_cross_one_exchange_to_player_lines(spark):
    rows = balls(spark, 1, 9, match=F.col("id") % 3).repartition(3)
    assert plan(stats.player_lines(rows)).count("Exchange hashpartitioning") == 1
    assert {r["player_id"]: r["runs"] for r in stats.player_lines(rows.where("match_id = 1")).collect()} == {"a": 12.0, "b": 0.0}


def test_rows_of_a_large_file_are_not_dealt_by_path(spark):
    rows = balls(spark, 1, 9).withColumn("path", F.lit("one"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judged = src.dedupe_deliveries(rows, source=("path",))
        assert "SortMergeJoin" not in plan(judged) and judged.count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_arrays_of_records_read_like_single_ones(spark, tmp_path):
    rows = spark.range(25).selectExpr("id AS file", "concat('m', id) AS match_key", "CASE WHEN id = 3 THEN NULL ELSE concat('p', id) END AS official_potm")
    files._write_arrays(rows, str(tmp_path / "many"), 10)
    assert len(list((tmp_path / "many").rglob("*.txt"))) == 3
    back = reference.read_results(spark, str(tmp_path / "many"), "*.txt")
    assert sorted(map(tuple, back.select("match_key", "official_potm").collect())) == sorted(map(tuple, rows.drop("file").collect()))
    (tmp_path / "one.json").write_text('{"match_key": "m1",\n "official_potm": "p"}')
    assert reference.read_results(spark, str(tmp_path / "one.json")).count() == 1


@pytest.mark.parametrize("per_file, more", [(500_000, False), (100, True)])
def test_dropped_files_follow_the_size_of_the_table(spark, sf_dir, tmp_path, monkeypatch, per_file, more):
    monkeypatch.setattr(ingest, "BALLS_PER_FILE", per_file)
    folders = {}
    monkeypatch.setattr(ingest, "_folder", lambda spark, name: folders.setdefault(name, str(tmp_path / name)))
    ingest._late_drops(spark, sf_dir)
    assert (len(list((tmp_path / "drop").glob("*.parquet"))) > 3) == more


def test_sizes_leave_own_settings(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    other = spark.newSession()
    other.conf.set(key, "7m")
    set_sizes(other)
    assert other.conf.get(key) == "7m" and other.conf.get("spark.sql.sources.fileCompressionFactor") == SIZES["spark.sql.sources.fileCompressionFactor"]


def test_pairs_are_dealt_by_match_and_by_pair_only(spark, monkeypatch):
    sampled = []
    monkeypatch.setattr(features, "chunk_borders", lambda rows, *a: (sampled.append(plan(rows)), chunk_borders(rows, *a))[1])
    rows = balls(spark, 1, 9, match=F.col("id") % 3)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    dates = spark.sql("SELECT id AS match_id, date_add(date'2024-01-01', CAST(id AS INT)) AS date FROM range(3)")
    dates = spark.createDataFrame(dates.collect(), dates.schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        priors = features.pair_priors(rows, dates)
        # Balls by match, dates by match, pairs by pair.
        assert plan(priors).count("Exchange hashpartitioning") == 3
        assert len(sampled) == 1 and "Exchange hashpartitioning" not in sampled[0]
        assert [r["prev_runs"] for r in priors.orderBy("date").collect()] == [0.0, 8.0, 20.0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_opponents_meet_rows_by_match(spark):
    rows = spark.sql("SELECT * FROM VALUES (1L, 'A', 'A', 'B', 'batter'), (1L, 'B', 'B', 'A', 'bowler'), (2L, 'A', 'A', NULL, 'batter') t(match_id, team, batting_team, bowling_team, role)")
    past = spark.sql("SELECT * FROM VALUES (1L, 'A', 10D, 1D), (1L, 'B', 20D, 2D) t(match_id, team, past_batting_strength, past_bowling_strength)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = features._join_opponent(rows, past)
        assert "opponent_team" not in "".join(x for x in plan(joined).splitlines() if "Exchange" in x)
        found = joined.select("match_id", "team", "opponent_past_batting_strength", "opponent_strength").collect()
        assert sorted(map(tuple, found)) == [(1, "A", 20.0, 2.0), (1, "B", 10.0, 10.0), (2, "A", None, None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_forests_read_written_rows(spark, monkeypatch):
    class Seen(Exception):
        pass

    def forest(**kwargs):
        class Forest:
            def fit(self, rows):
                raise Seen(plan(rows))

        return Forest()

    monkeypatch.setattr(training, "RandomForestClassifier", forest)
    monkeypatch.setattr(training, "RandomForestRegressor", forest)
    number = {c: F.col("id") * 1.0 for c in [*training.PLAYER_INPUTS, "runs", "wickets", *[f"team{s}_{c}" for s in (1, 2) for c in training.SIDE_INPUTS]]}
    rows = spark.range(400).withColumns({**number, "match_id": F.col("id"), "date": F.expr("date_add(date'2024-01-01', CAST(id % 90 AS INT))"), "winner": F.expr("concat('team', id % 2 + 1)"), "winner_source": F.lit("official")})
    for train in (training.train_winner, training.train_player_models):
        with pytest.raises(Seen) as seen:
            train(rows.repartition(40))
        assert "parquet" in str(seen.value) and "InMemoryTableScan" not in str(seen.value) and "Exchange RoundRobin" not in str(seen.value)
