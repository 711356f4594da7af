"""Files of several dialects to deliveries, records, payloads, sinks and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from creaseline.schemas import DELIVERIES
from creaseline.sources import deliveries as src
from creaseline.sources import reference, sinks

FEED = "match_id,innings,over,ball_in_over,batter_id,non_striker_id,bowler_id,batting_team,bowling_team,runs_batter,runs_extras,extras_type,wicket,dismissal_kind,batter_out_id,strike_rate_inn,venue,date,competition"


def match_doc():
    ball = {"batter": "A", "bowler": "X", "non_striker": "B", "runs": {"batter": 4, "extras": 0}}
    wide = {"batsman": "A", "bowler": "X", "non_striker": "B", "runs": {"batter": 0, "extras": 1}, "extras": {"wides": 1}}
    out = {**ball, "runs": {"batter": 0}, "wickets": [{"kind": "bowled", "player_out": "A"}]}
    return {
        "info": {"dates": ["2024-04-02", "2024-04-01"], "venue": "V", "teams": ["T1", "T2"], "event": {"name": "Indian Premier League"}},
        "innings": [
            {"team": "T1", "overs": [{"deliveries": [ball, wide]}, {"deliveries": [out]}]},
            {"team": "T2", "overs": [{"deliveries": [{**ball, "batter": "C", "bowler": "Y"}]}]},
        ],
    }


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    raw, drop = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("matches")
    (drop / "a1.csv").write_text(
        FEED + "\n"
        "ipl-m1,1,0,1,head,,bumrah,,,4,0,,False,,,1,,,\n"
        "ipl-m1,1,0,1,head,,bumrah,,,4,0,,False,,,1,,,\n"
        "ipl-m1,1,0,2,head,,bumrah,,,0,1,wide,False,,,1,,,\n"
        'ipl-m1,2,0,1,"kohli, v",,cummins,,,0,0,,True,caught,"kohli, v",1,,,\n'
    )
    sub = raw / "sub"
    sub.mkdir()
    (sub / "old.CSV").write_text(
        "matchId,batsman,bowler,batsman_runs,extras,isWide,isNoBall,dismissal_kind,player_dismissed,start_date,innings,over,ball_in_over\n"
        "335982,P,Q,6,0,0,0,,,2008-04-18,1,0,1\n335982,P,Q,0,1,0,1,,,2008-04-18,1,0,2\n335982,,Q,1,0,0,0,,,2008-04-18,1,0,3\n"
    )
    (raw / "venues.csv").write_text("venue,city\nV,W\n")
    (raw / "ragged.csv").write_text("match_id,batter,bowler,innings\n77,a,b,1,9\n")
    (raw / "zz_match.json").write_text(json.dumps(match_doc()))
    (raw / "broken.json").write_text("{ not json")
    return [str(raw), str(drop)]


def test_build_deliveries(spark, roots):
    defaults = spark.createDataFrame(
        [(1, "SRH", "RCB", "M Chinnaswamy Stadium, Bengaluru", "2026-03-28"), (2, "RCB", "SRH", "M Chinnaswamy Stadium, Bengaluru", "2026-03-28")],
        "innings int, batting_team string, bowling_team string, venue string, date string",
    ).withColumn("date", F.to_date("date"))
    out = src.build_deliveries(spark, roots, defaults)
    assert out.schema.fieldNames() == DELIVERIES.fieldNames()
    rows = out.collect()
    feed = [r for r in rows if r.bowler in ("bumrah", "cummins")]
    assert len(feed) == 3  # the repeated ball collapses
    assert {r.match_id for r in feed} == {910000000} and {r.batting_team for r in feed} == {"SRH", "RCB"}
    assert sum(r.is_wide for r in feed) == 1 and any(r.batter == "kohli, v" and r.player_dismissed == "kohli, v" for r in feed)
    old = [r for r in rows if r.match_id == 335982]
    assert len(old) == 2 and {str(r.date) for r in old} == {"2008-04-18"} and sum(r.is_noball for r in old) == 1
    nested = [r for r in rows if r.batter in ("A", "C")]
    assert len(nested) == 4 and {str(r.date) for r in nested} == {"2024-04-01"} and {r.competition for r in nested} == {"IPL"}
    assert {r.match_id for r in nested} == {910000001}
    wide = [r for r in nested if r.is_wide][0]
    assert (wide.extras, wide.ball_in_over, wide.over, wide.bowling_team) == (1.0, 2, 0, "T2")
    assert [r.dismissal_kind for r in nested if r.over == 1] == ["bowled"]


def test_rejects_and_checks(spark, roots):
    reasons = {(os.path.basename(r.path), r.reason) for r in src.rejected_rows(spark, roots).collect()}
    assert ("venues.csv", "not a delivery file") in reasons
    assert ("ragged.csv", "cell count") in reasons
    assert ("broken.json", "not a match document") in reasons
    df = spark.createDataFrame([(1, "x")], "match_id int, batter string")
    assert "bowler" in src.missing_columns(df) and "batter" not in src.missing_columns(df)


def test_dedupe_is_idempotent(spark, roots):
    once = src.dedupe_deliveries(src.csv_deliveries(src.csv_rows(spark, roots)), order=("path", "line"))
    assert src.dedupe_deliveries(once, order=("path", "line")).count() == once.count()


def test_records_and_payloads(spark, tmp_path):
    good = {
        "match_key": "k1", "match_date": "2026-01-01", "venue": "V", "team1_name": "A", "team2_name": "B", "team1_bats_first": True,
        "pred_winner": "A", "pred_p_team1_win": 0.6, "pred_best_bat": "a", "pred_best_bowl": "b", "pred_top5_bats": list("abcde"),
        "pred_top3_bowls": list("xyz"), "pred_potm": "a", "pred_extra": {"sims": 10},
    }
    (tmp_path / "a_pre.json").write_text(json.dumps(good))
    (tmp_path / "b_pre.json").write_text(json.dumps({**good, "match_key": "k2", "pred_top5_bats": ["a"]}))
    (tmp_path / "p.json").write_text(
        json.dumps({"team1_name": " A ", "team2_name": "B", "playing_xi_team1": "p1, p2,, p3", "xi2": ["q1", " q2 "], "toss_winner": "b", "elected_to": "field", "pitch_report": "flat"})
    )
    ok, bad = reference.read_predictions(spark, str(tmp_path), "*_pre.json")
    assert [r.match_key for r in ok.collect()] == ["k1"] and [r.match_key for r in bad.collect()] == ["k2"]
    assert json.loads(ok.first().pred_extra) == {"sims": 10}
    p = reference.read_payloads(spark, str(tmp_path), "p.json").first()
    assert (p.xi1, p.xi2, p.batting_first, p.pitch_text) == (["p1", "p2", "p3"], ["q1", "q2"], "team1", "flat")


def test_reference_tables_and_sinks(spark, tmp_path):
    (tmp_path / "squads.csv").write_text("team,player_id,is_overseas\n A ,p1,1\nA,p2,x\n")
    rows = reference.read_reference(spark, "squads", str(tmp_path / "squads.csv")).orderBy("player_id").collect()
    assert [(r.team, r.is_overseas) for r in rows] == [("A", 1), ("A", 0)]
    assert reference.read_reference(spark, "bowling_style", str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "res.csv").write_text("matchId,winner,team1,team2\n5, A ,A,B\nx,A,A,B\n6,,A,B\n")
    assert [(r.match_id, r.winner) for r in reference.read_official_results(spark, str(tmp_path / "res.csv")).orderBy("match_id").collect()] == [(5, "A"), (6, "")]
    d = spark.createDataFrame([(1, "2024-01-01"), (2, "2025-01-01"), (3, None)], "match_id int, d string").withColumn("date", F.to_date("d"))
    sinks.write_deliveries(d, str(tmp_path / "t"))
    sinks.write_deliveries(d.where("match_id = 2").withColumn("match_id", F.lit(9)), str(tmp_path / "t"))
    assert sorted(r.match_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 3, 9]


def test_streams(spark, sf_dir, tmp_path):
    from creaseline.plans.stats import innings_totals, player_match_stats
    from creaseline.queries.views import deliveries
    from creaseline.sources.deliveries import BALL_KEY
    from creaseline.streaming import drops

    d = deliveries(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in DELIVERIES.fields])
    drop, table, ckpt = str(tmp_path / "drop"), str(tmp_path / "table"), str(tmp_path / "ckpt")
    early = d.where("date < '1995-06-01'")
    late = d.where("date >= '1995-06-01'")
    early.coalesce(1).write.mode("append").parquet(drop)

    def run():
        drops.append_deliveries(drops.read_drops(spark, drop), table, ckpt).awaitTermination()
        drops.write_innings_totals(drops.read_drops(spark, drop), str(tmp_path / "totals"), ckpt).awaitTermination()
        drops.refresh_player_stats(drops.read_drops(spark, drop), str(tmp_path / "balls"), str(tmp_path / "stats"), ckpt, buckets=4).awaitTermination()

    run()
    late.unionByName(early.limit(50)).coalesce(1).write.mode("append").parquet(drop)
    run()
    stored = drops.ball_log(spark, table).read()
    unique = d.select(*BALL_KEY).distinct()
    assert stored.count() == unique.count()
    assert stored.select(*BALL_KEY).exceptAll(unique).count() == 0
    want = innings_totals(d).select("match_id", "innings1_runs").where("innings1_runs is not null")
    got = drops.current_innings_totals(spark, str(tmp_path / "totals")).where("innings = 1")
    joined = want.join(got, "match_id")
    assert joined.count() == want.count()
    stats = drops.current_player_stats(spark, str(tmp_path / "stats"), buckets=4)
    again = player_match_stats(stored.select(*DELIVERIES.fieldNames()))
    assert stats.select(*again.columns).exceptAll(again).count() == 0 and stats.count() == again.count()


def test_dropped_files_equal_the_batch_ingest(spark, roots, tmp_path):
    """Three dialects and nested JSON dropped together, and once more, one file at a time."""
    import shutil

    from creaseline.streaming import drops

    folder = tmp_path / "drop"
    folder.mkdir()
    names = []
    for root in roots:
        for base, _, files in os.walk(root):
            names += [os.path.join(base, f) for f in files]
    (tmp_path / "third.csv").write_text("match_id,striker,bowler,non_striker,total_runs,extras,innings,over,ball_in_over,start_date\n41,s1,b1,n1,5,1,1,0,1,2024-05-01\n41,s1,b1,n1,0,0,1,0,2,2024-05-01\n")
    for name in [*names, str(tmp_path / "third.csv")]:
        shutil.copy(name, folder)
    want = src.build_deliveries(spark, [str(folder)])
    together = drops.read_files(spark, str(folder))
    drops.append_files(together, str(tmp_path / "t1"), str(tmp_path / "ids1"), str(tmp_path / "c1")).awaitTermination()
    got = drops.ball_log(spark, str(tmp_path / "t1")).read()
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    # One file per batch gives the same balls; numbers of text ids follow the order of batches and then hold.
    shutil.copy(folder / "a1.csv", folder / "again.csv")
    single = drops.read_files(spark, str(folder), files_per_batch=1)
    drops.append_files(single, str(tmp_path / "t2"), str(tmp_path / "ids2"), str(tmp_path / "c2")).awaitTermination()
    plain = [c for c in DELIVERIES.fieldNames() if c != "match_id"]
    assert drops.ball_log(spark, str(tmp_path / "t2")).read().select(*plain).exceptAll(want.select(*plain)).count() == 0
    assert drops.ball_log(spark, str(tmp_path / "t2")).read().count() == want.count()
