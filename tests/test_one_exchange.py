"""Balls cross one exchange where one is enough, and are not kept a second time."""

import pytest
from test_stream_repeats import balls

from creaseline.operators.buckets import BucketLog
from creaseline.queries import files
from creaseline.queries.all import QUERIES
from creaseline.streaming import drops


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_new_and_known_balls_meet_in_one_grouping(spark, tmp_path, monkeypatch):
    drop, totals, ckpt = (str(tmp_path / n) for n in ("drop", "totals", "ckpt"))
    appended, write = [], BucketLog.append
    monkeypatch.setattr(BucketLog, "append", lambda self, rows, batch_id: (appended.append(plan(rows)), write(self, rows, batch_id)))
    monkeypatch.setattr(drops, "cut_lineage", lambda df: pytest.fail("balls are written a second time"))
    for part in (balls(spark, 1, 4), balls(spark, 2, 6, match=None), balls(spark, 2, 6).unionByName(balls(spark, 2, 6, match=None))):
        part.write.mode("append").parquet(drop)
        drops.write_innings_totals(drops.read_drops(spark, drop), totals, ckpt).awaitTermination()
    rows = {r["match_id"]: (r["runs"], r["wickets"], r["balls"]) for r in drops.current_innings_totals(spark, totals).collect()}
    assert rows == {1: (25.0, 1, 5), None: (20.0, 1, 4)}
    assert len(appended) == 3 and all("Join" not in p and p.count("Exchange hashpartitioning") == 1 for p in appended)


def test_nested_documents_are_built_in_one_exchange(spark, sf_dir, monkeypatch):
    class Seen(Exception):
        pass

    def seen(rows, path):
        raise Seen(plan(rows.groupBy("file").count()), plan(rows))

    monkeypatch.setattr(files, "_write_files", seen)
    with pytest.raises(Seen) as found:
        QUERIES["a06_a07_nested_match_files"](spark, sf_dir)
    assert [p.count("Exchange hashpartitioning") for p in found.value.args] == [1, 1]
