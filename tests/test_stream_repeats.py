"""Balls that are delivered again count once, in whatever order files come."""

from pyspark.sql import functions as F

from creaseline.schemas import DELIVERIES
from creaseline.streaming import drops


def balls(spark, first, last, match=1, **fixed):
    ball = {f.name: F.lit(None).cast(f.dataType) for f in DELIVERIES.fields}
    ball |= {c: F.lit(v) for c, v in (("match_id", match), ("innings", 1), ("over", 3), ("batter", "a"), ("bowler", "b"), ("non_striker", "c"), ("extras", 1.0), ("runs_off_bat", 4.0))}
    ball |= {"ball_in_over": F.col("id"), "dismissal_kind": F.when(F.col("id") == 2, "bowled").otherwise("")}
    ball |= {c: F.lit(v) for c, v in fixed.items()}
    return spark.range(first, last, 1, 1).select(*[ball[f.name].cast(f.dataType).alias(f.name) for f in DELIVERIES.fields])


def test_innings_totals_count_a_repeated_ball_once(spark, tmp_path):
    drop, totals, ckpt = (str(tmp_path / n) for n in ("drop", "totals", "ckpt"))

    def deliver(rows):
        rows.write.mode("append").parquet(drop)
        drops.write_innings_totals(drops.read_drops(spark, drop), totals, ckpt).awaitTermination()
        return [tuple(r) for r in drops.current_innings_totals(spark, totals).select("match_id", "innings", "runs", "wickets", "balls").collect()]

    assert deliver(balls(spark, 1, 4)) == [(1, 1, 15.0, 1, 3)]
    assert deliver(balls(spark, 1, 4)) == [(1, 1, 15.0, 1, 3)]
    assert deliver(balls(spark, 2, 6)) == [(1, 1, 25.0, 1, 5)]
    # A copy that names a dismissal makes the ball a wicket, once, also where it comes later.
    assert deliver(balls(spark, 4, 5, dismissal_kind="caught").unionByName(balls(spark, 4, 5))) == [(1, 1, 25.0, 2, 5)]
    assert deliver(balls(spark, 4, 5, dismissal_kind="lbw")) == [(1, 1, 25.0, 2, 5)]


def test_a_batch_opens_the_buckets_of_its_matches_only(spark, tmp_path):
    """Twenty batches of new matches with one repeated ball each: what a batch reads does not grow with the table."""
    table = str(tmp_path / "table")
    log = drops.ball_log(spark, table, rows_per_bucket=40)
    opened, sizes = [], []
    for n in range(20):
        batch = balls(spark, 1, 31, match=n)
        if n:
            batch = batch.unionByName(balls(spark, 1, 6, match=n - 1))
        folders = log.opened(batch, n)
        files = [f for d in folders for f in (tmp_path / "table" / d.removeprefix(f"{table}/")).rglob("*.parquet")]
        opened.append(len(folders))
        sizes.append(sum(f.stat().st_size for f in files))
        drops._append_new(batch, n, log)
    level, rows = log.state(20)
    assert rows == 600 and level >= 3  # twice as many buckets whenever they are full
    everything = sum(f.stat().st_size for f in (tmp_path / "table").rglob("*.parquet") if "_state" not in str(f))
    assert max(sizes[10:]) < 0.6 * everything and max(sizes[15:]) <= 1.8 * max(sizes[5:10])
    assert log.read().groupBy("match_id").count().where("count <> 30").count() == 0
    # A batch that runs again leaves the table as it is.
    drops._append_new(balls(spark, 1, 31, match=19).unionByName(balls(spark, 1, 6, match=18)), 19, log)
    assert log.read().count() == 600
