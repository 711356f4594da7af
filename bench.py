"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Every query runs to completion into the no-op sink.  ``stage_*`` entries time the writing of the tables
that later queries read, so nothing is measured from a warm cache without its cost being listed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "b16_player_match_stats", "e01_prior5_form", "e02_franchise_prior5", "e04_player_venue_history",
    "e06_pair_history", "c06_matchup_rates", "d12_b11_innings_table", "d19_innings_totals", "d21_column_medians",
    "e10_i02_player_training_rows", "e12_recency_weighted_form", "e19_player_time_split", "c09_label_resolution",
    "e11_franchise_momentum", "c11_momentum_as_of", "f08_actual_top_batters", "g02_dedupe_deliveries",
    "c18_squad_resolution", "c19_registry_resolution", "c12_venue_preferred_row", "k03_stream_innings_totals",
    "d23_headline_stats",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    from creaseline.queries import views
    from creaseline.queries.all import QUERIES
    from creaseline.session import get_session

    spark = get_session(f"local[{cpus}]", int(cpus))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    timed("stage_player_match", lambda: views.player_match(spark, sf_dir))
    timed("stage_player_features", lambda: views.player_features(spark, sf_dir))
    timed("stage_match_rows", lambda: views.match_rows(spark, sf_dir))
    timed("stage_fixture_players", lambda: views.priced_players(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
