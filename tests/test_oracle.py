"""Registered queries against their SQL.  CREASELINE_ORACLE=all runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from compare import difference, duck

QUICK = (
    "b16_player_match_stats", "e01_prior5_form", "e02_franchise_prior5", "e06_pair_history", "d19_innings_totals",
    "d20_build_counts", "b14_b15_franchise_names", "c18_squad_resolution", "c14_loose_containment",
    "g02_dedupe_deliveries", "h09_h11_pitch_multipliers", "d25_coarse_calibration", "c12_venue_preferred_row",
    "c19_registry_resolution", "b31_eleven_problems", "j17_impact_substitutes", "e11_franchise_momentum", "e19_player_time_split",
    "d21_column_medians", "g02_dedupe_without_innings", "g02_dedupe_mixed_sources", "b04_dates_by_file", "b19_match_id_numbers",
    "a06_a07_nested_match_files", "a09_rejected_files", "h01_folded_names", "k03_stream_innings_totals", "k04_stream_player_features",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CREASELINE_ORACLE") == "all" else QUICK


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toArrow()
    assert difference(got, con.sql(entry.oracle_sql()[name]).to_arrow_table()) is None


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, sf_dir):
    assert entry.entry(spark).count() > 0
