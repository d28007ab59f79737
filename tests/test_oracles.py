"""Registered queries against their DuckDB oracle. TIDEMARK_FULL=1 runs every query."""

import os

import pytest
from conftest import SF

import __spark_entry__ as entry
import oracle_check

QUICK = (
    "s01_s02_segment_bounds", "s04_label_run_windows", "s13_interval_windows", "s22_text_labels", "f01_f02_band_power", "f09_f13_rr_features",
    "p12_structural_scalar", "m04_index_v4", "r02_r03_state_map", "d05_d11_recurrences", "k04_rank_sum", "k22_candidate_scores", "y02_y06_methods", "w01_window_stream",
)
NAMES = tuple(entry.queries()) if os.environ.get("TIDEMARK_FULL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    outcome = oracle_check.compare(spark, oracle_check.connect(SF), entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert outcome.startswith(("ok", "rows-only")), outcome


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
