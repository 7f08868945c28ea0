"""The registered queries agree with their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import check

SF_DIR = "/root/testdata/sf0.001"
# one query per area; `python -m checks.compare` runs them all
NAMES = """C2_status_counts C1_cell_diffs W1_duplicates C3_pairs C4_rows A12_ledger_summary SRC1_read_strings P14_load_and_map
S1_canonical S17_char_grams SNK6_chunk_records SRC7_latest_batch A3_profile J12_column_assignment J9_scores C2_renamed
A15_day_summary A22_narrative A29_digest R1_side_by_side J7_lookup C5_row_pairs A27_history A23_run_metrics""".split()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, note = check(spark, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 5
