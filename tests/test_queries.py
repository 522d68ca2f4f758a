"""A cross-section of registered queries against their SQL; compare.py runs all of them."""
import pytest
from compare import compare, duck

import __spark_entry__ as entry

NAMES = ("parse_date", "flag_duplicate_ids", "rule_waterfall", "gold_build", "join_as_of_range", "dataset_tabular",
         "fold_training_set", "rank_runs", "availability_summary", "agg_quantile_exact", "win_cumsum", "minimum_removed",
         "manual_membership", "company_profile_daily", "cascade_labels")


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["RUN_NAME"] for r in rows] and all(r["mae"] >= 0 for r in rows)
