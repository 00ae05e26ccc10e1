"""Registered queries against DuckDB on the smallest given tables. VOTELENS_ALL=1 runs every one."""
import os
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="given tables not found")

CORE = """first_vote_per_pair user_prefix_matrix dynamic_scores static_scores score_export retire_thresholds find_purity roc_curve auc
fdr_threshold controversial_top dump_stats gold_selection parse_votes ingest_votes_csv random_trials cv_grid_trials bootstrap_loop
silver_metrics random_patches grouped_split binned_rates mean_by_user kde split_scores""".split()


def names():
    import __spark_entry__ as e
    return list(e.oracle_sql()) if os.environ.get("VOTELENS_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    from compare import duck
    return duck(SF)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    import __spark_entry__ as e
    from compare import compare
    ok, text, _ = compare(spark, con, SF, name, e.queries()[name], e.oracle_sql()[name])
    assert ok, text


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["subject", "gold", "p", "retired"] and df.count() > 0
