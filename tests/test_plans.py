"""Properties of the physical plans that matter at scale."""
import re

import pytest
from pyspark.sql import functions as F

from sequential import random_log
from votelens.operators import consensus as C, evaluate as E, prefix as P, relational as R
from votelens.params import Params


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Votes (with a column nobody reads) and golds as Parquet; one voter holds a third of the votes."""
    folder = tmp_path_factory.mktemp("plans")
    log, golds = random_log(1, voters=30, subjects=80, n=900)
    log = [("u:hot", s, v, k) if k % 3 == 0 else (u, s, v, k) for u, s, v, k in log]
    spark.createDataFrame([(*r, "unused") for r in log], "voter string, subject long, annotation int, seq long, note string").write.parquet(str(folder / "v"))
    spark.createDataFrame(sorted(golds.items()), "subject long, gold int").write.parquet(str(folder / "g"))
    return spark.read.parquet(str(folder / "v")), spark.read.parquet(str(folder / "g"))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_scan_reads_only_the_scoring_columns(tables):
    votes, golds = tables
    text = plan(C.dynamic_scores(votes, golds))
    assert "note" not in text
    assert "PushedFilters: [IsNotNull(voter), IsNotNull(subject)" in text


def test_hot_voter_is_cut_into_blocks(tables):
    votes, golds = tables
    cut = Params(split_rows=50, shares=64)
    text = plan(C.dynamic_scores(votes, golds, cut))
    assert re.search(r"Exchange hashpartitioning\(voter#\d+, block#\d+", text)
    assert "_fine" in text
    # without a large key adaptive execution takes the cuts and the carried sums out of the plan again
    whole = plan(C.dynamic_scores(votes, golds))
    assert "Join [voter" not in whole and "cast(null as bigint) AS _c_seen0" in whole
    a, b = ({r.subject: r.p for r in C.dynamic_scores(votes, golds, p).collect()} for p in (cut, Params()))
    assert a == pytest.approx(b, abs=2e-9)


def test_building_a_plan_starts_no_job(spark, tables):
    votes, golds = tables
    sc = spark.sparkContext
    sc.setJobGroup("only-plans", "no job may run here")
    try:
        dyn = C.dynamic_votes(votes, golds, Params(split_rows=50, shares=64))
        frames = [dyn, C.subject_prefix_scores(dyn, source=votes), C.score_history(dyn, source=votes), C.user_history(C.votes_with_gold(C.first_vote_per_pair(votes), golds)),
                  C.dynamic_scores(votes, golds), R.group_push(votes, ["voter"], ["subject"], ["seq"])]
        assert list(sc.statusTracker().getJobIdsForGroup("only-plans")) == []
        frames[0].collect()
        assert list(sc.statusTracker().getJobIdsForGroup("only-plans"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_more_large_keys_than_any_list_and_a_burst(spark):
    """5,000 keys of six rows, all above the fair share; one key with 4,000 rows, nearly all within one thousandth of its time; equal orders and nulls."""
    rows = [(f"k{i}", 1000 * j + i % 7, j + 1) for i in range(5000) for j in range(6)]
    rows += [("burst", 5_000_000 + i, 2) for i in range(3900)] + [("burst", i * 100_000, 1) for i in range(100)]
    rows += [(None, i, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, at long, v long").repartition(4)
    params = Params(split_rows=2, shares=20_000)
    placed = P.hot_blocks(df, "key", "at", params)
    per = placed.groupBy("key", "block").agg(F.count("*").alias("n")).collect()
    burst = [r.n for r in per if r.key == "burst"]
    assert len({r.key for r in per if r.block >= 0}) == 5001 and max(burst) <= 8 and len(burst) > 1000
    got = P.running(placed, ["key"], ["at"], sums={"s": "v"}, mins={"m": "v"}, totals=True, hot_only=True)
    assert placed.count() == len(rows) and "block" not in got.columns
    want, total, least = {}, {}, {}
    for k, at, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        total[k], least[k] = total.get(k, 0) + v, min(least.get(k, v), v)
        want[k, at] = (total[k], least[k])
    assert {(r.key, r.at): (r.s, r.m) for r in got.collect()} == want


def test_curve_windows_are_blocked_and_share_their_input(tables):
    votes, golds = tables
    text = plan(E.auc(E.with_golds(C.static_scores(votes, golds), golds)))
    windows = [line for line in text.splitlines() if "- Window [sum(" in line and "total_" not in line and "_c_" not in line]
    assert windows and all("block" in w for w in windows)
    assert text.count("ReusedExchange") >= 2        # deduplicated votes and score points


def test_unlabelled_table_gives_empty_figures(spark):
    df = spark.createDataFrame([(1, -1, .4), (2, -1, .6)], "subject long, gold int, p double")
    assert E.purity_threshold(df, .5).first().threshold == 1.0
    assert tuple(E.retire_thresholds(df, .1, .1).first()) == (0.0, 0.0)
    assert E.completeness_at(df, .5).first().completeness is None
    assert E.composition_at(df, .5).first().share_none == 1.0
    assert E.eval_summary(df).first().auc is None
    assert E.rates_sweep(df).where(F.col("i") == 0).first().fpr is None
