"""Forests grown a few trees a task."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from votelens.plans import forest, learning as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(1500, 5)), rng.integers(0, 4, 1500)]
    y = x[:, 0] + x[:, 1] + .5 * rng.normal(size=1500) > 0
    return spark.createDataFrame([(k, [float(v) for v in a], int(b)) for k, (a, b) in enumerate(zip(x, y))], "vec_id long, x array<double>, y int").persist()


def test_edges(spark, rows):
    edges = forest.bin_edges(rows)
    assert [len(e) for e in edges] == [31] * 5 + [3] and edges[5].tolist() == [.5, 1.5, 2.5]
    x = np.array([r.x for r in rows.collect()])
    share = np.bincount(np.searchsorted(edges[0], x[:, 0])) / len(x)
    assert len(share) == 32 and abs(share - 1 / 32).max() < .005


def test_one_tree():
    """A whole tree tells all rows apart; leaves hold the least number of rows; trees of several leaf sizes grown together are those grown alone while they split alike."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 32, (400, 6)).astype(np.uint8), rng.integers(0, 2, 400)
    w, every = np.ones(400, np.int64), np.arange(400)
    probs, gains = forest.grow(x, y, w, every, 6, (1, 20), 30, np.random.default_rng(1))
    assert (probs[0] == y * forest.ONE).all()
    assert gains[0].sum() == pytest.approx(400 - (y.sum() ** 2 + (400 - y.sum()) ** 2) / 400)       # all impurity is gone
    assert min(np.unique(probs[1], return_counts=True)[1]) >= 20
    alone, own = forest.grow(x, y, w, every, 6, (20,), 30, np.random.default_rng(9))                 # all inputs are drawn: no chance is left
    assert (alone[0] == probs[1]).all() and own[0] == pytest.approx(gains[1])
    stump, first = forest.grow(x, y, w, every, 6, (1,), 1, np.random.default_rng(1))
    best = max(sum((y[side].sum() ** 2 + (len(y[side]) - y[side].sum()) ** 2) / len(y[side]) for side in (x[:, k] <= c, x[:, k] > c) if side.any()) for k in range(6) for c in range(31))
    assert first.sum() == pytest.approx(best - (y.sum() ** 2 + (400 - y.sum()) ** 2) / 400)
    assert len(np.unique(stump)) == 2


def test_importances_without_trees_at_the_driver(spark, rows, monkeypatch):
    """Above a number of rows no forest is fitted by the driver, and the figures are those of Spark ML's forest."""
    df = L.as_features(rows)
    wanted = {r.feature: r for r in L.forest_importance(df).collect()}
    monkeypatch.setattr(L, "FOREST_ROWS", 100)
    monkeypatch.setattr(L, "random_forest", None)
    got = {r.feature: r for r in L.forest_importance(df).collect()}
    assert sum(r.importance for r in got.values()) == pytest.approx(1)
    for k, r in wanted.items():
        assert got[k].importance == pytest.approx(r.importance, abs=.04) and got[k].sd == pytest.approx(r.sd, abs=.05)


def test_cross_validation_in_tasks(spark, rows, monkeypatch):
    df = L.contiguous_folds(L.as_features(rows).select("vec_id", "features", "label"), "vec_id", 3)
    kinds = dict(trees=(20, 5), features=(2, 4), leaves=(1, 5))
    wanted = {tuple(r)[:3]: r["mean"] for r in L.cross_validate_forest(df, **kinds).collect()}
    monkeypatch.setattr(L, "FOREST_ROWS", 100)
    monkeypatch.setattr(L, "random_forest", None)
    got = {tuple(r)[:3]: r["mean"] for r in L.cross_validate_forest(df, **kinds).collect()}
    assert got.keys() == wanted.keys() and len(got) == 8
    assert abs(np.mean(list(got.values())) - np.mean(list(wanted.values()))) < .1
    x = df.select(F.col("fold"), L.vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
    scores = forest.held_out_scores(x, **kinds)
    per = scores.groupBy("trees", "features", "leaf").agg(F.count("*").alias("n"), F.sum("gold").alias("real"), F.avg(F.abs(F.col("p") - F.col("gold"))).alias("off")).collect()
    assert len(per) == 8 and {(r.n, r.real) for r in per} == {(1500, rows.where("y = 1").count())} and all(r.off < .35 for r in per)
