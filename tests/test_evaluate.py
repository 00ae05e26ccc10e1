"""Evaluation operators against small loops and hand cases."""
import random

import numpy as np
import pytest

from sequential import find_purity, find_thresholds
from votelens.operators import aggregates as A, evaluate as E, quantiles as Q

SCHEMA = "subject long, gold int, p double"


def table(spark, rows):
    return spark.createDataFrame([(k, g, float(p)) for k, (p, g) in enumerate(rows)], SCHEMA)


def random_scores(seed, n=60, levels=20):
    r = random.Random(seed)
    return [(r.randrange(levels + 1) / levels, r.choice([-1, 0, 0, 1, 1])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_thresholds_and_purity(spark, seed):
    rows = random_scores(seed, levels=random.Random(seed).choice([4, 20, 1000]))
    df = table(spark, rows)
    t = E.retire_thresholds(df, .1, .2).first()
    assert (t.bogus, t.real) == find_thresholds(rows, .1, .2)
    for target in (.5, .9):
        p = find_purity(rows, target)
        assert E.purity_threshold(df, target).first().threshold == p
        both = E.completeness_at_purity(df, target).first()
        ones = [x for x, g in rows if g == 1]
        assert (both.threshold, both.completeness) == (p, sum(x > p for x in ones) / len(ones))


@pytest.mark.parametrize("golds, target, want", [
    ([0, 0, 0, 0, 1, 1, 1, 1], .99, .3), ([0, 1, 0, 1, 0, 1, 0, 1, 1], .99, .6), ([1, 1], 1.0, 1.0)])
def test_purity_cases(spark, golds, target, want):
    df = table(spark, [(k / 10, g) for k, g in enumerate(golds)])
    assert E.purity_threshold(df, target).first().threshold == want


def test_counts_composition_completeness(spark):
    df = table(spark, [(.5, -1), (.6, 0), (.7, 0), (.8, 1), (.9, 1), (.95, 1), (.1, 1)])
    assert tuple(E.class_counts_at(df, .5).first()) == (1, 2, 3)
    assert tuple(E.composition_at(df, .5).first()) == (1 / 5, 2 / 5, 3 / 5)
    assert E.purity_at(df, .99).first().purity is None
    assert E.completeness_at(df, .9).first().completeness == 1 / 4
    ten = table(spark, [(k / 10, g) for k, g in enumerate([1, 1, 1, 0, 0, 0, 0, 0, 1, 1])])
    assert E.completeness_at(ten, .5).first().completeness == .4


@pytest.mark.parametrize("seed", range(3))
def test_roc_auc_and_figures_of_merit(spark, seed):
    rows = random_scores(seed, 80, 25)
    df = table(spark, rows)
    gold = [(p, g) for p, g in rows if g >= 0]
    n1, n0 = sum(g for _, g in gold), sum(1 - g for _, g in gold)
    points = [(t, sum(p >= t and g == 0 for p, g in gold) / n0, sum(p >= t and g == 1 for p, g in gold) / n1)
              for t in sorted({p for p, _ in gold}, reverse=True)]
    got = {r.threshold: (r.fpr, r.tpr) for r in E.roc_curve(df).collect()}
    assert got == {t: pytest.approx((f, y)) for t, f, y in points}
    pairs = [(a > b) + .5 * (a == b) for a, g in gold if g == 1 for b, h in gold if h == 0]
    assert E.auc(df).first().auc == pytest.approx(np.mean(pairs))
    for level in (.01, .2, .5):
        ok = [(t, y) for t, f, y in points if f <= level]
        row = E.fom_mdr_at_fpr(df, level).first()
        assert (row.mdr, row.threshold) == ((pytest.approx(1 - ok[-1][1]), ok[-1][0]) if ok else (1.0, None))
        ok = [(t, f) for t, f, y in points if 1 - y <= level]
        row = E.fom_fpr_at_mdr(df, level).first()
        assert (row.fpr, row.threshold) == (pytest.approx(ok[0][1]), ok[0][0])


def test_runs_are_independent(spark):
    a, b = random_scores(1), random_scores(2)
    df = spark.createDataFrame([(n, k, g, float(p)) for n, rows in (("a", a), ("b", b)) for k, (p, g) in enumerate(rows)], "run string, " + SCHEMA)
    got = {r.run: r.threshold for r in E.purity_threshold(df, .55, runs=["run"]).collect()}
    assert got == {"a": find_purity(a, .55), "b": find_purity(b, .55)}


@pytest.mark.parametrize("seed", range(2))
def test_fdr(spark, seed):
    rows = [(p, g) for p, g in random_scores(seed, 120, 400) if g >= 0]
    p, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    bins = np.minimum(np.floor(np.round(p * 1000, 9)), 999)
    pv = np.array([(bins[y == 0] >= b).sum() / (y == 0).sum() for b in bins])
    ranks = np.arange(1, len(p) + 1) * .3 / len(p)
    hit = np.where(np.sort(pv) <= ranks)[0]
    row = E.fdr_threshold(table(spark, rows), alpha=.3).first()
    if len(hit):
        t = np.sort(pv)[hit[-1]]
        assert row.threshold == pytest.approx(t)
        assert row.real_within == pytest.approx((pv[y == 1] <= t).mean())
    else:
        assert row.threshold is None


def test_kde_matches_direct_sum(spark):
    rows = random_scores(3, 40, 40)
    x = np.array([p for p, _ in rows])
    bw = 1.06 * x.std(ddof=1) * len(x) ** -.2
    grid = np.linspace(0, 1, 50)
    want = np.log(np.exp(-((grid[:, None] - x) / bw) ** 2 / 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi)))
    got = [r.log_density for r in E.kde(table(spark, rows)).orderBy("i").collect()]
    assert got == pytest.approx(list(want), abs=1e-9)


def test_quantiles_interpolate(spark):
    r = random.Random(2)
    rows = [(k % 3, r.random() * 50) for k in range(100)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {x.k: (x.a, x.b) for x in Q.quantiles(df, "v", {"a": .25, "b": .9}, ["k"]).collect()}
    for k in range(3):
        v = [b for a, b in rows if a == k]
        assert got[k] == pytest.approx((np.quantile(v, .25), np.quantile(v, .9)))


def test_class_accuracy_of_an_empty_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "gold int, label int")
    got = {r["class"]: (r.matched, r.n, r.accuracy) for r in A.class_accuracy(df).collect()}
    assert got == {"0": (0, 0, 0.0), "1": (1, 2, .5), "total": (1, 2, .5)}


def test_first_exit_counts_the_prior(spark):
    hist = spark.createDataFrame([(1, 0, .12), (1, 1, .5), (2, 0, .12), (2, 1, .01), (2, 2, .9)], "subject long, step long, p double")
    th = spark.createDataFrame([(.05, .8)], "bogus double, real double")
    assert {r.subject: r.retired for r in E.first_exit(hist, th).collect()} == {2: .01}
    th = spark.createDataFrame([(.2, .8)], "bogus double, real double")
    assert {r.subject: r.retired for r in E.first_exit(hist, th).collect()} == {1: .12, 2: .12}


def test_scatter_bins_and_missing_values(spark):
    from votelens.operators import captures as K
    rows = [(0., 0., 1), (10., 5., 1), (5., 2.5, 0), (None, 1., 0), (2., None, 1), (9.99, 5., 1)]
    df = spark.createDataFrame(rows, "x double, y double, gold int")
    got = {(r.ix, r.iy): r.n for r in E.scatter_bins(df, "x", "y", cells=2).collect()}
    assert got == {(0, 0): 1, (1, 1): 3}
    by = {(r.gold, r.ix, r.iy): r.n for r in E.scatter_bins(df, "x", "y", cells=2, by=("gold",)).collect()}
    assert by == {(1, 0, 0): 1, (1, 1, 1): 2, (0, 1, 1): 1}
    one = E.scatter_bins(df.where("x = 5"), "x", "y").collect()
    assert [(r.ix, r.iy, r.n) for r in one] == [(0, 0, 1)]
    prof = {r.column: (r["rows"], r.distinct_values) for r in K_profile(df).collect()}
    assert prof == {"x": (6, 6), "y": (6, 5), "gold": (6, 2)}
    links = spark.createDataFrame([(1, "S1/a/x.jpg"), (1, "S1/b.jpg"), (2, "S2/c.jpg"), (3, None)], "CaptureEventID long, URL_Info string")
    golds = spark.createDataFrame([(1, "lion"), (9, "zebra")], "CaptureEventID long, Species string")
    assert {(r.what, r.key): r.n for r in K.season_counts(links, golds).collect()} == {
        ("season", "S1"): 2, ("season", "S2"): 1, ("season", None): 1, ("gold season", "S1"): 2, ("gold species", "lion"): 2}


def K_profile(df):
    from votelens.operators import aggregates
    return aggregates.capture_profile(df)


def test_grid_layout_places_points_over_blocks(spark):
    from votelens.operators import layout
    points = [("e", g, n, ((g * 7 + n) % 11) / 11, ((g + 3 * n) % 13) / 13) for g in range(30) for n in range(3)] + [("f", 1, 0, .5, .5)]
    df = spark.createDataFrame(points, "experiment string, golds int, n int, purity double, completeness double").repartition(4)
    for order in ("plain", "sorted"):
        got = {(r.experiment, r.golds, r.n): (r.id, r.width, r.x, r.y) for r in layout.grid_layout(df, order).collect()}
        assert sorted(v[0] for k, v in got.items() if k[0] == "e") == list(range(90)) and got["f", 1, 0] == (0, 1, 0, 0)
        assert all(w == 10 and x == i % 11 and y == i // 11 for k, (i, w, x, y) in got.items() if k[0] == "e")
    assert [k[1:] for k, v in sorted(((k, v) for k, v in {(r.experiment, r.golds, r.n): r.id for r in layout.grid_layout(df).collect()}.items() if k[0] == "e"), key=lambda z: z[1])] == [(g, n) for g in range(30) for n in range(3)]
