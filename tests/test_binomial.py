"""Binomial models against a dense numpy fit, and the chi-square tail against known values."""
import math

import numpy as np
import pytest

from votelens.plans import binomial as G

CELLS = "voter string, bin string, k double, m double"


def dense(rows, columns):
    """(deviance, rank) by Newton on the whole design matrix."""
    x = np.array([columns(r) for r in rows], float)
    k, m = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (m * p * (1 - p))[:, None]).T @ x
        b = b + np.clip(np.linalg.pinv(h, rcond=1e-12) @ (x.T @ (k - m * p)), -3, 3)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-13, 1 - 1e-13)
    log = lambda a, of: np.where(a > 0, a * np.log(np.maximum(a, 1e-300) / of), 0)
    return 2 * (log(k, m * p) + log(m - k, m * (1 - p))).sum(), np.linalg.matrix_rank(x)


def data(seed, voters=25, bins=4, full=.8):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 1, voters), rng.normal(0, .7, bins)
    rows = []
    for u in range(voters):
        for j in range(bins):
            if rng.random() < full:
                m = int(rng.integers(1, 40))
                rows.append((f"u{u}", f"b{j}", float(rng.binomial(m, 1 / (1 + math.exp(-a[u] - b[j])))), float(m)))
    return rows


def designs(rows):
    voters, bins = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    one = lambda x, of: [float(x == v) for v in of]
    return {"null": lambda r: [1.], "bin": lambda r: one(r[1], bins), "user": lambda r: one(r[0], voters), "bin+user": lambda r: one(r[1], bins) + one(r[0], voters)}


@pytest.mark.parametrize("seed, full", [(1, 1.), (2, .6)])
def test_models_against_a_dense_fit(spark, seed, full):
    rows = [r for r in data(seed, full=full)]
    # two voters who are never, or always, right, and two bins that only one voter saw: a second island
    rows += [("all", "b0", 5., 5.), ("all", "b1", 3., 3.), ("none", "b2", 0., 7.), ("far", "x0", 3., 9.), ("far", "x1", 5., 6.)]
    got = {r.model: r for r in G.models(spark.createDataFrame(rows, CELLS)).collect()}
    choose = sum(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + (k * math.log(k / m) if k else 0) + ((m - k) * math.log((m - k) / m) if m > k else 0) for _, _, k, m in rows)
    for name, columns in designs(rows).items():
        deviance, rank = dense(rows, columns)
        assert got[name].deviance == pytest.approx(deviance, abs=1e-4), name
        assert got[name].df == len(rows) - rank, name
        assert got[name].aic == pytest.approx(deviance - 2 * choose + 2 * rank, abs=1e-4)
    assert got["bin*user"].deviance == pytest.approx(0, abs=1e-9) and got["bin*user"].df == 0


def test_more_voters_than_a_dense_solver_takes(spark):
    rows = data(5, voters=5000)
    got = G.additive_model(spark.createDataFrame(rows, CELLS)).first()
    # the same optimum by turns: voters with bins fixed, bins with voters fixed
    voters, bins = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    k, m = np.zeros((len(voters), len(bins))), np.zeros((len(voters), len(bins)))
    at = {v: i for i, v in enumerate(voters)}
    for u, b, x, n in rows:
        k[at[u], bins.index(b)], m[at[u], bins.index(b)] = x, n
    a, beta = np.zeros(len(voters)), np.zeros(len(bins))
    live = (k.sum(1) > 0) & (k.sum(1) < m.sum(1))
    for _ in range(300):
        for axis in (1, 0):
            p = 1 / (1 + np.exp(-(a[:, None] + beta)))
            r, w = (k - m * p)[live].sum(0) if axis == 0 else (k - m * p).sum(1), (m * p * (1 - p))[live].sum(0) if axis == 0 else (m * p * (1 - p)).sum(1)
            if axis:
                a[live] += np.clip(r[live] / w[live], -2, 2)
            else:
                beta += r / w
    p = 1 / (1 + np.exp(-(a[:, None] + beta)))[live]
    k, m = k[live], m[live]
    log = lambda x, of: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / of), 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        want = 2 * np.nansum(log(k, m * p) + log(m - k, m * (1 - p)))
    assert got.deviance == pytest.approx(want, rel=1e-6)
    assert got.df == len(rows) - (len(voters) + len(bins) - 1)


@pytest.mark.parametrize("x, df, p", [(3.841458820694124, 1, .05), (18.307038053275146, 10, .05), (124.34211340400407, 100, .05), (0., 3, 1.), (10., 2, math.exp(-5)),
                                      (1., 1, math.erfc(math.sqrt(.5))), (200., 1, math.erfc(10.)), (900., 1000, .98970)])
def test_chi_square_tail(x, df, p):
    assert G.chi_square_tail(x, df) == pytest.approx(p, rel=2e-3 if df == 1000 else 1e-9)


def test_log_factorial(spark):
    got = spark.range(0, 200).select(G.log_factorial(G.F.col("id").cast("double")).alias("v")).collect()
    assert [r.v for r in got] == [pytest.approx(math.lgamma(i + 1), abs=1e-10) for i in range(200)]


def test_tests_between_models(spark):
    fits = G.models(spark.createDataFrame(data(7), CELLS))
    got = {(r.test, r.model): r for r in G.tests(fits).collect()}
    assert set(got) == {("anova", "bin"), ("anova", "bin+user"), ("anova", "bin*user"), ("drop1", "bin*user")}
    assert got["anova", "bin+user"].p_value < 1e-6 and got["anova", "bin*user"].p_value == got["drop1", "bin*user"].p_value > .001
    assert all(r["drop"] >= 0 and r.terms > 0 for r in got.values())


def test_empty(spark):
    assert G.tests(G.additive_model(spark.createDataFrame([], CELLS))).count() == 0
