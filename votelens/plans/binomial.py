"""Binomial models of volunteer skill: successes out of trials per (voter, bin), on bin, voter, both, and both with interaction.

Models whose fit is a group's rate (none, bin, voter, and the full model, whose groups are the cells) need no iteration: deviance, log-likelihood
and degrees of freedom are sums over cells. The additive model has a coefficient per voter, however many there are. Its Newton step splits: given the few
bin coefficients, each voter's own is one number, so the voters are eliminated one by one (a sum over voters of bins x bins numbers), the bins are solved
from that sum, and each voter's step follows from it. No voter's number comes to the driver.

A voter (or bin) with successes only, or none, is fitted exactly by a coefficient that grows without end: it adds nothing to the deviance and is
left out of the iteration, but counts among the coefficients.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import land

#: Models from small to large, and the columns their rates are taken over.
CLOSED = {"null": [], "bin": ["bin"], "user": ["voter"], "bin*user": ["voter", "bin"]}
_EXACT = 16


def cells(counts: DataFrame, good: Column, total: Column) -> DataFrame:
    """(voter, bin, k, m): successes and trials of each cell that has any."""
    return counts.select("voter", F.col("bin").cast("string").alias("bin"), good.cast("double").alias("k"), total.cast("double").alias("m")).where("m > 0")


def _x_log(k: Column, of: Column) -> Column:
    """k log(k / of), 0 for k = 0."""
    return F.when(k > 0, k * F.log(k / of)).otherwise(F.lit(0.))


def log_factorial(n: Column) -> Column:
    """log n!: a table by rule for small n, Stirling's series beyond (to 12 digits)."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(_EXACT)])
    x = F.greatest(n, F.lit(float(_EXACT)))
    series = (x + .5) * F.log(x) - x + .5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
    return F.when(n < _EXACT, F.element_at(table, F.least(n, F.lit(float(_EXACT - 1))).cast("int") + 1)).otherwise(series)


def _saturated(rows: DataFrame) -> DataFrame:
    """One row: cells, and twice the log-likelihood of the model that fits every cell."""
    k, m = F.col("k"), F.col("m")
    ways = log_factorial(m) - log_factorial(k) - log_factorial(m - k)
    return rows.agg(F.count("*").alias("n"), (2 * F.sum(ways + _x_log(k, m) + _x_log(m - k, m))).alias("ll2"))


def closed_models(rows: DataFrame) -> DataFrame:
    """(model, deviance, df, aic) of the models in ``CLOSED``, as sums."""
    from ..operators.prefix import union_all
    whole, out = _saturated(rows), []
    for name, by in CLOSED.items():
        # deviance of a rate per group: the cells' terms less the group's, which depends on sums only
        k, m = F.col("k"), F.col("m")
        per = rows.groupBy(*by).agg(F.sum("k").alias("k"), F.sum("m").alias("m"), F.sum(_x_log(k, m) + _x_log(m - k, m)).alias("own"))
        out.append(per.agg((2 * F.sum(F.col("own") - _x_log(F.col("k"), F.col("m")) - _x_log(F.col("m") - F.col("k"), F.col("m")))).alias("deviance"),
                           F.count("*").alias("terms")).select(F.lit(name).alias("model"), F.greatest("deviance", F.lit(0.)).alias("deviance"), "terms"))
    both = union_all(out).withColumn("_j", F.lit(1)).join(F.broadcast(whole.withColumn("_j", F.lit(1))), "_j")
    return both.select("model", "deviance", (F.col("n") - F.col("terms")).alias("df"), (F.col("deviance") - F.col("ll2") + 2 * F.col("terms")).alias("aic"))


# ---- bin + user ------------------------------------------------------------------------------

def _wide(rows: DataFrame, bins: list[str]) -> DataFrame:
    """(voter, k, m): arrays over the bins, one row per voter."""
    per = lambda c: F.array(*[F.coalesce(F.max(F.when(F.col("bin") == b, F.col(c))), F.lit(0.)) for b in bins])
    return rows.groupBy("voter").agg(per("k").alias("k"), per("m").alias("m"))


def _total(a: str, use: list[int]) -> Column:
    return sum((F.get(a, F.lit(j)) for j in use), F.lit(0.))


def _live(wide: DataFrame, bins: list[str]) -> tuple[DataFrame, list[int]]:
    """Voters and bins whose coefficients are finite: those with a success and a failure among each other, until nothing more drops out."""
    use = list(range(len(bins)))
    while True:
        k, m = _total("k", use), _total("m", use)
        voters = wide.where((k > 0) & (k < m))
        sums = voters.agg(*[F.sum(F.get(c, F.lit(j))).alias(f"{c}{j}") for c in "km" for j in use]).first()
        keep = [j for j in use if sums[f"k{j}"] and 0 < sums[f"k{j}"] < sums[f"m{j}"]]
        if keep == use or not keep:
            return voters, keep
        use = keep


def _islands(wide: DataFrame, bins: list[str]) -> int:
    """Groups of bins that no voter links: the additive model has one coefficient less for each. At most 2^bins masks come back."""
    mask = sum((F.when(F.get("m", F.lit(j)) > 0, 1 << j).otherwise(0) for j in range(len(bins))), F.lit(0))
    groups: list = []
    for (got,) in wide.select(mask.alias("g")).distinct().collect():
        for g in [g for g in groups if g & got]:
            groups.remove(g)
            got |= g
        groups.append(got)
    return len(groups)


def additive_model(rows: DataFrame, tol: float = 1e-9, max_iter: int = 40) -> DataFrame:
    """(model, deviance, df, aic) of bin + user."""
    spark = rows.sparkSession
    bins = sorted(r.bin for r in rows.select("bin").distinct().collect())          # as many numbers as there are bins
    if not bins:
        return spark.createDataFrame([], "model string, deviance double, df long, aic double")
    wide = land(_wide(rows, bins), "glm-wide")
    voters, use = _live(wide, bins)
    n_voters, islands = wide.count(), _islands(wide, bins)
    whole = _saturated(rows).first()
    k, m = (lambda j: F.get("k", F.lit(j))), (lambda j: F.get("m", F.lit(j)))
    deviance = 0.
    if use and voters.take(1):
        beta = np.zeros(len(use))
        state = land(voters.withColumn("a", F.log(_total("k", use) / (_total("m", use) - _total("k", use)))), "glm-state")
        last = math.inf
        for _ in range(max_iter):
            p = [1 / (1 + F.exp(-(F.col("a") + float(b)))) for b in beta]
            w = [m(j) * q * (1 - q) for j, q in zip(use, p)]
            r = [k(j) - m(j) * q for j, q in zip(use, p)]
            each = state.select("voter", "k", "m", "a", F.array(*w).alias("w"), F.array(*r).alias("r"), F.array(*p).alias("p"))
            ws, rs = _total("w", range(len(use))), _total("r", range(len(use)))
            g = lambda c, i: F.get(c, F.lit(i))
            size = range(len(use))
            fit = sum((_x_log(k(j), m(j) * g("p", i)) + _x_log(m(j) - k(j), m(j) * (1 - g("p", i))) for i, j in enumerate(use)), F.lit(0.))
            got = each.agg((2 * F.sum(fit)).alias("dev"),
                           F.array(*[F.sum(g("r", i) - g("w", i) * rs / ws) for i in size]).alias("rhs"),
                           F.array(*[F.sum((g("w", i) if i == j else F.lit(0.)) - g("w", i) * g("w", j) / ws) for i in size for j in size]).alias("s")).first()
            deviance = got.dev
            if abs(last - deviance) <= tol * (abs(deviance) + 1):
                break
            last = deviance
            # the bins' coefficients are known up to a constant (one per island): the least step solves it
            step = np.linalg.pinv(np.array(got.s).reshape(len(use), len(use)), rcond=1e-10) @ np.array(got.rhs)
            step = np.clip(step, -4, 4)
            moved = (rs - sum((g("w", i) * float(d) for i, d in enumerate(step)), F.lit(0.))) / ws
            state = land(each.select("voter", "k", "m", (F.col("a") + F.least(F.greatest(moved, F.lit(-4.)), F.lit(4.))).alias("a")), "glm-state")
            beta = beta + step
    terms = n_voters + len(bins) - islands
    return spark.createDataFrame([("bin+user", float(deviance), int(whole.n - terms), float(deviance - whole.ll2 + 2 * terms))], "model string, deviance double, df long, aic double")


def models(rows: DataFrame) -> DataFrame:
    return closed_models(rows).unionByName(additive_model(rows))


# ---- tests between models --------------------------------------------------------------------

def chi_square_tail(x: float, df: float) -> float:
    """P(chi-square with ``df`` > x): the regularised upper incomplete gamma function, by its series or its continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0 or a <= 0:
        return 1.
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0., 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


#: What is tested: terms added one after the other, and the one term whose deletion leaves the others whole.
ANOVA = (("bin", "null"), ("bin+user", "bin"), ("bin*user", "bin+user"))
DROP = (("bin*user", "bin+user"),)


def tests(fits: DataFrame) -> DataFrame:
    """(test, model, smaller, drop, terms, p_value, aic_smaller) between nested ``fits`` (a handful of rows)."""
    by = {r.model: r for r in fits.collect()}
    out = []
    for kind, pairs in (("anova", ANOVA), ("drop1", DROP)):
        for large, small in pairs:
            if large in by and small in by:
                drop, terms = by[small].deviance - by[large].deviance, by[small].df - by[large].df
                out.append((kind, large, small, float(drop), int(terms), chi_square_tail(drop, terms), float(by[small].aic)))
    return fits.sparkSession.createDataFrame(out, "test string, model string, smaller string, drop double, terms long, p_value double, aic_smaller double")
