"""Score-table evaluation: thresholds, purity, completeness, ROC, figures of merit.

A score table has ``subject, gold, p`` and may carry run columns (run, trial, bin); every operator takes
them as ``runs`` and answers for all runs in one job. Curves are built on one row per (run, distinct
score): subjects that share a score are counted before anything is ordered, so a score that a third of
all subjects share is one row, and the order among equal scores cannot change a curve.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .prefix import unit_blocks, running

ALL = "run"


def _runs(df: DataFrame, runs) -> tuple[DataFrame, list[str]]:
    """With no run column, add a constant one so windows always have a partition key."""
    runs = list(runs or [])
    return (df, runs) if runs else (df.withColumn(ALL, F.lit("all")), [ALL])


# ---- at one threshold ------------------------------------------------------------------------

def class_counts_at(scores: DataFrame, threshold: float, runs=None) -> DataFrame:
    """Subjects of each class with p >= threshold."""
    at = F.col("p") >= threshold
    return scores.groupBy(*(runs or [])).agg(
        *[F.count_if(at & (F.col("gold") == g)).alias(n) for n, g in
          (("n_none", -1), ("n_bogus", 0), ("n_real", 1))])


def composition_at(scores: DataFrame, threshold: float, runs=None) -> DataFrame:
    """Counts over labelled subjects; the unlabelled share uses the same divisor.
    Without labelled subjects the counts stay as they are."""
    c = class_counts_at(scores, threshold, runs)
    total = F.col("n_bogus") + F.col("n_real")
    div = F.when(total > 0, total).otherwise(1)
    return c.select(*(runs or []), *[(F.col(n) / div).alias(f"share_{n[2:]}") for n in
                                     ("n_none", "n_bogus", "n_real")])


def purity_at(scores: DataFrame, threshold: float, runs=None) -> DataFrame:
    c = class_counts_at(scores, threshold, runs)
    return c.select(*(runs or []),
                    F.try_divide(F.col("n_real"), F.col("n_bogus") + F.col("n_real")).alias("purity"))


def completeness_at(scores: DataFrame, threshold, runs=None) -> DataFrame:
    """Real subjects strictly above the threshold over all real subjects. ``threshold`` may be a column."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    real = F.col("gold") == 1
    return scores.groupBy(*(runs or [])).agg(
        F.try_divide(F.count_if(real & (F.col("p") > t)), F.count_if(real)).alias("completeness"))


# ---- scatter plots ---------------------------------------------------------------------------

def scatter_bins(df: DataFrame, x: str, y: str, cells: int = 20, by=()) -> DataFrame:
    """Points of a scatter plot as counts: (by, ix, iy, n) on an even grid of cells x cells over the range of each axis (one grid for all groups).

    A plot needs no more than its cells; rows with a missing value are no points. The edges' own values lie in the outer cells.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ends = rows.agg(*[f(c).alias(f"{n}{c}") for c in ("_x", "_y") for n, f in (("lo", F.min), ("hi", F.max))])
    at = _with_one_row(rows, ends)

    def place(c):
        share = F.coalesce(F.try_divide(F.col(c) - F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(f"lo{c}")), F.lit(0.))
        return F.least(F.floor(F.round(share * cells, 9)), F.lit(cells - 1)).cast("int")
    return at.groupBy(*by, place("_x").alias("ix"), place("_y").alias("iy")).agg(F.count("*").alias("n"))


# ---- the score profile -----------------------------------------------------------------------

def score_points(scores: DataFrame, runs: list[str]) -> DataFrame:
    """One row per (run, score): how many subjects of each class stand there. A table of such counts (m, z, o) is added up."""
    if {"m", "z", "o"} <= set(scores.columns):
        return scores.groupBy(*runs, "p").agg(*[F.sum(c).alias(c) for c in ("m", "z", "o")])
    return scores.groupBy(*runs, "p").agg(
        F.count_if(F.col("gold") == -1).alias("m"),
        F.count_if(F.col("gold") == 0).alias("z"),
        F.count_if(F.col("gold") == 1).alias("o"))


def score_profile(scores: DataFrame, runs=None) -> DataFrame:
    """``score_points`` plus counts at or below each score (le_*) and per run (total_le_*).

    Ordered in blocks of equal log-odds, where scores that pile up at 0 and 1 stay apart; the carried block totals are
    at most 801 rows per run.
    """
    df, keys = _runs(scores, runs)
    points = unit_blocks(score_points(df, keys), "p")
    return running(points, keys, ["p"], sums={"le_m": "m", "le_z": "z", "le_o": "o"}, totals=True)


def _strip(df: DataFrame, runs) -> DataFrame:
    return df if runs else df.drop(ALL)


def retire_thresholds(scores: DataFrame, fpr: float, mdr: float, runs=None) -> DataFrame:
    """real: lowest score at which the bogus subjects above it are fewer than ``fpr``;
    bogus: highest score at which the real subjects below it are fewer than ``mdr``; 0 if none."""
    prof = score_profile(scores, runs)
    keys = list(runs) if runs else [ALL]
    above = 1 - F.col("le_z") / F.col("total_le_z")
    at_or_above = F.col("total_le_o") - F.col("le_o") + F.col("o")
    below = 1 - at_or_above / F.col("total_le_o")
    out = prof.groupBy(*keys).agg(
        F.coalesce(F.max(F.when((F.col("o") > 0) & (below < mdr), F.col("p"))), F.lit(0.0)).alias("bogus"),
        F.coalesce(F.min(F.when((F.col("z") > 0) & (above < fpr), F.col("p"))), F.lit(0.0)).alias("real"))
    return _strip(out, runs)


def purity_threshold(scores: DataFrame, target: float, runs=None) -> DataFrame:
    """Lowest score at which, its subjects being taken away one after the other, the purity of those that
    remain rises above ``target``; 1.0 if it never does.

    Among equal scores unlabelled subjects go first, then bogus, then real ones, so the purest state of a
    score is the one right before its real subjects go (or, if it has only real ones, after the first).
    """
    prof = score_profile(scores, runs)
    keys = list(runs) if runs else [ALL]
    real_left = F.col("total_le_o") - F.col("le_o") + F.col("o") \
        - F.when((F.col("m") + F.col("z")) == 0, 1).otherwise(0)
    bogus_left = F.col("total_le_z") - F.col("le_z")
    best = F.try_divide(real_left, real_left + bogus_left)
    out = prof.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(best > target, F.col("p"))), F.lit(1.0)).alias("threshold"))
    return _strip(out, runs)


def completeness_at_purity(scores: DataFrame, target: float, runs=None) -> DataFrame:
    """``purity_threshold`` and the completeness there, from one profile."""
    prof = score_profile(scores, runs)
    keys = list(runs) if runs else [ALL]
    real_left = F.col("total_le_o") - F.col("le_o") + F.col("o") \
        - F.when((F.col("m") + F.col("z")) == 0, 1).otherwise(0)
    bogus_left = F.col("total_le_z") - F.col("le_z")
    hit = F.try_divide(real_left, real_left + bogus_left) > target
    # real subjects strictly above the first hit; none above the fall-back threshold of 1
    above = F.col("total_le_o") - F.col("le_o")
    out = prof.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(hit, F.col("p"))), F.lit(1.0)).alias("threshold"),
        F.coalesce(F.min_by(above, F.when(hit, F.col("p"))), F.lit(0)).alias("_above"),
        F.max("total_le_o").alias("_real"))
    return _strip(out.select(*keys, "threshold",
                             F.try_divide("_above", "_real").alias("completeness")), runs)


def purity_completeness_curve(scores: DataFrame, runs=None) -> DataFrame:
    """From the top score down: real subjects over all subjects so far, and over all real subjects.
    One point per distinct score."""
    prof = score_profile(scores, runs)
    so_far = [F.col(f"total_le_{c}") - F.col(f"le_{c}") + F.col(c) for c in "mzo"]
    keys = list(runs) if runs else []
    return prof.select(*keys, "p", (so_far[2] / (so_far[0] + so_far[1] + so_far[2])).alias("purity"),
                       F.try_divide(so_far[2], F.col("total_le_o")).alias("completeness"))


# ---- ROC -------------------------------------------------------------------------------------

def roc_pairs(scores: DataFrame, runs=None) -> DataFrame:
    return scores.where(F.col("gold").isin(0, 1)).select(*(runs or []), "subject", "gold", "p")


def roc_curve(scores: DataFrame, runs=None) -> DataFrame:
    """False and true positive rate when everything at or above a score counts as real.

    Every distinct score is kept. The point before the first score, (0, 0), has no row. A table of counts (m, z, o) at scores is taken as it is.
    """
    gold = scores.where("z + o > 0") if {"m", "z", "o"} <= set(scores.columns) else scores.where(F.col("gold").isin(0, 1))
    prof = score_profile(gold, runs)
    keys = list(runs) if runs else []
    fp = F.col("total_le_z") - F.col("le_z") + F.col("z")
    tp = F.col("total_le_o") - F.col("le_o") + F.col("o")
    return prof.select(*keys, F.col("p").alias("threshold"), fp.alias("fp"), tp.alias("tp"),
                       F.try_divide(fp, F.col("total_le_z")).alias("fpr"),
                       F.try_divide(tp, F.col("total_le_o")).alias("tpr"))


def auc(scores: DataFrame, runs=None) -> DataFrame:
    """Trapezoid area under the ROC curve.

    Each score adds z * (reals above it + half of those at it), so no neighbouring row is needed.
    """
    gold = scores.where(F.col("gold").isin(0, 1))
    prof = score_profile(gold, runs)
    keys = list(runs) if runs else [ALL]
    above = F.col("total_le_o") - F.col("le_o")
    out = prof.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("z") * (above + F.col("o") / 2)),
                     F.max("total_le_z").cast("double") * F.max("total_le_o")).alias("auc"))
    return _strip(out, runs)


def pr_curve(scores: DataFrame, runs=None) -> DataFrame:
    roc = roc_curve(scores, runs)
    return roc.select(*(runs or []), "threshold", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
                      F.col("tpr").alias("recall"))


def fom_mdr_at_fpr(scores: DataFrame, fpr: float = .01, runs=None) -> DataFrame:
    """Missed-detection rate and threshold at the last ROC point whose FPR is at most ``fpr``.

    If no score qualifies the curve's start (nothing accepted) is that point: rate 1, null threshold.
    """
    roc = roc_curve(scores, runs)
    ok = F.when(F.col("fpr") <= fpr, F.col("threshold"))
    return roc.groupBy(*(runs or [])).agg(
        (1 - F.coalesce(F.min_by("tpr", ok), F.lit(0.0))).alias("mdr"), F.min(ok).alias("threshold"))


def fom_fpr_at_mdr(scores: DataFrame, mdr: float = .01, runs=None) -> DataFrame:
    """False-positive rate and threshold at the first ROC point whose missed-detection rate is at most ``mdr``."""
    roc = roc_curve(scores, runs)
    ok = F.when(1 - F.col("tpr") <= mdr, F.col("threshold"))
    return roc.groupBy(*(runs or [])).agg(F.max_by("fpr", ok).alias("fpr"), F.max(ok).alias("threshold"))


def fom_grid(scores: DataFrame, levels=(.01, .05, .1), runs=None) -> DataFrame:
    """Both figures of merit at every level, from one pass over one curve."""
    runs = list(runs or [])
    roc = roc_curve(scores, runs).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    low = F.when(F.col("fpr") <= F.col("level"), F.col("threshold"))
    high = F.when(1 - F.col("tpr") <= F.col("level"), F.col("threshold"))
    return roc.groupBy(*runs, "level").agg(
        (1 - F.coalesce(F.min_by("tpr", low), F.lit(0.0))).alias("mdr_at_fpr"),
        F.max_by("fpr", high).alias("fpr_at_mdr"))


def rates_at_nearest(scores: DataFrame, threshold: float = .5, runs=None) -> DataFrame:
    """Rates at the ROC threshold nearest to the wanted one; the higher of two equally near ones."""
    roc = roc_curve(scores, runs)
    near = F.struct(F.abs(F.col("threshold") - threshold), -F.col("threshold"))
    return roc.groupBy(*(runs or [])).agg(F.min_by(F.struct("threshold", "fpr", "tpr"), near).alias("b")).select(
        *(runs or []), "b.threshold", "b.fpr", (1 - F.col("b.tpr")).alias("mdr"))


# ---- histograms and densities ----------------------------------------------------------------

def class_hist(scores: DataFrame, bins: int = 25) -> DataFrame:
    """Equal bins over the data's own range (last one closed), counted by class. Scores that are all the
    same fall into the middle bin of a range one wide."""
    gold = scores.where(F.col("gold").isin(0, 1))
    span = gold.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    lo, hi = (F.col(c) for c in ("lo", "hi"))
    pos = F.when(hi > lo, F.floor((F.col("p") - lo) * bins / (hi - lo))).otherwise(bins // 2)
    return (_with_one_row(gold, span)
            .groupBy(F.least(pos, F.lit(bins - 1)).cast("int").alias("bin"))
            .agg(F.count_if(F.col("gold") == 0).alias("bogus"), F.count_if(F.col("gold") == 1).alias("real")))


def class_hist_density(scores: DataFrame, bins: int = 50) -> DataFrame:
    """The normalised variant over all scores: share of subjects per bin divided by the bin width."""
    span = scores.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("total"))
    lo, hi = (F.col(c) for c in ("lo", "hi"))
    pos = F.when(hi > lo, F.floor((F.col("p") - lo) * bins / (hi - lo))).otherwise(bins // 2)
    out = (_with_one_row(scores, span)
           .groupBy(F.least(pos, F.lit(bins - 1)).cast("int").alias("bin"))
           .agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                F.first("total").alias("total")))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) / bins
    return out.select("bin", "n", (F.col("n") / F.col("total") / width).alias("density"))


def _with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate beside every row (an equi-join on a constant, one row wide)."""
    return (df.withColumn("_k", F.lit(1)).join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k"))


def kde(scores: DataFrame, points: int = 50, cutoff: float | None = None) -> DataFrame:
    """Gaussian density on an even grid over [0, 1], bandwidth 1.06 sd n^-.2, as log density.

    Subjects are first counted per distinct score; the grid is a literal of ``points`` numbers. Sums are
    taken per grid point before the shuffle, so it carries one row per grid point and map task.
    """
    rows = scores if cutoff is None else scores.where(F.col("p") < cutoff)
    at = rows.groupBy("p").agg(F.count("*").alias("w"))
    size = rows.agg(F.count("*").alias("n"), F.stddev_samp("p").alias("sd"))
    grid = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    bw = 1.06 * F.col("sd") / F.pow(F.col("n"), F.lit(.2))
    z = F.try_divide(F.col("x") - F.col("p"), F.col("bw"))
    parts = (_with_one_row(at, size.select("n", bw.alias("bw")))
             .select("p", "w", "n", "bw", F.posexplode(grid).alias("i", "x"))
             .withColumn("e", z * z / 2))
    # exponents are taken relative to the nearest score, so far-off grid points do not underflow
    near = parts.groupBy("i").agg(F.min("e").alias("e0"))
    dens = (parts.join(F.broadcast(near), "i").groupBy("i", "x")
            .agg((F.log(F.sum(F.col("w") * F.exp(F.col("e0") - F.col("e")))) - F.max("e0")
                  - F.log(F.max("n") * F.max("bw") * math.sqrt(2 * math.pi))).alias("log_density")))
    # 50 grid rows: one small ordered partition
    w = W.partitionBy(F.lit(1)).orderBy("i")
    before, after = F.lag("log_density").over(w), F.lead("log_density").over(w)
    here = F.col("log_density")
    return dens.select("i", "x", "log_density",
                       F.when((here < before) & (here < after), "min")
                       .when((here > before) & (here > after), "max").alias("extremum"))


def hypothesis_hist(scores: DataFrame, width: float = .04) -> DataFrame:
    """Scores by true class in bins of ``width`` on [0, 1]; marks bins where real <= bogus."""
    last = round(1 / width) - 1
    return (scores.where(F.col("gold").isin(0, 1) & F.col("p").between(0, 1))
            .groupBy(F.least(F.floor(F.round(F.col("p") / width, 9)), F.lit(last)).cast("int").alias("bin"))
            .agg(F.count_if(F.col("gold") == 1).alias("real"), F.count_if(F.col("gold") == 0).alias("bogus"))
            .withColumn("overlap", F.col("real") <= F.col("bogus")))


# ---- tests, sweeps, error lists --------------------------------------------------------------

def fdr_threshold(scores: DataFrame, alpha: float = .01, bins: int = 1000) -> DataFrame:
    """Benjamini-Hochberg on empirical p-values from the bogus scores.

    The p-value of a subject is the share of bogus subjects in its bin or a higher one. Subjects are
    counted per bin (at most ``bins`` rows), which turns the rank test into a running count: equal
    p-values pass together when the highest rank among them passes.
    """
    gold = scores.where(F.col("gold").isin(0, 1))
    per_bin = gold.groupBy(F.least(F.floor(F.round(F.col("p") * bins, 9)), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count_if(F.col("gold") == 0).alias("z"), F.count_if(F.col("gold") == 1).alias("o"))
    # at most ``bins`` rows from here on
    down = W.partitionBy(F.lit(1)).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(F.lit(1))
    ranked = per_bin.select(
        "bin", "z", "o", F.sum("z").over(down).alias("z_up"), F.sum("z").over(every).alias("zs"),
        F.sum("o").over(every).alias("os")).withColumn("p_value", F.try_divide("z_up", "zs"))
    # bins without bogus subjects share the p-value of the next bin that has some
    tied = ranked.groupBy("p_value").agg(F.sum(F.col("z") + F.col("o")).alias("k"), F.sum("z").alias("z"),
                                         F.sum("o").alias("o"), F.max("zs").alias("zs"), F.max("os").alias("os"))
    up = W.partitionBy(F.lit(1)).orderBy("p_value").rowsBetween(W.unboundedPreceding, 0)
    tested = tied.select("*", F.sum("k").over(up).alias("rank"), F.sum("z").over(up).alias("z_le"),
                         F.sum("o").over(up).alias("o_le"))
    passed = F.when(F.col("p_value") <= F.col("rank") * alpha / (F.col("zs") + F.col("os")), F.col("p_value"))
    return tested.agg(F.max(passed).alias("threshold"),
                      F.coalesce(F.max_by(F.try_divide("o_le", "os"), passed), F.lit(0.0)).alias("real_within"),
                      F.coalesce(F.max_by(F.try_divide("z_le", "zs"), passed), F.lit(0.0)).alias("bogus_within"))


def rates_sweep(scores: DataFrame, steps: int = 1000) -> DataFrame:
    """FPR, FNR and precision for thresholds 0, 1/steps, ... below 1.

    One count per step instead of one pass per threshold: a subject is accepted by the first
    floor(p * steps) + 1 thresholds. Steps without a subject get the rates of the next one that has some.
    """
    gold = scores.where(F.col("gold").isin(0, 1))
    per = gold.groupBy(F.least(F.floor(F.round(F.col("p") * steps, 9)), F.lit(steps - 1)).cast("int").alias("i")).agg(
        F.count_if(F.col("gold") == 0).alias("z"), F.count_if(F.col("gold") == 1).alias("o"))
    # ``steps`` grid rows, fixed by the parameter
    spark = scores.sparkSession
    grid = spark.range(steps, numPartitions=1).select(F.col("id").cast("int").alias("i"))
    down = W.partitionBy(F.lit(1)).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(F.lit(1))
    full = grid.join(per, "i", "left").select(
        "i", F.sum(F.coalesce("z", F.lit(0))).over(down).alias("fp"), F.sum(F.coalesce("o", F.lit(0))).over(down).alias("tp"),
        F.sum("z").over(every).alias("zs"), F.sum("o").over(every).alias("os"))
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0))
    recall = F.try_divide("tp", "os")
    return full.select("i", (F.col("i") / steps).alias("threshold"), F.try_divide("fp", "zs").alias("fpr"),
                       (1 - recall).alias("fnr"), precision.alias("precision"),
                       F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def fnr_near_fpr(sweep: DataFrame, fpr: float = .01, tolerance: float = 1e-3) -> DataFrame:
    """FNR and threshold at the last step whose FPR is within ``tolerance`` of ``fpr``; zeros if none."""
    # compare with a little slack so that decimal steps on the edge count on every machine alike
    near = F.when((F.col("fpr") >= fpr - tolerance - 1e-12) & (F.col("fpr") <= fpr + tolerance + 1e-12), F.col("i"))
    return sweep.agg(F.coalesce(F.max_by("fnr", near), F.lit(0.0)).alias("fnr"),
                     F.coalesce(F.max_by("threshold", near), F.lit(0.0)).alias("threshold"))


def error_class(threshold: float, strict: bool = False) -> Column:
    """tp / fn / fp / tn of a row. ``strict`` accepts only scores above the threshold."""
    yes = F.col("p") > threshold if strict else F.col("p") >= threshold
    real = F.col("gold") == 1
    return (F.when(real & yes, "tp").when(real, "fn").when(yes, "fp").otherwise("tn"))


def error_rows(scores: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    return scores.where(F.col("gold").isin(0, 1)).withColumn("outcome", error_class(threshold, strict))


def error_rates(scores: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    rows = error_rows(scores, threshold, strict)
    n = {c: F.count_if(F.col("outcome") == c) for c in ("tp", "fn", "fp", "tn")}
    return rows.agg(*[v.alias(k) for k, v in n.items()],
                    F.try_divide(n["fn"], n["fn"] + n["tp"]).alias("fnr"),
                    F.try_divide(n["fp"], n["fp"] + n["tn"]).alias("fpr"))


def confusion_matrix(labelled: DataFrame, normalised: bool = False) -> DataFrame:
    """Counts of (gold, label), or their share within a gold class."""
    counts = labelled.groupBy("gold", "label").agg(F.count("*").alias("n"))
    if not normalised:
        return counts
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("gold")))


def eval_summary(scores: DataFrame, exclude: int = -1, fpr: float = .01) -> DataFrame:
    """AUC, threshold at the wanted false-positive rate, missed rate there, and the confusion matrix.

    One profile feeds all figures: a score's counts say how many subjects it accepts.
    """
    gold = scores.where(F.col("gold") != exclude).where(F.col("gold").isin(0, 1))
    prof = score_profile(gold)
    fp = F.col("total_le_z") - F.col("le_z") + F.col("z")
    tp = F.col("total_le_o") - F.col("le_o") + F.col("o")
    ok = F.when(F.try_divide(fp, F.col("total_le_z")) <= fpr, F.col("p"))
    above = F.col("total_le_o") - F.col("le_o")
    s = prof.agg(
        F.try_divide(F.sum(F.col("z") * (above + F.col("o") / 2)),
                     F.max("total_le_z").cast("double") * F.max("total_le_o")).alias("auc"),
        F.min(ok).alias("threshold"),
        F.coalesce(F.min_by(tp, ok), F.lit(0)).alias("tp"), F.coalesce(F.min_by(fp, ok), F.lit(0)).alias("fp"),
        F.max("total_le_o").alias("os"), F.max("total_le_z").alias("zs"))
    return s.select("auc", "threshold", (1 - F.try_divide("tp", "os")).alias("fnr"), "tp", "fp",
                    (F.col("os") - F.col("tp")).alias("fn"), (F.col("zs") - F.col("fp")).alias("tn"))


# ---- retirement and export -------------------------------------------------------------------

def first_exit(history: DataFrame, thresholds: DataFrame) -> DataFrame:
    """First history value (the prior included) below bogus or above real, per subject that has one."""
    out = _with_one_row(history, thresholds).where((F.col("p") < F.col("bogus")) | (F.col("p") > F.col("real")))
    return out.groupBy("subject").agg(F.min_by("p", "step").alias("retired"))


def with_golds(scores: DataFrame, golds: DataFrame) -> DataFrame:
    """Replace whatever gold the scores carry by the stored one, -1 if none."""
    base = scores.drop("gold") if "gold" in scores.columns else scores
    return base.join(golds.select("subject", "gold"), "subject", "left").withColumn(
        "gold", F.coalesce("gold", F.lit(-1)))


def score_export(scores: DataFrame, history: DataFrame, golds: DataFrame, fpr: float, mdr: float,
                 spread=False) -> DataFrame:
    """(subject, gold, p, retired) for subjects with votes. ``retired`` is null while still open."""
    labelled = with_golds(scores, golds)
    exits = first_exit(history, retire_thresholds(labelled, fpr, mdr))
    return labelled.join(exits, "subject", "left").select("subject", "gold", "p", "retired")
