"""How good volunteers are, by experience, image quality and user type."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import cut_breaks
from ..params import Params
from .joins import with_group
from .prefix import hot_blocks, running

INF = float("inf")
# Vote-count limits and names of the user types.
TYPE_BREAKS, TYPE_NAMES = (0, 10, 50, 500, INF), ("Rare", "Casual", "Regular", "Power")
# Per-bin minimum of votes behind the bin-wise user types.
BIN_TYPES = ((500, "1) mega"), (100, "2) power"), (30, "3) frequent"), (10, "4) casual"))
RARE = "5) rare"


def user_rank_types(votes: DataFrame, params: Params = Params(), source: DataFrame | None = None) -> DataFrame:
    """Position of each vote among its voter's votes, their total, user type and score quarter.

    Votes carry ``voter, seq, subject, annotation, gold, machine_score``. ``source``: see ``hot_blocks``.
    """
    rows = hot_blocks(votes.withColumn("_one", F.lit(1)), "voter", "seq", params, source)
    ranked = running(rows, ["voter"], ["seq"], sums={"rank": "_one"}, hot_only=True).drop("_one")
    out = with_group(ranked, ["voter"], {"n_class": F.max("rank")})
    return out.withColumns({
        "correct": (F.col("annotation") == F.col("gold")).cast("int"),
        "user_type": cut_breaks(F.col("n_class"), TYPE_BREAKS, TYPE_NAMES),
        "ml_score": cut_breaks(F.col("machine_score"), (0, .25, .5, .75, 1),
                               tuple(f"Q{i} - ML Score" for i in range(1, 5)))})


def rank_breaks(step: int = 30, end: int = 500) -> tuple:
    return tuple(range(0, end, step)) + ((end,) if end % step == 0 else ()) + (INF,)


def skill_by_bucket(ranked: DataFrame, by=(), breaks=None, min_support: int = 50, min_users: int = 0) -> DataFrame:
    """Share of correct votes and support per (gold, rank bucket, ...)."""
    bucket = cut_breaks(F.col("rank"), breaks or rank_breaks())
    out = ranked.groupBy("gold", bucket.alias("rank_bucket"), *by).agg(
        (F.sum("correct") / F.count("*")).alias("p_correct"), F.count("*").alias("support"),
        *([F.count_distinct("voter").alias("n_users")] if min_users else []))
    out = out.where(F.col("support") >= min_support)
    return out.where(F.col("n_users") >= min_users) if min_users else out


def skill_measures(ranked: DataFrame, breaks=None, min_support: int = 50, min_users: int = 20) -> DataFrame:
    """Precision, recalls, accuracy and F1 per (rank bucket, user type).

    Precision divides by all rows of the cell, as the analysis defines it.
    """
    bucket = cut_breaks(F.col("rank"), breaks or rank_breaks())
    hit1 = F.sum(F.col("correct") * F.col("gold"))
    hit0 = F.sum(F.col("correct") * (F.col("gold") == 0).cast("int"))
    out = ranked.groupBy(bucket.alias("rank_bucket"), "user_type").agg(
        (hit1 / F.count("*")).alias("precision"), F.try_divide(hit1, F.sum("gold")).alias("recall_pos"),
        F.try_divide(hit0, F.count_if(F.col("gold") == 0)).alias("recall_neg"),
        (F.sum("correct") / F.count("*")).alias("accuracy"), F.count("*").alias("support"),
        F.count_distinct("voter").alias("n_users"))
    p, r = F.col("precision"), F.col("recall_pos")
    return (out.where((F.col("support") >= min_support) & (F.col("n_users") >= min_users))
            .withColumn("f1", F.try_divide(2 * (p * r), p + r)))


def binned_rates(labelled: DataFrame, bin_column: str) -> DataFrame:
    """True / false rates of two scorers (slabel, mlabel), F1 and prevalence per bin."""
    g = F.col("gold")
    aggs = []
    for name in ("crowd", "machine"):
        lab = F.col("slabel" if name == "crowd" else "mlabel")
        for short, l, t in (("tp", 1, 1), ("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1)):
            aggs.append(F.try_divide(F.count_if((lab == l) & (g == t)), F.count_if(g == t)).alias(f"{short}_{name}"))
    out = labelled.where(F.col(bin_column).isNotNull()).groupBy(bin_column).agg(
        *aggs, (F.count_if(g == 1) / F.count("*")).alias("pos"))
    return out.withColumns({f"f1_{n}": F.try_divide(2 * F.col(f"tp_{n}"), 2 * F.col(f"tp_{n}") + F.col(f"fp_{n}") + F.col(f"fn_{n}"))
                            for n in ("crowd", "machine")})


def bin_user_types(bin_counts: DataFrame, n_bins: int) -> DataFrame:
    """Best type a voter reaches: all ``n_bins`` bins above a type's limit; rare with any bin below 10.

    The five stacked groups and the minimum over them come from two figures per voter: the number of bins
    and the smallest bin.
    """
    per = bin_counts.groupBy("voter").agg(*[F.count_if(F.col("n") >= k).alias(f"b{k}") for k, _ in BIN_TYPES],
                                          F.count_if(F.col("n") < 10).alias("below"))
    out = None
    for k, name in BIN_TYPES:
        hit = F.col(f"b{k}") == n_bins
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return per.select("voter", out.when(F.col("below") > 0, RARE).alias("user_type")).where("user_type is not null")


def skill_deviation(bin_counts: DataFrame, n_bins: int) -> DataFrame:
    """P(1 | real) and P(0 | bogus) per (voter, bin), and their deviation from the voter's own mean and
    from the mean of the (bin, type)."""
    typed = bin_counts.join(bin_user_types(bin_counts, n_bins), "voter").withColumns({
        "p_tp": F.try_divide("tp", "pos"), "p_tn": F.try_divide("tn", F.col("n") - F.col("pos"))})
    # a voter has at most one row per bin, so these groups are small or the keys few
    own = with_group(typed, ["voter"], {"tp_own": F.avg("p_tp"), "tn_own": F.avg("p_tn")})
    both = with_group(own, ["bin", "user_type"], {"tp_meta": F.avg("p_tp"), "tn_meta": F.avg("p_tn")})
    return both.select("voter", "bin", "user_type", "p_tp", "p_tn",
                       (F.col("p_tp") - F.col("tp_own")).alias("p_tp_rel"),
                       (F.col("p_tn") - F.col("tn_own")).alias("p_tn_rel"),
                       (F.col("p_tp") - F.col("tp_meta")).alias("p_tp_rel_meta"),
                       (F.col("p_tn") - F.col("tn_meta")).alias("p_tn_rel_meta"))
