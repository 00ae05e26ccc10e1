"""Independent scoring runs per metadata bin, all bins in one job."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import consensus
from ..operators.relational import expert_only
from ..params import Params


def range_bin(column: str, edges) -> Column:
    """Lower edge of the half-open range [lo, hi) a value lies in; null outside all ranges."""
    out = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        inside = (F.col(column) >= lo) & (F.col(column) < hi)
        out = F.when(inside, F.lit(float(lo))) if out is None else out.when(inside, F.lit(float(lo)))
    return out


def split_scores(votes: DataFrame, golds: DataFrame, metadata: DataFrame, bin_: Column,
                 params: Params = Params()) -> DataFrame:
    """(bin, subject, p): voters earn and spend their matrix within a bin only."""
    first = consensus.first_vote_per_pair(votes)
    binned = first.join(metadata.select("subject", bin_.alias("bin")).where(F.col("bin").isNotNull()), "subject")
    users = consensus.user_matrix(binned.join(golds.where(expert_only()).select("subject", "gold"), "subject"),
                                  params, keys=("bin", "voter"))
    joined = binned.join(users.select("bin", "voter", "s0", "s1"), ["bin", "voter"], "left").withColumns(
        {"s0": F.coalesce("s0", F.lit(.5)), "s1": F.coalesce("s1", F.lit(.5))})
    return consensus.subject_scores(joined, params, keys=("bin", "subject"))
