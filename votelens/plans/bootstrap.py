"""Bootstrap rounds: confident scores become silver labels of the next round."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates, consensus, evaluate
from ..operators.prefix import union_all
from ..params import Params
from ..session import land


def silver_update(scores: DataFrame, golds: DataFrame, low: float, high: float) -> DataFrame:
    """Next labels: p < low -> 0, p > high -> 1, true golds always as they are."""
    p = F.col("p")
    silver = (scores.join(golds.select("subject"), "subject", "left_anti")
              .select("subject", F.when(p < low, 0).when(p > high, 1).alias("gold")).where("gold is not null"))
    return silver.unionByName(golds.select("subject", "gold"))


def bootstrap_round(votes: DataFrame, silver: DataFrame, golds: DataFrame, low: float, high: float,
                    params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(scores of this round, labels of the next)."""
    scores = consensus.static_scores(votes, silver, params)
    return scores, silver_update(scores, golds, low, high)


def bootstrap_loop(votes: DataFrame, golds: DataFrame, rounds: int, low: float, high: float,
                   changes: dict | None = None, params: Params = Params()) -> DataFrame:
    """(round, subject, p, silver, own, low, high) over all rounds; ``changes`` maps a 0-based round to
    new limits. ``own`` marks training labels; those without votes have no p.

    Every round is written to the shared folder, so plans stay one round deep and a lost executor costs
    no earlier round.
    """
    first = land(consensus.first_vote_per_pair(votes), "first_votes")
    own = golds.select("subject", F.col("gold").alias("_g"))
    silver, rows = golds.select("subject", "gold"), []
    for i in range(rounds):
        if changes and i in changes:
            low, high = changes[i]
        scores = consensus.static_scores(first, silver, params)
        p = F.col("p")
        done = land(
            scores.select("subject", "p").join(own, "subject", "full")
            .select(F.lit(i + 1).alias("round"), "subject", "p",
                    F.coalesce("_g", F.when(p < low, 0).when(p > high, 1)).alias("silver"),
                    F.col("_g").isNotNull().alias("own"),
                    F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")), f"round{i + 1}")
        rows.append(done)
        silver = done.where("silver is not null").select("subject", F.col("silver").alias("gold"))
    return union_all(rows)


def silver_metrics(rounds: DataFrame, true_golds: DataFrame) -> DataFrame:
    """Per round: silver labels by class (training labels included), subjects still open, accuracy of the
    labels against the true golds by class, score statistics and the limits in force."""
    j = rounds.join(true_golds.select("subject", F.col("gold").alias("true")), "subject", "left")
    t, s = F.col("true"), F.col("silver")

    def accuracy(g):
        return F.coalesce(F.try_divide(F.count_if((s == g) & (t == g)), F.count_if(s.isNotNull() & (t == g))), F.lit(0.0))

    base = j.groupBy("round").agg(
        F.count_if(s == 0).alias("silver0"), F.count_if(s == 1).alias("silver1"), F.count_if(s.isNull()).alias("remaining"),
        accuracy(0).alias("accuracy0"), accuracy(1).alias("accuracy1"), F.max("low").alias("low"), F.max("high").alias("high"))
    return base.join(aggregates.stat_row(rounds, "p", ("round",)), "round")


def bootstrap_roc(rounds: DataFrame, true_golds: DataFrame, round_: int | None = None,
                  silver_only: bool = False) -> DataFrame:
    """(round, subject, gold, p) for labelled subjects, of one round or all, optionally silver ones only."""
    rows = rounds if round_ is None else rounds.where(F.col("round") == round_)
    if silver_only:
        rows = rows.where("silver is not null and not own")
    voted = rows.where("p is not null")
    return evaluate.roc_pairs(evaluate.with_golds(voted, true_golds), runs=["round"])


def bootstrap_traces(rounds: DataFrame) -> DataFrame:
    """Score by round of each subject with the class of the last round, 2 while it is open.
    The number of rounds bounds the list."""
    last = F.max_by(F.coalesce("silver", F.lit(2)), "round")
    return rounds.groupBy("subject").agg(
        last.alias("class"),
        F.transform(F.array_sort(F.collect_list(F.struct("round", "p"))), lambda r: r["p"]).alias("scores"))
