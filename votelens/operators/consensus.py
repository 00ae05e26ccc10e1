"""Consensus scoring: voter confusion matrices and subject posteriors.

Votes carry ``voter, subject, annotation, seq``. The posterior odds of a subject are multiplied by one
factor per vote, so a subject's log-odds is a sum over its votes and a voter's matrix a ratio of counts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..params import Params
from .prefix import hot_blocks, running


# ---- votes -----------------------------------------------------------------------------------

def first_vote_per_pair(votes: DataFrame) -> DataFrame:
    """Only a voter's first vote on a subject counts.

    ``min`` over one long that holds (seq, annotation): a hash aggregate with partial minima, so a pair
    that repeats without end still arrives as one row per map task. Equal ``seq`` keeps the 0 vote. A vote that is neither
    0 nor 1 does not fit that number and does not count.
    """
    code = F.shiftleft(F.col("seq"), 1).bitwiseOR(F.col("annotation").cast("bigint"))
    # both null tests are spelled out, so every later join finds them in place and shares this shuffle
    return (votes.where(F.col("voter").isNotNull() & F.col("subject").isNotNull() & F.col("annotation").isin(0, 1))
            .groupBy("voter", "subject").agg(F.min(code).alias("_code"))
            .select("voter", "subject",
                    F.shiftright("_code", 1).alias("seq"),
                    F.col("_code").bitwiseAND(F.lit(1).cast("bigint")).cast("int").alias("annotation")))


def votes_with_gold(votes: DataFrame, golds: DataFrame) -> DataFrame:
    """Left join without a hint: Spark broadcasts golds only when their size allows it."""
    g = golds.select("subject", "gold")
    return votes.join(g, "subject", "left").withColumn("gold", F.coalesce("gold", F.lit(-1)))


def _counters() -> dict:
    """0/1 columns whose sums are seen and matched votes per gold class."""
    right = F.col("annotation") == F.col("gold")
    return {
        "seen0": (F.col("gold") == 0).cast("int"),
        "match0": ((F.col("gold") == 0) & right).cast("int"),
        "seen1": (F.col("gold") == 1).cast("int"),
        "match1": ((F.col("gold") == 1) & right).cast("int"),
    }


def _smoothed(matched: str, seen: str, params: Params) -> Column:
    return (F.col(matched) + params.gamma) / (F.col(seen) + 2 * params.gamma)


def user_matrix(gold_votes: DataFrame, params: Params = Params(), keys=("voter",)) -> DataFrame:
    """Final (s0, s1) and vote count per voter (the count only if no key is called ``n``)."""
    extra = [] if "n" in keys else [F.count("*").alias("n")]
    sums = gold_votes.groupBy(*keys).agg(*extra, *[F.sum(c).alias(n) for n, c in _counters().items()])
    return sums.select(*keys, _smoothed("match0", "seen0", params).alias("s0"),
                       _smoothed("match1", "seen1", params).alias("s1"), *(["n"] if extra else []),
                       "seen0", "match0", "seen1", "match1")


def user_prefix_matrix(gold_votes: DataFrame, params: Params = Params(), inclusive: bool = False,
                       keys=("voter",), source: DataFrame | None = None) -> DataFrame:
    """(s0, s1) of the voter just before (or just after) each vote. ``source``: see ``hot_blocks``."""
    rows = gold_votes.select("*", *[c.alias(f"_{n}") for n, c in _counters().items()])
    rows = hot_blocks(rows, "voter", "seq", params, source)
    out = running(rows, list(keys), ["seq"], sums={n: f"_{n}" for n in _counters()}, inclusive=inclusive,
                  hot_only=True)
    return (out.withColumn("s0", _smoothed("match0", "seen0", params))
            .withColumn("s1", _smoothed("match1", "seen1", params))
            .drop(*[f"_{n}" for n in _counters()]))


# ---- posterior -------------------------------------------------------------------------------

def _factors():
    real = F.col("annotation") == 1
    return F.when(real, F.col("s1")).otherwise(1 - F.col("s1")), \
        F.when(real, 1 - F.col("s0")).otherwise(F.col("s0"))


NANO = 1e9


def log_ratio() -> Column:
    """Log of the factor a vote puts on the odds, in whole billionths; null where a factor is zero.

    Whole numbers add up to the same sum in any order and in any engine, so equal votes tie exactly, however many there are.
    """
    a, b = _factors()
    return F.when((a > 0) & (b > 0), F.round(F.lit(NANO) * F.log(a / b)).cast("bigint"))


def absorbed() -> Column:
    """1 / 0 where a vote with exactly one zero factor fixes the score from there on, else null."""
    a, b = _factors()
    return F.when((a > 0) & (b == 0), F.lit(1)).when((a == 0) & (b > 0), F.lit(0))


def logistic(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def posterior(total: Column, fixed: Column | None, params: Params) -> Column:
    """``total``: summed ``log_ratio``. Not rounded: scores differ as far as doubles do (up to log-odds of about 37)."""
    p = logistic(F.log(F.lit(params.p0 / (1 - params.p0))) + F.coalesce(total, F.lit(0)) / F.lit(NANO))
    return p if fixed is None else F.coalesce(fixed.cast("double"), p)


def subject_scores(scored_votes: DataFrame, params: Params = Params(), keys=("subject",),
                   imported: bool = False) -> DataFrame:
    """Last posterior per subject from votes that carry the voter's (s0, s1).

    ``imported=True`` for matrices that may hold exact zeros or ones: the first vote with one zero factor
    fixes the score. It needs ``seq``; smoothed matrices never get there.
    """
    aggs = [F.sum(log_ratio()).alias("_llr"), F.count("*").alias("n_votes")]
    fixed = None
    if imported:
        code = F.shiftleft(F.col("seq"), 1).bitwiseOR(absorbed().cast("bigint"))
        aggs.append(F.min(F.when(absorbed().isNotNull(), code)).alias("_fixed"))
        fixed = F.col("_fixed").bitwiseAND(F.lit(1).cast("bigint"))
    out = scored_votes.groupBy(*keys).agg(*aggs)
    return out.select(*keys, posterior(F.col("_llr"), fixed, params).alias("p"), "n_votes")


def dynamic_votes(votes: DataFrame, golds: DataFrame, params: Params = Params()) -> DataFrame:
    """Each counted vote with its gold and the voter's matrix before it."""
    return user_prefix_matrix(votes_with_gold(first_vote_per_pair(votes), golds), params, source=votes)


def dynamic_scores(votes: DataFrame, golds: DataFrame, params: Params = Params()) -> DataFrame:
    """Ordered scoring: a vote weighs what its voter was known to be worth at that moment.

    Only the voter side needs an ordered pass; the subject side is a plain sum.
    """
    return subject_scores(dynamic_votes(votes, golds, params), params)


def static_votes(votes: DataFrame, golds: DataFrame, params: Params = Params()) -> DataFrame:
    """Each counted vote with the voter's final matrix.

    Only votes on labelled subjects feed the matrix, so the join with golds is inner and comes first;
    voters without such a vote stand at .5 / .5.
    """
    first = first_vote_per_pair(votes)
    users = user_matrix(first.join(golds.where(F.col("gold").isin(0, 1)).select("subject", "gold"),
                                   "subject"), params).select("voter", "s0", "s1")
    return apply_user_scores(first, users)


def apply_user_scores(first_votes: DataFrame, users: DataFrame) -> DataFrame:
    joined = first_votes.join(users.select("voter", "s0", "s1"), "voter", "left")
    return joined.withColumns({"s0": F.coalesce("s0", F.lit(0.5)), "s1": F.coalesce("s1", F.lit(0.5))})


def static_scores(votes: DataFrame, golds: DataFrame, params: Params = Params()) -> DataFrame:
    """Two-pass scoring: every vote weighs what its voter is worth in the end."""
    return subject_scores(static_votes(votes, golds, params), params)


# A new gold set after a run always means scoring again with it.
rescore = static_scores


def subject_prefix_scores(scored_votes: DataFrame, params: Params = Params(), keys=("subject",),
                          imported: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Posterior after each vote, with the vote's position (0-based) in its subject's list."""
    rows = scored_votes.withColumn("_llr", F.coalesce(log_ratio(), F.lit(0))).withColumn("_one", F.lit(1))
    mins = {}
    if imported:
        code = F.shiftleft(F.col("seq"), 1).bitwiseOR(absorbed().cast("bigint"))
        rows = rows.withColumn("_fix", F.when(absorbed().isNotNull(), code))
        mins = {"fixed": "_fix"}
    rows = hot_blocks(rows, "subject", "seq", params, source)
    out = running(rows, list(keys), ["seq"], sums={"log_odds": "_llr", "step": "_one"}, mins=mins,
                  hot_only=True)
    fixed = F.col("fixed").bitwiseAND(F.lit(1).cast("bigint")) if imported else None
    return (out.withColumn("p", posterior(F.col("log_odds"), fixed, params))
            .withColumn("vote_order", F.col("step") - 1)
            .drop("_llr", "_one", "_fix", "fixed"))


def score_history(scored_votes: DataFrame, params: Params = Params(), source: DataFrame | None = None) -> DataFrame:
    """One row per (subject, step): step 0 is the prior, step k the posterior after vote k.

    Rows instead of one array per subject, so that a subject with very many votes stays spread out.
    """
    steps = subject_prefix_scores(scored_votes, params, source=source).select("subject", F.col("step").cast("bigint"), "p")
    # the prior rides on each subject's first vote: no second pass for the list of subjects
    return steps.select(F.explode(F.when(
        F.col("step") == 1, F.array(F.struct("subject", F.lit(0).cast("bigint").alias("step"), F.lit(params.p0).alias("p")),
                                    F.struct("subject", "step", "p")))
        .otherwise(F.array(F.struct("subject", "step", "p")))).alias("r")).select("r.*")


def user_history(gold_votes: DataFrame, params: Params = Params(), source: DataFrame | None = None) -> DataFrame:
    """Running s0 and s1 per voter, lined up by position, and their mean.

    The k-th value of s0 is reached at the voter's k-th gold-0 vote (s1 likewise); position 0 is the
    untrained .5. The shorter list is padded with its last value, which is the voter's final score.
    """
    seen = gold_votes.where(F.col("gold").isin(0, 1))
    ran = user_prefix_matrix(seen, params, inclusive=True, source=source)
    is0 = F.col("gold") == 0
    steps = ran.select("voter", F.when(is0, F.col("seen0")).otherwise(F.col("seen1")).cast("bigint").alias("step"),
                       F.when(is0, F.col("s0")).alias("s0"), F.when(~is0, F.col("s1")).alias("s1"))
    ends = user_matrix(seen, params).select("voter", F.col("s0").alias("_e0"), F.col("s1").alias("_e1"))
    start = ends.select("voter", F.lit(0).cast("bigint").alias("step"), F.lit(.5).alias("s0"), F.lit(.5).alias("s1"))
    lined = (steps.unionByName(start).groupBy("voter", "step").agg(F.max("s0").alias("s0"), F.max("s1").alias("s1"))
             .join(ends, "voter"))
    s0, s1 = F.coalesce("s0", "_e0"), F.coalesce("s1", "_e1")
    return lined.select("voter", "step", s0.alias("s0"), s1.alias("s1"), ((s0 + s1) / 2).alias("mean"))


def user_quadrant() -> Column:
    """Which quadrant of the (s0, s1) plane a voter is in."""
    # Quadrant names.
    return (F.when((F.col("s0") > .5) & (F.col("s1") > .5), "Astute")
            .when((F.col("s0") > .5), "Pessimistic")
            .when((F.col("s1") > .5), "Optimistic")
            .otherwise("Obtuse"))
