"""Counts, fractions and statistics over votes, scores, users and captures."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import consensus_score, controversy
from .quantiles import quantiles
from .relational import top_by


def vote_fraction(votes: DataFrame) -> DataFrame:
    """Baseline score: share of 1 votes per labelled subject, with the gold of its first vote."""
    g = votes.where(F.col("gold") != -1)
    return g.groupBy("subject").agg(F.min_by("gold", "seq").alias("gold"), F.count("*").alias("total"),
                                    F.sum("annotation").alias("votes")).select(
        "subject", "gold", (F.col("votes") / F.col("total")).alias("p"))


def dump_stats(votes: DataFrame) -> DataFrame:
    """Votes, voters, subjects, first votes and repeats of a vote table.

    Both distinct counts go through their own grouped count, so no task holds a set of all ids.
    """
    return votes.agg(F.count("*").alias("votes"), F.count_distinct("voter").alias("users"),
                     F.count_distinct("subject_id").alias("subjects"),
                     F.count_if(~F.col("seen_before")).alias("first_votes"),
                     F.count_if(F.col("seen_before")).alias("duplicates"))


def vote_split(votes: DataFrame) -> DataFrame:
    return votes.groupBy("subject").agg(F.count("*").alias("total"),
                                        F.count_if(F.col("annotation") == 1).alias("real"),
                                        F.count_if(F.col("annotation") == 0).alias("bogus"))


def _ranked(votes, score, n, below):
    split = vote_split(votes)
    if below is not None:
        split = split.where(F.col("total") < below)
    scored = split.withColumn("score", score)
    return scored if n is None else top_by(scored, "score", "subject", n)


def controversial_top(votes: DataFrame, n: int | None, version: str = "pow", below: int | None = None) -> DataFrame:
    """Subjects with the most evenly split votes; ``below`` keeps those with fewer votes than that."""
    return _ranked(votes, F.round(controversy(F.col("real"), F.col("bogus"), version), 9), n, below)


def consensus_top(votes: DataFrame, n: int | None, version: str = "pow", below: int | None = None) -> DataFrame:
    return _ranked(votes, F.round(consensus_score(F.col("real"), F.col("bogus"), version), 9), n, below)


def stat_row(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Mean, exact median and population standard deviation of values within [0, 1]."""
    keys = list(keys) or ["run"]
    rows = df if "run" not in keys else df.withColumn("run", F.lit("all"))
    base = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))
    mid = quantiles(rows, value, {"median": .5}, keys, unit=True)
    out = base.join(mid, keys)
    return out.drop("run") if keys == ["run"] else out


def score_stats(scores: DataFrame) -> DataFrame:
    return stat_row(scores, "p")


def user_stats(users: DataFrame) -> DataFrame:
    """Statistics of s0 and s1 as labelled rows."""
    long = users.select(F.explode(F.array(
        F.struct(F.lit("s0").alias("name"), F.col("s0").alias("value")),
        F.struct(F.lit("s1").alias("name"), F.col("s1").alias("value")))).alias("s")).select("s.*")
    return stat_row(long, "value", ("name",))


def all_stats(scores: DataFrame, users: DataFrame) -> DataFrame:
    """Subject and user statistics in one table."""
    return user_stats(users).unionByName(score_stats(scores).withColumn("name", F.lit("p")))


def class_accuracy(labelled: DataFrame) -> DataFrame:
    """Matched / n per gold class and in total; 0 for an empty class."""
    hit = F.col("label") == F.col("gold")
    sums = labelled.agg(*[x for g in (0, 1) for x in (
        F.count_if(F.col("gold") == g).alias(f"n{g}"), F.count_if((F.col("gold") == g) & hit).alias(f"m{g}"))])
    row = lambda name, m, n: F.struct(F.lit(name).alias("class"), m.alias("matched"), n.alias("n"))
    m0, m1, n0, n1 = (F.col(c) for c in ("m0", "m1", "n0", "n1"))
    return sums.select(F.explode(F.array(row("0", m0, n0), row("1", m1, n1), row("total", m0 + m1, n0 + n1))).alias("r")) \
        .select("r.*").withColumn("accuracy", F.when(F.col("n") > 0, F.col("matched") / F.col("n")).otherwise(0.0))


def gold_counts(golds: DataFrame, keys=()) -> DataFrame:
    return golds.groupBy(*keys).agg(*[F.count_if(F.col("gold") == g).alias(n) for n, g in
                                      (("n_none", -1), ("n_bogus", 0), ("n_real", 1))])


def threshold_split(scores: DataFrame, low: float, high: float) -> DataFrame:
    p = F.col("p")
    return scores.agg(F.count_if(p < low).alias("low"), F.count_if((p >= low) & (p > high)).alias("high"),
                      F.count_if((p >= low) & (p <= high)).alias("other"))


def minmax_normalise(points: DataFrame, columns, keys) -> DataFrame:
    """(x - min) / (max - min) per group, 0 where constant."""
    ends = points.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in
                                       (("lo", F.min), ("hi", F.max))])
    j = points.join(ends, keys)
    return j.withColumns({f"{c}_n": F.when(F.col(f"_hi_{c}") != F.col(f"_lo_{c}"),
                                           (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")))
                          .otherwise(0.0) for c in columns}).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def range_stats(points: DataFrame, columns, keys) -> DataFrame:
    """Minimum, maximum and middle of each column."""
    return points.groupBy(*keys).agg(*[x for c in columns for x in (
        F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), ((F.min(c) + F.max(c)) / 2).alias(f"{c}_middle"))])


def base_rate_cut(scores: DataFrame, column: str = "p", out: str = "label") -> DataFrame:
    """Label 1 above the score quantile at 1 - prevalence of gold 1. Rows without a score stay unlabelled."""
    level = scores.agg((1 - F.count_if(F.col("gold") == 1) / F.count("*")).alias("level"))
    cut = quantiles(scores.withColumn("run", F.lit("all")), column, {"cut": level}, ["run"])
    return (scores.withColumn("run", F.lit("all")).join(F.broadcast(cut), "run").drop("run")
            .withColumn(out, (F.col(column) > F.col("cut")).cast("int")).drop("cut"))


def pred_by_name(preds: DataFrame) -> DataFrame:
    """Median prediction per object name."""
    return quantiles(preds, "pred", {"pred": .5}, ["file"], unit=True)


def label_by_name(preds: DataFrame) -> DataFrame:
    """Most frequent label per name; the lowest one on ties."""
    c = preds.groupBy("file", "label").agg(F.count("*").alias("k"))
    return c.groupBy("file").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("label"))


def unpivot(df: DataFrame, ids, values, name="variable", value="value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def pivot_fill(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """Long to wide with 0 for absent cells; the wide columns are named, so no extra job finds them."""
    return df.groupBy(row).pivot(column, values).agg(F.first(value)).na.fill(0)


def capture_profile(captures: DataFrame) -> DataFrame:
    """Row count and distinct values per column, one row per column, from one scan of any number of columns. Missing is one value.

    Equal values of a task are counted before the shuffle, so a value that most rows hold is one row per task.
    """
    longs = captures.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in captures.columns])).alias("r"))
    per_value = longs.groupBy("r.column", "r.value").agg(F.count("*").alias("k"))
    return per_value.groupBy("column").agg(F.sum("k").alias("rows"), F.count("*").alias("distinct_values"))


def user_bin_confusion(votes: DataFrame) -> DataFrame:
    """n, pos, tp, fp, fn, tn per (voter, bin) over labelled votes with a known bin."""
    g, a = F.col("gold"), F.col("annotation")
    return votes.where(g.isin(0, 1) & F.col("bin").isNotNull() & ~F.isnan(F.col("bin").cast("double"))).groupBy(
        "voter", "bin").agg(
        F.count("*").alias("n"), F.count_if(g == 1).alias("pos"), F.count_if((g == 1) & (a == 1)).alias("tp"),
        F.count_if((g == 0) & (a == 1)).alias("fp"), F.count_if((g == 1) & (a == 0)).alias("fn"),
        F.count_if((g == 0) & (a == 0)).alias("tn"))
