"""Joins between votes, golds, scores, users and metadata. No side is broadcast by hint: all grow with
the data, and Spark broadcasts whichever turns out small."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .evaluate import with_golds as scores_with_gold  # noqa: F401  (same operator)


def score_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(p_a, p_b) and their difference on common subjects."""
    j = a.select("subject", F.col("p").alias("p_a")).join(b.select("subject", F.col("p").alias("p_b")), "subject")
    return j.withColumn("diff", F.col("p_b") - F.col("p_a"))


def score_diff_runs(base: DataFrame, others: DataFrame) -> DataFrame:
    """The same against many runs at once; ``others`` carries ``run``."""
    j = others.select("run", "subject", F.col("p").alias("p_b")).join(
        base.select("subject", F.col("p").alias("p_a")), "subject")
    return j.withColumn("diff", F.col("p_b") - F.col("p_a"))


def user_score_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """b - a of s0, s1 and vote count on common voters, and the sign of the count difference."""
    pick = lambda d, t: d.select("voter", *[F.col(c).alias(f"{c}_{t}") for c in ("s0", "s1", "n")])
    j = pick(a, "a").join(pick(b, "b"), "voter")
    return j.select("voter", *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"d_{c}") for c in ("s0", "s1", "n")],
                    F.signum((F.col("n_b") - F.col("n_a")).cast("double")).cast("int").alias("class"))


def user_error_vs_base(base: DataFrame, other: DataFrame) -> DataFrame:
    """a - b / a per voter and class, division first, as the comparison is defined."""
    pick = lambda d, t: d.select("voter", *[F.col(c).alias(f"{c}_{t}") for c in ("s0", "s1")])
    j = pick(base, "a").join(pick(other, "b"), "voter")
    return j.select("voter", *[(F.col(f"{c}_a") - F.col(f"{c}_b") / F.col(f"{c}_a")).alias(f"error{c[1]}")
                               for c in ("s0", "s1")])


def metadata_latest(rows: DataFrame, order: str = "load_seq") -> DataFrame:
    """The latest metadata row per subject, all columns from the same row."""
    others = [c for c in rows.columns if c not in ("subject",)]
    best = rows.groupBy("subject").agg(F.max_by(F.struct(*others), order).alias("r"))
    return best.select("subject", *[F.col(f"r.{c}").alias(c) for c in others])


def subjects_with_scores(metadata: DataFrame, scores: DataFrame) -> DataFrame:
    """Metadata with score and label (p > .5); null without votes."""
    return metadata.join(scores.select("subject", "p"), "subject", "left").withColumn(
        "label", F.when(F.col("p").isNotNull(), (F.col("p") > .5).cast("int")))


def score_fallback_mean(full: DataFrame, by_mag: DataFrame, by_seeing: DataFrame) -> DataFrame:
    """Mean of the full and the two split scores; a missing split score counts as the full one."""
    j = (full.select("subject", F.col("p").alias("p_full"))
         .join(by_mag.select("subject", F.col("p").alias("p_mag")), "subject", "left")
         .join(by_seeing.select("subject", F.col("p").alias("p_seeing")), "subject", "left"))
    mag, seeing = F.coalesce("p_mag", "p_full"), F.coalesce("p_seeing", "p_full")
    return j.select("subject", "p_full", mag.alias("p_mag"), seeing.alias("p_seeing"),
                    ((F.col("p_full") + mag + seeing) / 3).alias("p_mean"))


def gold_images(gold_captures: DataFrame, links: DataFrame) -> DataFrame:
    return gold_captures.join(links, "CaptureEventID")


def with_group(df: DataFrame, keys: list[str], aggs: dict) -> DataFrame:
    """Group aggregates beside every row of the group.

    Aggregate and join back rather than a window: partial sums before the shuffle, and the join splits a
    key that is too large, whereas a window partition cannot be split.
    """
    return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys, "left")


def votes_on_golds(votes: DataFrame, labels: DataFrame) -> DataFrame:
    return votes.join(labels.select("subject"), "subject", "left_semi")
