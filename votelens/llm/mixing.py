"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame operations only.

A source's share of the total is its weight's share; a target stops at ``max_epochs`` times the source's size, and what
it cannot hold goes to the others by weight, until none is above. Sources of positive weight are clamped in the order of
cap / weight, so a round needs two sums over the sources: only these scalars reach the driver.

A document is repeated ``floor(target / size of its source)`` times whole. The rest of the target is a fractional
repetition: documents in a seeded random order take one more copy while the middle of their words lies within it, so a
source misses its target by half a document at most. The order is cut into blocks (prefixes of the hash), block sums are
carried over, and no window holds a whole source.

Cases: null text: size 0, taken 0. Null source: a source of its own, last in order. A source without words: target 0.
Repeated rows count each; equal rows share a hash, and then it does not matter which of them is taken. Null ``doc_id``:
hashed as an empty text. Empty table: no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import land

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    max_epochs: int = 3
    weights: tuple = (1, 2, 3)     # of the sources in their order, repeating
    seed: str = "mix"
    block_digits: int = 3          # hex digits of the hash: 4,096 blocks per source


def sized(docs: DataFrame, p: MixParams, *keep: str) -> DataFrame:
    """(doc_id, source, size, h, *keep): words of each text and its place in the seeded order."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.md5(F.concat_ws(":", F.lit(p.seed), F.col("doc_id").cast("string"))).alias("h"), *keep)


def order_weights(sizes: DataFrame, p: MixParams) -> DataFrame:
    """``sizes`` (source, source_size) with ``weight``: the given weights by rank, code points ascending, null last."""
    # one row per source, ranked in one task
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(int(x)) for x in p.weights]), (F.col("at") % len(p.weights) + 1).cast("int"))
    return sizes.withColumn("at", rank).withColumn("weight", pick.cast("long")).drop("at")


def water_fill(sources: DataFrame, p: MixParams) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target`` words."""
    s = sources.withColumn("cap", F.col("source_size") * p.max_epochs)
    total = s.agg(F.sum("source_size")).first()[0] or 0
    full, open_weight, last = 0, None, -1
    level = (0, 1)                 # clamped: cap * level[1] <= weight * level[0]
    while full != last:
        clamped = F.col("cap") * F.lit(level[1]) <= F.col("weight") * F.lit(level[0])
        last = full
        n, full_words, open_weight = s.agg(F.count_if(clamped), F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)),
                                           F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0))).first()
        full = n + 1
        if not open_weight:
            break
        level = (total - full_words, open_weight)
    clamped = F.col("cap") * F.lit(level[1]) <= F.col("weight") * F.lit(level[0])
    share = F.col("weight") * F.lit(level[0]) / F.lit(max(level[1], 1))
    return s.withColumn("target", F.when(clamped, F.col("cap").cast("double")).otherwise(share.cast("double"))).drop("cap")


def repetitions(docs: DataFrame, p: MixParams = MixParams(), *keep: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, *keep) for every row of ``docs``."""
    rows = land(sized(docs, p, *keep), "mix-sizes").withColumn("block", F.substring("h", 1, p.block_digits))
    # a name without null, so that window and join share one partitioning
    rows = rows.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    blocks = land(rows.groupBy("s", "source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    sizes = land(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), "mix-sources")
    targets = water_fill(order_weights(sizes, p), p).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("s"), "source_size", "target")
    before = W.partitionBy("s").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = (blocks.withColumn("carry", F.coalesce(F.sum("words").over(before), F.lit(0)))
               .join(targets, "s").select("s", "block", "source_size", "target", "carry"))
    inside = W.partitionBy("s", "block").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(carried, ["s", "block"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    more = 2 * (F.col("carry") + F.col("within")) + F.col("size") <= 2 * rest
    copies = F.col("whole") + F.when(more & (F.col("whole") < p.max_epochs), 1).otherwise(0)
    return (placed.withColumn("whole", whole).withColumn("copies", copies.cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *keep))


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mixed rows themselves: each row of ``docs`` as often as it is taken, with its columns (of any name)."""
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = repetitions(packed, p, "row").where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
