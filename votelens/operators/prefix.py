"""Running sums and minima that no single key, however large, can pile into one task.

A window over ``partitionBy(key).orderBy(order)`` sends all rows of a key to one task. Here a key may
carry a ``block`` number that grows with ``order``: the window then runs per (key, block), and what the
earlier blocks of that key add up to is joined on. The join keys are the window's own partitioning, so
the large side is not shuffled a second time.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DatetimeType, NumericType

from ..params import Params
from ..session import land

BLOCK = "block"
STEP = 32


def _levels(n: int):
    """The levels 1/n ... (n-1)/n as one expression: a list would be a node of the plan per number."""
    return F.from_json(F.lit(str([i / n for i in range(1, n)])), "array<double>")


def hot_cuts(source: DataFrame, key: str, order: str, params: Params = Params()) -> DataFrame:
    """(key, _coarse, _fine): where the rows of each large key are cut, as a table that is computed with the query.

    A block should hold ``split_rows`` rows, or the table's rows over ``shares`` if that is more. A key above that is cut
    into as many blocks as it needs, at quantiles of ``order`` over its own rows, so neither many large keys nor a burst at one time fill a block. The quantiles
    only place the cuts; the sums stay exact. Keys that hold more than one ``shares``-th of all rows are fewer than ``shares``, and so are
    the cuts of all keys together: that bounds what is broadcast, whatever the size of the table.
    """
    n = params.shares
    rows = source.select(F.col(key).alias("_key"), F.col(order).alias("_at")).where("_key IS NOT NULL")
    per = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    fair = F.greatest(F.lit(params.split_rows), F.ceil(per.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar() / n))
    large = per.withColumn("_fair", fair).where("_n > _fair")
    large = large.select("_key", F.ceil(F.col("_n") / F.col("_fair")).cast("int").alias("_blocks"))
    marks = rows.join(F.broadcast(large), "_key").groupBy("_key").agg(
        F.first("_blocks").alias("_blocks"), F.percentile_approx("_at", _levels(n), 10 * n).alias("_q"))
    at = F.transform(F.sequence(F.lit(1), F.col("_blocks") - 1), lambda i: F.element_at("_q", F.greatest(F.floor(i * n / F.col("_blocks")).cast("int"), F.lit(1))))
    cuts = marks.select("_key", F.array_distinct(at).alias("_cuts"))
    # two levels of at most ``STEP`` cuts and their heads, so that a row is placed by a few dozen comparisons
    fine = F.transform(F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / STEP).cast("int")), lambda j: F.slice("_cuts", STEP * j + 1, F.lit(STEP)))
    return cuts.select("_key", fine.alias("_fine")).select("_key", F.transform("_fine", lambda f: f[0]).alias("_coarse"), "_fine")


def hot_blocks(df: DataFrame, key: str, order: str, params: Params = Params(),
               source: DataFrame | None = None) -> DataFrame:
    """Add ``block``: it grows with ``order`` within a large key (see ``hot_cuts``) and is -1 for all others.

    Building the plan starts no job. The rows per key are counted with partial counts, from ``source`` if given: an earlier table with
    at least these rows, so that the count is a scan of two columns. Where no key is large the cuts are an empty table, and adaptive execution takes the
    join and all that follows from it out of the plan. An order that is neither number nor time is not cut.
    """
    if not isinstance(df.schema[order].dataType, (NumericType, DatetimeType)):
        return df
    cuts = hot_cuts(df if source is None else source, key, order, params)
    below = lambda marks: F.size(F.filter(marks, lambda c: c < F.col(order)))
    head = below(F.col("_coarse"))
    block = F.when(F.col("_fine").isNull(), -1).when(head == 0, 0).otherwise(STEP * (head - 1) + below(F.element_at("_fine", head)))
    placed = df.join(F.broadcast(cuts), F.col(key) == F.col("_key"), "left")
    return placed.withColumn(BLOCK, block.cast("int")).drop("_key", "_coarse", "_fine")


def range_blocks(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Range-partition by (keys, order), number the partitions and land the result.

    Spark's own sampling places the bounds, so no value range and no run can fill one block. The number
    must not change when a task is repeated, hence the written table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, order)
    landed = land(ranged.withColumn(BLOCK, F.spark_partition_id()), "ranged")
    return landed.withColumn(BLOCK, F.coalesce(BLOCK, F.lit(0)))


def unit_blocks(df: DataFrame, order: str) -> DataFrame:
    """Blocks for an order column within [0, 1]: tenths of its log-odds from -40 to 40. No sampling, no extra job."""
    x = F.col(order)
    # never null: the join on it then adds no filter, and both uses of the frame share one shuffle
    inside = F.coalesce(F.floor(10 * F.log(x / (1 - x))), F.lit(0))
    at = F.when(x <= 0, -400).when(x >= 1, 400).otherwise(F.least(F.greatest(inside, F.lit(-400)), F.lit(400)))
    return df.withColumn(BLOCK, F.coalesce(at, F.lit(0)).cast("int"))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict | None = None,
            mins: dict | None = None, inclusive: bool = True, totals: bool = False, hot_only: bool = False) -> DataFrame:
    """Append running sums / minima per ``keys`` in ``order``.

    ``sums`` and ``mins`` map new column names to the columns added up. ``inclusive=False`` leaves the
    current row out. ``totals=True`` also appends ``total_<name>`` for every sum. Uses ``block`` if the
    frame has one (and drops it); ``hot_only=True`` says that rows outside hot keys carry block -1.
    """
    sums, mins = sums or {}, mins or {}
    end = 0 if inclusive else -1
    blocked = BLOCK in df.columns
    parts = keys + [BLOCK] if blocked else keys
    w = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    local = df.select(
        "*",
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in sums.items()],
        *[F.min(c).over(w).alias(n) for n, c in mins.items()])
    if totals and not blocked:
        whole = W.partitionBy(*keys)
        local = local.select("*", *[F.sum(c).over(whole).alias(f"total_{n}") for n, c in sums.items()])
    if not blocked:
        return local

    per_block = ((df.where(F.col(BLOCK) >= 0) if hot_only else df)
                 .groupBy(*parts)
                 .agg(F.count("*").alias("_rows"),
                      *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
                      *[F.min(c).alias(f"_m_{n}") for n, c in mins.items()]))
    before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys)
    carry = per_block.select(
        *parts,
        *[F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.min(f"_m_{n}").over(before).alias(f"_c_{n}") for n in mins],
        *([F.sum(f"_s_{n}").over(every).alias(f"total_{n}") for n in sums] if totals else []))
    # large keys have fewer blocks than twice ``shares``; with further keys beside them Spark decides by size
    joined = local.join(F.broadcast(carry) if hot_only and len(keys) == 1 else carry, parts, "left")
    joined = joined.withColumns({
        **{n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums},
        **{n: F.least(F.col(n), F.col(f"_c_{n}")) for n in mins}})
    return joined.drop(BLOCK, *[f"_c_{n}" for n in [*sums, *mins]])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
