"""Exact, interpolated quantiles from running counts.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer. Here equal values
are counted first, the distinct ones are ordered in blocks, and a quantile is a minimum over the rows
whose running count passes its place.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .prefix import range_blocks, running, unit_blocks


def quantiles(df: DataFrame, value: str, wanted: dict, keys: list[str], unit: bool = False) -> DataFrame:
    """One row per ``keys`` with a column per wanted quantile (place (n-1) * level, interpolated).

    A level is a number, or a one-row frame that computes it. ``unit=True`` for values within [0, 1];
    others are range-partitioned.
    """
    x = F.col(value).cast("double")
    points = df.where(F.col(value).isNotNull()).groupBy(*keys, x.alias("_x")).agg(F.count("*").alias("_k"))
    points = unit_blocks(points, "_x") if unit else range_blocks(points, keys, "_x")
    ran = running(points, keys, ["_x"], sums={"_le": "_k"}, totals=True)
    levels, picks = {}, []
    for name, level in wanted.items():
        if isinstance(level, DataFrame):
            one = level.toDF(f"_l_{name}").withColumn("_j", F.lit(1))
            ran = ran.withColumn("_j", F.lit(1)).join(F.broadcast(one), "_j").drop("_j")
            levels[name] = F.col(f"_l_{name}")
        else:
            levels[name] = F.lit(float(level))
    for name, level in levels.items():
        place = F.round(level * (F.col("total__le") - 1), 9)
        picks += [F.min(F.when(F.col("_le") > F.floor(place), F.col("_x"))).alias(f"_a_{name}"),
                  F.min(F.when(F.col("_le") > F.ceil(place), F.col("_x"))).alias(f"_b_{name}"),
                  F.max(place - F.floor(place)).alias(f"_f_{name}")]
    got = ran.groupBy(*keys).agg(*picks)
    return got.select(*keys, *[
        (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n) for n in wanted])


def quantile_bin(df: DataFrame, column: str, parts: int, out: str) -> DataFrame:
    """Number (1-based) of the right-closed quantile interval; the lowest value falls outside (null)."""
    run = df.withColumn("_run", F.lit("all"))
    names = [f"q{i}" for i in range(parts + 1)]
    cuts = quantiles(run, column, {n: i / parts for i, n in enumerate(names)}, ["_run"])
    cuts = cuts.select("_run", F.array(*names).alias("_cuts"))
    joined = run.join(F.broadcast(cuts), "_run")
    below = F.size(F.filter("_cuts", lambda c: c < F.col(column)))
    return joined.withColumn(out, F.when(below > 0, below)).drop("_cuts", "_run")
