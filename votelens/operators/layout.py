"""Point layouts and samples behind the plots (data sets only)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .aggregates import minmax_normalise
from .prefix import range_blocks, running


def trace_sample(history: DataFrame, golds: DataFrame, n: int = 1000) -> DataFrame:
    """Histories of the first n subjects, with their class."""
    from .evaluate import with_golds
    first = history.select("subject").distinct().orderBy("subject").limit(n)
    return with_golds(history.join(first, "subject", "left_semi"), golds)


def _cell(width: Column) -> tuple[Column, Column]:
    # a row takes width + 1 cells: the wrap test is x > width
    per_row = width + 1
    return F.col("id") % per_row, F.floor(F.col("id") / per_row).cast("int")


def grid_layout(points: DataFrame, order: str = "plain", keys=("experiment",)) -> DataFrame:
    """Cell positions of trial points: in plain order, or best first ("sorted"), on ceil(sqrt n) columns.

    Places are running counts over range-partitioned blocks, so an experiment of any number of points is spread over tasks.
    """
    norm = minmax_normalise(points, ["purity", "completeness"], list(keys))
    rank = F.round(F.pow(1 - F.col("purity_n"), F.lit(2)) + F.pow(F.col("completeness_n"), F.lit(2)), 9) if order == "sorted" else F.lit(0.)
    by = ["_rank", "golds", "n"]
    blocks = range_blocks(norm.withColumn("_rank", rank).withColumn("_one", F.lit(1)), [*keys, "_rank", "golds"], "n")
    ran = running(blocks, list(keys), by, sums={"_id": "_one"}, totals=True)
    width = F.ceil(F.sqrt(F.col("total__id"))).cast("int")
    placed = ran.withColumn("id", (F.col("_id") - 1).cast("int")).withColumn("width", width)
    x, y = _cell(F.col("width"))
    return placed.withColumn("x", x.cast("int")).withColumn("y", y).drop("_rank", "_one", "_id", "total__id")


def column_layout(points: DataFrame, keys=("experiment",), step: int = 1000) -> DataFrame:
    """One column of cells per group of ``golds // step``."""
    norm = minmax_normalise(points, ["purity", "completeness"], list(keys))
    group = F.floor(F.col("golds") / step)
    w = W.partitionBy(*keys).orderBy("golds", "n")
    inner = W.partitionBy(*keys, group).orderBy("golds", "n")
    return (norm.withColumn("id", F.row_number().over(w) - 1)
            .withColumn("x", F.dense_rank().over(W.partitionBy(*keys).orderBy(group)) - 1)
            .withColumn("y", F.row_number().over(inner) - 1))


def first_detection(files: DataFrame) -> DataFrame:
    """Earliest date per object, with its file."""
    return files.groupBy("object").agg(F.min("mjd").alias("mjd"), F.min_by("file", F.struct("mjd", "file")).alias("file"))
