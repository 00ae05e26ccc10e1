"""Keyed state of a stream, in hash buckets and folded parts.

A table has fixed hash buckets over its key columns. Batch k writes one part, split by bucket; a batch reads the buckets of its own keys only, as a partition
filter, so all other files stay closed. Parts are folded like the digits of a counter: after ``fan`` parts of one level the last ``fan`` become one
part of the next. Before batch k there are hence at most (fan - 1) parts per level and log(k) levels, and a row is rewritten once per level. Which parts
these are follows from k alone: nothing is listed or looked up, a replayed batch reads the same parts as before, and writes its own again.

``buckets`` should be so many that one bucket's files fit a task; it is fixed for the life of the store.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, types as T, functions as F

BUCKET = "bucket"
WARM = -1


@dataclass(frozen=True)
class BucketStore:
    """``sums``: columns that add up per key; without any, a key is simply known (repeats in several parts are one)."""
    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple
    sums: tuple = ()
    buckets: int = 64
    fan: int = 8

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    # ---- parts -------------------------------------------------------------------------------
    def _part(self, level: int, first: int) -> str:
        return f"{self.path}/{'warm' if first == WARM else f'level={level}/from={first}'}"

    def parts(self, below: int) -> list[str]:
        """The parts that hold all batches before ``below``, the largest first."""
        out, at = [self._part(0, WARM)], 0
        level = 0
        while self.fan ** (level + 1) <= below:
            level += 1
        for n in range(level, -1, -1):
            size = self.fan ** n
            while at + size <= below:
                out.append(self._part(n, at))
                at += size
        return out

    def _write(self, rows: DataFrame, path: str) -> None:
        rows = rows.select(*self.schema.fieldNames(), self.bucket())
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)

    def _open(self, paths: list[str], wanted: list[int] | None) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        # one reader per part: each has its own root, under which the buckets are partitions
        frames = [self.spark.read.schema(schema).parquet(p) for p in paths]
        if wanted is not None:
            frames = [f.where(F.col(BUCKET).isin(wanted)) for f in frames]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.drop(BUCKET)

    def _folded(self, rows: DataFrame) -> DataFrame:
        if not self.sums:
            return rows.distinct()
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    # ---- use ---------------------------------------------------------------------------------
    def write(self, rows: DataFrame, batch: int) -> None:
        """The part of one batch (``WARM``: what was there before the first); a repeated batch overwrites it. Full levels are folded."""
        self._write(rows, self._part(0, batch))
        level = 1
        while batch >= 0 and (batch + 1) % self.fan ** level == 0:
            first, size = batch + 1 - self.fan ** level, self.fan ** (level - 1)
            self._write(self._folded(self._open([self._part(level - 1, first + i * size) for i in range(self.fan)], None)), self._part(level, first))
            level += 1

    def read(self, below: int, wanted: list[int] | None = None) -> DataFrame:
        """Rows of all batches before ``below``, of the wanted buckets only (default all); sums are not yet added up across parts."""
        return self._open(self.parts(below), wanted)

    def state(self, below: int, wanted: list[int] | None = None) -> DataFrame:
        return self._folded(self.read(below, wanted))
