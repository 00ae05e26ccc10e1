"""Exact top-k by inner product: term-at-a-time accumulation over postings, in blocks.

A vector is a sparse row of integer weights per dimension (term). Candidates and queries are packed into blocks of ``block`` rows as they are read, so
no id and no vector can fill one; query blocks, the smaller side, are sent to the candidate blocks, and each pair of blocks is one unit of work. In it the candidates
are turned into postings per term, every query scatters its weights term by term into a dense score array, the k best
are picked by partition selection, and the partial lists are merged by rank. No score leaves its block beyond k rows.

Cases: vectors that are null, or hold null or non-finite components, take no part. An empty vector scores 0 everywhere;
vectors of different lengths meet in their common dimensions. Ties go to the smaller id. Rows with a null id take no
part. A candidate is any row whose id differs from the query's; repeated rows are candidates (and queries) each. A weight or
score that exceeds a long raises an error. Empty table: no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import land
from .hardneg import LIMIT, _packed


@dataclass(frozen=True)
class TopKParams:
    k: int = 5
    query_every: int = 50
    scale: float = 256.
    block: int = 4096


def integer_vectors(df: DataFrame, p: TopKParams, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, w): usable rows with floor(scale * x) per component."""
    x = F.col(vec)
    ok = (F.col(id_col).isNotNull() & x.isNotNull()
          & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))))
    whole = lambda v: F.when(F.abs(v.cast("double") * p.scale) < LIMIT, F.floor(v.cast("double") * p.scale)).otherwise(
        F.raise_error(F.lit("a weight exceeds a long")).cast("long"))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("w"))


def _blocks(rows: DataFrame, p: TopKParams, name: str) -> DataFrame:
    """(part, seq, <name>id, <name>dim, <name>w): landed blocks of rows, ``w`` a flat matrix with ``dim`` columns."""
    longs = pa.list_(pa.int64())

    def run(batches):
        for seq, (ids, _, m) in enumerate(_packed(batches, p.block)):
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int32()), pa.array([ids], longs), pa.array([m.shape[1]], pa.int32()), pa.array([m.ravel()], longs)],
                                             ["seq", f"{name}id", f"{name}dim", f"{name}w"])
    blocks = rows.withColumn("label", F.lit(0).cast("long")).mapInArrow(run, f"seq int, {name}id array<long>, {name}dim int, {name}w array<long>")
    return land(blocks.withColumn("part", F.spark_partition_id()), "topk-blocks")


def _best(qid, q, cid, c, k):
    """Rows (query, candidate, score) of the k best per query within one pair of blocks."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    postings = [np.flatnonzero(c[:, d]) for d in range(c.shape[1])]
    weights = [c[ids, d] for d, ids in enumerate(postings)]
    out = []
    n = min(q.shape[1], c.shape[1])
    bound = float((np.abs(q[:, :n].astype(float)).max(0, initial=0) * np.abs(c[:, :n].astype(float)).max(0, initial=0)).sum()) if len(q) and len(c) else 0.
    if bound >= LIMIT:                                          # whole numbers of any size; what is no long in the end raises
        q, weights = q.astype(object), [x.astype(object) for x in weights]
    score = np.empty(len(cid), q.dtype)
    for i, row in zip(qid, q):
        score[:] = 0
        for d in np.flatnonzero(row[:len(postings)]):       # scatter term by term
            ids = postings[d]
            if len(ids) == len(score):
                score += row[d] * weights[d]
            else:
                score[ids] += row[d] * weights[d]
        valid = np.flatnonzero(cid != i)
        s = score[valid]
        if len(s) > k:
            cut = np.partition(s, len(s) - k)[len(s) - k] if s.dtype != object else sorted(s)[len(s) - k]
            above = np.flatnonzero(s > cut)
            pick = np.concatenate((above, np.flatnonzero(s == cut)[:k - len(above)]))    # ids ascend: ties to the smaller
        else:
            pick = np.arange(len(s))
        out.append((np.full(len(pick), i), cid[valid][pick], np.array([int(x) for x in s[pick]], np.int64)))
    return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ()))]


def top_k(vectors: DataFrame, queries: DataFrame, p: TopKParams = TopKParams()) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``queries`` against ``vectors`` (both: id, w)."""
    cand, query = _blocks(vectors, p, "c"), _blocks(queries, p, "q").drop("part", "seq")
    parts = 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # query blocks are numbered by the candidate blocks they meet: all of them, part by part
    per = cand.groupBy("part").agg((F.max("seq") + 1).alias("n"))
    last = cand.agg(F.max("part")).first()[0]
    meet = (query.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last)) if last is not None else F.array().cast("array<int>")))
            .join(per, "part").withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n"))
    pairs = cand.repartition(parts, "part", "seq").join(meet, ["part", "seq"]).select("cid", "cdim", "cw", "qid", "qdim", "qw")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                value = lambda c: b.column(c)[i].values.to_numpy(zero_copy_only=False)
                (cid, c), (qid, q) = ((value(x + "id"), value(x + "w").reshape(-1, max(b.column(x + "dim")[i].as_py(), 1))) for x in "cq")
                # without dimensions there is nothing to add up
                c, q = (m if len(m) else np.zeros((len(ids), 0), np.int64) for ids, m in ((cid, c), (qid, q)))
                a, found, s = _best(qid, q, cid, c, p.k)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(found, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.k)
            .select("query_id", "rank", "vec_id", "score"))
