"""Hard negatives by inner product, with score bounds along a spanning tree of anchors.

Vectors are rows of integer weights. A negative of an anchor and one of its positives is a row of another label whose score lies in the
window [``low``, ``high``] percent of the positive's score; the ``top`` best of each are wanted.

1. *Blocks.* Candidates are packed as they are read, ``block`` rows to a block, so neither a label nor an id nor a vector can fill one. Anchors
   are range-partitioned by the signs of a few fixed projections, so that near ones meet, and packed ``tree`` to a block.
2. *Tree.* In each anchor block a minimum spanning tree is grown from the origin (Prim), whose score with everything is 0. An edge's length is the
   distance of its two ends.
3. *Bounds.* A candidate's score at a child differs from that at the parent by at most edge length times the candidate's norm. From the parent's
   interval follows the child's; only candidates whose interval meets a wanted window are scored again, exactly.
   The first walk wants the ``positives`` best rows of the own label (the window starts at the k-th largest lower bound), the second the windows of those.
4. *Merge.* Each pair of blocks gives at most ``positives`` rows per anchor, then ``top`` per anchor and positive; the best of them are ranked.

Anchor blocks are sent to the candidate blocks (every block once; anchors are the smaller side). The bound only saves work: if it excludes nothing, all
is scored, and the result is the same.

Cases: a row with a null id, label or vector, or a null or non-finite component takes no part, as anchor, positive or negative. Vectors of different
lengths meet in their common dimensions, an empty one scores 0. Ties go to the smaller id. Rows with the
anchor's own id are no positives or negatives of it; other repeated rows count each, repeated anchors give repeated results. A positive with a negative
score has an empty window, one with score 0 the window [0, 0]. Weights or scores beyond a long raise an error. Extra columns do not enter. Empty table: no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import land

LIMIT = float(1 << 62)


@dataclass(frozen=True)
class HardNegParams:
    scale: float = 256.
    anchor_every: int = 100
    relabel_every: int = 7
    labels: int = 10
    positives: int = 5
    top: int = 10
    low: int = 30
    high: int = 90
    block: int = 4096
    tree: int = 1024
    signs: int = 12
    seed: int = 5


def integer_rows(df: DataFrame, p: HardNegParams) -> DataFrame:
    """(id, label, w): usable rows with floor(scale * x) per component and the label of the contract."""
    x = F.col("embedding")
    ok = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
          & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))))
    whole = lambda v: F.when(F.abs(v.cast("double") * p.scale) < LIMIT, F.floor(v.cast("double") * p.scale)).otherwise(
        F.raise_error(F.lit("a weight exceeds a long")).cast("long"))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % p.relabel_every == 0, (label + 1) % p.labels).otherwise(label)
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.transform(x, whole).alias("w"))


# ---- blocks ----------------------------------------------------------------------------------

_FLAT = "ids array<long>, labels array<long>, dim int, w array<long>"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of weights, padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.int64)
    m = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    m[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return m


def _packed(batches, size: int):
    """(ids, labels, matrix) of ``size`` rows each."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, min(size - n, b.num_rows - at))
            held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
            if n == size:
                yield _unpacked(held)
                held, n = [], 0
    if n:
        yield _unpacked(held)


def _unpacked(parts):
    t = pa.Table.from_batches(parts).combine_chunks()
    w = t.column("w")
    return t.column("id").to_numpy(), t.column("label").to_numpy(), _matrix(w.chunk(0) if isinstance(w, pa.ChunkedArray) else w)


def candidate_blocks(rows: DataFrame, p: HardNegParams) -> DataFrame:
    """(part, seq, ids, labels, dim, w): landed blocks; ``w`` is a flat matrix with ``dim`` columns."""
    def run(batches):
        for seq, (ids, labels, m) in enumerate(_packed(batches, p.block)):
            yield pa.RecordBatch.from_pylist([{"seq": seq, "ids": ids, "labels": labels, "dim": m.shape[1], "w": m.ravel()}], _schema("seq"))
    blocks = rows.mapInArrow(run, f"seq int, {_FLAT}")
    return land(blocks.withColumn("part", F.spark_partition_id()), "hn-blocks")


def _schema(*ints, **more):
    longs = pa.list_(pa.int64())
    return pa.schema([*[(c, pa.int32()) for c in ints], ("ids", longs), ("labels", longs), ("dim", pa.int32()), ("w", longs), *more.items()])


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of ``m`` and the origin: rows in the order they join the tree, their parents (-1: the origin) and the edges' lengths."""
    x = m.astype(np.float64)
    n = len(x)
    dist = np.sqrt((x * x).sum(1))
    parent, order, edge = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
    left = np.ones(n, bool)
    for k in range(n):
        i = int(np.argmin(np.where(left, dist, np.inf)))
        order[k], edge[i], left[i] = i, dist[i], False
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = left & (d < dist)
        dist[near], parent[near] = d[near], i
    return order, parent, edge


def anchor_blocks(anchors: DataFrame, p: HardNegParams) -> DataFrame:
    """(ab, ids, labels, dim, w, walk, parent, edge): landed anchor blocks with their trees."""
    plane = np.random.default_rng(p.seed)

    def signs(w):
        # a fixed +1 / -1 pattern per projection over the dimensions met, repeated for longer vectors
        pattern = [[float(v) for v in plane.choice([-1, 1], 64)] for _ in range(p.signs)]
        total = [F.aggregate(F.transform(w, lambda v, i: v.cast("double") * F.element_at(F.array(*map(F.lit, s)), (i % 64 + 1).cast("int"))), F.lit(0.), lambda a, b: a + b)
                 for s in pattern]
        code = F.lit(0)
        for t in total:
            code = code * 2 + (t > 0).cast("int")
        return code

    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = land(anchors.withColumn("code", signs(F.col("w"))), "hn-anchors")
    near = near.repartitionByRange(parts, "code", "id").sortWithinPartitions("code", "id").select("id", "label", "w")

    def run(batches):
        for seq, (ids, labels, m) in enumerate(_packed(batches, p.tree)):
            walk, parent, edge = spanning_tree(m)
            yield pa.RecordBatch.from_pylist([{"seq": seq, "ids": ids, "labels": labels, "dim": m.shape[1], "w": m.ravel(), "walk": walk, "parent": parent, "edge": edge}],
                                             _schema("seq", walk=pa.list_(pa.int64()), parent=pa.list_(pa.int64()), edge=pa.list_(pa.float64())))
    trees = near.mapInArrow(run, f"seq int, {_FLAT}, walk array<long>, parent array<long>, edge array<double>")
    return land(trees.withColumn("ab", F.concat_ws("-", F.spark_partition_id(), "seq")).drop("seq"), "hn-trees")


# ---- bounds ----------------------------------------------------------------------------------

def exact(c: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``c`` with ``a`` as whole numbers; an error where one exceeds a long."""
    n = min(c.shape[1], len(a))
    c, a = c[:, :n], a[:n]
    if not n or not len(c):
        return np.zeros(len(c), np.int64)
    top = float(np.abs(c.astype(np.float64)).max()) * float(np.abs(a.astype(np.float64)).max()) * n
    if top < 2 ** 53:
        return (c.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    if top < LIMIT:
        return c @ a
    return np.array([int(x) for x in c.astype(object) @ a.astype(object)], np.int64)      # OverflowError beyond a long


class Walk:
    """One anchor block beside one candidate block: from the origin down the tree, with an interval per candidate."""

    def __init__(self, anchors: dict, cands: dict):
        self.a, self.c = anchors, cands
        self.c_float = cands["m"].astype(np.float64)
        self.norm = np.sqrt((self.c_float ** 2).sum(1)) * (1 + 1e-9)
        self.scored = self.seen = 0

    def visit(self, want):
        """For every anchor ``(i, candidates, scores)``: those that ``want(i, low, high)`` (a mask over all candidates) says may matter."""
        n = len(self.norm)
        waiting = np.bincount(self.a["parent"] + 1, minlength=len(self.a["walk"]) + 1)
        held = {-1: (np.zeros(n), np.zeros(n))}
        for i in self.a["walk"].tolist():
            up = int(self.a["parent"][i])
            low, high = held[up]
            slack = self.a["edge"][i] * (1 + 1e-9) * self.norm + 1e-6
            # the last term covers the rounding of whole scores beyond 2^53
            low, high = low - slack - 1e-12 * np.abs(low), high + slack + 1e-12 * np.abs(high)
            pick = np.flatnonzero(want(i, low, high))
            score = exact(self.c["m"][pick], self.a["m"][i])
            self.scored, self.seen = self.scored + len(pick), self.seen + n
            waiting[up + 1] -= 1
            if not waiting[up + 1]:
                del held[up]
            if waiting[i + 1]:
                low[pick] = high[pick] = score
                held[i] = (low, high)
            yield i, pick, score


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        pick = np.flatnonzero(score >= cut)
    else:
        pick = np.arange(len(score))
    return pick[np.lexsort((ids[pick], -score[pick]))[:k]]


def near_positives(walk: Walk, p: HardNegParams):
    """(anchor, id, score) of the best rows of the anchor's label in this block."""
    ids, labels = walk.c["ids"], walk.c["labels"]

    def want(i, low, high):
        mine = (labels == walk.a["labels"][i]) & (ids != walk.a["ids"][i])
        at = low[mine]
        if len(at) <= p.positives:
            return mine
        return mine & (high >= np.partition(at, len(at) - p.positives)[len(at) - p.positives])

    for i, pick, score in walk.visit(want):
        best = _best(score, ids[pick], p.positives)
        yield i, ids[pick][best], score[best]


def windows_of(positive: np.ndarray, p: HardNegParams) -> list[tuple[int, int]]:
    """Least and greatest score that a negative of each positive score may have."""
    return [(-(-p.low * int(s) // 100), p.high * int(s) // 100) for s in positive]


def window_negatives(walk: Walk, positives: dict, p: HardNegParams):
    """(anchor, place of the positive, id, score) of the best rows of other labels within each positive's window, in this block."""
    ids, labels = walk.c["ids"], walk.c["labels"]
    spans = {i: windows_of(s, p) for i, s in positives.items()}

    def want(i, low, high):
        meet = np.zeros(len(ids), bool)
        for lo, hi in set(spans.get(i, ())):
            if lo <= hi:
                meet |= (high >= lo) & (low <= hi)
        return meet & (labels != walk.a["labels"][i]) & (ids != walk.a["ids"][i])

    for i, pick, score in walk.visit(want):
        done: dict = {}
        for k, (lo, hi) in enumerate(spans.get(i, ())):
            if (lo, hi) not in done:
                inside = np.flatnonzero((score >= lo) & (score <= hi))
                best = inside[_best(score[inside], ids[pick][inside], p.top)]
                done[lo, hi] = ids[pick][best], score[best]
            yield i, k, *done[lo, hi]


# ---- the two walks on Spark ------------------------------------------------------------------

def _meet(cands: DataFrame, trees: DataFrame, parts: int, extra: list[str]) -> DataFrame:
    """Every anchor block beside every candidate block, joined on the candidate block's number."""
    per = cands.groupBy("part").agg((F.max("seq") + 1).alias("n"))
    last = cands.agg(F.max("part")).first()[0]
    sent = (trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-1 if last is None else last)) if last is not None else F.array().cast("array<int>")))
            .join(per, "part").withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n"))
    sent = sent.select("part", "seq", "ab", *extra, *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "dim", "w", "walk", "parent", "edge")])
    return cands.repartition(parts, "part", "seq").join(sent, ["part", "seq"])


def _walks(batches):
    for b in batches:
        for i in range(b.num_rows):
            value = lambda c: b.column(c)[i].values.to_numpy(zero_copy_only=False)
            side = lambda x: {"ids": value(x + "ids"), "labels": value(x + "labels"), "m": value(x + "w").reshape(len(value(x + "ids")), -1)}
            a = side("a_") | {k: value("a_" + k) for k in ("walk", "parent", "edge")}
            yield b, i, Walk(a, side(""))


def hard_negatives(rows: DataFrame, anchors: DataFrame, p: HardNegParams = HardNegParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``rows`` and ``anchors``: id, label, w."""
    spark = rows.sparkSession
    cands, trees = candidate_blocks(rows, p), anchor_blocks(anchors, p)
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    columns = lambda *x: [c if isinstance(c, pa.Array) else pa.array(c) for c in x]

    def first(batches):
        for b, r, walk in _walks(batches):
            ab = b.column("ab")[r].as_py()
            for i, ids, score in near_positives(walk, p):
                n = len(ids)
                yield pa.RecordBatch.from_arrays(columns(pa.array([ab] * n, pa.string()), np.full(n, i, np.int32), ids, score), ["ab", "i", "id", "score"])

    found = _meet(cands, trees, parts, []).mapInArrow(first, "ab string, i int, id long, score long")
    by = W.partitionBy("ab", "i").orderBy(F.desc("score"), "id")
    best = land(found.withColumn("k", F.row_number().over(by) - 1).where(F.col("k") < p.positives), "hn-positives")
    # at most ``tree * positives`` numbers per anchor block
    per = best.groupBy("ab").agg(F.array_sort(F.collect_list(F.struct("i", "k", "score"))).alias("pos"))

    def second(batches):
        for b, r, walk in _walks(batches):
            ab, pos = b.column("ab")[r].as_py(), b.column("pos")[r].values
            at, scores = pos.field("i").to_numpy(), pos.field("score").to_numpy()
            cut = np.searchsorted(at, np.arange(len(walk.a["ids"]) + 1))
            for i, k, ids, score in window_negatives(walk, {i: scores[cut[i]:cut[i + 1]] for i in range(len(cut) - 1)}, p):
                n = len(ids)
                yield pa.RecordBatch.from_arrays(columns(pa.array([ab] * n, pa.string()), np.full(n, i, np.int32), np.full(n, k, np.int32), ids, score),
                                                 ["ab", "i", "k", "negative_id", "negative_score"])

    found = _meet(cands, trees.join(per, "ab"), parts, ["pos"]).mapInArrow(second, "ab string, i int, k int, negative_id long, negative_score long")
    by = W.partitionBy("ab", "i", "k").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= p.top)
    named = trees.select("ab", F.posexplode("ids").alias("i", "anchor_id"))
    pairs = best.join(named, ["ab", "i"]).select("ab", "i", "k", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(pairs, ["ab", "i", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame, p: HardNegParams = HardNegParams()) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, embedding, label); anchors are the rows whose id ``anchor_every`` divides."""
    rows = integer_rows(embeddings, p)
    return hard_negatives(rows, rows.where(F.col("id") % p.anchor_every == 0), p)


def oracle(p: HardNegParams) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % {p.relabel_every} = 0 THEN (label + 1) % {p.labels} ELSE label END AS label,
  [floor({p.scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, list_sum([z[1] * z[2] FOR z IN list_zip(a.w, c.w)])::BIGINT AS score
  FROM v a JOIN v c ON a.id % {p.anchor_every} = 0 AND a.id <> c.id),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= {p.positives}),
neg AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank
  FROM pos p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND {p.low} * p.score <= 100 * n.score AND 100 * n.score <= {p.high} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {p.top}"""
