"""Random forests grown a few trees a task.

A level of all trees in one job, as Spark ML grows them, sends the counts of every open node from every task and keeps all trees at the driver. Here a task has all rows as bytes (the
bin of each input, of at most ``BINS``) and grows some trees to the end: no node leaves it. What does are the scores of the held-out rows, or the importance of each input. So a task's memory
grows with the rows (a byte per input), its time with rows x depth, and the driver holds the bins' edges alone.

The trees are Spark ML's otherwise: rows drawn with replacement (Poisson), random inputs at each node, Gini impurity, no split of no gain, bins of equal shares. Rows carry ``x array<double>``
and ``y int`` (0 or 1).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import land
from .trials import _own_keys

BINS = 32
TREES = 10              # that a task grows
CELLS = 1 << 20         # numbers of a level that are worked on at a time
ONE = 1 << 40           # a probability of 1: sums of whole numbers are the same in any order


def bin_edges(df: DataFrame) -> list[np.ndarray]:
    """Per input, ascending: values up to an edge are in its bin or below. The middles between values where these are ``BINS`` at most, otherwise quantiles of all rows."""
    def distinct(batches):
        held = None
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0))
            held = held or [np.array([])] * x.shape[1]
            held = [u if len(u) > BINS else np.unique(np.append(u, x[:, k]))[:BINS + 1] for k, u in enumerate(held)]
        for k, u in enumerate(held or []):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([u], pa.list_(pa.float64()))], ["pos", "values"])

    found: dict = {}
    for r in df.select("x").mapInArrow(distinct, "pos int, values array<double>").collect():
        found[r.pos] = np.unique(np.append(found.get(r.pos, []), r["values"]))
    levels = [k / BINS for k in range(1, BINS)]
    marks = {r.pos: r.q for r in df.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.percentile_approx("v", levels, 10_000).alias("q")).collect()}
    return [(u[1:] + u[:-1]) / 2 if len(u) <= BINS else np.unique(marks[k]) for k, u in sorted(found.items())]


def packed(df: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(at, x, y, fold): landed blocks of rows, ``x`` the bins as bytes; ``at`` orders the blocks."""
    def task(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                bins = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], 1).astype(np.uint8)
                y, fold = (b.column(c).to_numpy().astype(np.int8) for c in ("y", "fold"))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in (bins, y, fold)], ["x", "y", "fold"])
    blocks = df.select("x", F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold")).mapInArrow(task, "x binary, y binary, fold binary")
    return land(blocks.withColumn("at", F.monotonically_increasing_id()), "forest-rows")


def _unpacked(t: pa.Table, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = t.sort_by("at")
    x, y, fold = (np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in (("x", np.uint8), ("y", np.int8), ("fold", np.int8)))
    return x.reshape(-1, inputs), y, fold


def _parted(rows: np.ndarray, size: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that lie node by node, each node's ``left`` ones first; and the sizes of both sides, node by node."""
    node = np.repeat(np.arange(len(size)), size)
    lefts = np.bincount(node, left, len(size)).astype(np.int64)
    start = np.cumsum(size) - size
    before = np.cumsum(left) - left                                             # left ones before this row
    rank = before - np.append(before, 0)[np.minimum(start, len(rows))][node]    # within its node
    place = np.where(left, start[node] + rank, np.arange(len(rows)) + lefts[node] - rank)
    out = np.empty_like(rows)
    out[place] = rows
    return out, np.stack([lefts, size - lefts], 1).ravel()


def _best(x: np.ndarray, rows: np.ndarray, size: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, n1: np.ndarray, inputs: int, leaves: tuple, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input, bin, gain) of each node's best split, a column per least number of rows in ``leaves``: gain of impurity times rows, 0 where there is none."""
    m, d = len(size), x.shape[1]
    some = np.argpartition(rng.random((m, d)), inputs - 1, 1)[:, :inputs] if inputs < d else np.tile(np.arange(d), (m, 1))
    node = np.repeat(np.arange(m), size)
    both, counts = w[rows] + (w * y)[rows] * float(1 << 26), np.zeros(m * inputs * BINS)      # rows, and rows of class 1 above them
    for k in range(0, len(rows), piece := max(CELLS // inputs, 1)):
        at, own = node[k:k + piece, None], rows[k:k + piece, None]
        places = x.ravel()[own * np.int64(d) + some[at[:, 0]]] + (at * inputs + np.arange(inputs)) * BINS
        counts += np.bincount(places.ravel(), np.repeat(both[k:k + piece], inputs), len(counts))
    counts = counts.reshape(m, inputs, BINS).cumsum(2)[:, :, :-1]
    l1 = np.floor(counts / (1 << 26))
    ln = counts - l1 * (1 << 26)
    rn, r1 = n[:, None, None] - ln, n1[:, None, None] - l1
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (l1 ** 2 + (ln - l1) ** 2) / ln + (r1 ** 2 + (rn - r1) ** 2) / rn
    least = np.minimum(ln, rn).reshape(m, -1)
    score = score.reshape(m, -1)
    base, at = (n1 ** 2 + (n - n1) ** 2) / n, np.arange(m)
    feature, cut, gain = (np.zeros((m, len(leaves)), t) for t in (np.int64, np.int64, float))
    best = None
    for s, leaf in enumerate(leaves):
        if best is None:
            best = np.argmax(np.where(least >= leaf, score, -1.), 1)
        else:
            short = np.flatnonzero(least[at, best] < leaf)
            best = best.copy()
            best[short] = np.argmax(np.where(least[short] >= leaf, score[short], -1.), 1)
        gain[:, s] = np.where(least[at, best] >= leaf, score[at, best] - base, 0)
        feature[:, s], cut[:, s] = some[at, best // (BINS - 1)], best % (BINS - 1)
    return feature, cut, np.where(gain > 1e-7, gain, 0)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, inputs: int, leaves: tuple, depth: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """One tree for each least number of rows in ``leaves`` (ascending), from the rows drawn ``w`` times: (leaves, held) probabilities of class 1 in parts of ``ONE``, and (leaves, inputs) gains.

    The trees draw the same rows, and the same inputs at each node as long as they split alike: till then they are one.
    """
    d, s_ = x.shape[1], len(leaves)
    probs, gains = np.zeros((s_, len(x)), np.int64), np.zeros((s_, d))
    rows, out = np.flatnonzero(w), held
    size, out_size, mask = np.array([len(rows)]), np.array([len(out)]), np.ones((1, s_), bool)
    for level in range(depth + 1):
        if not len(size):
            break
        node = np.repeat(np.arange(len(size)), size)
        n, n1 = np.bincount(node, w[rows], len(size)), np.bincount(node, (w * y)[rows], len(size))
        open_ = np.flatnonzero((n1 > 0) & (n1 < n)) if level < depth else np.zeros(0, np.int64)
        feature, cut, gain = (np.zeros((len(size), s_), t) for t in (np.int64, np.int64, float))
        start = np.cumsum(size) - size
        cost = np.maximum(np.cumsum(size[open_]) * inputs, np.arange(1, len(open_) + 1) * inputs * BINS) // CELLS
        for some in np.split(open_, np.flatnonzero(np.diff(cost)) + 1) if len(open_) else []:
            ends = np.cumsum(size[some])
            own = rows[np.repeat(start[some] - ends + size[some], size[some]) + np.arange(ends[-1])]
            feature[some], cut[some], gain[some] = _best(x, own, size[some], y, w, n[some], n1[some], inputs, leaves, rng)
        split = mask & (gain > 0)
        out_node = np.repeat(np.arange(len(size)), out_size)
        value = np.rint(n1 / np.maximum(n, 1) * ONE).astype(np.int64)
        for s in range(s_):
            there = (mask & ~split)[out_node, s]
            probs[s, out[there]] = value[out_node[there]]
            np.add.at(gains[s], feature[split[:, s], s], gain[split[:, s], s])
        # trees that split a node alike go on as one
        code, parts, left = np.where(split, feature * BINS + cut, -1), [], split.copy()
        for s in range(s_):
            lead = np.flatnonzero(left[:, s])
            if not len(lead):
                continue
            alike = left[lead] & (code[lead] == code[lead, s:s + 1])
            left[lead] &= ~alike
            one = [np.repeat(alike, 2, 0)]
            for r, k, at in ((rows, size, node), (out, out_size, out_node)):
                inside = np.zeros(len(size), bool)
                inside[lead] = True
                here = inside[at]
                own, own_at = r[here], at[here]
                one += _parted(own, k[lead], x[own, feature[own_at, s]] <= cut[own_at, s])
            parts.append(one)
        if not parts:
            break
        mask, rows, size, out, out_size = (np.concatenate(c) for c in zip(*parts))
    return probs[:, held], gains


def _tasks(blocks: DataFrame, n: int) -> DataFrame:
    """All blocks for each of ``n`` tasks, numbered ``job``, each in a partition of its own."""
    keys = _own_keys(blocks.sparkSession, n)
    own = F.explode(F.array(*[F.struct(F.lit(j).alias("job"), F.lit(k).alias("task")) for j, k in enumerate(keys)]))
    return blocks.withColumn("own", own).select("*", "own.job", "own.task").drop("own").repartition(n, "task").groupBy("task")


def held_out_scores(df: DataFrame, trees=(100, 10), features=(10, 25), leaves=(1, 2, 5), depth: int = 30, seed: int = 0) -> DataFrame:
    """(trees, features, leaf, fold, gold, p): P(class 1) of each row by the forests grown without its fold, for every setting. Forests of fewer trees are the first ones of the largest."""
    edges = bin_edges(df)
    blocks, d = packed(df, edges), len(edges)
    folds = sorted(r.fold for r in df.select("fold").distinct().collect())
    steps = sorted({*range(0, max(trees), TREES), 0, *trees})
    jobs = [(f, k, a, b) for f in features for k in folds for a, b in zip(steps, steps[1:])]
    small = tuple(sorted(leaves))

    def run(t: pa.Table) -> pa.Table:
        f, k, a, b = jobs[t["job"][0].as_py()]
        x, y, fold = _unpacked(t, d)
        held, fit = np.flatnonzero(fold == k), fold != k
        total = 0
        for tree in range(a, b):
            rng = np.random.default_rng([seed, f, k + 1, tree])
            total += grow(x, y, rng.poisson(1, len(x)) * fit, held, min(f, d), small, depth, rng)[0]
        out = pa.table({"features": [f] * len(small), "leaf": list(small), "fold": [k] * len(small), "first": [a] * len(small)})
        return out.append_column("sums", pa.array([v.tobytes() for v in total], pa.binary())).append_column("gold", pa.array([y[held].tobytes()] * len(small), pa.binary()))

    got = _tasks(blocks, len(jobs)).applyInArrow(run, "features bigint, leaf bigint, fold bigint, first bigint, sums binary, gold binary")
    schema = pa.schema([(c, pa.int32()) for c in ("trees", "features", "leaf", "fold", "gold")] + [("p", pa.float64())])

    def merge(t: pa.Table) -> pa.Table:
        gold, tables = np.frombuffer(t["gold"][0].as_py(), np.int8).astype(np.int32), []
        for n in trees:
            total = sum(np.frombuffer(v, np.int64) for v, first in zip(t["sums"].to_pylist(), t["first"].to_pylist()) if first < n)
            same = {c: np.full(len(gold), t[c][0].as_py(), np.int32) for c in ("features", "leaf", "fold")}
            tables.append(pa.table({"trees": np.full(len(gold), n, np.int32), **same, "gold": gold, "p": total / (n * ONE)}, schema=schema))
        return pa.concat_tables(tables)

    return land(got.groupBy("features", "leaf", "fold").applyInArrow(merge, "trees int, features int, leaf int, fold int, gold int, p double"), "forest-scores")


def importances(df: DataFrame, trees: int = 100, leaf: int = 1, depth: int = 30, seed: int = 0) -> DataFrame:
    """(tree, feature, importance): each tree's gains by input, whose sum is 1; the square root of the inputs is drawn at a node."""
    df = df.withColumn("fold", F.lit(0))
    edges = bin_edges(df)
    blocks, d = packed(df, edges), len(edges)
    inputs, most = int(np.ceil(np.sqrt(d))), 2 * df.sparkSession.sparkContext.defaultParallelism
    step = max(-(-trees // most), 1)

    def run(t: pa.Table) -> pa.Table:
        job = t["job"][0].as_py()
        x, y, _ = _unpacked(t, d)
        own, parts = range(job * step, min((job + 1) * step, trees)), []
        for tree in own:
            rng = np.random.default_rng([seed, tree])
            gains = grow(x, y, rng.poisson(1, len(x)), np.zeros(0, np.int64), inputs, (leaf,), depth, rng)[1][0]
            parts.append(gains / (gains.sum() or 1.))
        return pa.table({"tree": np.repeat(np.array(own, np.int32), d), "feature": np.tile(np.arange(d, dtype=np.int32), len(own)), "importance": np.concatenate(parts)})

    return _tasks(blocks, -(-trees // step)).applyInArrow(run, "tree int, feature int, importance double")
