"""Learners that Spark ML lacks, as gradients summed over partitions.

Two ways to learn. *Averaged passes*: every partition goes through its own rows in a seeded order, in mini-batches (of one row, if wanted), from the same
weights; what the partitions end with is averaged by their rows. *Whole gradients*: loss and gradient are summed over all rows and a
quasi-Newton method (L-BFGS) on the driver takes the steps. Either way the weights alone (a few thousand numbers) pass the driver.

Rows carry ``x array<double>`` and ``y int``.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from threading import Condition, Thread

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import hash_order
from ..operators import evaluate as curves

# ---- sums over partitions --------------------------------------------------------------------


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1), batch.column("y").to_numpy()


#: Rows that a task of an iteration should hold.
TASK_ROWS = 8192


def packed(df: DataFrame) -> DataFrame:
    """``x, y`` as bytes, one row per Arrow batch, for rows that many iterations read: kept so, they pass to Python without a conversion per number."""
    def task(batches):
        for b in batches:
            if b.num_rows:
                x, y = _arrays(b)
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, float).tobytes()]), pa.array([y.astype(float).tobytes()])], ["x", "y"])
    return df.select("x", "y").mapInArrow(task, "x binary, y binary")


def _blocks(batch: pa.RecordBatch):
    """The (x, y) of a batch of rows, or of each row of packed ones."""
    if not pa.types.is_binary(batch.column("x").type):
        yield _arrays(batch)
        return
    for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
        y = np.frombuffer(y)
        yield np.frombuffer(x).reshape(len(y), -1), y


def _summed(df: DataFrame, run: Callable, size: int) -> np.ndarray:
    """The sum over partitions of the vector that ``run`` makes of a partition's batches."""
    def task(batches):
        v = run(block for b in batches if b.num_rows for block in _blocks(b))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.asarray(v, float))], ["i", "v"])
    got = df.select("x", "y").mapInArrow(task, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    if got.num_rows:
        out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def averaged_pass(df: DataFrame, w: np.ndarray, step: Callable, batch: int, order: Column | None = None, first: int = 0) -> tuple[np.ndarray, int]:
    """One pass: ``step(w, x, y, t)`` gives the weights after mini-batch ``t`` (counted from ``first``) of a partition's rows in ``order``.
    Returns the average of the partitions' weights, each counted by its rows, and the number of rows."""
    rows = df if order is None else df.withColumn("_order", order).sortWithinPartitions("_order")

    def run(parts):
        v, n, t, xs, ys = w.copy(), 0, first, None, None
        for x, y in parts:
            xs, ys = (x, y) if xs is None else (np.concatenate((xs, x)), np.concatenate((ys, y)))
            whole = len(ys) // batch * batch
            for k in range(0, whole, batch):
                v, t = step(v, xs[k:k + batch], ys[k:k + batch], t), t + 1
            n, xs, ys = n + whole, xs[whole:], ys[whole:]
        if ys is not None and len(ys):
            v, n = step(v, xs, ys, t), n + len(ys)
        return np.append(v.ravel() * n, n)

    total = _summed(rows, run, w.size + 1)
    return (total[:-1] / total[-1]).reshape(w.shape) if total[-1] else w, int(total[-1])


def row_order(id_: Column, seed: int = 0) -> Column:
    """A repeatable random order of rows."""
    return hash_order(id_, seed)


# ---- softmax, one example after the other ----------------------------------------------------

def softmax_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean gradient of the log loss; ``w``: classes x (1 + inputs), the first column for the constant."""
    x = np.c_[np.ones(len(x)), x]
    z = x @ w.T
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(x)), y] -= 1
    return p.T @ x / len(x)


def softmax_pass(df: DataFrame, w: np.ndarray, rate: float = .1, lam: float = 1e-4, batch: int = 1, order: Column | None = None) -> np.ndarray:
    """One pass of single examples (``batch`` = 1) over the rows, from the weights given; the penalty covers the constant too."""
    return averaged_pass(df, w, lambda v, x, y, t: v - rate * (softmax_gradient(v, x, y) + lam * v), batch, order)[0]


# ---- linear SVM by stochastic gradient, modified-huber loss ----------------------------------

def huber_loss(margin: np.ndarray) -> np.ndarray:
    """0 from 1 on, (1 - z)^2 down to -1, then -4 z."""
    return np.where(margin >= -1, np.maximum(1 - margin, 0) ** 2, -4 * margin)


def huber_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean gradient for labels 0 / 1; ``w``: constant, then one per input."""
    sign, x = 2 * y - 1, np.c_[np.ones(len(x)), x]
    margin = sign * (x @ w)
    slope = np.where(margin >= -1, -2 * np.maximum(1 - margin, 0), -4.)
    return (slope * sign) @ x / len(x)


@dataclass
class HuberSVM:
    """``alpha``: L2 penalty (not on the constant). The rate falls as 1 / (alpha (t + t0)) with the mini-batches t gone through."""
    alpha: float = 1e-4
    passes: int = 20
    batch: int = 16
    seed: int = 0
    w: np.ndarray | None = None

    def fit(self, df: DataFrame, id_: Column) -> "HuberSVM":
        w, t = np.zeros(len(df.select("x").first().x) + 1), 0
        parts = max(df.select(F.spark_partition_id()).distinct().count(), 1)
        # the first rate is that of a typical weight over the loss's slope there
        typical = np.sqrt(1 / np.sqrt(self.alpha))
        t0 = 1 / (self.alpha * typical / max(1., 2 * (1 + typical)))

        def step(v, x, y, t):
            rate = 1 / (self.alpha * (t + t0))
            keep = np.append(1., np.full(len(v) - 1, max(0., 1 - rate * self.alpha)))
            return v * keep - rate * huber_gradient(v, x, y)

        for k in range(self.passes):
            w, n = averaged_pass(df, w, step, self.batch, row_order(id_, self.seed + k), t)
            t += max(n // (self.batch * parts), 1)
        self.w = w
        return self

    def margin(self, x: Column) -> Column:
        return linear(x, self.w)

    def probability(self, x: Column) -> Column:
        """The loss's own estimate: the margin clipped to [-1, 1], moved to [0, 1]."""
        return (F.least(F.greatest(self.margin(x), F.lit(-1.)), F.lit(1.)) + 1) / 2


def linear(x: Column, w) -> Column:
    """Constant and inner product as an expression."""
    terms = F.zip_with(x, F.array(*[F.lit(float(v)) for v in w[1:]]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(float(w[0])), lambda a, b: a + b)


# ---- L-BFGS ----------------------------------------------------------------------------------

def minimise(f: Callable, w: np.ndarray, max_iter: int = 10_000, tol: float = 1e-5, memory: int = 10) -> tuple[np.ndarray, float, int]:
    """Limited-memory BFGS: ``f(w)`` gives (value, gradient). Ends where no component of the gradient exceeds ``tol``."""
    value, g = f(w)
    past: list = []
    for k in range(max_iter):
        if np.abs(g).max(initial=0) <= tol:
            return w, value, k
        q, used = g.copy(), []
        for s, y, rho in reversed(past):
            a = rho * (s @ q)
            used.append(a)
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1., np.linalg.norm(g))
        for (s, y, rho), a in zip(past, reversed(used)):
            q += (a - rho * (y @ q)) * s
        slope, size = -(g @ q), 1.
        if slope >= 0:                                       # no way down: start again along the gradient
            past, q, slope = [], g.copy(), -(g @ g)
        for _ in range(30):
            new = w - size * q
            new_value, new_g = f(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return w, value, k
        s, y = new - w, new_g - g
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        w, value, g = new, new_value, new_g
    return w, value, max_iter


# ---- one hidden layer ------------------------------------------------------------------------

def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def mlp_loss(w: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int) -> tuple[float, np.ndarray]:
    """Sum of the log loss and its gradient over some rows: sigmoid units, one output for class 1, no penalty."""
    d = x.shape[1]
    a, b = w[:hidden * (d + 1)].reshape(hidden, d + 1), w[hidden * (d + 1):]
    x1 = np.c_[np.ones(len(x)), x]
    h = _sigmoid(x1 @ a.T)
    h1 = np.c_[np.ones(len(x)), h]
    z = h1 @ b
    loss = np.logaddexp(0, np.where(y == 1, -z, z)).sum()
    out = _sigmoid(z) - y
    back = out[:, None] * b[1:] * h * (1 - h)
    return loss, np.append((back.T @ x1).ravel(), out @ h1)


@dataclass
class MLP:
    """One hidden layer of sigmoid units with an L2 penalty ``lam / (2 n)`` on all weights but the constants', trained to the end."""
    hidden: int = 8
    lam: float = 1.
    max_iter: int = 10_000
    tol: float = 1e-4
    seed: int = 0
    w: np.ndarray | None = None
    iterations: int = 0

    def _free(self, d: int) -> np.ndarray:
        """0 for the constants, 1 for all other weights."""
        return np.append(np.tile(np.append(0., np.ones(d)), self.hidden), np.append(0., np.ones(self.hidden)))

    def loss(self, df: DataFrame, n: int, d: int) -> Callable:
        free = self._free(d)

        def f(w):
            def run(parts):
                total = np.zeros(w.size + 1)
                for x, y in parts:
                    loss, g = mlp_loss(w, x, y, self.hidden)
                    total += np.append(g, loss)
                return total
            got = _summed(df, run, w.size + 1) / n
            return got[-1] + self.lam / (2 * n) * (w * free) @ w, got[:-1] + self.lam / n * free * w
        return f

    def fit(self, df: DataFrame) -> "MLP":
        # a packed table is one task: many rows are dealt out
        n, d = df.count(), len(df.select("x").first().x)
        tasks = -(-n // TASK_ROWS)
        rows = packed(df.repartition(tasks) if tasks > 1 else df).persist()
        try:
            bound = np.sqrt(6 / (d + self.hidden))
            start = np.random.default_rng(self.seed).uniform(-bound, bound, self.hidden * (d + 2) + 1)
            self.w, self.value, self.iterations = minimise(self.loss(rows, n, d), start, self.max_iter, self.tol)
        finally:
            rows.unpersist()
        return self

    def probability(self, x: Column, d: int) -> Column:
        """P(class 1) as an expression over ``x``."""
        cut = self.hidden * (d + 1)
        a, b = self.w[:cut].reshape(self.hidden, d + 1), self.w[cut:]
        units = [1 / (1 + F.exp(-linear(x, row))) for row in a]
        z = sum((float(v) * u for v, u in zip(b[1:], units)), F.lit(float(b[0])))
        return 1 / (1 + F.exp(-z))


# ---- many logistic fits in one pass ----------------------------------------------------------

#: Prefixes whose sums a task holds at a time, and the rows it should hold: each task sends a sum per prefix, so more of them only send more.
PREFIXES, PREFIX_ROWS = 64, 16_384
#: Prefixes from one whose curvature is worked out to the next, as a ratio of their rows, and the passes in which those between, with its curvature, should arrive.
ANCHORS, CHORDS = 1.1, 12


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists, without a Python object per number."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def prefix_logistic(df: DataFrame, sizes: list[int], lam: float = 1e-3, max_iter: int = 25, tol: float = 1e-8) -> np.ndarray:
    """Logistic fits on the first ``sizes[j]`` rows by ``position``, all in the same passes: weights (sizes, 1 + inputs).

    Mean log loss plus ``lam / 2`` times the squared weights (not the constant), by Newton steps. A row adds to the gradient and the curvature of every prefix that
    holds it; what comes back is one step per prefix, so the number of jobs does not depend on the number of rows or prefixes. A task holds its rows and the sums
    of ``PREFIXES`` prefixes at a time, however many there are; prefixes that have arrived are left out.

    The curvature is most of the work, and nearly that of a prefix that is hardly shorter: only prefixes ``ANCHORS`` apart have it worked out. Those between start from the next shorter one's weights and
    take steps by its curvature from their own gradient, until the steps are as small; any that do not get there take Newton steps like the others.
    """
    d = len(df.select("x").first().x) + 1
    ends = np.array(sizes)
    anchor, last = [], None
    for j in np.argsort(ends, kind="stable"):
        last = j if last is None or ends[j] >= ANCHORS * ends[last] else last
        anchor.append((j, last))
    anchor = np.array([a for _, a in sorted(anchor)])
    own = np.flatnonzero(anchor == np.arange(len(ends)))
    w, free = np.zeros((len(sizes), d)), np.append(0., np.ones(d - 1))
    rows = df.select("x", F.struct("y", "position").alias("at")).persist()
    try:
        w[own], curved = _prefix_steps(rows, ends[own], w[own], free, lam, max_iter, tol)
        others = np.flatnonzero(anchor != np.arange(len(ends)))
        if len(others):
            w[others], far = _chord_steps(rows, ends[others], w[anchor[others]], curved[np.searchsorted(own, anchor[others])], free, lam, tol)
            if len(far):
                far = others[far]
                w[far], _ = _prefix_steps(rows, ends[far], w[anchor[far]], free, lam, max_iter, tol)
        return w
    finally:
        rows.unpersist()


def _held(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """A task's rows by position: x, y, position."""
    held = []
    for b in batches:
        if b.num_rows:
            x, at = b.column("x"), b.column("at")
            held.append((x.flatten().to_numpy().reshape(len(x), -1), at.field("y").to_numpy(), at.field("position").to_numpy()))
    if not held:
        return None
    x, y, pos = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(pos, kind="stable")
    return x[order], y[order], pos[order]


def _chord_steps(rows: DataFrame, ends: np.ndarray, w: np.ndarray, curved: np.ndarray, free: np.ndarray, lam: float, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Steps by the curvatures given: the weights, and the places of those that have not arrived after ``CHORDS`` passes."""
    (k, d), w, order = w.shape, w.copy(), np.argsort(ends, kind="stable")
    inverse, open_ = np.linalg.inv(curved), order
    for _ in range(CHORDS):
        def task(batches):
            rows_ = _held(batches)
            if rows_ is None:
                return
            x, y, pos = np.c_[np.ones(len(rows_[0])), rows_[0]], rows_[1], rows_[2]
            for first in range(0, len(open_), PREFIXES):
                js = open_[first:first + PREFIXES]
                most, g = np.searchsorted(pos, ends[js]), np.zeros((len(js), d))
                for at in range(0, most.max(), 2048):
                    xs, n = x[at:at + 2048], np.arange(at, min(at + 2048, len(x)))
                    off = _sigmoid(xs @ w[js].T) - y[at:at + 2048, None]
                    off[n[:, None] >= most] = 0
                    g += off.T @ xs
                yield pa.RecordBatch.from_arrays([pa.array(js, pa.int32()), _lists(g)], ["j", "g"])

        parts = rows.mapInArrow(task, "j int, g array<double>")
        got = parts.groupBy("j").agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).toArrow()
        js, g = got["j"].to_numpy(), got["g"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
        step = np.einsum("jab,jb->ja", inverse[js], g / ends[js][:, None] + lam * free * w[js])
        w[js] -= np.clip(step, -10, 10)
        open_ = np.intersect1d(js[~(np.abs(step).max(1) < tol)], open_)
        open_ = open_[np.argsort(ends[open_], kind="stable")]
        if not len(open_):
            break
    return w, open_


def _prefix_steps(rows: DataFrame, ends: np.ndarray, w: np.ndarray, free: np.ndarray, lam: float, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """The Newton steps of ``prefix_logistic`` from the weights ``w``: the weights, and the curvatures of the last steps."""
    (k, d), w = w.shape, w.copy()
    curved = np.zeros((k, d, d))
    half = d * (d + 1) // 2
    upper = np.triu_indices(d)
    open_ = np.arange(k)
    for _ in range(max_iter):
        def task(batches):
            held = []
            for b in batches:
                if b.num_rows:
                    x, at = b.column("x"), b.column("at")
                    held.append((np.c_[np.ones(len(x)), x.flatten().to_numpy().reshape(len(x), -1)], at.field("y").to_numpy(), at.field("position").to_numpy()))
            for first in range(0, len(open_) if held else 0, PREFIXES):
                js = open_[first:first + PREFIXES]
                g, h = np.zeros((len(js), d)), np.zeros((len(js), half))
                for x, y, pos in held:
                    for i, j in enumerate(js):
                        use = pos < ends[j]
                        if use.any():
                            xs = x[use]
                            p = _sigmoid(xs @ w[j])
                            g[i] += (p - y[use]) @ xs
                            h[i] += ((xs * (p * (1 - p))[:, None]).T @ xs)[upper]
                yield pa.RecordBatch.from_arrays([pa.array(js, pa.int32()), _lists(g), _lists(h)], ["j", "g", "h"])

        def solve(batches):
            for b in batches:
                js, steps, full = b.column("j").to_numpy(), np.zeros((b.num_rows, d)), np.zeros((b.num_rows, d * d))
                gs, hs = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in "gh")
                for i, j in enumerate(js):
                    n = ends[j]
                    h = np.zeros((d, d))
                    h[upper] = hs[i] / n
                    h = h + np.triu(h, 1).T + np.diag(lam * free + 1e-12)
                    steps[i], full[i] = np.linalg.solve(h, gs[i] / n + lam * free * w[j]), h.ravel()
                yield pa.RecordBatch.from_arrays([b.column("j"), _lists(steps), _lists(full)], ["j", "step", "h"])

        parts = rows.mapInArrow(task, "j int, g array<double>, h array<double>")
        total = lambda c: vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c)
        got = parts.groupBy("j").agg(total("g"), total("h")).mapInArrow(solve, "j int, step array<double>, h array<double>").toArrow()
        left = []
        for j, step, h in zip(got["j"].to_pylist(), *(got[c].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1) for c in ("step", "h"))):
            w[j] -= np.clip(step, -10, 10)
            curved[j] = h.reshape(d, d)
            if np.abs(step).max() >= tol:
                left.append(j)
        if not left:
            break
        open_ = np.array(sorted(left))
    return w, curved


def _probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(rows, fits): each a plain sum in the order of the inputs, so that equal rows have equal scores wherever they lie."""
    z, columns = np.empty((len(x), len(w))), np.ascontiguousarray(x.T)
    for at in range(0, len(x), 256):
        part = z[at:at + 256]
        part[:] = w[:, 0]
        term = np.empty_like(part)
        for k, column in enumerate(columns):
            part += np.multiply(column[at:at + 256, None], w[:, k + 1], out=term)
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _sides(batches, ends: np.ndarray, w: np.ndarray, cut: int, open_: np.ndarray):
    """(fits, [(place in fits, 0 training or 1 held out, y, p)]) of a task's rows, ``PREFIXES`` fits at a time."""
    rows = _held(batches)
    for first in range(0, len(open_) if rows else 0, PREFIXES):
        js = open_[first:first + PREFIXES]
        x, y, pos = rows
        p, held = _probabilities(x, w[js]), np.searchsorted(pos, cut)
        yield js, [(i, part, y[side], p[side, i]) for i, m in enumerate(np.searchsorted(pos, ends[js])) for part, side in enumerate((slice(0, m), slice(held, None)))]


def prefix_points(df: DataFrame, sizes: list[int], w: np.ndarray, cut: int, fpr: float) -> DataFrame:
    """(size, part, p, m, z, o): bogus and real rows on either side of the lowest score at which at most ``fpr`` of the bogus ones are accepted, on the ``train`` rows of each prefix and the
    ``holdout`` rows from ``cut`` on. All that the missed-detection rate there needs.

    A pass over the rows sends each task's highest bogus scores: the first one too many among all of them is the threshold, unless a task may have more; those fits are asked again with more of them.
    A second pass counts what is above. Between the passes a few numbers per prefix come to the driver.
    """
    rows = df.select("x", F.struct("y", "position").alias("at"))
    ends, open_, share, edge = np.array(sizes), np.arange(len(sizes)), 1.5, {}
    while len(open_):
        def top(batches):
            for js, sides in _sides(batches, ends, w, cut, open_):
                out = []
                for i, part, y, p in sides:
                    bogus = p[y == 0]
                    n = min(len(bogus), int(np.ceil(fpr * len(bogus) * share)) + 32)
                    out.append((int(js[i]), part, len(bogus), int((y == 1).sum()), np.partition(bogus, len(bogus) - n)[len(bogus) - n:] if n else bogus))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), js[0] // PREFIXES), pa.int32()), *cols], ["block", "j", "part", "n0", "n1", "top"])

        def merge(t: pa.Table) -> pa.Table:
            out, by = [], {}
            for j, part, n0, n1, top_ in zip(*(t[c].to_numpy() for c in ("j", "part", "n0", "n1", "top"))):
                by.setdefault((j, part), []).append((n0, n1, top_))
            for (j, part), held in by.items():
                n0, n1 = sum(h[0] for h in held), sum(h[1] for h in held)
                most = int(fpr * n0) + 1
                while most and n0 and most / n0 > fpr:
                    most -= 1
                every = np.sort(np.concatenate([h[2] for h in held]))[::-1]
                # no bogus row: no score is accepted; none too many: all are
                p = 1. if not n0 else -1. if most >= n0 else every[most] if most < len(every) else np.nan
                out.append((j, part, n0, n1, p, bool(p in (1., -1.) or all(len(h[2]) == h[0] or h[2].min() <= p for h in held))))
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["j", "part", "n0", "n1", "p", "found"])

        sent = rows.mapInArrow(top, "block int, j int, part int, n0 bigint, n1 bigint, top array<double>")
        got = sent.groupBy("block").applyInArrow(merge, "j int, part int, n0 bigint, n1 bigint, p double, found boolean").collect()
        edge |= {(r.j, r.part): (r.n0, r.n1, r.p) for r in got if r.found}
        open_, share = np.unique([r.j for r in got if not r.found]).astype(int), 4 * share

    limit = np.array([[edge.get((j, part), (0, 0, 1.))[2] for part in (0, 1)] for j in range(len(sizes))])

    def above(batches):
        for js, sides in _sides(batches, ends, w, cut, np.arange(len(ends))):
            out = []
            for i, part, y, p in sides:
                over = (p > limit[js[i], part]) & ((y == 0) | (y == 1))
                out.append((int(js[i]), part, int((y[over] == 0).sum()), int((y[over] == 1).sum()), float(p[over].min()) if over.any() else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))], ["j", "part", "z", "o", "p"])

    over = rows.mapInArrow(above, "j int, part int, z bigint, o bigint, p double").groupBy("j", "part").agg(F.sum("z").alias("z"), F.sum("o").alias("o"), F.min("p").alias("p"))
    points = []
    for r in over.collect():
        n0, n1, p = edge[r.j, r.part]
        name = (int(sizes[r.j]), ("train", "holdout")[r.part])
        points += [(*name, float(v), 0, z, o) for v, z, o in ((r.p, r.z, r.o), (p, n0 - r.z, n1 - r.o)) if z + o]
    return df.sparkSession.createDataFrame(points, "size int, part string, p double, m long, z long, o long")


# ---- many networks side by side --------------------------------------------------------------

class Rendezvous:
    """Lets minimisers in threads share their evaluations: when every one that still runs has asked, all are answered by one job."""

    def __init__(self, n: int, evaluate: Callable):
        self.running, self.asked, self.answers, self.evaluate, self.turn = n, {}, {}, evaluate, Condition()

    def ask(self, i: int, w: np.ndarray):
        with self.turn:
            self.asked[i] = w
            self.turn.notify_all()
            self.turn.wait_for(lambda: i in self.answers)
            got = self.answers.pop(i)
        if isinstance(got, BaseException):
            raise got
        return got

    def leave(self) -> None:
        with self.turn:
            self.running -= 1
            self.turn.notify_all()

    def serve(self) -> None:
        while True:
            with self.turn:
                self.turn.wait_for(lambda: len(self.asked) >= self.running)
                if not self.running:
                    return
                asked, self.asked = self.asked, {}
            try:
                answers = self.evaluate(asked)
            except BaseException as e:  # noqa: BLE001 - handed to the threads that wait for it
                answers = dict.fromkeys(asked, e)
            with self.turn:
                self.answers |= answers
                self.turn.notify_all()


def fold_scales(df: DataFrame) -> dict:
    """{fold: (mean, deviation) of the inputs of all other folds}: as many numbers as folds x inputs."""
    rows = (df.select("fold", F.posexplode("x").alias("i", "v")).groupBy("fold", "i")
            .agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).collect())
    folds, d = sorted({r.fold for r in rows}), max(r.i for r in rows) + 1
    sums = np.zeros((len(folds), d, 3))
    for r in rows:
        sums[folds.index(r.fold), r.i] = r.n, r.s, r.q
    out = {}
    for k, fold in enumerate(folds):
        n, s, q = (sums.sum(0) - sums[k]).T
        mean = s / n
        sd = np.sqrt(np.maximum(q / n - mean ** 2, 0))
        out[fold] = mean, np.where(sd > 0, sd, 1.), float(n[0])
    return out


def _side_by_side(n: int, size: int, evaluate: Callable, start: Callable, max_iter: int, tol: float) -> dict:
    """{i: weights} of ``n`` minimisers in threads, whose evaluations meet in one job per round."""
    meet, done = Rendezvous(n, evaluate), {}

    def learn(i):
        try:
            done[i] = minimise(lambda w: meet.ask(i, w), start(size), max_iter, tol)[0]
        except BaseException as e:  # noqa: BLE001 - raised again below
            done[i] = e
        finally:
            meet.leave()

    threads = [Thread(target=learn, args=(i,), daemon=True) for i in range(n)]
    for t in threads:
        t.start()
    meet.serve()
    for t in threads:
        t.join()
    for e in done.values():
        if isinstance(e, BaseException):
            raise e
    return done


def _per_net(rows: DataFrame, ws: dict, nets: list, scales: dict, held: bool, width: int, add: Callable) -> dict:
    """{i: sum}: ``add(w, x, y)`` summed over the rows that network i = (setting, fold) learns from (or that it is held to), inputs standardised."""
    places = sorted(ws)

    def run(batches):
        total = np.zeros((len(places), width))
        for b in batches:
            if b.num_rows:
                x, y = _arrays(b)
                fold = b.column("fold").to_numpy()
                for at, i in enumerate(places):
                    mean, sd, _ = scales[nets[i][1]]
                    use = (fold == nets[i][1]) == held
                    total[at] += add(ws[i], (x[use] - mean) / sd, y[use])
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    got = rows.mapInArrow(run, "i int, v array<double>").groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()
    return {r.i: np.array(r.v) for r in got}


def cross_validate_mlp(df: DataFrame, hidden=(10, 20), lams=(10, 3, 1, .3, .1, .03, .01), max_iter: int = 100, tol: float = 1e-3, seed: int = 0) -> DataFrame:
    """(hidden, lam, mean): mean F1 of class 1 at .5 over the folds (column ``fold``); inputs are standardised by the rows each network learns from.

    The networks of one size (settings x folds) are trained side by side: an iteration of all of them is one pass over the rows.
    """
    rows = df.select("x", "y", "fold").persist()
    out = []
    try:
        scales = fold_scales(rows)
        d = len(next(iter(scales.values()))[0])
        for units in hidden:
            nets = [(lam, fold) for lam in lams for fold in scales]
            size, free = units * (d + 2) + 1, MLP(units)._free(d)

            def loss(w, x, y, units=units):
                value, g = mlp_loss(w, x, y, units)
                return np.append(g, value)

            def errors(w, x, y, units=units):
                a, o = w[:units * (d + 1)].reshape(units, d + 1), w[units * (d + 1):]
                yes = np.c_[np.ones(len(x)), _sigmoid(np.c_[np.ones(len(x)), x] @ a.T)] @ o > 0
                return np.array([(yes & (y == 1)).sum(), (yes & (y == 0)).sum(), (~yes & (y == 1)).sum()], float)

            def evaluate(ws, nets=nets, free=free, loss=loss, size=size):
                got = _per_net(rows, ws, nets, scales, False, size + 1, loss)
                return {i: _penalised(v, ws[i], nets[i][0] / scales[nets[i][1]][2], free, scales[nets[i][1]][2]) for i, v in got.items()}

            bound = np.sqrt(6 / (d + units))
            done = _side_by_side(len(nets), size, evaluate, lambda n, bound=bound: np.random.default_rng(seed).uniform(-bound, bound, n), max_iter, tol)
            f1: dict = {}
            for i, (tp, fp, fn) in _per_net(rows, done, nets, scales, True, 3, errors).items():
                f1.setdefault(nets[i][0], []).append(2 * tp / (2 * tp + fp + fn) if tp else 0.)
            out += [(units, float(lam), float(np.mean(v))) for lam, v in f1.items()]
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "hidden int, lam double, mean double")


def _penalised(v: np.ndarray, w: np.ndarray, lam: float, free: np.ndarray, n: float) -> tuple[float, np.ndarray]:
    """Mean loss and gradient out of their sums (gradient, loss), with ``lam / 2`` times the squared free weights."""
    return v[-1] / n + lam / 2 * (w * free) @ w, v[:-1] / n + lam * free * w


CORNER = .1


def log_loss(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the gradient and of the log loss of a linear model."""
    x, sign = np.c_[np.ones(len(x)), x], 2 * y - 1
    margin = sign * (x @ w)
    return np.append(-(sign * _sigmoid(-margin)) @ x, np.logaddexp(0, -margin).sum())


def hinge_loss(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the gradient and of the hinge loss of a linear SVM, its corner rounded over a width of ``CORNER``, so that it has a gradient everywhere."""
    x, sign = np.c_[np.ones(len(x)), x], 2 * y - 1
    short = 1 - sign * (x @ w)
    slope = np.clip(short / CORNER, 0, 1)
    value = np.where(short > CORNER, short - CORNER / 2, np.maximum(short, 0) ** 2 / (2 * CORNER))
    return np.append(-(sign * slope) @ x, value.sum())


def cross_validate_linear(df: DataFrame, lams, loss: Callable, id_: str, fpr: float = .01, max_iter: int = 200, tol: float = 1e-4) -> DataFrame:
    """(setting, mean): mean missed-detection rate over the folds (column ``fold``) of linear models with each penalty; all settings and folds are trained side
    by side, inputs standardised by the rows each learns from, and all held-out scores compared in one job."""
    rows = df.select("x", "y", "fold").persist()
    try:
        scales = fold_scales(rows)
        d = len(next(iter(scales.values()))[0])
        nets, free = [(lam, fold) for lam in lams for fold in scales], np.append(0., np.ones(d))

        def evaluate(ws):
            got = _per_net(rows, ws, nets, scales, False, d + 2, loss)
            return {i: _penalised(v, ws[i], nets[i][0], free, scales[nets[i][1]][2]) for i, v in got.items()}

        done = _side_by_side(len(nets), d + 1, evaluate, np.zeros, max_iter, tol)
    finally:
        rows.unpersist()
    fits = []
    for i, w in done.items():
        mean, sd, _ = scales[nets[i][1]]
        fits.append((float(nets[i][0]), int(nets[i][1]), [float(w[0] - (w[1:] * mean / sd).sum()), *(float(v) for v in w[1:] / sd)]))
    table = df.sparkSession.createDataFrame(fits, "lam double, fold int, w array<double>")
    z = F.aggregate(F.zip_with("x", F.slice("w", 2, F.size("w")), lambda a, b: a * b), F.get("w", F.lit(0)), lambda a, b: a + b)
    scores = df.join(F.broadcast(table), "fold").select("lam", "fold", F.col(id_).alias("subject"), F.col("y").alias("gold"), (1 / (1 + F.exp(-z))).alias("p"))
    merit = curves.fom_mdr_at_fpr(scores, fpr, runs=["lam", "fold"])
    return merit.groupBy(F.col("lam").cast("string").alias("setting")).agg(F.avg("mdr").alias("mean"))
