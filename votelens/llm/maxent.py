"""Language-model scoring with a hashed maximum-entropy model and class-factored softmax.

P(word | context) = P(class | context) * P(leaf | class, context) * P(word | leaf). Every word has a class by its form (its last letters
and whether a mark follows), unseen words too. P(class | context) is a softmax over features hashed into rows of a weight table: the word
before (n-gram), the classes of the two words before (n-gram), and those of the two before these (skip).

Inside a class the words' hashes form a binary tree. A decision between two halves that both hold known words is a maximum-entropy model of
its own: the log ratio of the halves' counts (the features of the word alone) plus weights of (decision, word before) and (decision, word
before the last; skip), hashed into slots. The other decisions keep their counts. Words of one leaf are told apart by their smoothed shares.
Leaves and slots are sized by the counted vocabulary, up to ``depth`` levels and 2^``slot_bits`` slots. Each leaf keeps one place for unseen words, so that all words and these places sum to one in every context.

Training is one pass of mini-batch gradient updates (Adagrad) in every partition of the training documents at once, from
common weights; the partitions' weights are averaged per row by the tokens that touched it (sums by blocks of the tables, over the
executors), and the mean starts the next round. So ``score`` depends on how the documents are partitioned; all other columns do not.
Scoring runs in numpy batches: rows of the sparse features are gathered and added.

Word counts are summed over all training documents. Words that make up a millionth of all tokens or more (a million words
at most, by counting) are sent to every worker; all rarer words of a text meet their counts in a join on the word's hash.

Tokens are the words, A-Z lower-cased, and one end per text. Words are told apart by 64-bit hashes. Cases: null text = empty text: one
token, the end. A null ``doc_id`` counts as an empty text in the split. Rows are scored each, repeated ones too, and train as often. No training
rows: all counts 0, classes equally likely. Extra columns do not enter. Empty table: no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import land
from .text import U, Words, mix, slices, split

END = U(0xE7D1C3B5A7968574)


@dataclass(frozen=True)
class LmParams:
    classes: int = 32
    rows: int = 1 << 13            # hashed rows of the word feature
    batch: int = 4096              # tokens of one gradient step
    rate: float = .15
    rounds: int = 1
    smooth: float = .1
    common: float = 1e-6           # share of all tokens from which a word's count is sent to all workers
    folds: int = 10                # fold 0 is held out
    depth: int = 6                 # most levels of decisions inside a class
    slots: int = 4                 # hashed weights of the decisions per common word
    slot_bits: int = 16            # 2^16 of them at most: every partition of the training texts ships those it touched
    word_rate: float = .25

    @property
    def size(self) -> int:
        return self.rows + 2 * self.classes ** 2


_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?\"')]}*#$%&|")] = True


def tokens(w: Words, p: LmParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, place in its text) of every token, one end after each text; class 0 is the end."""
    h = w.hashes(lower=True)
    c = np.zeros(len(h), np.int64)
    if len(h):
        low = np.concatenate((np.zeros(2, np.uint8), w.data)).astype(np.int64)
        low += 32 * ((low >= 65) & (low < 91))
        mark = _MARK[w.data[w.end - 1]] & (w.end - w.start > 1)
        last = w.end + 1 - mark                                     # index of the last letter in `low`
        one = last - 2 - w.start < 1                                # a single byte has no letter before it
        key = (low[last] * 257 + np.where(one, 0, low[last - 1])).astype(U)
        few = (p.classes - 1) // 4
        c = np.where(mark, 1 + (mix(key) % U(few)).astype(np.int64), 1 + few + (mix(key) % U(p.classes - 1 - few)).astype(np.int64))
    n = len(w.first) - 1
    doc = np.concatenate((w.doc, np.arange(n)))
    order = np.argsort(doc, kind="stable")
    h = np.concatenate((h, np.full(n, END)))[order]
    c = np.concatenate((c, np.zeros(n, np.int64)))[order]
    first = w.first[:-1] + np.arange(n)
    return h, c, np.arange(len(h)) - np.repeat(first, w.counts + 1)


def contexts(h: np.ndarray, c: np.ndarray, at: np.ndarray, p: LmParams) -> np.ndarray:
    """The three weight rows of each token's context; before a text lie ends."""
    def back(x, k, none):
        out = np.full(len(x), none, x.dtype)
        out[k:] = np.where(at[k:] >= k, x[:-k] if k else x, none)
        return out
    h1, (c1, c2, c3, c4) = back(h, 1, END), (back(c, k, 0) for k in (1, 2, 3, 4))
    n, k = p.rows, p.classes
    # 16 bits where they do: sorting them is several times faster
    return np.stack([(h1 % U(n)).astype(np.int64), n + c1 * k + c2, n + k * k + c3 * k + c4]).astype(np.uint16 if p.size <= 1 << 16 else np.int64)


def log_shares(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log of P(class | context), one row per token."""
    z = weights.take(rows[0], 0)
    for r in rows[1:]:
        z += weights.take(r, 0)
    np.clip(z, -40, 40, out=z)
    z -= np.log(np.exp(z) @ np.ones((z.shape[1], 1), z.dtype))
    return z


@dataclass(frozen=True)
class Tree:
    """Decisions inside the classes. Leaf ``c << depth | i`` is of class c and of the hashes whose first ``depth`` bits are i."""
    depth: int
    bits: int                      # 2^bits hashed weights
    first: np.ndarray              # the decisions to leaf i with known words on both sides are first[i]:first[i + 1] of the next two
    node: np.ndarray
    up: np.ndarray                 # 1 or -1: the half that the leaf lies in
    bias: np.ndarray               # of each node, natural log of the ratio of the halves
    rest: np.ndarray               # of each leaf, natural log: its other decisions, less its mass

    @staticmethod
    def of(n: np.ndarray, v: np.ndarray, common: int, p: LmParams) -> "Tree":
        """From tokens ``n`` and distinct words ``v`` by (class, first ``p.depth`` bits) and the number of common words."""
        depth = min(p.depth, max(int(np.ceil(np.log2(max(common, 1) / p.classes))), 0))
        n, v = (x.reshape(p.classes, 1 << depth, -1).sum(2) for x in (n, v))
        mass = n + p.smooth * (v + 1)
        bias, leaf, base = np.zeros(p.classes << depth), np.arange(1 << depth), np.arange(p.classes)[:, None] << depth
        rest, nodes, ups, opens = -np.log(mass), [], [], []
        for d in range(depth):
            m, words = (x.reshape(p.classes, 2 << d, -1).sum(2) for x in (mass, v))
            odds = np.log(m[:, 1::2] / m[:, ::2])
            here = (1 << d) + np.arange(1 << d)
            bias[base + here] = odds
            prefix, up = leaf >> (depth - d), 2 * ((leaf >> (depth - d - 1)) & 1) - 1
            is_open = ((words[:, ::2] > 0) & (words[:, 1::2] > 0))[:, prefix]
            rest -= np.where(is_open, 0, np.logaddexp(0, -up * odds[:, prefix]))
            nodes.append(base + here[prefix])
            ups.append(np.broadcast_to(up, is_open.shape))
            opens.append(is_open)
        if not depth:
            return Tree(0, 0, np.zeros(p.classes + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), bias.astype(np.float32), rest.ravel())
        is_open = np.stack(opens, 2).reshape(-1, depth)
        bits = min(max(int(np.ceil(np.log2(p.slots * common))), 10), p.slot_bits)
        return Tree(depth, bits, np.concatenate(([0], np.cumsum(is_open.sum(1)))), np.stack(nodes, 2).reshape(-1, depth)[is_open],
                    np.stack(ups, 2).reshape(-1, depth)[is_open].astype(np.float32), bias.astype(np.float32), rest.ravel())

    def leaves(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return c if not self.depth else (c << self.depth) + (h >> U(64 - self.depth)).astype(np.int64)

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, node, up) of all open decisions of some tokens."""
        k = self.first[leaf + 1] - self.first[leaf]
        token = np.repeat(np.arange(len(leaf)), k)
        at = np.arange(len(token)) + np.repeat(self.first[leaf] - (np.cumsum(k) - k), k)
        return token, self.node[at], self.up[at]

    def places(self, token: np.ndarray, node: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The hashed weights (feature, decision) of decisions, given the context features of the tokens."""
        key = mix(np.arange(len(self.bias)).astype(U) + _TREE)[node]
        return np.stack([((f[token] ^ key) * _TREE >> U(64 - self.bits)).astype(np.int32) for f in words])

    def log_share(self, slots: np.ndarray, leaf: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log of P(word | class, context) of each token, less log(count + smooth) of its word."""
        token, node, up = self.paths(leaf)
        if not len(token):
            return self.rest[leaf]
        z = up * (self.bias[node] + slots[self.places(token, node, words)].sum(0))
        return self.rest[leaf] - np.bincount(token, np.log1p(np.exp(np.clip(-z, -40, 40))), len(leaf))


_TREE = U(0xD6E8FEB86659FD93)


def word_contexts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of each token's word features: the word before, the word before the last; before a text lie ends."""
    h1, h2 = np.full(len(h), END, U), np.full(len(h), END, U)
    h1[1:] = np.where(at[1:] >= 1, h[:-1], END)
    h2[2:] = np.where(at[2:] >= 2, h[:-2], END)
    return np.stack([mix(h1), mix(h2 + _TREE)])


class Trainer:
    """Mini-batch Adagrad on one partition's tokens, from given weights of classes and, with a tree, of its decisions."""

    def __init__(self, weights: np.ndarray, p: LmParams, tree: Tree | None = None, slots: np.ndarray | None = None):
        self.p, self.w = p, weights.copy()
        self.square = np.full((p.size, 1), 1e-6, np.float32)
        self.seen = np.zeros(p.size, np.float32)
        if tree is not None:
            self.tree, self.slots = tree, slots.copy()
            self.slot_square = np.full(len(slots), 1e-2, np.float32)
            self.slot_step, self.slot_seen = np.zeros(len(slots), np.float32), np.zeros(len(slots), np.float32)

    def learn_words(self, leaf: np.ndarray, words: np.ndarray) -> None:
        for lo in range(0, len(leaf), self.p.batch):
            some = words[:, lo:lo + self.p.batch]
            token, node, up = self.tree.paths(leaf[lo:lo + self.p.batch])
            at = self.tree.places(token, node, some)
            z = up * (self.tree.bias[node] + self.slots[at].sum(0))
            g = -up / (1 + np.exp(np.clip(z, -40, 40)))
            at, g = at.ravel(), np.tile(g, len(at))
            np.add.at(self.slot_step, at, g)
            np.add.at(self.slot_seen, at, np.ones(len(at), np.float32))
            step = self.slot_step[at]              # a slot met twice gets the same sum twice, and is set twice to the same value
            square = self.slot_square[at] + step * step
            self.slots[at] -= self.p.word_rate * step / np.sqrt(square)
            self.slot_square[at], self.slot_step[at] = square, 0

    def learn(self, rows: np.ndarray, c: np.ndarray) -> None:
        for lo in range(0, len(c), self.p.batch):
            r, y = rows[:, lo:lo + self.p.batch], c[lo:lo + self.p.batch]
            g = np.exp(log_shares(self.w, r))
            g[np.arange(len(y)), y] -= 1
            for f in r:
                order = np.argsort(f, kind="stable")
                s = f[order]
                start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                at, step = s[start].astype(np.int64), np.add.reduceat(g.take(order, 0), start, 0)
                self.square[at] += np.einsum('ij,ij->i', step, step)[:, None] / len(step[0])
                self.w[at] -= self.p.rate * step / np.sqrt(self.square[at])
                self.seen[at] += np.diff(np.append(start, len(s)))


def split_docs(docs: DataFrame, p: LmParams) -> DataFrame:
    """(doc_id, text, held_out)."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % p.folds
    return docs.select("doc_id", "text", (fold == 0).alias("held_out"))


def train(texts: DataFrame, tree: Tree, p: LmParams = LmParams()) -> tuple[np.ndarray, np.ndarray]:
    """The weights of classes and of decisions, fitted on every row of ``texts``. What reaches the driver is one table of each."""
    sc = texts.sparkSession.sparkContext
    weights, slots = np.zeros((p.size, p.classes), np.float32), np.zeros(1 << tree.bits, np.float32)
    # part i of a table: the rows from i * block; those of the decisions come after those of the classes; weights travel in half precision
    kinds = [(p.size, p.classes, 1 << 9), (len(slots), 1, 1 << 14)]
    behind = -(-p.size // kinds[0][2])
    schema = "part int, row binary, n binary, w binary"

    def record(part, row, n, w):
        arrays = [pa.array([part], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (row.astype(np.uint16), n.astype(np.float32), w.astype(np.float16))]]
        return pa.RecordBatch.from_arrays(arrays, ["part", "row", "n", "w"])

    def add(batches):
        """One row per part: touches summed, weights averaged by touches."""
        held: dict = {}
        for b in batches:
            for r in b.to_pylist():
                _, width, block = kinds[r["part"] >= behind]
                n, w = held.setdefault(r["part"], (np.zeros(block), np.zeros((block, width))))
                row, more = np.frombuffer(r["row"], np.uint16), np.frombuffer(r["n"], np.float32)
                n[row] += more
                w[row] += np.frombuffer(r["w"], np.float16).astype(np.float32).reshape(len(row), width) * more[:, None]
        for part, (n, w) in held.items():
            row = np.flatnonzero(n)
            yield record(part, row, n[row], w[row] / n[row, None])

    for _ in range(p.rounds):
        sent = sc.broadcast((weights, slots, tree))

        def learn(batches):
            w, s, tr = sent.value
            t = Trainer(w, p, tr, s)
            for b in slices(batches):
                h, c, at = tokens(split(b.column("text")), p)
                t.learn(contexts(h, c, at, p), c)
                t.learn_words(tr.leaves(h, c), word_contexts(h, at))
            for start, (size, _, block), seen, w in zip((0, behind), kinds, (t.seen, t.slot_seen), (t.w, t.slots)):
                for lo in range(0, size, block):
                    row = np.flatnonzero(seen[lo:lo + block])
                    if len(row):
                        yield record(start + lo // block, row, seen[lo:lo + block][row], w[lo:lo + block][row])

        # many partitions' parts are summed by 64 tasks each, then these by one
        parts = (texts.select("text").mapInArrow(learn, schema).withColumn("salt", F.spark_partition_id() % 64)
                 .repartition("part", "salt").drop("salt").mapInArrow(add, schema).repartition("part").mapInArrow(add, schema))
        weights, slots = weights.copy(), slots.copy()
        for r in parts.collect():
            kind = int(r["part"] >= behind)
            row = np.frombuffer(r["row"], np.uint16).astype(np.int64) + (r["part"] - kind * behind) * kinds[kind][2]
            w = np.frombuffer(r["w"], np.float16)
            if kind:
                slots[row] = w
            else:
                weights[row] = w.reshape(len(row), -1)
    return weights, slots


def counted(texts: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """(h, cls, c): every token of ``texts`` with its class and count. Each worker sums up before the shuffle."""
    def run(batches):
        held: list = []

        def merged():
            h, c, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h)
            start = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            return h[order][start], c[order][start], np.add.reduceat(n[order], start)

        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1], pa.int32()), pa.array(x[2], pa.int64())], ["h", "cls", "n"])

        size = 0
        for b in slices(batches):
            h, c, _ = tokens(split(b.column("text")), p)
            h, i, n = np.unique(h, return_index=True, return_counts=True)
            held.append((h, c[i], n))
            size += len(h)
            if size > 1_000_000:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 500_000:
                    yield out(held.pop())
                    size = 0
        if held:
            yield out(merged())
    # the class is a function of the word
    return texts.select("text").mapInArrow(run, "h long, cls int, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("c"))


def score(docs: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text)."""
    docs = split_docs(docs, p)
    sc = docs.sparkSession.sparkContext
    texts = docs.where("NOT held_out")
    counts = land(counted(texts, p), "lm-counts")
    # at most p.classes * 2^p.depth rows
    cell = F.col("cls") * (1 << p.depth) + (F.shiftrightunsigned("h", 64 - p.depth) if p.depth else 0)
    cells = counts.groupBy(cell.alias("cell")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(p.classes << p.depth), np.zeros(p.classes << p.depth)
    for r in cells:
        n[r["cell"]], v[r["cell"]] = r["n"], r["v"]
    total, distinct = sum(r["n"] for r in cells), sum(r["v"] for r in cells)
    # at most 1 / p.common words have that share of the tokens
    known = counts.where(F.col("c") >= p.common * total).select("h", "c").toPandas().sort_values("h")
    tree = Tree.of(n, v, len(known), p)
    sent = sc.broadcast((*train(texts, tree, p), tree, known["h"].to_numpy(np.int64), known["c"].to_numpy(np.int64)))

    def run(batches):
        w, slots, tr, kh, kc = sent.value
        for b in slices(batches):
            q = split(b.column("text"))
            h, c, at = tokens(q, p)
            n, size = b.num_rows, q.counts + 1
            doc = np.repeat(np.arange(n), size)
            fit = log_shares(w, contexts(h, c, at, p))[np.arange(len(c)), c]
            fit = (fit + tr.log_share(slots, tr.leaves(h, c), word_contexts(h, at))) / np.log(10)
            s = h.view(np.int64)
            j = np.minimum(np.searchsorted(kh, s), max(len(kh) - 1, 0))
            common = kh[j] == s if len(kh) else np.zeros(len(s), bool)
            log = np.where(common, np.log10((kc[j] if len(kh) else 0) + p.smooth), 0.)
            rare, rd = s[~common], doc[~common]
            order = np.lexsort((rare, rd))
            rare, rd = rare[order], rd[order]
            start = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (rd[1:] != rd[:-1])))) if len(rare) else np.zeros(0, np.int64)
            cut = pa.array(np.searchsorted(rd[start], np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(size, pa.int64()), pa.array(np.bincount(doc, common, n).astype(np.int64)),
                 pa.array(np.bincount(doc, log, n)), pa.array(np.bincount(doc, fit, n)),
                 pa.ListArray.from_arrays(cut, pa.array(rare[start], pa.int64())),
                 pa.ListArray.from_arrays(cut, pa.array(np.diff(np.append(start, len(rare))), pa.int32()))],
                ["doc_id", "held_out", "n_tokens", "known", "log", "fit", "rare", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    first = docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, log double, fit double, rare array<long>, times array<int>")
    first = land(first.withColumn("row", F.monotonically_increasing_id()), "lm-scored")     # numbers are fixed once written
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("t"))
    c = F.coalesce("c", F.lit(0))
    rest = (rare.join(counts.where(F.col("c") < p.common * total).select("h", "c"), "h", "left")
            .groupBy("row").agg(F.sum(F.when(c > 0, F.col("t")).otherwise(0)).alias("rare_known"), F.sum(F.col("t") * F.log10(c + p.smooth)).alias("rare_log")))
    out = first.drop("rare", "times").join(rest, "row", "left")
    log = F.col("log") + F.coalesce("rare_log", F.lit(0.))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"),
                      (log - F.col("n_tokens") * float(np.log10(total + p.smooth * (distinct + 1)))).alias("base_score"), (log + F.col("fit")).alias("score"))
