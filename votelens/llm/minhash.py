"""Near-duplicates by b-bit MinHash.

1. One pass over the texts: the set of word shingles of each document, its key (two sums over hashed shingles), ``bands x rows`` minima,
   one key per band, and a signature of the low two bits of every minimum, packed into longs.
2. Documents with one set are one class; all that follows works on classes.
3. Bands that two classes share make candidates. The similarity of a candidate is estimated from the equal lanes of the signatures by bit
   counts, corrected for lanes that agree by chance (one in four); what is far below the threshold is left. The rest is confirmed
   by the size of the intersection of the full sets.
4. No bucket is expanded into rows of pairs. First each member meets one member of one of its buckets (the smallest one there, of the
   highest estimate), confirmed pairs are joined into components. Buckets whose members are all connected are done. In
   the others the members outside the largest component are compared with all of another component, block by block within a
   task, on their full sets; that work grows with their number times that of the bucket.

A pair at the threshold is missed with a probability of (1 - .8^4)^28 < 5e-7 by the bands, and by the estimate below 1e-6 (five
standard deviations); more similar pairs less often. Sets are compared by 64-bit hashes of their shingles.

Cases: null or empty text (no words): no set, linked with nothing, a component of its own. Fewer words than a shingle: the whole sequence
is the one shingle. Repeated rows: the same class. Rows that share a ``doc_id`` but not a text are judged by their text. Null ``doc_id``: such a row
is in the class of its text and never names it; a text that only rows without id have is linked with nothing. Ties: the smallest id. Extra columns do not enter. Empty table: no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import land
from .components import components
from .text import U, mix, slices, split

LANES = 0x5555555555555555


@dataclass(frozen=True)
class MinHashParams:
    """Link two sets if ``100 * |A & B| >= percent * |A | B|``. ``gate`` is the estimate below which a candidate is left."""
    words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4
    per_long: int = 28             # two-bit lanes in a packed long
    gate: float = .57
    star_rounds: int = 1
    cell: int = 512                # members of a block that meet those of another one in a task
    columns: int = 4096            # shingles of a cell that are multiplied at a time
    seed: int = 11

    @property
    def longs(self) -> int:
        return -(-self.bands * self.rows // self.per_long)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    w = split(column)
    return w.shingles(w.hashes(lower=True), k)


def sketch(sets: list[np.ndarray], p: MinHashParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sets: keys (n, 2), band keys (n, bands), packed signatures (n, longs), all uint64."""
    n, m = len(sets), p.bands * p.rows
    rng = np.random.default_rng(p.seed)
    mul, add = rng.integers(0, 1 << 63, m, dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, m, dtype=U)
    flat = np.concatenate(sets)
    cut = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    key = np.stack([np.add.reduceat(mix(flat ^ U(c)), cut) for c in (0x5BD1E995, 0xC2B2AE35)], 1)
    low = np.empty((m, n), U)
    for j in range(m):
        low[j] = np.minimum.reduceat(flat * mul[j] + add[j], cut)
    bands = np.empty((n, p.bands), U)
    for b in range(p.bands):
        h = np.full(n, b + 1, U)
        for r in range(p.rows):
            h = mix(h * U(0x9E3779B97F4A7C15) + low[b * p.rows + r])
        bands[:, b] = h
    sig = np.zeros((n, p.longs), U)
    for j in range(m):
        sig[:, j // p.per_long] |= (mix(low[j]) & U(3)) << U(2 * (j % p.per_long))
    return key, bands, sig


def profile(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """(doc_id, n, cid, bands, sig) of every row; ``cid`` (16 bytes) is the class, null without words."""
    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), p.words)
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            cid, bands, sig = ([None] * len(sets) for _ in range(3))
            if len(full):
                key, bk, sg = sketch([sets[i] for i in full], p)
                for i, k, x, y in zip(full, key, bk.view(np.int64), sg.view(np.int64)):
                    cid[i], bands[i], sig[i] = k.tobytes(), x, y
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(cid, pa.binary()), pa.array(bands, longs), pa.array(sig, longs)],
                                             ["doc_id", "n", "cid", "bands", "sig"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, cid binary, bands array<long>, sig array<long>")


def estimate(a: str, b: str, p: MinHashParams):
    """Collision-corrected similarity of two packed signatures: a lane differs if one of its two bits does."""
    lanes = p.bands * p.rows
    differ = None
    for i in range(p.longs):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        count = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LANES)))
        differ = count if differ is None else differ + count
    return 1 - differ / F.lit(.75 * lanes)


def _sets(docs: DataFrame, wanted: DataFrame, p: MinHashParams) -> DataFrame:
    """(cid, s): the full sets of the wanted classes, from one document each."""
    rows = docs.select("doc_id", "text").join(wanted.select("doc_id", "cid"), "doc_id")

    def run(batches):
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), p.words)
            keep = [i for i, (s, c) in enumerate(zip(sets, b.column("cid").to_pylist())) if len(s) and _key(s) == c]
            yield pa.RecordBatch.from_arrays([b.column("cid").take(pa.array(keep, pa.int64())), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                                             ["cid", "s"])
    return rows.mapInArrow(run, "cid binary, s array<long>")


def _key(s: np.ndarray) -> bytes:
    return np.array([np.add.reduce(mix(s ^ U(c))) for c in (0x5BD1E995, 0xC2B2AE35)]).tobytes()


def _confirm(pairs: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = (pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= p.percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _spanning(ask: np.ndarray, root: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the hits (row: place in ``ask``, column: member) those that join two trees of the known components (``root``) and the hits before:
    at most one less than there are members, and they connect what all hits connect."""
    tree = np.arange(int(root.max()) + 1)

    def top(x):
        while tree[x] != x:
            tree[x] = tree[tree[x]]
            x = tree[x]
        return x

    a, b = [], []
    for row, i in enumerate(ask):
        found = np.flatnonzero(hit[row])
        for r, j in zip(*np.unique(root[found], return_index=True)):
            x, y = top(int(root[i])), top(int(r))
            if x != y:
                tree[max(x, y)] = min(x, y)
                a.append(i)
                b.append(found[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def _across(members: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """Links (a, b) of different components, confirmed on full sets, among the members (key, cid, root) of each bucket.

    The largest component of a bucket is cut into blocks, and so are all others ("askers"). A cell is one block of askers beside one
    block of either; its sets meet in one task as a product of incidence matrices. Members are sent, not pairs, and a cell names a spanning
    forest of its links.
    """
    per = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(p.cell)).cast("int")
    top = top.select("key", F.col("m.root").alias("main"), blocks(F.col("m.n")).alias("nm"), blocks(F.col("n") - F.col("m.n")).alias("nq"))
    rows = members.join(top, "key")
    asks = F.col("root") != F.col("main")
    rows = rows.withColumn("k", F.pmod(F.xxhash64("cid"), F.when(asks, F.col("nq")).otherwise(F.col("nm"))).cast("int"))
    cell = lambda q, b, ask: F.struct(q.cast("int").alias("q"), b.cast("int").alias("b"), F.lit(ask).alias("asks"))
    none = F.array().cast("array<struct<q:int,b:int,asks:boolean>>")
    spread = lambda lo, hi, f: F.when(lo <= hi, F.transform(F.sequence(lo, hi), f)).otherwise(none)
    zero, k = F.lit(0), F.col("k")
    main = spread(zero, F.col("nq") - 1, lambda q: cell(q, k, False))
    asker = F.concat(spread(zero, F.col("nm") - 1, lambda b: cell(k, b, True)), spread(zero, k - 1, lambda o: cell(k, F.col("nm") + o, True)),
                     spread(k + 1, F.col("nq") - 1, lambda q: cell(q, F.col("nm") + k, False)))
    rows = rows.select("key", "cid", "root", F.explode(F.when(asks, asker).otherwise(main)).alias("c")).select("key", "c.q", "c.b", "c.asks", "cid", "root")
    # whole hashes: a link that full sets would refuse must not stand for a true one in the forest
    cells = rows.join(sets.select("cid", "s"), "cid").repartition("key", "q", "b").sortWithinPartitions("key", "q", "b")

    def pair(held, first):
        cids, roots, asks, items = zip(*held)
        asks, size = np.array(asks), np.array([len(x) for x in items])
        root = np.unique(np.frombuffer(b"".join(roots), "V16"), return_inverse=True)[1]
        _, token, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(items)), size)
        keep = times[token] > 1
        owner, token = owner[keep], (np.cumsum(times > 1) - 1)[token[keep]]
        order = np.argsort(token, kind="stable")
        owner, token, ask = owner[order], token[order], np.flatnonzero(asks)
        common = np.zeros((len(ask), len(items)), np.float32)
        for lo in range(0, int(token[-1]) + 1 if len(token) else 0, p.columns):
            cut = slice(*np.searchsorted(token, (lo, lo + p.columns)))
            m = np.zeros((len(items), min(p.columns, int(token[-1]) + 1 - lo)), np.float32)
            np.add.at(m, (owner[cut], token[cut] - lo), 1)
            common += m[ask] @ m.T
        common = common.astype(np.int64)
        hit = (100 * common >= p.percent * (size[ask][:, None] + size[None, :] - common)) & (root[ask][:, None] != root[None, :])
        if not first:
            hit &= ~asks[None, :]                                   # askers among themselves: in the first cell of their block
        return pa.RecordBatch.from_arrays([pa.array([cids[i] for i in x], pa.binary()) for x in _spanning(ask, root, hit)], ["a", "b"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for key, q, b, asks, cid, root, s in zip(*(c if i == 6 else c.to_pylist() for i, c in enumerate(batch.columns))):
                if (key, q, b) != now:
                    if len(held) > 1:
                        yield pair(held, now[2] == 0)
                    now, held = (key, q, b), []
                held.append((cid, root, asks, s.values.to_numpy()))
        if len(held) > 1:
            yield pair(held, now[2] == 0)

    return cells.select("key", "q", "b", "asks", "cid", "root", "s").mapInArrow(run, "a binary, b binary").distinct()


def link(docs: DataFrame, prof: DataFrame, p: MinHashParams) -> DataFrame:
    """(cid, root): classes linked to another class, with the root of their component. ``prof`` is a landed ``profile``."""
    reps = land(prof.where("cid IS NOT NULL").groupBy("cid").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "mh-classes")
    keys = reps.select("cid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("key")
    buckets = land(keys.join(shared, "key"), "mh-buckets")
    wanted = reps.join(buckets.select("cid").distinct(), "cid").select("cid", "doc_id", "n", "sig")
    wanted = land(wanted, "mh-wanted")
    sets = land(_sets(docs, wanted, p).dropDuplicates(["cid"]), "mh-sets")
    sigs = wanted.select("cid", "n", "sig")
    members = land(buckets.join(sigs, "cid"), "mh-members")
    large, small = F.greatest("na", "nb"), F.least("na", "nb")
    possible = (100 * small >= p.percent * large) & (estimate("ga", "gb", p) >= p.gate)
    side = lambda df, x, *more: df.select("key", F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"g{x}"), *more)

    roots = None
    for turn in range(p.star_rounds + 1):
        if roots is None:
            now = members.withColumn("root", F.col("cid"))
        else:
            now = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        hub = F.min(F.struct("root", "cid", "n", "sig"))
        open_ = now.groupBy("key").agg(hub.alias("h"), F.max("root").alias("top")).where("h.root <> top")
        if turn < p.star_rounds:
            pairs = (side(now, "a", F.col("root")).join(open_, "key").where("root <> h.root")
                     .select("a", "na", "ga", F.col("h.cid").alias("b"), F.col("h.n").alias("nb"), F.col("h.sig").alias("gb"))
                     .where(possible).withColumn("e", estimate("ga", "gb", p))
                     .groupBy("a").agg(F.max(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
            found = _confirm(pairs, sets, p)
        else:
            found = _across(now.join(open_.select("key"), "key").select("key", "cid", "root"), sets, p)
        # what is connected already is a star, and that is all the next round needs
        found = found if roots is None else found.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(found)
    return roots.select(F.col("node").alias("cid"), "root")


def groups(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    prof = land(profile(docs, p), "mh-profile")
    classes = prof.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("first"))
    named = classes.join(link(docs, prof, p), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = land(named, "mh-named")
    # a table of its own, so that the join's large side can be split where one component holds very many classes
    lowest = land(named.groupBy("root").agg(F.min("first").alias("component")), "mh-lowest")
    named = named.join(lowest, "root").select("cid", "component")
    # documents without words share no class; their join key is null and matches nothing
    out = prof.select("doc_id", "n", "cid").join(named, "cid", "left")
    own = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
