"""Repeated passages by relative Lempel-Ziv parsing of every document against all documents with a smaller id.

A window is ``window`` consecutive words; a word goes if a window over it also starts in a document with a smaller id.

1. *Index.* Every window picks its anchor: the gram of ``gram`` words with the least hash in it. Equal windows pick equal anchors, so one
   word in twenty or so is indexed, and no repeated window can be missed. Between consecutive anchors lie segments (the reference blocks), each
   indexed by its hash with the smallest document that has it and its place there. Both indexes are minima per hash: a passage that
   a third of all documents share is one entry.
2. *Parse.* Going left to right, segments found one after the other in the same earlier document are one factor. All windows inside
   a factor are repeats.
3. *Factor boundaries.* A window that crosses one may still be a repeat. If its anchor occurs in another document,
   it is checked by its own hash against those of all other documents. The first document with a window never covers
   it by a factor, so its hash is there to be found: the result is the same as checking every window.

Segments and windows are compared by 96 bits of two hashes. A row is named by its id and a hash of its text; a factor lies within one row of the reference. Cases: null or empty text, or fewer words than a window: nothing goes. A null ``doc_id`` is smaller than none and
has none smaller: such rows stay whole. Rows with equal ids never remove each other's words; repeated rows give repeated results. A window repeated
only within its own document stays. Texts of any length are parsed whole. Extra columns do not enter. Empty table: no rows.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import land
from .text import U, Words, mix, slices, split

_BASES = [(U(b), U(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]
_B = _BASES[0][0]


@dataclass(frozen=True)
class RlzParams:
    window: int = 50
    gram: int = 16


class Parsed:
    """Anchors, segments and window hashes of the documents of one slice, all by word index within the slice."""

    def __init__(self, w: Words, p: RlzParams):
        self.w, self.p, h = w, p, w.hashes()
        n, k, span = len(h), p.gram, p.window - p.gram + 1
        self.sums = []
        for base, inverse in _BASES:
            up, down = np.full(n + 1, base, U), np.full(n + 1, inverse, U)
            up[:1], down[:1] = 1, 1
            self.sums.append((np.concatenate((np.zeros(1, U), np.cumsum(h * np.multiply.accumulate(up)[:n]))), np.multiply.accumulate(down)))
            h = mix(h ^ base)
        left = np.repeat(w.first[1:], w.counts) - np.arange(n)
        self.windows = np.flatnonzero(left >= p.window)             # starts of whole windows
        if not len(self.windows):
            self.anchor_of = self.anchors = self.ends = self.doc_first = np.zeros(0, np.int64)
            return
        at = np.arange(n - k + 1)
        low = self.range_hash(at, at + k)
        self.grams = low
        low = np.concatenate((low, np.full(p.window, ~U(0))))
        pos = np.arange(len(low))
        size = 1
        while 2 * size <= span:                                    # leftmost minimum of `size` grams, doubled
            low, pos, size = *_lower(low, pos, size), 2 * size
        low, pos = _lower(low, pos, span - size) if span > size else (low, pos)
        self.anchor_of = pos[self.windows]
        self.anchors = np.unique(self.anchor_of)
        doc = w.doc[self.anchors]
        last = np.append(doc[1:] != doc[:-1], True)
        self.ends = np.where(last, w.first[1:][doc], np.append(self.anchors[1:], 0) + k)    # segment j is anchors[j]:ends[j]
        self.doc_first = np.searchsorted(doc, np.arange(len(w.first)))

    def range_hash(self, start, end, which: int = 0):
        total, down = self.sums[which]
        return mix((total[end] - total[start]) * down[start] ^ (end - start).astype(U) * _B)

    def check(self, start, end) -> np.ndarray:
        """32 bits of the second hash."""
        return (self.range_hash(start, end, 1) >> U(32)).astype(np.uint32).view(np.int32)


def _lower(low, pos, by):
    take = low[by:] < low[:-by]
    return np.where(take, low[by:], low[:-by]), np.where(take, pos[by:], pos[:-by])


def indexed(docs: DataFrame, p: RlzParams) -> DataFrame:
    """(doc_id, rid, n_words, sha256 of the words, a, s, t): anchor hashes and segment hashes (two) of each row, in order."""
    def run(batches):
        for b in slices(batches):
            w = split(b.column("text"))
            q = Parsed(w, p)
            a = q.grams[q.anchors].view(np.int64) if len(q.anchors) else np.zeros(0, np.int64)
            s, t = q.range_hash(q.anchors, q.ends).view(np.int64), q.check(q.anchors, q.ends)
            cut = pa.array(q.doc_first if len(q.anchors) else np.zeros(b.num_rows + 1), pa.int32())
            sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("rid"), pa.array(w.counts, pa.int64()), pa.array(sha),
                 pa.ListArray.from_arrays(cut, pa.array(a, pa.int64())), pa.ListArray.from_arrays(cut, pa.array(s, pa.int64())),
                 pa.ListArray.from_arrays(cut, pa.array(t, pa.int32()))], ["doc_id", "rid", "n_words", "sha", "a", "s", "t"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, rid long, n_words long, sha string, a array<long>, s array<long>, t array<int>")


def references(index: DataFrame) -> DataFrame:
    """(doc_id, rid, found): for rows with an anchor that another document has, (j, ref, place) of these segments; ``ref`` is the row (of the smallest
    document) that has the segment, if that document is smaller than the own, ``place`` the segment's number there."""
    rows = index.where("doc_id IS NOT NULL").select("doc_id", "rid", F.posexplode(F.arrays_zip("a", "s", "t")).alias("j", "x"))
    rows = rows.select("doc_id", "rid", "j", "x.a", "x.s", "x.t")
    shared = rows.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a")
    rows = land(rows.join(shared, "a").select("doc_id", "rid", "j", "s", "t"), "rlz-anchors")
    first = rows.groupBy("s", "t").agg(F.min(F.struct("doc_id", "rid", "j")).alias("m"))
    earlier = F.col("m.doc_id") < F.col("doc_id")
    rows = rows.join(first, ["s", "t"]).select(
        "doc_id", "rid", F.struct("j", F.when(earlier, F.struct("m.doc_id", "m.rid")).alias("ref"), F.when(earlier, F.col("m.j")).alias("place")).alias("x"))
    return rows.groupBy("doc_id", "rid").agg(F.collect_set("x").alias("found"))


def factors(q: Parsed, d: int, found: list[dict]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Of row ``d`` of a slice: its factors (first word, end, reference row), and the windows to check."""
    lo, hi = q.doc_first[d], q.doc_first[d + 1]
    known = np.zeros(hi - lo, bool)
    out, last = [], None
    for x in sorted(found, key=lambda x: x["j"]):
        j = x["j"]
        known[j] = True
        if x["ref"] is None:
            last = None
        elif last == (j - 1, x["ref"], x["place"] - 1):
            out[-1] = (out[-1][0], int(q.ends[lo + j]), x["ref"])
            last = (j, x["ref"], x["place"])
        else:
            out.append((int(q.anchors[lo + j]), int(q.ends[lo + j]), x["ref"]))
            last = (j, x["ref"], x["place"])
    out = [f for f in out if f[1] - f[0] >= q.p.window]
    cut = np.searchsorted(q.windows, q.w.first[d:d + 2])
    at = q.windows[cut[0]:cut[1]]
    keep = known[np.searchsorted(q.anchors[lo:hi], q.anchor_of[cut[0]:cut[1]])]
    if out:
        start, end = np.array([f[0] for f in out]), np.array([f[1] for f in out])
        i = np.searchsorted(start, at, "right") - 1
        keep &= (i < 0) | (end[np.maximum(i, 0)] < at + q.p.window)
    return out, at[keep]


def parsed(docs: DataFrame, refs: DataFrame, p: RlzParams) -> DataFrame:
    """(doc_id, rid, text, spans, at, h, t): words in factors as flat (start, end) pairs; windows to check and their hashes."""
    rows = docs.where("doc_id IS NOT NULL").join(refs, ["doc_id", "rid"]).select("doc_id", "rid", "text", "found")

    def run(batches):
        for b in slices(batches):
            q = Parsed(split(b.column("text")), p)
            spans, at, h, t = [], [], [], []
            for d, found in enumerate(b.column("found").to_pylist()):
                base = q.w.first[d]
                f, check = factors(q, d, found)
                spans.append([int(x - base) for s, e, _ in f for x in (s, e)])
                at.append((check - base).astype(np.int32))
                h.append(q.range_hash(check, check + p.window).view(np.int64))
                t.append(q.check(check, check + p.window))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), b.column("text"), pa.array(spans, ints), pa.array(at, ints),
                                              pa.array(h, pa.list_(pa.int64())), pa.array(t, ints)], ["doc_id", "rid", "text", "spans", "at", "h", "t"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, text string, spans array<int>, at array<int>, h array<long>, t array<int>")


def repeated(middle: DataFrame) -> DataFrame:
    """(doc_id, rid, hits): windows to check that an earlier document has too."""
    w = middle.select("doc_id", "rid", F.explode(F.arrays_zip("at", "h", "t")).alias("x")).select("doc_id", "rid", "x.at", "x.h", "x.t")
    lo = w.groupBy("h", "t").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "t", "lo")
    return w.join(lo, ["h", "t"]).where("lo < doc_id").groupBy("doc_id", "rid").agg(F.collect_set("at").alias("hits"))


def cut(middle: DataFrame, hits: DataFrame, p: RlzParams) -> DataFrame:
    """(doc_id, rid, n_removed, spans, kept, sha): the removed word ranges of each parsed document and what is left of it."""
    rows = middle.select("doc_id", "rid", "text", "spans").join(hits, ["doc_id", "rid"], "left")

    def run(batches):
        for b in slices(batches):
            out = [[], [], [], []]
            for text, spans, hit in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "hits"))):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                start = np.array(list(spans[::2]) + (hit or []), np.int64)
                end = np.array(list(spans[1::2]) + [i + p.window for i in hit or []], np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                kept = b" ".join(compress(words, ~gone))
                for o, v in zip(out, (int(gone.sum()), turn.tolist(), kept.decode(), hashlib.sha256(kept).hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32())),
                                              pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                                             ["doc_id", "rid", "n_removed", "removed", "kept", "kept_sha"])
    kind = middle.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, n_removed long, removed array<int>, kept string, kept_sha string")


def substring_dedup(docs: DataFrame, p: RlzParams = RlzParams(), with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) of every row; ``removed`` holds flat (start, end) word ranges. ``with_text`` adds
    the words that stay of documents that lost any (``kept``, null for the others: they stay as they are)."""
    # rows with the same id and text are told apart by nothing and share one key (doc_id, rid)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("rid"))
    index = land(indexed(docs, p), "rlz-index")
    middle = land(parsed(docs, references(index), p).where("size(spans) > 0 OR size(at) > 0"), "rlz-parsed")
    done = cut(middle, repeated(middle), p).where("n_removed > 0")
    more = [F.first(c).alias(c) for c in ("n_removed", "removed", "kept_sha", *(["kept"] if with_text else []))]
    out = index.select("doc_id", "rid", "n_words", "sha").join(done.groupBy("doc_id", "rid").agg(*more), ["doc_id", "rid"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("kept_sha", "sha").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
                      *(["kept"] if with_text else []))
