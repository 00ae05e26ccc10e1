"""Benchmark decontamination: test n-grams in a broadcast hash set, looked up for every window of the training texts.

1. *Test side.* Every item is normalised to words (A-Z lower-cased; letters, digits and everything beyond ASCII) and cut into windows of
   ``window`` words; an item of fewer words is one window. The distinct windows are a table (w, item).
2. *Hash set.* Two probes of each window's 64-bit hash are set in a bit set that Spark aggregates word by word. It has ``spare`` bits per window, at most
   2^``max_bits`` (32 MB), whatever the size of the benchmark: this is all that is broadcast. Beyond that size it only lets more windows
   through to be verified.
3. *Scan.* One pass over the texts hashes all windows of the lengths that occur and notes those in the set, with their words.
4. *Verify.* Noted windows are joined with the table on their words. The table goes to the tasks if it was counted to at most ``send`` rows, otherwise
   Spark shuffles the noted windows, which are few beside the texts. A word inside any verified window is hit.
5. *Remove.* ``remove_spans`` cuts every run of hit words out of its text, ``remove_documents`` drops every document with a hit.

Cases: a null or empty text, or one of gaps only, has no words, hits nothing and is not contaminated; an item without words has no window. Texts of any length
are scanned whole; a text shorter than a window meets shorter items only. Rows with equal ids are judged by their own texts, repeated rows alike.
Items that share an id are one item, equal items with different ids are named each. An item without an id hits words but is not
counted or named. Extra columns do not enter and are kept by both ways of removing. Empty documents: no rows; empty benchmark: no hits.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import land
from .text import U, slices, split

GAPS = np.ones(256, bool)
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ROW = "__decontam_row"


@dataclass(frozen=True)
class DecontamParams:
    window: int = 10
    spare: int = 256               # bits of the set per window of the benchmark
    max_bits: int = 28
    send: int = 200_000            # rows of the window table that may go to every task (some 20 MB)


def _probes(h: np.ndarray, bits: int):
    return h >> U(64 - bits), (h << U(32)) >> U(64 - bits) if bits <= 32 else h & U((1 << bits) - 1)


def _words(w, lowered: bytes, at: int, k: int) -> str:
    return b" ".join(lowered[s:e] for s, e in zip(w.start[at:at + k], w.end[at:at + k])).decode()


def windows(bench: DataFrame, p: DecontamParams) -> DataFrame:
    """(w, k, h, item): distinct windows of each item, their number of words and hash."""
    def run(batches):
        for b in slices(batches):
            w = split(b.column("text"), GAPS)
            h, lowered, ids = w.hashes(lower=True), w.data.tobytes().translate(_LOWER), b.column("item").to_pylist()
            out = set()
            for k in range(1, p.window + 1):
                at, g = w.runs(h, k)
                doc = w.doc[at]
                use = np.flatnonzero(w.counts[doc] == k) if k < p.window else np.arange(len(at))
                out |= {(_words(w, lowered, a, k), k, x, ids[d]) for a, x, d in zip(at[use], g[use].view(np.int64).tolist(), doc[use])}
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string()))], ["w", "k", "h", "item"])
    rows = bench.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(run, "w string, k int, h long, item string").distinct()


def hash_set(wins: DataFrame, n: int, p: DecontamParams) -> tuple[int, np.ndarray]:
    """Bits of the probes and the bit set, as 64-bit words. At most 2^(max_bits - 6) rows of two longs come to the driver."""
    bits = min(max(int(n * p.spare).bit_length(), 10), p.max_bits)
    first = F.shiftrightunsigned("h", 64 - bits)
    second = F.shiftrightunsigned(F.shiftleft("h", 32), 64 - bits)
    rows = wins.select(F.explode(F.array(first, second)).alias("b"))
    rows = rows.groupBy(F.shiftright("b", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), U)
    out[rows.column("i").to_numpy()] = rows.column("v").to_numpy().view(U)
    return bits, out


def scan(docs: DataFrame, wins: DataFrame, n: int, p: DecontamParams) -> DataFrame:
    """(doc_id, row, n_words, found): of each text the windows in the hash set, as (w, k, at)."""
    spark = docs.sparkSession
    lengths = sorted(r.k for r in wins.select("k").distinct().collect())        # at most ``window`` numbers
    sent = spark.sparkContext.broadcast((lengths, *hash_set(wins, n, p)))

    def run(batches):
        lens, bits, table = sent.value
        has = lambda x: (table[(x >> U(6)).astype(np.int64)] >> (x & U(63))) & U(1) == 1
        for b in slices(batches):
            w = split(b.column("text"), GAPS)
            h, lowered, found = w.hashes(lower=True), None, [{} for _ in range(b.num_rows)]
            for k in lens:
                at, g = w.runs(h, k)
                x, y = _probes(g, bits)
                at = at[has(x) & has(y)]
                if len(at):
                    lowered = lowered or w.data.tobytes().translate(_LOWER)
                    doc = np.searchsorted(w.first, at, "right") - 1
                    for a, d in zip(at.tolist(), doc.tolist()):
                        found[d].setdefault((_words(w, lowered, a, k), k), []).append(a - int(w.first[d]))
            kind = pa.list_(pa.struct([("w", pa.string()), ("k", pa.int32()), ("at", pa.list_(pa.int32()))]))
            rows = pa.array([[{"w": t, "k": k, "at": v} for (t, k), v in f.items()] for f in found], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(w.counts, pa.int64()), rows], ["doc_id", "row", "n_words", "found"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {kind}, row string, n_words long, found array<struct<w:string,k:int,at:array<int>>>")


def _row_key():
    """Names a row by its content: 128 bits of id and text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary"))


@dataclass(frozen=True)
class Hits:
    scanned: DataFrame         # (doc_id, row, n_words, found) of every row
    words: DataFrame           # (row, i): the hit words of each text
    items: DataFrame           # (row, item): the items that have a window there


def hits(docs: DataFrame, bench: DataFrame, p: DecontamParams = DecontamParams()) -> Hits:
    wins = land(windows(bench, p), "dc-windows")
    n = wins.count()
    sent = F.broadcast if n <= p.send else lambda df: df
    scanned = land(scan(docs.select("doc_id", "text", _row_key().alias("row")), wins, n, p), "dc-scan")
    noted = scanned.where("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.w", "f.k", "f.at")
    true = noted.join(sent(wins.select("w").distinct()), "w")
    words = (true.select("row", "k", F.explode("at").alias("s"))
             .select("row", F.explode(F.sequence("s", F.col("s") + F.col("k") - 1)).alias("i")).distinct())
    items = noted.select("row", "w").join(sent(wins.select("w", "item")), "w").select("row", "item").distinct()
    return Hits(scanned, words, items)


def contamination(docs: DataFrame, bench: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    h = hits(docs, bench, p)
    named = h.items.groupBy("row").agg(F.count("item").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("names"))
    hit = h.words.groupBy("row").agg(F.count("*").alias("n_hit")).join(named, "row")
    # texts without a noted window take no part in the join
    noted = h.scanned.where("size(found) > 0").select("doc_id", "row", "n_words").join(hit, "row", "left")
    clean = h.scanned.where("size(found) = 0").select("doc_id", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in (("n_hit", "long"), ("n_items", "long"), ("names", "string"))])
    out = noted.select(*clean.columns).union(clean)
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
                      F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, bench: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    rows = docs.withColumn(_ROW, _row_key())
    return rows.join(hits(docs, bench, p).words.select(F.col("row").alias(_ROW)).distinct(), _ROW, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def remove_spans(docs: DataFrame, bench: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """``docs`` with every run of hit words cut out of ``text``, from the first letter of the run to its last; all columns kept."""
    cut = hits(docs, bench, p).words.groupBy("row").agg(F.sort_array(F.collect_list("i")).alias(_ROW + "s")).withColumnRenamed("row", _ROW)
    rows = docs.withColumn(_ROW, _row_key()).join(cut, _ROW, "left").select(*[f"`{c}`" for c in docs.columns], _ROW + "s")
    kind = docs.schema["text"].dataType.simpleString()
    assert kind == "string", kind

    def run(batches):
        for b in slices(batches):
            spans, text = b.column(_ROW + "s").to_pylist(), b.column("text").to_pylist()
            for i, hit in zip(range(b.num_rows), spans):
                if hit:
                    w = split(pa.array([text[i]]), GAPS)
                    at = np.array(hit)
                    turn = np.flatnonzero(np.diff(at) > 1)
                    heads, tails = w.start[at[np.append(0, turn + 1)]], w.end[at[np.append(turn, len(at) - 1)]]
                    edges = [0, *np.stack((heads, tails), 1).ravel().tolist(), len(w.data)]
                    data = w.data.tobytes()
                    text[i] = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])).decode()
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(text, b.schema.field(at).type)).drop_columns([_ROW + "s"])
    return rows.mapInArrow(run, docs.schema)


#: DuckDB, with ``window`` in place.
ORACLE = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), {window}) AS k,
    unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT r, i, k, s FROM dw SEMI JOIN bw USING (k, s)),
wrd AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
itm AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit JOIN bw USING (k, s) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN wrd USING (r) LEFT JOIN itm USING (r)"""
