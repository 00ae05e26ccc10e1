"""Byte-level BPE with the tiktoken library and a local rank file.

The text is cut by a pattern first and each match is merged on its own. A long text is handed to the library in pieces
that end at safe boundaries: a space after a character that is no white space and before one that is none. No match of
the pattern reaches over such a place (only white space itself, or a space at the front of a match, contains a space),
so the ids of the pieces are the ids of the text. A stretch without such a place stays whole. Ids are decoded to raw bytes.

Cases: null text = empty text: no ids. Lone surrogates cannot occur in a Spark string. Strings of special tokens are
ordinary text. Ids outside the rank file make ``decode_bytes`` raise. Repeated rows are encoded each.
"""
from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import slices

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict = {}     # per Python worker: rank files already read


@dataclass(frozen=True)
class BpeParams:
    """``ranks``: a rank file that every executor can open (installed with the library, or shipped with ``addFile``)."""
    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern: str = public_tokenizers.PATTERN
    piece_chars: int = 1 << 16


def encoder(p: BpeParams):
    import tiktoken
    key = (p.ranks, p.pattern)
    if key not in _loaded:
        with open(p.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[key] = tiktoken.Encoding("local", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def pieces(text: str, limit: int):
    """``text`` in order, in pieces of at least ``limit`` characters that end at safe boundaries."""
    at = 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def ids_of(text: str | None, enc, limit: int) -> list[int]:
    text = text or ""
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, limit) for i in enc.encode_ordinary(piece)]


def encode(df: DataFrame, p: BpeParams = BpeParams(), text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with its token ids as an array<int>."""
    @F.pandas_udf("array<int>")
    def run(s):
        enc = encoder(p)
        return s.map(lambda x: ids_of(x, enc, p.piece_chars))
    return df.withColumn(out, run(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, p: BpeParams = BpeParams(), ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its token ids; null ids are no bytes."""
    @F.pandas_udf("binary")
    def run(s):
        enc = encoder(p)
        return s.map(lambda x: enc.decode_bytes([] if x is None else list(x)))
    return df.withColumn(out, run(F.col(ids)))


def digests(docs: DataFrame, p: BpeParams = BpeParams()) -> DataFrame:
    """Per row: doc_id, n_tokens and the digests of ids and decoded bytes, without moving the ids out of the worker."""
    def run(batches):
        enc, name = encoder(p), None
        for b in slices(batches):
            name = name or [str(i) for i in range(enc.n_vocab)]
            n, a, d = [], [], []
            for text in b.column("text").to_pylist():
                ids = ids_of(text, enc, p.piece_chars)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([name[i] for i in ids]).encode()).hexdigest())
                d.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, p: BpeParams = BpeParams()) -> DataFrame:
    """(doc_id, source, n_tokens, ids, round_trip) per row; ``round_trip`` says that the decoded bytes are the text's."""
    def run(batches):
        enc = encoder(p)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            ids = [ids_of(t, enc, p.piece_chars) for t in texts]
            same = [enc.decode_bytes(i) == (t or "").encode() for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)],
                                             ["doc_id", "source", "n_tokens", "ids", "round_trip"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "text").mapInArrow(
        run, f"doc_id {kind}, source string, n_tokens long, ids array<int>, round_trip boolean")
