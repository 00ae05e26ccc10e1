"""Quality rules: a calibrated logistic model over hashed word and character n-grams, behind plain text rules.

Method: word and character n-grams (bytes of the UTF-8 text) are hashed into a fixed number of features; a feature's
value is its share of the text's n-grams. A logistic regression is fitted by Spark ML on labelled rows, its margin is
calibrated by a second, one-variable logistic fit on labelled rows the first did not see, and all texts are scored in
Arrow batches (a gather and a sum per n-gram) against fixed thresholds.

Cases: null text = empty text: all figures 0, ``base_failed`` true, ``kept`` false. A null or unlabelled ``doc_id`` is
scored like any other. Several labels of one document: the lowest quality counts. Repeated rows are judged each.
No usable labels (none, or one class only): the model has no say, every text that passes the base rules is kept.

Toxic texts are the subject of a second model (``fit_toxic``) over the presence of words, A-Z lower-cased and without marks at their ends: an
insult counts the same in a long text as in a short one; words whose link with the label could be chance take no part; longer words also
count by their first bytes. Several labels of one document: toxic if one says so. A text goes if either model says so.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..session import scratch_path
from .text import U, Words, mix, slices, split

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass(frozen=True)
class QualityParams:
    """``fit_rows`` bounds the labelled rows used to fit (the lowest hashes of their ids, so a random choice that does not
    depend on layout); a quarter of them calibrates. ``keep`` is the probability from which a text is kept."""
    bits: int = 14
    char_n: int = 4
    word_n: tuple = (1, 2)
    fit_rows: int = 6000
    calibrate_share: float = .25
    iterations: int = 40
    penalty: float = 1e-3
    keep: float = .5
    min_words: int = 50
    repeat_share: float = .5
    symbols: bytes = b"#*$%&|<>"
    seed: int = 17
    toxic_bits: int = 18           # hashed words of the toxic model
    stem: int = 6                  # bytes of a word's beginning
    toxic_penalty: float = 1e-4
    toxic_spread: float = 4.       # a word counts from so many standard deviations above chance
    toxic_from: float = .5         # probability from which a text is toxic


@dataclass(frozen=True)
class Model:
    weights: np.ndarray      # one per feature, in units of the feature's share
    bias: float
    slope: float = 1.
    shift: float = 0.

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def features(w: Words, p: QualityParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind of n-gram: (document of each n-gram, its feature). Character n-grams come first in the feature range."""
    out, size = [], 1 << p.bits
    n = len(w.data) - p.char_n + 1
    if n > 0:
        g = np.zeros(n, np.uint32)
        for j in range(p.char_n):
            g = (g << np.uint32(8)) | w.data[j:j + n]
        g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - p.bits)
        doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
        inside = doc[:n] == doc[p.char_n - 1:]
        out.append((doc[:n][inside], g[inside].astype(np.int64)))
    else:
        out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    h, doc = w.hashes(), w.doc
    for i, k in enumerate(p.word_n):
        at, g = w.runs(h, k)
        out.append((doc[at], (mix(g + U(i)) >> U(64 - p.bits)).astype(np.int64) + size * (1 + i)))
    return out


_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def present(w: Words, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every hashed word that a document has, and of every beginning of a longer word, each once."""
    start, end = w.start.copy(), w.end.copy()
    while len(cut := np.flatnonzero(_MARK[w.data[end - 1]] & (end - start > 1))):
        end[cut] -= 1
    while len(cut := np.flatnonzero(_MARK[w.data[start]] & (end - start > 1))):
        start[cut] += 1
    h = Words(w.data, w.offsets, start, end, w.first).hashes(lower=True)
    # inflected and compounded words share their beginning
    stem = mix(Words(w.data, w.offsets, start, np.minimum(end, start + p.stem), w.first).hashes(lower=True) ^ U(1))
    long = end - start > p.stem
    h, doc = np.concatenate((h, stem[long])), np.concatenate((w.doc, w.doc[long]))
    both = np.unique((doc << p.toxic_bits) | (mix(h) >> U(64 - p.toxic_bits)).astype(np.int64))
    return both >> p.toxic_bits, both & ((1 << p.toxic_bits) - 1)


def toxic_margins(w: Words, m: Model, p: QualityParams) -> np.ndarray:
    doc, f = present(w, p)
    return m.bias + np.bincount(doc, m.weights[f], len(w.offsets) - 1)


def margins(w: Words, m: Model, p: QualityParams) -> np.ndarray:
    n = len(w.offsets) - 1
    total = np.full(n, m.bias)
    for doc, f in features(w, p):
        count = np.bincount(doc, minlength=n)
        total += np.bincount(doc, m.weights[f], n) / np.maximum(count, 1)
    return total


def base_figures(batch: pa.RecordBatch, w: Words, p: QualityParams) -> dict:
    """The plain figures of each text, as in ``BASE``."""
    n, doc_of = len(w.offsets) - 1, lambda mask: np.add.reduceat(
        np.append(mask, False).astype(np.int64), w.offsets[:-1]) * (np.diff(w.offsets) > 0)
    symbol = np.zeros(256, bool)
    symbol[list(p.symbols)] = True
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    at, g = w.runs(w.hashes(), 3)
    d = w.doc[at]
    key = mix(g ^ mix(d.astype(U) + U(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    hit = np.zeros(len(w.start) + 3, bool)
    for j in range(3):
        hit[at[twice] + j] = True
    repeats = np.bincount(w.doc, hit[:len(w.start)], n).astype(np.int64)
    dup = np.zeros(n, np.int64)
    for i, text in enumerate(batch.column("text").to_pylist()):
        seen: set = set()
        for line in (text or "").split("\n"):
            if line in seen:
                dup[i] += 1
            elif line.strip(" \t\n\v\f\r"):
                seen.add(line)
    words = w.counts.astype(np.int64)
    return {"n_words": words, "word_chars": doc_of(inside & ((w.data & 0xC0) != 0x80)), "n_symbols": doc_of(symbol[w.data]),
            "n_dup_lines": dup, "n_repeat_words": repeats,
            "base_failed": (words < p.min_words) | (repeats > p.repeat_share * words)}


def fit(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> Model | None:
    """Fit on at most ``p.fit_rows`` labelled documents (``labels``: doc_id, quality 0 / 1)."""
    known = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").cast("double").alias("label")))

    def shares(w):
        kinds = features(w, p)
        for i in range(len(w.offsets) - 1):
            total: dict = {}
            for doc, f in kinds:
                lo, hi = np.searchsorted(doc, (i, i + 1))
                v, c = np.unique(f[lo:hi], return_counts=True)
                total.update(zip(v.tolist(), (c / max(hi - lo, 1)).tolist()))
            yield total
    _, rows = _labelled(docs, known, p, shares, (1 + len(p.word_n)) << p.bits)
    if not _both(rows.where("NOT second")):
        return None
    first = LogisticRegression(maxIter=p.iterations, regParam=p.penalty).fit(rows.where("NOT second"))
    return _calibrated(Model(first.coefficients.toArray(), float(first.intercept)), first, rows, p)


def fit_toxic(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> Model | None:
    """The model of toxic texts, fitted like ``fit`` on ``labels`` (doc_id, toxic 0 / 1).

    Words are chosen before the fit, by counts: a word that ``rows`` texts hold, ``bad`` of them toxic, takes part if ``bad`` exceeds what chance gives
    (the share of toxic texts times ``rows``) by ``toxic_spread`` standard deviations. The few that remain are numbered anew for a narrow fit."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id")
             .agg(F.max("toxic").cast("double").alias("label")))

    def words(w):
        doc, f = present(w, p)
        cut = np.searchsorted(doc, np.arange(len(w.offsets)))
        return (dict.fromkeys(f[a:b].tolist(), 1.) for a, b in zip(cut[:-1], cut[1:]))
    rows, _ = _labelled(docs, known, p, words, 1 << p.toxic_bits)
    first = rows.where("NOT second")
    if not _both(first):
        return None
    n, share = first.agg(F.count("*"), F.avg("label")).first()
    held = first.select("label", F.explode("features.indices").alias("word")).groupBy("word").agg(F.count("*").alias("rows"), F.sum("label").alias("bad"))
    spread = F.sqrt(F.col("rows") * (share * (1 - share)) * (1 - F.col("rows") / F.lit(n)))
    on = sorted(r.word for r in held.where((F.col("bad") - share * F.col("rows")) > p.toxic_spread * spread).select("word").collect())
    if not on:
        return None
    place = {f: i for i, f in enumerate(on)}

    def few(batches):
        for b in batches:
            found = [[(place[f], 1.) for f in at if f in place] for at in b.column("at").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("second"), _vectors(found, len(on))], ["label", "second", "features"])

    _, rows = _with_vectors(rows.select("label", "second", F.col("features.indices").alias("at")).mapInArrow(few, f"label double, second boolean, features {_VECTOR}"))
    fitted = LogisticRegression(maxIter=p.iterations, regParam=p.toxic_penalty, standardization=False).fit(rows.where("NOT second"))
    weights = np.zeros(1 << p.toxic_bits)
    weights[on] = fitted.coefficients.toArray()
    return _calibrated(Model(weights, float(fitted.intercept)), fitted, rows, p)


def _labelled(docs, known, p: QualityParams, values, size: int) -> tuple[DataFrame, DataFrame]:
    """(label, second, features), as in ``_with_vectors``, of at most ``p.fit_rows`` rows of ``known`` (doc_id, label), landed; ``values``: one {feature: value} per text of a slice."""
    # at most fit_rows pairs of numbers: a proven bound, so the texts need no shuffle
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").limit(p.fit_rows)
    chosen = chosen.withColumn("second", F.pmod(F.xxhash64("doc_id", F.lit(p.seed + 1)), F.lit(1000)) < 1000 * p.calibrate_share)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "second", "text")

    def sparse(batches):
        for b in slices(batches):
            found = [sorted(v.items()) for v in values(split(b.column("text")))]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("second"), _vectors(found, size)], ["label", "second", "features"])

    return _with_vectors(rows.mapInArrow(sparse, f"label double, second boolean, features {_VECTOR}"))


#: How Spark ML stores a sparse vector (type 0).
_VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def _vectors(rows: list[list[tuple]], size: int) -> pa.Array:
    return pa.array([{"type": 0, "size": size, "indices": [int(i) for i, _ in r], "values": [float(v) for _, v in r]} for r in rows],
                    pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))


def _with_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landed rows as plain structs, and the same table read as vectors: no row passes a Python function for it."""
    plain, path = rows.sparkSession.read.schema(rows.schema), scratch_path(rows.sparkSession, "quality-fit")
    rows.write.parquet(path)
    vectors = StructType([StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in rows.schema])
    return plain.parquet(path), rows.sparkSession.read.schema(vectors).parquet(path)


def _both(rows: DataFrame) -> bool:
    return {r[0] for r in rows.select("label").distinct().collect()} == {0., 1.}


def _calibrated(model: Model, fitted, rows: DataFrame, p: QualityParams) -> Model:
    """A one-variable logistic fit of the margin on the rows that the first fit did not see."""
    held = fitted.transform(rows.where("second")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    if not _both(held):
        return model
    again = LogisticRegression(maxIter=p.iterations, regParam=1e-2, standardization=False).fit(held.select("label", array_to_vector(F.array("margin")).alias("features")))
    return Model(model.weights, model.bias, float(again.coefficients[0]), float(again.intercept)) if again.coefficients[0] > 0 else model


def score(docs: DataFrame, model: Model | None, p: QualityParams = QualityParams(), toxic: Model | None = None) -> DataFrame:
    """(doc_id, figures of ``BASE``, probability, toxic, kept) of every row of ``docs`` (doc_id, text). ``toxic``: its probability."""
    sent = docs.sparkSession.sparkContext.broadcast((model, toxic))      # one weight per feature: fixed size

    def run(batches):
        for b in slices(batches):
            w = split(b.column("text"))
            got = base_figures(b, w, p)
            prob, bad = _probabilities(w, *sent.value, p)
            got |= {"probability": prob, "toxic": bad, "kept": ~got["base_failed"] & (prob >= p.keep) & (bad < p.toxic_from)}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, got.values())], ["doc_id", *got])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, {BASE}, probability double, toxic double, kept boolean")


def _probabilities(w: Words, model: Model | None, toxic: Model | None, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    n = len(w.offsets) - 1
    return (model.probability(margins(w, model, p)) if model else np.ones(n),
            toxic.probability(toxic_margins(w, toxic, p)) if toxic else np.zeros(n))


def judge(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    return score(docs, fit(docs, labels, p), p, fit_toxic(docs, labels, p) if "toxic" in labels.columns else None)


def keep_rows(docs: DataFrame, model: Model | None, p: QualityParams = QualityParams(), toxic: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast((model, toxic))

    def run(batches):
        for b in slices(batches):
            w = split(b.column("text"))
            prob, bad = _probabilities(w, *sent.value, p)
            yield b.filter(pa.array(~base_figures(b, w, p)["base_failed"] & (prob >= p.keep) & (bad < p.toxic_from)))
    return docs.mapInArrow(run, docs.schema)
