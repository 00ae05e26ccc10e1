"""Decisions inside the classes of the language model."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from votelens.llm import maxent
from votelens.llm.text import U, split


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")


P = maxent.LmParams(depth=4, slots=64, classes=8)
TEXTS = ["the cat sat on the mat and the dog sat on the log", "a cat and a dog ran to the mat", None, "cat mat dog log hat bat rat sat fat"] * 5


def known(texts, p=P):
    """(tree, {hash: (class, count)}) from plain counts."""
    h, c, _ = maxent.tokens(split(pa.array(texts)), p)
    words: dict = {}
    for x, k in zip(h.tolist(), c.tolist()):
        words[x] = (k, words.get(x, (k, 0))[1] + 1)
    n, v = np.zeros(p.classes << p.depth), np.zeros(p.classes << p.depth)
    for x, (k, m) in words.items():
        n[(k << p.depth) + (x >> (64 - p.depth))] += m
        v[(k << p.depth) + (x >> (64 - p.depth))] += 1
    return maxent.Tree.of(n, v, 16 * len(words), p), words


def trained(texts, rounds, p=P):
    tree, words = known(texts, p)
    t = maxent.Trainer(np.zeros((p.size, p.classes), np.float32), p, tree, np.zeros(1 << tree.bits, np.float32))
    h, c, at = maxent.tokens(split(pa.array(texts)), p)
    for _ in range(rounds):
        t.learn_words(tree.leaves(h, c), maxent.word_contexts(h, at))
    return tree, words, t


def shares(tree, slots, words, context, p):
    """P(word | class, context) of all known words and of one unseen place per leaf, by class."""
    x = np.array(list(words), U)
    c = np.array([words[k][0] for k in words])
    log = tree.log_share(slots, tree.leaves(x, c), np.repeat(context, len(x), 1)) + np.log([words[k][1] + p.smooth for k in words])
    leaf = np.arange(p.classes << tree.depth)
    unseen = tree.log_share(slots, leaf, np.repeat(context, len(leaf), 1)) + math.log(p.smooth)
    return np.bincount(c, np.exp(log), p.classes) + np.exp(unseen).reshape(p.classes, -1).sum(1)


@pytest.mark.parametrize("rounds", [0, 15])
def test_sums_to_one_over_a_small_vocabulary(rounds):
    tree, words, t = trained(TEXTS, rounds)
    assert tree.depth >= 2 and len(tree.node) and (rounds == 0) == (not t.slots.any())
    h, _, at = maxent.tokens(split(pa.array(["the cat sat unseen on"])), P)
    for context in maxent.word_contexts(h, at).T:
        assert np.allclose(shares(tree, t.slots, words, context[:, None], P), 1, atol=1e-5)


def test_without_training_it_is_the_share_within_the_class():
    """The decisions multiply out to (count + smooth) over the sum of the class's leaves."""
    tree, words, t = trained(TEXTS, 0)
    x, c = np.array(list(words), U), np.array([k for k, _ in words.values()])
    got = tree.log_share(t.slots, tree.leaves(x, c), np.zeros((2, len(x)), U))
    size = {k: sum(n + P.smooth for j, n in words.values() if j == k) + P.smooth * (1 << tree.depth) for k in set(c.tolist())}
    assert np.allclose(got, [-math.log(size[k]) for k in c.tolist()], atol=1e-6)


def test_context_tells_words_of_a_class_apart():
    """Two words of one class, each after a word of its own."""
    p = maxent.LmParams(depth=6, slots=256, slot_bits=20, classes=8)
    texts = ["red mat blue hat " * 30, "blue hat red mat " * 30]
    tree, _, t = trained(texts, 60, p)
    h, c, at = maxent.tokens(split(pa.array(["red mat blue hat"])), p)
    assert c[1] == c[3] and tree.leaves(h, c)[1] != tree.leaves(h, c)[3]
    feats = maxent.word_contexts(h, at)
    right = tree.log_share(t.slots, tree.leaves(h, c)[[1, 3]], feats[:, [1, 3]])
    wrong = tree.log_share(t.slots, tree.leaves(h, c)[[3, 1]], feats[:, [1, 3]])
    plain = tree.log_share(np.zeros_like(t.slots), tree.leaves(h, c)[[1, 3]], feats[:, [1, 3]])
    assert (right > wrong + 1).all() and (right > plain).all()


def test_scores_against_a_plain_loop():
    """log_share of trained weights, decision by decision."""
    tree, _, t = trained(TEXTS, 5)
    h, c, at = maxent.tokens(split(pa.array(["the cat sat on a new log", "dog"])), P)
    leaf, words = tree.leaves(h, c), maxent.word_contexts(h, at)
    got = tree.log_share(t.slots, leaf, words)
    for i in range(len(h)):
        log = float(tree.rest[leaf[i]])
        for j in range(tree.first[leaf[i]], tree.first[leaf[i] + 1]):
            one = np.zeros(1, np.int64)
            z = float(tree.bias[tree.node[j]]) + sum(float(t.slots[s]) for s in tree.places(one, tree.node[j:j + 1], words[:, i:i + 1])[:, 0])
            log -= math.log1p(math.exp(-float(tree.up[j]) * z))
        assert abs(log - got[i]) < 1e-4


def test_one_partition_is_the_sequential_loop(spark, given):
    """Blocks of both tables, written, summed and put together, equal one trainer's weights; empty partitions add nothing."""
    p = maxent.LmParams()
    texts = [r.text for r in given.select("text").collect()]
    one = given.sparkSession.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    texts = [r.text for r in one.collect()]
    tree, _ = known(texts, p)
    weights, slots = maxent.train(one, tree, p)
    t = maxent.Trainer(np.zeros((p.size, p.classes), np.float32), p, tree, np.zeros(1 << tree.bits, np.float32))
    for b in maxent.slices([pa.RecordBatch.from_pydict({"text": pa.array(texts)})]):
        h, c, at = maxent.tokens(split(b.column("text")), p)
        t.learn(maxent.contexts(h, c, at, p), c)
        t.learn_words(tree.leaves(h, c), maxent.word_contexts(h, at))
    assert np.abs(weights - t.w).max() < 1e-2 and np.abs(slots - t.slots).max() < 1e-2 and (slots != 0).sum() > 1000
    many, _ = maxent.train(one.repartition(5).where(F.col("text").isNotNull()), tree, p)
    assert many.shape == weights.shape and np.isfinite(many).all()


def test_held_out_texts_gain_from_the_words(given):
    """More than the class context alone gives."""
    def held(p):
        return maxent.score(given, p).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    flat, deep = held(maxent.LmParams(depth=0)), held(maxent.LmParams())
    assert deep.s > flat.s > flat.b
