"""Hard negatives against a plain double loop."""
import math
import random

import numpy as np
import pytest

KIND = "vec_id long, embedding array<float>, label int, id string, w string, part int, seq int, ab string"


def brute(rows, anchors_every=100, positives=5, top=10):
    use = []
    for v, e, lab in rows:
        if v is None or lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        use.append((v, (lab + 1) % 10 if v % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for a, la, wa in use:
        if a % anchors_every:
            continue
        scored = [(-sum(x * y for x, y in zip(wa, w)), v, lab) for v, lab, w in use if v != a]
        pos = sorted((s, v) for s, v, lab in scored if lab == la)[:positives]
        for ps, pv in pos:
            neg = sorted((s, v) for s, v, lab in scored if lab != la and 30 * -ps <= 100 * -s <= 90 * -ps)[:top]
            out += [(a, pv, r + 1, v, -ps, -s) for r, (s, v) in enumerate(neg)]
    return sorted(out)


def vectors(seed, n=400, dim=8, groups=6):
    """Groups of near vectors, whose tree edges are short, and far ones; ties, repeats and odd rows."""
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    rows = []
    for i in range(n):
        c = centre[i % groups]
        near = .02 if i % 3 else 1.
        rows.append((i * 10, [x + rng.gauss(0, near) for x in c], rng.randrange(10) if i % 4 else i % groups))
    rows += [(7, None, 1), (8, [None] * dim, 1), (9, [float("nan")] * dim, 2), (11, [float("inf")] * dim, 3), (12, centre[0], None), (None, centre[0], 3),
             (13, [], 1), (14, [1.], 4), (15, centre[1] + [3., 4.], 5), (100, rows[10][1], rows[10][2]), (16, [0.] * dim, 6), (1000, [0.] * dim, 6), (-300, centre[2], 2)]
    rows += [(5000 + i, centre[3], 7) for i in range(30)]                 # one vector that many rows hold
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(v, e, lab, "i", "w", 1, 2, "ab") for v, e, lab in rows], KIND).repartition(3)


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"block": 16, "tree": 4}), (3, {"block": 7, "tree": 1}), (4, {"block": 64, "tree": 16})])
def test_against_brute_force(spark, seed, sizes):
    from votelens.llm import hardneg
    rows = vectors(seed)
    got = hardneg.mine(frame(spark, rows), hardneg.HardNegParams(**sizes))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 300
    assert sorted(tuple(r) for r in got.collect()) == want


def test_bounds_hold_and_save_work():
    """Near anchors: most candidates are never scored at the children, and none that matters is missed."""
    from votelens.llm import hardneg as H
    rng = np.random.default_rng(0)
    p = H.HardNegParams()
    centre = rng.normal(0, 200, 32)
    anchors = np.round(centre + rng.normal(0, 2, (60, 32))).astype(np.int64)
    cands = np.round(np.concatenate((centre + rng.normal(0, 60, (500, 32)), rng.normal(0, 200, (1500, 32))))).astype(np.int64)
    walk, parent, edge = H.spanning_tree(anchors)
    assert sorted(walk.tolist()) == list(range(60)) and (parent == -1).sum() == 1
    ids, labels = np.arange(2000), (np.arange(2000) < 400).astype(np.int64)
    w = H.Walk({"ids": -1 - np.arange(60), "labels": np.ones(60, np.int64), "m": anchors, "walk": walk, "parent": parent, "edge": edge}, {"ids": ids, "labels": labels, "m": cands})
    exact = anchors @ cands.T
    pos = {i: s for i, _, s in H.near_positives(w, p)}
    assert all(pos[i].tolist() == sorted(exact[i][labels == 1], reverse=True)[:5] for i in range(60))
    assert w.scored < .5 * w.seen
    before, w.scored, w.seen = w.scored, 0, 0
    for i, k, got, score in H.window_negatives(w, pos, p):
        lo, hi = H.windows_of(pos[i], p)[k]
        fits = sorted((-exact[i][c], c) for c in range(2000) if not labels[c] and lo <= exact[i][c] <= hi)[:10]
        assert [(-s, c) for c, s in zip(got.tolist(), score.tolist())] == fits
    assert w.scored < .5 * w.seen, (before, w.scored, w.seen)


def test_tree_of_equal_anchors_and_the_origin():
    from votelens.llm import hardneg as H
    walk, parent, edge = H.spanning_tree(np.array([[3, 4], [3, 4], [0, 0], [30, 40]]))
    assert walk[0] == 2 and edge[2] == 0 and sorted(edge.tolist()) == [0, 0, 5, 45]
    walk, parent, edge = H.spanning_tree(np.zeros((2, 0), np.int64))
    assert edge.tolist() == [0, 0]


def test_large_weights(spark):
    """Sums beyond 2^53 are exact; a score that is no long is an error."""
    from votelens.llm import hardneg as H
    big = [(100, [1e7, 1e6 + 3], 1), (1, [1e7, 1.], 1), (2, [9e6, 0.], 2), (3, [5e6, -7.], 2), (4, [2e6, 1e6], 3)]
    assert sorted(tuple(r) for r in H.mine(frame(spark, big)).collect()) == brute(big)
    a = np.array([1 << 31, 5])
    assert H.exact(np.array([[1 << 31, 3]]), a).tolist() == [(1 << 62) + 15]
    with pytest.raises(OverflowError):
        H.exact(np.array([[1 << 40, 3]]), a)


def test_empty(spark):
    from votelens.llm import hardneg
    for rows in ([], [(100, [1.], 1)], [(1, [1.], 1), (2, [1.], 2)], [(100, None, 1)]):
        assert hardneg.mine(frame(spark, rows)).collect() == []
