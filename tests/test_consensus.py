"""Consensus scoring against hand-computed values and a sequential oracle."""
import math

import pytest
from pyspark.sql import functions as F

from sequential import random_log, sequential, static
from votelens.operators import consensus as C, evaluate as E, relational as R
from votelens.params import Params

VOTES = "voter string, subject long, annotation int, seq long"


def frames(spark, log, golds):
    return spark.createDataFrame(log, VOTES), spark.createDataFrame(sorted(golds.items()), "subject long, gold int")


def labelled(spark, rows):
    return spark.createDataFrame([("u:1", s, g, v, s) for s, g, v in rows], "voter string, subject long, gold int, annotation int, seq long")


@pytest.mark.parametrize("rows, gamma, want", [
    ([(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 1, 1), (4, 0, 0), (5, 0, 0), (6, 0, 0), (7, 0, 0)], 5.0, (9 / 14, 6 / 14)),
    ([(0, 0, 0), (1, 1, 0), (2, 1, 0)], 1.0, (2 / 3, 1 / 4)),
    ([(0, -1, 0)], 5.0, (.5, .5)),
])
def test_user_matrix(spark, rows, gamma, want):
    got = C.user_matrix(labelled(spark, rows), Params(gamma=gamma)).first()
    assert (got.s0, got.s1) == pytest.approx(want)


@pytest.mark.parametrize("prior, vote, s, want", [
    (.12, 1, (.25, .8), .096 / .756), (.12, 0, (.25, .8), .024 / .244), (.12, 1, (.5, .5), .12)])
def test_one_vote(spark, prior, vote, s, want):
    df = spark.createDataFrame([(1, vote, 0, *s)], "subject long, annotation int, seq long, s0 double, s1 double")
    assert C.subject_scores(df, Params(p0=prior)).first().p == pytest.approx(want, abs=1e-8)


def test_ten_votes_of_a_contrary_user(spark):
    df = spark.createDataFrame([(1, 0, k, .25, .25) for k in range(10)], "subject long, annotation int, seq long, s0 double, s1 double")
    assert C.subject_scores(df).first().p == pytest.approx(.9998758248, abs=1e-8)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("split_rows", [1_000_000, 20])
def test_against_sequential(spark, seed, split_rows):
    """Whole windows and windows cut into blocks give the same as one vote after the other."""
    log, golds = random_log(seed)
    votes, g = frames(spark, log, golds)
    params = Params(split_rows=split_rows, shares=64)
    hist, users, at_vote = sequential(log, golds)
    dyn = C.dynamic_votes(votes, g, params)
    got = {(r.voter, r.subject): (r.s0, r.s1) for r in dyn.collect()}
    assert got.keys() == at_vote.keys()
    for k, v in at_vote.items():
        assert got[k] == pytest.approx(v, abs=1e-12)
    scores = {r.subject: r.p for r in C.dynamic_scores(votes, g, params).collect()}
    assert scores == pytest.approx({s: h[-1] for s, h in hist.items()}, abs=2e-9)
    rows = C.score_history(dyn, params, votes).collect()
    assert {(r.subject, r.step): r.p for r in rows} == pytest.approx(
        {(s, k): p for s, h in hist.items() for k, p in enumerate(h)}, abs=2e-9)
    shist, suser = static(log, golds)
    assert {r.subject: r.p for r in C.static_scores(votes, g, params).collect()} == pytest.approx(
        {s: h[-1] for s, h in shist.items()}, abs=2e-9)
    m = C.user_matrix(C.votes_with_gold(C.first_vote_per_pair(votes), g), params)
    assert {r.voter: (r.s0, r.s1) for r in m.collect()} == {k: pytest.approx(v) for k, v in suser.items()}


@pytest.mark.parametrize("split_rows", [1_000_000, 10])
def test_imported_zeros_and_ones(spark, split_rows):
    """A score that reaches 0 or 1 stays; a vote with two zero factors changes nothing."""
    import random
    r = random.Random(4)
    users = {f"u:{k}": (r.choice([0., 1., .6, .7]), r.choice([0., 1., .6, .3])) for k in range(20)}
    log = [(f"u:{k}", s, r.randrange(2), s * 100 + k) for s in range(30) for k in r.sample(range(20), r.randrange(1, 9))]
    hist, _, _ = sequential(log, {}, users=users)
    df = spark.createDataFrame([(*v, *users[v[0]]) for v in log], VOTES + ", s0 double, s1 double")
    got = {x.subject: x.p for x in C.subject_scores(df, imported=True).collect()}
    assert got == pytest.approx({s: h[-1] for s, h in hist.items()}, abs=1e-8)
    steps = C.subject_prefix_scores(df, Params(split_rows=split_rows, shares=64), imported=True)
    assert {(x.subject, x.step): x.p for x in steps.collect()} == pytest.approx(
        {(s, k): p for s, h in hist.items() for k, p in enumerate(h) if k}, abs=1e-8)


def test_without_golds_both_modes_agree(spark):
    log, _ = random_log(9)
    votes, g = frames(spark, log, {0: -1})
    a = {r.subject: r.p for r in C.dynamic_scores(votes, g).collect()}
    b = {r.subject: r.p for r in C.static_scores(votes, g).collect()}
    assert a == b and set(a.values()) == {.12}


def test_shuffled_votes_keep_the_static_score(spark):
    log, golds = random_log(5)
    votes, g = frames(spark, log, golds)
    scored = C.static_votes(votes, g)
    last = R.shuffle_votes_within_subject(scored, 1)
    steps = C.subject_prefix_scores(last).groupBy("subject").agg(F.max_by("p", "step").alias("p"))
    assert {r.subject: r.p for r in steps.collect()} == pytest.approx({r.subject: r.p for r in C.static_scores(votes, g).collect()}, abs=1e-9)


def test_user_history_pads_the_shorter_list(spark):
    rows = labelled(spark, [(0, 1, 1), (1, 0, 0), (2, 0, 1), (3, 0, 0)])
    got = {r.step: (r.s0, r.s1) for r in C.user_history(rows, Params(gamma=1.0)).collect()}
    assert got == {0: (.5, .5), 1: (2 / 3, 2 / 3), 2: (.5, 2 / 3), 3: (3 / 5, 2 / 3)}


def test_parameters_are_checked():
    for bad in ({"gamma": 0.0}, {"p0": 1.0}, {"controversy": "sum"}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_many_agreeing_votes_keep_scores_apart(spark):
    """25 to 44 votes per subject: scores far in the tails stay different and in the order of their votes."""
    import random
    r = random.Random(2)
    log = [(f"u:{k % 10}", s, int((k % 10 == 9) != (s % 2 == 1)), s * 100 + k) for s in range(60) for k in r.sample(range(100), 25 + s % 20)]
    log = [(f"{u}-{q}", s, a, q) for u, s, a, q in log]        # a voter votes once on a subject
    users = {v[0]: (.9, .9) for v in log}
    df = spark.createDataFrame([(*v, *users[v[0]]) for v in log], VOTES + ", s0 double, s1 double")
    got = {x.subject: x.p for x in C.subject_scores(df).collect()}
    want = {}
    for u, s, a, q in log:
        want[s] = want.get(s, math.log(.12 / .88)) + (1 if a else -1) * math.log(9)
    bogus = [s for s in want if s % 2 == 0]
    assert all(0 < got[s] < 1e-6 for s in bogus) and len({got[s] for s in bogus}) == len({round(want[s], 6) for s in bogus}) > 5
    assert all(got[s] == pytest.approx(1 / (1 + math.exp(-want[s])), rel=1e-6) for s in want)
    prof = sorted((x.p, x.le_z) for x in E.score_profile(spark.createDataFrame([(s, 0, p) for s, p in got.items()], "subject long, gold int, p double")).collect())
    assert [n for _, n in prof] == [sum(p <= at for p in got.values()) for at, _ in prof]


def test_votes_other_than_0_and_1_do_not_count(spark):
    votes = spark.createDataFrame([("u:1", 1, 3, 4), ("u:1", 1, 1, 6), ("u:2", 1, None, 1), ("u:2", 2, -1, 1)], VOTES)
    assert [tuple(r) for r in C.first_vote_per_pair(votes).select("voter", "subject", "seq", "annotation").collect()] == [("u:1", 1, 6, 1)]
