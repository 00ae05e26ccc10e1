"""Trials in one job, bootstrap rounds, and the online scorer."""
import pytest
from pyspark.sql import functions as F

from sequential import random_log, sequential, static
from votelens.operators import consensus as C
from votelens.params import Params
from votelens.plans import bootstrap as B, trials as X
from votelens.streaming.online import OnlineScorer

VOTES = "voter string, subject long, annotation int, seq long"


@pytest.fixture(scope="module")
def world(spark):
    log, golds = random_log(21, voters=10, subjects=20, n=250)
    return log, golds, spark.createDataFrame(log, VOTES).persist(), \
        spark.createDataFrame(sorted(golds.items()), "subject long, gold int").persist()


def separate(log, used, golds):
    """Scores of one trial per class, one subject after the other."""
    hist, _ = static(log, used)
    return {c: sorted(h[-1] for s, h in hist.items() if golds.get(s, -1) == c) for c in (-1, 0, 1)}


def check_trials(trials, votes, log, golds, g, wanted=None):
    first = C.first_vote_per_pair(votes)
    member = {}
    for r in trials.golds().collect():
        member.setdefault(tuple(r[k] for k in trials.keys), {})[r.subject] = r.gold
    points, scores, last = {}, {}, trials.last.first()[0] if trials.last else trials.n
    for r in trials_points(first, trials, g):
        at = points.setdefault(tuple(r[k] for k in trials.keys), {-1: [], 0: [], 1: []})
        for c, n in ((-1, r.m), (0, r.z), (1, r.o)):
            at[c] += [r.p] * n
    for r in X.trial_scores(first, trials).collect():
        scores.setdefault(tuple(r[k] for k in trials.keys), {})[r.subject] = r.p
    keys = [tuple(r)[1:] for r in trials.table.collect()]
    assert set(scores) == set(keys) and len(keys) == trials.n and set(points) == set(keys[:last + 1])
    for t in keys:
        used = member.get(t, {})
        assert wanted is None or used == wanted(t)
        hist, _ = static(log, used)
        assert scores[t] == pytest.approx({s: h[-1] for s, h in hist.items()}, abs=2e-9)
        assert t not in points or {c: sorted(p) for c, p in points[t].items()} == {c: pytest.approx(p, abs=2e-9) for c, p in separate(log, used, golds).items()}
    flat = trials.for_all(X.trial_gold_metrics(X.trial_points(first, trials, g), list(trials.keys), .3)).collect()
    assert len(flat) == trials.n
    for r in flat:
        p, t = scores[tuple(r[k] for k in trials.keys)], [golds.get(s, -1) for s in scores[keys[0]]]
        real = [s for s in p if golds.get(s) == 1]
        assert (r.n_none, r.n_bogus, r.n_real) == tuple(sum(x == v for x in t) for v in (-1, 0, 1))
        assert r.completeness == pytest.approx(sum(p[s] > .3 for s in real) / len(real))


def trials_points(first, trials, g):
    return X.trial_points(first, trials, g).collect()


def test_random_trials_equal_separate_runs(spark, world):
    log, golds, votes, g = world
    trials = X.random_trials(g, [3, 8], 2, seed=1)
    check_trials(trials, votes, log, golds, g)
    rows = trials.golds().collect()
    sizes = {}
    for r in rows:
        sizes[r.golds, r.n] = sizes.get((r.golds, r.n), 0) + 1
        assert golds[r.subject] == r.gold
    assert sizes == {(3, 0): 3, (3, 1): 3, (8, 0): 8, (8, 1): 8}


def test_ordered_trials_grow(spark, world):
    log, golds, votes, g = world
    trials = X.ordered_trials(g, 2, 8, 3)
    rows = trials.golds().collect()
    sets = {n: {r.subject for r in rows if r.n == n} for n in {r.n for r in rows}}
    assert {n: len(s) for n, s in sets.items()} == {0: 5, 1: 8, 2: 11}
    assert sets[0] < sets[1] < sets[2]
    check_trials(trials, votes, log, golds, g)
    # more blocks than one, and prefixes longer than there are labels
    long = X.ordered_trials(g, 0, 300, 1)
    labelled = sum(v >= 0 for v in golds.values())
    assert long.n == 301 and X.trial_points(C.first_vote_per_pair(votes), long, g).select("n").distinct().count() == labelled
    check_trials(X.ordered_trials(g, 0, 130, 1), votes, log, golds, g)


def test_cv_grid_members(spark, world):
    log, golds, votes, g = world
    trials = X.cv_grid_trials(votes, g, range(0, 5, 2), range(0, 5, 4))
    size = {}
    for r in trials.golds().collect():
        size.setdefault((r.controversial, r.consensus), set()).add(r.subject)
    assert (0, 0) not in size and len(size[(2, 0)]) == 2 and len(size[(0, 4)]) == 4
    assert size[(4, 4)] == size[(4, 0)] | size[(0, 4)] and size[(2, 4)] == size[(2, 0)] | size[(0, 4)]
    check_trials(trials, votes, log, golds, g)


def test_untouched_subjects_have_no_rows(spark):
    """Two groups of voters who never meet: labels in one leave no row for the subjects of the other."""
    votes = spark.createDataFrame([(f"a{k}", s, (s + k) % 2, 100 * s + k) for s in range(5) for k in range(4)]
                                  + [(f"b{k}", s, k % 2, 100 * s + k) for s in range(50, 80) for k in range(4)], VOTES)
    g = spark.createDataFrame([(s, s % 2) for s in range(5)], "subject long, gold int")
    first, trials = C.first_vote_per_pair(votes), X.ordered_trials(g, 0, 4, 2)
    assert {r.subject for r in X.moved_scores(first, trials).collect()} <= set(range(5))
    per = X.trial_points(first, trials, g).groupBy("n").agg(F.sum(F.col("m") + F.col("z") + F.col("o")).alias("all"), F.max("m").alias("m")).collect()
    assert {(r["all"], r.m) for r in per} == {(35, 30)}


def test_trial_lists_are_the_broadcast_side(spark, tmp_path):
    """An exploded table is estimated at its source's size: copied to every worker it would be (trials x labels) rows at the driver."""
    spark.range(3000).selectExpr("id AS subject", "cast(id % 2 as int) AS gold").write.parquet(str(tmp_path / "g"))
    g = spark.read.parquet(str(tmp_path / "g"))
    for trials in (X.random_trials(g, [3, 8], 10), X.ordered_trials(g, 0, 60, 3)):
        for df in (trials.labels, trials.golds()):
            plan, inside = df._jdf.queryExecution().executedPlan().toString().splitlines(), None
            for line in plan:
                depth = len(line) - len(line.lstrip(" :+-"))
                inside = depth if "BroadcastExchange" in line else inside if inside is not None and depth > inside else None
                assert inside is None or "Generate" not in line
    assert X.random_trials(g, [3, 8], 10).golds().count() == 110


def test_trials_summed_in_buckets(spark, world, monkeypatch):
    """Votes meet weights as short rows, whatever the buckets; at a cutoff, scores far from it are not kept apart."""
    log, golds, votes, g = world
    g = g.unionByName(g.limit(2))                               # a subject with two labels counts twice
    first, trials = C.first_vote_per_pair(votes), X.ordered_trials(g, 0, 40, 1)
    keys, got = list(trials.keys), []
    for size in (X.VOTES, 37):
        monkeypatch.setattr(X, "VOTES", size)
        points = X.trial_points(first, trials, g)
        assert "vectorudt" not in points._jdf.queryExecution().executedPlan().toString().lower()
        assert "cogroup" in points._jdf.queryExecution().executedPlan().toString().lower()
        near = X.trial_points(first, trials, g, cutoff=.3)
        assert max(r["count"] for r in near.groupBy(*keys).count().collect()) <= 3      # below, above, untouched
        got += [sorted(map(str, X.trial_gold_metrics(p, keys, .3).collect())) for p in (points, near)]
    assert all(x == got[0] for x in got)
    scores = X.trial_scores(first, trials).join(g, "subject", "left").withColumn("gold", F.coalesce("gold", F.lit(-1)))
    plain = X.trial_gold_metrics(X.evaluate.score_points(scores, keys), keys, .3)
    assert set(got[0]) <= set(map(str, plain.select(*X.trial_gold_metrics(points, keys, .3).columns).collect()))
    few = X.random_trials(g, [3], 2)
    a, b = (sorted(map(str, X.trial_gold_metrics(X.trial_points(first, few, g, cutoff=c), list(few.keys), .12).collect())) for c in (None, .12))
    assert a == b


def test_gold_choices(spark, world):
    _, golds, votes, g = world
    rows = g.withColumn("load_seq", F.lit(1)).unionByName(g.limit(3).withColumn("gold", F.lit(1)).withColumn("load_seq", F.lit(2)))
    assert X.select_golds("all", gold_rows=rows).count() == len(golds)
    assert {r.subject: r.gold for r in X.select_golds("literal", gold_rows=rows, literal={4: 1}).collect()} == {4: 1}
    assert X.select_golds("consensus", gold_rows=rows, votes=votes, n=5).count() == 5
    both = X.union_golds(g, X.select_golds("literal", gold_rows=rows, literal={4: 7}))
    assert {r.gold for r in both.where("subject = 4").collect()} == {7}
    with pytest.raises(ValueError):
        X.select_golds("none", gold_rows=rows)


def test_bootstrap_rounds(spark, world):
    log, golds, votes, g = world
    own = {s: v for s, v in list(golds.items())[:9] if v >= 0}
    train = spark.createDataFrame(sorted(own.items()), "subject long, gold int")
    low, high = .11, .2
    rounds = B.bootstrap_loop(votes, train, 3, low, high, changes={2: (.05, .5)}).collect()
    silver = dict(own)
    for n in (1, 2, 3):
        low, high = (.05, .5) if n == 3 else (.11, .2)
        hist, _ = static(log, silver)
        mine = {r.subject: r for r in rounds if r.round == n}
        assert {s: r.p for s, r in mine.items() if r.p is not None} == pytest.approx({s: h[-1] for s, h in hist.items()}, abs=2e-9)
        silver = {s: own.get(s, 0 if r.p < low else 1 if r.p > high else None) for s, r in mine.items()}
        assert {s: r.silver for s, r in mine.items()} == silver
        silver = {s: v for s, v in silver.items() if v is not None}


def test_stream_batches_equal_one_run_and_replays_change_nothing(spark, world, tmp_path):
    log, golds, votes, g = world
    hist, users, _ = sequential(log, golds)
    scorer = OnlineScorer(spark, str(tmp_path / "s"), g, Params(split_rows=15, shares=64), buckets=4, fan=2).start_cold()
    df = votes.withColumnRenamed("seq", "classification_id")
    cuts = [0, 60, 61, 150, 250]
    for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = df.where((F.col("classification_id") >= lo) & (F.col("classification_id") < hi))
        part = part.unionByName(df.where(F.col("classification_id") < lo).limit(5))     # delivered again
        scorer.process(part, b)
        if b in (1, 3):
            scorer.process(part, b)                                                    # repeated batch
    snap = {r.subject: (r.p, r.n_votes) for r in scorer.snapshot().collect()}
    assert {s: p for s, (p, _) in snap.items()} == pytest.approx({s: h[-1] for s, h in hist.items()}, abs=2e-9)
    assert {s: n for s, (_, n) in snap.items()} == {s: len(h) - 1 for s, h in hist.items()}
    emitted = {}
    for r in scorer.emitted().orderBy("classification_id").collect():
        emitted.setdefault(r.subject, []).append(r.score)
    assert {s: pytest.approx(v, abs=2e-9) for s, v in emitted.items()} == {s: h[1:] for s, h in hist.items()}
    assert scorer.stored_votes().count() == len(log)
    warm = OnlineScorer(spark, str(tmp_path / "w"), g).warm_start(df.withColumn("seq", F.col("classification_id")))
    assert {r.subject: r.p for r in warm.snapshot().collect()} == pytest.approx({s: p for s, (p, _) in snap.items()}, abs=2e-9)


def test_warm_start_over_a_log_that_repeats_ids(spark, world, tmp_path):
    """A dump and the online table overlap: every id counts once, for subjects and for voters."""
    log, golds, votes, g = world
    df = votes.select("voter", "subject", "annotation", F.col("seq").alias("classification_id"), "seq")
    twice = df.unionByName(df.where("seq % 3 = 0")).unionByName(df.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1000))
    once, warm = (OnlineScorer(spark, str(tmp_path / n), g).warm_start(d) for n, d in (("o", df), ("t", twice)))
    for table in ("snapshot", "users"):
        a, b = (sorted(map(str, getattr(s, table)().collect())) for s in (once, warm))
        assert a == b
    hist, _, _ = sequential(log, golds)
    warm.process(df.select("classification_id", "voter", "subject", "annotation"), 0)      # all delivered before
    assert {r.subject: r.n_votes for r in warm.snapshot().collect()} == {s: len(h) - 1 for s, h in hist.items()}


def test_points_for_a_purity_equal_all_points(spark, monkeypatch):
    """Scores are only told apart where the threshold can be: same thresholds as with all scores, in few rows; a vote is one row for all trials."""
    log, golds = random_log(5, voters=12, subjects=400, n=3000)
    first, g = C.first_vote_per_pair(spark.createDataFrame(log, VOTES)), spark.createDataFrame(sorted(golds.items()), "subject long, gold int")
    trials, keys = X.ordered_trials(g, 0, 200, 5), ["golds", "n"]
    full = X.trial_points(first, trials, g).persist()
    for target in (.3, .515, .7, .99):
        monkeypatch.setattr(X, "VOTES", 900)
        points = X.trial_points(first, trials, g, target=target)
        assert points.count() < full.count() / 2
        got, wanted = ({(r.golds, r.n): (r.purity, r.completeness) for r in X.random_trial_points(p, target=target).collect()} for p in (points, full))
        assert got == wanted and len(got) == 41


def test_bins_and_their_lowest():
    import numpy as np
    ends = X._ends(Params())
    for steps in X.STEPS:
        at = np.unique(np.concatenate([np.arange(-3000, 3000), np.random.default_rng(1).integers(-2 * 10 ** 10, 10 ** 10, 5000)]))
        bins = X._bin(at, ends, steps)
        low = X._lowest(bins, steps)
        assert (np.diff(bins) >= 0).all() and (low <= at).all() and (X._bin(low, ends, steps) == bins).all()
        assert (X._bin(low - 1, ends, steps) < bins)[np.abs(at) > 1].all()
