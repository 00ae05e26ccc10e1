"""Gradients against differences, passes against a plain loop, fits against separate ones."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from votelens.plans import gradient as G, learning as L

ROWS = "id long, x array<double>, y int"


def rows(seed, n=300, d=5, classes=2):
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1.5, (classes, d))
    x = rng.normal(0, 1, (n, d))
    y = (x @ w.T + rng.gumbel(0, .5, (n, classes))).argmax(1)
    return [(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)]


def differences(f, w, eps=1e-6):
    return np.array([(f(w + eps * e) - f(w - eps * e)) / (2 * eps) for e in np.eye(len(w))])


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 2, (40, 4)), rng.integers(0, 2, 40)
    w = rng.normal(0, 1, 5)
    loss = lambda v: G.huber_loss((2 * y - 1) * (np.c_[np.ones(40), x] @ v)).mean()
    assert G.huber_gradient(w, x, y) == pytest.approx(differences(loss, w), abs=1e-5)
    w = rng.normal(0, 1, 3 * 6 + 1)
    assert G.mlp_loss(w, x, y, 3)[1] == pytest.approx(differences(lambda v: G.mlp_loss(v, x, y, 3)[0], w), abs=1e-4)
    y = rng.integers(0, 3, 40)
    w = rng.normal(0, 1, 15)

    def log_loss(v):
        z = np.c_[np.ones(40), x] @ v.reshape(3, 5).T
        return (np.log(np.exp(z).sum(1)) - z[np.arange(40), y]).mean()
    assert G.softmax_gradient(w.reshape(3, 5), x, y).ravel() == pytest.approx(differences(log_loss, w), abs=1e-5)


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_one_partition_is_the_plain_loop(spark, batch):
    data = rows(1, classes=3)
    df = spark.createDataFrame(data, ROWS)
    order = G.row_order(F.col("id"), 4)
    got = G.softmax_pass(df.coalesce(1), np.zeros((3, 6)), rate=.2, lam=1e-3, batch=batch, order=order)
    by = {r.id: r for r in df.withColumn("o", order).collect()}
    line = sorted(by.values(), key=lambda r: r.o)
    w = np.zeros((3, 6))
    for k in range(0, len(line), batch):
        part = line[k:k + batch]
        w = w - .2 * (G.softmax_gradient(w, np.array([r.x for r in part]), np.array([r.y for r in part])) + 1e-3 * w)
    assert got == pytest.approx(w, abs=1e-12)


def test_partitions_are_averaged_by_rows(spark):
    df = spark.createDataFrame(rows(2, classes=3), ROWS).withColumn("p", F.when(F.col("id") < 50, 0).otherwise(1))
    both = df.repartition(2, "p").sortWithinPartitions("id")
    sizes = [n for n in both.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    got = G.softmax_pass(both, np.zeros((3, 6)), order=F.col("id"))
    parts = [G.softmax_pass(df.where(c).coalesce(1), np.zeros((3, 6)), order=F.col("id")) for c in ("p = 0", "p = 1")]
    assert got == pytest.approx((50 * parts[0] + 250 * parts[1]) / 300, abs=1e-12) if len(sizes) == 2 else parts
    empty = df.where("false")
    assert (G.softmax_pass(empty, np.ones((3, 6))) == 1).all()


def test_huber_svm_learns(spark):
    df = spark.createDataFrame(rows(3, n=1200), ROWS).repartition(3)
    fit, test = df.where("id < 900"), df.where("id >= 900")
    model = G.HuberSVM(alpha=1e-3, passes=8).fit(fit, F.col("id"))
    got = test.select("y", model.probability(F.col("x")).alias("p"), model.margin(F.col("x")).alias("m")).collect()
    right = sum((r.p > .5) == (r.y == 1) for r in got) / len(got)
    assert right > .85 and all(0 <= r.p <= 1 and (r.m > 0) == (r.p > .5) for r in got)
    # close to the optimum of the same loss
    x, y = np.array([r.x for r in fit.orderBy("id").collect()]), np.array([r.y for r in fit.orderBy("id").collect()])
    total = lambda w: G.huber_loss((2 * y - 1) * (np.c_[np.ones(len(x)), x] @ w)).mean() + 5e-4 * w[1:] @ w[1:]
    best, value, _ = G.minimise(lambda w: (total(w), G.huber_gradient(w, x, y) + 1e-3 * np.append(0, w[1:])), np.zeros(6))
    assert total(model.w) < 1.1 * value + .01


def test_minimise_quadratic_and_rosenbrock():
    a = np.diag([1., 10., 100.])
    w, value, _ = G.minimise(lambda v: (v @ a @ v / 2 - v.sum(), a @ v - 1), np.zeros(3), tol=1e-9)
    assert w == pytest.approx([1, .1, .01], abs=1e-6)
    w, value, _ = G.minimise(lambda v: ((1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2,
                                        np.array([-2 * (1 - v[0]) - 400 * v[0] * (v[1] - v[0] ** 2), 200 * (v[1] - v[0] ** 2)])), np.array([-1.2, 1.]))
    assert w == pytest.approx([1, 1], abs=1e-3)


def test_mlp_penalty_and_skill(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 2))
    data = [(i, [float(a), float(b)], int(a * b > 0)) for i, (a, b) in enumerate(x)]       # no line separates these
    df = spark.createDataFrame(data, ROWS).repartition(2)
    fit, test = df.where("id < 300"), df.where("id >= 300")
    loose, tight = G.MLP(hidden=6, lam=.01, max_iter=60, tol=1e-3, seed=1).fit(fit), G.MLP(hidden=6, lam=30., max_iter=30, tol=1e-3, seed=1).fit(fit)
    assert np.abs(tight.w).sum() < .5 * np.abs(loose.w).sum()
    got = test.select("y", loose.probability(F.col("x"), 2).alias("p")).collect()
    assert sum((r.p > .5) == (r.y == 1) for r in got) / len(got) > .85
    plain = G.mlp_loss(loose.w, np.array([r[1] for r in data[:300]]), np.array([r[2] for r in data[:300]]), 6)[0] / 300
    free = loose._free(2)
    assert loose.value == pytest.approx(plain + .01 / 600 * (loose.w * free) @ loose.w, abs=1e-9)


def test_prefix_fits_equal_separate_ones(spark):
    from pyspark.ml.classification import LogisticRegression
    from votelens.plans import learning as L
    df = spark.createDataFrame(rows(6, n=260), ROWS).withColumn("position", F.col("id")).repartition(3)
    sizes = [60, 120, 260]
    w = G.prefix_logistic(df, sizes, lam=1e-2)
    for j, n in enumerate(sizes):
        m = LogisticRegression(family="binomial", regParam=1e-2, standardization=False, tol=1e-10, maxIter=200).fit(L.as_features(df.where(F.col("id") < n)))
        assert w[j] == pytest.approx([m.intercept, *m.coefficients.toArray()], abs=1e-4)


def test_linear_losses_against_differences():
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(0, 1, (50, 4)), rng.integers(0, 2, 50), rng.normal(0, 1, 5)
    for loss in (G.log_loss, G.hinge_loss):
        assert loss(w, x, y)[:-1] == pytest.approx(differences(lambda v: loss(v, x, y)[-1], w), abs=1e-4)


def test_cross_validation_side_by_side_equals_fits_apart(spark):
    from votelens.operators import evaluate as E
    data = rows(8, n=240)
    df = spark.createDataFrame(data, ROWS).withColumn("fold", (F.col("id") / 80).cast("int")).repartition(3)
    got = {r.setting: r.mean for r in G.cross_validate_linear(df, [1., .01], G.log_loss, "id", fpr=.1).collect()}
    x, y = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    for lam in (1., .01):
        merits = []
        for k in range(3):
            held = np.arange(240) // 80 == k
            mean, sd = x[~held].mean(0), x[~held].std(0)
            xs, free = (x - mean) / sd, np.append(0., np.ones(5))
            w, _, _ = G.minimise(lambda v: G._penalised(G.log_loss(v, xs[~held], y[~held]), v, lam, free, 160.), np.zeros(6), tol=1e-4)
            p = 1 / (1 + np.exp(-np.c_[np.ones(80), xs[held]] @ w))
            s = spark.createDataFrame([(i, int(g), float(v)) for i, (g, v) in enumerate(zip(y[held], p))], "subject long, gold int, p double")
            merits.append(E.fom_mdr_at_fpr(s, .1).first().mdr)
        assert got[str(lam)] == pytest.approx(np.mean(merits), abs=1e-9)
    nets = G.cross_validate_mlp(df, hidden=(3,), lams=(1., 100.), max_iter=40).collect()
    assert [(r.hidden, r.lam) for r in nets] == [(3, 1.), (3, 100.)] and nets[0].mean > .8 >= nets[1].mean - .2


def test_forest_prefix(spark):
    from votelens.plans import learning as L
    df = L.as_features(spark.createDataFrame(rows(9, n=200), ROWS)).withColumn("fold", (F.col("id") % 2).cast("int"))
    model = L.random_forest(6, "2", 1, 5).fit(df)
    whole, few = L.forest_prefix(model, 6), L.forest_prefix(model, 2)
    assert len(few.trees) == 2 and [r.probability for r in whole.transform(df).collect()] == [r.probability for r in model.transform(df).collect()]
    trees = [[t.predictProbability(r.features) for t in model.trees[:2]] for r in df.collect()[:20]]
    got = few.transform(df).collect()[:20]
    assert all(np.allclose(r.probability.toArray(), (a.toArray() + b.toArray()) / 2) for r, (a, b) in zip(got, trees))
    table = L.cross_validate_forest(df.withColumn("vec_id", F.col("id")), (4, 2), (2,), (1, 5), depth=4).collect()
    assert sorted((r.trees, r.features, r.leaf) for r in table) == [(2, 2, 1), (2, 2, 5), (4, 2, 1), (4, 2, 5)] and all(0 <= r.mean <= 1 for r in table)


def test_forests_are_let_go_once_scored(spark):
    """Held-out scores are tables: a plan that still predicts would keep every forest at the driver."""
    from votelens.plans import learning as L
    df = L.as_features(spark.createDataFrame(rows(9, n=90), ROWS)).withColumn("fold", (F.col("id") % 2).cast("int"))
    merit = L.cross_validate_forest(df, (4, 2), (2,), (1,), depth=3)
    plan = merit._jdf.queryExecution().analyzed().toString()
    assert "UDF" not in plan and "predict" not in plan.lower() and merit.count() == 2


def test_forest_rows_are_dealt_out(spark, monkeypatch):
    """Many rows of one file are grown by several tasks; few stay as they lie. No task gets the forest so far."""
    df = L.as_features(spark.range(300).select(F.array(F.rand(1), F.rand(2)).alias("x"), (F.col("id") % 2).cast("int").alias("y")).coalesce(1))
    assert L.forest_rows(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(L, "FOREST_ROWS", 100)
    dealt = L.forest_rows(df)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.count() == 300
    assert L.random_forest().getCacheNodeIds()


def test_prefix_sums_are_held_in_parts(spark, monkeypatch):
    """No batch that a task sends holds the curvature of more than ``PREFIXES`` prefixes, and the fits stay the same."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    rows = [(k, [float(v) for v in r], int(r[0] + rng.normal() > 0)) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "position long, x array<double>, y int").repartition(3)
    sizes = list(range(30, 121, 10))
    whole = G.prefix_logistic(df, sizes, 1e-2)
    monkeypatch.setattr(G, "PREFIXES", 3)
    assert np.allclose(G.prefix_logistic(df, sizes, 1e-2), whole, atol=1e-9)


def test_mlp_reads_packed_rows(spark, monkeypatch):
    """Rows that many iterations read are bytes, dealt out where they are many."""
    df = spark.range(60).select(F.array(F.col("id") / 60, F.col("id") % 7 / 7).alias("x"), (F.col("id") % 2).cast("int").alias("y")).coalesce(1)
    one = G.packed(df)
    assert [f.dataType.typeName() for f in one.schema] == ["binary", "binary"] and one.count() == 1
    w = np.linspace(-1, 1, 3 * 4 + 1)
    plain, small = (G.MLP(hidden=3).loss(d, 60, 2)(w) for d in (df, one))
    assert np.isclose(plain[0], small[0]) and np.allclose(plain[1], small[1])
    monkeypatch.setattr(G, "TASK_ROWS", 20)
    net = G.MLP(hidden=3, lam=1.).fit(df)
    assert np.abs(net.loss(df, 60, 2)(net.w)[1]).max() < 1e-3


def test_counts_are_made_once(spark):
    """The models and their iterations read landed cells: the vote table is not scanned again for each."""
    from votelens.catalog import learning_q as Q
    from votelens.catalog.base import Inputs
    b = Q.landed_counts(Inputs(spark, "/root/testdata/sf0.001"))
    for df in (b, Q.glm_cells(b, "tp")):
        assert "lineitem" not in "".join(df.inputFiles()) and df.inputFiles()


def test_prefixes_between_curvatures(spark):
    """Most prefixes never have a curvature worked out, and arrive where their own Newton steps do."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4))
    df = spark.createDataFrame([(k, [float(v) for v in r], int(r[0] + rng.normal() > 0)) for k, r in enumerate(x)], "position long, x array<double>, y int").repartition(3)
    sizes = list(range(20, 901, 20))
    w = G.prefix_logistic(df, sizes, 1e-3)
    held, seen = G._prefix_steps, []

    try:
        G._prefix_steps = lambda rows, ends, *a: (seen.extend(ends), held(rows, ends, *a))[1]
        assert np.allclose(G.prefix_logistic(df, sizes, 1e-3), w, atol=1e-12) and len(seen) < 30
        old, G.ANCHORS = G.ANCHORS, 1.
        assert np.allclose(G.prefix_logistic(df, sizes, 1e-3), w, atol=1e-7)
        G.ANCHORS, chords, G.CHORDS = old, G.CHORDS, 1                 # none arrives: all are fitted by Newton steps
        assert np.allclose(G.prefix_logistic(df, sizes, 1e-3), w, atol=1e-7)
        G.CHORDS = chords
    finally:
        G._prefix_steps = held


@pytest.mark.parametrize("fpr", [.01, .2, 1.])
def test_learning_curve_keeps_scores_in_tasks(spark, fpr, monkeypatch):
    """The figure of every prefix is that of a table of all scores, with ties; no row per row and prefix is made."""
    from votelens.operators import evaluate as E
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(700, 3)), 0)                          # many equal rows
    y = (x[:, 0] + rng.normal(size=700) > 0).astype(int)
    y[:40] = 1                                                          # the first prefix has one class
    df = spark.createDataFrame([(k, [float(v) for v in r], int(c)) for k, (r, c) in enumerate(zip(x, y))], "vec_id long, x array<double>, y int").repartition(5)
    monkeypatch.setattr(G, "PREFIX_ROWS", 200)
    got = {(r.size, r.part): r.mdr for r in L.learning_curve(df, "vec_id", step=35, fpr=fpr).collect()}
    cut, sizes = 525, list(range(35, 526, 35))
    w = G.prefix_logistic(df.withColumnRenamed("vec_id", "position"), sizes, 1e-3)
    scores = []
    for s, v in zip(sizes, w):
        p = 1 / (1 + np.exp(-(v[0] + x @ v[1:]).round(9)))
        scores += [(s, "train" if k < cut else "holdout", k, int(y[k]), float(p[k])) for k in range(700) if k < s or k >= cut]
    plain = E.fom_mdr_at_fpr(spark.createDataFrame(scores, "size int, part string, subject int, gold int, p double"), fpr, runs=["size", "part"]).collect()
    assert len(plain) == 30 and got == {(r.size, r.part): pytest.approx(r.mdr, abs=1e-9) for r in plain}
