"""Data-set preparation and classifiers on image vectors with Spark ML.

Rows carry ``file`` (or another id), ``x array<double>`` and ``y int``.
"""
from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target, keyword_only
from pyspark.ml import Pipeline
from pyspark.ml.classification import (LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasLabelCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import fold_soft_pred, hash_unit
from ..operators import evaluate
from ..operators.prefix import range_blocks, running, union_all, unit_blocks
from ..session import land
from . import forest, gradient

# ---- splits ----------------------------------------------------------------------------------


def grouped_split(df: DataFrame, group: str, label: str = "y", fraction: float = .75, seed=0) -> DataFrame:
    """Train / test by group and class: groups in random order, the boundary moved so that no group is cut.

    The group that covers row floor(fraction * m) of its class is the last training group.
    """
    sizes = df.groupBy(label, group).agg(F.count("*").alias("_k")).withColumn("_h", hash_unit(F.col(group), seed))
    ran = running(unit_blocks(sizes, "_h"), [label], ["_h", group], sums={"_le": "_k"}, totals=True)
    side = F.when(F.col("_le") - F.col("_k") <= F.floor(fraction * F.col("total__le")), "train").otherwise("test")
    return df.join(ran.select(label, group, side.alias("split")), [label, group])


def skew_limit(df: DataFrame, id_: str, skew: int, label: str = "y") -> DataFrame:
    """All positives, and the first skew x positives negatives in list order."""
    pos = df.where(F.col(label) == 1)
    neg = range_blocks(df.where(F.col(label) == 0).select(id_, F.lit("all").alias("_r"), F.lit(1).alias("_one")), ["_r"], id_)
    ranked = running(neg, ["_r"], [id_], sums={"_n": "_one"})
    most = pos.agg((F.count("*") * skew).alias("_most")).withColumn("_r", F.lit("all"))
    keep = ranked.join(F.broadcast(most), "_r").where(F.col("_n") <= F.col("_most")).select(id_)
    return pos.unionByName(df.where(F.col(label) == 0).join(keep, id_, "left_semi"))


def with_position(df: DataFrame, id_: str) -> DataFrame:
    """0-based position of each row in id order, and the number of rows."""
    blocks = range_blocks(df.select(id_, F.lit("all").alias("_r"), F.lit(1).alias("_one")), ["_r"], id_)
    ran = running(blocks, ["_r"], [id_], sums={"_n": "_one"}, totals=True)
    return df.join(ran.select(id_, (F.col("_n") - 1).alias("position"), F.col("total__n").alias("rows")), id_)


def random_split(df: DataFrame, id_: str, train: float = .93, seed=0) -> DataFrame:
    return df.withColumn("split", F.when(hash_unit(F.col(id_), seed) < train, "train").otherwise("test"))


def unit_pixels(x):
    """Byte values as numbers from 0 to 1."""
    return F.transform(x, lambda v: v / 255)


def contiguous_folds(df: DataFrame, id_: str, k: int = 5) -> DataFrame:
    pos = with_position(df, id_)
    return pos.withColumn("fold", F.floor(F.col("position") * k / F.col("rows")).cast("int")).drop("position", "rows")


def one_hot(df: DataFrame, label: str, classes: int) -> DataFrame:
    """One-hot label vector next to the row (all classes kept)."""
    enc = OneHotEncoder(inputCol=label, outputCol="_oh", dropLast=False, handleInvalid="error")
    enc_model = enc.fit(df.withColumn(label, F.col(label).cast("double")).select(label))
    out = enc_model.transform(df.withColumn(label, F.col(label).cast("double")))
    return out.withColumn("one_hot", vector_to_array("_oh")).drop("_oh").withColumn(label, F.col(label).cast("int"))


# ---- scaling ---------------------------------------------------------------------------------

def _column_stats(train: DataFrame, x: str) -> DataFrame:
    """One row of per-position statistics; its length is the vector length."""
    per = train.select(F.posexplode(x).alias("pos", "v")).groupBy("pos").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    packed = per.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "sd", "lo", "hi"))).alias("_s"))
    return packed.withColumn("_k", F.lit(1))


def _scaled(df: DataFrame, train: DataFrame, x: str, rule) -> DataFrame:
    stats = F.broadcast(_column_stats(train, x))
    return (df.withColumn("_k", F.lit(1)).join(stats, "_k")
            .withColumn(x, F.zip_with(x, "_s", rule)).drop("_k", "_s"))


def standard_scale(df: DataFrame, train: DataFrame, x: str = "x") -> DataFrame:
    """(v - mean) / population sd of the training rows; constant positions are only centred."""
    return _scaled(df, train, x, lambda v, s: (v - s["mean"]) / F.when(s["sd"] == 0, 1.0).otherwise(s["sd"]))


def minmax_scale(df: DataFrame, train: DataFrame, x: str = "x") -> DataFrame:
    """(v - min) / (max - min) of the training rows; constant positions become v - min."""
    return _scaled(df, train, x, lambda v, s: (v - s["lo"]) / F.when(s["hi"] == s["lo"], 1.0).otherwise(s["hi"] - s["lo"]))


# ---- training --------------------------------------------------------------------------------

def as_features(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("features", array_to_vector(x)).withColumn("label", F.col(y).cast("double"))


def random_forest(trees: int = 100, per_split: str = "sqrt", min_leaf: int = 1, depth: int = 30, seed: int = 0):
    return RandomForestClassifier(numTrees=trees, featureSubsetStrategy=per_split, minInstancesPerNode=min_leaf,
                                  maxDepth=depth, seed=seed, cacheNodeIds=True)    # without: every task of every pass gets the forest so far


#: Rows that a task of a forest should hold, and the most tasks of one: each sends the counts of every open node, so more of them only send more.
FOREST_ROWS, FOREST_TASKS = 4096, 24


def forest_rows(df: DataFrame) -> DataFrame:
    """The training rows dealt out evenly: a packed table is one task, which would grow the whole forest. Small ones stay as they lie."""
    tasks = min(FOREST_TASKS, -(-df.count() // FOREST_ROWS))
    return df.select("features", "label").repartition(tasks) if tasks > 1 else df


def softmax(lam: float = 1e-3, max_iter: int = 100):
    return LogisticRegression(family="multinomial", regParam=lam, elasticNetParam=0.0, maxIter=max_iter)


def mlp(layers: list[int], max_iter: int = 100, seed: int = 0):
    return MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed)


class CalibratedSVM:
    """Linear SVM whose margin is turned into a probability by a one-variable logistic fit."""

    def __init__(self, reg: float = 1e-3, max_iter: int = 50):
        self.reg, self.max_iter = reg, max_iter

    def fit(self, df: DataFrame) -> "CalibratedSVM":
        self.svm = LinearSVC(regParam=self.reg, maxIter=self.max_iter).fit(df)
        margins = self._margin(df)
        self.logit = LogisticRegression(featuresCol="margin", maxIter=50).fit(margins.select("margin", "label"))
        return self

    def _margin(self, df: DataFrame) -> DataFrame:
        out = self.svm.transform(df)
        return out.withColumn("margin", array_to_vector(F.array(F.get(vector_to_array("rawPrediction"), F.lit(1))))) \
            .drop("rawPrediction", "prediction")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.logit.transform(self._margin(df)).drop("margin")


def predict_proba(model, df: DataFrame) -> DataFrame:
    """P(class 1) as ``p``."""
    return model.transform(df).withColumn("p", fold_soft_pred(F.col("probability")))


def centroid_model(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """A linear model table (pos, w): half way between the two classes' mean vectors; position -1 holds the constant."""
    per = df.select(y, F.posexplode(x).alias("pos", "v")).groupBy("pos").agg(
        F.avg(F.when(F.col(y) == 1, F.col("v"))).alias("m1"), F.avg(F.when(F.col(y) == 0, F.col("v"))).alias("m0"))
    const = per.agg((-F.sum((F.col("m1") - F.col("m0")) * (F.col("m1") + F.col("m0"))) / 2).alias("w")).select(F.lit(-1).alias("pos"), "w")
    return per.select("pos", (F.col("m1") - F.col("m0")).alias("w")).unionByName(const)


def apply_linear(model: DataFrame, df: DataFrame, x: str = "x", scale: float = 1.) -> DataFrame:
    """``probability`` (of class 0 and 1) of a stored linear model (pos, w): one row of weights, whose length is the vector's."""
    packed = model.agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("_w")).select(F.transform("_w", lambda r: r["w"]).alias("_w"), F.lit(1).alias("_k"))
    z = F.aggregate(F.zip_with(x, F.slice("_w", 2, F.size("_w")), lambda a, b: a * b), F.get("_w", F.lit(0)), lambda a, b: a + b)
    p = 1 / (1 + F.exp(-scale * z))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(packed), "_k").withColumn("probability", F.array(1 - p, p)).drop("_k", "_w")


class FomEvaluator(Evaluator, HasLabelCol):
    """Missed-detection rate at a false-positive rate; smaller is better."""

    @keyword_only
    def __init__(self, labelCol="label", fpr=.01):
        super().__init__()
        self._set(labelCol=labelCol)
        self.fpr = fpr

    def _evaluate(self, dataset: DataFrame) -> float:
        scores = dataset.select(F.lit(0).alias("subject"), F.col(self.getLabelCol()).cast("int").alias("gold"),
                                fold_soft_pred(F.col("probability")).alias("p"))
        return float(evaluate.fom_mdr_at_fpr(scores, self.fpr).first()["mdr"])

    def isLargerBetter(self) -> bool:
        return False


class F1Evaluator(FomEvaluator):
    """F1 of class 1 at .5; larger is better."""

    def _evaluate(self, dataset: DataFrame) -> float:
        yes, real = fold_soft_pred(F.col("probability")) > .5, F.col(self.getLabelCol()) == 1
        row = dataset.agg(F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"),
                          F.count_if(~yes & real).alias("fn")).first()
        return 2 * row.tp / (2 * row.tp + row.fp + row.fn) if row.tp else 0.0

    def isLargerBetter(self) -> bool:
        return True


class MarginFomEvaluator(FomEvaluator):
    """The same figure from an SVM's margin; only the order of the scores matters, so the margin is
    squeezed into (0, 1)."""

    def _evaluate(self, dataset: DataFrame) -> float:
        margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
        scores = dataset.select(F.lit(0).alias("subject"), F.col(self.getLabelCol()).cast("int").alias("gold"),
                                (1 / (1 + F.exp(-margin))).alias("p"))
        return float(evaluate.fom_mdr_at_fpr(scores, self.fpr).first()["mdr"])


def cross_validate(df: DataFrame, estimator, grid: dict, evaluator, folds: int = 5, parallelism: int = 4) -> DataFrame:
    """Mean figure per grid setting over contiguous folds (column ``fold``), one row per setting."""
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(estimator.getParam(name), values)
    maps = build.build()
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds,
                        foldCol="fold", parallelism=parallelism)
    means = cv.fit(df).avgMetrics
    rows = [(str({p.name: v for p, v in m.items()}), float(f)) for m, f in zip(maps, means)]
    return df.sparkSession.createDataFrame(rows, "setting string, mean double")


def forest_prefix(model, trees: int):
    """The forest of the first ``trees`` trees of a fitted one."""
    jvm = model._java_obj
    cls = jvm.getClass()
    few = SparkContext._gateway.new_array(SparkContext._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, trees)
    for k, tree in enumerate(jvm.trees()[:trees]):
        few[k] = tree
    new = SparkContext._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(f"{model.uid}_{trees}", few, model.numFeatures, model.numClasses)
    assert new.getClass() == cls
    out = RandomForestClassificationModel(new)
    out._transfer_params_from_java()
    return out


def cross_validate_forest(df: DataFrame, trees=(100, 10), features=(10, 25), leaves=(1, 2, 5), depth: int = 30, seed: int = 0, fpr: float = .01,
                          parallelism: int = 4) -> DataFrame:
    """(trees, features, leaf, mean) over contiguous folds (column ``fold``): mean figure of merit per setting.

    One forest of the most trees is grown per fold, feature count and leaf size; forests of fewer trees are its first ones. Its held-out scores are written as soon as it
    is grown, so the driver holds ``parallelism`` forests and not all of them. All held-out scores are compared in one job.

    Above ``FOREST_ROWS`` rows the trees are grown in tasks (``forest``), where those that differ in the leaf size alone share what they have in common.
    """
    keys = ["trees", "features", "leaf"]
    if df.count() > FOREST_ROWS:
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), "fold")
        scores = forest.held_out_scores(rows, trees, features, leaves, depth, seed).withColumn("subject", F.lit(0))
        return evaluate.fom_mdr_at_fpr(scores, fpr, runs=[*keys, "fold"]).groupBy(*keys).agg(F.avg("mdr").alias("mean"))
    folds = sorted(r.fold for r in df.select("fold").distinct().collect())
    jobs = [(f, leaf, k) for f in features for leaf in leaves for k in folds]

    def grow(job):
        f, leaf, k = job
        model = random_forest(max(trees), str(f), leaf, depth, seed).fit(df.where(F.col("fold") != k))
        held = df.where(F.col("fold") == k)
        return land(union_all([predict_proba(forest_prefix(model, n) if n < max(trees) else model, held).select(
            F.lit(n).alias("trees"), F.lit(f).alias("features"), F.lit(leaf).alias("leaf"), "fold", F.lit(0).alias("subject"),
            F.col("label").cast("int").alias("gold"), "p") for n in trees]), "forest")

    with ThreadPool(parallelism) as pool:
        scored = pool.map(inheritable_thread_target(df.sparkSession)(grow), jobs)
    merit = evaluate.fom_mdr_at_fpr(union_all(scored), fpr, runs=[*keys, "fold"])
    return merit.groupBy(*keys).agg(F.avg("mdr").alias("mean"))


def best_setting(results: DataFrame, smallest: bool = True) -> DataFrame:
    return results.agg((F.min_by if smallest else F.max_by)("setting", "mean").alias("setting"),
                       (F.min if smallest else F.max)("mean").alias("mean"))


def learning_curve(df: DataFrame, id_: str, step: int = 100, fraction: float = .75, fpr: float = .01, lam: float = 1e-3) -> DataFrame:
    """Figure of merit on the training prefix and on the hold-out rows, for prefixes that grow by ``step`` rows.

    Rows carry ``x`` and ``y``. All prefixes are fitted in the same passes (``gradient.prefix_logistic``) and scored in the same passes: the number of jobs
    does not depend on the number of rows. Scores (rows x prefixes) never leave a task; what does are the counts on either side of the figure's threshold.
    """
    pos = land(with_position(df, id_), "prefix-rows")            # every pass reads them again
    n = pos.select("rows").first()["rows"]
    if n > gradient.PREFIX_ROWS:
        pos = pos.repartition(-(-n // gradient.PREFIX_ROWS))      # the landed files are packed into few tasks
    cut = int(n * fraction)
    sizes = sorted({*range(step, cut + 1, step), cut})
    train = pos.where(F.col("position") < cut)
    w = gradient.prefix_logistic(train.select("x", "y", "position"), sizes, lam)
    points = gradient.prefix_points(pos.select("x", "y", "position"), sizes, w, cut, fpr)
    return evaluate.fom_mdr_at_fpr(points, fpr, runs=["size", "part"]).select("size", "part", "mdr")


def feature_importance(model, spark) -> DataFrame:
    """Importance of each feature and its deviation over the trees."""
    rows = [(t, i, float(v)) for t, tree in enumerate(model.trees) for i, v in enumerate(tree.featureImportances.toArray())]
    per_tree = spark.createDataFrame(rows, "tree int, feature int, importance double")
    total = spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())],
                                  "feature int, importance double")
    return total.join(per_tree.groupBy("feature").agg(F.stddev_pop("importance").alias("sd")), "feature") \
        .orderBy(F.desc("importance"), "feature")


def forest_importance(df: DataFrame) -> DataFrame:
    """``feature_importance`` of a forest on ``x`` and ``y``. Above ``FOREST_ROWS`` rows the trees are grown in tasks (``forest``) and never come to the driver."""
    if df.count() <= FOREST_ROWS:
        return feature_importance(random_forest().fit(forest_rows(df)), df.sparkSession)
    per_tree = land(forest.importances(df.select("x", "y")), "importances")
    per = per_tree.groupBy("feature").agg(F.avg("importance").alias("importance"), F.stddev_pop("importance").alias("sd"))
    total = F.broadcast(per.agg(F.sum("importance").alias("_all")))
    return per.crossJoin(total).select("feature", F.try_divide("importance", "_all").alias("importance"), "sd").orderBy(F.desc("importance"), "feature")


# ---- one-pass online softmax -----------------------------------------------------------------

def softmax_step(batch: DataFrame, weights: dict, classes: int, rate: float, lam: float) -> dict:
    """One mini-batch gradient step. The gradient is summed in Spark; only the weights (classes x (d + 1)
    numbers) come back. Rows are summed per task by a batch function before the shuffle."""
    import numpy as np
    import pandas as pd
    w = np.array(weights["w"])

    def partial(batches):
        total, n = np.zeros_like(w), 0
        for b in batches:
            if not len(b):
                continue
            x = np.c_[np.ones(len(b)), np.stack(b["x"].to_numpy())]
            z = x @ w.T
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), b["y"].to_numpy()] -= 1
            total += p.T @ x
            n += len(b)
        yield pd.DataFrame({"i": np.arange(w.size), "g": total.ravel(), "n": n})

    got = batch.select("x", "y").mapInPandas(partial, "i int, g double, n long").groupBy("i").agg(
        F.sum("g").alias("g"), F.sum("n").alias("n")).collect()
    if not got or got[0]["n"] == 0:
        return weights
    grad = np.zeros(w.size)
    for r in got:
        grad[r["i"]] = r["g"] / r["n"]
    return {"w": (w - rate * (grad.reshape(w.shape) + lam * w)).tolist(), "steps": weights["steps"] + 1}


class OnlineSoftmax:
    """Carries weights across micro-batches; continues from stored weights. State of batch k is written
    under k, so a repeated batch starts from the weights before it."""

    def __init__(self, spark, path: str, classes: int, dim: int, rate: float = .1, lam: float = 1e-4, batch: int = 1):
        """``batch``: examples per step; each partition goes through its own, one step after the other."""
        self.spark, self.path, self.classes, self.dim, self.rate, self.lam, self.batch = spark, path, classes, dim, rate, lam, batch

    def _write(self, state: dict, batch: int) -> None:
        self.spark.createDataFrame([(state["w"], state["steps"])], "w array<array<double>>, steps int").write.mode(
            "overwrite").parquet(f"{self.path}/batch={batch}")

    def start(self, weights=None) -> "OnlineSoftmax":
        self._write({"w": weights or [[0.0] * (self.dim + 1) for _ in range(self.classes)], "steps": 0}, -1)
        return self

    def weights(self, below: int | None = None) -> DataFrame:
        df = self.spark.read.schema("w array<array<double>>, steps int, batch long").parquet(self.path)
        df = df if below is None else df.where(F.col("batch") < below)
        return df.orderBy(F.desc("batch")).limit(1)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        import numpy as np
        r = self.weights(batch_id).first()
        w = gradient.softmax_pass(batch.select("x", "y"), np.array(r["w"]), self.rate, self.lam, self.batch, F.xxhash64("x"))
        self._write({"w": w.tolist(), "steps": r["steps"] + 1}, batch_id)

    def predict(self, df: DataFrame) -> DataFrame:
        """Class probabilities from the latest weights."""
        w = F.broadcast(self.weights().select("w", F.lit(1).alias("_k")))
        dot = lambda row: F.aggregate(F.zip_with(F.concat(F.array(F.lit(1.0)), "x"), row, lambda a, b: a * b),
                                      F.lit(0.0), lambda a, v: a + v)
        # the largest margin is taken off first: no overflow, however sure the model is
        probs = df.withColumn("_k", F.lit(1)).join(w, "_k").withColumn("_z", F.transform("w", dot)).drop("_k", "w")
        top = F.array_max("_z")
        probs = probs.withColumn("_z", F.transform("_z", lambda v: F.exp(v - top)))
        return probs.withColumn("probs", F.transform("_z", lambda v: v / F.aggregate("_z", F.lit(0.0), lambda a, b: a + b))).drop("_z")


# ---- user models -----------------------------------------------------------------------------

def kmeans_users(wide: DataFrame, columns: list[str], k: int = 3, seed: int = 0) -> DataFrame:
    """Cluster of each voter on its row of the user x bin matrix."""
    vec = VectorAssembler(inputCols=columns, outputCol="features")
    km = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")
    return Pipeline(stages=[vec, km]).fit(wide).transform(wide).drop("features")
