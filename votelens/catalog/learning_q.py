"""Queries: image-vector features and learning (M)."""
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import aggregates as A, evaluate as E, skill
from ..operators.prefix import union_all
from ..plans import learning as L
from ..session import land, scratch_path
from .base import query
from .relational import BIN_SQL, bin_counts

# x(vec_id, pos, v): the image values by 0-based position
_X = """, x AS (SELECT vec_id, label, pos - 1 AS pos, CAST(embedding[pos] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)),
 st AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd, max(abs(v)) AS mx FROM x GROUP BY 1)
"""


def long(df, column="x", keys=("vec_id",)):
    return df.select(*keys, F.posexplode(column).alias("pos", "v"))


@query("nan_to_num", _X + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, CASE WHEN v > .1 THEN 0 ELSE v END AS v FROM x", r="v")
def m1(i):
    holed = i.images.select("vec_id", F.transform("x", lambda v: F.when(v > .1, float("nan")).otherwise(v)).alias("x"))
    return long(holed.select("vec_id", V.nan_to_num(F.col("x")).alias("x")))


@query("sign_log_norm", _X + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, sign(v) * ln(1 + abs(v) / sd) AS v FROM x JOIN st USING (vec_id)", r="v")
def m2(i):
    return long(i.images.select("vec_id", V.sign_log_norm(F.col("x")).alias("x")))


@query("rescale_abs", _X + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, v / mx AS v FROM x JOIN st USING (vec_id)", r="v")
def m3(i):
    return long(i.images.select("vec_id", V.rescale_abs(F.col("x")).alias("x")))


@query("mean_subtract", _X + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, v - m AS v FROM x JOIN st USING (vec_id)", r="v")
def m4(i):
    return long(i.images.select("vec_id", V.mean_subtract(F.col("x")).alias("x")))


@query("feature_standardise", _X + """, c AS (SELECT vec_id, pos, (v - m) / max(abs(v - m)) OVER (PARTITION BY vec_id) AS w FROM x JOIN st USING (vec_id))
  SELECT vec_id, CAST(pos AS INTEGER) AS pos, w / stddev_pop(w) OVER (PARTITION BY vec_id) AS v FROM c""", r="v")
def m5(i):
    return long(i.images.select("vec_id", V.feature_standardise(F.col("x")).alias("x")))


@query("centre_crop", _X + """SELECT vec_id, CAST((pos // 8 - 2) * 4 + pos % 8 - 2 AS INTEGER) AS pos, v FROM x
  WHERE pos // 8 BETWEEN 2 AND 5 AND pos % 8 BETWEEN 2 AND 5""", r="v")
def m6(i):
    return long(i.images.select("vec_id", V.centre_crop(F.col("x"), 8, 2).alias("x")))


@query("background_subtract")
def m7(i):
    return long(V.background_subtract(i.images, "vec_id", "x", 8))


_FILES = ", fl AS (SELECT vec_id, label % 2 AS y, 'obj' || (vec_id // 3) AS grp, label FROM embeddings)"
_UNIT = "CAST('0x' || substr(md5('{s}:' || {c}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


@query("grouped_split", _FILES + f""", gs AS (SELECT y, grp, count(*) AS k, {_UNIT.format(s=0, c='grp')} AS h FROM fl GROUP BY 1, 2),
 rn AS (SELECT y, grp, sum(k) OVER (PARTITION BY y ORDER BY h, grp) - k AS before, sum(k) OVER (PARTITION BY y) AS m FROM gs)
 SELECT vec_id, y, CASE WHEN before <= floor(.75 * m) THEN 'train' ELSE 'test' END AS split FROM fl JOIN rn USING (y, grp)""")
def m8(i):
    rows = i.images.select("vec_id", "y", F.split_part("file", F.lit("_"), F.lit(1)).alias("grp"))
    return L.grouped_split(rows, "grp").select("vec_id", "y", "split")


@query("skew_limit", """SELECT vec_id, y FROM (SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY label = 0 ORDER BY vec_id) AS r,
  count(*) FILTER (WHERE label = 0) OVER () AS n FROM embeddings) WHERE y = 1 OR r <= 3 * n""")
def m9(i):
    return L.skew_limit(i.images.select("vec_id", (F.col("label") == 0).cast("int").alias("y")), "vec_id", 3)


@query("rotate_augment", _X + """SELECT vec_id, turn, CAST(CASE turn WHEN 0 THEN pos WHEN 1 THEN (pos % 8) * 8 + 7 - pos // 8 WHEN 2 THEN 63 - pos
  ELSE (7 - pos % 8) * 8 + pos // 8 END AS INTEGER) AS pos, v FROM x, (SELECT CAST(unnest(range(4)) AS INTEGER) AS turn)""", r="v")
def m10(i):
    return long(V.rotate_augment(i.images.select("vec_id", "x"), "x", 8), keys=("vec_id", "turn"))


_PATCH = _X + f""", co AS (SELECT vec_id, patch, CAST(floor({_UNIT.format(s='0r', c="(vec_id || '/' || patch)")} * 5) AS INTEGER) AS t,
  CAST(floor({_UNIT.format(s='0c', c="(vec_id || '/' || patch)")} * 5) AS INTEGER) AS l FROM embeddings, (SELECT CAST(unnest(range(2)) AS INTEGER) AS patch))
 SELECT vec_id, patch, t AS top, l AS left, CAST((pos // 8 - l) * 3 + pos % 8 - t AS INTEGER) AS pos, v FROM x JOIN co USING (vec_id)
 WHERE pos // 8 BETWEEN l AND l + 2 AND pos % 8 BETWEEN t AND t + 2"""


@query("random_patches", _PATCH.replace("l AS left,", 'l AS "left",'), r="v")
def m11(i):
    return long(V.random_patches(i.images.select("vec_id", "x"), "vec_id", "x", 8, 3, 2), keys=("vec_id", "patch", "top", "left"))


def filter_bank(i):
    """One 3 x 3 filter per label: the mean top-left patch of its images (a model of label-many rows)."""
    corner = [c * 8 + r for c in range(3) for r in range(3)]
    rows = (i.images.groupBy("label").agg(*[F.avg(F.col("x")[k]).alias(f"w{n}") for n, k in enumerate(corner)]).orderBy("label").collect())
    return [list(r)[1:] for r in rows]


_CONV = _X + """, fb AS (SELECT label AS f, pos // 8 AS c, pos % 8 AS r, avg(v) AS w FROM x WHERE pos // 8 < 3 AND pos % 8 < 3 GROUP BY ALL),
 fk AS (SELECT dense_rank() OVER (ORDER BY f) - 1 AS f, c, r, w FROM fb),
 cv AS (SELECT vec_id, f, oc, o_r, sqrt(pow(sum(v * w), 2) + 1e-8) AS v FROM x, fk, (SELECT unnest(range(6)) AS oc), (SELECT unnest(range(6)) AS o_r)
   WHERE pos // 8 = oc + c AND pos % 8 = o_r + r GROUP BY ALL)
"""


@query("convolve", _CONV + "SELECT vec_id, CAST(f AS INTEGER) AS filter, CAST(oc * 6 + o_r AS INTEGER) AS pos, v FROM cv", r="v")
def m12(i):
    return long(V.convolve(i.images, "vec_id", "x", 8, filter_bank(i), 3), "response", ("vec_id", "filter"))


@query("sum_pool", _CONV + "SELECT vec_id, CAST(f AS INTEGER) AS filter, CAST((oc // 2) * 3 + o_r // 2 AS INTEGER) AS pos, sum(v) AS v FROM cv GROUP BY ALL", r="v")
def m13(i):
    return long(V.convolve(i.images, "vec_id", "x", 8, filter_bank(i), 3, pool=2), "response", ("vec_id", "filter"))


_FIT = ", ft AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM x WHERE label < 7 GROUP BY 1)"


@query("standard_scale", _X + _FIT + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, (v - m) / sd AS v FROM x JOIN ft USING (pos)", r="v")
def m14(i):
    return long(L.standard_scale(i.images, i.images.where("label < 7")))


@query("minmax_scale", _X + _FIT + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, (v - lo) / (hi - lo) AS v FROM x JOIN ft USING (pos)", r="v")
def m15(i):
    return long(L.minmax_scale(i.images, i.images.where("label < 7")))


def training_rows(i):
    """Binary target from the label and whether the first component is positive, so a model can learn some of it."""
    return L.as_features(i.images.withColumn("y", F.when((F.col("x")[0] + F.col("x")[1] > 0), 1).otherwise(0)))


def _scored(model, df):
    return L.predict_proba(model, df).select(F.col("vec_id").alias("subject"), F.col("y").alias("gold"), "p")


def held_out(i, df):
    """(rows to fit, rows to score): a fifth is held out, by a hash of the id."""
    from ..functions.scalars import hash_unit
    test = hash_unit(F.col("vec_id"), 5) < .2
    return df.where(~test), df.where(test)


@query("rf_train")
def m16(i):
    fit, test = held_out(i, training_rows(i))
    return E.fom_grid(_scored(L.random_forest(50).fit(L.forest_rows(fit)), test))


@query("linear_svm_train")
def m17(i):
    fit, test = held_out(i, training_rows(i))
    return E.fom_grid(_scored(L.CalibratedSVM().fit(fit), test))


@query("svm_sgd_train")
def m17b(i):
    """The linear SVM's second form: modified-huber loss, stochastic gradient."""
    from ..plans import gradient as G
    fit, test = held_out(i, training_rows(i))
    model = G.HuberSVM(alpha=1e-3).fit(fit.select("vec_id", "x", "y"), F.col("vec_id"))
    return E.fom_grid(test.select(F.col("vec_id").alias("subject"), F.col("y").alias("gold"), model.probability(F.col("x")).alias("p")))


@query("softmax_train")
def m18(i):
    fit, test = held_out(i, L.as_features(i.images, y="label"))
    return L.softmax().fit(fit).transform(test).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("softmax_online")
def m19(i):
    """The image table as a stream that arrives in four random parts, one example per step; weights carried from batch to batch."""
    from ..functions.scalars import hash_unit
    folder, path, ckpt = (scratch_path(i.spark, n) for n in ("images", "weights", "ckpt"))
    model = L.OnlineSoftmax(i.spark, path, 10, 64, rate=.1).start()
    at = F.floor(hash_unit(F.col("vec_id"), 2) * 4)
    for k in range(4):
        i.images.where(at == k).select("x", F.col("label").alias("y")).write.mode("append").parquet(folder)
        stream = i.spark.readStream.schema("x array<double>, y int").parquet(folder)
        (stream.writeStream.foreachBatch(model.process).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start()).awaitTermination()
    out = model.predict(i.images)
    best = F.array_position("probs", F.array_max("probs")) - 1
    return out.groupBy("label", best.alias("prediction")).agg(F.count("*").alias("n"))


@query("mlp_train")
def m20(i):
    """A penalised one-hidden-layer network, trained until its gradient vanishes."""
    from ..plans import gradient as G
    fit, test = held_out(i, training_rows(i))
    model = G.MLP(hidden=8, lam=.1).fit(fit)
    return E.fom_grid(test.select(F.col("vec_id").alias("subject"), F.col("y").alias("gold"), model.probability(F.col("x"), 64).alias("p")))


# a model that SQL can express: the classes' mean vectors, fitted on the rows that are not held out
_MODEL = _X + f""", tr AS (SELECT vec_id, CASE WHEN CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) > 0 THEN 1 ELSE 0 END AS y, {_UNIT.format(s=5, c='vec_id')} < .2 AS held FROM embeddings),
 mw AS (SELECT pos, avg(v) FILTER (WHERE y = 1) AS m1, avg(v) FILTER (WHERE y = 0) AS m0 FROM x JOIN tr USING (vec_id) WHERE NOT held GROUP BY 1),
 pr AS (SELECT vec_id, y, 1 / (1 + exp(-5 * (sum((m1 - m0) * v) - (SELECT sum((m1 - m0) * (m1 + m0)) / 2 FROM mw)))) AS p FROM x JOIN tr USING (vec_id) JOIN mw USING (pos) WHERE held GROUP BY 1, 2)
"""


def applied(i):
    """A model table written, read back, and applied to rows it was not fitted on."""
    fit, test = held_out(i, training_rows(i))
    path = scratch_path(i.spark, "model")
    L.centroid_model(fit.select("x", "y")).write.parquet(path)
    return L.apply_linear(i.spark.read.parquet(path), test.select("vec_id", "x", "y"), scale=5.)


@query("predict_proba", _MODEL + "SELECT vec_id AS subject, y AS gold, p FROM pr", r="p")
def m21(i):
    return applied(i).select(F.col("vec_id").alias("subject"), F.col("y").alias("gold"), F.get("probability", F.lit(1)).alias("p"))


@query("fold_soft_pred", _MODEL + "SELECT vec_id, p FROM pr", r="p")
def c21(i):
    from pyspark.ml.functions import array_to_vector
    return applied(i).select("vec_id", L.fold_soft_pred(array_to_vector("probability")).alias("p"))


def folded(i):
    return L.contiguous_folds(training_rows(i).select("vec_id", "features", "label"), "vec_id")


@query("contiguous_folds", "SELECT vec_id, CAST((row_number() OVER (ORDER BY vec_id) - 1) * 5 // count(*) OVER () AS INTEGER) AS fold FROM embeddings")
def folds(i):
    return folded(i).select("vec_id", "fold")


# The reference's grids.
SOFTMAX_GRID = [.1, .03, .01, .003, .001, 3e-4, 1e-4, 3e-5, 1e-5]
SVM_GRID = [10., 3., 1., .3, .1, .03, .01, .003, .001]


@query("cv_rf")
def m22(i):
    """Twelve settings: 10 and 100 trees, 10 and 25 features per split, leaves of 1, 2 and 5 rows."""
    return L.cross_validate_forest(folded(i))


def xy_folds(i):
    return L.contiguous_folds(training_rows(i).select("vec_id", "x", "y"), "vec_id")


@query("cv_softmax")
def m23(i):
    from ..plans import gradient as G
    return L.best_setting(G.cross_validate_linear(xy_folds(i), SOFTMAX_GRID, G.log_loss, "vec_id"))


@query("cv_svm")
def m24(i):
    """Linear SVM settings, ranked by the margin through the same figure of merit."""
    from ..plans import gradient as G
    return L.best_setting(G.cross_validate_linear(xy_folds(i), SVM_GRID, G.hinge_loss, "vec_id"))


@query("cv_nn")
def m25(i):
    """Networks of 10 and 20 units, seven penalties, five folds; the larger sizes are parameters."""
    from ..plans import gradient as G
    return G.cross_validate_mlp(xy_folds(i))


@query("learning_curve")
def m26(i):
    return L.learning_curve(training_rows(i).select("vec_id", "x", "y"), "vec_id")


@query("feature_importance")
def m27(i):
    return L.forest_importance(training_rows(i))


@query("unit_pixels", _X + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, v / 255 AS v FROM x", r="v")
def m28b(i):
    return long(i.images.select("vec_id", L.unit_pixels(F.col("x")).alias("x")))


@query("random_split", f"SELECT vec_id, label, CASE WHEN {_UNIT.format(s=0, c='vec_id')} < .93 THEN 'train' ELSE 'test' END AS split, 1.0::DOUBLE AS hot FROM embeddings", r="hot")
def m28(i):
    """Random split with one-hot labels (the value at the label's own position is shown)."""
    hot = L.one_hot(L.random_split(i.images.select("vec_id", "label"), "vec_id"), "label", 10)
    return hot.select("vec_id", "label", "split", F.get("one_hot", F.col("label")).alias("hot"))


@query("scale_pm1", _X + "SELECT vec_id, CAST(pos AS INTEGER) AS pos, (v / 255 - .5) * 2 AS v FROM x", r="v")
def m29(i):
    return long(i.images.select("vec_id", V.scale_pm1(F.col("x")).alias("x")))


# The two responses (successes, trials) and the user types the analysis keeps.
RESPONSES = {"tp": ("tp", "pos"), "tn": ("tn", "n - pos")}
KEPT = ("1) mega", "2) power", "3) frequent")


def landed_counts(i):
    """The counts per voter and bin, made once: every model and every iteration reads them again."""
    return land(bin_counts(i), "bin-counts")


def glm_cells(b, response):
    from ..plans import binomial as G
    kept = skill.bin_user_types(b, 4).where(F.col("user_type").isin(*KEPT)).select("voter")
    good, total = RESPONSES[response]
    return land(G.cells(b.join(kept, "voter", "left_semi"), F.expr(good), F.expr(total)), "glm-cells")


def _glm_sql():
    """Deviance, degrees of freedom and AIC of the models that are rates of groups, for both responses."""
    xl = "CASE WHEN {k} > 0 THEN {k} * ln({k} / {m}) ELSE 0 END"
    cell = xl.format(k="k", m="m") + " + " + xl.format(k="(m - k)", m="m")
    out = BIN_SQL + """, vt AS (SELECT voter, min(n) AS least, count(*) AS bins FROM bc GROUP BY 1),
 kept AS (SELECT voter FROM vt WHERE bins = 4 AND least >= 30)"""
    parts = []
    for r, (good, total) in RESPONSES.items():
        out += f", cl_{r} AS (SELECT voter, bin, CAST({good} AS DOUBLE) AS k, CAST({total} AS DOUBLE) AS m FROM bc SEMI JOIN kept USING (voter) WHERE {total} > 0)"
        out += f", sa_{r} AS (SELECT count(*) AS n, 2 * sum(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + {cell}) AS ll2 FROM cl_{r})"
        for name, by in (("null", "1"), ("bin", "bin"), ("user", "voter"), ("bin*user", "voter, bin")):
            group = f"GROUP BY {by}" if name != "null" else ""
            parts.append(f"SELECT '{r}' AS response, '{name}' AS model, greatest(deviance, 0) AS deviance, n - terms AS df, greatest(deviance, 0) - ll2 + 2 * terms AS aic FROM ("
                         f"SELECT 2 * sum(own - ({cell})) AS deviance, count(*) AS terms FROM (SELECT sum(k) AS k, sum(m) AS m, sum({cell}) AS own FROM cl_{r} {group})), sa_{r}")
    return out + " " + " UNION ALL ".join(parts)


@query("glm_binomial", _glm_sql(), r="deviance aic")
def m30(i):
    """Both responses, the models that are rates of groups."""
    from ..plans import binomial as G
    b = landed_counts(i)
    return union_all([G.closed_models(glm_cells(b, r)).withColumn("response", F.lit(r)) for r in RESPONSES])


@query("glm_tests")
def m30b(i):
    """With bin + user: deviance drops of terms added in turn, and the deletion of the interaction, with chi-square p-values."""
    from ..plans import binomial as G
    b = landed_counts(i)
    return union_all([G.tests(G.models(glm_cells(b, r))).withColumn("response", F.lit(r)) for r in RESPONSES])


@query("kmeans_users")
def m31(i):
    from ..functions.scalars import MAG_EDGES
    dev = skill.skill_deviation(landed_counts(i), 4)
    wide = A.pivot_fill(dev, "voter", "bin", list(MAG_EDGES), "p_tp_rel").toDF("voter", "b18", "b19", "b20", "b23")
    return L.kmeans_users(wide, ["b18", "b19", "b20", "b23"])
