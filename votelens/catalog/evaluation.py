"""Queries: evaluation (E) and joins (J)."""
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import consensus as C, evaluate as E, joins as J, quantiles as Q, relational as R
from .base import query
from .relational import _LABELS, labelled_meta
from .scoring import _TRAIN, _PURITY_ROWS, _train, gold_rows

_NONE, _BOGUS, _REAL = (f"count(*) FILTER (WHERE p >= .1 AND gold = {g})" for g in (-1, 0, 1))


@query("counts_at", f"SELECT {_NONE} AS n_none, {_BOGUS} AS n_bogus, {_REAL} AS n_real FROM lscores")
def e1(i):
    return E.class_counts_at(i.lscores, .1)


@query("composition_at", f"""SELECT {_NONE} / ({_BOGUS} + {_REAL})::DOUBLE AS share_none, {_BOGUS} / ({_BOGUS} + {_REAL})::DOUBLE AS share_bogus,
  {_REAL} / ({_BOGUS} + {_REAL})::DOUBLE AS share_real FROM lscores""", r="share_none share_bogus share_real")
def e2(i):
    return E.composition_at(i.lscores, .1)


@query("purity_at", f"SELECT {_REAL} / ({_BOGUS} + {_REAL})::DOUBLE AS purity FROM lscores", r="purity")
def e3(i):
    return E.purity_at(i.lscores, .1)


@query("completeness_at", """SELECT count(*) FILTER (WHERE gold = 1 AND p > .1) / (count(*) FILTER (WHERE gold = 1))::DOUBLE AS completeness
  FROM lscores""", r="completeness")
def e4(i):
    return E.completeness_at(i.lscores, .1)


@query("completeness_at_purity", _PURITY_ROWS.format(q=.51) + """SELECT threshold, count(*) FILTER (WHERE gold = 1 AND p > threshold)
  / (count(*) FILTER (WHERE gold = 1))::DOUBLE AS completeness FROM lscores, t GROUP BY 1""", r="threshold completeness")
def e5(i):
    return E.completeness_at_purity(i.lscores, .51)


@query("roc_pairs", "SELECT subject, gold, p FROM lscores WHERE gold IN (0, 1)", r="p")
def e6(i):
    return E.roc_pairs(i.lscores)


@query("roc_curve", "SELECT threshold, fp, tp, fpr, tpr FROM lroc", r="threshold fpr tpr")
def e7(i):
    return E.roc_curve(i.lscores)


@query("auc", """SELECT sum((fpr - pf) * (tpr + pt) / 2) AS auc FROM (SELECT fpr, tpr, coalesce(lag(fpr) OVER o, 0) AS pf,
  coalesce(lag(tpr) OVER o, 0) AS pt FROM lroc WINDOW o AS (ORDER BY threshold DESC))""", r="auc")
def e8(i):
    return E.auc(i.lscores)


@query("pr_curve", "SELECT threshold, tp / (tp + fp)::DOUBLE AS precision, tpr AS recall FROM lroc", r="threshold precision recall")
def e9(i):
    return E.pr_curve(i.lscores)


_HIST = """, hg AS (SELECT * FROM lscores {w}), sp AS (SELECT min(p) AS lo, max(p) AS hi, count(*) AS total FROM hg),
 hb AS (SELECT gold, lo, hi, total, CAST(least(floor((p - lo) * {b} / (hi - lo)), {b} - 1) AS INTEGER) AS bin FROM hg, sp)
"""


@query("class_hist", _HIST.format(b=25, w="WHERE gold IN (0, 1)") + """SELECT bin, count(*) FILTER (WHERE gold = 0) AS bogus,
  count(*) FILTER (WHERE gold = 1) AS real FROM hb GROUP BY 1""")
def e10(i):
    return E.class_hist(i.lscores)


@query("class_hist_density", _HIST.format(b=50, w="") + """SELECT bin, count(*) AS n, count(*) / any_value(total)::DOUBLE / ((any_value(hi) - any_value(lo)) / 50) AS density
  FROM hb GROUP BY 1""", r="density")
def e10b(i):
    return E.class_hist_density(i.lscores)


_KDE = """, ks AS (SELECT count(*) AS n, 1.06 * stddev_samp(p) * pow(count(*), -.2) AS bw FROM lscores WHERE p < .9),
 kd AS (SELECT g.i AS i, g.i / 49.0::DOUBLE AS x, ln(sum(exp(e0 - e))) - any_value(e0) - ln(any_value(n) * any_value(bw) * sqrt(2 * pi())) AS log_density
   FROM (SELECT *, min(e) OVER (PARTITION BY i) AS e0 FROM (SELECT g.i, pow((g.i / 49.0::DOUBLE - p) / bw, 2) / 2 AS e, n, bw
   FROM (SELECT unnest(range(50)) AS i) g, (SELECT p FROM lscores WHERE p < .9), ks)) g GROUP BY 1, 2)
 SELECT CAST(i AS INTEGER) AS i, x, log_density, CASE WHEN log_density < lag(log_density) OVER w AND log_density < lead(log_density) OVER w THEN 'min'
   WHEN log_density > lag(log_density) OVER w AND log_density > lead(log_density) OVER w THEN 'max' END AS extremum FROM kd WINDOW w AS (ORDER BY i)"""


@query("kde", _KDE, r="x log_density")
def e11(i):
    """The density of the scores themselves, below the cutoff."""
    return E.kde(i.lscores, cutoff=.9)


@query("hypothesis_hist", """SELECT CAST(least(floor(round(p / .04, 9)), 24) AS INTEGER) AS bin, count(*) FILTER (WHERE gold = 1) AS real,
  count(*) FILTER (WHERE gold = 0) AS bogus, count(*) FILTER (WHERE gold = 1) <= count(*) FILTER (WHERE gold = 0) AS overlap
  FROM lscores WHERE gold IN (0, 1) GROUP BY 1""")
def e12(i):
    return E.hypothesis_hist(i.lscores)


_FPR = "coalesce(1 - (SELECT tpr FROM lroc WHERE fpr <= {f} ORDER BY threshold LIMIT 1), 1)"
_MDR = "(SELECT fpr FROM lroc WHERE 1 - tpr <= {f} ORDER BY threshold DESC LIMIT 1)"


@query("fom_mdr_at_fpr", f"SELECT {_FPR.format(f=.01)} AS mdr, (SELECT min(threshold) FROM lroc WHERE fpr <= .01) AS threshold", r="mdr threshold")
def e13(i):
    return E.fom_mdr_at_fpr(i.lscores)


@query("fom_fpr_at_mdr", f"SELECT {_MDR.format(f=.01)} AS fpr, (SELECT max(threshold) FROM lroc WHERE 1 - tpr <= .01) AS threshold", r="fpr threshold")
def e14(i):
    return E.fom_fpr_at_mdr(i.lscores)


@query("fom_grid", " UNION ALL ".join(f"SELECT {f}::DOUBLE AS level, {_FPR.format(f=f)} AS mdr_at_fpr, {_MDR.format(f=f)} AS fpr_at_mdr" for f in (.01, .05, .1)),
       r="level mdr_at_fpr fpr_at_mdr")
def e15(i):
    return E.fom_grid(i.lscores)


@query("rates_at_nearest", "SELECT threshold, fpr, 1 - tpr AS mdr FROM lroc ORDER BY abs(threshold - .5), threshold DESC LIMIT 1", r="threshold fpr mdr")
def e16(i):
    return E.rates_at_nearest(i.lscores)


@query("fdr_threshold", """, fb AS (SELECT gold, least(floor(round(p * 1000, 9)), 999) AS b FROM lscores WHERE gold IN (0, 1)),
 pv AS (SELECT gold, (SELECT count(*) FROM fb z WHERE z.gold = 0 AND z.b >= fb.b) / (SELECT count(*) FROM fb WHERE gold = 0)::DOUBLE AS pv FROM fb),
 rk AS (SELECT gold, pv, row_number() OVER (ORDER BY pv) AS j, count(*) OVER () AS n FROM pv),
 th AS (SELECT max(pv) AS t FROM rk WHERE pv <= j * .7 / n)
 SELECT t AS threshold, count(*) FILTER (WHERE gold = 1 AND pv <= t) / (count(*) FILTER (WHERE gold = 1))::DOUBLE AS real_within,
   count(*) FILTER (WHERE gold = 0 AND pv <= t) / (count(*) FILTER (WHERE gold = 0))::DOUBLE AS bogus_within FROM pv, th GROUP BY 1""",
       r="threshold real_within bogus_within")
def e17(i):
    return E.fdr_threshold(i.lscores, alpha=.7)


@query("eval_summary", """, a AS (SELECT sum((fpr - pf) * (tpr + pt) / 2) AS auc FROM (SELECT fpr, tpr, coalesce(lag(fpr) OVER o, 0) AS pf,
  coalesce(lag(tpr) OVER o, 0) AS pt FROM lroc WINDOW o AS (ORDER BY threshold DESC))),
 b AS (SELECT min(threshold) AS threshold, coalesce(max(tp), 0) AS tp, coalesce(max(fp), 0) AS fp FROM lroc WHERE fpr <= .01)
 SELECT auc, threshold, 1 - tp / (SELECT max(tp) FROM lroc)::DOUBLE AS fnr, tp, fp, (SELECT max(tp) FROM lroc) - tp AS fn,
  (SELECT max(fp) FROM lroc) - fp AS tn FROM a, b""", r="auc threshold fnr")
def e18(i):
    return E.eval_summary(i.lscores)


@query("confusion_matrix", """, c AS (SELECT gold, CASE WHEN p > .1 THEN 1 ELSE 0 END AS label, count(*) AS n FROM lscores WHERE gold IN (0, 1) GROUP BY 1, 2)
  SELECT gold, label, n, n / (sum(n) OVER (PARTITION BY gold))::DOUBLE AS share FROM c""", r="share")
def e19(i):
    return E.confusion_matrix(i.lscores.where(R.expert_only()).withColumn("label", scalars.score_label(F.col("p"), .1)), True)


@query("score_label", "SELECT subject, CASE WHEN p > .12 THEN 1 ELSE 0 END AS label FROM lscores")
def c20(i):
    return i.lscores.select("subject", scalars.score_label(F.col("p"), .12).alias("label"))


_STRATA = """, st AS (SELECT scorer, mag_bin, seeing_bin, gold, round(v, 9) AS v FROM (
  SELECT 'crowd' AS scorer, CASE WHEN mag <= 18 THEN 18.0::DOUBLE WHEN mag <= 19 THEN 19 WHEN mag <= 20 THEN 20 ELSE 23 END AS mag_bin,
   CASE WHEN seeing <= 3 THEN 3.0::DOUBLE WHEN seeing <= 3.5 THEN 3.5 WHEN seeing <= 3.9 THEN 3.9 WHEN seeing <= 4.5 THEN 4.5 ELSE 14 END AS seeing_bin, m.gold, p AS v
   FROM meta m JOIN lscores USING (subject) WHERE m.gold IN (0, 1)
  UNION ALL SELECT 'machine', CASE WHEN mag <= 18 THEN 18.0::DOUBLE WHEN mag <= 19 THEN 19 WHEN mag <= 20 THEN 20 ELSE 23 END,
   CASE WHEN seeing <= 3 THEN 3.0::DOUBLE WHEN seeing <= 3.5 THEN 3.5 WHEN seeing <= 3.9 THEN 3.9 WHEN seeing <= 4.5 THEN 4.5 ELSE 14 END, m.gold, machine_score
   FROM meta m JOIN lscores USING (subject) WHERE m.gold IN (0, 1)))
 SELECT a.scorer, a.mag_bin, a.seeing_bin, sum(CASE WHEN a.v > b.v THEN 1 WHEN a.v = b.v THEN .5 ELSE 0 END) / count(*)::DOUBLE AS auc
 FROM st a JOIN st b USING (scorer, mag_bin, seeing_bin) WHERE a.gold = 1 AND b.gold = 0 GROUP BY 1, 2, 3"""


@query("strata_roc", _STRATA, r="mag_bin seeing_bin auc")
def e20(i):
    m = i.meta.join(i.lscores.select("subject", "p"), "subject").where(R.expert_only())
    long = m.select("subject", "gold", scalars.mag_bin(F.col("mag")).alias("mag_bin"), scalars.seeing_bin(F.col("seeing")).alias("seeing_bin"),
                    F.explode(F.array(F.struct(F.lit("crowd").alias("scorer"), F.col("p")),
                                      F.struct(F.lit("machine").alias("scorer"), F.col("machine_score").alias("p")))).alias("s")) \
        .select("subject", "gold", "mag_bin", "seeing_bin", "s.scorer", "s.p")
    return E.auc(long, runs=["scorer", "mag_bin", "seeing_bin"]).where("auc is not null")


@query("error_lists", """, o AS (SELECT CASE WHEN gold = 1 AND p >= .1 THEN 'tp' WHEN gold = 1 THEN 'fn' WHEN p >= .1 THEN 'fp' ELSE 'tn' END AS o,
  CASE WHEN gold = 1 AND p > .1 THEN 'tp' WHEN gold = 1 THEN 'fn' WHEN p > .1 THEN 'fp' ELSE 'tn' END AS s, subject FROM lscores WHERE gold IN (0, 1))
  SELECT subject, o AS outcome, s AS outcome_strict FROM o""")
def e21(i):
    rows = E.error_rows(i.lscores, .1)
    return rows.withColumn("outcome_strict", E.error_class(.1, strict=True)).select("subject", "outcome", "outcome_strict")


@query("error_rates", """, c AS (SELECT count(*) FILTER (WHERE gold = 1 AND p >= .1) AS tp, count(*) FILTER (WHERE gold = 1 AND p < .1) AS fn,
  count(*) FILTER (WHERE gold = 0 AND p >= .1) AS fp, count(*) FILTER (WHERE gold = 0 AND p < .1) AS tn FROM lscores)
  SELECT *, fn / (fn + tp)::DOUBLE AS fnr, fp / (fp + tn)::DOUBLE AS fpr FROM c""", r="fnr fpr")
def e21b(i):
    return E.error_rates(i.lscores, .1)


_SWEEP = """, sg AS (SELECT unnest(range(1000)) AS i), sb AS (SELECT gold, least(floor(round(p * 1000, 9)), 999) AS b FROM lscores WHERE gold IN (0, 1)),
 sc AS (SELECT sg.i, count(*) FILTER (WHERE gold = 0 AND b >= sg.i) AS fp, count(*) FILTER (WHERE gold = 1 AND b >= sg.i) AS tp,
  count(*) FILTER (WHERE gold = 0) AS zs, count(*) FILTER (WHERE gold = 1) AS os FROM sg, sb GROUP BY 1),
 sw AS (SELECT CAST(i AS INTEGER) AS i, i / 1000.0::DOUBLE AS threshold, fp / zs::DOUBLE AS fpr, 1 - tp / os::DOUBLE AS fnr,
  CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp)::DOUBLE END AS precision, tp / os::DOUBLE AS rc FROM sc)
"""


@query("rates_sweep", _SWEEP + "SELECT i, threshold, fpr, fnr, precision, 2 * precision * rc / nullif(precision + rc, 0) AS f1 FROM sw",
       r="threshold fpr fnr precision f1")
def e22(i):
    return E.rates_sweep(i.lscores)


@query("fnr_near_fpr", _SWEEP + """SELECT coalesce(arg_max(fnr, i), 0) AS fnr, coalesce(arg_max(threshold, i), 0) AS threshold FROM sw
  WHERE fpr >= .05 - .02 - 1e-12 AND fpr <= .05 + .02 + 1e-12""", r="fnr threshold")
def e22b(i):
    return E.fnr_near_fpr(E.rates_sweep(i.lscores), .05, .02)


@query("score_scatter", """SELECT CAST(floor(mag) AS INTEGER) AS int_bin, corr(machine_score, p) AS r_machine, corr(mag, p) AS r_mag, count(*) AS n
  FROM meta JOIN lscores USING (subject) GROUP BY 1""", r="r_machine r_mag")
def e23(i):
    j = i.meta.join(i.lscores.select("subject", "p"), "subject")
    return j.groupBy(scalars.int_bin(F.col("mag")).alias("int_bin")).agg(
        F.corr("machine_score", "p").alias("r_machine"), F.corr("mag", "p").alias("r_mag"), F.count("*").alias("n"))


def scatter_rows(i):
    """The pair rows behind the scatter plots: one per subject with a score."""
    return i.meta.select("subject", "machine_score", "mag", "seeing").join(i.lscores.select("subject", "gold", "p"), "subject") \
        .withColumn("mag_bin", scalars.mag_bin(F.col("mag")))


_PAIRS = ", pr AS (SELECT subject, machine_score, mag, seeing, s.gold, p, CASE WHEN mag <= 18 THEN 18.0::DOUBLE WHEN mag <= 19 THEN 19 WHEN mag <= 20 THEN 20 WHEN mag <= 23 THEN 23 END AS mag_bin FROM meta JOIN lscores s USING (subject)) "


def _cells(x, y, plot, gold):
    at = lambda c: f"CAST(least(floor(round(coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0) * 20, 9)), 19) AS INTEGER)"
    return f"SELECT '{plot}' AS plot, {gold} AS class, ix, iy, count(*) AS n FROM (SELECT gold, {at(x)} AS ix, {at(y)} AS iy FROM pr) GROUP BY ALL"


@query("scatter_pairs", _PAIRS + "SELECT * FROM pr", r="machine_score mag seeing p mag_bin")
def e23b(i):
    return scatter_rows(i)


@query("scatter_density", _PAIRS + _cells("machine_score", "mag", "machine-mag", "9") + " UNION ALL " + _cells("seeing", "mag", "seeing-mag", "9") + " UNION ALL "
       + _cells("seeing", "mag", "seeing-mag by gold", "gold"))
def e23c(i):
    """Machine score against magnitude, seeing against magnitude, and the latter per gold class (9: all classes)."""
    from ..operators.prefix import union_all
    rows = scatter_rows(i)
    plots = [("machine-mag", "machine_score", ()), ("seeing-mag", "seeing", ()), ("seeing-mag by gold", "seeing", ("gold",))]
    return union_all([E.scatter_bins(rows, x, "mag", by=by).select(F.lit(name).alias("plot"), (F.col("gold") if by else F.lit(9)).alias("class"), "ix", "iy", "n")
                      for name, x, by in plots])


@query("seeing_by_mag", _PAIRS + """SELECT mag_bin, CAST(least(floor(round((seeing - lo) / (hi - lo) * 20, 9)), 19) AS INTEGER) AS ix, count(*) AS n FROM pr, (SELECT min(seeing) AS lo, max(seeing) AS hi FROM pr)
  GROUP BY 1, 2""", r="mag_bin")
def e23d(i):
    """Seeing, one histogram per magnitude bin on a common grid."""
    return E.scatter_bins(scatter_rows(i), "seeing", "mag", by=("mag_bin",)).groupBy("mag_bin", "ix").agg(F.sum("n").alias("n"))


@query("retired_only", """, th AS (SELECT .1::DOUBLE AS bogus, .15::DOUBLE AS real), ex AS (SELECT subject, arg_min(p, step) AS retired FROM dhist, th
  WHERE p < bogus OR p > real GROUP BY subject) SELECT subject, s.p, retired FROM dscores s JOIN ex USING (subject)""", r="p retired")
def f13(i):
    th = i.spark.range(1).select(F.lit(.1).alias("bogus"), F.lit(.15).alias("real"))
    exits = E.first_exit(C.score_history(i.dyn, i.params, i.votes), th)
    return i.dscores.join(exits, "subject", "left").where(F.col("retired").isNotNull()).select("subject", "p", "retired")


# ---- joins -----------------------------------------------------------------------------------

@query("votes_with_gold", "SELECT voter, subject, seq, annotation, gold FROM fgold")
def j1(i):
    return i.fgold.select("voter", "subject", "seq", "annotation", "gold")


@query("votes_with_user_score", "SELECT voter, subject, annotation, s0, s1 FROM first_v JOIN users USING (voter)", r="s0 s1")
def j2(i):
    return C.apply_user_scores(i.first, i.users).select("voter", "subject", "annotation", "s0", "s1")


@query("scores_with_gold", "SELECT subject, gold, p FROM sgold", r="p")
def j3(i):
    return J.scores_with_gold(i.sscores.withColumn("gold", F.lit(9)), i.golds).select("subject", "gold", "p")


@query("golds_for_subjects", "SELECT subject, gold FROM golds WHERE subject IN (SELECT subject FROM votes)")
def j4(i):
    return R.golds_for_subjects(i.golds, i.votes)


@query("score_diff", _TRAIN + "SELECT subject, s.p AS p_a, ts.p AS p_b, ts.p - s.p AS diff FROM sscores s JOIN ts USING (subject)", r="p_a p_b diff")
def j5(i):
    return J.score_diff(i.sscores, C.static_scores(i.votes, _train(i), i.params))


@query("score_diff_runs", _TRAIN + """SELECT 'train' AS run, subject, ts.p AS p_b, s.p AS p_a, ts.p - s.p AS diff FROM sscores s JOIN ts USING (subject)
  UNION ALL SELECT 'dynamic', subject, d.p, s.p, d.p - s.p FROM sscores s JOIN dscores d USING (subject)""", r="p_a p_b diff")
def j5b(i):
    runs = C.static_scores(i.votes, _train(i), i.params).withColumn("run", F.lit("train")).unionByName(
        i.dscores.withColumn("run", F.lit("dynamic")))
    return J.score_diff_runs(i.sscores, runs)


def _train_users(i):
    return C.user_matrix(C.votes_with_gold(i.first, _train(i)), i.params)


@query("user_score_diff", """, half AS (SELECT voter, (count(*) FILTER (WHERE gold = 0 AND annotation = 0) + 5.0::DOUBLE) / (count(*) FILTER (WHERE gold = 0) + 10) AS s0,
  (count(*) FILTER (WHERE gold = 1 AND annotation = 1) + 5.0::DOUBLE) / (count(*) FILTER (WHERE gold = 1) + 10) AS s1, count(*) AS n
  FROM fgold WHERE subject % 2 = 0 OR length(voter) % 2 = 0 GROUP BY 1)
  SELECT voter, h.s0 - u.s0 AS d_s0, h.s1 - u.s1 AS d_s1, h.n - u.n AS d_n, CAST(sign(h.n - u.n) AS INTEGER) AS class FROM users u JOIN half h USING (voter)""",
       r="d_s0 d_s1")
def j6(i):
    """Against a run that saw only the even subjects of some voters: their counts fall, those of others stay."""
    half = i.fgold.where((F.col("subject") % 2 == 0) | (F.length("voter") % 2 == 0))
    return J.user_score_diff(i.users, C.user_matrix(half, i.params))


@query("user_error_vs_base", _TRAIN + "SELECT voter, u.s0 - tu.s0 / u.s0 AS error0, u.s1 - tu.s1 / u.s1 AS error1 FROM users u JOIN tu USING (voter)",
       r="error0 error1")
def j7(i):
    return J.user_error_vs_base(i.users, _train_users(i))


@query("metadata_latest", """SELECT l_partkey AS subject, arg_max(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS supplier,
  max((l_orderkey, l_linenumber))[1] AS load_seq FROM lineitem GROUP BY 1""")
def j8(i):
    rows = i.raw("lineitem").groupBy(F.col("l_partkey").alias("subject"), F.col("l_orderkey").alias("load_seq")).agg(
        F.max(F.struct("l_linenumber", "l_suppkey"))["l_suppkey"].alias("supplier"))
    return J.metadata_latest(rows).select("subject", "supplier", "load_seq")


@query("subjects_with_scores", "SELECT subject, mag, p, CAST(p > .5 AS INTEGER) AS label FROM meta JOIN sscores USING (subject)", r="mag p")
def j9(i):
    return J.subjects_with_scores(i.meta, i.sscores).where("p is not null").select("subject", "mag", "p", "label")


@query("gold_images", "SELECT o_orderkey AS CaptureEventID, o_orderpriority AS Species, l_shipdate::DATE::VARCHAR AS URL_Info FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def j11(i):
    gold = i.raw("orders").select(F.col("o_orderkey").alias("CaptureEventID"), F.col("o_orderpriority").alias("Species"))
    links = i.raw("lineitem").select(F.col("l_orderkey").alias("CaptureEventID"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("URL_Info"))
    return J.gold_images(gold, links)


@query("join_back_group", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_suppkey) AS n, max(l_quantity) OVER (PARTITION BY l_suppkey) AS most FROM lineitem",
       r="most")
def j12(i):
    return J.with_group(i.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_suppkey"],
                        {"n": F.count("*"), "most": F.max("l_quantity")}).select("l_orderkey", "l_linenumber", "l_partkey", "n", "most")


@query("votes_on_golds", "SELECT voter, subject, seq FROM votes WHERE subject IN (SELECT subject FROM golds WHERE gold IN (0, 1))")
def j13(i):
    return J.votes_on_golds(i.votes, i.golds.where(R.expert_only())).select("voter", "subject", "seq")


# ---- scalar functions ------------------------------------------------------------------------

@query("mag_bin", "SELECT subject, CASE WHEN mag <= 18 THEN 18.0::DOUBLE WHEN mag <= 19 THEN 19 WHEN mag <= 20 THEN 20 ELSE 23 END AS mag_bin FROM meta", r="mag_bin")
def c12(i):
    return i.meta.select("subject", scalars.mag_bin(F.col("mag")).alias("mag_bin"))


@query("seeing_bin", """SELECT subject, CASE WHEN seeing <= 3 THEN 3.0::DOUBLE WHEN seeing <= 3.5 THEN 3.5 WHEN seeing <= 3.9 THEN 3.9
  WHEN seeing <= 4.5 THEN 4.5 ELSE 14 END AS seeing_bin FROM meta""", r="seeing_bin")
def c12b(i):
    return i.meta.select("subject", scalars.seeing_bin(F.col("seeing")).alias("seeing_bin"))


@query("int_bin", "SELECT subject, CAST(floor(mag) AS INTEGER) AS bin FROM meta")
def c13(i):
    return i.meta.select("subject", scalars.int_bin(F.col("mag")).alias("bin"))


@query("cut_breaks", """SELECT subject, CASE WHEN mag > 17 AND mag <= 19.5 THEN '(17,19.5]' WHEN mag > 19.5 AND mag <= 21 THEN '(19.5,21]'
  WHEN mag > 21 THEN '(21,Inf]' END AS label FROM meta""")
def c14(i):
    return i.meta.select("subject", scalars.cut_breaks(F.col("mag"), (17, 19.5, 21, float("inf"))).alias("label"))


@query("file_key", "SELECT vec_id, 'obj' || (vec_id // 3) || label AS key FROM embeddings")
def c16(i):
    return i.images.select("vec_id", scalars.file_key(F.col("file")).alias("key"))


@query("season_of", "SELECT page_id, split_part(url, '/', 1) AS season, split_part(url, '/', 4) AS name FROM pages")
def c17(i):
    return i.raw("pages").select("page_id", scalars.season_of(F.col("url")).alias("season"), scalars.image_name(F.col("url")).alias("name"))


@query("voter_key", "SELECT classification_id, CASE WHEN live_project THEN 'u:' || user_id ELSE 's:' || session_id END AS voter FROM vlog")
def c11(i):
    from ..functions.parsing import voter_key
    v = i.vlog.withColumn("user_id", F.when(F.col("live_project"), F.col("user_id")))
    return v.select("classification_id", voter_key(F.col("user_id"), F.col("session_id")).alias("voter"))
