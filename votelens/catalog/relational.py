"""Queries: filters, predicates, sorts, sets, simple aggregates (F, L, U, A)."""
from pyspark.sql import functions as F, types as T

from ..functions import scalars
from ..operators import aggregates as A, consensus as C, evaluate as E, quantiles as Q, relational as R, skill
from ..schema import VOTES
from ..session import land
from .base import query
from .scoring import GOLD_ROWS, RANKED_SQL, _SPLIT, gold_rows, ranked

_V = "classification_id, user_id, subject_id, annotation"


def _four(df):
    return df.select("classification_id", "user_id", "subject_id", "annotation")


@query("match_eq", f"SELECT {_V} FROM vlog WHERE annotation = 1")
def f1(i):
    return _four(i.vlog.where(R.match("annotation", 1)))


# nullable field for the negative forms: the magnitude of bright parts only
_N = ", nn AS (SELECT o_orderkey, CASE WHEN o_totalprice < 300000 THEN o_orderstatus END AS st FROM orders)"


def _nullable(i):
    return i.raw("orders").select("o_orderkey", F.when(F.col("o_totalprice") < 300000, F.col("o_orderstatus")).alias("st"))


@query("match_ne", _N + "SELECT o_orderkey, st FROM nn WHERE st IS NULL OR st <> 'F'")
def f2(i):
    return _nullable(i).where(R.match("st", "F", eq=False))


@query("match_in", _N + "SELECT o_orderkey, st FROM nn WHERE st IN ('F', 'O')")
def f3(i):
    return _nullable(i).where(R.match("st", ["F", "O"]))


@query("match_nin", _N + "SELECT o_orderkey, st FROM nn WHERE st IS NULL OR st NOT IN ('F', 'O')")
def f4(i):
    return _nullable(i).where(R.match("st", ["F", "O"], eq=False))


@query("match_in_table", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def f3b(i):
    keys = i.raw("orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")
    return R.match_table(i.raw("lineitem"), "l_orderkey", keys).select("l_orderkey", "l_linenumber", "l_partkey")


@query("match_range", "SELECT subject, mag FROM meta WHERE mag >= 17.2 AND mag < 17.4", r="mag")
def f5(i):
    return i.meta.where(R.match_range("mag", 17.2, 17.4)).select("subject", "mag")


@query("project", "SELECT classification_id AS id, user_id AS voter_id, annotation * 2 - 1 AS sign FROM vlog")
def f6(i):
    return R.project(i.vlog, {"id": "classification_id", "voter_id": "user_id", "sign": F.col("annotation") * 2 - 1})


@query("first_votes", "SELECT user_id, subject_id, annotation, session_id, classification_id FROM vlog WHERE NOT seen_before")
def f7(i):
    return R.first_votes(i.vlog)


@query("metadata_slice", "SELECT v.voter, v.subject, v.annotation FROM votes v JOIN meta m USING (subject) WHERE mag >= 17.2 AND mag < 17.4")
def f8(i):
    return R.metadata_slice(i.votes, i.meta, "mag", 17.2, 17.4).select("voter", "subject", "annotation")


@query("debug_cap", "SELECT voter, subject, seq FROM votes ORDER BY seq LIMIT 501")
def f9(i):
    return R.debug_cap(i.votes, 500).select("voter", "subject", "seq")


@query("expert_only", "SELECT subject, gold FROM golds WHERE gold IN (0, 1)")
def f10(i):
    return i.golds.where(R.expert_only())


@query("validate_vote", """SELECT event_id, CASE WHEN k IS NULL THEN 'missing subject_id' WHEN a IS NULL THEN 'missing annotation'
  WHEN TRY_CAST(a AS INTEGER) IS NULL THEN 'not an int: annotation' END AS reason FROM (SELECT event_id,
  json_extract_string(props, '$.k') AS k, CASE event_type WHEN 'purchase' THEN '1' WHEN 'click' THEN '1' WHEN 'view' THEN '0'
  WHEN 'error' THEN 'err' END AS a FROM events)""")
def f11(i):
    t = F.col("event_type")
    raw = i.raw("events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("subject_id"),
                                 F.when(t.isin("purchase", "click"), "1").when(t == "view", "0").when(t == "error", "err")
                                 .alias("annotation"))
    return R.validate_votes(raw).select("event_id", "reason")


@query("validate_schema", """SELECT v.what, v.n, count(*) AS rows FROM vlog, (VALUES ('fits', 0), ('one type, one name, one unknown', 3)) AS v(what, n)
  GROUP BY 1, 2""")
def f12(i):
    """Errors against the declared schema, and against one that differs in a type, lacks a field and has another one."""
    other = T.StructType([T.StructField(f.name, T.StringType() if f.name == "subject_id" else f.dataType) for f in VOTES if f.name != "workflow"]
                         + [T.StructField("extra", T.LongType())])
    checks = (("fits", T.StructType([f for f in VOTES])), ("one type, one name, one unknown", other))
    found = F.array(*[F.struct(F.lit(what).alias("what"), F.lit(len(R.schema_errors(i.vlog, s))).alias("n")) for what, s in checks])
    return i.vlog.agg(F.count("*").alias("rows")).select(F.explode(found).alias("c"), "rows").select("c.what", "c.n", "rows")


@query("below_cutoff", "SELECT subject, gold, p FROM lscores WHERE p < .5 AND gold IN (0, 1)", r="p")
def f14(i):
    return i.lscores.where(F.col("p") < .5).where(R.expert_only()).select("subject", "gold", "p")


@query("vote_exists", """SELECT classification_id, classification_id IN (SELECT classification_id FROM vlog WHERE seen_before)
  OR classification_id IN (SELECT l_orderkey FROM lineitem) AS known FROM vlog""")
def f16(i):
    dump = i.vlog.where("seen_before")
    online = i.raw("lineitem").select(F.col("l_orderkey").alias("classification_id"))
    return R.vote_exists(i.vlog.select("classification_id"), dump, online)


@query("extreme_scores", """, h AS (SELECT subject, avg(annotation) AS p FROM lgold GROUP BY 1)
  SELECT avg(CASE WHEN p IN (0, 1) THEN 1 ELSE 0 END) AS share, count(*) FILTER (WHERE p IN (0, 1)) AS touching,
  (SELECT avg(CASE WHEN p IN (0, 1) THEN 1.0 ELSE 0 END) FROM lscores) AS score_share, (SELECT count(DISTINCT subject) FROM dhist WHERE p IN (0, 1)) AS histories FROM h""", r="share score_share")
def f17(i):
    frac = i.lvotes.groupBy("voter", "subject").agg(F.min("annotation").alias("a")).groupBy("subject").agg(F.avg("a").alias("p"))
    touching = R.extreme_histories(frac).agg(F.count("*").alias("touching"))
    scores = R.extreme_share(i.lscores).withColumnRenamed("share", "score_share")
    histories = R.extreme_histories(C.score_history(i.dyn, i.params, source=i.votes)).agg(F.count("*").alias("histories"))
    return E._with_one_row(E._with_one_row(E._with_one_row(R.extreme_share(frac), touching), scores), histories)


@query("labelled_rows", "SELECT subject, gold FROM golds WHERE gold <> -1")
def f18(i):
    return i.golds.where(F.col("gold") != -1)


# ---- sorts, limits, samples ------------------------------------------------------------------

@query("sort_many", "SELECT subject, gold, mag FROM meta ORDER BY gold, mag DESC, subject", r="mag")
def l1(i):
    return R.sort_many(i.meta.select("subject", "gold", "mag"), [("gold", 1), ("mag", -1), ("subject", 1)])


@query("limit_n", "SELECT subject, gold FROM golds ORDER BY subject LIMIT 25")
def l2(i):
    return i.golds.orderBy("subject").limit(25)


@query("random_golds", GOLD_ROWS + """SELECT subject, arg_max(gold, load_seq) AS gold FROM (SELECT * FROM grows WHERE gold <> -1
  ORDER BY substr(md5('11:' || subject || '/' || load_seq), 1, 16), subject, load_seq LIMIT 1000) GROUP BY 1""")
def l3(i):
    return R.random_golds(gold_rows(i), 1000, 11)


@query("sorted_scores", "SELECT subject, gold, p FROM lscores ORDER BY p, subject", r="p")
def l4(i):
    return i.lscores.select("subject", "gold", "p").orderBy("p", "subject")


@query("top_n_metric", """SELECT subject, n, score FROM (SELECT l_partkey AS subject, count(*) AS n, round(sum(l_extendedprice), 2) AS score
  FROM lineitem GROUP BY 1) ORDER BY score DESC, subject LIMIT 100""", r="score")
def l6(i):
    m = i.raw("lineitem").groupBy(F.col("l_partkey").alias("subject")).agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("score"))
    return R.top_by(m, "score", "subject", 100)


@query("shuffle_rows", "SELECT vec_id, label, substr(md5('4:' || vec_id), 1, 16) AS shuffle_key FROM embeddings")
def l7(i):
    return R.shuffle_rows(i.images.select("vec_id", "label"), "vec_id", 4)


@query("vote_shuffle", "SELECT subject, p, n_votes FROM sscores", r="p")
def l8(i):
    """Votes in a new order with the voters' final scores: the last score of each subject is unchanged."""
    moved = R.shuffle_votes_within_subject(C.static_votes(i.votes, i.golds, i.params), 3)
    steps = C.subject_prefix_scores(moved, i.params)
    return steps.groupBy("subject").agg(F.max_by("p", "step").alias("p"), F.count("*").alias("n_votes"))


# ---- set operations --------------------------------------------------------------------------

@query("gold_union", GOLD_ROWS + """SELECT coalesce(b.subject, a.subject) AS subject, coalesce(b.gold, a.gold) AS gold
  FROM golds a FULL JOIN glatest b ON a.subject = b.subject""")
def u1(i):
    return R.gold_union(i.golds, R.latest_gold(gold_rows(i)))


@query("vote_concat", """SELECT 'u:' || user_id AS voter, subject_id AS subject, annotation,
  classification_id + CASE WHEN seen_before THEN 1152921504606846976 ELSE 0 END AS seq FROM vlog""")
def u2(i):
    return R.vote_concat(i.vlog.where(~F.col("seen_before")), i.vlog.where("seen_before"))


@query("gold_then_all", "SELECT subject, p, n_votes FROM sscores", r="p")
def u3(i):
    """Training votes first, then all votes: the two-pass form has the same result."""
    users = C.user_matrix(C.votes_with_gold(
        i.first.join(i.golds.where(R.expert_only()).select("subject"), "subject", "left_semi"), i.golds), i.params)
    return C.subject_scores(C.apply_user_scores(i.first, users), i.params)


BIN_SQL = """, bc AS (SELECT voter, CASE WHEN mag <= 18 THEN 18.0::DOUBLE WHEN mag <= 19 THEN 19 WHEN mag <= 20 THEN 20 WHEN mag <= 23 THEN 23 END AS bin,
  count(*) AS n, count(*) FILTER (WHERE gold = 1) AS pos, count(*) FILTER (WHERE gold = 1 AND annotation = 1) AS tp,
  count(*) FILTER (WHERE gold = 0 AND annotation = 1) AS fp, count(*) FILTER (WHERE gold = 1 AND annotation = 0) AS fn,
  count(*) FILTER (WHERE gold = 0 AND annotation = 0) AS tn
  FROM lgold JOIN (SELECT subject, mag FROM meta) USING (subject) WHERE gold IN (0, 1) GROUP BY 1, 2)
"""


def bin_counts(i):
    votes = C.votes_with_gold(C.first_vote_per_pair(i.lvotes), i.golds)
    binned = votes.join(i.meta.select("subject", scalars.mag_bin(F.col("mag")).alias("bin")), "subject")
    return A.user_bin_confusion(binned)


@query("user_bin_confusion", BIN_SQL + "SELECT * FROM bc", r="bin")
def a15(i):
    return bin_counts(i)


_TYPES = BIN_SQL + """, ty AS (SELECT voter, min(t) AS user_type FROM (
  SELECT voter, '1) mega' AS t FROM bc WHERE n >= 500 GROUP BY 1 HAVING count(*) = 4
  UNION ALL SELECT voter, '2) power' FROM bc WHERE n >= 100 GROUP BY 1 HAVING count(*) = 4
  UNION ALL SELECT voter, '3) frequent' FROM bc WHERE n >= 30 GROUP BY 1 HAVING count(*) = 4
  UNION ALL SELECT voter, '4) casual' FROM bc WHERE n >= 10 GROUP BY 1 HAVING count(*) = 4
  UNION ALL SELECT voter, '5) rare' FROM bc WHERE n < 10 GROUP BY 1) GROUP BY 1)
"""


@query("user_type_union", _TYPES + "SELECT voter, user_type FROM ty")
def u4(i):
    return skill.bin_user_types(bin_counts(i), 4)


@query("gold_replace", """, k AS (SELECT DISTINCT subject FROM lfirst), g AS (SELECT subject, gold FROM golds WHERE gold = 1)
  SELECT coalesce(k.subject, g.subject) AS subject, coalesce(g.gold, -1) AS gold FROM k FULL JOIN g ON k.subject = g.subject""")
def u5(i):
    return R.gold_replace(i.lvotes, i.golds.where(F.col("gold") == 1))


@query("id_set", """SELECT DISTINCT s_suppkey AS subject FROM supplier WHERE s_suppkey IN (SELECT subject FROM lfirst)
  AND s_suppkey NOT IN (SELECT subject FROM golds WHERE gold = 1)""")
def u6(i):
    ids = R.id_set(i.raw("supplier").select(F.col("s_suppkey").alias("subject")))
    return R.without_ids(R.golds_for_subjects(ids, i.lvotes), i.golds.where(F.col("gold") == 1).select("subject"))


@query("split_union", """SELECT vec_id, label, 'train' AS split FROM embeddings WHERE label < 7
  UNION ALL SELECT vec_id, label, 'test' FROM embeddings WHERE label >= 7""")
def u7(i):
    base = i.images.select("vec_id", "label")
    return R.split_union(("train", base.where("label < 7")), ("test", base.where("label >= 7")))


# ---- aggregates ------------------------------------------------------------------------------

@query("group_count", "SELECT workflow, annotation, live_project, count(*) AS count FROM vlog GROUP BY 1, 2, 3")
def a1(i):
    return R.group_count(i.vlog, "workflow", "annotation", "live_project")


@query("group_push", "SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY classification_id) - 1 AS position, user_id, annotation FROM vlog")
def a2(i):
    return R.group_push(i.vlog, ["subject_id"], ["user_id", "annotation"], ["classification_id"])


@query("result_count", "SELECT count(*) AS n FROM vlog WHERE annotation = 1 AND NOT seen_before")
def a3(i):
    return i.vlog.where(R.match("annotation", 1) & ~F.col("seen_before")).agg(F.count("*").alias("n"))


@query("vote_fraction", """SELECT subject, any_value(gold) AS gold, sum(annotation) / count(*)::DOUBLE AS p FROM votes JOIN golds USING (subject)
  WHERE gold <> -1 GROUP BY 1""", r="p")
def a4(i):
    return A.vote_fraction(C.votes_with_gold(i.votes, i.golds))


@query("dump_stats", """SELECT count(*) AS votes, count(DISTINCT user_id) AS users, count(DISTINCT subject_id) AS subjects,
  count(*) FILTER (WHERE NOT seen_before) AS first_votes, count(*) FILTER (WHERE seen_before) AS duplicates FROM vlog""")
def a5(i):
    from ..functions.parsing import voter_key
    return A.dump_stats(i.vlog.withColumn("voter", voter_key(F.col("user_id"), F.col("session_id"))))


@query("latest_gold", GOLD_ROWS + "SELECT subject, gold FROM glatest")
def a6(i):
    return R.latest_gold(gold_rows(i))


@query("vote_split", """SELECT l_partkey AS subject, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS real,
  count(*) FILTER (WHERE l_returnflag <> 'R') AS bogus FROM lineitem GROUP BY 1""")
def a7(i):
    return A.vote_split(i.lvotes)


_LS = """, ls AS (SELECT *, round({f}, 9) AS score FROM (SELECT l_partkey AS subject, count(*) AS total,
  count(*) FILTER (WHERE l_returnflag = 'R') AS real, count(*) FILTER (WHERE l_returnflag <> 'R') AS bogus FROM lineitem GROUP BY 1) {w})
  SELECT subject, total, real, bogus, score FROM ls ORDER BY score DESC, subject LIMIT {n}"""
_MIN = "least(real, bogus) / greatest(real, bogus)::DOUBLE"
_CVP, _CNP = f"pow(real + bogus, {_MIN})", f"pow(abs(real - bogus), 1 - {_MIN})"


@query("controversial_top", _LS.format(f=_CVP, w="", n=100), r="score")
def a8(i):
    return A.controversial_top(i.lvotes, 100)


@query("consensus_top", _LS.format(f=_CNP, w="", n=100), r="score")
def a9(i):
    return A.consensus_top(i.lvotes, 100)


@query("controversial_multiply", _LS.format(f=f"(real + bogus) * ({_MIN})", w="", n=100), r="score")
def a8b(i):
    return A.controversial_top(i.lvotes, 100, "multiply")


@query("consensus_multiply", _LS.format(f=f"abs(real - bogus) * (1 - {_MIN})", w="", n=100), r="score")
def a9b(i):
    return A.consensus_top(i.lvotes, 100, "multiply")


@query("controversial_capped", _LS.format(f=_CVP, w="WHERE total < 50", n=100), r="score")
def a10(i):
    return A.controversial_top(i.lvotes, 100, below=50)


@query("consensus_capped", _LS.format(f=_CNP, w="WHERE total < 50", n=100), r="score")
def a10b(i):
    return A.consensus_top(i.lvotes, 100, below=50)


@query("controversy", _LS.format(f=_CVP, w="", n=1000000000), r="score")
def c18(i):
    return A.controversial_top(i.lvotes, None)


@query("consensus_score", _LS.format(f=_CNP, w="", n=1000000000), r="score")
def c19(i):
    return A.consensus_top(i.lvotes, None)


_STAT = "avg({c}) AS mean, quantile_cont(round({c}, 9), .5) AS median, stddev_pop({c}) AS stdev"


@query("score_stats", f"SELECT {_STAT.format(c='p')} FROM lscores", r="mean median stdev")
def a11(i):
    return A.score_stats(i.lscores)


@query("user_stats", " UNION ALL ".join(f"SELECT '{n}' AS name, {_STAT.format(c=n)} FROM users" for n in ("s0", "s1"))
       + f" UNION ALL SELECT 'p', {_STAT.format(c='p')} FROM sscores", r="mean median stdev")
def a12(i):
    return A.all_stats(i.sscores, i.users)


@query("class_accuracy", """, l AS (SELECT gold, CASE WHEN p > .1 THEN 1 ELSE 0 END AS label FROM lscores WHERE gold IN (0, 1))
  SELECT coalesce(gold::VARCHAR, 'total') AS class, count(*) FILTER (WHERE label = gold) AS matched, count(*) AS n,
  count(*) FILTER (WHERE label = gold) / count(*)::DOUBLE AS accuracy FROM l GROUP BY ROLLUP (gold)""", r="accuracy")
def a13(i):
    return A.class_accuracy(i.lscores.withColumn("label", scalars.score_label(F.col("p"), .1)))


@query("gold_counts", """SELECT count(*) FILTER (WHERE gold = -1) AS n_none, count(*) FILTER (WHERE gold = 0) AS n_bogus,
  count(*) FILTER (WHERE gold = 1) AS n_real FROM golds""")
def a14(i):
    return A.gold_counts(i.golds)


@query("skill_by_bucket", RANKED_SQL + """SELECT gold, rank_bucket, sum(correct) / count(*)::DOUBLE AS p_correct, count(*) AS support
  FROM ranked GROUP BY 1, 2 HAVING count(*) >= 50""", r="p_correct")
def a16(i):
    return skill.skill_by_bucket(ranked(i))


@query("skill_by_bucket_score", RANKED_SQL + """SELECT gold, rank_bucket, ml_score, sum(correct) / count(*)::DOUBLE AS p_correct, count(*) AS support
  FROM ranked GROUP BY 1, 2, 3 HAVING count(*) >= 50""", r="p_correct")
def a16b(i):
    return skill.skill_by_bucket(ranked(i), ["ml_score"])


@query("skill_by_bucket_type", RANKED_SQL + """SELECT gold, rank_bucket, user_type, sum(correct) / count(*)::DOUBLE AS p_correct, count(*) AS support,
  count(DISTINCT voter) AS n_users FROM ranked GROUP BY 1, 2, 3 HAVING count(*) >= 50 AND count(DISTINCT voter) >= 20""", r="p_correct")
def a16c(i):
    return skill.skill_by_bucket(ranked(i), ["user_type"], min_users=20)


@query("skill_measures", RANKED_SQL + """, sm AS (SELECT rank_bucket, user_type, sum(correct * gold) / count(*)::DOUBLE AS precision,
  sum(correct * gold) / sum(gold)::DOUBLE AS recall_pos,
  sum(CASE WHEN gold = 0 THEN correct ELSE 0 END) / (count(*) FILTER (WHERE gold = 0))::DOUBLE AS recall_neg,
  sum(correct) / count(*)::DOUBLE AS accuracy, count(*) AS support, count(DISTINCT voter) AS n_users FROM ranked GROUP BY 1, 2)
  SELECT *, 2 * precision * recall_pos / (precision + recall_pos) AS f1 FROM sm WHERE support >= 50 AND n_users >= 20""",
       r="precision recall_pos recall_neg accuracy f1")
def a17(i):
    return skill.skill_measures(ranked(i))


_LABELS = """, base AS (SELECT m.*, s.p FROM meta m LEFT JOIN lscores s USING (subject)),
 cuts AS (SELECT quantile_cont(machine_score, 1 - (SELECT count(*) FILTER (WHERE gold = 1) / count(*)::DOUBLE FROM base)) AS mc,
   quantile_cont(p, 1 - (SELECT count(*) FILTER (WHERE gold = 1) / count(*)::DOUBLE FROM base)) AS sc FROM base),
 lab AS (SELECT base.*, CASE WHEN p IS NOT NULL THEN CAST(p > sc AS INTEGER) END AS slabel, CAST(machine_score > mc AS INTEGER) AS mlabel FROM base, cuts)
"""
# DuckDB wants constant quantile levels: the interpolated value from ordered rows instead
_LABELS = """, base AS (SELECT m.*, s.p FROM meta m LEFT JOIN lscores s USING (subject)),
 lev AS (SELECT 1 - count(*) FILTER (WHERE gold = 1) / count(*)::DOUBLE AS lv FROM base),
 om AS (SELECT machine_score AS x, row_number() OVER (ORDER BY machine_score) - 1 AS k, count(*) OVER () AS n FROM base),
 os AS (SELECT p AS x, row_number() OVER (ORDER BY p) - 1 AS k, count(*) OVER () AS n FROM base WHERE p IS NOT NULL),
 mc AS (SELECT sum(x * CASE WHEN k = floor(pl) AND k = ceil(pl) THEN 1 WHEN k = floor(pl) THEN 1 - (pl - floor(pl)) WHEN k = ceil(pl) THEN pl - floor(pl) ELSE 0 END) AS c
   FROM (SELECT x, k, round(lv * (n - 1), 9) AS pl FROM om, lev)),
 sc AS (SELECT sum(x * CASE WHEN k = floor(pl) AND k = ceil(pl) THEN 1 WHEN k = floor(pl) THEN 1 - (pl - floor(pl)) WHEN k = ceil(pl) THEN pl - floor(pl) ELSE 0 END) AS c
   FROM (SELECT x, k, round(lv * (n - 1), 9) AS pl FROM os, lev)),
 lab AS (SELECT base.*, CAST(p > sc.c AS INTEGER) AS slabel, CAST(machine_score > mc.c AS INTEGER) AS mlabel FROM base, sc, mc)
"""


def labelled_meta(i):
    base = i.meta.join(i.lscores.select("subject", "p"), "subject", "left")
    return A.base_rate_cut(A.base_rate_cut(base, "p", "slabel"), "machine_score", "mlabel")


@query("base_rate_cut", _LABELS + "SELECT subject, slabel, mlabel FROM lab WHERE slabel IS NOT NULL")
def a27(i):
    return labelled_meta(i).select("subject", "slabel", "mlabel").where("slabel is not null")


_QB = """, qc AS (SELECT quantile_cont(seeing, [0.0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0]) AS q FROM lab),
 qb AS (SELECT lab.*, len(list_filter(q, lambda c : c < seeing)) AS seeing_bin FROM lab, qc)
"""


@query("cut_quantiles", _LABELS.split(" lev AS")[0].rstrip().rstrip(",") + """, qc AS (SELECT quantile_cont(seeing, [""" + ", ".join(f"{k * .05:.2f}" for k in range(21)) + """]) AS q FROM base)
  SELECT subject, CAST(len(list_filter(q, lambda c : c < seeing)) AS INTEGER) AS seeing_bin FROM base, qc WHERE len(list_filter(q, lambda c : c < seeing)) > 0""")
def c15(i):
    return Q.quantile_bin(i.meta, "seeing", 20, "seeing_bin").where("seeing_bin is not null").select("subject", "seeing_bin")


@query("binned_rates", _LABELS + _QB + """, br AS (SELECT CAST(seeing_bin AS INTEGER) AS seeing_bin, """ + ", ".join(
    f"count(*) FILTER (WHERE {c} = {l} AND gold = {t}) / (count(*) FILTER (WHERE gold = {t}))::DOUBLE AS {s}_{n}"
    for n, c in (("crowd", "slabel"), ("machine", "mlabel")) for s, l, t in (("tp", 1, 1), ("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1)))
       + """, count(*) FILTER (WHERE gold = 1) / count(*)::DOUBLE AS pos FROM qb WHERE seeing_bin > 0 GROUP BY 1)
  SELECT *, 2 * tp_crowd / (2 * tp_crowd + fp_crowd + fn_crowd) AS f1_crowd, 2 * tp_machine / (2 * tp_machine + fp_machine + fn_machine) AS f1_machine FROM br""",
       r="tp_crowd tn_crowd fp_crowd fn_crowd tp_machine tn_machine fp_machine fn_machine pos f1_crowd f1_machine")
def a18(i):
    lab = labelled_meta(i).where("slabel is not null")
    lab = land(lab, "labels")
    return skill.binned_rates(Q.quantile_bin(lab, "seeing", 10, "seeing_bin"), "seeing_bin")


_DEV = _TYPES + """, tyd AS (SELECT bc.voter, bin, user_type, tp / nullif(pos, 0)::DOUBLE AS p_tp, tn / nullif(n - pos, 0)::DOUBLE AS p_tn
  FROM bc JOIN ty USING (voter)), dv AS (SELECT voter, bin, user_type, p_tp, p_tn,
  p_tp - avg(p_tp) OVER (PARTITION BY voter) AS p_tp_rel, p_tn - avg(p_tn) OVER (PARTITION BY voter) AS p_tn_rel,
  p_tp - avg(p_tp) OVER (PARTITION BY bin, user_type) AS p_tp_rel_meta, p_tn - avg(p_tn) OVER (PARTITION BY bin, user_type) AS p_tn_rel_meta FROM tyd)
"""


@query("mean_by_user", _DEV + "SELECT * FROM dv", r="bin p_tp p_tn p_tp_rel p_tn_rel p_tp_rel_meta p_tn_rel_meta")
def a19(i):
    return skill.skill_deviation(bin_counts(i), 4)


@query("unpivot", _DEV + """SELECT voter, bin, user_type, 'p_tp_rel' AS variable, p_tp_rel AS value FROM dv
  UNION ALL SELECT voter, bin, user_type, 'p_tn_rel', p_tn_rel FROM dv""", r="bin value")
def a20(i):
    return A.unpivot(skill.skill_deviation(bin_counts(i), 4), ["voter", "bin", "user_type"], ["p_tp_rel", "p_tn_rel"])


@query("pivot_fill", _DEV + """SELECT voter, coalesce(max(p_tp_rel) FILTER (WHERE bin = 18), 0) AS b18, coalesce(max(p_tp_rel) FILTER (WHERE bin = 19), 0) AS b19,
  coalesce(max(p_tp_rel) FILTER (WHERE bin = 20), 0) AS b20, coalesce(max(p_tp_rel) FILTER (WHERE bin = 23), 0) AS b23 FROM dv GROUP BY 1""",
       r="b18 b19 b20 b23")
def a21(i):
    wide = A.pivot_fill(skill.skill_deviation(bin_counts(i), 4), "voter", "bin", list(scalars.MAG_EDGES), "p_tp_rel")
    return wide.toDF("voter", "b18", "b19", "b20", "b23")


@query("pred_by_name", """, im AS (SELECT 'obj' || (vec_id // 3) AS file, CAST(embedding[1] AS DOUBLE) AS pred FROM embeddings)
  SELECT file, quantile_cont(round(pred * .5 + .5, 9), .5) AS pred FROM im GROUP BY 1""", r="pred")
def a23(i):
    return A.pred_by_name(i.images.select(F.split_part("file", F.lit("_"), F.lit(1)).alias("file"),
                                          (F.col("x")[0] * .5 + .5).alias("pred")))


@query("label_by_name", """, im AS (SELECT 'obj' || (vec_id // 3) AS file, label, count(*) AS k FROM embeddings GROUP BY 1, 2)
  SELECT file, arg_max(label, (k, -label)) AS label FROM im GROUP BY 1""")
def a24(i):
    return A.label_by_name(i.images.select(F.split_part("file", F.lit("_"), F.lit(1)).alias("file"), "label"))


@query("threshold_split", """SELECT count(*) FILTER (WHERE p < .08) AS low, count(*) FILTER (WHERE p >= .08 AND p > .15) AS high,
  count(*) FILTER (WHERE p >= .08 AND p <= .15) AS other FROM lscores""")
def a25(i):
    return A.threshold_split(i.lscores, .08, .15)


_MM = """, pts AS (SELECT l_linestatus AS experiment, l_linenumber AS golds, l_suppkey AS n, avg(l_discount) AS purity, avg(l_tax) AS completeness
  FROM lineitem GROUP BY 1, 2, 3), ends AS (SELECT experiment, min(purity) AS a, max(purity) AS b, min(completeness) AS c, max(completeness) AS d FROM pts GROUP BY 1),
 norm AS (SELECT pts.*, CASE WHEN b <> a THEN (purity - a) / (b - a) ELSE 0 END AS purity_n, CASE WHEN d <> c THEN (completeness - c) / (d - c) ELSE 0 END AS completeness_n
  FROM pts JOIN ends USING (experiment))
"""


def line_points(i):
    """Plot-like points (two rates per line number and supplier) as a stand-in for stored trial points."""
    return i.raw("lineitem").groupBy(F.col("l_linestatus").alias("experiment"), F.col("l_linenumber").alias("golds"),
                                     F.col("l_suppkey").alias("n")).agg(F.avg("l_discount").alias("purity"), F.avg("l_tax").alias("completeness"))


@query("minmax_normalise", _MM + "SELECT * FROM norm", r="purity completeness purity_n completeness_n")
def a26(i):
    return A.minmax_normalise(line_points(i), ["purity", "completeness"], ["experiment"])


@query("range_stats", _MM + """SELECT experiment, a AS purity_min, b AS purity_max, (a + b) / 2 AS purity_middle, c AS completeness_min, d AS completeness_max,
  (c + d) / 2 AS completeness_middle FROM ends""", r="purity_min purity_max purity_middle completeness_min completeness_max completeness_middle")
def a26b(i):
    return A.range_stats(line_points(i), ["purity", "completeness"], ["experiment"])


_GRID = _MM + """, g AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY {o}) - 1 AS id,
  CAST(ceil(sqrt(count(*) OVER (PARTITION BY experiment))) AS INTEGER) AS width FROM norm)
  SELECT experiment, golds, n, CAST(id AS INTEGER) AS id, width, CAST(id % (width + 1) AS INTEGER) AS x, CAST(id // (width + 1) AS INTEGER) AS y FROM g"""


@query("sort_grid", _GRID.format(o="round(pow(1 - purity_n, 2) + pow(completeness_n, 2), 9), golds, n"))
def w13(i):
    from ..operators import layout
    pts = line_points(i)
    return layout.grid_layout(pts, "sorted").select("experiment", "golds", "n", "id", "width", "x", "y")


@query("plain_grid", _GRID.format(o="golds, n"))
def w13b(i):
    from ..operators import layout
    return layout.grid_layout(line_points(i)).select("experiment", "golds", "n", "id", "width", "x", "y")


@query("column_grid", _MM + """SELECT experiment, golds, n, CAST(row_number() OVER (PARTITION BY experiment ORDER BY golds, n) - 1 AS INTEGER) AS id,
  CAST(dense_rank() OVER (PARTITION BY experiment ORDER BY golds // 2) - 1 AS INTEGER) AS x,
  CAST(row_number() OVER (PARTITION BY experiment, golds // 2 ORDER BY golds, n) - 1 AS INTEGER) AS y FROM norm""")
def w13c(i):
    from ..operators import layout
    return layout.column_layout(line_points(i), step=2).select("experiment", "golds", "n", "id", "x", "y")
