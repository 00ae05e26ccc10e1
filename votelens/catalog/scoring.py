"""Queries: windows and the consensus core (W, N)."""
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import consensus as C, evaluate as E, layout, relational as R, skill
from ..plans import split_runs, trials
from ..sources import tables
from .base import query


@query("user_prefix_matrix", "SELECT voter, subject, seq, s0, s1 FROM dyn", r="s0 s1")
def w1(i):
    return i.dyn.select("voter", "subject", "seq", "s0", "s1")


@query("subject_prefix_score", "SELECT subject, step - 1 AS vote_order, p FROM dsteps", r="p")
def w2(i):
    return C.subject_prefix_scores(i.dyn, i.params, source=i.votes).select("subject", F.col("vote_order").cast("bigint"), "p")


@query("first_vote_per_pair", "SELECT voter, subject, seq, annotation FROM first_v")
def w3(i):
    return i.first


@query("vote_order", """SELECT subject, voter, row_number() OVER (PARTITION BY subject ORDER BY seq) - 1 AS in_subject,
  row_number() OVER (PARTITION BY voter ORDER BY seq) - 1 AS in_voter FROM first_v""")
def w4(i):
    rows = R.group_push(i.first, ["subject"], ["voter", "seq"], ["seq"]).withColumnRenamed("position", "in_subject")
    return R.group_push(rows, ["voter"], ["subject", "in_subject"], ["seq"]).select(
        "subject", "voter", "in_subject", F.col("position").alias("in_voter"))


@query("score_history", "SELECT subject, step, p FROM dhist", r="p")
def w5(i):
    return C.score_history(i.dyn, i.params, i.votes)


_THRESH = """, g AS (SELECT s.subject, s.p, coalesce(g.gold, -1) AS gold FROM dscores s LEFT JOIN golds g USING (subject)),
th AS (SELECT coalesce((SELECT max(p) FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS k, count(*) OVER () AS n FROM g
    WHERE gold = 1) WHERE 1 - k / n::DOUBLE < 0.1), 0) AS bogus,
  coalesce((SELECT min(p) FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM g
    WHERE gold = 0) WHERE 1 - k / n::DOUBLE < 0.01), 0) AS real)
"""


@query("first_exit", _THRESH + """SELECT subject, arg_min(p, step) AS retired FROM dhist, th
  WHERE p < bogus OR p > real GROUP BY subject""", r="retired")
def w6(i):
    labelled = E.with_golds(i.dscores, i.golds)
    return E.first_exit(C.score_history(i.dyn, i.params, i.votes), E.retire_thresholds(labelled, i.params.fpr, i.params.mdr))


@query("retire_thresholds", """SELECT
  coalesce((SELECT max(p) FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS k, count(*) OVER () AS n FROM lscores
    WHERE gold = 1) WHERE 1 - k / n::DOUBLE < 0.1), 0) AS bogus,
  coalesce((SELECT min(p) FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM lscores
    WHERE gold = 0) WHERE 1 - k / n::DOUBLE < 0.01), 0) AS real""", r="bogus real")
def w7(i):
    return E.retire_thresholds(i.lscores, i.params.fpr, i.params.mdr)


_PURITY_ROWS = """, r AS (SELECT p, coalesce(count(*) FILTER (WHERE gold = 0) OVER w, 0) AS z,
  coalesce(count(*) FILTER (WHERE gold = 1) OVER w, 0) AS o FROM lscores
  WINDOW w AS (ORDER BY p, gold, subject ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
t AS (SELECT coalesce(min(p), 1.0) AS threshold FROM r WHERE z + o > 0 AND o / (z + o)::DOUBLE > {q})
"""


@query("find_purity", _PURITY_ROWS.format(q=.5) + "SELECT threshold FROM t", r="threshold")
def w8(i):
    return E.purity_threshold(i.lscores, .5)


@query("purity_completeness_curve", """SELECT p, sum(o) OVER d / (sum(n) OVER d)::DOUBLE AS purity,
  sum(o) OVER d / (sum(o) OVER ())::DOUBLE AS completeness FROM (SELECT p, count(*) AS n,
  count(*) FILTER (WHERE gold = 1) AS o FROM lscores GROUP BY p) WINDOW d AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""",
       r="p purity completeness")
def w9(i):
    return E.purity_completeness_curve(i.lscores)


RANKED_SQL = """, ranked AS (SELECT *, CASE WHEN n_class <= 10 THEN 'Rare' WHEN n_class <= 50 THEN 'Casual' WHEN n_class <= 500
    THEN 'Regular' ELSE 'Power' END AS user_type,
  CASE WHEN machine_score <= 0 THEN NULL WHEN machine_score <= .25 THEN 'Q1 - ML Score' WHEN machine_score <= .5 THEN 'Q2 - ML Score'
    WHEN machine_score <= .75 THEN 'Q3 - ML Score' WHEN machine_score <= 1 THEN 'Q4 - ML Score' END AS ml_score,
  CASE WHEN rank > 480 AND rank <= 500 THEN '(480,500]' WHEN rank > 500 THEN '(500,Inf]'
    ELSE '(' || ((rank - 1) // 30 * 30) || ',' || ((rank - 1) // 30 * 30 + 30) || ']' END AS rank_bucket
  FROM (SELECT v.voter, v.subject, v.seq, v.annotation, m.gold, m.machine_score,
    CASE WHEN v.annotation = m.gold THEN 1 ELSE 0 END AS correct,
    row_number() OVER (PARTITION BY voter ORDER BY seq) AS rank, count(*) OVER (PARTITION BY voter) AS n_class
    FROM votes v JOIN meta m USING (subject) WHERE m.gold IN (0, 1)))
"""
# R's seq(0, 500, 30) ends at 480; the last finite break is 480
RANKED_SQL = RANKED_SQL.replace("WHEN rank > 480 AND rank <= 500 THEN '(480,500]' WHEN rank > 500 THEN '(500,Inf]'",
                                "WHEN rank > 480 THEN '(480,Inf]'")


def ranked(i):
    rows = i.votes.join(i.meta.select("subject", "gold", "machine_score").where(R.expert_only()), "subject")
    return skill.user_rank_types(rows, i.params, i.votes)


@query("user_rank_types", RANKED_SQL + "SELECT voter, seq, rank, n_class, user_type, ml_score FROM ranked")
def w10(i):
    return ranked(i).select("voter", "seq", "rank", "n_class", "user_type", "ml_score")


_UHIST = """, k AS (SELECT voter, gold, CAST(row_number() OVER w AS BIGINT) AS step,
    (count(*) FILTER (WHERE annotation = gold) OVER (w ROWS UNBOUNDED PRECEDING) + 5.0::DOUBLE) / (row_number() OVER w + 10) AS s
    FROM fgold WHERE gold IN (0, 1) WINDOW w AS (PARTITION BY voter, gold ORDER BY seq)),
  steps AS (SELECT voter, step, max(s) FILTER (WHERE gold = 0) AS a, max(s) FILTER (WHERE gold = 1) AS b FROM (
    SELECT * FROM k UNION ALL SELECT DISTINCT voter, 0, 0, .5::DOUBLE FROM k UNION ALL SELECT DISTINCT voter, 1, 0, .5::DOUBLE FROM k)
    GROUP BY 1, 2),
  h AS (SELECT voter, step, coalesce(a, u.s0) AS s0, coalesce(b, u.s1) AS s1 FROM steps JOIN users u USING (voter))
"""


@query("user_history", _UHIST + "SELECT voter, step, s0, s1, (s0 + s1) / 2 AS mean FROM h", r="s0 s1 mean")
def w11(i):
    return C.user_history(i.fgold, i.params, i.votes)


@query("user_history_slice", _UHIST + "SELECT voter, step, s0, s1, (s0 + s1) / 2 AS mean FROM h WHERE step BETWEEN 8 AND 20",
       r="s0 s1 mean")
def w11b(i):
    return C.user_history(i.fgold, i.params, i.votes).where(F.col("step").between(8, 20))


@query("trace_sample", """SELECT h.subject, h.step, h.p, coalesce(g.gold, -1) AS gold FROM dhist h LEFT JOIN golds g USING (subject)
  WHERE h.subject IN (SELECT DISTINCT subject FROM dhist ORDER BY subject LIMIT 1000)""", r="p")
def w12(i):
    return layout.trace_sample(C.score_history(i.dyn, i.params, i.votes), i.golds)


@query("first_detection", """SELECT o_custkey AS object, min(strftime(o_orderdate, '%Y-%m-%d')) AS mjd,
  arg_min(o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'), o_orderkey)) AS file FROM orders GROUP BY 1""")
def w14(i):
    return layout.first_detection(i.raw("orders").select(
        F.col("o_custkey").alias("object"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("mjd"), F.col("o_orderkey").alias("file")))


# ---- consensus core --------------------------------------------------------------------------

@query("dynamic_scores", "SELECT subject, p, n_votes FROM dscores", r="p")
def n1(i):
    return i.dscores


@query("static_scores", "SELECT subject, p, n_votes FROM sscores", r="p")
def n2(i):
    return i.sscores


@query("static_scores_lineitem", "SELECT subject, gold, p, n_votes FROM lscores", r="p")
def n2b(i):
    return i.lscores


@query("user_matrix", "SELECT voter, s0, s1, n FROM users", r="s0 s1")
def n3(i):
    return i.users.select("voter", "s0", "s1", "n")


@query("user_quadrant", """SELECT voter, s0, s1, CASE WHEN s0 > .5 AND s1 > .5 THEN 'Astute' WHEN s0 > .5 THEN 'Pessimistic'
  WHEN s1 > .5 THEN 'Optimistic' ELSE 'Obtuse' END AS quadrant FROM users""", r="s0 s1")
def n4(i):
    return i.users.select("voter", "s0", "s1", C.user_quadrant().alias("quadrant"))


@query("score_export", _THRESH + """SELECT g.subject, g.gold, g.p, x.retired FROM g LEFT JOIN (
  SELECT subject, arg_min(p, step) AS retired FROM dhist, th WHERE p < bogus OR p > real GROUP BY subject) x USING (subject)""",
       r="p retired")
def n5(i):
    return E.score_export(i.dscores, C.score_history(i.dyn, i.params, i.votes), i.golds, i.params.fpr, i.params.mdr)


_TRAIN = """, tg AS (SELECT subject, gold FROM golds WHERE gold IN (0, 1) ORDER BY substr(md5('5:' || subject), 1, 16), subject LIMIT 1000),
 tu AS (SELECT voter, (count(*) FILTER (WHERE gold = 0 AND annotation = 0) + 5.0::DOUBLE) / (count(*) FILTER (WHERE gold = 0) + 10) AS s0,
  (count(*) FILTER (WHERE gold = 1 AND annotation = 1) + 5.0::DOUBLE) / (count(*) FILTER (WHERE gold = 1) + 10) AS s1
  FROM first_v LEFT JOIN tg USING (subject) GROUP BY 1),
 ts AS (SELECT subject, 1 / (1 + exp(-(ln(0.12::DOUBLE / 0.88::DOUBLE)
    + sum(CAST(round(1e9 * CASE WHEN annotation = 1 THEN ln(s1 / (1 - s0)) ELSE ln((1 - s1) / s0) END) AS BIGINT)) / 1e9))) AS p
  FROM first_v JOIN tu USING (voter) GROUP BY 1)
"""


def _train(i):
    """A second gold set (1,000 random labels), for rescoring and train / test."""
    return R.random_rows(i.golds.where(R.expert_only()), "subject", 1000, 5)


@query("rescore_new_golds", _TRAIN + "SELECT subject, p FROM ts", r="p")
def n6(i):
    return C.rescore(i.votes, _train(i), i.params).select("subject", "p")


@query("train_test_split", _TRAIN + "SELECT ts.subject, ts.p, coalesce(g.gold, -1) AS gold FROM ts LEFT JOIN golds g USING (subject)", r="p")
def n9(i):
    return trials.train_test(i.votes, _train(i), i.golds, i.params).select("subject", "p", "gold")


def _split_sql(col, edges):
    bins = " ".join(f"WHEN {col} >= {lo} AND {col} < {hi} THEN {lo}::DOUBLE" for lo, hi in zip(edges[:-1], edges[1:]))
    return f""", b AS (SELECT f.*, CASE {bins} END AS bin FROM fgold f JOIN meta m USING (subject)),
 bv AS (SELECT * FROM b WHERE bin IS NOT NULL),
 bu AS (SELECT bin, voter, (count(*) FILTER (WHERE gold = 0 AND annotation = 0) + 5.0::DOUBLE) / (count(*) FILTER (WHERE gold = 0) + 10) AS s0,
  (count(*) FILTER (WHERE gold = 1 AND annotation = 1) + 5.0::DOUBLE) / (count(*) FILTER (WHERE gold = 1) + 10) AS s1 FROM bv GROUP BY 1, 2),
 bs AS (SELECT bin, subject, 1 / (1 + exp(-(ln(0.12::DOUBLE / 0.88::DOUBLE)
    + sum(CAST(round(1e9 * CASE WHEN annotation = 1 THEN ln(s1 / (1 - s0)) ELSE ln((1 - s1) / s0) END) AS BIGINT)) / 1e9))) AS p
  FROM bv JOIN bu USING (bin, voter) GROUP BY 1, 2)
"""


MAG_EDGES, SEEING_EDGES = (17, 18, 19, 20, 23), (2, 3, 5, 8, 10)


def mag_split(i):
    return split_runs.split_scores(i.votes, i.golds, i.meta, split_runs.range_bin("mag", MAG_EDGES), i.params)


def seeing_split(i):
    return split_runs.split_scores(i.votes, i.golds, i.meta, split_runs.range_bin("seeing", SEEING_EDGES), i.params)


@query("split_scores", _split_sql("m.mag", MAG_EDGES) + "SELECT bin, subject, p FROM bs", r="p")
def n7(i):
    return mag_split(i).select("bin", "subject", "p")


@query("split_scores_seeing", _split_sql("m.seeing", SEEING_EDGES) + "SELECT bin, subject, p FROM bs", r="p")
def n7b(i):
    return seeing_split(i).select("bin", "subject", "p")


@query("score_fallback_mean", _split_sql("m.mag", MAG_EDGES).replace("bs AS", "ms AS")
       + _split_sql("m.seeing", SEEING_EDGES).replace(", b AS", ", b2 AS").replace("FROM b WHERE", "FROM b2 WHERE")
       .replace("bv AS", "bv2 AS").replace("FROM bv GROUP", "FROM bv2 GROUP").replace("bu AS", "bu2 AS")
       .replace("FROM bv JOIN bu ", "FROM bv2 JOIN bu2 ") + """
  SELECT s.subject, s.p AS p_full, coalesce(ms.p, s.p) AS p_mag, coalesce(bs.p, s.p) AS p_seeing,
  (s.p + coalesce(ms.p, s.p) + coalesce(bs.p, s.p)) / 3 AS p_mean
  FROM sscores s LEFT JOIN ms USING (subject) LEFT JOIN bs USING (subject)""", r="p_full p_mag p_seeing p_mean")
def j10(i):
    from ..operators import joins
    return joins.score_fallback_mean(i.sscores, mag_split(i), seeing_split(i))


def gold_rows(i):
    """A gold table with several loads per subject: one load per order line of the part."""
    return i.raw("lineitem").groupBy(F.col("l_partkey").alias("subject"), F.col("l_orderkey").alias("load_seq")).agg(
        (F.max("l_linenumber") % 3 - 1).alias("gold"))


GOLD_ROWS = """, grows AS (SELECT l_partkey AS subject, l_orderkey AS load_seq, max(l_linenumber) % 3 - 1 AS gold
  FROM lineitem GROUP BY 1, 2), glatest AS (SELECT subject, arg_max(gold, load_seq) AS gold FROM grows GROUP BY 1)
"""
_SPLIT = ", sp AS (SELECT subject, count(*) AS total, sum(annotation) AS real, count(*) - sum(annotation) AS bogus FROM votes GROUP BY 1)"
_CV = "(SELECT subject, round(pow(real + bogus, least(real, bogus) / greatest(real, bogus)::DOUBLE), 9) AS score FROM sp ORDER BY score DESC, subject LIMIT 20)"
_CN = "(SELECT subject, round(pow(abs(real - bogus), 1 - least(real, bogus) / greatest(real, bogus)::DOUBLE), 9) AS score FROM sp ORDER BY score DESC, subject LIMIT 20)"


@query("gold_selection", GOLD_ROWS + _SPLIT + f""", rg AS (SELECT subject, arg_max(gold, load_seq) AS gold FROM (SELECT *,
    substr(md5('7:' || subject || '/' || load_seq), 1, 16) AS h FROM grows WHERE gold <> -1 ORDER BY h, subject, load_seq LIMIT 500) GROUP BY 1)
  SELECT 'all' AS kind, subject, gold FROM glatest
  UNION ALL SELECT 'random', subject, gold FROM rg
  UNION ALL SELECT 'subjects', subject, gold FROM glatest WHERE subject IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'controversial', subject, gold FROM glatest WHERE subject IN (SELECT subject FROM {_CV})
  UNION ALL SELECT 'consensus', subject, gold FROM glatest WHERE subject IN (SELECT subject FROM {_CN})
  UNION ALL SELECT 'union', subject, gold FROM (SELECT subject, gold FROM golds WHERE subject NOT IN (SELECT subject FROM rg)
    UNION ALL SELECT subject, gold FROM rg)""")
def n8(i):
    from ..operators.prefix import union_all
    rows = gold_rows(i)
    pick = lambda kind, **k: trials.select_golds(kind, gold_rows=rows, votes=i.votes, **k)
    some = i.raw("supplier").select(F.col("s_suppkey").alias("subject"))
    sets = {"all": pick("all"), "random": pick("random", n=500, seed=7), "subjects": pick("subjects", subjects=some),
            "controversial": pick("controversial", n=20), "consensus": pick("consensus", n=20),
            "union": trials.union_golds(i.golds, pick("random", n=500, seed=7))}
    return union_all([d.select(F.lit(k).alias("kind"), "subject", "gold") for k, d in sets.items()])


@query("ledger_dump", "SELECT subject, step - 1 AS vote_order, voter, annotation, s0, s1, p FROM dsteps", r="s0 s1 p")
def s17(i):
    return tables.ledger_dump(C.subject_prefix_scores(i.dyn, i.params, source=i.votes)).withColumn("vote_order", F.col("vote_order").cast("bigint"))


@query("hash_order_check", "SELECT subject, substr(md5('3:' || subject), 1, 16) AS h FROM golds")
def hash_order(i):
    return i.golds.select("subject", scalars.hash_order(F.col("subject"), 3).alias("h"))
