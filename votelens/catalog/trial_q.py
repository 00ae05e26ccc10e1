"""Queries: trials and bootstrap (X), stores (S10, S11), streaming (T)."""
from functools import cache

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import aggregates as A, evaluate as E
from ..operators.prefix import union_all
from ..plans import bootstrap as B, trials as X
from ..session import scratch_path
from ..sources import tables as S
from ..streaming.online import OnlineScorer, run_stream
from .base import query
from .parsing_q import ANSWERS, messages
from .scoring import _SPLIT

# The experiments' own lists (sizes and repeats; counts of the grid; start, end and step of the growing series).
SIZES, REPEATS = (1000, 2000), 10
CV = CN = range(0, 2001, 50)
ORDERED = (5000, 50_000, 10)
FINE = (0, 1300, 10)          # a series that is as long as the small tables have labels

_P = """1 / (1 + exp(-(ln(0.12::DOUBLE / 0.88::DOUBLE) + coalesce({s}, 0) / 1e9)))"""


def trial_sql(keys, golds_cte, trial_list, votes="lfirst"):
    """Scores of every trial: ``tsc(keys, subject, p, gold)``; ``golds_cte`` defines ``tg`` (keys, subject, gold)."""
    k = ", ".join(keys)
    return golds_cte + f""", tu AS (SELECT {k}, voter,
  (count(*) FILTER (WHERE g.gold = 0 AND annotation = 0) + 5.0::DOUBLE) / (count(*) FILTER (WHERE g.gold = 0) + 10) AS s0,
  (count(*) FILTER (WHERE g.gold = 1 AND annotation = 1) + 5.0::DOUBLE) / (count(*) FILTER (WHERE g.gold = 1) + 10) AS s1
  FROM {votes} JOIN tg g USING (subject) WHERE g.gold IN (0, 1) GROUP BY ALL),
 tw AS (SELECT {k}, voter, CAST(round(1e9 * ln(s1 / (1 - s0))) AS BIGINT) AS l1, CAST(round(1e9 * ln((1 - s1) / s0)) AS BIGINT) AS l0 FROM tu),
 tl AS (SELECT {k}, subject, sum(CASE WHEN annotation = 1 THEN l1 ELSE l0 END) AS llr FROM {votes} JOIN tw USING (voter) GROUP BY ALL),
 tsc AS (SELECT {k}, v.subject, {_P.format(s='llr')} AS p, coalesce(gg.gold, -1) AS gold
  FROM (SELECT DISTINCT subject FROM {votes}) v CROSS JOIN ({trial_list}) t LEFT JOIN tl USING ({k}, subject) LEFT JOIN golds gg ON gg.subject = v.subject)
"""


_RANDOM = trial_sql(("golds", "n"), ", " + f"""tg AS (SELECT golds, n, subject, gold FROM (SELECT *, row_number() OVER (PARTITION BY golds, n
  ORDER BY substr(md5('0-' || golds || '-' || n || ':' || subject), 1, 16), subject) AS r FROM (SELECT subject, gold FROM golds WHERE gold IN (0, 1)),
  (SELECT unnest([{', '.join(map(str, SIZES))}]) AS golds), (SELECT unnest(range({REPEATS})) AS n)) WHERE r <= golds)""",
                    "SELECT DISTINCT golds, n FROM tg")

_POINTS = """, rr AS (SELECT {k}, p, coalesce(count(*) FILTER (WHERE gold = 0) OVER w, 0) AS z, coalesce(count(*) FILTER (WHERE gold = 1) OVER w, 0) AS o
  FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY p, gold, subject ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 th AS (SELECT {k}, coalesce(min(p) FILTER (WHERE z + o > 0 AND o / (z + o)::DOUBLE > {q}), 1.0) AS purity FROM rr GROUP BY ALL),
 pt AS (SELECT {k}, any_value(purity) AS purity, count(*) FILTER (WHERE gold = 1 AND p > purity) / (count(*) FILTER (WHERE gold = 1))::DOUBLE AS completeness
  FROM {t} JOIN th USING ({k}) GROUP BY ALL)
"""
TARGET = .515


def lfirst(i):
    from ..operators.consensus import first_vote_per_pair
    return first_vote_per_pair(i.lvotes)


def random_set(i):
    return X.random_trials(i.golds, SIZES, REPEATS)


def random_points(i):
    return X.trial_points(lfirst(i), random_set(i), i.golds, i.params)


def random_scores(i):
    return X.trial_scores(lfirst(i), random_set(i), i.params)


@query("random_trials", _RANDOM + _POINTS.format(k="golds, n", t="tsc", q=TARGET) + "SELECT golds, CAST(n AS INTEGER) AS n, purity, completeness FROM pt",
       r="purity completeness")
def x1(i):
    return X.random_trial_points(random_points(i), target=TARGET)


@query("random_trial_scores", _RANDOM + "SELECT golds, CAST(n AS INTEGER) AS n, subject, p FROM tsc", r="p")
def x1b(i):
    return random_scores(i)


@query("trial_gold_metrics", _RANDOM + """SELECT golds, CAST(n AS INTEGER) AS n, count(*) FILTER (WHERE gold = -1) AS n_none, count(*) FILTER (WHERE gold = 0) AS n_bogus,
  count(*) FILTER (WHERE gold = 1) AS n_real, count(*) FILTER (WHERE gold = 1 AND p >= .12) / nullif(count(*) FILTER (WHERE gold IN (0, 1) AND p >= .12), 0)::DOUBLE AS purity,
  count(*) FILTER (WHERE gold = 1 AND p > .12) / (count(*) FILTER (WHERE gold = 1))::DOUBLE AS completeness FROM tsc GROUP BY ALL""", r="purity completeness")
def x13(i):
    return X.trial_gold_metrics(random_points(i), ["golds", "n"], .12)


@query("trial_rows", _RANDOM + """SELECT 'randomex' AS experiment, t.golds, CAST(t.n AS INTEGER) AS n, t.subject, t.gold, t.p, coalesce(g.gold, -1) AS used_gold
  FROM tsc t LEFT JOIN tg g USING (golds, n, subject)""", r="p")
def x4(i):
    rows = X.trial_rows(random_scores(i), random_set(i).golds(), i.golds, ["golds", "n"], "randomex")
    return rows.select("experiment", "trial.golds", "trial.n", "subject", "gold", "p", "used_gold")


def _stored(i):
    store = S.TrialStore(i.spark, scratch_path(i.spark, "trials"))
    store.upload(X.trial_rows(random_scores(i), random_set(i).golds(), i.golds, ["golds", "n"], "randomex"), "randomex")
    return store


@query("trial_store", _RANDOM + "SELECT golds, CAST(n AS INTEGER) AS n, count(*) AS rows, count(*) FILTER (WHERE gold = 1) AS real FROM tsc GROUP BY ALL")
def s10(i):
    """Store two experiments, delete one, read the other's trials."""
    store = _stored(i)
    store.upload(store.rows("randomex").withColumn("experiment", F.lit("copy")), "copy")
    store.remove("copy")
    flat = store.rows().select("trial.golds", "trial.n", "gold")
    counts = flat.groupBy("golds", "n").agg(F.count("*").alias("rows"), F.count_if(F.col("gold") == 1).alias("real"))
    return counts.join(store.trials().select("trial.golds", "trial.n"), ["golds", "n"], "left_semi")


@query("trial_points", _RANDOM + _POINTS.format(k="golds, n", t="tsc", q=TARGET) + "SELECT 'randomex' AS experiment, golds, CAST(n AS INTEGER) AS n, purity, completeness FROM pt",
       r="purity completeness")
def x5(i):
    return X.trial_points_from_rows(_stored(i).rows("randomex"), ["golds", "n"], TARGET)


@query("trial_rerun", _RANDOM + "SELECT subject, p FROM tsc WHERE golds = 1000 AND n = 1", r="p")
def x6(i):
    rows = X.trial_rows(random_scores(i), random_set(i).golds(), i.golds, ["golds", "n"], "randomex")
    return X.trial_rerun(i.lvotes, rows, {"golds": 1000, "n": 1}, i.params).select("subject", "p")


_LSPLIT = f""", sp AS (SELECT l_partkey AS subject, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS real,
  count(*) FILTER (WHERE l_returnflag <> 'R') AS bogus FROM lineitem GROUP BY 1),
 cv AS (SELECT subject, row_number() OVER (ORDER BY score DESC, subject) AS r FROM (SELECT subject, round(pow(real + bogus, least(real, bogus) / greatest(real, bogus)::DOUBLE), 9) AS score FROM sp)),
 cn AS (SELECT subject, row_number() OVER (ORDER BY score DESC, subject) AS r FROM (SELECT subject, round(pow(abs(real - bogus), 1 - least(real, bogus) / greatest(real, bogus)::DOUBLE), 9) AS score FROM sp)),
 gr AS (SELECT a.controversial, b.consensus FROM (SELECT unnest(range({CV.start}, {CV.stop}, {CV.step})) AS controversial) a, (SELECT unnest(range({CN.start}, {CN.stop}, {CN.step})) AS consensus) b
  WHERE a.controversial + b.consensus > 0),
 tg AS (SELECT controversial, consensus, g.subject, g.gold FROM golds g JOIN cv ON cv.subject = g.subject JOIN cn ON cn.subject = g.subject
  JOIN gr ON cv.r <= controversial OR cn.r <= consensus)
"""
_CVGRID = trial_sql(("controversial", "consensus"), _LSPLIT, "SELECT controversial, consensus FROM gr")


def cv_points(i):
    return X.cutoff_trial_points(X.trial_points(lfirst(i), X.cv_grid_trials(i.lvotes, i.golds, CV, CN), i.golds, i.params, .12), cutoff=.12)


_CVPOINTS = """, cp AS (SELECT CAST(controversial AS INTEGER) AS controversial, CAST(consensus AS INTEGER) AS consensus,
  count(*) FILTER (WHERE gold = 1 AND p >= .12) / nullif(count(*) FILTER (WHERE gold IN (0, 1) AND p >= .12), 0)::DOUBLE AS purity,
  count(*) FILTER (WHERE gold = 1 AND p > .12) / (count(*) FILTER (WHERE gold = 1))::DOUBLE AS completeness FROM tsc GROUP BY ALL)
"""


@query("cv_grid_trials", _CVGRID + _CVPOINTS + "SELECT * FROM cp", r="purity completeness")
def x2(i):
    return cv_points(i)


@query("plot_grid", _CVGRID + _CVPOINTS + """, e AS (SELECT min(purity) AS a, max(purity) AS b, min(completeness) AS c, max(completeness) AS d FROM cp),
 nm AS (SELECT cp.*, CASE WHEN b <> a THEN (purity - a) / (b - a) ELSE 0 END AS pn, CASE WHEN d <> c THEN (completeness - c) / (d - c) ELSE 0 END AS cn_ FROM cp, e)
 SELECT controversial AS golds, consensus AS n, purity * completeness AS product, CAST(row_number() OVER o - 1 AS INTEGER) AS id,
  CAST((row_number() OVER o - 1) % (w + 1) AS INTEGER) AS x, CAST((row_number() OVER o - 1) // (w + 1) AS INTEGER) AS y FROM nm, (SELECT CAST(ceil(sqrt(count(*))) AS INTEGER) AS w FROM cp)
  WINDOW o AS (ORDER BY round(pow(1 - pn, 2) + pow(cn_, 2), 9), controversial, consensus)""", r="product")
def x7(i):
    return X.plot_grid(cv_points(i), "controversial", "consensus", "cvgrid").select("golds", "n", "product", "id", "x", "y")


def _ordered_sql(start, end, step):
    """Prefixes as long as there are labels are the same set: each length is worked out once and given to all trials that have it."""
    n = max((end - start) // step + 1, 1)
    return trial_sql(("size",), f""", od AS (SELECT subject, gold, row_number() OVER (ORDER BY substr(md5('0:' || subject), 1, 16), subject) AS r FROM golds WHERE gold IN (0, 1)),
 sz AS (SELECT n, {start} + (n + 1) * {step} AS golds, least({start} + (n + 1) * {step}, (SELECT count(*) FROM od)) AS size FROM (SELECT unnest(range({n})) AS n)),
 tg AS (SELECT size, subject, gold FROM od, (SELECT DISTINCT size FROM sz) WHERE r <= size)""", "SELECT DISTINCT size FROM sz") + _POINTS.format(k="size", t="tsc", q=TARGET) + \
        "SELECT CAST(golds AS INTEGER) AS golds, CAST(n AS INTEGER) AS n, purity, completeness FROM sz JOIN pt USING (size)"


def ordered(i, start, end, step):
    trials = X.ordered_trials(i.golds, start, end, step)
    return trials.for_all(X.random_trial_points(X.trial_points(lfirst(i), trials, i.golds, i.params, target=TARGET), target=TARGET))


@query("ordered_trials", _ordered_sql(*ORDERED), r="purity completeness")
def x3(i):
    return ordered(i, *ORDERED)


@query("ordered_trials_fine", _ordered_sql(*FINE), r="purity completeness")
def x3b(i):
    return ordered(i, *FINE)


@query("plot_store", _RANDOM + _POINTS.format(k="golds, n", t="tsc", q=TARGET) + "SELECT golds, CAST(n AS INTEGER) AS n, purity, completeness FROM pt",
       r="purity completeness")
def s11(i):
    store = S.PlotStore(i.spark, scratch_path(i.spark, "plots"))
    pts = X.random_trial_points(random_points(i), target=TARGET)
    store.upload(pts, "randomex")
    store.upload(pts.limit(1), "other")
    return store.get("randomex").select("golds", "n", "purity", "completeness")


# ---- bootstrap -------------------------------------------------------------------------------

LOW, HIGH, ROUNDS = .09, .16, 3


def _round_sql(n, labels):
    """CTEs of round n: matrix, scores and labels (``sil{n}``) from the labels table given."""
    return f""", bu{n} AS (SELECT voter, (count(*) FILTER (WHERE g.gold = 0 AND annotation = 0) + 5.0::DOUBLE) / (count(*) FILTER (WHERE g.gold = 0) + 10) AS s0,
  (count(*) FILTER (WHERE g.gold = 1 AND annotation = 1) + 5.0::DOUBLE) / (count(*) FILTER (WHERE g.gold = 1) + 10) AS s1
  FROM lfirst LEFT JOIN (SELECT subject, gold FROM {labels} WHERE gold IN (0, 1)) g USING (subject) GROUP BY 1),
 bs{n} AS (SELECT {n} AS round, subject, {_P.format(s="sum(CAST(round(1e9 * CASE WHEN annotation = 1 THEN ln(s1 / (1 - s0)) ELSE ln((1 - s1) / s0) END) AS BIGINT))")} AS p
  FROM lfirst JOIN bu{n} USING (voter) GROUP BY subject),
 sil{n} AS (SELECT {n} AS round, subject, p, coalesce(t.gold, CASE WHEN p < {LOW} THEN 0 WHEN p > {HIGH} THEN 1 END) AS gold, t.gold IS NOT NULL AS own
  FROM bs{n} FULL JOIN tr t USING (subject))"""


_TR = ", tr AS (SELECT subject, gold FROM golds WHERE gold IN (0, 1) ORDER BY substr(md5('9:' || subject), 1, 16), subject LIMIT 300)"
_BOOT = _TR + _round_sql(1, "tr") + _round_sql(2, "sil1") + _round_sql(3, "sil2") + \
    ", bl AS (SELECT * FROM sil1 UNION ALL SELECT * FROM sil2 UNION ALL SELECT * FROM sil3)"


def _training(i):
    from ..operators.relational import expert_only, random_rows
    return random_rows(i.golds.where(expert_only()), "subject", 300, 9)


def rounds(i):
    return B.bootstrap_loop(i.lvotes, _training(i), ROUNDS, LOW, HIGH, params=i.params)


@query("bootstrap_round", _BOOT + "SELECT subject, gold FROM sil1 WHERE gold IS NOT NULL")
def x8(i):
    _, silver = B.bootstrap_round(i.lvotes, _training(i), _training(i), LOW, HIGH, i.params)
    return silver


@query("bootstrap_loop", _BOOT + "SELECT round, subject, p, coalesce(gold, 2) AS silver FROM bl WHERE p IS NOT NULL", r="p")
def x9(i):
    return rounds(i).where("p is not null").select("round", "subject", "p", F.coalesce("silver", F.lit(2)).alias("silver"))


@query("silver_metrics", _BOOT + f"""SELECT round, count(*) FILTER (WHERE b.gold = 0) AS silver0, count(*) FILTER (WHERE b.gold = 1) AS silver1,
  count(*) FILTER (WHERE b.gold IS NULL) AS remaining,
  coalesce(count(*) FILTER (WHERE b.gold = 0 AND g.gold = 0) / nullif(count(*) FILTER (WHERE b.gold IS NOT NULL AND g.gold = 0), 0)::DOUBLE, 0) AS accuracy0,
  coalesce(count(*) FILTER (WHERE b.gold = 1 AND g.gold = 1) / nullif(count(*) FILTER (WHERE b.gold IS NOT NULL AND g.gold = 1), 0)::DOUBLE, 0) AS accuracy1,
  {LOW}::DOUBLE AS low, {HIGH}::DOUBLE AS high, avg(p) AS mean, quantile_cont(p, .5) AS median, stddev_pop(p) AS stdev
  FROM bl b LEFT JOIN golds g USING (subject) GROUP BY 1""", r="accuracy0 accuracy1 low high mean median stdev")
def x10(i):
    return B.silver_metrics(rounds(i), i.golds)


@query("bootstrap_roc", _BOOT + """, br AS (SELECT round, b.p, g.gold FROM bl b JOIN golds g USING (subject) WHERE g.gold IN (0, 1) AND p IS NOT NULL AND b.gold IS NOT NULL AND NOT own)
  SELECT a.round, sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN .5 ELSE 0 END) / count(*)::DOUBLE AS auc FROM br a JOIN br b USING (round)
  WHERE a.gold = 1 AND b.gold = 0 GROUP BY 1""", r="auc")
def x11(i):
    return E.auc(B.bootstrap_roc(rounds(i), i.golds, silver_only=True), runs=["round"])


@query("bootstrap_traces", _BOOT + """SELECT s.subject, coalesce(s.gold, 2) AS class, b.round - 1 AS step, b.p FROM sil3 s JOIN bl b USING (subject)
  WHERE b.p IS NOT NULL""", r="p")
def x12(i):
    t = B.bootstrap_traces(rounds(i).where("p is not null"))
    return t.select("subject", "class", F.posexplode("scores").alias("step", "p"))


# ---- streaming -------------------------------------------------------------------------------

PARTS = 3


def delivery(events, lo, below):
    """The messages of a range of ids. Cut before the messages are made, and dealt out: a packed table is few tasks, and its text many times its size."""
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = events.where((F.col("event_id") >= lo) & (F.col("event_id") < below)).repartition(tasks)
    return messages(part).where("raw IS NOT NULL")


@cache
def _streamed(spark, sf_dir):
    """The whole event feed in id order, delivered in parts; the stream runs on each part that has arrived.
    Once per session and folder, shared by the stream queries."""
    from .base import Inputs
    i = Inputs(spark, sf_dir)
    feed, state, ckpt = (scratch_path(spark, n) for n in ("feed", "state", "ckpt"))
    ids = i.raw("events").agg(F.min("event_id").alias("lo"), (F.max("event_id") + 1).alias("hi")).first()
    width = -(-(ids.hi - ids.lo) // PARTS)
    scorer = OnlineScorer(spark, state, i.golds, i.params, buckets=8, fan=2).start_cold()

    def parse(df):
        ok = P.parse_votes(df, "json", ANSWERS).accepted.where(~F.col("seen_before"))
        return ok.select("classification_id", F.concat(F.lit("u:"), F.regexp_replace("session_id", "s", "")).alias("voter"),
                         F.col("subject_id").alias("subject"), "annotation")

    # the last part is delivered twice: repeated ids must change nothing
    for k in [*range(PARTS), PARTS - 1]:
        delivery(i.raw("events"), ids.lo + k * width, ids.lo + (k + 1) * width).write.mode("append").text(feed)
        run_stream(S.stream_votes_json(spark, feed), scorer, ckpt, parse).awaitTermination()
    return scorer


def streamed(i):
    return _streamed(i.spark, i.dir)


@query("stream_votes", "SELECT seq AS classification_id, voter, subject, annotation FROM votes")
def t1(i):
    return streamed(i).stored_votes().select("classification_id", "voter", "subject", "annotation")


@query("stream_dedup", "SELECT count(*) AS n, count(DISTINCT seq) AS ids FROM votes")
def t2(i):
    return streamed(i).stored_votes().agg(F.count("*").alias("n"), F.count_distinct("classification_id").alias("ids"))


@query("stream_scores", "SELECT subject, p, n_votes FROM dscores", r="p")
def t3(i):
    return streamed(i).snapshot()


@query("stream_warm_start", "SELECT subject, p, n_votes FROM dscores", r="p")
def t4(i):
    """State rebuilt from the stored log scores as the log itself does."""
    log = streamed(i).stored_votes().select("classification_id", "voter", "subject", "annotation").withColumn("seq", P.order_key(F.col("classification_id")))
    return OnlineScorer(i.spark, scratch_path(i.spark, "warm"), i.golds, i.params).warm_start(log).snapshot()


@query("stream_emit", "SELECT seq AS classification_id, subject, p AS score FROM dsteps", r="score")
def t5(i):
    return streamed(i).emitted().select("classification_id", "subject", "score")


@query("stream_snapshot", "SELECT s.subject, coalesce(g.gold, -1) AS gold, s.p FROM dscores s LEFT JOIN golds g USING (subject)", r="p")
def t6(i):
    return E.with_golds(streamed(i).snapshot(), i.golds).select("subject", "gold", "p")


@query("stream_counts", """SELECT count(*) AS votes, count(DISTINCT user_id) AS users, count(DISTINCT subject_id) AS subjects, count(*) FILTER (WHERE NOT seen_before) AS first_votes,
  count(*) FILTER (WHERE seen_before) AS duplicates FROM vlog""")
def t7(i):
    """Counts of the stored dump (repeated views here) and of the online table together."""
    dump = i.vlog.where("seen_before").select(P.voter_key(F.col("user_id"), F.col("session_id")).alias("voter"), "subject_id", "seen_before")
    online = streamed(i).stored_votes().select("voter", F.col("subject").alias("subject_id"), F.lit(False).alias("seen_before"))
    return A.dump_stats(union_all([dump, online]))
