"""The queries' inputs, mapped from the given tables, and the same mapping as SQL.

Vote log: ``events`` (purchase, click = 1; view, error = 0; signup is no vote), subject ``props.k``, in
``event_id`` order. Golds and metadata: ``part``. Unordered votes: ``lineitem`` (supplier on part,
return flag R = 1). Images: ``embeddings`` (64 numbers = 8 x 8).
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parsing
from ..operators import consensus, evaluate
from ..params import Params

QUERIES: dict = {}
ORACLE: dict = {}
DIGITS = 6
_SCHEMAS: dict = {}


def query(name: str, sql: str | None = None, r: str = ""):
    """Register a query. ``sql`` is its oracle on top of ``CTES``; ``r`` names its floating-point columns,
    rounded on both sides (nudged, so that an exact half rounds the same way in both engines)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Inputs(spark, sf_dir)))
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            body = f"WITH {CTES}\n{sql}" if not sql.lstrip().upper().startswith(", ") else f"WITH {CTES}\n{sql.lstrip()}"
            if r:
                cols = ", ".join(f"ROUND({c} + 1e-12, {DIGITS}) AS {c}" for c in r.split())
                body = f"SELECT * REPLACE ({cols}) FROM ({body}) AS q"
            ORACLE[name] = body
        return fn
    return deco


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{f.name}`") + 1e-12, DIGITS).alias(f.name) if f.dataType.typeName() == "double"
                        else F.col(f"`{f.name}`")) for f in df.schema])


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.params = spark, sf_dir, Params()
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        """A given table; its schema is inferred once per path."""
        path = f"{self.dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @cached_property
    def vlog(self) -> DataFrame:
        e = self.raw("events")
        t = F.col("event_type")
        return e.select(
            F.col("event_id").alias("classification_id"), "user_id",
            F.when(t.isin("purchase", "click"), 1).when(t.isin("view", "error"), 0).alias("annotation"),
            F.lit(1).cast("bigint").alias("workflow"),
            F.get_json_object("props", "$.k").cast("bigint").alias("subject_id"),
            (F.col("value") >= 100).alias("seen_before"), (t != "error").alias("live_project"),
            F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").cast("timestamp").alias("time_stamp"),
        ).where("annotation is not null")

    @cached_property
    def votes(self) -> DataFrame:
        return parsing.scoring_view(self.vlog.where(~F.col("seen_before")))

    @cached_property
    def meta(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("subject"), (F.col("p_size") % 3 - 1).alias("gold"),
            (F.col("p_partkey") * 10).alias("object_id"), (F.col("p_size") / 50).alias("machine_score"),
            (17 + (F.col("p_retailprice") - 900) * .06).alias("mag"), F.lit(.1).alias("mag_err"),
            (2 + F.col("p_size") * .2).alias("seeing"))

    @cached_property
    def golds(self) -> DataFrame:
        return self.meta.select("subject", "gold")

    @cached_property
    def first(self) -> DataFrame:
        return consensus.first_vote_per_pair(self.votes)

    @cached_property
    def fgold(self) -> DataFrame:
        return consensus.votes_with_gold(self.first, self.golds)

    @cached_property
    def users(self) -> DataFrame:
        return consensus.user_matrix(self.fgold, self.params)

    @cached_property
    def sscores(self) -> DataFrame:
        return consensus.static_scores(self.votes, self.golds, self.params)

    @cached_property
    def sgold(self) -> DataFrame:
        return evaluate.with_golds(self.sscores, self.golds)

    @cached_property
    def dyn(self) -> DataFrame:
        return consensus.dynamic_votes(self.votes, self.golds, self.params)

    @cached_property
    def dscores(self) -> DataFrame:
        return consensus.dynamic_scores(self.votes, self.golds, self.params)

    @cached_property
    def lvotes(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.concat(F.lit("u:"), F.col("l_suppkey").cast("string")).alias("voter"), F.col("l_partkey").alias("subject"),
            (F.col("l_returnflag") == "R").cast("int").alias("annotation"), F.lit(0).cast("bigint").alias("seq"))

    @cached_property
    def lscores(self) -> DataFrame:
        """The larger score table (every part with votes), used by the evaluation queries."""
        return evaluate.with_golds(consensus.static_scores(self.lvotes, self.golds, self.params), self.golds)

    @cached_property
    def images(self) -> DataFrame:
        return self.raw("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).alias("y"), "label",
            F.concat(F.format_string("obj%d", F.floor(F.col("vec_id") / 3)), F.lit("_"), F.col("label").cast("string"),
                     F.lit("."), F.col("vec_id").cast("string"), F.lit(".img")).alias("file"))


CTES = """
vlog AS (SELECT event_id AS classification_id, user_id,
  CASE WHEN event_type IN ('purchase','click') THEN 1 WHEN event_type IN ('view','error') THEN 0 END AS annotation,
  CAST(1 AS BIGINT) AS workflow, CAST(json_extract_string(props, '$.k') AS BIGINT) AS subject_id,
  value >= 100 AS seen_before, event_type <> 'error' AS live_project, 's' || user_id AS session_id, ts AS time_stamp
  FROM events WHERE event_type IN ('purchase','click','view','error')),
votes AS (SELECT 'u:' || user_id AS voter, subject_id AS subject, annotation, classification_id AS seq
  FROM vlog WHERE NOT seen_before),
meta AS (SELECT p_partkey AS subject, p_size % 3 - 1 AS gold, p_partkey * 10 AS object_id,
  p_size / 50.0::DOUBLE AS machine_score, 17 + (p_retailprice - 900) * 0.06::DOUBLE AS mag, 0.1::DOUBLE AS mag_err,
  2 + p_size * 0.2::DOUBLE AS seeing FROM part),
golds AS (SELECT subject, gold FROM meta),
first_v AS (SELECT voter, subject, min(seq) AS seq, arg_min(annotation, seq) AS annotation FROM votes GROUP BY 1, 2),
fgold AS (SELECT f.*, coalesce(g.gold, -1) AS gold FROM first_v f LEFT JOIN golds g USING (subject)),
users AS (SELECT voter,
  (count(*) FILTER (WHERE gold = 0 AND annotation = 0) + 5.0::DOUBLE) / (count(*) FILTER (WHERE gold = 0) + 10) AS s0,
  (count(*) FILTER (WHERE gold = 1 AND annotation = 1) + 5.0::DOUBLE) / (count(*) FILTER (WHERE gold = 1) + 10) AS s1,
  count(*) AS n FROM fgold GROUP BY 1),
sscores AS (SELECT subject, 1 / (1 + exp(-(ln(0.12::DOUBLE / 0.88::DOUBLE)
    + sum(CAST(round(1e9 * CASE WHEN annotation = 1 THEN ln(s1 / (1 - s0)) ELSE ln((1 - s1) / s0) END) AS BIGINT)) / 1e9))) AS p, count(*) AS n_votes
  FROM first_v JOIN users USING (voter) GROUP BY 1),
sgold AS (SELECT s.*, coalesce(g.gold, -1) AS gold FROM sscores s LEFT JOIN golds g USING (subject)),
dyn AS (SELECT *, (m0 + 5.0::DOUBLE) / (c0 + 10) AS s0, (m1 + 5.0::DOUBLE) / (c1 + 10) AS s1 FROM (SELECT *,
  count(*) FILTER (WHERE gold = 0) OVER w AS c0, count(*) FILTER (WHERE gold = 0 AND annotation = 0) OVER w AS m0,
  count(*) FILTER (WHERE gold = 1) OVER w AS c1, count(*) FILTER (WHERE gold = 1 AND annotation = 1) OVER w AS m1
  FROM fgold WINDOW w AS (PARTITION BY voter ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
dllr AS (SELECT *, CAST(round(1e9 * CASE WHEN annotation = 1 THEN ln(s1 / (1 - s0)) ELSE ln((1 - s1) / s0) END) AS BIGINT) AS llr FROM dyn),
dscores AS (SELECT subject, 1 / (1 + exp(-(ln(0.12::DOUBLE / 0.88::DOUBLE) + sum(llr) / 1e9))) AS p,
  count(*) AS n_votes FROM dllr GROUP BY 1),
dsteps AS (SELECT *, row_number() OVER w AS step,
  1 / (1 + exp(-(ln(0.12::DOUBLE / 0.88::DOUBLE) + sum(llr) OVER w / 1e9))) AS p
  FROM dllr WINDOW w AS (PARTITION BY subject ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dhist AS (SELECT subject, step, p FROM dsteps UNION ALL SELECT DISTINCT subject, 0, 0.12::DOUBLE FROM dsteps),
lfirst AS (SELECT 'u:' || l_suppkey AS voter, l_partkey AS subject,
  min(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS annotation FROM lineitem GROUP BY 1, 2),
lgold AS (SELECT f.*, coalesce(g.gold, -1) AS gold FROM lfirst f LEFT JOIN golds g USING (subject)),
lusers AS (SELECT voter,
  (count(*) FILTER (WHERE gold = 0 AND annotation = 0) + 5.0::DOUBLE) / (count(*) FILTER (WHERE gold = 0) + 10) AS s0,
  (count(*) FILTER (WHERE gold = 1 AND annotation = 1) + 5.0::DOUBLE) / (count(*) FILTER (WHERE gold = 1) + 10) AS s1,
  count(*) AS n FROM lgold GROUP BY 1),
lscores AS (SELECT subject, any_value(gold) AS gold, 1 / (1 + exp(-(ln(0.12::DOUBLE / 0.88::DOUBLE)
    + sum(CAST(round(1e9 * CASE WHEN annotation = 1 THEN ln(s1 / (1 - s0)) ELSE ln((1 - s1) / s0) END) AS BIGINT)) / 1e9))) AS p, count(*) AS n_votes
  FROM lgold JOIN lusers USING (voter) GROUP BY 1),
lroc AS (SELECT p AS threshold, CAST(sum(z) OVER d AS BIGINT) AS fp, CAST(sum(o) OVER d AS BIGINT) AS tp,
  sum(z) OVER d / (sum(z) OVER ())::DOUBLE AS fpr, sum(o) OVER d / (sum(o) OVER ())::DOUBLE AS tpr FROM (
  SELECT p, count(*) FILTER (WHERE gold = 0) AS z, count(*) FILTER (WHERE gold = 1) AS o FROM lscores
  WHERE gold IN (0, 1) GROUP BY p) WINDOW d AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
"""
