"""Registered queries of the subpackage, and their SQL where it can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontam, hardneg, maxent, minhash, mixing, pii, quality, quoting, repair, rlz, topk, urltree

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@register("op2_url_filter", urltree.oracle())
def op2_url_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return urltree.judge(table(spark, sf_dir, "pages", "page_id", "url"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


_MIX = mixing.MixParams()


@register("op3_mix_sources", f"""WITH RECURSIVE
rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  md5('{_MIX.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM rows GROUP BY 1),
wts AS (SELECT *, [{', '.join(map(str, _MIX.weights))}][(nr - 1) % {len(_MIX.weights)} + 1]::BIGINT AS weight, {_MIX.max_epochs} * source_size AS cap FROM src),
lev AS (SELECT 0 AS i, 0::BIGINT AS l0, 1::BIGINT AS l1, -1::BIGINT AS n UNION ALL
  SELECT i + 1, l0, l1, n FROM (SELECT i, (sum(source_size) - coalesce(sum(cap) FILTER (WHERE cap * l1 <= weight * l0), 0))::BIGINT AS l0,
    (sum(weight) FILTER (WHERE cap * l1 > weight * l0))::BIGINT AS l1, count(*) FILTER (WHERE cap * l1 <= weight * l0) AS n, any_value(n) AS was
    FROM lev, wts GROUP BY i) WHERE n <> was AND l1 IS NOT NULL),
top AS (SELECT l0, l1 FROM lev ORDER BY i DESC LIMIT 1),
tgt AS (SELECT source, source_size, CASE WHEN cap * l1 <= weight * l0 THEN cap::DOUBLE ELSE (weight * l0)::DOUBLE / l1 END AS target FROM wts, top),
pos AS (SELECT r.*, t.source_size, t.target, sum(size) OVER (PARTITION BY r.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM rows r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM (SELECT *, (whole + CASE WHEN whole < {_MIX.max_epochs}
  AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END)::BIGINT AS copies FROM pos)""")
def op3_mix_sources(spark, sf_dir):
    return mixing.repetitions(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken")


@register("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


_TOP = topk.TopKParams()


@register("op9_exact_topk", f"""WITH v AS (SELECT vec_id, [floor({_TOP.scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.w, c.w)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {_TOP.query_every} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {_TOP.k}""")
def op9_exact_topk(spark, sf_dir):
    v = topk.integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), _TOP)
    return topk.top_k(v, v.where(F.col("id") % _TOP.query_every == 0), _TOP)


@register("op10_byte_bpe")
def op10_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op1_minhash_dedup")
def op1_minhash_dedup(spark, sf_dir):
    return minhash.groups(table(spark, sf_dir, "documents", "doc_id", "text"), minhash.MinHashParams(words=2))


@register("op8_pii_pseudonyms")
def op8_pii_pseudonyms(spark, sf_dir):
    return pii.replace_counted(table(spark, sf_dir, "documents", "doc_id", "text"), pii.session_params(spark))


@register("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir):
    return rlz.substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text")).drop("removed")


@register("op4_lm_score")
def op4_lm_score(spark, sf_dir):
    return maxent.score(table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op5_quote_links", quoting.ORACLE)
def op5_quote_links(spark, sf_dir):
    return quoting.conversations(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


_DECONTAM = decontam.DecontamParams()


@register("op13_decontaminate", decontam.ORACLE.replace("{window}", str(_DECONTAM.window)))
def op13_decontaminate(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), _DECONTAM)


_HARD = hardneg.HardNegParams()


@register("op11_hard_negatives", hardneg.oracle(_HARD))
def op11_hard_negatives(spark, sf_dir):
    return hardneg.mine(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), _HARD)


@register("op12_conversation_repair", repair.ORACLE)
def op12_conversation_repair(spark, sf_dir):
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
