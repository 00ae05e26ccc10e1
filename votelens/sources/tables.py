"""Reading and writing of the vote, gold, score, trial and run tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parsing
from ..schema import SCORES, USER_SCORES, AnswerRule

_CSV = {"header": True, "multiLine": True, "escape": '"'}


# ---- votes -----------------------------------------------------------------------------------

def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """A CSV dump as one JSON record per row (all cells are texts). Quoted cells may hold JSON and line
    breaks."""
    rows = spark.read.options(**_CSV).csv(path)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("raw"))


def ingest_votes_csv(spark: SparkSession, path: str, table: str, answer: AnswerRule = AnswerRule()) -> parsing.Parsed:
    """Parse a dump and replace the vote table at ``table``; bad rows go to ``table``_quarantine."""
    parsed = parsing.parse_votes(csv_records(spark, path), "csv", answer)
    return _replace(parsed, table)


def ingest_votes_json(spark: SparkSession, path: str, table: str | None = None,
                      answer: AnswerRule = AnswerRule()) -> parsing.Parsed:
    """Parse feed messages, one JSON object per line."""
    parsed = parsing.parse_votes(spark.read.text(path).toDF("raw"), "json", answer)
    return parsed if table is None else _replace(parsed, table)


def stream_votes_json(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The feed as a stream of raw messages; parse each batch with ``parse_votes``."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).toDF("raw")


def _replace(parsed: parsing.Parsed, table: str) -> parsing.Parsed:
    """Write accepted and rejected rows in one pass (partition ``accepted``) and read them back."""
    ok = F.col("reason").isNull()
    parsed.checked.withColumn("raw", F.when(~ok, F.col("raw"))).withColumn("accepted", ok).write.mode(
        "overwrite").partitionBy("accepted").parquet(table)
    schema = parsed.checked.schema.add("accepted", "boolean")
    return parsing.Parsed(parsed.checked.sparkSession.read.schema(schema).parquet(table), parsed.columns,
                          F.col("accepted"))


def ingest_legacy_csv(spark: SparkSession, path: str, metadata: tuple) -> DataFrame:
    """The older dump: blanks -> 0 (user_id -> -1), 'None' -> -1, metadata columns folded into a struct."""
    rows = spark.read.option("header", True).csv(path)

    def number(name, type_, blank):
        c = F.col(name)
        return F.when(c.isNull() | (F.trim(c) == ""), F.lit(blank)).when(c == "None", F.lit(-1)) \
            .otherwise(c.try_cast(type_)).cast(type_).alias(name)

    ints = [c for c in rows.columns if c not in metadata and c not in ("user_name", "created_at")]
    return rows.select(*[number(c, "bigint", -1 if c == "user_id" else 0) for c in ints],
                       *[c for c in ("user_name", "created_at") if c in rows.columns],
                       F.struct(*[number(m, "double", 0) for m in metadata]).alias("metadata"))


# ---- golds and metadata ----------------------------------------------------------------------

def ingest_golds_csv(spark: SparkSession, path: str, table: str, load_seq: int) -> DataFrame:
    """Append (subject, gold) rows; ``load_seq`` tells later loads from earlier ones."""
    parsed = parsing.parse_golds(csv_records(spark, path))
    parsed.accepted.withColumn("load_seq", F.lit(load_seq).cast("bigint")).write.mode("append").parquet(table)
    return spark.read.parquet(table)


def ingest_metadata_csv(spark: SparkSession, path: str, table: str) -> parsing.Parsed:
    """Replace the subject table. Columns the file lacks are taken as absent values."""
    raw = csv_records(spark, path)
    from dataclasses import replace
    rules = tuple(r if r.name == "subject" else replace(r, default=None) for r in parsing.METADATA_RULES)
    return _replace(parsing.parse_metadata(raw, rules=rules), table)


def golds_from_votes(votes: DataFrame, table: str) -> DataFrame:
    """The last gold label the votes carry per subject, written as the subject table."""
    out = votes.groupBy("subject").agg(F.max_by("gold_label", "seq").alias("gold"))
    out.write.mode("overwrite").parquet(table)
    return votes.sparkSession.read.parquet(table)


def subject_set(votes: DataFrame, table: str, columns=("subject", "gold", "diff")) -> DataFrame:
    votes.select(*columns).distinct().write.mode("overwrite").parquet(table)
    return votes.sparkSession.read.parquet(table)


# ---- results ---------------------------------------------------------------------------------

def scores_to_csv(scores: DataFrame, path: str) -> None:
    scores.select("subject", "gold", "p").write.mode("overwrite").csv(path)


def scores_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Keeps the stored golds."""
    return spark.read.schema(SCORES).csv(path)


def user_scores_to_csv(users: DataFrame, path: str) -> None:
    users.select("voter", "s0", "s1", "n").write.mode("overwrite").csv(path)


def user_scores_from_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USER_SCORES).csv(path)


def predictions_to_csv(preds: DataFrame, path: str) -> None:
    preds.select("file", "pred", "label").write.mode("overwrite").csv(path)


def query_out(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Send a result to a named table (stored at ``path`` if given)."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def export_flat_votes(votes: DataFrame, fields=None) -> DataFrame:
    """Metadata fields lifted to the top level (all of them by default)."""
    names = fields or votes.schema["metadata"].dataType.fieldNames()
    return votes.select(*[c for c in votes.columns if c != "metadata"], *[F.col(f"metadata.{n}").alias(n) for n in names])


def ledger_dump(scored_steps: DataFrame) -> DataFrame:
    """Every counted vote with its place in its subject's and its voter's list."""
    return scored_steps.select("subject", "vote_order", "voter", "annotation", "s0", "s1", "p")


# ---- trials, plots, statistics ---------------------------------------------------------------

class TrialStore:
    """Trial rows partitioned by experiment, and an index with one row per trial."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def upload(self, rows: DataFrame, experiment: str) -> None:
        """Append an experiment's rows, then list its trials from its own partition."""
        rows.where(F.col("experiment") == experiment).drop("experiment").write.mode("append").parquet(
            f"{self.path}/rows/experiment={experiment}")
        index = self.rows(experiment).select("trial").distinct()
        index.write.mode("overwrite").parquet(f"{self.path}/index/experiment={experiment}")

    def remove(self, experiment: str) -> None:
        """Overwrite the experiment's partition with nothing left in it."""
        for part in ("rows", "index"):
            schema = self.spark.read.parquet(f"{self.path}/{part}").drop("experiment").schema
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(
                f"{self.path}/{part}/experiment={experiment}")

    def trials(self, experiment: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/index")
        return df if experiment is None else df.where(F.col("experiment") == experiment)

    def rows(self, experiment: str | None = None, **trial) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/rows")
        if experiment is not None:
            df = df.where(F.col("experiment") == experiment)
        for k, v in trial.items():
            df = df.where(F.col(f"trial.{k}") == v)
        return df


class PlotStore:
    """Plot points by experiment name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def upload(self, points: DataFrame, name: str) -> None:
        points.withColumn("name", F.lit(name)).write.mode("append").partitionBy("name").parquet(self.path)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("name") == name).drop("name")


class StatsLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, stats: DataFrame, run_seq: int) -> None:
        stats.withColumn("run_seq", F.lit(run_seq).cast("bigint")).write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        return self.spark.read.parquet(self.path).orderBy(F.desc("run_seq")).limit(1)


class StateSnapshot:
    """A whole run as two tables: voter counters and subject scores."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, users: DataFrame, subjects: DataFrame) -> None:
        users.write.mode("overwrite").parquet(f"{self.path}/users")
        subjects.write.mode("overwrite").parquet(f"{self.path}/subjects")

    def load(self) -> tuple[DataFrame, DataFrame]:
        return self.spark.read.parquet(f"{self.path}/users"), self.spark.read.parquet(f"{self.path}/subjects")


def run_manifest(params, golds: DataFrame, scores: DataFrame, users: DataFrame) -> DataFrame:
    """Parameters, gold counts by class and statistics as (name, value) rows."""
    from ..operators import aggregates as A
    spark = golds.sparkSession
    settings = spark.createDataFrame([(k, float(getattr(params, k))) for k in ("p0", "gamma", "mdr", "fpr")],
                                     "name string, value double")
    counts = A.gold_counts(golds).unpivot([], ["n_none", "n_bogus", "n_real"], "name", "value")
    stats = A.all_stats(scores, users).unpivot(["name"], ["mean", "median", "stdev"], "what", "value").select(
        F.concat_ws("_", "name", "what").alias("name"), "value")
    return settings.unionByName(counts.withColumn("value", F.col("value").cast("double"))).unionByName(stats)


# ---- images and captures ---------------------------------------------------------------------

def load_capture_csvs(spark: SparkSession, gold: str, consensus: str, links: str) -> tuple[DataFrame, ...]:
    return tuple(spark.read.option("header", True).csv(p) for p in (gold, consensus, links))


def image_list(spark: SparkSession, list_path: str, vectors: DataFrame) -> DataFrame:
    """Decoded image vectors of the files named in a text list."""
    names = spark.read.text(list_path).select(F.rtrim("value").alias("file"))
    return names.join(vectors, "file")
