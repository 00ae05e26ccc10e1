"""Online scoring as a Structured Streaming job.

Each micro-batch is parsed, freed of ids and pairs already stored, and scored with the state the earlier
batches left. State is kept as increments: a voter's counters and a subject's log-odds are sums, so
batch k writes what it adds, and the state before batch k is the sum over batches below k. The ids, the counted (voter, subject)
pairs, the voters and the subjects are bucketed tables (``store.BucketStore``): a batch opens the buckets of its own keys only, whatever the length of
the history. Stored votes and emitted scores are logs that no batch reads. Everything is
written per batch number, and a repeated batch overwrites its own part only: replays change nothing. Batches are numbered from 0 without gaps, as ``foreachBatch``
numbers them.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T, functions as F

from ..operators import consensus
from ..params import Params
from .store import WARM, BucketStore

BATCH = "batch"
#: Batches of more rows, and logs, meet state and labels by shuffles: what is broadcast passes the driver, and it would grow with the batch.
BROADCAST_ROWS = 100_000

_VOTES = T.StructType([T.StructField("classification_id", T.LongType()), T.StructField("voter", T.StringType()),
                       T.StructField("subject", T.LongType()), T.StructField("annotation", T.IntegerType()),
                       T.StructField("seq", T.LongType()), T.StructField("scored", T.BooleanType())])
_EMITTED = T.StructType([T.StructField("classification_id", T.LongType()), T.StructField("subject", T.LongType()),
                         T.StructField("llr", T.LongType()), T.StructField("score", T.DoubleType())])
_TABLES = {"votes": _VOTES, "emitted": _EMITTED}
_COUNTERS = ("seen0", "match0", "seen1", "match1", "n")
#: Bucketed tables: schema, key columns, columns that add up.
_STATE = {
    "ids": ("classification_id long", ("classification_id",), ()),
    "pairs": ("voter string, subject long", ("voter", "subject"), ()),
    "users": ("voter string, " + ", ".join(f"{c} long" for c in _COUNTERS), ("voter",), _COUNTERS),
    "subjects": ("subject long, llr long, n_votes long", ("subject",), ("llr", "n_votes")),
}


def _side(df: DataFrame, large: bool) -> DataFrame:
    """A side of a join: of a large batch it is shuffled."""
    return df.hint("merge") if large else df


@dataclass
class OnlineScorer:
    """``buckets``: of each state table; ``fan``: parts that are folded into one."""
    spark: SparkSession
    path: str
    golds: DataFrame
    params: Params = field(default_factory=Params)
    buckets: int = 64
    fan: int = 8

    def __post_init__(self):
        self.state = {n: BucketStore(self.spark, f"{self.path}/{n}", T.StructType.fromDDL(schema), keys, sums, self.buckets, self.fan)
                      for n, (schema, keys, sums) in _STATE.items()}

    # ---- logs --------------------------------------------------------------------------------
    def _write(self, name: str, df: DataFrame, batch: int) -> None:
        df.select(*_TABLES[name].fieldNames()).write.mode("overwrite").parquet(self._part(name, batch))

    def _part(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/{BATCH}={batch}"

    def _mine(self, name: str, batch: int) -> DataFrame:
        """A batch's own part of a log: no other part is listed."""
        return self.spark.read.schema(_TABLES[name]).parquet(self._part(name, batch))

    def _log(self, name: str) -> DataFrame:
        schema = T.StructType([*_TABLES[name].fields, T.StructField(BATCH, T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _last(self) -> int:
        """One more than the newest batch: counted for results, never by a batch."""
        newest = self._log("votes").agg(F.max(BATCH)).first()[0]
        return 0 if newest is None else max(newest + 1, 0)

    def users(self, below: int | None = None) -> DataFrame:
        return self.state["users"].state(self._last() if below is None else below)

    def subjects(self, below: int | None = None) -> DataFrame:
        return self.state["subjects"].state(self._last() if below is None else below)

    # ---- starting ----------------------------------------------------------------------------
    def start_cold(self) -> "OnlineScorer":
        return self._start(None)

    def warm_start(self, log: DataFrame) -> "OnlineScorer":
        """State from an ordered log (dump, then stored online votes): ``classification_id, voter,
        subject, annotation, seq``. Ids that the log repeats count once, at their first place."""
        first = log.groupBy("classification_id").agg(F.min(F.struct("seq", "voter", "subject", "annotation")).alias("v"))
        return self._start(first.select("classification_id", "v.*"))

    def _start(self, log: DataFrame | None) -> "OnlineScorer":
        if log is None:
            for name, store in self.state.items():
                store.write(self.spark.createDataFrame([], store.schema), WARM)
            for name, schema in _TABLES.items():
                self._write(name, self.spark.createDataFrame([], schema), WARM)
        else:
            self._score(log, WARM, None)
        return self

    # ---- one micro-batch ---------------------------------------------------------------------
    def touched(self, incoming: DataFrame) -> dict:
        """Per state table the buckets that hold the batch's keys: at most ``buckets`` numbers each."""
        row = incoming.agg(*[F.collect_set(s.bucket()).alias(n) for n, s in self.state.items()]).first()
        return {n: sorted(row[n]) for n in self.state}

    def known(self, name: str, batch: int, incoming: DataFrame, touched: dict, large: bool = False) -> DataFrame:
        """Stored rows of the batch's keys. The batch side is a written part, so Spark knows its size and broadcasts it where that is small; a ``large`` one never is."""
        keys = list(self.state[name].keys)
        return self.state[name].read(batch, touched[name]).join(_side(incoming.select(*keys), large), keys, "left_semi")

    def process(self, votes: DataFrame, batch: int) -> None:
        """``foreachBatch`` body. ``votes``: ``classification_id, voter, subject, annotation``. Ids repeated
        in the batch or stored by an earlier one are dropped."""
        once = votes.groupBy("classification_id").agg(F.min(F.struct("voter", "subject", "annotation")).alias("v"))
        part = f"{self.path}/incoming/{BATCH}={batch}"
        once.select("classification_id", "v.*").write.mode("overwrite").parquet(part)
        incoming = self.spark.read.schema("classification_id long, voter string, subject long, annotation int").parquet(part)
        came = incoming, self.touched(incoming), incoming.count() > BROADCAST_ROWS
        fresh = incoming.join(_side(self.known("ids", batch, *came), came[2]), "classification_id", "left_anti")
        self._score(fresh.withColumn("seq", F.col("classification_id")), batch, came)

    def _score(self, votes: DataFrame, batch: int, came: tuple | None) -> None:
        """``came``: the batch as it came, its buckets and whether it is large; none for the log of a warm start, before which there is nothing."""
        large = came is None or came[2]
        first = consensus.first_vote_per_pair(votes)
        if came:
            first = first.join(_side(self.known("pairs", batch, *came), large), ["voter", "subject"], "left_anti")
        all_ids = votes.join(_side(first.select("voter", "subject", "seq", F.lit(True).alias("_hit")), large),
                             ["voter", "subject", "seq"], "left")
        self._write("votes", all_ids.withColumn("scored", F.col("_hit").isNotNull()), batch)
        # from here on the batch is read back from its own part, so it is computed once
        stored = self._mine("votes", batch)
        mine = stored.where("scored").drop("scored")
        labelled = consensus.votes_with_gold(mine, _side(self.golds, large))

        adds = labelled.groupBy("voter").agg(
            *[F.sum(c.cast("bigint")).alias(n) for n, c in consensus._counters().items()], F.count("*").alias("n"))
        inside = consensus.user_prefix_matrix(labelled, self.params, source=mine)
        matrix = ("seen0", "match0", "seen1", "match1")
        if came:
            before = self.known("users", batch, *came).groupBy("voter").agg(*[F.sum(c).alias(f"b_{c}") for c in matrix])
            inside = inside.join(_side(before, large), "voter", "left")
        g = self.params.gamma
        total = {c: F.col(c) + F.coalesce(F.col(f"b_{c}"), F.lit(0)) if came else F.col(c) for c in matrix}
        weighed = inside.withColumns({"s0": (total["match0"] + g) / (total["seen0"] + 2 * g),
                                      "s1": (total["match1"] + g) / (total["seen1"] + 2 * g)}) \
            .select("classification_id", "voter", "subject", "seq", "annotation", "s0", "s1")
        # per-vote record: running log-odds inside the batch on top of the stored ones
        steps = consensus.subject_prefix_scores(weighed, self.params, source=mine)
        odds = F.col("log_odds")
        if came:
            prior = self.known("subjects", batch, *came).groupBy("subject").agg(F.sum("llr").alias("_before"))
            steps, odds = steps.join(_side(prior, large), "subject", "left"), odds + F.coalesce("_before", F.lit(0))
        scored = steps.withColumn("score", consensus.posterior(odds, None, self.params))
        self._write("emitted", scored.withColumn("llr", consensus.log_ratio()), batch)
        self.state["ids"].write(stored.select("classification_id"), batch)
        self.state["pairs"].write(mine.select("voter", "subject"), batch)
        self.state["users"].write(adds, batch)
        self.state["subjects"].write(self._mine("emitted", batch).groupBy("subject").agg(
            F.sum("llr").alias("llr"), F.count("*").alias("n_votes")), batch)

    # ---- results -----------------------------------------------------------------------------
    def emitted(self) -> DataFrame:
        """One (subject, score) record per processed vote."""
        return self._log("emitted").where(F.col(BATCH) >= 0)

    def snapshot(self) -> DataFrame:
        """Current score of every subject with votes."""
        return self.subjects().select(
            "subject", consensus.posterior(F.col("llr"), None, self.params).alias("p"), "n_votes")

    def stored_votes(self) -> DataFrame:
        return self._log("votes")


def run_stream(stream: DataFrame, scorer: OnlineScorer, checkpoint: str, parse=None, available_now: bool = True):
    """Attach the scorer to a streaming frame. ``parse`` maps raw rows to the four vote columns."""
    def body(df: DataFrame, batch: int) -> None:
        scorer.process(parse(df) if parse else df, batch)

    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
