"""The bucketed, folded state of the online scorer."""
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from votelens.streaming.store import WARM, BucketStore

USERS = T.StructType([T.StructField("voter", T.StringType()), T.StructField("n", T.LongType())])
IDS = T.StructType([T.StructField("id", T.LongType())])


def test_parts_are_digits_of_a_counter():
    s = BucketStore(None, "p", IDS, ("id",), fan=3)
    assert s.parts(0) == ["p/warm"]
    assert s.parts(5) == ["p/warm", "p/level=1/from=0", "p/level=0/from=3", "p/level=0/from=4"]
    assert s.parts(9) == ["p/warm", "p/level=2/from=0"]
    assert all(len(s.parts(k)) <= 1 + 2 * 7 for k in range(2000))
    for k in range(100):          # every batch in exactly one part
        covered = [i for p in s.parts(k)[1:] for i in range(int(p.split("=")[-1]), int(p.split("=")[-1]) + 3 ** int(p.split("=")[1].split("/")[0]))]
        assert covered == list(range(k))


@pytest.mark.parametrize("sums", [(), ("n",)])
def test_against_a_dict(spark, tmp_path, sums):
    rng = random.Random(1)
    store = BucketStore(spark, str(tmp_path / "s"), USERS, ("voter",) if sums else ("voter", "n"), sums, buckets=4, fan=3)
    write = lambda rows, batch: store.write(spark.createDataFrame(rows, USERS), batch)
    write([("u0", 100)], WARM)
    held = [[("u0", 100)]]
    for batch in range(10):
        rows = [(f"u{rng.randrange(12)}", rng.randrange(5)) for _ in range(rng.randrange(6))]
        if batch in (2, 5, 8):
            write([("never", 1)], batch)                     # a first try of the same batch, whose part and folds are overwritten
        write(rows, batch)
        held.append(rows)
        got = {tuple(r) for r in store.state(batch + 1).collect()}
        flat = [r for part in held for r in part]
        want = {(u, sum(n for v, n in flat if v == u)) for u, _ in flat} if sums else set(flat)
        assert got == want
    # earlier states can still be read
    flat = [r for part in held[:5] for r in part]
    assert {r.voter for r in store.state(4).collect()} == {u for u, _ in flat}


def test_a_batch_opens_its_own_buckets_only(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "s"), IDS, ("id",), buckets=32, fan=4)
    store.write(spark.range(5000), WARM)
    for batch in range(5):
        store.write(spark.range(5000 + 10 * batch, 5010 + 10 * batch), batch)
    mine = spark.createDataFrame([(17,), (5003,)], IDS)
    wanted = [r[0] for r in mine.select(store.bucket()).distinct().collect()]
    df = store.read(5, wanted).join(mine, "id", "left_semi")
    assert {r.id for r in df.collect()} == {17, 5003}
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    assert scans and all("PartitionFilters: [" in x and "bucket#" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    assert store.read(5, wanted).count() < 5050 * .2 and store.read(5).count() == 5050


def test_two_hundred_batches_cost_the_same(spark, tmp_path):
    """What a batch opens (parts, files and rows of its buckets) does not grow with the number of batches before it, but for the history's rows in its buckets."""
    store = BucketStore(spark, str(tmp_path / "s"), IDS, ("id",), buckets=16, fan=6)
    store.write(spark.range(0), WARM)
    opened = []
    for batch in range(200):
        ids = spark.range(3 * batch, 3 * batch + 3)
        wanted = [r[0] for r in ids.select(store.bucket()).distinct().collect()]
        parts = store.parts(batch)
        files = sum(f.endswith(".parquet") for p in parts for b in wanted for _, _, names in os.walk(f"{p}/bucket={b}") for f in names)
        opened.append((len(parts), files))
        store.write(ids, batch)
    assert max(p for p, _ in opened) <= 1 + 5 * 3
    assert all(f <= 3 * p for p, f in opened)              # three ids lie in three buckets at most
    assert sum(f for _, f in opened[150:]) < 2 * sum(f for _, f in opened[50:100])
    assert sorted(r.id for r in store.state(200).collect()) == list(range(600))


def test_scorer_reads_by_bucket(spark, tmp_path):
    """The plan of a batch against a history: every stored table is opened by its buckets."""
    from votelens.streaming.online import OnlineScorer
    golds = spark.createDataFrame([(1, 1), (2, 0)], "subject long, gold int")
    votes = spark.createDataFrame([(i, f"u{i % 40}", i % 50, i % 2) for i in range(400)], "classification_id long, voter string, subject long, annotation int")
    scorer = OnlineScorer(spark, str(tmp_path / "o"), golds, buckets=32).start_cold()
    scorer.process(votes, 0)
    batch = spark.createDataFrame([(7, "u7", 7, 1), (900, "u3", 2, 0)], votes.schema)
    touched = scorer.touched(batch)
    assert all(1 <= len(b) <= 2 for b in touched.values())
    for name in ("ids", "pairs", "users", "subjects"):
        df = scorer.known(name, 1, batch, touched)
        text = df._jdf.queryExecution().executedPlan().toString()
        scans = [x.split("PartitionFilters: [")[1].split("]")[0] for x in text.splitlines() if "FileScan parquet" in x]
        assert len(scans) == 2 and sum("bucket#" in x for x in scans) == 1          # the part from before the first batch is empty here: it has no buckets
    scorer.process(batch, 1)
    assert scorer.stored_votes().count() == 401
    assert {r.classification_id for r in scorer.emitted().where(F.col("batch") == 1).collect()} == {900}


def test_large_batches_are_not_broadcast(spark, tmp_path, monkeypatch):
    """A large batch meets state by shuffles, so nothing that grows with it passes the driver; what is scored stays the same."""
    from votelens.streaming import online
    golds = spark.createDataFrame([(s, s % 2) for s in range(50)], "subject long, gold int")
    votes = spark.createDataFrame([(i, f"u{i % 40}", i * 7 % 50, i % 2) for i in range(400)], "classification_id long, voter string, subject long, annotation int")
    got = []
    for rows in (1000, 0):
        monkeypatch.setattr(online, "BROADCAST_ROWS", rows)
        scorer = online.OnlineScorer(spark, str(tmp_path / f"o{rows}"), golds, buckets=4, fan=2).start_cold()
        for k in range(2):
            scorer.process(votes.where(F.col("classification_id") % 2 == k), k)
        got.append(sorted(map(tuple, scorer.emitted().select("classification_id", "subject", "llr").collect())))
    assert got[0] == got[1] and len(got[0]) > 0
    batch = votes.where("classification_id < 9")
    for name in scorer.state:
        plan = scorer.known(name, 2, batch, scorer.touched(batch), True)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_feed_is_dealt_out(spark, tmp_path):
    """A delivery of the feed is written by many tasks, whatever the files the events lie in, and by its own ids only."""
    from votelens.catalog.parsing_q import messages
    from votelens.catalog.trial_q import delivery
    events = spark.createDataFrame([(k, "purchase", 1., k, '{"k": 5}') for k in range(4000)], "event_id long, event_type string, value double, user_id long, props string") \
        .withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1)
    got = delivery(events, 100, 1100)
    assert got.rdd.getNumPartitions() >= 4
    assert {r.raw for r in got.collect()} == {r.raw for r in messages(events.where("event_id between 100 and 1099")).collect()}
