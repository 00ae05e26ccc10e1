"""Parsing of dump rows and feed messages, with rows invented here."""
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from votelens.functions import parsing as P
from votelens.schema import AnswerRule
from votelens.sources import tables as S

WORDS = AnswerRule("T1", None, ("Real thing",), ("Bogus thing",))


def dump_row(id_, answer, **meta):
    return {"classification_id": str(id_), "user_id": "31", "workflow_id": "7", "created_at": "2019-03-24 17:00:38 UTC",
            "metadata": json.dumps({"session": "abc", "live_project": True, "viewport": {"width": 10}, **meta}),
            "annotations": json.dumps([{"task": "T0", "value": "x"}, {"task": "T1", "task_label": "What, \"this\"?", "value": answer}]),
            "subject_ids": "1053214149494"}


def raw(spark, *records):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "raw string")


def test_dump_rows(spark):
    p = P.parse_votes(raw(spark, dump_row(1, "Real thing"), dump_row(2, "Bogus thing", seen_before=True), dump_row(3, "Unsure")), "csv", WORDS)
    a, b = sorted(p.accepted.collect(), key=lambda r: r.classification_id)
    assert (a.annotation, a.seen_before, a.user_id, a.subject_id, a.workflow) == (1, False, 31, 1053214149494, 7)
    assert (a.session_id, a.live_project, a.time_stamp) == ("abc", True, datetime(2019, 3, 24, 17, 0, 38))
    assert (b.annotation, b.seen_before) == (0, True)
    assert [r.reason for r in p.quarantine.collect()] == ["no valid annotation"]


@pytest.mark.parametrize("task, path, true, false, annotations, want", [
    ("T1", None, ("2",), ("-1",), [{"task": "T1", "value": 2}], 1),
    ("T1", None, ("yes",), ("no",), [{"task": "T0", "value": "yes"}, {"task": "T1", "value": "no"}], 0),
    ("T0", "0.details.0.value.0", ("3",), ("-1",), [{"task": "T0", "value": [{"details": [{"value": [3]}]}]}], 1),
    ("T1", None, ("1",), ("0",), {"T0": [{"task": "T0", "value": 0}], "T1": [{"task": "T1", "value": 1}]}, 1),
])
def test_answers(spark, task, path, true, false, annotations, want):
    rec = dict(dump_row(5, "x"), annotations=json.dumps(annotations))
    p = P.parse_votes(raw(spark, rec), "csv", AnswerRule(task, path, true, false))
    assert [r.annotation for r in p.accepted.collect()] == [want]


def test_feed_message(spark):
    msg = {"id": "88", "project_id": 3, "workflow_id": 9, "subject_id": 5, "user_id": None,
           "annotations": {"T1": [{"task": "T1", "value": 1}]}, "created_at": "2018-06-22T11:29:50.609Z",
           "metadata": {"session": "zz", "live_project": False}}
    missing = {k: v for k, v in msg.items() if k != "user_id"}
    bad = dict(msg, workflow_id="nine")
    p = P.parse_votes(raw(spark, msg, missing, bad, "{not json"), "json")
    row, = p.accepted.collect()
    assert (row.classification_id, row.user_id, row.annotation, row.time_stamp) == (88, None, 1, datetime(2018, 6, 22, 11, 29, 50, 609000))
    assert sorted(r.reason for r in p.quarantine.collect()) == ["bad workflow", "missing user_id", "not json"]


def test_voter_keys_cannot_meet(spark):
    df = spark.createDataFrame([(5, "5"), (None, "5")], "user_id long, session_id string")
    assert [r[0] for r in df.select(P.voter_key(F.col("user_id"), F.col("session_id"))).collect()] == ["u:5", "s:5"]


def test_csv_files(spark, tmp_path):
    import csv
    rows = [dump_row(1, "Real thing"), dump_row(2, "Nothing")]
    with open(tmp_path / "d.csv", "w", newline="") as f:
        w = csv.DictWriter(f, rows[0].keys())
        w.writeheader()
        w.writerows(rows)
    p = S.ingest_votes_csv(spark, str(tmp_path / "d.csv"), str(tmp_path / "t"), WORDS)
    assert [r.classification_id for r in p.accepted.collect()] == [1]
    assert [r.reason for r in p.quarantine.collect()] == ["no valid annotation"]
    (tmp_path / "g.csv").write_text("subject,gold\n1,0\n2,-1\n3,\n")
    golds = S.ingest_golds_csv(spark, str(tmp_path / "g.csv"), str(tmp_path / "golds"), 1)
    assert {(r.subject, r.gold) for r in golds.collect()} == {(1, 0), (2, -1), (3, None)}
    (tmp_path / "m.csv").write_text("subject_id,project_id\n4,17\n")
    m = S.ingest_metadata_csv(spark, str(tmp_path / "m.csv"), str(tmp_path / "meta")).accepted.first()
    assert (m.subject, m.gold, m.mag) == (4, None, None)


def test_legacy_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("classification_id,user_id,gold_label,user_name,mag,seeing\n1,,None,ann,,2.5\n2,9,1,bob,18.5,\n")
    a, b = S.ingest_legacy_csv(spark, str(tmp_path / "l.csv"), ("mag", "seeing")).orderBy("classification_id").collect()
    assert (a.user_id, a.gold_label, a.metadata.mag, a.metadata.seeing) == (-1, -1, 0.0, 2.5)
    assert (b.user_id, b.gold_label, b.metadata.mag) == (9, 1, 18.5)


def test_trial_store(spark, tmp_path):
    store = S.TrialStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", (1, 10), 5, 0, .5, -1), ("a", (2, 10), 5, 0, .6, 0), ("b", (1, 10), 6, 1, .7, 1)],
                                 "experiment string, trial struct<n:int,golds:int>, subject long, gold int, p double, used_gold int")
    store.upload(rows, "a")
    store.upload(rows, "b")
    assert {tuple(r.trial) for r in store.trials("a").collect()} == {(1, 10), (2, 10)}
    assert store.rows("a", n=2).first().p == .6
    store.remove("a")
    assert [r.experiment for r in store.rows().collect()] == ["b"]
    assert store.trials("a").count() == 0
