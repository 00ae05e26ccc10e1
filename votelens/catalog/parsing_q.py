"""Queries: parsing rules (C) and sources / sinks (S), on records built from the event table."""
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import consensus as C, evaluate as E
from ..schema import AnswerRule, FieldRule
from ..session import scratch_path
from ..sources import tables as S
from .base import query
from .scoring import _TRAIN

ANSWERS = AnswerRule("T1", None, ("purchase", "click"), ("view", "error"))


def messages(events):
    """Feed messages (nested objects) made from the events: signups carry no valid answer, views no user,
    and only repeated views carry ``seen_before``."""
    text = lambda c: F.col(c).cast("string")
    seen = F.when(F.col("value") >= 100, F.lit(',"seen_before":true')).otherwise("")
    user = F.when(F.col("event_type") == "view", "null").otherwise(text("user_id"))
    return events.select(F.concat(
        F.lit('{"id":"'), text("event_id"), F.lit('","workflow_id":7,"subject_id":'), F.get_json_object("props", "$.k"),
        F.lit(',"user_id":'), user, F.lit(',"annotations":{"T0":[{"task":"T0","value":"no"}],"T1":[{"task":"T1","value":"'),
        F.col("event_type"), F.lit('"}]},"metadata":{"session":"s'), text("user_id"), F.lit('","live_project":'),
        (F.col("event_type") != "error").cast("string"), seen, F.lit('},"created_at":"'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"}')).alias("raw"))


def dump(i):
    """The same as dump rows: metadata and annotations are JSON texts, ids and null users plain texts."""
    e = i.raw("events")
    seen = F.when(F.col("value") >= 100, F.lit(',"seen_before":true')).otherwise("")
    return e.select(
        F.col("event_id").cast("string").alias("classification_id"), F.lit("nobody").alias("user_name"),
        F.when(F.col("event_type") == "view", "null").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.lit("7").alias("workflow_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("created_at"),
        F.concat(F.lit('{"session":"s'), F.col("user_id").cast("string"), F.lit('","live_project":'),
                 (F.col("event_type") != "error").cast("string"), seen, F.lit("}")).alias("metadata"),
        F.concat(F.lit('[{"task":"T0","value":"no"},{"task":"T1","value":"'), F.col("event_type"), F.lit('"}]')).alias("annotations"),
        F.get_json_object("props", "$.k").alias("subject_ids"))


_COLS = "classification_id, user_id, workflow, subject_id, seen_before, live_project, session_id, annotation"
_WANT = """SELECT event_id AS classification_id, CASE WHEN event_type <> 'view' THEN user_id END AS user_id, CAST(7 AS BIGINT) AS workflow,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS subject_id, value >= 100 AS seen_before, event_type <> 'error' AS live_project,
  's' || user_id AS session_id, CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS annotation,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_stamp FROM events WHERE event_type <> 'signup'"""


def _want(df):
    return df.select(*_COLS.split(", "), F.date_format("time_stamp", "yyyy-MM-dd HH:mm:ss").alias("time_stamp"))


@query("parse_votes", _WANT)
def c8(i):
    return _want(P.parse_votes(messages(i.raw("events")), "json", ANSWERS).accepted)


@query("parse_votes_dump", _WANT)
def c8b(i):
    raw = dump(i)
    rec = raw.select(F.to_json(F.struct(*raw.columns)).alias("raw"))
    return _want(P.parse_votes(rec, "csv", ANSWERS).accepted)


@query("parse_quarantine", "SELECT event_id::VARCHAR AS id, 'no valid annotation' AS reason FROM events WHERE event_type = 'signup'")
def c7q(i):
    q = P.parse_votes(messages(i.raw("events")), "json", ANSWERS).quarantine
    return q.select(F.get_json_object("raw", "$.id").alias("id"), "reason")


@query("nav_path", """SELECT event_id::VARCHAR AS id, event_type AS value, 's' || user_id AS session FROM events""")
def c1(i):
    r = messages(i.raw("events")).select(P.as_json(F.col("raw")).alias("r"))
    return r.select(P.nav_path(F.col("r"), "id").alias("id"), P.nav_path(F.col("r"), "annotations.T1.0.value").alias("value"),
                    P.nav_path(F.col("r"), "metadata.session").alias("session"))


@query("remap", """SELECT event_id::VARCHAR AS id, CASE WHEN value >= 100 THEN 'true' ELSE 'false' END AS seen,
  CASE WHEN event_type <> 'view' THEN user_id::VARCHAR END AS user_id, TRUE AS found FROM events""")
def c2(i):
    r = messages(i.raw("events")).select(P.as_json(F.col("raw")).alias("r"))
    seen, _ = P.remap(F.col("r"), FieldRule("seen", any_source=("metadata.seen_before",), default=False), "json")
    user, found = P.remap(F.col("r"), FieldRule("user_id", any_source=("uid",)), "json")
    return r.select(P.nav_path(F.col("r"), "id").alias("id"), seen.alias("seen"), user.alias("user_id"), found.alias("found"))


@query("cast_value", """SELECT event_id, TRY_CAST(nullif(t, 'None') AS INTEGER) AS as_int, CASE t WHEN 'None' THEN NULL ELSE TRY_CAST(t AS DOUBLE) END AS as_double,
  t <> 'None' AND TRY_CAST(t AS INTEGER) IS NULL AS bad_int, b = 'true' AS as_bool FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'None'
  WHEN event_type = 'error' THEN 'x' ELSE user_id::VARCHAR END AS t, CASE WHEN value >= 100 THEN 'true' ELSE 'false' END AS b FROM events)
  WHERE t IS NOT NULL""", r="as_double")
def c3(i):
    t = F.when(F.col("event_type") == "view", "None").when(F.col("event_type") == "error", "x").otherwise(F.col("user_id").cast("string"))
    b = F.when(F.col("value") >= 100, "True").otherwise("false")
    e = i.raw("events").select("event_id", t.alias("t"), b.alias("b"))
    return e.select("event_id", P.cast_value(F.col("t"), "int").alias("as_int"), P.cast_value(F.col("t"), "double").alias("as_double"),
                    P.cast_failed(F.col("t"), "int").alias("bad_int"), P.cast_value(F.col("b"), "boolean").alias("as_bool"))


@query("parse_ts", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dump_time, epoch_us(ts) // 1000 AS feed_ms FROM events")
def c4(i):
    e = i.raw("events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("a"),
                               F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("b"))
    return e.select("event_id", F.date_format(P.parse_time(F.col("a")), "yyyy-MM-dd HH:mm:ss").alias("dump_time"),
                    F.unix_millis(P.parse_time(F.col("b"))).alias("feed_ms"))


@query("parse_json_field", "SELECT event_id, event_type <> 'error' AS parsed FROM events")
def c5(i):
    t = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken"), F.col("props"))).otherwise(F.col("props"))
    return i.raw("events").select("event_id", P.as_json(t).isNotNull().alias("parsed"))


@query("find_task", "SELECT event_id, event_type AS from_list, event_type AS from_map, event_type <> event_type AS missing FROM events")
def c6(i):
    as_list = F.concat(F.lit('[{"task":"T0","value":1},{"task":"T1","value":"'), F.col("event_type"), F.lit('"}]'))
    as_map = F.concat(F.lit('{"T1":[{"task":"T1","value":"'), F.col("event_type"), F.lit('"}]}'))
    text = lambda j, task: F.try_variant_get(P.find_task(P.as_json(j), task)["value"], "$", "string")
    return i.raw("events").select("event_id", text(as_list, "T1").alias("from_list"), text(as_map, "T1").alias("from_map"),
                                  text(as_list, "T9").isNotNull().alias("missing"))


@query("map_annotation", """SELECT event_id, CASE WHEN event_type IN ('purchase', 'click') THEN 1 WHEN event_type IN ('view', 'error') THEN 0 END AS vote FROM events
  WHERE event_type <> 'signup'""")
def c7(i):
    j = F.concat(F.lit('[{"details":[{"value":["'), F.col("event_type"), F.lit('"]}]}]'))
    rule = AnswerRule("T0", "0.details.0.value.0", ANSWERS.true, ANSWERS.false)
    return i.raw("events").select("event_id", P.map_answer(P.as_json(j), rule).alias("vote")).where("vote is not null")


def subject_records(i):
    m = i.meta
    return m.select(F.to_json(F.struct(F.col("subject").cast("string").alias("subject_id"), F.col("gold").cast("string").alias("gold_label"),
                                       F.col("object_id").cast("string").alias("object_id"), F.col("machine_score").cast("string").alias("machine_score"),
                                       F.col("mag").cast("string").alias("mag"), F.lit("").alias("mag_err"))).alias("raw"))


@query("parse_metadata", "SELECT subject, gold, object_id, machine_score, mag FROM meta", r="machine_score mag")
def c9(i):
    return P.parse_metadata(subject_records(i)).accepted.select("subject", "gold", "object_id", "machine_score", "mag")


@query("parse_golds", "SELECT subject, gold FROM golds")
def c10(i):
    return P.parse_golds(subject_records(i)).accepted


# ---- sources and sinks -----------------------------------------------------------------------

@query("ingest_votes_csv", _WANT)
def s1(i):
    path, table = scratch_path(i.spark, "dump"), scratch_path(i.spark, "votes")
    dump(i).write.option("header", True).option("escape", '"').csv(path)
    return _want(S.ingest_votes_csv(i.spark, path, table, ANSWERS).accepted)


@query("ingest_votes_json", _WANT)
def s2(i):
    path, table = scratch_path(i.spark, "feed"), scratch_path(i.spark, "votes")
    messages(i.raw("events")).write.text(path)
    return _want(S.ingest_votes_json(i.spark, path, table, ANSWERS).accepted)


@query("ingest_golds_csv", """SELECT subject, CAST(1 AS BIGINT) AS load_seq, gold FROM golds UNION ALL SELECT subject, 2, 1 - gold FROM golds""")
def s3(i):
    table = scratch_path(i.spark, "golds")
    for seq, gold in ((1, F.col("gold")), (2, 1 - F.col("gold"))):
        path = scratch_path(i.spark, "goldcsv")
        i.golds.select("subject", gold.alias("gold")).write.option("header", True).csv(path)
        out = S.ingest_golds_csv(i.spark, path, table, seq)
    return i.spark.read.parquet(table).select("subject", "load_seq", "gold")


@query("ingest_metadata_csv", "SELECT subject, gold, object_id, mag FROM meta", r="mag")
def s4(i):
    path, table = scratch_path(i.spark, "metacsv"), scratch_path(i.spark, "subjects")
    i.meta.select(F.col("subject").alias("subject_id"), "gold", "object_id", "mag").write.option("header", True).csv(path)
    return S.ingest_metadata_csv(i.spark, path, table).accepted.select("subject", "gold", "object_id", "mag")


@query("golds_from_votes", "SELECT l_partkey AS subject, arg_max(l_linenumber % 3 - 1, (l_orderkey * 8 + l_linenumber) * 8 + l_linenumber) AS gold FROM lineitem GROUP BY 1")
def s5(i):
    v = i.raw("lineitem").select(F.col("l_partkey").alias("subject"), (F.col("l_linenumber") % 3 - 1).alias("gold_label"),
                                 ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 8 + F.col("l_linenumber")).alias("seq"))
    return S.golds_from_votes(v, scratch_path(i.spark, "subjects"))


@query("subject_set", "SELECT DISTINCT l_partkey AS subject, l_linenumber % 3 - 1 AS gold, l_tax AS diff FROM lineitem", r="diff")
def s6(i):
    v = i.raw("lineitem").select(F.col("l_partkey").alias("subject"), (F.col("l_linenumber") % 3 - 1).alias("gold"), F.col("l_tax").alias("diff"))
    return S.subject_set(v, scratch_path(i.spark, "subject_set"))


@query("ingest_legacy_csv", """SELECT event_id AS classification_id, CASE WHEN event_type = 'view' THEN -1 ELSE user_id END AS user_id,
  CAST(CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'click' THEN 0 ELSE 1 END AS BIGINT) AS gold_label,
  CASE WHEN event_type = 'click' THEN 0 ELSE value END AS mag FROM events""", r="mag")
def s7(i):
    t = F.col("event_type")
    path = scratch_path(i.spark, "legacy")
    i.raw("events").select(
        F.col("event_id").alias("classification_id"), F.when(t != "view", F.col("user_id")).alias("user_id"),
        F.when(t == "error", "None").when(t == "click", F.lit(None)).otherwise("1").alias("gold_label"),
        F.when(t != "click", F.col("value")).alias("mag")).write.option("header", True).csv(path)
    out = S.ingest_legacy_csv(i.spark, path, ("mag",))
    return out.select("classification_id", "user_id", "gold_label", "metadata.mag")


@query("scores_csv", "SELECT subject, gold, p FROM lscores", r="p")
def s8(i):
    path = scratch_path(i.spark, "scores")
    S.scores_to_csv(i.lscores, path)
    return S.scores_from_csv(i.spark, path)


@query("user_scores_csv", "SELECT voter, s0, s1, n FROM users", r="s0 s1")
def s9(i):
    path = scratch_path(i.spark, "user_scores")
    S.user_scores_to_csv(i.users, path)
    return S.user_scores_from_csv(i.spark, path)


@query("stats_log", """SELECT count(*) AS votes, count(DISTINCT user_id) AS users, count(DISTINCT subject_id) AS subjects, count(*) FILTER (WHERE NOT seen_before) AS first_votes,
  count(*) FILTER (WHERE seen_before) AS duplicates, CAST(2 AS BIGINT) AS run_seq FROM vlog""")
def s12(i):
    from ..operators import aggregates as A
    log = S.StatsLog(i.spark, scratch_path(i.spark, "stats"))
    v = i.vlog.withColumn("voter", P.voter_key(F.col("user_id"), F.col("session_id")))
    log.append(A.dump_stats(v.where("seen_before")), 1)
    log.append(A.dump_stats(v), 2)
    return log.latest()


@query("query_out", "SELECT annotation, count(*) AS n FROM vlog GROUP BY 1")
def s13(i):
    path = scratch_path(i.spark, "out")
    return S.query_out(i.vlog.groupBy("annotation").agg(F.count("*").alias("n")), "out_" + path[-32:], path)


@query("predictions_csv", "SELECT 'obj' || (vec_id // 3) || '_' || label || '.' || vec_id || '.img' AS file, CAST(embedding[1] AS DOUBLE) AS pred, label % 2 AS label FROM embeddings", r="pred")
def s14(i):
    path = scratch_path(i.spark, "predictions")
    S.predictions_to_csv(i.images.select("file", F.col("x")[0].alias("pred"), F.col("y").alias("label")), path)
    return i.spark.read.schema("file string, pred double, label int").csv(path)


@query("state_snapshot", "SELECT subject, p, n_votes FROM sscores", r="p")
def s15(i):
    """Save a run, load it, and score the votes with the loaded voter table."""
    snap = S.StateSnapshot(i.spark, scratch_path(i.spark, "snapshot"))
    snap.save(i.users, i.sscores)
    users, _ = snap.load()
    return C.subject_scores(C.apply_user_scores(i.first, users), i.params)


@query("export_flat_votes", "SELECT classification_id, subject_id, mag, seeing FROM vlog JOIN meta ON subject_id = subject", r="mag seeing")
def s16(i):
    v = i.vlog.join(i.meta.select(F.col("subject").alias("subject_id"), F.struct("mag", "seeing").alias("metadata")), "subject_id")
    return S.export_flat_votes(v.select("classification_id", "subject_id", "metadata"))


_MANIFEST = """, st AS (SELECT 's0' AS name, s0 AS v FROM users UNION ALL SELECT 's1', s1 FROM users UNION ALL SELECT 'p', p FROM sscores),
  sa AS (SELECT name, avg(v) AS mean, quantile_cont(round(v, 9), .5) AS median, stddev_pop(v) AS stdev FROM st GROUP BY 1)
SELECT 'p0' AS name, .12::DOUBLE AS value UNION ALL SELECT 'gamma', 5 UNION ALL SELECT 'mdr', .1 UNION ALL SELECT 'fpr', .01
UNION ALL SELECT 'n_none', count(*) FILTER (WHERE gold = -1) FROM golds UNION ALL SELECT 'n_bogus', count(*) FILTER (WHERE gold = 0) FROM golds
UNION ALL SELECT 'n_real', count(*) FILTER (WHERE gold = 1) FROM golds
UNION ALL SELECT name || '_mean', mean FROM sa UNION ALL SELECT name || '_median', median FROM sa UNION ALL SELECT name || '_stdev', stdev FROM sa"""


@query("run_manifest", _MANIFEST, r="value")
def s18(i):
    return S.run_manifest(i.params, i.golds, i.sscores, i.users)


# ---- captures and images ---------------------------------------------------------------------

def captures(i):
    """Capture consensus rows, with orders as events: site, votes, evenness and two behaviours."""
    o = i.raw("orders")
    return o.select(F.col("o_orderkey").alias("CaptureEventID"), F.col("o_orderpriority").alias("Species"), F.col("o_custkey").alias("SiteID"),
                    (F.col("o_custkey") % 60).alias("NumVotes"), (F.col("o_totalprice") / 500000).alias("Evenness"),
                    (F.col("o_totalprice") % 100 / 100).alias("Babies"), (F.col("o_totalprice") % 1000 / 1000).alias("Eating"))


_CAP = """, cap AS (SELECT o_orderkey AS CaptureEventID, o_orderpriority AS Species, o_custkey AS SiteID, o_custkey % 60 AS NumVotes,
  o_totalprice / 500000 AS Evenness, o_totalprice % 100 / 100 AS Babies, o_totalprice % 1000 / 1000 AS Eating FROM orders)
"""


@query("camera_csvs", "SELECT 'gold' AS file, count(*) AS rows FROM orders UNION ALL SELECT 'consensus', count(*) FROM orders UNION ALL SELECT 'links', count(*) FROM lineitem")
def s19(i):
    paths = [scratch_path(i.spark, n) for n in ("gold", "consensus", "links")]
    captures(i).select("CaptureEventID", "Species").write.option("header", True).csv(paths[0])
    captures(i).write.option("header", True).csv(paths[1])
    i.raw("lineitem").select(F.col("l_orderkey").alias("CaptureEventID"), F.col("l_returnflag").alias("URL_Info")).write.option("header", True).csv(paths[2])
    from ..operators.prefix import union_all
    tables = S.load_capture_csvs(i.spark, *paths)
    return union_all([t.agg(F.lit(n).alias("file"), F.count("*").alias("rows")) for n, t in zip(("gold", "consensus", "links"), tables)])


@query("capture_subsets", _CAP + """SELECT 'babies' AS subset, CaptureEventID FROM cap WHERE Babies > .9 UNION ALL SELECT 'uneven', CaptureEventID FROM cap WHERE Evenness > .8 AND NumVotes > 20
  UNION ALL SELECT 'eating', CaptureEventID FROM cap WHERE Eating > .9 UNION ALL SELECT 'lion', CaptureEventID FROM cap WHERE Species IN ('1-URGENT', '2-HIGH')""")
def f15(i):
    from ..operators import captures as K
    return K.capture_subsets(captures(i), lions=("1-URGENT", "2-HIGH"))


@query("sample_captures", _CAP + """, s AS (SELECT CaptureEventID FROM cap WHERE Babies > .9 ORDER BY substr(md5('6:' || CaptureEventID), 1, 16), CaptureEventID LIMIT 50)
  SELECT l_orderkey AS CaptureEventID, min(l_linenumber || '-' || l_partkey) AS image FROM lineitem JOIN s ON l_orderkey = CaptureEventID GROUP BY 1""")
def l5(i):
    from ..operators import captures as K
    subset = captures(i).where(F.col("Babies") > .9)
    links = i.raw("lineitem").select(F.col("l_orderkey").alias("CaptureEventID"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("image"))
    return K.sample_captures(subset, links, 50, 6)


ORDER_COLUMNS = """o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority""".split()


@query("capture_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) AS distinct_values FROM orders"
                                             for c in ORDER_COLUMNS))
def a22(i):
    """All columns of the capture table."""
    from ..operators import aggregates as A
    return A.capture_profile(i.raw("orders"))


_LINKS = """, lk AS (SELECT l_orderkey AS CaptureEventID, 'S' || year(l_shipdate::DATE) || '/' || l_linestatus || '/' || l_linenumber || '.jpg' AS URL_Info FROM lineitem),
 gd AS (SELECT o_orderkey AS CaptureEventID, o_orderpriority AS Species FROM orders WHERE o_orderkey % 5 = 0),
 im AS (SELECT CaptureEventID, split_part(URL_Info, '/', 1) AS season FROM lk), gi AS (SELECT Species, season FROM gd JOIN im USING (CaptureEventID))
"""


@query("season_counts", _LINKS + """SELECT 'season' AS what, season AS key, count(*) AS n FROM im GROUP BY 2 UNION ALL SELECT 'gold season', season, count(*) FROM gi GROUP BY 2
  UNION ALL SELECT 'gold species', Species, count(*) FROM gi GROUP BY 2""")
def a22c(i):
    from ..operators import captures as K
    l = i.raw("lineitem")
    link = F.concat(F.lit("S"), F.year(F.col("l_shipdate").cast("date")), F.lit("/"), "l_linestatus", F.lit("/"), "l_linenumber", F.lit(".jpg"))
    links = l.select(F.col("l_orderkey").alias("CaptureEventID"), link.alias("URL_Info"))
    return K.season_counts(links, captures(i).where("CaptureEventID % 5 = 0"))


@query("captures_per", _CAP + """SELECT 'species' AS what, Species AS key, count(*) AS n FROM cap GROUP BY 2 UNION ALL SELECT 'site', SiteID::VARCHAR, count(*) FROM cap GROUP BY 2""")
def a22b(i):
    from ..operators import captures as K
    return K.captures_per(captures(i), {"species": "Species", "site": "SiteID"})


@query("image_list", "SELECT 'obj' || (vec_id // 3) || '_' || label || '.' || vec_id || '.img' AS file, vec_id FROM embeddings")
def s20(i):
    path = scratch_path(i.spark, "list")
    i.images.select(F.concat("file", F.lit("  "))).write.text(path)
    return S.image_list(i.spark, path, i.images).select("file", "vec_id")
