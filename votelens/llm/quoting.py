"""Quotation linking: conversations in reply order, without what they quote, in DataFrame operations.

A line that starts with ``>`` marks is quoted, its level is their number; the other lines are the message's own. Lines are normalised (marks
taken off, white space collapsed, A-Z lower-cased). Adjacent lines of one level are a passage; a message's keys are the hashes of its lines and of all runs of
four words of its passages, so passages that were re-wrapped or cut within a line are found. A quoted key belongs to the earliest message that has it
as its own, if that came before; but where the message that most runs of the level belong to has it too, it belongs to that one. So a line that
many messages have goes with its passage. A quoted line belongs to the origin of its keys (the level's main one first, then most keys, then the
earlier). Less than four words that are no whole line link nothing. A message replies to the origin of most of its lines of the lowest
level with a link (ties: the later message). Own keys are reduced to the first message per conversation and hash before the join, so a line
that every message repeats is one row. Threads are followed by pointer doubling, whose rounds grow with the logarithm of the longest chain.

``position`` is the place within the conversation by (first turn of the thread, turn). It is counted in range blocks, so no task holds a whole
conversation. Cases: null text: no lines, empty content. Null ``conv_id`` or ``turn``: the row cannot be placed; it is returned with its content and
null ``position``. Null role: formatted as ``unknown``. Messages that share a turn: each is placed (order: role, then content), links name the turn.
Repeated rows are returned each. A quote of nobody's words links nothing and is still taken out. Empty table: no rows.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.prefix import range_blocks, running
from ..session import land

MARKS = r"^((?:[ \t]*>)+)"


def _level(line):
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def _normal(line):
    bare = F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"[\x20\x09-\x0D]+", " ")
    return F.translate(F.trim(bare), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``content`` (own lines), the ``levels`` and normalised ``words`` of all lines, and the levels of ``quoted`` ones."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(
        x.alias("line"), _level(x).alias("level"), _normal(x).alias("words")))
    content = F.array_join(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.line), "\n")
    return messages.select("conv_id", "turn", "role", lines.alias("lines")).select(
        "conv_id", "turn", "role", F.regexp_replace(content, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("content"),
        F.transform("lines", lambda x: x.level).alias("levels"), F.transform("lines", lambda x: x.words).alias("words"),
        F.transform(F.filter("lines", lambda x: (x.level > 0) & (x.words != "")), lambda x: x.level).alias("quoted"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x.level)), F.lit(0)).alias("max_level"))


RUN = 4        # words of a run


def keys_of(levels: list, words: list) -> list[tuple]:
    """(level, line, hash) of one message: every line of words, and every run of ``RUN`` words of a passage (adjacent lines of one level) for
    each line it touches. ``words``: the normalised lines."""
    out, at = [], 0
    while at < len(levels):
        end = at
        while end < len(levels) and levels[end] == levels[at]:
            end += 1
        flat = [(w, i) for i in range(at, end) for w in words[i].split()]
        out += [(levels[at], i, "l" + hashlib.md5(words[i].encode()).hexdigest()) for i in range(at, end) if words[i]]
        for j in range(len(flat) - RUN + 1):
            h = "r" + hashlib.md5(" ".join(w for w, _ in flat[j:j + RUN]).encode()).hexdigest()
            out += [(levels[at], i, h) for i in sorted({i for _, i in flat[j:j + RUN]})]
        at = end
    return out


def _keys(msgs: DataFrame) -> DataFrame:
    """(conv_id, turn, msg, level, line, h) of the messages of every conversation that quotes at all."""
    placed = msgs.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    placed = placed.join(placed.where("size(quoted) > 0").select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", "msg", "levels", "words")
    kind = {c: placed.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches):
        for b in batches:
            found = [keys_of(*x) for x in zip(b.column("levels").to_pylist(), b.column("words").to_pylist())]
            of = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            level, line, h = zip(*[k for x in found for k in x]) if len(of) else ((), (), ())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(of) for c in ("conv_id", "turn", "msg")], pa.array(level, pa.int32()), pa.array(line, pa.int32()),
                                              pa.array(h, pa.string())], ["conv_id", "turn", "msg", "level", "line", "h"])
    return placed.mapInArrow(run, f"conv_id {kind['conv_id']}, turn {kind['turn']}, msg long, level int, line int, h string")


def links(msgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, level, origin, n): quoted lines per origin; (conv_id, turn, reply_to): the message replied to."""
    keys = land(_keys(msgs), "quote-keys")
    own = keys.where("level = 0").select("conv_id", "turn", "h").distinct()
    origin = own.groupBy("conv_id", "h").agg(F.min("turn").alias("first"))
    quoted = keys.where("level > 0").join(origin, ["conv_id", "h"]).where("first < turn")
    # most runs of a message's level are from one origin; whatever of the level that one has is its own, too
    votes = quoted.where(F.col("h").startswith("r")).groupBy("conv_id", "turn", "level", "first").agg(F.count("*").alias("n"))
    main = votes.groupBy("conv_id", "turn", "level").agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("main"))
    has = own.withColumnRenamed("turn", "main").withColumn("has", F.lit(True))
    quoted = quoted.join(main, ["conv_id", "turn", "level"], "left").join(has, ["conv_id", "main", "h"], "left")
    of = quoted.groupBy("conv_id", "turn", "msg", "level", "line", F.when(F.col("has"), F.col("main")).otherwise(F.col("first")).alias("origin")).agg(
        F.max(F.coalesce("has", F.lit(False))).alias("has"), F.count("*").alias("n"))
    line = of.groupBy("conv_id", "turn", "msg", "level", "line").agg(F.max_by("origin", F.struct("has", "n", -F.col("origin"))).alias("origin"))
    found = land(line.groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("n")), "quote-links")
    best = F.max(F.struct((-F.col("level")).alias("l"), "n", "origin"))
    return found, found.groupBy("conv_id", "turn").agg(best.alias("m")).select("conv_id", "turn", F.col("m.origin").alias("reply_to"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth): the first message of each reply's chain and the number of steps to it."""
    up = land(parents.withColumn("thread", F.col("reply_to")).withColumn("depth", F.lit(1).cast("long")), "quote-threads")
    while True:
        above = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("t2"), F.col("depth").alias("d2"))
        up = land(up.join(above, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", "reply_to", F.coalesce("t2", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("t2").isNotNull().alias("moved")), "quote-threads")
        if not up.where("moved").limit(1).count():
            return up.drop("moved")
        up = up.drop("moved")


def conversations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, position, reply_to, thread, depth, n_quoted, n_linked, max_level, content, chat."""
    msgs = land(parsed(messages.select("conv_id", "turn", "role", "text")).withColumn("msg", F.monotonically_increasing_id()), "quote-parsed")
    found, parents = links(msgs)
    linked = found.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked"))
    # lines of messages that share a turn are counted together; each such row carries the sum
    up = threads(parents).join(linked, ["conv_id", "turn"])
    all_rows = msgs.join(up, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.size("quoted").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("max_level").cast("long").alias("max_level"), "content",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("content"), F.lit("\n")).alias("chat"))
    able = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    blocks = range_blocks(all_rows.where(able).withColumn("one", F.lit(1)), ["conv_id", "thread"], "turn")
    # rows of one turn that fell into two blocks keep the order of the blocks
    placed = running(blocks, ["conv_id"], ["thread", "turn", "role", "content"], sums={"position": "one"}).drop("one")
    return placed.unionByName(all_rows.where(~able).withColumn("position", F.lit(None).cast("long"))).select(
        "conv_id", "turn", "role", F.col("position").cast("long").alias("position"), "reply_to", "thread", "depth", "n_quoted", "n_linked", "max_level", "content", "chat")


ORACLE = r"""WITH RECURSIVE l AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
m AS (SELECT conv_id, turn, role, [x FOR x IN ls IF regexp_extract(x, '^((?:[ \t]*>)+)', 1) = ''] AS own,
  [x FOR x IN ls IF regexp_extract(x, '^((?:[ \t]*>)+)', 1) <> ''] AS quo FROM l),
n AS (SELECT conv_id, turn, role, regexp_replace(array_to_string(own, chr(10)), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS content,
  [trim(translate(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) FOR x IN own] AS own,
  [{'level': length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')),
    'h': trim(translate(regexp_replace(regexp_replace(x, '^((?:[ \t]*>)+)', ''), '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))} FOR x IN quo] AS quo FROM m),
q AS (SELECT conv_id, turn, z.level AS level, z.h AS h FROM (SELECT conv_id, turn, unnest(quo) AS z FROM n) WHERE z.h <> ''),
o AS (SELECT conv_id, h, min(turn) AS origin FROM (SELECT conv_id, turn, unnest(own) AS h FROM n) WHERE h <> '' GROUP BY 1, 2),
f AS (SELECT conv_id, turn, level, origin, count(*) AS n FROM q JOIN o USING (conv_id, h) WHERE origin < turn GROUP BY ALL),
p AS (SELECT conv_id, turn, reply_to, linked FROM (SELECT conv_id, turn, origin AS reply_to, sum(n) OVER (PARTITION BY conv_id, turn) AS linked,
  row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) AS r FROM f) WHERE r = 1),
c AS (SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM p UNION ALL
  SELECT c.conv_id, c.turn, p.reply_to, c.depth + 1 FROM c JOIN p ON p.conv_id = c.conv_id AND p.turn = c.thread),
t AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM c GROUP BY 1, 2)
SELECT conv_id, turn, role, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN
    row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(thread, turn), turn, role, content) END AS position,
  reply_to, coalesce(thread, turn) AS thread, coalesce(depth, 0)::BIGINT AS depth, len([x FOR x IN quo IF x.h <> '']) AS n_quoted, coalesce(linked, 0)::BIGINT AS n_linked,
  coalesce(list_max([x.level FOR x IN quo]), 0)::BIGINT AS max_level, content, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || content || chr(10) AS chat
FROM n LEFT JOIN p USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn)"""
