"""Conversation structure repair: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

Every turn is kept (K, 0), given the other role (R, 3) or deleted (D, 4); an empty turn of user or assistant may be inserted anywhere (I, 3). Blank and
repeated turns must go; a truncated turn that stays adds 3. Of all cheapest repairs the one with the least edit string in ASCII order counts.

*Alignment.* The target strings are ``ua``, ``sua``, ``uaua``, ... up to every feasible length. Wagner-Fischer tables run from the last turn back, so that all
targets with one ending share one table: its cell (i, r) is the least cost of aligning turns i.. with the last r symbols. Ukkonen bands bound r:
a path whose extra inserts and deletes alone cost more than the incumbent repair is never entered. The incumbent is the best repair of a narrow band (or the
deletion of everything); if it costs more than its band proves, the band is widened to its cost, once. The cheapest lengths are then
traced forwards side by side, and those whose edit string falls behind are dropped: the audits are compared as they are traced.

*Long conversations.* Damaged rows are range-partitioned by (conversation, turn, role, text) and streamed in that order; equal rows travel as one row with a
count. A conversation within one partition and of at most ``segment`` turns is repaired at once. Any other is cut into segments. A segment is
aligned for every pair of what came before and after it (nothing yet, s, u, a); the pairs are chained per conversation. That is exact: with both ends given, no
edit string of equal cost begins another one, so least pieces make the least whole. Only the chaining (costs and edit strings) and the
hash of the repaired text, which no one can compute in parallel, pass a conversation's segments through one task, one at a time.

Cases: a null conv_id or turn is one space in the key of the damage; rows with a null ``conv_id`` are one conversation. A null role or text is one space: such a text is blank, and such a role fits
nowhere. Turns of one number stand in the order of role, then text (code points); a null turn comes first. The initial of a role is its first character;
an empty role has none. An empty or missing table: no rows. ``gaps`` beyond a long is the greatest long. Texts of any length are whole. Extra columns do not enter.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import land
from .text import slices

SPACES = " \t\n\v\f\r"
END = ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
NONE, S, U, A = range(4)          # what the repaired conversation ends with so far
NAME = {"u": "user", "a": "assistant"}
_FAR = 1 << 40


@dataclass(frozen=True)
class RepairParams:
    segment: int = 4096
    band: int = 12                # extra cost that the first band covers


# ---- damage ----------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) after the damage; a dropped row leaves its conversation behind with ``times`` 0."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), code.alias("code"))
    gone, code = F.col("code") == 0, F.col("code")
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"),
                       F.when(gone, "").when(code == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(gone | (code == 1), "").when(code == 2, F.translate("text", END, "")).otherwise(F.col("text")).alias("text"),
                       F.when(gone, 0).when(code == 3, 2).otherwise(1).cast("long").alias("times"))


# ---- alignment -------------------------------------------------------------------------------

class Turns:
    """Initials of some turns, which of them must go and which are truncated."""

    def __init__(self, initials: list[str], forced: list[bool], cut: list[bool]):
        self.c, self.forced, self.n = initials, forced, len(initials)
        self.cut = [bool(x) and not f for x, f in zip(cut, forced)]
        self.rest = np.concatenate((np.cumsum([not f for f in forced[::-1]], dtype=np.int64)[::-1], [0])).tolist() if self.n else [0]
        self.cuts = sum(self.cut)
        self.base = DELETE * (self.n - self.rest[0]) + CUT * self.cuts       # no repair is cheaper

    def deletes_within(self, extra: int) -> int:
        """How many turns that need not go can go for ``extra`` on top of the base."""
        return extra if extra <= self.cuts else self.cuts + (extra - self.cuts) // DELETE


def _symbol(last: int, r: int) -> str:
    """The r-th symbol from the end of a target that ends with ``last``."""
    return "ua"[(last == A) == (r % 2 == 1)]


class Table:
    """Suffix costs within a band, for targets ending with ``last``."""

    def __init__(self, t: Turns, last: int, extra: int):
        up, down = extra // INSERT, t.deletes_within(extra)
        self.rows: list = [None] * (t.n + 1)
        self.rows[t.n] = lo, v = 0, INSERT * np.arange(up + 1, dtype=np.int64)
        odd = _symbol(last, 1)
        for i in range(t.n - 1, -1, -1):
            if t.forced[i]:
                v = v + DELETE
            else:
                at, width = max(0, t.rest[i] - down), t.rest[i] + up + 1 - max(0, t.rest[i] - down)
                new = np.full(width, _FAR, np.int64)
                k = min(len(v) - (at - lo), width)                            # same r: deleted
                new[:k] = v[at - lo:at - lo + k] + DELETE
                # r - 1 below: kept or given a role
                cost = np.full(len(v), REROLE, np.int64)
                if t.c[i] in "ua" and t.c[i]:
                    cost[(lo + 1 + (t.c[i] != odd)) % 2 == 0::2] = KEEP
                into = lo + 1 - at
                move = v + cost + CUT * t.cut[i]
                a, b = max(into, 0), min(into + len(v), width)
                new[a:b] = np.minimum(new[a:b], move[a - into:b - into])
                step = INSERT * np.arange(width, dtype=np.int64)
                v, lo = np.minimum.accumulate(new - step) + step, at
            self.rows[i] = lo, v

    def get(self, i: int, r: int) -> int:
        lo, v = self.rows[i]
        return int(v[r - lo]) if 0 <= r - lo < len(v) else _FAR


def _starts(t: Turns, table: Table, entry: int, last: int, extra: int) -> tuple[int, list[tuple[int, int]]]:
    """Least cost over all target lengths, and where its alignments start: (-1, r), or (i, r) where turn i is the target's s."""
    first = "a" if entry == U else "u"
    lo, v = table.rows[0]
    best, at = _FAR, []

    def offer(cost, i, r):
        nonlocal best, at
        if cost < best:
            best, at = cost, []
        if cost == best < _FAR:
            at.append((i, r))

    least = 0 if entry == last else 1
    for r in range(max(lo, least), lo + len(v)):
        if r == 0 or _symbol(last, r) == first:
            offer(int(v[r - lo]), -1, r)
    if entry == NONE:
        before = 0                                        # extra cost of deleting the turns before
        for i in range(t.n):
            if before > extra:
                break
            if t.c[i] == "s" and not t.forced[i]:
                lo_i, v_i = table.rows[i + 1]
                for r in range(max(lo_i, 1), lo_i + len(v_i)):
                    if _symbol(last, r) == "u":
                        offer(DELETE * i + CUT * t.cut[i] + int(v_i[r - lo_i]), i, r)
            before += 0 if t.forced[i] else DELETE - CUT * t.cut[i]
    return best, at


def _trace(t: Turns, table: Table, last: int, starts: list[tuple[int, int]]) -> str:
    """The least edit string of the given starts, traced side by side."""
    live, i, out = set(starts), 0, []
    while not (i == t.n and any(s < 0 and r == 0 for s, r in live)):
        steps: dict = {}
        for s, r in live:
            if s >= 0:                                    # the s of the target is still to come, at turn s
                steps.setdefault("D" if i < s else "K", set()).add((s, r) if i < s else (-1, r))
                continue
            now = table.get(i, r)
            if r and table.get(i, r - 1) + INSERT == now:
                steps.setdefault("I", set()).add((-1, r - 1))
            if i < t.n:
                if table.get(i + 1, r) + DELETE == now:
                    steps.setdefault("D", set()).add((-1, r))
                if r and not t.forced[i]:
                    same = t.c[i] == _symbol(last, r)
                    if table.get(i + 1, r - 1) + CUT * t.cut[i] + (KEEP if same else REROLE) == now:
                        steps.setdefault("K" if same else "R", set()).add((-1, r - 1))
        letter = min(steps)
        live = steps[letter]
        i += letter != "I"
        out.append(letter)
    return "".join(out)


def align(t: Turns, entries: tuple, last: int, p: RepairParams, incumbent: int = _FAR) -> dict:
    """{entry: (cost, audit)} of the cheapest repairs between ``entry`` and an end with ``last`` (U or A) that cost at most ``incumbent``."""
    extra = min(p.band, incumbent - t.base)
    while True:
        if extra < 0:
            return {}
        table = Table(t, last, extra)
        found = {e: _starts(t, table, e, last, extra) for e in entries}
        need = max(c for c, _ in found.values())
        need = min(need, incumbent) - t.base if need < _FAR else (min(4 * extra + 12, incumbent - t.base))
        if need <= extra:
            return {e: (c, _trace(t, table, last, s)) for e, (c, s) in found.items() if c < _FAR}
        extra = need


def whole(t: Turns, p: RepairParams = RepairParams()) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; deleting everything is the first incumbent."""
    nothing = DELETE * t.n, "D" * t.n
    return min([nothing, *align(t, (NONE,), A, p, nothing[0]).values()])


def pairs(t: Turns, p: RepairParams) -> dict:
    """{(entry, exit): (cost, audit)} of a segment."""
    out = {(e, e): (DELETE * t.n, "D" * t.n) for e in (NONE, S)}
    keep = [(DELETE * (t.n - 1) + CUT * t.cut[i], "D" * i + "K" + "D" * (t.n - 1 - i)) for i in range(t.n) if t.c[i] == "s" and not t.forced[i]]
    if keep:
        out[NONE, S] = min(keep)
    for last in (U, A):
        out |= {(e, last): v for e, v in align(t, (NONE, S, U, A), last, p).items()}
    return out


def repaired(audit: str, roles: list[str], texts: list, state: int):
    """The repaired ``role:text`` lines of some turns; returns the state behind them."""
    i = 0
    for letter in audit:
        symbol = "a" if state == U else "u"
        if letter == "I":
            yield f"{NAME[symbol]}:"
        elif letter != "D":
            symbol = roles[i][0] if letter == "K" else symbol
            yield f"{roles[i] if letter == 'K' else NAME[symbol]}:{texts[i]}"
        if letter != "I":
            i += 1
        if letter != "D":
            state = {"s": S, "u": U, "a": A}[symbol]
    return state


# ---- streams of rows -------------------------------------------------------------------------

@dataclass
class Segment:
    """Some consecutive turns of one conversation with their figures."""
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    forced: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    illegal: int = 0
    turns: list = field(default_factory=list)       # least, greatest, number of different ones

    def add(self, turn, role: str, text: str, repeat: bool) -> None:
        body = text.strip(SPACES)
        if self.roles:
            self.illegal += self.roles[-1][:1] + role[:1] not in ("su", "ua", "au")
        self.blank += not body
        self.duplicate += bool(body) and repeat
        self.roles.append(role)
        self.forced.append(not body or repeat)
        self.cut.append(not self.forced[-1] and body[-1] not in END)
        self.texts.append(None if self.forced[-1] else text)
        if turn is not None:
            lo, hi, n = self.turns or (turn, turn, 1)
            self.turns = [lo, turn, n + (turn != hi)]

    def aligned(self) -> Turns:
        return Turns([r[:1] for r in self.roles], self.forced, self.cut)


def _gaps(turns: list) -> int:
    return min(turns[1] - turns[0] + 1 - turns[2], (1 << 63) - 1) if turns else 0


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = ", ".join(f"{c} long" for c in _FIGURES) + ", audit string, repaired_sha256 string"
_SEGMENT = "roles array<string>, texts array<string>, turns array<long>, costs array<long>, audits array<string>"


def _finished(s: Segment, p: RepairParams) -> dict:
    cost, audit = whole(s.aligned(), p)
    text = "\n".join(repaired(audit, s.roles, s.texts, NONE))
    return {"gaps": _gaps(s.turns), "blank": s.blank, "duplicate": s.duplicate, "truncated": sum(s.cut), "illegal": s.illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _open(s: Segment, p: RepairParams) -> dict:
    got = pairs(s.aligned(), p)
    both = [got.get((e, x), (None, None)) for e in range(4) for x in range(4)]
    return {"blank": s.blank, "duplicate": s.duplicate, "truncated": sum(s.cut), "illegal": s.illegal, "roles": s.roles, "texts": s.texts, "turns": s.turns,
            "costs": [c for c, _ in both], "audits": [a for _, a in both]}


def aligned(rows: DataFrame, p: RepairParams) -> DataFrame:
    """Sorted rows (conv_id, turn, role, text, times, repeats) to results (``seq`` null) and segments of conversations cut in pieces."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, seq int, {_RESULT}, {_SEGMENT}"

    def run(batches):
        out, size, place = [], 0, 0                       # ``place`` numbers the segments of a partition
        conv, seg, cut = None, None, True                 # the first conversation of a partition may have begun before it

        def rows_of():
            for b in slices(batches):
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "repeats")))

        def emit(piece: bool):
            nonlocal size, place
            out.append({"conv_id": conv, **({"seq": place, **_open(seg, p)} if piece else _finished(seg, p))})
            size, place = size + len(seg.roles), place + piece

        for c, turn, role, text, times, repeats in rows_of():
            if seg is None or c != conv:
                if seg is not None:
                    emit(cut)
                    cut = False
                conv, seg = c, Segment()
            for k in range(times):
                if len(seg.roles) >= p.segment:
                    cut = True
                    emit(cut)
                    seg = Segment()
                seg.add(turn, role, text, k >= times - repeats)
                if size >= p.segment:
                    yield pa.RecordBatch.from_pylist(out, types)
                    out, size = [], 0
        if seg is not None:
            emit(True)                                    # the last one may go on behind the partition
            yield pa.RecordBatch.from_pylist(out, types)

    types = _arrow(schema)
    return rows.select("conv_id", "turn", "role", "text", "times", "repeats").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(schema))


# ---- conversations cut in pieces -------------------------------------------------------------

def _by_conversation(batches, columns):
    """Lists of a conversation's pieces would grow with it, so: (is it a new conversation, row) one by one."""
    before = ()
    for b in batches:
        for i in range(b.num_rows):
            row = [b.column(c)[i].as_py() for c in columns]
            yield before != (row[0],), row
            before = (row[0],)


def chained(segments: DataFrame) -> DataFrame:
    """(conv_id, part, seq, entry, audit, total): of each segment what came before it and its edits in the cheapest repair."""
    kind = segments.schema["conv_id"].dataType.simpleString()

    def chosen(conv, places, back, best):
        cost, audit, x = min((best[e][0], best[e][1], e) for e in (NONE, A) if e in best)
        for k in range(len(places) - 1, -1, -1):
            e, piece = back[k][x]
            yield {"conv_id": conv, "part": places[k][0], "seq": places[k][1], "entry": e, "audit": piece, "total": cost}
            x = e

    def run(batches):
        conv, places, back, best = None, [], [], {}
        for new, (c, part, seq, costs, audits) in _by_conversation(batches, ("conv_id", "part", "seq", "costs", "audits")):
            if new:
                if places:
                    yield pa.RecordBatch.from_pylist(list(chosen(conv, places, back, best)), types)
                conv, places, back, best = c, [], [], {NONE: (0, "")}
            after, links = {}, {}
            for x in range(4):
                ways = [(best[e][0] + costs[4 * e + x], e) for e in best if costs[4 * e + x] is not None]
                least = min((w for w, _ in ways), default=None)
                ties = [(best[e][1] + audits[4 * e + x], e) for w, e in ways if w == least]
                if ties:
                    text, e = min(ties)
                    after[x], links[x] = (least, text), (e, audits[4 * e + x])
            best = after
            places.append((part, seq))
            back.append(links)
        if places:
            yield pa.RecordBatch.from_pylist(list(chosen(conv, places, back, best)), types)

    schema = f"conv_id {kind}, part int, seq int, entry int, audit string, total long"
    types = _arrow(schema)
    return segments.select("conv_id", "part", "seq", "costs", "audits").mapInArrow(run, schema)


def joined(segments: DataFrame) -> DataFrame:
    """Segments with their chosen edits, in order, to one result per conversation."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    columns = ("conv_id", "entry", "audit", "total", "roles", "texts", "turns", "blank", "duplicate", "truncated", "illegal")

    def run(batches):
        row = sha = None

        def closed():
            return {"conv_id": row["conv_id"], **{c: row[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}, "gaps": _gaps(row["turns"]),
                    "audit": "".join(row["audit"]), "repaired_sha256": sha.hexdigest()}

        for new, (conv, entry, audit, total, roles, texts, turns, *figures) in _by_conversation(batches, columns):
            if new:
                if row:
                    yield pa.RecordBatch.from_pylist([closed()], types)
                row, sha, empty = {"conv_id": conv, "turns": [], "audit": [], "last": None, "cost": total} | dict.fromkeys(columns[7:], 0), hashlib.sha256(), True
            for c, v in zip(columns[7:], figures):
                row[c] += v
            if roles:
                row["illegal"] += row["last"] is not None and row["last"] + roles[0][:1] not in ("su", "ua", "au")
                row["last"] = roles[-1][:1]
            if turns:
                lo, hi, n = row["turns"] or (turns[0], turns[0], 1)
                row["turns"] = [lo, turns[1], n + turns[2] - (turns[0] == hi)]
            row["audit"].append(audit)
            for line in repaired(audit, roles, texts, entry):
                sha.update((b"" if empty else b"\n") + line.encode())
                empty = False
        if row:
            yield pa.RecordBatch.from_pylist([closed()], types)

    schema = f"conv_id {kind}, {_RESULT}"
    types = _arrow(schema)
    return segments.select(*columns).mapInArrow(run, schema)


def repair(damaged: DataFrame, p: RepairParams = RepairParams()) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``damaged``
    (conv_id, turn, role, text, times)."""
    parts = int(damaged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = damaged.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    rows = land(rows.withColumn("key", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256)), "cr-rows")
    # the first turn of what a conversation says more than once: these few groups are joined back
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    again = (rows.where("times > 0").groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k"))
             .agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("c", "k", F.col("first.turn").alias("t")))
    both = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    first = F.col("k").isNull() | F.col("turn").eqNullSafe(F.col("t"))
    rows = both.select("conv_id", "turn", "role", "text", "times", (F.col("times") - F.when(first, 1).otherwise(0)).alias("repeats"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)
    got = land(aligned(ranged, p).withColumn("part", F.spark_partition_id()), "cr-aligned")

    results = ["conv_id", *_FIGURES, "audit", "repaired_sha256"]
    segments = got.where("seq IS NOT NULL")
    ordered = lambda df: df.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    plan = land(chained(ordered(segments.select("conv_id", "part", "seq", "costs", "audits"))), "cr-plan")
    chosen = segments.drop("costs", "audits", "conv_id", "audit").join(plan, ["part", "seq"])
    return got.where("seq IS NULL").select(*results).union(joined(ordered(chosen)).select(*results))


#: DuckDB: CRC-32 by table, then the cheapest edits turn by turn over what the repaired conversation ends with (0 nothing, 1 s, 2 u, 3 a). Between two
#: turns one insert suffices, since two lead back to where they began.
ORACLE = r"""WITH RECURSIVE
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM range(256) x(i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 20 AS code FROM conversations, tab),
dam AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE code <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, dense_rank() OVER (ORDER BY conv_id) AS cid,
  trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS c FROM dam),
flt AS (SELECT *, body = '' AS is_blank, body <> '' AND row_number() OVER (PARTITION BY cid, role, text ORDER BY n) > 1 AS is_dup,
  coalesce(lag(c) OVER (PARTITION BY cid ORDER BY n) || c NOT IN ('su', 'ua', 'au'), false) AS is_illegal FROM num),
trn AS (SELECT *, is_blank OR is_dup AS forced, CASE WHEN NOT is_blank AND NOT is_dup AND right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM flt),
st AS (SELECT DISTINCT cid, 0::BIGINT AS n, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'txt': ''} AS b FROM trn
 UNION ALL SELECT cid, n, q, min(b) AS b FROM (
  SELECT t.cid, t.n, CASE WHEN e = 'D' THEN q WHEN e = 'R' THEN CASE WHEN q = 2 THEN 3 ELSE 2 END ELSE CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS q,
   {'cost': cost + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 + 3 * cut ELSE 3 * cut END, 'audit': audit || e,
    'txt': CASE e WHEN 'D' THEN txt WHEN 'K' THEN txt || chr(10) || role || ':' || text ELSE txt || chr(10) || CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || text END} AS b
  FROM (SELECT cid, n, CASE WHEN k = 0 THEN q WHEN q = 2 THEN 3 ELSE 2 END AS q, b.cost + 3 * k AS cost, b.audit || repeat('I', k) AS audit,
     b.txt || CASE WHEN k = 0 THEN '' WHEN q = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END AS txt FROM st, (VALUES (0), (1)) i(k)) s
  JOIN trn t ON t.cid = s.cid AND t.n = s.n + 1, (VALUES ('D'), ('K'), ('R')) x(e)
  WHERE e = 'D' OR NOT forced AND (e = 'R' OR q = 0 AND c IN ('s', 'u') OR q IN (1, 3) AND c = 'u' OR q = 2 AND c = 'a')) GROUP BY cid, n, q),
fin AS (SELECT cid, min(b) AS b FROM (SELECT cid, CASE WHEN k = 0 THEN q WHEN q = 2 THEN 3 ELSE 2 END AS q, {'cost': b.cost + 3 * k, 'audit': b.audit || repeat('I', k),
   'txt': b.txt || CASE WHEN k = 0 THEN '' WHEN q = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END} AS b
  FROM st SEMI JOIN (SELECT cid, max(n) AS n FROM trn GROUP BY cid) m USING (cid, n), (VALUES (0), (1)) i(k)) WHERE q IN (0, 3) GROUP BY cid),
fig AS (SELECT cid, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE is_blank) AS blank,
  count(*) FILTER (WHERE is_dup) AS duplicate, sum(cut)::BIGINT AS truncated, count(*) FILTER (WHERE is_illegal) AS illegal FROM trn GROUP BY cid)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.txt, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN (SELECT * FROM fig JOIN fin USING (cid)) f ON o.conv_id IS NOT DISTINCT FROM f.conv_id"""
