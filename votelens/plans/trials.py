"""Many scoring runs in one job.

A trial is a set of labels. Trials are a table; which labels belong to which is kept as *cells*: the trial itself for random sets, the first trial
of a growing series, or the place in a grid of two rankings. Votes on labelled subjects are counted per (voter, cell) once, whatever the number of
trials; a voter's counts in every trial are sums over cells. Votes then meet these counts in tasks of one bucket of subjects, which go through the trials
one after the other: what a trial changes is the weights of the voters on the labels that it adds or drops, and the sums of the subjects they voted on. A vote is one row,
however many trials there are. What comes out are the subjects that a trial moves away from the prior. All others
are one row per trial: the class totals less what was moved.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import hash_order
from ..operators import aggregates, consensus, evaluate
from ..operators.relational import expert_only, gold_union
from ..params import Params
from ..session import land

BLOCK = 128                               # trials of which a task writes whole score tables
FEW = 32
VOTES, SUBJECTS = 2_000_000, 1 << 16      # of a bucket of subjects, in whose task the trials are summed
FAIR = 1 << 18                            # votes below which a bucket is not made smaller to give every core one
CLASSES = {"m": -1, "z": 0, "o": 1}


@dataclass(frozen=True)
class Trials:
    """``table``: (trial 0.., keys). ``labels``: (subject, gold, cell). ``spread``: sums per cell (cells, k) to sums per trial (trials, k).
    ``holds``: which cells a trial's labels are in; ``order``: the trials in an order in which neighbours share most of them.
    ``members``: cells to (trial, ...) rows, for the labels of each trial. ``last``: of a growing series, one row with the last trial that adds a label; all
    later ones have the same labels and are worked out once."""
    keys: tuple
    table: DataFrame
    n: int
    labels: DataFrame
    cells: int
    spread: Callable
    holds: Callable
    order: list
    members: Callable
    last: DataFrame | None = None

    def distinct(self, df: DataFrame) -> DataFrame:
        """Rows of trials that differ from the one before."""
        return df if self.last is None else df.join(F.broadcast(self.last), F.col("trial") <= F.col("_last")).drop("_last")

    def for_all(self, results: DataFrame) -> DataFrame:
        """Results (keys, ...) of the distinct trials, given to every trial that has the same labels."""
        if self.last is None:
            return results
        own = results.join(F.broadcast(self.table), list(self.keys)).drop(*self.keys).withColumnRenamed("trial", "_like")
        like = self.table.join(F.broadcast(self.last)).withColumn("_like", F.least("trial", "_last")).drop("_last")
        return like.join(own, "_like").select(*self.keys, *[c for c in results.columns if c not in self.keys])

    def golds(self) -> DataFrame:
        """(keys, subject, gold): the labels of each trial as rows."""
        return self.members(self.labels).join(F.broadcast(self.table), "trial").select(*self.keys, "subject", "gold")


def _table(spark, keys, trials) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(trials)], "trial int, " + ", ".join(f"{k} int" for k in keys))


def random_trials(golds: DataFrame, sizes, n_trials: int, seed=0) -> Trials:
    """For each size and repeat, that many random labelled subjects.

    Where Spark limits ranks within the map tasks (``windowGroupLimitThreshold``, 1,000 by default, at least the largest size), a trial's partition holds
    no more than the largest size times the number of map tasks; else it holds all labels.
    """
    keys, trials = ("golds", "n"), [(int(g), int(n)) for g in sizes for n in range(n_trials)]
    table = _table(golds.sparkSession, keys, trials)
    rows = golds.where(expert_only()).select("subject", "gold", F.explode(F.sequence(F.lit(0), F.lit(len(trials) - 1))).alias("trial"))
    # the trial list is the small side: an exploded frame is estimated at the size of its source, and Spark would broadcast it
    rows = rows.join(F.broadcast(table), "trial").withColumn("_h", hash_order(F.col("subject"), F.concat_ws("-", F.lit(seed), "golds", "n")))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("trial").orderBy("_h", "subject"))).where(F.col("_r") <= max(sizes))
    labels = ranked.where(F.col("_r") <= F.col("golds")).select("subject", "gold", F.col("trial").alias("cell"))
    return Trials(keys, table, len(trials), labels, len(trials), lambda x: x, lambda t: np.arange(len(trials)) == t, [*range(len(trials))],
                  lambda df: df.withColumnRenamed("cell", "trial"))


def ordered_trials(golds: DataFrame, start: int, end: int, step: int, seed=0) -> Trials:
    """Growing prefixes of one shuffled label order: start + step, start + 2 step, ... until one is longer
    than ``end`` (that one included)."""
    n = max((end - start) // step + 1, 1)
    keys, trials = ("golds", "n"), [(start + (k + 1) * step, k) for k in range(n)]
    ordered = (golds.where(expert_only()).withColumn("_h", hash_order(F.col("subject"), seed))
               .orderBy("_h", "subject").limit(trials[-1][0]))
    # at most as many rows as the longest prefix has
    ranked = ordered.withColumn("_r", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("_h", "subject")))
    first = F.greatest(F.ceil((F.col("_r") - start) / step).cast("int"), F.lit(1)) - 1
    labels = ranked.select("subject", "gold", first.alias("cell"))
    return Trials(keys, _table(golds.sparkSession, keys, trials), n, labels, n, lambda x: np.cumsum(x, 0), lambda t: np.arange(n) <= t, [*range(n)],
                  lambda df: df.withColumn("trial", F.explode(F.sequence("cell", F.lit(n - 1)))), labels.agg(F.coalesce(F.max("cell"), F.lit(0)).alias("_last")))


def cv_grid_trials(votes: DataFrame, golds: DataFrame, controversial: range, consensus_: range, version: str = "pow") -> Trials:
    """Each pair of counts but (0, 0): the labels of that many most controversial and that many clearest subjects.

    Both rankings are made once; a subject's cell says which count of each list reaches its rank first (one more than there are: none).
    """
    keys, a, b = ("controversial", "consensus"), list(controversial), list(consensus_)

    def ranked(top, counts, name):
        # at most max(counts) rows
        r = top.withColumn("_r", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "subject")))
        step = counts[1] - counts[0] if len(counts) > 1 else 1
        return r.select("subject", F.greatest(F.ceil((F.col("_r") - counts[0]) / step), F.lit(0)).cast("int").alias(name))

    i = ranked(aggregates.controversial_top(votes, max(a), version), a, "i")
    j = ranked(aggregates.consensus_top(votes, max(b), version), b, "j")
    both = i.join(j, "subject", "full").select("subject", F.coalesce("i", F.lit(len(a))).alias("i"), F.coalesce("j", F.lit(len(b))).alias("j"))
    labels = both.join(golds.select("subject", "gold"), "subject").select("subject", "gold", (F.col("i") * (len(b) + 1) + F.col("j")).alias("cell"))
    pairs = [(x, y) for x in range(len(a)) for y in range(len(b)) if a[x] + b[y] > 0]
    at = np.array(pairs)

    def spread(x):
        grid = x.reshape(len(a) + 1, len(b) + 1, -1)
        beyond = np.zeros((len(a) + 2, len(b) + 2, grid.shape[2]), x.dtype)       # sums over cells at or beyond (i, j)
        beyond[:-1, :-1] = grid[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
        return beyond[0, 0] - beyond[at[:, 0] + 1, at[:, 1] + 1]

    x, y = np.divmod(np.arange((len(a) + 1) * (len(b) + 1)), len(b) + 1)
    holds = lambda t: (x <= pairs[t][0]) | (y <= pairs[t][1])
    # to and fro: the next trial is a neighbour in the grid
    order = sorted(range(len(pairs)), key=lambda t: (pairs[t][0], pairs[t][1] * (-1) ** pairs[t][0]))
    table = _table(golds.sparkSession, keys, [(a[x], b[y]) for x, y in pairs])
    place = _table(golds.sparkSession, ("x", "y"), pairs)

    def members(df):
        df = df.withColumns({"i": F.floor(F.col("cell") / (len(b) + 1)).cast("int"), "j": F.col("cell") % (len(b) + 1)})
        each = df.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(len(a) - 1))))
        # every row of the grid from the subject's first one on, of the rows before only the places that its second rank reaches
        each = each.withColumn("_y", F.when(F.col("i") <= F.col("x"), 0).otherwise(F.col("j"))).where(F.col("_y") < len(b))
        return each.withColumn("y", F.explode(F.sequence("_y", F.lit(len(b) - 1)))).join(F.broadcast(place), ["x", "y"])

    return Trials(keys, table, len(pairs), labels, (len(a) + 1) * (len(b) + 1), spread, holds, order, members)


# ---- scoring ---------------------------------------------------------------------------------

def _log(x: np.ndarray) -> np.ndarray:
    """The C library's logarithm of each different value: numpy's own may differ in the last bit, and a rounded billionth with it."""
    values, at = np.unique(x, return_inverse=True)
    return np.array([math.log(v) for v in values])[at]


def _counted(first_votes: DataFrame, trials: Trials) -> DataFrame:
    """(voter, c): seen and matched labels of each class per cell, for voters with labelled votes."""
    names = list(consensus._counters())
    counts = (first_votes.join(trials.labels.where(expert_only()), "subject").groupBy("voter", "cell")
              .agg(*[F.sum(c).alias(n) for n, c in consensus._counters().items()]))
    # at most one entry per cell: bounded by the trial list, not by the votes
    return counts.groupBy("voter").agg(F.collect_list(F.struct("cell", *names)).alias("c"))


def _ratios(sums: np.ndarray, g: float) -> tuple[np.ndarray, np.ndarray]:
    """What a 1 and a 0 vote weigh, in billionths, for rows of (seen 0, matched 0, seen 1, matched 1)."""
    half_up = lambda x: np.sign(x) * np.floor(np.abs(x) + .5)
    seen0, match0, seen1, match1 = sums.T
    s0, s1 = (match0 + g) / (seen0 + 2 * g), (match1 + g) / (seen1 + 2 * g)
    return tuple(half_up(consensus.NANO * _log(x)) + 0. for x in (s1 / (1 - s0), (1 - s1) / s0))


def _weights(first_votes: DataFrame, trials: Trials, params: Params) -> DataFrame:
    """(voter, block, l1, l0): what a 1 and a 0 vote of the voter weigh in each trial of a block, in billionths; no row for blocks where it weighs nothing."""
    names = list(consensus._counters())
    cells, spread, g = trials.cells, trials.spread, params.gamma

    def run(batches):
        for b in batches:
            out = []
            for voter, held in zip(b.column("voter").to_pylist(), b.column("c")):
                c = held.values
                sums = np.zeros((cells, 4))
                sums[c.field("cell").to_numpy()] = np.stack([c.field(n).to_numpy() for n in names], 1)
                l1, l0 = _ratios(spread(sums), g)
                for k in range(0, len(l1), BLOCK):
                    part = slice(k, k + BLOCK)
                    if l1[part].any() or l0[part].any():
                        out.append((voter, k // BLOCK, l1[part], l0[part]))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())))],
                                             ["voter", "block", "l1", "l0"])

    weights = _counted(first_votes, trials).mapInArrow(run, "voter string, block int, l1 array<double>, l0 array<double>")
    return trials.distinct(weights.withColumn("trial", F.col("block") * BLOCK)).drop("trial")


def _few(first_votes: DataFrame, trials: Trials, params: Params) -> DataFrame:
    """(subject, block, sums) of at most ``FEW`` trials: plain sums per place, aggregated by hash within generated code."""
    votes = first_votes.select("voter", "subject", "annotation").join(_weights(first_votes, trials, params), "voter")
    ratio = F.when(F.col("annotation") == 1, F.col("l1")).otherwise(F.col("l0"))
    places = [F.sum(F.get("_r", F.lit(k))).alias(f"_{k}") for k in range(trials.n)]
    sums = votes.select("subject", "block", ratio.alias("_r")).groupBy("subject", "block").agg(*places)
    return sums.select("subject", "block", F.array(*[f"_{k}" for k in range(trials.n)]).alias("sums"))


def _rows(moved: DataFrame, *columns: str) -> DataFrame:
    each = moved.select(*columns, "block", F.posexplode("sums").alias("k", "v")).withColumn("llr", F.round("v").cast("bigint")).where("llr <> 0")
    return each.select((F.col("block") * BLOCK + F.col("k")).alias("trial"), *columns, "llr")


def _own_keys(spark, n: int) -> list[int]:
    """A number for each of ``n`` partitions that is dealt to it: large tasks that shared one would run one after the other."""
    ids = F.col("id").cast("int")
    found = spark.range(n * (12 + n.bit_length())).groupBy(F.pmod(F.hash(ids), F.lit(n)).alias("at")).agg(F.min(ids).alias("key")).collect()
    keys = {r["at"]: r.key for r in found}
    return [keys.get(k, -1 - k) for k in range(n)]


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + count - 1`` of each pair, one after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _walk(order: list, last: int, holds: Callable, at: np.ndarray, cell: np.ndarray, counts: np.ndarray, starts: np.ndarray, subject: np.ndarray, n: int, g: float):
    """(trial, sums, changed) for each trial in ``order`` up to ``last``: the summed log ratios of ``n`` subjects.

    Entries (``at``: voter, ``cell``, ``counts``) come sorted by cell; the votes 0 and 1 of voter ``v`` are on ``subject[starts[2 v]:starts[2 v + 1]]`` and the next span.
    Sums are whole numbers: exact, however they were come by.
    """
    first, end = (np.searchsorted(cell, np.arange(len(holds(order[0]))), side) for side in ("left", "right"))
    held, sums = np.zeros(len(first), bool), np.zeros(n, np.int64)
    seen, weigh, had = np.zeros(((len(starts) - 1) // 2, 4), np.int64), np.zeros(len(starts) - 1, np.int64), np.diff(starts)
    for trial in order:
        if trial > last:
            continue
        now = holds(trial)
        moved = False
        turned = np.flatnonzero(now != held)
        turned = turned[end[turned] > first[turned]]
        if len(turned):
            entries = _spans(first[turned], end[turned] - first[turned])
            sign = np.where(now[cell[entries]], 1, -1)
            np.add.at(seen, at[entries], counts[entries] * sign[:, None])
            voters = np.unique(at[entries])
            l1, l0 = _ratios(seen[voters], g)
            votes, new = np.concatenate([2 * voters, 2 * voters + 1]), np.concatenate([l0, l1]).astype(np.int64)
            by = new - weigh[votes]
            weigh[votes] = new
            votes, by = votes[by != 0], by[by != 0]
            if len(votes):
                np.add.at(sums, subject[_spans(starts[votes], had[votes])], np.repeat(by, had[votes]))
                moved = True
        held = now
        yield trial, sums, moved


def _summed(first_votes: DataFrame, golds: DataFrame | None, trials: Trials, params: Params, emit: Callable, schema: pa.Schema, subjects: int, at_once: int, still: bool = True) -> DataFrame:
    """What ``emit(trial, sums, rows)`` makes of the summed log ratios of each trial, a bucket of subjects at a time: columns of equal length, to which the trial is added.
    ``still``: it depends on the sums alone, and is not asked again where they are those of the trial before.

    A task has the votes on one bucket of subjects and all label counts, and goes through ``at_once`` trials; where that is all of them, a vote is one row. The
    sums exist only in the task. ``rows``: ``subject``, and with ``golds`` how often it is among them by class (m, z, o; once unlabelled if it is not). A bucket holds about ``VOTES`` votes
    and ``subjects`` subjects at most. ``first_votes`` is a landed table.
    """
    spark = first_votes.sparkSession
    size = first_votes.agg(F.count("*").alias("v"), F.count_distinct("subject").alias("s")).first()
    buckets = max(-(-size.v // VOTES), -(-size.s // subjects), min(2 * spark.sparkContext.defaultParallelism, -(-size.v // FAIR)), 1)
    blocks = -(-trials.n // at_once)
    own = F.array(*map(F.lit, _own_keys(spark, blocks * buckets)))
    left = first_votes.select(F.col("voter").alias("voter"), F.col("subject").cast("bigint").alias("subject"), F.coalesce(F.col("annotation") == 1, F.lit(False)).alias("yes"), F.lit(None).cast("array<bigint>").alias("n"))
    if golds is not None:
        # a subject counts once for each of its rows among the golds
        per = golds.where("subject IS NOT NULL").groupBy("subject").agg(F.array(*[F.count_if(F.coalesce("gold", F.lit(-1)) == g) for g in CLASSES.values()]).alias("n"))
        left = left.unionByName(per.select(F.lit(None).cast("string").alias("voter"), F.col("subject").cast("bigint").alias("subject"), F.lit(False).alias("yes"), "n"))
    left = left.withColumn("bucket", F.pmod(F.xxhash64("subject"), F.lit(buckets)).cast("int"))
    last = trials.last if trials.last is not None else spark.range(1).select(F.lit(trials.n - 1).alias("_last"))
    right = _counted(first_votes, trials).crossJoin(F.broadcast(last)).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    left, right = (df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else df.withColumn("block", F.lit(0)) for df in (left, right))
    left, right = (df.withColumn("task", F.get(own, F.col("block") * buckets + F.col("bucket"))).drop("bucket") for df in (left, right))
    names, holds, order, g = list(consensus._counters()), trials.holds, trials.order, params.gamma
    out_schema = pa.schema([pa.field("trial", pa.int32()), *schema])

    def run(v: pa.Table, w: pa.Table) -> pa.Table:
        if not len(v) or not len(w):
            return out_schema.empty_table()
        block, classes = v["block"][0].as_py(), v.filter(pc.is_null(v["voter"]))
        v = v.filter(pc.is_in(v["voter"], w["voter"].combine_chunks())).select(["voter", "subject", "yes"])
        if not len(v):
            return out_schema.empty_table()
        known = pc.unique(v["voter"])
        w = w.filter(pc.is_in(w["voter"], known))
        held = w["c"].combine_chunks()
        c, at = held.flatten(), np.repeat(pc.index_in(w["voter"], known).to_numpy(), pc.list_value_length(held).to_numpy())
        cell, counts = c.field("cell").to_numpy(), np.stack([c.field(k).to_numpy() for k in names], 1)
        sort = np.argsort(cell, kind="stable")
        ids, subject = np.unique(v["subject"].to_numpy(), return_inverse=True)
        code = 2 * pc.index_in(v["voter"], known).to_numpy() + v["yes"].to_numpy()
        starts = np.searchsorted(code[by := np.argsort(code, kind="stable")], np.arange(2 * len(known) + 1))
        rows = {"subject": ids} | {k: np.full(len(ids), g == -1, np.int64) for k, g in CLASSES.items()}
        if len(classes):
            place = np.searchsorted(ids, own := classes["subject"].to_numpy())
            inside = ids[np.minimum(place, len(ids) - 1)] == own
            for k, n in zip(CLASSES, classes["n"].combine_chunks().flatten().to_numpy().reshape(len(own), -1).T):
                rows[k][place[inside]] = n[inside]
        parts, made = [[] for _ in out_schema], None
        for trial, sums, moved in _walk(order[block * at_once:(block + 1) * at_once], w["_last"][0].as_py(), holds, at[sort], cell[sort], counts[sort], starts, subject[by], len(ids), g):
            if made is None or moved or not still:
                made = emit(trial, sums, rows)
            parts[0].append(np.full(len(made[schema.names[0]]), trial, np.int32))
            for k, name in enumerate(schema.names, 1):
                parts[k].append(made[name])
        if not parts[0]:
            return out_schema.empty_table()
        return pa.Table.from_arrays([pa.chunked_array([pa.array(x, f.type) if isinstance(x, np.ndarray) else x for x in p], f.type) for p, f in zip(parts, out_schema)], schema=out_schema)

    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
    both = (df.repartition(blocks * buckets, "task").groupBy("task") for df in (left, right))
    return next(both).cogroup(next(both)).applyInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in out_schema))


def moved_scores(first_votes: DataFrame, trials: Trials, params: Params = Params()) -> DataFrame:
    """(trial, subject, llr): static scores of every distinct trial, of the subjects that it moves away from the prior."""
    if trials.n <= FEW:
        return trials.distinct(_rows(_few(first_votes, trials, params), "subject"))

    def emit(trial, sums, rows):
        at = np.flatnonzero(sums)
        return {"subject": rows["subject"][at], "llr": sums[at]}

    first = land(first_votes.select("voter", "subject", "annotation"), "first-votes")
    return _summed(first, None, trials, params, emit, pa.schema([("subject", pa.int64()), ("llr", pa.int64())]), SUBJECTS, BLOCK)


def _near(cutoff: float | None, params: Params) -> tuple[int, int] | None:
    """Summed log ratios between which scores are told apart where only a cutoff matters: a millionth of log-odds around it, much more than a score's last bits."""
    if cutoff is None or not 1e-6 < cutoff < 1 - 1e-6:
        return None
    at = round(consensus.NANO * (math.log(cutoff / (1 - cutoff)) - math.log(params.p0 / (1 - params.p0))))
    return at - 1000, at + 1000


def _moved_points(first_votes: DataFrame, trials: Trials, golds: DataFrame, params: Params, near: tuple | None) -> DataFrame:
    """(trial, llr, m, z, o): the subjects that a trial moves, counted by class within the tasks that sum them; they are taken off the prior's place (llr 0).

    Parts of sums: a place may have several rows.
    """
    if trials.n <= FEW:
        moved = trials.distinct(_rows(evaluate.with_golds(_few(first_votes, trials, params), golds), "gold"))
        llr = F.greatest(F.least("llr", F.lit(near[1])), F.lit(near[0])) if near else F.col("llr")
        both = F.explode(F.array(F.struct(llr.alias("llr"), F.lit(1).alias("n")), F.struct(F.lit(0).cast("bigint").alias("llr"), F.lit(-1).alias("n"))))
        return moved.select("trial", "gold", both.alias("r")).groupBy("trial", "r.llr").agg(*[F.sum(F.when(F.col("gold") == g, F.col("r.n")).otherwise(0)).alias(c) for c, g in CLASSES.items()])

    def emit(trial, sums, rows):
        at = np.flatnonzero(sums)
        values, n = sums[at], [rows[c][at] for c in CLASSES]
        if near:
            # of most subjects all that matters is the side they are on
            low, high = values <= near[0], values >= near[1]
            inside = ~(low | high)
            ends = [(near[0], low), (near[1], high)]
            values, sides = values[inside], [(end, [c[side].sum() for c in n]) for end, side in ends if side.any()]
            n = [c[inside] for c in n]
        llr, counts = _at_places(values, n)
        if near:
            llr, counts = np.append(llr, [end for end, _ in sides]), [np.append(c, [s[k] for _, s in sides]) for k, c in enumerate(counts)]
        return _taken_off(llr, counts)

    return _summed(first_votes, golds, trials, params, emit, _PLACES, 16 * SUBJECTS if near else SUBJECTS, trials.n if near else BLOCK)


_PLACES = pa.schema([(c, pa.int64()) for c in ("llr", *CLASSES)])


def _at_places(llr: np.ndarray, n: list) -> tuple[np.ndarray, list]:
    """The different values of ``llr`` and the sums of each ``n`` there."""
    low = int(llr.min()) if len(llr) else 0
    if len(llr) and int(llr.max()) - low < 4 * len(llr):
        place = llr - low
        held = np.flatnonzero(np.bincount(place))
        return held + low, [np.bincount(place, c)[held].astype(np.int64) for c in n]
    values, place = np.unique(llr, return_inverse=True)
    return values, [np.bincount(place, c, len(values)).astype(np.int64) for c in n]


def _taken_off(llr: np.ndarray, n: list) -> dict:
    """Rows of places, and the one that takes these subjects off the prior's place."""
    return {"llr": np.append(llr, 0).astype(np.int64)} | {c: np.append(k, -k.sum()).astype(np.int64) for c, k in zip(CLASSES, n)}


# ---- points where only a purity's threshold is asked -------------------------------------------

#: Rounds of bins that narrow down where a threshold can be, each by how many leading bits of a summed log ratio tell them apart: 32, then 1,024 bins from a number to its double.
STEPS = (5, 10)


def _ends(params: Params) -> tuple[int, int]:
    """Summed log ratios beyond which different ones may have equal scores: log-odds of -600 and 14."""
    prior = math.log(params.p0 / (1 - params.p0))
    return round(consensus.NANO * (-600 - prior)), round(consensus.NANO * (14 - prior))


def _bin(llr: np.ndarray, ends: tuple[int, int], steps: int) -> np.ndarray:
    """A number that grows with the summed log ratio; 0 for 0 alone. All equal scores are in one bin."""
    llr = np.clip(llr, *ends)
    size = (np.abs(llr).astype(float).view(np.int64) >> (52 - steps)) - (1023 << steps) + 1
    return np.sign(llr) * np.maximum(size, 0)


def _lowest(bins: np.ndarray, steps: int) -> np.ndarray:
    """The lowest summed log ratio in each bin."""
    least = lambda size: np.ceil(((size - 1 + (1023 << steps)) << (52 - steps)).view(float)).astype(np.int64)
    size = np.abs(bins.astype(np.int64))
    return np.where(bins == 0, 0, np.where(bins > 0, least(np.maximum(size, 1)), 1 - least(size + 1)))


def _open_bins(bins: np.ndarray, z: np.ndarray, o: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray]:
    """(start, whole): the first bin of each stretch, and whether it stands as one point; ``bins`` ascending, with the bogus and real subjects in each.

    The threshold is the lowest score from which on the real ones are more than ``target`` of the labelled. Within some bins it is somewhere between the real ones from the first bin's start on
    against the bogus ones beyond the last bin, and the real ones beyond against the bogus ones from the start on: where the most that can be is too little, the bins stand as one point, and so do all
    bins beyond the first one that surely has it. All others stay as they are.
    """
    real, bogus = (np.cumsum(c[::-1])[::-1].tolist() for c in (o, z))
    share = lambda r, b: r / (r + b) if r + b else 0.
    start, whole, since = [], [], None
    for k, b in enumerate(bins.tolist()):
        beyond = bogus[k + 1] if k + 1 < len(bogus) else 0
        if share(real[k], beyond) > target or b == 0:
            start.append(b), whole.append(False)
            since = None
            if share(real[k] - 1, bogus[k]) > target:
                if k + 1 < len(bogus):
                    start.append(int(bins[k + 1])), whole.append(True)
                break
        elif since is None or share(real[since], beyond) > target:
            start.append(b), whole.append(True)
            since = k
    return np.array(start, np.int64), np.array(whole, bool)


def _joined(llr: np.ndarray, stretches: tuple | None) -> np.ndarray:
    """``llr``, where a stretch stands as one point the lowest in it."""
    if stretches is None:
        return llr
    start, whole = stretches
    place = np.maximum(np.searchsorted(start, llr, "right") - 1, 0)
    return np.where(whole[place], start[place], llr)


def _packed(bins: np.ndarray, counts: list) -> bytes:
    """Bins and counts, in less room than a list of numbers takes."""
    return zlib.compress(np.stack([np.diff(bins, prepend=0), *counts]).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(rows: list, n: int) -> np.ndarray:
    """The bins and ``n`` counts of all rows."""
    each = [np.ascontiguousarray(np.frombuffer(zlib.decompress(r), np.uint8).reshape(4, -1).T).view("<i4").reshape(n + 1, -1).astype(np.int64) for r in rows]
    for x in each:
        x[0] = np.cumsum(x[0])
    return np.concatenate(each, 1)


def _stretches(first_votes: DataFrame, trials: Trials, golds: DataFrame, every: DataFrame, params: Params, target: float) -> dict:
    """{trial: (start, whole)}: the lowest summed log ratio of each of ``_open_bins``, and whether it stands as one point.

    What comes to the driver is bounded by the trials and the bins, not by the subjects.
    """
    ends, found = _ends(params), {}
    for steps in STEPS:
        def emit(trial, sums, rows, steps=steps, found=found):
            at = np.flatnonzero(sums)
            bins, counts = _at_places(_bin(_joined(np.clip(sums[at], *ends), found.get(trial)), ends, steps), [rows[c][at] for c in CLASSES])
            return {"packed": pa.array([_packed(bins, counts[1:])], pa.binary())}

        def merge(t: pa.Table) -> pa.Table:
            bins, z, o = _unpacked(t["packed"].to_pylist(), 2)
            bins, (z, o) = _at_places(bins, [z, o])
            bins, z, o = np.append(bins, 0), np.append(z, t["all_z"][0].as_py() - z.sum()), np.append(o, t["all_o"][0].as_py() - o.sum())
            sort = np.argsort(bins)
            start, whole = _open_bins(bins[sort], z[sort], o[sort], target)
            return pa.table({"trial": t["trial"][:1], "start": pa.array([_lowest(start, steps)], pa.list_(pa.int64())), "whole": pa.array([whole], pa.list_(pa.bool_()))})

        binned = _summed(first_votes, golds, trials, params, emit, pa.schema([("packed", pa.binary())]), 16 * SUBJECTS, trials.n, still=not found)
        binned = binned.crossJoin(F.broadcast(every.select(F.col("z").alias("all_z"), F.col("o").alias("all_o"))))
        got = binned.groupBy("trial").applyInArrow(merge, "trial int, start array<bigint>, whole array<boolean>").toArrow()
        found = {t: (np.array(s, np.int64), np.array(w, bool)) for t, s, w in zip(*(got[c].to_pylist() for c in ("trial", "start", "whole")))}
    return found


def _target_points(first_votes: DataFrame, trials: Trials, golds: DataFrame, every: DataFrame, params: Params, target: float) -> DataFrame:
    """(trial, llr, m, z, o) as ``_moved_points``; subjects that cannot be at the threshold are added up by stretch."""
    found = _stretches(first_votes, trials, golds, every, params, target)

    def emit(trial, sums, rows):
        at = np.flatnonzero(sums)
        return _taken_off(*_at_places(_joined(sums[at], found[trial]), [rows[c][at] for c in CLASSES]))

    return _summed(first_votes, golds, trials, params, emit, _PLACES, 16 * SUBJECTS, trials.n, still=False)


def trial_points(first_votes: DataFrame, trials: Trials, golds: DataFrame, params: Params = Params(), cutoff: float | None = None, target: float | None = None) -> DataFrame:
    """(keys, p, m, z, o): how many unlabelled, bogus and real subjects stand at each score of each distinct trial. Untouched subjects make one row per trial.

    With ``cutoff``, scores are only told apart near it: those beyond count at one score below and one above, which is all that ``trial_gold_metrics`` at this cutoff needs.
    With ``target``, scores are only told apart where the threshold for that purity can be: all that ``random_trial_points`` at this target needs.
    """
    many = trials.n > FEW
    if many:
        first_votes = land(first_votes.select("voter", "subject", "annotation"), "first-votes")
    # one row: the class totals of all subjects with votes
    every = evaluate.with_golds(first_votes.select("subject").distinct(), golds).agg(*[F.count_if(F.col("gold") == g).alias(c) for c, g in CLASSES.items()])
    if many:
        every = land(every, "class-totals")
    if many and target is not None:
        moved = _target_points(first_votes, trials, golds, every, params, target)
    else:
        moved = _moved_points(first_votes, trials, golds, params, _near(cutoff, params))
    whole = trials.distinct(trials.table).select("trial", F.lit(0).cast("bigint").alias("llr")).crossJoin(F.broadcast(every))
    points = moved.unionByName(whole).groupBy("trial", "llr").agg(*[F.sum(c).alias(c) for c in CLASSES]).where("m + z + o > 0")
    return points.join(F.broadcast(trials.table), "trial").select(*trials.keys, consensus.posterior(F.col("llr"), None, params).alias("p"), *CLASSES)


def trial_scores(first_votes: DataFrame, trials: Trials, params: Params = Params()) -> DataFrame:
    """(keys, subject, p): the whole score table of every trial, as trial rows need it (for points, ``trial_points`` is enough)."""
    moved = moved_scores(first_votes, trials, params)
    whole = first_votes.select("subject").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials.n - 1))))
    whole = trials.distinct(whole).join(moved, ["trial", "subject"], "left").join(F.broadcast(trials.table), "trial")
    return trials.for_all(whole.select(*trials.keys, "subject", consensus.posterior(F.col("llr"), None, params).alias("p")))


def random_trial_points(points: DataFrame, keys=("golds", "n"), target: float = .89) -> DataFrame:
    """Per trial the threshold for the wanted purity and the completeness there.

    The column named purity holds the threshold.
    """
    return evaluate.completeness_at_purity(points, target, runs=list(keys)).withColumnRenamed("threshold", "purity")


def cutoff_trial_points(points: DataFrame, keys=("controversial", "consensus"), cutoff: float = .96) -> DataFrame:
    """Purity and completeness of each trial at the cutoff, in one pass."""
    return trial_gold_metrics(points, list(keys), cutoff).select(*keys, "purity", "completeness")


def trial_gold_metrics(points: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """Gold counts, purity (p >= cutoff) and completeness (p > cutoff) per trial."""
    at = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    reach, above = F.col("p") >= cutoff, F.col("p") > cutoff
    return points.groupBy(*keys).agg(
        F.sum("m").alias("n_none"), F.sum("z").alias("n_bogus"), F.sum("o").alias("n_real"),
        F.try_divide(at(reach, "o"), at(reach, "z") + at(reach, "o")).alias("purity"),
        F.try_divide(at(above, "o"), F.sum("o")).alias("completeness"))


def trial_rows(scores: DataFrame, trial_golds: DataFrame, golds: DataFrame, keys: list[str], experiment: str) -> DataFrame:
    """(experiment, trial, subject, gold, p, used_gold); used_gold is -1 where the trial had no label."""
    used = trial_golds.select(*keys, "subject", F.col("gold").alias("used_gold"))
    out = evaluate.with_golds(scores, golds).join(used, [*keys, "subject"], "left")
    return out.select(F.lit(experiment).alias("experiment"), F.struct(*keys).alias("trial"), "subject", "gold", "p",
                      F.coalesce("used_gold", F.lit(-1)).alias("used_gold"))


def trial_points_from_rows(rows: DataFrame, keys: list[str], target: float = .89) -> DataFrame:
    """Rebuild the points from stored trial rows (which carry their gold)."""
    flat = rows.select("experiment", *[F.col(f"trial.{k}").alias(k) for k in keys], "subject", "gold", "p")
    return evaluate.completeness_at_purity(flat, target, runs=["experiment", *keys]).withColumnRenamed("threshold", "purity")


def trial_rerun(votes: DataFrame, rows: DataFrame, trial: dict, params: Params = Params(), dynamic=False) -> DataFrame:
    """Score again with the labels a stored trial used."""
    cond = F.lit(True)
    for k, v in trial.items():
        cond = cond & (F.col(f"trial.{k}") == v)
    used = rows.where(cond & F.col("used_gold").isin(0, 1)).select("subject", F.col("used_gold").alias("gold"))
    return (consensus.dynamic_scores if dynamic else consensus.static_scores)(votes, used, params)


def plot_grid(points: DataFrame, x: str, y: str, experiment: str, order: str = "sorted") -> DataFrame:
    """Points with purity x completeness and their cells."""
    from ..operators.layout import grid_layout
    named = points.withColumn("experiment", F.lit(experiment)).withColumnsRenamed({x: "golds", y: "n"})
    named = named.na.fill(0.0, ["purity", "completeness"])
    return grid_layout(named, order).withColumn("product", F.col("purity") * F.col("completeness"))


def select_golds(kind: str, *, gold_rows: DataFrame, votes: DataFrame | None = None, n: int | None = None,
                 subjects: DataFrame | None = None, literal: dict | None = None, seed=0, version="pow") -> DataFrame:
    """A gold set: all / random n / given subjects / controversial n / consensus n / a literal map."""
    from ..operators import relational as R
    latest = R.latest_gold(gold_rows)
    if kind == "all":
        return latest
    if kind == "random":
        return R.random_golds(gold_rows, n, seed)
    if kind == "subjects":
        return R.golds_for_subjects(latest, subjects)
    if kind in ("controversial", "consensus"):
        top = (aggregates.controversial_top if kind == "controversial" else aggregates.consensus_top)(votes, n, version)
        return R.golds_for_subjects(latest, top)
    if kind == "literal":
        return gold_rows.sparkSession.createDataFrame(sorted(literal.items()), "subject long, gold int")
    raise ValueError(f"unknown gold choice {kind!r}")


def union_golds(*sets: DataFrame) -> DataFrame:
    return gold_union(*sets)


def train_test(votes: DataFrame, train_golds: DataFrame, all_golds: DataFrame, params: Params = Params(),
               dynamic: bool = False) -> DataFrame:
    """Score with one gold set, label the scores with all golds."""
    run = consensus.dynamic_scores if dynamic else consensus.static_scores
    return evaluate.with_golds(run(votes, train_golds, params), all_golds)
