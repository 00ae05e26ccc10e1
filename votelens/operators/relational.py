"""Filters, projections, grouping, sorting and set operations of the vote and score tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import hash_order

# ---- filters ---------------------------------------------------------------------------------


def match(field: str, value, eq: bool = True) -> Column:
    """Equal / not equal / in / not in. The negative forms also keep rows without a value."""
    c = F.col(field)
    if isinstance(value, (list, tuple, set)):
        inside = c.isin(list(value))
        return inside if eq else c.isNull() | ~inside
    return c == F.lit(value) if eq else ~c.eqNullSafe(F.lit(value))


def match_table(df: DataFrame, field: str, values: DataFrame, eq: bool = True) -> DataFrame:
    """``match`` against a list too long for an expression: semi / anti join on a one-column table.

    The anti join keeps rows whose field is null, as the expression form does.
    """
    v = values.toDF(field).where(F.col(field).isNotNull())
    return df.join(v, field, "left_semi" if eq else "left_anti")


def match_range(field: str, low, high) -> Column:
    """low <= x < high."""
    return (F.col(field) >= low) & (F.col(field) < high)


def expert_only(field: str = "gold") -> Column:
    return F.col(field).isin(0, 1)


def project(df: DataFrame, fields) -> DataFrame:
    """A name, a list or set of names, a (name, constant) pair, or a dict of new name -> name / column."""
    if isinstance(fields, str):
        return df.select(fields)
    if isinstance(fields, tuple):
        return df.select(F.lit(fields[1]).alias(fields[0]))
    if isinstance(fields, dict):
        return df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])
    return df.select(*sorted(fields) if isinstance(fields, set) else fields)


def first_votes(votes: DataFrame) -> DataFrame:
    """The default vote query: not seen before, the four scoring columns. The order stays a column."""
    return votes.where(~F.col("seen_before")).select(
        "user_id", "subject_id", "annotation", "session_id", "classification_id")


def debug_cap(votes: DataFrame, n: int) -> DataFrame:
    """The first n + 1 votes in order (the stop test follows the count, so one more is taken)."""
    return votes.orderBy("seq").limit(n + 1)


def metadata_slice(votes: DataFrame, metadata: DataFrame, field: str, low, high) -> DataFrame:
    """Votes whose subject's metadata field lies in [low, high)."""
    inside = metadata.where(match_range(field, low, high)).select("subject")
    return votes.join(inside, "subject", "left_semi")


def vote_exists(candidates: DataFrame, *stored: DataFrame) -> DataFrame:
    """Mark candidates whose classification id is already in one of the stored tables."""
    flagged = candidates
    known = None
    for i, table in enumerate(stored):
        ids = table.select("classification_id").distinct().withColumn(f"_k{i}", F.lit(True))
        flagged = flagged.join(ids, "classification_id", "left")
        hit = F.col(f"_k{i}").isNotNull()
        known = hit if known is None else known | hit
    return flagged.withColumn("known", known).drop(*[f"_k{i}" for i in range(len(stored))])


def validate_votes(raw: DataFrame, required=("user_id", "subject_id", "annotation")) -> DataFrame:
    """Rule columns on raw text rows: required fields present, annotation and gold_label whole numbers."""
    bad = F.lit(None).cast("string")
    for name in required:
        bad = F.coalesce(bad, F.when(F.col(name).isNull(), F.lit(f"missing {name}")))
    for name in ("annotation", "gold_label"):
        if name in raw.columns:
            bad = F.coalesce(bad, F.when(F.col(name).isNotNull() & F.col(name).cast("string").try_cast("int").isNull(),
                                         F.lit(f"not an int: {name}")))
    return raw.withColumn("reason", bad)


def schema_errors(df: DataFrame, declared) -> list[str]:
    """Differences of field set and types to a declared schema; empty if it fits exactly."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in declared}
    return ([f"missing {n}" for n in want if n not in have]
            + [f"unknown {n}" for n in have if n not in want]
            + [f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}"
               for n in want if n in have and have[n] != want[n]])


def extreme_share(scores: DataFrame) -> DataFrame:
    """Share of subjects whose score is exactly 0 or 1."""
    return scores.agg(F.avg(F.col("p").isin(0.0, 1.0).cast("int")).alias("share"))


def extreme_histories(history: DataFrame) -> DataFrame:
    """Subjects whose history touches 0 or 1."""
    return history.where(F.col("p").isin(0.0, 1.0)).select("subject").distinct()


# ---- groups, sorts, samples ------------------------------------------------------------------

def group_count(df: DataFrame, *fields) -> DataFrame:
    return df.groupBy(*fields).agg(F.count("*").alias("count"))


def group_push(df: DataFrame, fields: list[str], push: list[str], order: list[str]) -> DataFrame:
    """The collected members of each group as rows: group fields, position, pushed fields.

    Rows rather than one list per group, so that a very large group stays distributed; the list form is
    ``collect_list`` on top where groups are known to be small.
    """
    from .prefix import hot_blocks, running
    from ..params import Params
    rows = df.select(*fields, *order, *[p for p in push if p not in order], F.lit(1).alias("_one"))
    # the cut into blocks is by a hash of the group fields: a collision only cuts one group more
    rows = hot_blocks(rows.withColumn("_g", F.xxhash64(*fields)), "_g", order[0], Params())
    return (running(rows, fields, order, sums={"position": "_one"}, hot_only=True)
            .withColumn("position", F.col("position") - 1)
            .select(*fields, "position", *push))


def sort_many(df: DataFrame, keys: list[tuple[str, int]]) -> DataFrame:
    return df.orderBy(*[F.asc(k) if d > 0 else F.desc(k) for k, d in keys])


def top_by(df: DataFrame, metric: str, id_: str, n: int) -> DataFrame:
    """The n rows with the largest metric; ties by id. Planned as a per-task top n that is merged."""
    return df.orderBy(F.desc(metric), id_).limit(n)


def random_rows(df: DataFrame, id_: str, n: int, seed=0) -> DataFrame:
    """n random rows, the same ones for the same seed."""
    return df.withColumn("_h", hash_order(F.col(id_), seed)).orderBy("_h", id_).limit(n).drop("_h")


def random_golds(gold_rows: DataFrame, n: int, seed=0) -> DataFrame:
    """n random labelled rows of the gold table, then the latest label per subject."""
    rows = gold_rows.where(F.col("gold") != -1)
    picked = random_rows(rows.withColumn("_id", F.concat_ws("/", "subject", "load_seq")), "_id", n, seed)
    return latest_gold(picked)


def shuffle_rows(df: DataFrame, id_: str, seed=0) -> DataFrame:
    """A random order as a sort key column; sort on it only where the order itself is wanted."""
    return df.withColumn("shuffle_key", hash_order(F.col(id_), seed))


def shuffle_votes_within_subject(first_votes_df: DataFrame, seed=0) -> DataFrame:
    """A new random order of votes: ``seq`` replaced by a hash of it."""
    return first_votes_df.withColumn(
        "seq", F.conv(F.substring(hash_order(F.concat_ws("/", "subject", "voter"), seed), 1, 14), 16, 10).cast("bigint"))


# ---- gold tables and set operations ----------------------------------------------------------

def latest_gold(gold_rows: DataFrame) -> DataFrame:
    """Label of the highest load sequence per subject."""
    return gold_rows.groupBy("subject").agg(F.max_by("gold", "load_seq").alias("gold"))


def gold_union(*sets: DataFrame) -> DataFrame:
    """Several gold sets as one; a later set wins."""
    from .prefix import union_all
    ranked = union_all([s.select("subject", "gold").withColumn("rank", F.lit(i)) for i, s in enumerate(sets)])
    return ranked.groupBy("subject").agg(F.max_by("gold", "rank").alias("gold"))


def golds_for_subjects(golds: DataFrame, subjects: DataFrame) -> DataFrame:
    return golds.join(subjects.select("subject"), "subject", "left_semi")


def gold_replace(subjects: DataFrame, new_golds: DataFrame) -> DataFrame:
    """Known subjects with the new labels (-1 if not in the set), and the set's new subjects."""
    known = subjects.select("subject").distinct()
    return (known.join(new_golds.select("subject", "gold"), "subject", "full")
            .withColumn("gold", F.coalesce("gold", F.lit(-1))))


def id_set(df: DataFrame, id_: str = "subject") -> DataFrame:
    return df.select(id_).distinct()


def without_ids(df: DataFrame, ids: DataFrame, id_: str = "subject") -> DataFrame:
    return df.join(ids.select(id_), id_, "left_anti")


def vote_concat(dump: DataFrame, online: DataFrame) -> DataFrame:
    """The dump, then the online votes, as one ordered log."""
    from ..functions.parsing import scoring_view
    return scoring_view(dump, 0).unionByName(scoring_view(online, 1))


def split_union(*parts: tuple[str, DataFrame]) -> DataFrame:
    from .prefix import union_all
    return union_all([df.withColumn("split", F.lit(name)) for name, df in parts])
