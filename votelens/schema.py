"""Declared table schemas and the parse rules that fill them."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

VOTES = T.StructType([
    T.StructField("classification_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("annotation", T.IntegerType()),
    T.StructField("workflow", T.LongType()),
    T.StructField("subject_id", T.LongType()),
    T.StructField("seen_before", T.BooleanType()),
    T.StructField("live_project", T.BooleanType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("time_stamp", T.TimestampType()),
])

SUBJECTS = T.StructType([
    T.StructField("subject", T.LongType()),
    T.StructField("gold", T.IntegerType()),
    T.StructField("object_id", T.LongType()),
    T.StructField("machine_score", T.DoubleType()),
    T.StructField("mag", T.DoubleType()),
    T.StructField("mag_err", T.DoubleType()),
])

GOLDS = T.StructType(SUBJECTS.fields[:2])

SCORES = T.StructType([
    T.StructField("subject", T.LongType()),
    T.StructField("gold", T.IntegerType()),
    T.StructField("p", T.DoubleType()),
])

USER_SCORES = T.StructType([
    T.StructField("voter", T.StringType()),
    T.StructField("s0", T.DoubleType()),
    T.StructField("s1", T.DoubleType()),
    T.StructField("n", T.LongType()),
])

_MISSING = object()


@dataclass(frozen=True)
class FieldRule:
    """Where one output field comes from and how it is cast.

    ``paths`` maps a source name to its alternative dotted paths, tried in order; the field's own
    name is tried next, then ``default`` if one is set. A path that is present with a null wins.
    """
    name: str
    type: str = "string"
    paths: dict = field(default_factory=dict)
    any_source: tuple = ()
    default: object = _MISSING

    @property
    def has_default(self):
        return self.default is not _MISSING

    def alternatives(self, source):
        return tuple(self.paths.get(source, self.any_source)) + (self.name,)


@dataclass(frozen=True)
class AnswerRule:
    """Which task's value counts as a 1 or a 0 vote."""
    task: str = "T1"
    value_path: str | None = None
    true: tuple = ("1",)
    false: tuple = ("0",)


# Field names and source paths of the vote feed and dump.
VOTE_RULES = (
    FieldRule("classification_id", "bigint", paths={"json": ("id",)}),
    FieldRule("user_id", "bigint"),
    FieldRule("workflow", "bigint", any_source=("workflow_id",)),
    FieldRule("subject_id", "bigint", paths={"csv": ("subject_ids",)}),
    FieldRule("seen_before", "boolean", any_source=("metadata.seen_before",), default=False),
    FieldRule("live_project", "boolean", any_source=("metadata.live_project",)),
    FieldRule("session_id", "string", any_source=("metadata.session",)),
    FieldRule("time_stamp", "timestamp", any_source=("created_at",)),
)

METADATA_RULES = (
    FieldRule("subject", "bigint", any_source=("subject_id",)),
    FieldRule("gold", "int", any_source=("gold_label",)),
    FieldRule("object_id", "bigint"),
    FieldRule("machine_score", "double"),
    FieldRule("mag", "double"),
    FieldRule("mag_err", "double"),
)

GOLD_RULES = METADATA_RULES[:2]
