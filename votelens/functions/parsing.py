"""Turn raw vote, metadata and gold records into typed rows with column expressions.

A record is one JSON object per row (string column). Rows that break a rule are kept, with the reason,
on the quarantine side instead of stopping the run.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import GOLD_RULES, METADATA_RULES, VOTE_RULES, AnswerRule, FieldRule

# Texts that stand for "no value", and the accepted booleans.
NULL_TEXTS = ("None", "null", "")
TRUE_TEXTS = ("True", "true")
FALSE_TEXTS = ("False", "false")
# Accepted time formats ("2017-01-24 17:00:38 UTC", "2017-06-22T11:29:50.609Z").
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]X")


def json_path(dotted: str, sep: str = ".") -> str:
    """``a.0.b`` -> ``$.a[0].b``; list positions are the all-digit steps."""
    return "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in dotted.split(sep))


def as_json(col: Column) -> Column:
    """Parsed JSON, or null where the text is not JSON."""
    return F.try_parse_json(col)


def nav_path(record: Column, dotted: str) -> Column:
    """Text of the value at a dotted path of a parsed record; null if absent or null."""
    return F.try_variant_get(record, json_path(dotted), "string")


def remap(record: Column, rule: FieldRule, source: str) -> tuple[Column, Column]:
    """(text, found) of one field of a parsed record, for use outside a whole-record parse."""
    value = found = None
    for path in rule.alternatives(source):
        here, got = path_present(record, path), nav_path(record, path)
        value = F.when(here, got) if value is None else value.when(here, got)
        found = here if found is None else found | here
    if rule.has_default:
        d = rule.default
        return value.otherwise(F.lit(None if d is None else str(d).lower() if isinstance(d, bool) else str(d))), F.lit(True)
    return value, found


def path_present(record: Column, dotted: str) -> Column:
    """True also where the path holds a JSON null, which differs from a missing path."""
    return F.try_variant_get(record, json_path(dotted), "variant").isNotNull()


class Fields:
    """Paths of a parsed record, each looked up once.

    ``add`` puts one variant column per path on the frame; rules then refer to those columns, so neither
    the parse nor the look-up is repeated per check.
    """

    def __init__(self, record: str, tag: str):
        self.record, self.tag, self.names = record, tag, {}

    def want(self, path: str) -> "Fields":
        self.names.setdefault(path, f"_{self.tag}{len(self.names)}")
        return self

    def add(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[F.try_variant_get(F.col(self.record), json_path(p), "variant").alias(n)
                                for p, n in self.names.items()])

    def texts(self, df: DataFrame) -> DataFrame:
        """Replace the variants by their texts and presence flags (true also for a JSON null)."""
        keep = [c for c in df.columns if c not in self.names.values()]
        return df.select(*keep, *[x for n in self.names.values() for x in (
            F.try_variant_get(F.col(n), "$", "string").alias(n), F.col(n).isNotNull().alias(f"{n}_here"))])

    def remap(self, rule: FieldRule, alternatives) -> tuple[Column, Column]:
        """(text, found): the first alternative that is present wins, even as a null."""
        value = found = None
        for path in alternatives:
            n = self.names[path]
            here = F.col(f"{n}_here")
            value = F.when(here, F.col(n)) if value is None else value.when(here, F.col(n))
            found = here if found is None else found | here
        if rule.has_default:
            d = rule.default
            text = None if d is None else str(d).lower() if isinstance(d, bool) else str(d)
            return value.otherwise(F.lit(text)), F.lit(True)
        return value, found


def parse_time(text: Column) -> Column:
    """Only the first format has blanks, so each text is tried against one format."""
    spaced, plain = (F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS)
    return F.when(text.contains(" "), spaced).otherwise(plain)


def cast_value(text: Column, type_: str) -> Column:
    """Empty texts become null; other texts are cast, null where the cast fails."""
    if type_ == "timestamp":
        return parse_time(text)
    blank = text.isin(*NULL_TEXTS)
    if type_ == "boolean":
        return (F.when(blank, F.lit(None)).when(text.isin(*TRUE_TEXTS), True)
                .when(text.isin(*FALSE_TEXTS), False))
    return F.when(~blank, text.try_cast(type_))


def cast_failed(text: Column, type_: str) -> Column:
    """True where a text that is not empty could not be cast. A time may not be empty."""
    bad = cast_value(text, type_).isNull()
    if type_ == "timestamp":
        return bad
    return F.coalesce(~text.isin(*NULL_TEXTS), F.lit(False)) & bad


def find_task(annotations: Column, task: str) -> Column:
    """The entry of a task: the first list item with that task, or the first item under that key."""
    entry = "struct<task:string,value:variant>"
    in_list = F.filter(F.try_variant_get(annotations, "$", f"array<{entry}>"), lambda t: t["task"] == task)
    in_map = F.try_variant_get(annotations, f"$.{task}[0]", entry)
    return F.coalesce(in_map, F.get(in_list, F.lit(0)))


def map_answer(value: Column, rule: AnswerRule) -> Column:
    """1 / 0 for a listed answer, else null."""
    text = F.try_variant_get(value, json_path(rule.value_path) if rule.value_path else "$", "string")
    return F.when(text.isin(*map(str, rule.true)), 1).when(text.isin(*map(str, rule.false)), 0)


@dataclass
class Parsed:
    """Checked rows: ``raw``, the typed columns and ``reason`` (null if accepted)."""
    checked: DataFrame
    columns: list
    ok: Column | None = None       # a stored flag in place of the test on ``reason``

    def _ok(self) -> Column:
        return F.col("reason").isNull() if self.ok is None else self.ok

    @property
    def accepted(self) -> DataFrame:
        return self.checked.where(self._ok()).select(*self.columns)

    @property
    def quarantine(self) -> DataFrame:
        return self.checked.where(~self._ok()).select("raw", "reason")


def _ruled(rows: DataFrame, fields: list, keep: list):
    """Resolve (fields, rule, alternatives) triples: one text column per rule, then typed columns and checks."""
    for f in {id(f): f for f, _, _ in fields}.values():
        rows = f.add(rows)
    for f in {id(f): f for f, _, _ in fields}.values():
        rows = f.texts(rows)
    texts, founds = [], []
    for f, rule, alternatives in fields:
        text, found = f.remap(rule, alternatives)
        texts.append(text.alias(f"t_{rule.name}"))
        founds.append(found.alias(f"f_{rule.name}"))
    rows = rows.select(*keep, *texts, *founds)
    rows = rows.select("*", *[cast_value(F.col(f"t_{r.name}"), r.type).alias(r.name) for _, r, _ in fields])
    checks = []
    for _, r, _ in fields:
        checks.append((~F.col(f"f_{r.name}"), F.lit(f"missing {r.name}")))
        empty = F.lit(False) if r.type == "timestamp" else \
            F.col(f"t_{r.name}").isNull() | F.col(f"t_{r.name}").isin(*NULL_TEXTS)
        checks.append((~empty & F.col(r.name).isNull(), F.lit(f"bad {r.name}")))
    return rows, checks


def _reason(checks) -> Column:
    out = None
    for cond, text in checks:
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


def _split(rows: DataFrame, columns) -> Parsed:
    """Accepted and rejected rows of one checked frame.

    The checks are evaluated in a generator: a plain projection would let the optimizer move the test on
    ``reason`` down and write the whole parse out once more inside a filter.
    """
    one = F.struct(*[F.col(c) for c in columns], F.col("reason"))
    checked = rows.select("raw", F.inline(F.array(one)))
    return Parsed(checked, columns)


def parse_votes(raw: DataFrame, source: str, answer: AnswerRule = AnswerRule(), rules=VOTE_RULES) -> Parsed:
    """``raw`` has one JSON record per row in column ``raw``.

    In the dump ``metadata`` and ``annotations`` are JSON texts inside the record; they are parsed again
    where they are strings.
    """
    top, meta = Fields("_rec", "r"), Fields("_meta", "m")
    fields = []
    for rule in rules:
        alternatives = rule.alternatives(source)
        inner = tuple(p.removeprefix("metadata.") for p in alternatives if p.startswith("metadata."))
        where, paths = (meta, inner) if inner else (top, alternatives)
        for p in paths:
            where.want(p)
        fields.append((where, rule, paths))

    rows = raw.select("raw", as_json(F.col("raw")).alias("_rec"))
    rows = rows.select("*", *[F.try_variant_get("_rec", f"$.{n}", "variant").alias(f"_{n}_v") for n in ("metadata", "annotations")])

    def opened(name):
        v = F.col(f"_{name}_v")
        return F.when(F.schema_of_variant(v) == "STRING", as_json(F.try_variant_get(v, "$", "string"))).otherwise(v)

    rows = rows.select("raw", "_rec", opened("metadata").alias("_meta"), opened("annotations").alias("_ann"))
    rows = rows.select("raw", "_rec", "_meta", F.col("_rec").isNotNull().alias("is_json"), F.col("_meta").isNotNull().alias("has_meta"),
                       find_task(F.col("_ann"), answer.task)["value"].alias("_value"))
    rows = rows.select("*", map_answer(F.col("_value"), answer).cast("int").alias("annotation"))
    rows, checks = _ruled(rows, fields, ["raw", "is_json", "has_meta", "annotation"])
    checks = [(~F.col("is_json"), F.lit("not json")), (~F.col("has_meta"), F.lit("bad metadata")), *checks,
              (F.col("annotation").isNull(), F.lit("no valid annotation"))]
    return _split(rows.withColumn("reason", _reason(checks)), [r.name for r in rules] + ["annotation"])


def parse_metadata(raw: DataFrame, source: str = "csv", rules=METADATA_RULES) -> Parsed:
    top = Fields("_rec", "r")
    for rule in rules:
        for p in rule.alternatives(source):
            top.want(p)
    rows = raw.select("raw", as_json(F.col("raw")).alias("_rec"), F.lit(True).alias("is_json"))
    rows = rows.withColumn("is_json", F.col("_rec").isNotNull())
    rows, checks = _ruled(rows, [(top, r, r.alternatives(source)) for r in rules], ["raw", "is_json"])
    checks = [(~F.col("is_json"), F.lit("not json")), *checks]
    return _split(rows.withColumn("reason", _reason(checks)), [r.name for r in rules])


def parse_golds(raw: DataFrame, source: str = "csv") -> Parsed:
    return parse_metadata(raw, source, GOLD_RULES)


def voter_key(user_id: Column, session_id: Column) -> Column:
    """User id, else session id, tagged so the two id spaces cannot meet."""
    return F.coalesce(F.concat(F.lit("u:"), user_id.cast("string")), F.concat(F.lit("s:"), session_id))


def order_key(classification_id: Column, source_rank: int = 0) -> Column:
    """One long that orders the dump before online votes and by id within each (ids below 2^60)."""
    return (F.shiftleft(F.lit(source_rank).cast("bigint"), 60) + classification_id.cast("bigint"))


def scoring_view(votes: DataFrame, source_rank: int = 0) -> DataFrame:
    """The four columns scoring reads, from a parsed vote table."""
    return votes.select(voter_key(F.col("user_id"), F.col("session_id")).alias("voter"),
                        F.col("subject_id").alias("subject"), "annotation",
                        order_key(F.col("classification_id"), source_rank).alias("seq"))
