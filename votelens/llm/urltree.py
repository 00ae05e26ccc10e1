"""URL filter: a tree of path templates per host, in DataFrame operations only.

1. A path's segments are generalised by their form: digits, hexadecimal ids and digits with a suffix become wildcards. Urls are
   counted per (host, template), with the labelled and the bad ones, so everything after works on templates.
2. Level by level from the host down, the children of a node are counted. Where a node has more than ``max_children``
   different children and they hold few pages each, the segment is variable: its children become one wildcard.
3. Sibling branches whose share of bad pages does not differ from that of all siblings (a two-proportion test in whole
   numbers) are merged into one branch.
4. A finished template is rejected if its smoothed bad share, with ``smooth`` pages of the table's overall share added,
   reaches ``reject``.
Explicit rules (host and its subdomains, path prefix; the longest wins) come before the tree's verdict.

Cases: null url or no ``://``: host and path empty, a node of its own. Empty path: no segments. Paths of any depth are followed to
their last segment. Labels: several of one page count as bad if one is; of unknown pages they are ignored. No labels: every
template is allowed. Repeated rows count each and are returned each. Empty table: no rows.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import land


@dataclass(frozen=True)
class UrlParams:
    """``rules``: (verdict, host + path prefix), a short list given by hand; each becomes an expression."""
    rules: tuple = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
    depth: int = 6                 # of the SQL only, which is right for paths of up to so many segments
    max_children: int = 20
    child_pages: int = 10          # children with fewer pages on average are variable
    similar: int = 4               # square of the z value below which branches are merged
    smooth: int = 8
    reject: tuple = (1, 2)         # bad share from which a template goes, as a fraction


def parts(url) -> tuple:
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, p: UrlParams) -> tuple:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(p.rules, key=lambda x: len(x[1])):
        h, _, q = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + q)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def form(path):
    """Segments of a path with those of variable form as wildcards."""
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segs, lambda s: F.when(s.rlike(r"^[0-9]+$"), "{n}")
                       .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}."), F.regexp_extract(s, r"\.([A-Za-z0-9]+)$", 1)))
                       .when(s.rlike(r"^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*$") & (F.length(s) >= 8), "{x}").otherwise(s))


def templates(pages: DataFrame, bad: DataFrame, p: UrlParams) -> tuple[DataFrame, DataFrame]:
    """Pages with ``host``, ``path`` and ``form``; counts per (host, form). ``bad``: page_id, bad 0 / 1."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("form", F.array_join(form(F.col("path")), "/"))
    known = bad.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = (rows.select("page_id", "host", "form").join(known, "page_id", "left").groupBy("host", "form")
              .agg(F.count("*").alias("n"), F.count("bad").alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("b")))
    return rows, counts


def grow(counts: DataFrame, p: UrlParams) -> DataFrame:
    """(host, form, n, l, b, template): every form's place in the generalised tree.

    Rounds go on until no form has a further segment. A segment that all forms of a node share is an only child, which keeps its name; so each
    round first takes the segments that a node's forms have in common at once, and rounds grow with the branchings of a path only.
    """
    t = land(counts.withColumn("segs", F.split("form", "/")).withColumn("template", F.lit("")).withColumn("at", F.lit(0)), "url-tree")
    grown = []
    while True:
        rest = F.slice("segs", F.col("at") + 1, F.size("segs"))
        ends = t.groupBy("host", "template").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
        # the least and the greatest differ where any two do; 0: nowhere
        differ = F.array_position(F.zip_with("lo", "hi", lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
        shared = ends.select("host", "template", F.when(differ == 0, F.size("lo")).otherwise(differ - 1).alias("shared"))
        t = t.join(shared, ["host", "template"]).withColumn("template", F.concat_ws("/", "template", F.slice("segs", F.col("at") + 1, F.col("shared"))))
        t = t.withColumn("at", F.col("at") + F.col("shared")).drop("shared").withColumn("seg", F.get("segs", F.col("at")))
        child = t.groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in "nlb"])
        node = child.where("seg IS NOT NULL").groupBy("host", "template").agg(
            F.count("*").alias("k"), *[F.sum(c).alias(f"all_{c}") for c in "nlb"])
        # numbers up to about 2^50 labelled pages per node stay exact in decimals
        d = {c: F.col(c).cast("decimal(15,0)") for c in ("l", "b", "all_l", "all_b")}
        diff = (d["b"] * d["all_l"] - d["all_b"] * d["l"]).cast("double")
        f = {c: F.col(c).cast("double") for c in ("l", "all_l", "all_b")}
        near = diff * diff <= F.lit(float(p.similar)) * f["all_b"] * (f["all_l"] - f["all_b"]) * f["l"]
        child = (child.where("seg IS NOT NULL").join(node, ["host", "template"])
                 .withColumn("wide", (F.col("k") > p.max_children) & (F.col("all_n") < F.col("k") * p.child_pages))
                 .withColumn("near", near & ~F.col("wide")))
        twins = child.groupBy("host", "template").agg(F.count_if("near").alias("twins"))
        named = (child.join(twins, ["host", "template"])
                 .select("host", "template", "seg", F.when(F.col("wide"), "*").when(F.col("near") & (F.col("twins") > 1), "~")
                         .otherwise(F.col("seg")).alias("name")))
        t = (t.join(named, ["host", "template", "seg"], "left")
             .withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", "name")))
             .withColumn("at", F.col("at") + 1).drop("name", "seg"))
        t = land(t, "url-tree")
        more = F.size("segs") > F.col("at")
        grown.append(t.where(~more).drop("segs", "at"))
        t = t.where(more)
        if not t.limit(1).count():
            return reduce(DataFrame.unionByName, grown)


def judged(grown: DataFrame, p: UrlParams) -> DataFrame:
    """(host, form, template, l, b, verdict) of every form."""
    whole = grown.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("tl"), F.coalesce(F.sum("b"), F.lit(0)).alias("tb"))
    per = grown.groupBy("host", "template").agg(F.sum("l").alias("tpl_l"), F.sum("b").alias("tpl_b"))
    up, down = p.reject
    # (b + smooth * tb / tl) / (l + smooth) >= up / down, in whole numbers; one row joins
    per = per.crossJoin(F.broadcast(whole)).withColumn("verdict", F.when(
        (F.col("tl") > 0) & ((F.col("tpl_b") * F.col("tl") + p.smooth * F.col("tb")) * down >= (F.col("tpl_l") + p.smooth) * F.col("tl") * up),
        "block").otherwise("allow"))
    return grown.join(per.select("host", "template", "tpl_l", "tpl_b", "verdict"), ["host", "template"]).select(
        "host", "form", "template", "tpl_l", "tpl_b", "verdict")


def judge(pages: DataFrame, bad: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """(page_id, host, path, template, rule, verdict) of every row of ``pages`` (page_id, url)."""
    rows, counts = templates(pages, bad, p)
    tree = judged(grow(counts, p), p).select("host", "form", "template", F.col("verdict").alias("grown"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), p)
    return rows.join(tree, ["host", "form"]).select("page_id", "host", "path", "template", rule.alias("rule"),
                                                    F.coalesce(verdict, F.col("grown")).alias("verdict"))


def oracle(p: UrlParams = UrlParams()) -> str:
    """The same tree in DuckDB SQL over ``pages`` and ``labels``."""
    case = lambda i: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{q}') THEN '{(v, r)[i]}'"
        for v, r in sorted(p.rules, key=lambda x: -len(x[1])) for h, _, q in [r.partition("/")]) + " END"
    sql = f"""WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    g AS (SELECT *, [CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{{n}}'
        WHEN regexp_full_match(s, '[0-9]+\\.[A-Za-z0-9]+') THEN '{{n}}.' || regexp_extract(s, '\\.([A-Za-z0-9]+)$', 1)
        WHEN regexp_full_match(s, '[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*') AND length(s) >= 8 THEN '{{x}}' ELSE s END
        FOR s IN string_split(path, '/') IF s <> ''] AS gs FROM hp),
    f AS (SELECT page_id, host, path, array_to_string(CASE WHEN len(gs) > {p.depth} THEN gs[1:{p.depth}] || ['**'] ELSE gs END, '/') AS form FROM g),
    known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
    t0 AS (SELECT host, form, string_split(form, '/') AS segs, '' AS template, count(*) AS n, count(bad) AS l, coalesce(sum(bad), 0)::BIGINT AS b
      FROM f LEFT JOIN known USING (page_id) GROUP BY host, form)"""
    for i in range(p.depth + 1):
        sql += f""",
    c{i} AS (SELECT host, template, segs[{i + 1}] AS seg, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM t{i} WHERE segs[{i + 1}] IS NOT NULL GROUP BY 1, 2, 3),
    d{i} AS (SELECT *, count(*) OVER w AS k, sum(n) OVER w AS nn, sum(l) OVER w AS ll, sum(b) OVER w AS bb FROM c{i} WINDOW w AS (PARTITION BY host, template)),
    e{i} AS (SELECT *, k > {p.max_children} AND nn < k * {p.child_pages} AS wide,
      power((b * ll - bb * l)::DOUBLE, 2) <= {float(p.similar)} * bb::DOUBLE * (ll - bb)::DOUBLE * l::DOUBLE AS near FROM d{i}),
    n{i} AS (SELECT host, template, seg, CASE WHEN wide THEN '*' WHEN near AND count(*) FILTER (WHERE near AND NOT wide) OVER (PARTITION BY host, template) > 1
      THEN '~' ELSE seg END AS name FROM e{i}),
    t{i + 1} AS (SELECT t.host, t.form, t.segs, CASE WHEN x.seg IS NULL THEN t.template ELSE t.template || '/' || x.name END AS template, t.n, t.l, t.b
      FROM t{i} t LEFT JOIN n{i} x ON t.host = x.host AND t.template = x.template AND t.segs[{i + 1}] = x.seg)"""
    up, down = p.reject
    return sql + f""",
    tot AS (SELECT coalesce(sum(l), 0) AS tl, coalesce(sum(b), 0) AS tb FROM t0),
    v AS (SELECT host, template, CASE WHEN any_value(tl) > 0 AND (sum(b) * any_value(tl) + {p.smooth} * any_value(tb)) * {down}
      >= (sum(l) + {p.smooth}) * any_value(tl) * {up} THEN 'block' ELSE 'allow' END AS grown FROM t{p.depth + 1}, tot GROUP BY 1, 2)
    SELECT page_id, host, path, template, {case(1)} AS rule, coalesce({case(0)}, grown) AS verdict
    FROM f JOIN t{p.depth + 1} USING (host, form) JOIN v USING (host, template)"""
