"""Decontamination against every window in plain Python."""
import hashlib
import random
import re

import pytest
from brute import LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, row string, found string, w string, n_words string, item string, k int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, bench, n=10):
    wins: dict = {}
    for item, text in bench:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + k]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, items = words(text), set(), set()
        for k in range(1, n + 1):
            for i in range(len(w) - k + 1):
                if (got := wins.get(tuple(w[i:i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    items |= {str(x) for x in got if x is not None}
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(400)] + ["é", "ÑANDÚ", "x-y", "O'Neil", "A1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, text(rng.randrange(11, 40))) for i in range(30)]
    bench += [(30, "one two three"), (31, "Solo"), (32, ""), (33, None), (None, bench[0][1]), (34, bench[1][1]), (35, "..., !"), (2, "again and again one two"),
              (None, "nameless words here"), (100, " ".join(bench[2][1].split()[:10]))]
    docs = []
    for i in range(150):
        t = text(rng.randrange(0, 60))
        if i % 3 == 0:
            w = rng.choice([b for _, b in bench[:30]]).split()
            at, n = rng.randrange(len(w)), rng.choice([5, 9, 10, 11, 40])
            t = f"{t} {', '.join(w[at:at + n]).upper()} {text(5)}"
        if i % 7 == 0:
            t += " one, two\nTHREE"
        if i % 11 == 0:
            t = "solo " * 3 + t + " nameless/words/here"
        docs.append((i // 2 if i < 20 else i, t))
    docs += [(500, None), (501, ""), (502, "?!"), (None, bench[3][1]), (503, text(20_000) + " " + bench[4][1]), (504, bench[4][1]), (504, bench[4][1]), (505, "solo")]
    make = lambda rows: spark.createDataFrame([(d, t, "r", "f", "w", "n", "i", 1) for d, t in rows], DOCS).repartition(5)
    return docs, bench, make(docs), spark.createDataFrame([(i, t, "x", 3) for i, t in bench], "item_id long, text string, w string, k int")


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
order = lambda rows: sorted(rows, key=lambda x: tuple((v is not None, v) for v in x))


@pytest.mark.parametrize("params", [{}, {"spare": 1, "max_bits": 10}, {"send": 0}])
def test_against_brute_force(tables, params):
    """Also with a set so full that most windows have to be verified away, and with a window table that is not sent."""
    from votelens.llm import decontam
    docs, bench, d, b = tables
    got = decontam.contamination(d, b, decontam.DecontamParams(**params))
    assert got.columns == list(COLUMNS)
    assert order(tuple(r) for r in got.collect()) == order(brute(docs, bench))


def test_set_size_is_bounded(spark):
    from votelens.llm import decontam
    p = decontam.DecontamParams(max_bits=12)
    wins = spark.range(5000).selectExpr("xxhash64(id) AS h")
    bits, table = decontam.hash_set(wins, 5000, p)
    assert bits == 12 and len(table) == 64
    assert decontam.hash_set(wins, 3, decontam.DecontamParams())[0] == 10


def test_removing(tables):
    from votelens.llm import decontam
    docs, bench, d, b = tables
    verdict = {(r[0], t): r[5] for r, (_, t) in zip(brute(docs, bench), docs)}
    left = decontam.remove_documents(d, b)
    assert left.columns == d.columns
    assert order((r.doc_id, r.text) for r in left.collect()) == order(x for x in docs if not verdict[x])
    cut = decontam.remove_spans(d, b).collect()
    assert len(cut) == len(docs) and not any(t for t in brute([(r.doc_id, r.text) for r in cut if r.doc_id == 505], bench) if t[5])
    texts = {r.doc_id: r.text for r in cut}
    assert texts[505] == "" and texts[500] is None and texts[502] == "?!"
    by = {d: (t, n, h) for (d, t), (_, n, h, *_r) in zip(docs, brute(docs, bench))}
    for k in (503, 504):
        t, n, h = by[k]
        assert len(words(texts[k])) == n - h
    assert texts[503].split()[:100] == by[503][0].split()[:100]


def test_empty_tables(spark, tables):
    from votelens.llm import decontam
    docs, bench, d, b = tables
    assert decontam.contamination(d.limit(0), b).collect() == []
    got = decontam.contamination(d, b.limit(0)).collect()
    assert len(got) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    assert decontam.remove_spans(d, b.limit(0)).count() == len(docs) and decontam.remove_documents(d.limit(0), b).count() == 0
