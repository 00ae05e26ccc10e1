"""Planted notations of private values: each is found, in text, and keeps its format."""
import datetime
import random
import re

from votelens.llm import pii

P = pii.PiiParams(key=b"test")


def test_planted_forms_are_all_found():
    rng, total = random.Random(8), 0
    for _ in range(200):
        d = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))
        if d.day <= 12:
            d = d.replace(day=d.day + 13)
        area, exchange, line = rng.randrange(200, 1000), rng.randrange(100, 1000), rng.randrange(10000)
        forms = {"date": [f"{d.day}/{d.month}/{d.year}", f"{d.day:02}/{d.month:02}/{d.year}", f"{d.month:02}/{d.day:02}/{d.year}", f"{d.year}/{d.month:02}/{d.day:02}",
                          f"{d.day}.{d.month}.{d.year}", d.isoformat()],
                 "phone": [f"{area} {exchange} {line:04}", f"({area}) {exchange} {line:04}", f"({area}){exchange} {line:04}", f"1 {area} {exchange} {line:04}",
                           f"+1 {area} {exchange} {line:04}", f"{area}-{exchange} {line:04}", f"{area} {exchange}-{line:04}"]}
        for kind, values in forms.items():
            for v in values:
                new, found = pii.pseudonymise(f"born or call {v}, thanks", P)
                assert found == {kind: 1}, v
                got = re.fullmatch(r"born or call (.+), thanks", new)[1]
                assert re.sub("[0-9]+", "0", got) == re.sub("[0-9]+", "0", v)
                assert pii.pseudonymise(got, P)[1] == {kind: 1}                      # the pseudonym is valid itself
                total += 1
    assert total == 200 * 13


def test_dates_are_linked_and_told_apart():
    at = lambda s: pii.pseudonymise(s, P)[0]
    y, m, d = at("1980-12-25").split("-")
    assert at("25/12/1980") == f"{d}/{m}/{y}" and at("12/25/1980") == f"{m}/{d}/{y}" and at("1980/12/25") == f"{y}/{m}/{d}" and at("25.12.1980") == f"{d}.{m}.{y}"
    days = [datetime.date(1980, 1, 1) + datetime.timedelta(i) for i in range(366)]
    texts = {f"{x.month:02}/{x.day:02}/{x.year}" for x in days} | {f"{x.day:02}/{x.month:02}/{x.year}" for x in days}
    assert len({at(x) for x in texts}) == len(texts)                                 # two values never share a pseudonym


def test_phones_are_told_apart_and_look_alikes_stay():
    values = [f"{a} {e} {n:04}" for a in (199, 200, 555, 987) for e in (99, 123, 200, 999) if e > 99 for n in range(30)]
    assert len({pii.pseudonymise(v, P)[0] for v in values}) == len(values)
    for keep in ("123 456 7890", "31/02/1980", "45/45/1980", "1980/13/25", "1980/02/30", "a/1980/12/25/b", "25/12/80"):
        assert pii.pseudonymise(keep, P) == (keep, {}), keep


def test_no_clear_text_whatever_the_length():
    for n in (10, 30, 64, 65, 100, 225, 300, 600, 1200, 5000):
        for make in ("password={}", "{}@example.org"):
            rng = random.Random(n)
            value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n - 1)) + "z"
            new, found = pii.pseudonymise(make.format(value), P)
            got = new.replace("password=", "").replace("@example.org", "")
            assert sum(found.values()) == 1 and len(got) == n and got.islower() and got.isalpha()
            same = sum(a == b for a, b in zip(got, value))
            assert same < 5 + n / 10 and got[:5] != value[:5], (n, same)          # one letter in 26 falls on itself by chance


def test_long_strings_are_permuted_one_to_one():
    p = pii.PiiParams(key=b"test", long=0)
    for n, abc in ((1, "0123456789"), (2, "0123456789"), (3, "01")):
        every = [""]
        for _ in range(n):
            every = [x + c for x in every for c in abc]
        sizes = [len(abc)] * n
        assert sorted(tuple(pii.feistel_places([abc.index(c) for c in x], sizes, "t", p)) for x in every) == sorted(tuple(abc.index(c) for c in x) for x in every)
    base = "x" * 300
    assert len({pii.permute_string(base[:i] + "y" + base[i + 1:], "t", P) for i in range(300)}) == 300


def test_time_is_linear():
    import time
    for text in ("0a" * 500_000, "a1b2+" * 200_000, "password=" + "q" * 1_000_000, "x" * 1_000_000 + "@example.org", "1 " * 500_000, "AB12 " * 200_000, "12.12." * 160_000):
        start = time.perf_counter()
        pii.pseudonymise(text, P)
        assert time.perf_counter() - start < 20, text[:20]        # quadratic time would be most of an hour


def test_a_key_is_required():
    import pytest
    with pytest.raises(TypeError):
        pii.PiiParams()
    with pytest.raises(ValueError):
        pii.PiiParams(key=b"")


# Plain versions of the simplest kinds: one pattern and one rule each, over whole texts.
PLAIN = {"email": re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", re.A), "ssn": re.compile(r"\b(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}\b", re.A)}


def test_whole_texts_against_plain_search(spark):
    """Every address and number that a plain search finds in the given texts is replaced, by one pseudonym for all documents, and no two by the same."""
    from pathlib import Path
    import pytest
    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("given tables not found")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    new = {r.doc_id: r.text for r in pii.replace(docs, P).collect()}
    found = 0
    pairs: dict = {k: {} for k in PLAIN}
    for r in docs.collect():
        for kind, pattern in PLAIN.items():
            old = pattern.findall(r.text or "")
            got = pattern.findall(new[r.doc_id] or "")
            assert len(old) == len(got)
            for a, b in zip(old, got):
                found += 1
                assert pairs[kind].setdefault(a, b) == b and a != b and len(a) == len(b)
    assert found > 10 and all(len(set(v.values())) == len(v) for v in pairs.values())
