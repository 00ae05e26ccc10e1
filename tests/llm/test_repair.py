"""Conversation repair against an automaton that goes turn by turn, in plain Python."""
import hashlib
import random
import re
import zlib

import pytest

KIND = "conv_id long, turn long, role string, text string, key string, times int, part int, seq int"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAME = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """(cost, audit, lines) of [(role, text, forced, cut)]: the least per state, three inserts allowed between turns."""
    best = {0: (0, "", ())}

    def inserts(best):
        best = dict(best)
        for _ in range(3):
            for q, (w, a, t) in list(best.items()):
                for c in "ua":
                    if (q, c) in NEXT:
                        v = (w + 3, a + "I", (*t, NAME[c] + ":"))
                        best[NEXT[q, c]] = min(best.get(NEXT[q, c], v), v, key=lambda x: x[:2])
        return best

    for role, text, forced, cut in turns:
        new: dict = {}

        def offer(q, *v):
            if q not in new or v[:2] < new[q][:2]:
                new[q] = v
        for q, (w, a, t) in inserts(best).items():
            offer(q, w + 4, a + "D", t)
            if not forced:
                if (q, role[:1]) in NEXT:
                    offer(NEXT[q, role[:1]], w + 3 * cut, a + "K", (*t, f"{role}:{text}"))
                for c in "ua":
                    if (q, c) in NEXT:
                        offer(NEXT[q, c], w + 3 + 3 * cut, a + "R", (*t, f"{NAME[c]}:{text}"))
        best = new
    best = inserts(best)
    return min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])


def brute(rows):
    convs: dict = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        held = convs.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
            held += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, turns, faults = set(), [], [0, 0, 0]
        for _, role, text in held:
            body = text.strip(" \t\n\v\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            turns.append((role, text, fault in (0, 1), fault == 2))
        marks = [t[0][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit, lines = cheapest(turns)
        numbers = {t for t, *_ in held if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        n = rng.choice([0, 1, 2, 3, 5, 8, 30])
        for k in range(n):
            role = ("user", "assistant")[k % 2] if rng.random() < .8 else rng.choice(["system", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "no", "Why?\n", "ok!", " ", "", None, "é…", "\x0b"]) if rng.random() < .5 else f"text {rng.random()}" + rng.choice([".", "", "? "])
            rows.append((c, rng.choice([k, k, k, k + 1, None]), role, text))
    rows += [(None, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(12)] + [(None, None, "user", "x")]
    rows += [(1000, k, ("user", "assistant")[k % 2], f"turn {k}" + ".?!"[k % 3]) for k in range(900)]                       # one long conversation
    rows += [(1000, 5, "user", "turn 4!")] * 40 + [(1001, 3, "user", "the same.")] * 200 + [(1002, None, "user", f"n{k}.") for k in range(30)]
    return rows


def order(rows):
    return sorted(rows, key=lambda x: tuple((v is not None, v) for v in x))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, 1, 2) for r in rows], KIND).repartition(4)


@pytest.mark.parametrize("seed, params", [(1, {}), (2, {"segment": 7}), (3, {"segment": 64, "band": 0}), (4, {"segment": 1})])
def test_against_brute_force(spark, seed, params):
    from votelens.llm import repair as R
    rows = conversations(seed)
    got = R.repair(R.damage(frame(spark, rows)), R.RepairParams(**params))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert order(tuple(r) for r in got.collect()) == order(brute(rows))


def test_alignment_by_length_equals_the_automaton():
    from votelens.llm import repair as R
    rng = random.Random(9)
    for k in range(3000):
        n = rng.randrange(0, 10)
        c = [rng.choice(["s", "u", "a", "u", "a", "x", ""]) for _ in range(n)]
        forced = [rng.random() < .2 for _ in c]
        cut = [rng.random() < .3 and not f for f in forced]
        want = cheapest([(x, "", f, k) for x, f, k in zip(c, forced, cut)])[:2]
        p = R.RepairParams(band=rng.choice([0, 1, 5, 12]))
        assert R.whole(R.Turns(c, forced, cut), p) == want
        at = rng.randrange(0, n + 1)
        x, y = (R.pairs(R.Turns(c[i], forced[i], cut[i]), p) for i in (slice(at), slice(at, n)))
        assert min((w + x[0, m][0], x[0, m][1] + a) for (m, z), (w, a) in y.items() if z in (0, 3) and (0, m) in x) == want


def test_a_narrow_band_is_widened():
    """Every turn by the user: the best repair is far from the narrow band's."""
    from votelens.llm import repair as R
    t = R.Turns(["u"] * 40, [False] * 40, [False] * 40)
    cost, audit = R.whole(t, R.RepairParams(band=0))
    assert cost == cheapest([("u", "", False, False)] * 40)[0] and audit == cheapest([("u", "", False, False)] * 40)[1]


def test_empty(spark):
    from votelens.llm import repair as R
    assert R.repair(R.damage(frame(spark, []))).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in R.repair(R.damage(frame(spark, [(dropped, 0, "user", "x.")]))).collect()] == [
        (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
