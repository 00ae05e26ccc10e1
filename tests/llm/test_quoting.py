"""Mail threads: links and threads on quoted lines, against plain Python that looks at every pair of messages."""
import random
from collections import Counter

RUN = 4


def parse(text):
    lines = []
    for line in text.split("\n"):
        bare = line.lstrip(" \t>")
        lines.append((line[:len(line) - len(bare)].count(">"), " ".join(bare.lower().split())))
    passages, last = [], None
    for i, (level, words) in enumerate(lines):
        if level != last:
            passages.append((level, []))
        passages[-1][1].append((i, words))
        last = level
    return passages


def keys(passage):
    """{line: [key]}: whole lines, and runs of words over line ends."""
    out = {i: [("line", w)] for i, w in passage if w}
    flat = [(x, i) for i, w in passage for x in w.split()]
    for j in range(len(flat) - RUN + 1):
        for i in {i for _, i in flat[j:j + RUN]}:
            out[i].append(("run", *[x for x, _ in flat[j:j + RUN]]))
    return out


def brute(messages):
    """{turn: (reply_to, n_linked)} of one conversation."""
    own = {t: {k for level, p in parse(x) if level == 0 for ks in keys(p).values() for k in ks} for t, x in messages}
    first = lambda k, t: min((o for o in own if o < t and k in own[o]), default=None)
    out = {}
    for t, text in messages:
        lines = [(level, ks) for level, p in parse(text) if level for ks in keys(p).values()]
        votes: dict = {}
        for level, ks in lines:
            votes.setdefault(level, Counter()).update(o for k in ks if k[0] == "run" and (o := first(k, t)) is not None)
        main = {level: max(v, key=lambda o: (v[o], -o)) for level, v in votes.items() if v}
        found = Counter()
        for level, ks in lines:
            of, is_main = Counter(), set()
            for k in ks:
                o, m = first(k, t), main.get(level)
                if o is not None:
                    hit = m is not None and k in own[m]
                    of[m if hit else o] += 1
                    if hit:
                        is_main.add(m)
            if of:
                found[level, max(of, key=lambda o: (o in is_main, of[o], -o))] += 1
        if found:
            out[t] = (max(found, key=lambda x: (-x[0], found[x], x[1]))[1], sum(found.values()))
    return out


def run(spark, messages):
    from votelens.llm import quoting
    rows = quoting.conversations(spark.createDataFrame([(1, t, "user", x) for t, x in messages], "conv_id long, turn long, role string, text string")).collect()
    assert len(rows) == len(messages)
    return {r.turn: r for r in rows}


def check(got, messages):
    want = brute(messages)
    for t, _ in messages:
        reply, n = want.get(t, (None, 0))
        assert (got[t].reply_to, got[t].n_linked) == (reply, n), t
        chain, depth = t, 0
        while chain in want:
            chain, depth = want[chain][0], depth + 1
        assert (got[t].thread, got[t].depth) == (chain, depth), t


def test_mail_thread(spark):
    a = "Hello all,\nthe quarterly figures are ready for review and\nthe meeting moves to Friday at noon.\nThanks,"
    b = "Nothing to report from the second floor today.\nThanks,"
    messages = [(1, "Something unrelated was said before.\nThanks,"), (2, a), (3, b),
                (4, "> the quarterly figures are ready\n> for review and the\n> meeting moves to Friday\n> at noon. Thanks,\nFine with me, see you there then."),      # re-wrapped
                (5, "> figures are ready for\nWhich figures do you mean exactly?"),                                                   # cut within a line
                (6, "> Nothing to report from the second floor today.\n> Thanks,\nGood to know about that floor."),                  # hot line goes with its passage
                (7, ">> the meeting moves to Friday at noon.\n> Fine with me, see you there then.\nI cannot come on Friday, sorry."),   # nested
                (8, "> Hello all,\n> Nothing to report from the second floor today.\nA tie of lines: more runs decide."),
                (9, "> words that nobody has ever written here\nLinks nothing."), (10, "> Thanks,\nA single hot line.")]
    got = run(spark, messages)
    check(got, messages)
    assert [got[t].reply_to for t in range(1, 11)] == [None, None, None, 2, 2, 3, 4, 3, None, 1]
    assert (got[4].n_linked, got[6].n_linked, got[7].thread, got[7].depth) == (4, 2, 2, 2)


def test_random_threads(spark):
    rng = random.Random(6)
    vocab, messages = [f"w{i}" for i in range(60)], []
    for t in range(1, 60):
        quote = []
        for _, x in rng.sample(messages, min(len(messages), rng.choice([0, 1, 1, 2]))):
            words = x.replace("\n", " ").split() if rng.random() < .5 else None
            if words:                                      # wrapped anew and cut
                lo, width = rng.randrange(len(words)), rng.randrange(2, 9)
                words = [w for w in words[lo:lo + 20] if set(w) != {">"}]
                quote += ["> " + " ".join(words[i:i + width]) for i in range(0, len(words), width)]
            else:
                quote += [(">" if line.startswith(">") else "> ") + line for line in x.split("\n")]
        own = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))] + ["Thanks,"] * rng.randrange(2)
        messages.append((t, "\n".join(quote + own)))
    check(run(spark, messages), messages)
