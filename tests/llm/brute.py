"""Plain Python versions of the operators, for small tables."""
import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text, k):
    w = words(text, True)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_groups(docs, k, percent=80):
    """[(doc_id, set size, component)] of [(doc_id, text)], rows judged by their text."""
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in by[x] if j < i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)].append(d)
    return [(d, len(sets[i]), d if not sets[i] else min(ids[find(i)], default=None)) for i, (d, _) in enumerate(docs)]


def repeats(docs, n=50):
    """[(doc_id, words, removed, sha)]: every window against all of smaller ids."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i:i + n])] < d:
                gone[i:i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality_base(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def unigram(docs, smooth=.1):
    """[(doc_id, held_out, tokens, known, N, base)]"""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in docs]
    toks = [words(t, True) + [None] for _, t in docs]
    c = collections.Counter(w for t, h in zip(toks, held) if not h for w in t)
    n = sum(c.values())
    bottom = math.log10(n + smooth * (len(c) + 1))
    return [(d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(c[w] + smooth) - bottom for w in t)) for (d, _), h, t in zip(docs, held, toks)]


def bpe(data: bytes, ranks):
    """Merge the lowest-ranked pair until none is left."""
    parts = [bytes([b]) for b in data]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def mix(docs, seed="mix", epochs=3, weights=(1, 2, 3)):
    """[copies] of [(doc_id, text, source)]."""
    size = [len(words(t)) for _, t, _ in docs]
    names = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s))
    have = {s: sum(n for n, d in zip(size, docs) if d[2] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, left = {s: 0. for s in names if not have[s]}, sum(size), [s for s in names if have[s]]
    while left:
        level = rest / sum(weight[s] for s in left)
        full = [s for s in left if epochs * have[s] <= level * weight[s]]
        for s in full or left:
            target[s] = float(epochs * have[s]) if full else rest * weight[s] / sum(weight[x] for x in left)
        if not full:
            break
        rest, left = rest - sum(epochs * have[s] for s in full), [s for s in left if s not in full]
    copies = [0] * len(docs)
    for s in names:
        if have[s]:
            whole = math.floor(target[s] / have[s])
            at, more = 0, target[s] - whole * have[s]
            for h, i in sorted((hashlib.md5(f"{seed}:{d[0]}".encode()).hexdigest(), i) for i, d in enumerate(docs) if d[2] == s):
                copies[i] = whole + (whole < epochs and 2 * at + size[i] <= 2 * more)
                at += size[i]
    return copies
