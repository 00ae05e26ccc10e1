"""A small one-vote-at-a-time oracle for the tests."""
import math
import random


def random_log(seed, voters=12, subjects=15, n=300):
    r = random.Random(seed)
    golds = {s: r.choice([-1, 0, 1, 1, 0]) for s in range(subjects)}
    log = [(f"u:{r.randrange(voters)}", r.randrange(subjects), r.randrange(2), k) for k in range(n)]
    return log, golds


def sequential(log, golds, p0=.12, gamma=5.0, users=None):
    """(history per subject, final users, per-vote (s0, s1)) with the voter's matrix before each vote,
    or with the fixed matrices given."""
    seen, counts, hist, at_vote = set(), {}, {}, {}
    for voter, subject, vote, seq in sorted(log, key=lambda v: v[3]):
        if (voter, subject) in seen:
            continue
        seen.add((voter, subject))
        c = counts.setdefault(voter, [0, 0, 0, 0])
        s0, s1 = users[voter] if users else ((c[1] + gamma) / (c[0] + 2 * gamma), (c[3] + gamma) / (c[2] + 2 * gamma))
        at_vote[(voter, subject)] = (s0, s1)
        prior = hist.setdefault(subject, [p0])[-1]
        a, b = (s1, 1 - s0) if vote else (1 - s1, s0)
        total = prior * a + (1 - prior) * b
        hist[subject].append(prior * a / total if total else prior)
        gold = golds.get(subject, -1)
        if gold in (0, 1):
            c[2 * gold] += 1
            c[2 * gold + 1] += vote == gold
    final = {v: ((c[1] + gamma) / (c[0] + 2 * gamma), (c[3] + gamma) / (c[2] + 2 * gamma)) for v, c in counts.items()}
    return hist, final, at_vote


def static(log, golds, p0=.12, gamma=5.0):
    _, users, _ = sequential(log, golds, p0, gamma)
    hist, _, _ = sequential(log, golds, p0, gamma, users)
    return hist, users


def find_thresholds(rows, fpr, mdr):
    """rows: (p, gold). Rank forms of the two retirement limits."""
    zeros, ones = sorted(p for p, g in rows if g == 0), sorted((p for p, g in rows if g == 1), reverse=True)
    real = next((p for k, p in enumerate(zeros, 1) if 1 - k / len(zeros) < fpr), 0)
    bogus = next((p for k, p in enumerate(ones, 1) if 1 - k / len(ones) < mdr), 0)
    return bogus, real


def find_purity(rows, target):
    """Walk up, ties as unlabelled, bogus, real; the score at which the rest is pure enough."""
    left = {g: sum(1 for _, x in rows if x == g) for g in (-1, 0, 1)}
    for p, g in sorted(rows):
        left[g] -= 1
        n = left[0] + left[1]
        if n and left[1] / n > target:
            return p
    return 1.0


def logit(p):
    return math.log(p / (1 - p))
