"""The template tree on deep paths, against the same rules in plain Python."""
import random


def brute(pages, bad, p):
    """{form: (template, verdict)} of one host, level by level, without limit of depth."""
    forms: dict = {}
    for page, path in pages:
        f = forms.setdefault(tuple(s for s in path.split("/") if s) or ("",), [0, 0, 0])
        f[0] += 1
        f[1] += page in bad
        f[2] += bad.get(page, 0)
    template = {f: "" for f in forms}
    for level in range(max(map(len, forms))):
        nodes: dict = {}
        for f, c in forms.items():
            if len(f) > level:
                child = nodes.setdefault(template[f], {}).setdefault(f[level], [0, 0, 0])
                for i in range(3):
                    child[i] += c[i]
        name = {}
        for node, children in nodes.items():
            n, ll, bb = (sum(c[i] for c in children.values()) for i in range(3))
            wide = len(children) > p.max_children and n < len(children) * p.child_pages
            near = {s: not wide and (b * ll - bb * l) ** 2 <= p.similar * bb * (ll - bb) * l for s, (_, l, b) in children.items()}
            for s in children:
                name[node, s] = "*" if wide else "~" if near[s] and sum(near.values()) > 1 else s
        for f in forms:
            if len(f) > level:
                template[f] += "/" + name[template[f], f[level]]
    tl, tb = (sum(c[i] for c in forms.values()) for i in (1, 2))
    out = {}
    for f in forms:
        l, b = (sum(c[i] for g, c in forms.items() if template[g] == template[f]) for i in (1, 2))
        out[f] = (template[f], "block" if tl and (b * tl + p.smooth * tb) * p.reject[1] >= (l + p.smooth) * tl * p.reject[0] else "allow")
    return out


def run(spark, pages, bad, p):
    from votelens.llm import urltree
    got = urltree.judge(spark.createDataFrame([(i, f"http://h.net{path}") for i, path in pages], "page_id long, url string"),
                        spark.createDataFrame(list(bad.items()), "page_id long, bad int"), p).collect()
    assert len(got) == len(pages)
    return {r.page_id: (r.template, r.verdict) for r in got}


def test_bad_branch_below_the_sixth_level(spark):
    from votelens.llm import urltree
    p = urltree.UrlParams(rules=())
    pages = [(i, f"/a/b/c/d/e/f/g/{('good', 'bad')[i % 2]}/x") for i in range(80)] + [(80, "/a/b"), (81, "/"), (82, "/a/b/c/d/e/f/g/good/x/y/z/t/u")]
    got = run(spark, pages, {i: i % 2 for i in range(80)}, p)
    assert all(got[i][1] == ("allow", "block")[i % 2] for i in range(80))
    assert got[1][0].endswith("/d/e/f/g/bad/x") and got[82][0].endswith("/d/e/f/g/good/x/y/z/t/u")


def test_deep_paths_against_plain_python(spark):
    from votelens.llm import urltree
    p, rng = urltree.UrlParams(rules=(), max_children=3, child_pages=4), random.Random(4)
    pages = []
    for i in range(600):
        depth = rng.choice([0, 1, 3, 6, 7, 8, 9, 12])
        pages.append((i, "/" + "/".join(rng.choice("uvw" if level % 3 == 2 and rng.random() < .8 else "abcdefgh"[:1 + level % 2]) for level in range(depth))))
    pages += [(600 + i, "/a/a/u/a/deep/" + "/".join("k" * 30) + f"/leaf{i}/z") for i in range(9)]
    bad = {i: int("v" in path or rng.random() < .1) for i, path in pages if rng.random() < .8}
    want, got = brute(pages, bad, p), run(spark, pages, bad, p)
    for i, path in pages:
        assert got[i] == want[tuple(s for s in path.split("/") if s) or ("",)], path
    assert {v for _, v in want.values()} == {"allow", "block"} and any(t.count("~") for t, _ in want.values()) and any("*" in t for t, _ in want.values())
