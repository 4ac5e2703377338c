"""URL rules against plain Python: hosts and paths, listed rules, mined rules, their index, odd rows."""

import itertools
import random
import re

from headway.llm import urls as U

RULES = U.RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def fits(host, path):
    own = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(own) if own else None


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/", "http://example.com/en", "http://com/", "http://com", "http://notcom/x", "http://x.net/es/1?a=/fr/", "x://net/fr/#a",
       "http://a.net?x://b.com/en/", "http://ÄB.com/é", "http://a.com\n.net/es/", "://net/es/", "http://www.example.com/en/a/../b", "a://b://c.com/", "http://user@example.com/en/", "http://" + "a." * 3000 + "net/es/" + "b/" * 5000]


def test_hosts_paths_and_listed_rules(spark):
    pages = spark.createDataFrame([(i if i % 3 else None, u) for i, u in enumerate(ODD * 2)], "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS rule", "2 AS tokens")
    none = U.mined(U.labelled(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    got = sorted(map(repr, (tuple(r) for r in U.judged(pages, none).select("page_id", "host", "path", "rule", "verdict").collect())))
    want = []
    for i, u in enumerate(ODD * 2):
        h, p = split(u)
        f = fits(h, p)
        want.append(repr((i if i % 3 else None, h, p, f and f[1], f[2] if f else "allow")))
    assert got == sorted(want)
    assert U.judged(pages.limit(0), none).count() == 0


def rows(seed, n):
    g, out = random.Random(seed), []
    for _ in range(n):
        t = sorted({f"host:{g.choice('abcd')}", f"path:{g.choice('efg')}", f"query:{g.choice('hij')}", f"scheme:{g.choice('kl')}"})
        bad = g.random() < (0.97 if {"host:a", "query:h"} <= set(t) else 0.95 if "path:g" in t and "host:b" in t else 0.2)
        out.append((t, bad))
    return out


def test_mined_like_brute_force(spark):
    data = rows(3, 900)
    count = {}
    for t, bad in data:
        for size in (1, 2, 3):
            for s in itertools.combinations(t, size):
                n = count.setdefault(s, [0, 0])
                n[0] += 1
                n[1] += bad
    rules = {s: b / n for s, (n, b) in count.items() if b >= 15 and b / n >= 0.8}
    want = {s for s, c in rules.items() if not any(rules.get(x, -1) >= c for k in range(1, len(s)) for x in itertools.combinations(s, k))}
    found = U.mined(spark.createDataFrame(data, "tokens array<string>, bad boolean"), least=15, part=0.0)
    got = {tuple(r.rule): r for r in found.collect()}
    assert want and set(got) == want
    assert all(abs(r.confidence - rules[s]) < 1e-9 and r.anchor in s for s, r in got.items())
    # unseen rows: the index finds what a scan finds, and mostly bad rows
    unseen = rows(4, 600)
    sets = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(unseen)], "key string, tokens array<string>")
    hit = {int(r.key) for r in U.matched(sets, found).collect()}
    assert hit == {i for i, (t, _) in enumerate(unseen) if any(set(s) <= set(t) for s in want)}
    bad = {i for i, (_, b) in enumerate(unseen) if b}
    planted = {i for i, (t, _) in enumerate(unseen) if {"host:a", "query:h"} <= set(t) or {"path:g", "host:b"} <= set(t)}
    assert planted <= hit and len(hit & bad) >= 0.85 * len(hit)


def test_verdicts_from_labels(spark):
    """A planted token combination is learned from labelled articles and blocks other pages; listed rules still win."""
    g = random.Random(1)
    pages = [(i, f"https://{'bets' if i % 4 == 0 else g.choice(['a', 'b'])}.example.{'org' if i % 8 < 6 else 'com'}/en/{i}?from=feed") for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 400) if g.random() < 0.6] + [(1, 1, None), (None, 0, 1)]
    df, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.page_id: r for r in U.judged(df, U.mined(U.labelled(df, known))).collect()}
    assert len(out) == 400
    for i, u in pages:
        f = fits(*split(u))
        assert out[i].verdict == (f[2] if f else "block" if i % 4 == 0 else "allow")
    assert {tuple(r.mined) for r in out.values() if r.mined} == {("host:bets",)}
