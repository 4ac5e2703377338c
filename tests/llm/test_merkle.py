"""The Merkle manifest against a plain recursion, at block sizes that take every way."""

import zlib
from hashlib import sha256

import pytest

from headway.llm import merkle as M


def h(*inputs):
    return sha256("".join(inputs).encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for k, v in enumerate(row):
        if v is not None and k == 4 and lower:
            v = "".join(c.lower() if "A" <= c <= "Z" else c for c in v)
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def tree(nodes):
    """Root, and siblings of each node as lists of (left, right)."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, k in enumerate(at):
            s = k // 8 * 8
            ways[i].append((level[s:k], level[k + 1 : s + 8]))
        level, at = [h(*level[k : k + 8]) for k in range(0, len(level), 8)], [k // 8 for k in at]
    return level[0], ways


def brute(rows):
    langs, out, subs = {}, [], []
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs.append(tree([leaf(r) for r in langs[x]]))
    root, above = tree([s for s, _ in subs])
    for x, (sub, ways), up in zip(order, subs, above):
        for r, way in zip(langs[x], ways):
            f = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in way + up:
                f = h(*left, f, *right)
            out.append((r[0], leaf(r), sub, root, h(*(n for left, right in way + up for n in left + right)), f, f == root))
    return sorted(out, key=repr)


def result(spark, rows, levels, top):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS at", "'t' AS tree", "0 AS leaf", "'n' AS n")
    out = M.manifest(df.repartition(3), levels, top)
    return sorted((tuple(r) for r in out.drop("lang").collect()), key=repr)


ROWS = [(i * 7 % 1000, f"s{i % 3}", None if i % 10 == 9 else "en" if i % 10 < 6 else f"l{i % 10}", i, f"Text {i} Ünder") for i in range(700)]


@pytest.mark.parametrize("levels, top", [(4, 4096), (1, 4096), (2, 5), (1, 3)])
def test_like_recursion(spark, levels, top):
    assert result(spark, ROWS, levels, top) == brute(ROWS)


def test_many_languages(spark):
    rows = [(i, "s", f"lang{i % 90}", 1, "A" * (i % 5)) for i in range(200)]
    assert result(spark, rows, 1, 4) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 0, ""), (5, "s", "de", 3, "X" * 200_000), (5, "s", "de", 3, "ABC"), (5, "s", "de", 3, "ABC"), (6, None, "fr", None, None), (7, "4:", "", 1, "-"), (-3, "s", "Z", 1, "É"), (9, "s", "ä", 1, "Q\x00Z")]
    for many in (rows, rows[2:3], rows[:1], [(i % 2, "s", "en", 1, "Same") for i in range(60)]):
        assert result(spark, many, 1, 4) == brute(many)
        assert result(spark, many, 4, 4096) == brute(many)
    assert result(spark, rows[:0], 1, 4) == []


def test_tampering_is_seen(spark):
    got = result(spark, ROWS, 4, 4096)
    third = {r[0] for r in got if zlib.crc32(str(r[0]).encode()) % 3 == 0}
    assert third and all(r[6] == (r[0] not in third) for r in got)
