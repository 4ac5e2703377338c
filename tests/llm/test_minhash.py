import random
import re
from itertools import combinations

from headway.llm import minhash


def sets_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n):
    s = {d: sets_of(t, n) for d, t in rows}
    root = {d: d for d in s}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by = {}
    for d, x in s.items():
        for k in x:
            by.setdefault(k, set()).add(d)
    for a, b in {p for v in by.values() for p in combinations(sorted(v), 2)}:
        i = len(s[a] & s[b])
        if 100 * i >= 80 * (len(s[a]) + len(s[b]) - i):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s[d]), find(d)) for d in s}


def test_edges(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    base = [[word() for _ in range(rng.randint(30, 120))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append((i * 3, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one TWO"), (1005, "one two three"), (-7, "é É one two"), (1006, "a " * 4000), (1007, "a " * 3000), (1008, rows[5][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(df, 4).collect()}
    assert got == brute(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(df, 4, cluster=7).collect()} == got
    kept = minhash.dedup(df, 4)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute(rows, 4).items() if c == d}
    assert minhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "x y z"), (1, "q r s"), (2, "q r s"), (0, "x y z"), (9, "n")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.classes(twice).collect()) == [(0, 0), (1, 0), (1, 0), (2, 0), (9, 9)]


def test_null_and_repeated_ids(spark):
    """Rows are told apart by their texts: unlike rows of one doc_id or of none stay, near copies link whatever their ids."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    t = [text() for _ in range(8)]
    near = lambda x: x.rsplit(" ", 1)[0] + " changed"
    rows = [(None, t[0]), (None, t[1]), (None, near(t[1])), (7, t[2]), (7, t[3]), (None, near(t[3])), (8, near(t[2])), (9, t[4]), (9, t[4]), (None, ""), (None, None), (9, " "), (None, t[5]), (4, near(t[5])), (1, t[6]), (1, t[7]), (2, near(t[7]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in minhash.dedup(df, 4).collect()]
    want = [(7, t[2]), (7, t[3]), (9, t[4]), (None, ""), (None, None), (9, " "), (4, near(t[5])), (1, t[6]), (1, t[7]), (None, t[0])]
    assert sorted(map(repr, [x for x in kept if x[1] not in (t[1], near(t[1]))])) == sorted(map(repr, want))
    assert len(kept) == len(want) + 1
    # rows in order of their texts' groups
    got = sorted(((r.doc_id, r.component_id) for r in minhash.classes(df, 4).collect()), key=repr)
    assert got == sorted([(None, None)] * 3 + [(None, None)] * 2 + [(7, 7)] * 2 + [(None, 7), (8, 7)] + [(9, 9)] * 3 + [(None, 4), (4, 4)] + [(1, 1)] * 2 + [(2, 1)], key=repr)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = minhash.op2_minhash(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_words_of_the_same_structure(spark):
    """Long words over two letters whose sums by powers of an odd base agree are different words."""
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    df = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.classes(df, 4).collect()} == {1: 1, 2: 2, 3: 1}
