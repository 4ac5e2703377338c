import random

from headway.llm import decontaminate as D


def least(p, t):
    """Plain dynamic programming."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def brute(docs, items, rate=D.RATE):
    out = {}
    for doc, text in docs:
        for i, item in items:
            p, t = D.normal(item or ""), D.normal(text or "")
            if p and (d := least(p, t)) <= int(len(p) * rate):
                out[doc, i] = d
    return out


def edit(rng, t, n):
    for _ in range(n):
        k = rng.randrange(len(t))
        t = rng.choice([t[:k] + t[k + 1 :], t[:k] + "x" + t[k:], t[:k] + "é" + t[k + 1 :]])
    return t


def test_distance():
    rng = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 80))) for _ in range(2))
        assert D.distance(p, t) == least(p, t)


def test_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(1, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 40)))) for i in range(12)] + [(90, None), (91, "  \n"), (92, "ab"), (3, "twice named")]
    docs = [(k, " ".join(word() for _ in range(60)) + "  " + edit(rng, items[k % 12][1], k % 14).upper() + "\nand " + word()) for k in range(50)]
    docs += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (63, "a b " * 5000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, distance int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (D.BLOCK_CHARS, 200):
        assert {(r.doc_id, r.item_id): r.distance for r in D.matches(df, b, block_chars=size).collect()} == want
    assert 20 < len(want)
    assert sorted(r.doc_id for r in D.clean(df, b).collect()) == sorted(d for d, _ in docs if d not in {x for x, _ in want})
    none = spark.createDataFrame([], "doc_id long, text string")
    assert D.matches(none, b).count() == 0 and D.matches(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_repeating_items(spark):
    """Items whose pieces recur, edited near their start: a hit may imply a later place than the true one."""
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    items, docs = [], []
    for i in range(12):
        k = 10
        cuts = [200 * j // (k + 1) for j in range(k + 2)]
        own = [line(b - a) for a, b in zip(cuts, cuts[1:])]
        own[2] = own[0][: len(own[2])] + line(len(own[2]) - len(own[0]))
        own[0] = own[2][: len(own[0])]
        if i % 3 == 0:
            own[5] = own[1][: len(own[5])] + line(len(own[5]) - len(own[1]))
        text = "".join(own)
        items.append((i, text))
        for n in (2, 5, 11):
            at = sorted(rng.sample(range(2, 34), n))
            docs.append((100 * i + n, line(60) + "".join("z" if x in at else c for x, c in enumerate(text)) + line(60)))
        docs.append((100 * i + 50, own[0] * 3 + line(40) + text[:4] + "zz" + text[6:20] + "z" + text[21:]))
    got = {(r.doc_id, r.item_id): r.distance for r in D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and len(got) >= 36


def test_clean_tells_rows_apart(spark):
    rows = [(None, "holds the benchmark item here"), (None, "clean words"), (5, "the benchmark item"), (5, "other words"), (None, None)]
    items = spark.createDataFrame([(1, "the benchmark item")], "item_id long, text string")
    kept = D.clean(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((repr(r.doc_id), repr(r.text)) for r in kept) == [("5", "'other words'"), ("None", "'clean words'"), ("None", "None")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, D.normal(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, D.normal(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in D.op9_decontaminate(spark, sf).collect()}
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    assert {k for k, v in got.items() if v == 0} == exact and exact
