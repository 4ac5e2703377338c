import hashlib
import random

import numpy as np
import pytest

from headway.llm import suffix_array, suffix_tree


def brute_bytes(rows, n):
    """rows: (doc_id, text); earlier is a smaller doc_id, or the same document and an earlier start."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        x = (text or "").encode()
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - n + 1):
            if first.setdefault(x[p : p + n], (doc, p)) != (doc, p):
                gone[p : p + n] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out[doc] = (len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept)
    return out


def brute_words(rows, n):
    first, out = {}, {}
    for doc, text in sorted(rows):
        w = (text or "").encode().split()
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - n + 1):
            if first.setdefault(tuple(w[p : p + n]), doc) < doc:
                gone[p : p + n] = True
        out[doc] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g))
    return out


def mess(seed, n):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(5, 90))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "ab" * 300), (n + 3, "ab" * 200), (n + 4, "a" * 500), (-5, rows[3][1]), (n + 9, rows[3][1])]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_bytes(spark, hot):
    rows = mess(1, 120)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_array.dedup(df, 30, carried=["kept"], hot=hot, piece=700, chunk=5000).collect()}
    assert got == brute_bytes(rows, 30)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_words(spark, hot):
    rows = mess(2, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in suffix_tree.dedup(df, 6, hot=hot, piece=100, chunk=5000).collect()}
    assert got == brute_words(rows, 6)


def test_structures():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 2, 4000).astype(np.uint8)
    text[2000:] = text[:2000]
    ends = np.array([1500, 1533, 4000])
    starts = np.array([p for a, b in zip([0, *ends], ends) for p in range(a, b - 30)])
    g = suffix_array.groups(text, ends, starts, 30, bucket=700)
    want = {}
    ids = [want.setdefault(text[p : p + 30].tobytes(), len(want)) for p in starts]
    assert len(set(zip(g.tolist(), ids))) == len(set(g.tolist())) == len(set(ids))
    g = suffix_tree.groups(text.astype(np.uint64), ends, starts, 30, most=300)
    assert len(set(zip(g.tolist(), ids))) == len(set(g.tolist())) == len(set(ids))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.dedup(df).count() == suffix_tree.dedup(df).count() == 0


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for d, x in brute_bytes(rows, 100).items()}
    assert {r[0]: tuple(r)[1:] for r in suffix_array.op1_suffix_array(spark, sf).collect()} == want
    want = {d: (*x[:2], hashlib.sha256(x[2]).hexdigest()) for d, x in brute_words(rows, 50).items()}
    assert {r[0]: tuple(r)[1:] for r in suffix_tree.op10_suffix_tree(spark, sf).collect()} == want


def test_words_of_the_same_structure(spark):
    """Long words over two letters whose sums by powers of an odd base agree are different words."""
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    rows = [(1, " ".join(f"w{i}" for i in range(5)) + " " + x + " t u"), (2, " ".join(f"w{i}" for i in range(5)) + " " + y + " t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in suffix_tree.dedup(df, 6).collect()} == brute_words(rows, 6)
    assert {r.doc_id: r.n_removed for r in suffix_array.dedup(df, 100).collect()} == {d: n for d, (_, n, *_) in brute_bytes(rows, 100).items()}


def test_null_and_repeated_doc_ids(spark):
    """Rows of one doc_id (or of none) are documents of their own: op1 keeps the first, op10 removes from no row of the same doc_id."""
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(3, text), (3, text), (None, "x"), (None, "x"), (4, text)], "doc_id long, text string").repartition(1)
    assert sorted((r.doc_id or -1, r.n_removed) for r in suffix_array.dedup(df).collect()) == sorted([(-1, 0), (-1, 0), (3, 0), (3, len(text)), (4, len(text))])
    assert sorted((r.doc_id or -1, r.n_removed) for r in suffix_tree.dedup(df).collect()) == [(-1, 0), (-1, 0), (3, 0), (3, 0), (4, 60)]
