import hashlib
import random
import re

from headway.llm import paragraph_sketch as ps


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    texts = [t or "" for _, t in rows]
    cut = lambda t: set(re.findall(ps.PARAGRAPH, t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for k, (doc, _) in enumerate(rows):
        t, n = texts[k], texts[(k + 1) % len(rows)]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        out.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(cut(t), cut(e)), 9), round(like(cut(t), cut(n)), 9)))
    return out


def got(df):
    return sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def test_edges(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "é" * 7), (-4, "one line"), (60, "\n".join(f"line {k}" for k in range(3000))), (61, "\n".join(f"line {k}" for k in range(2990))), (61, "again")]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, near_next double").repartition(3)
    assert got(ps.fingerprints(ps.texts(df))) == sorted(brute(rows))
    assert ps.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    assert got(ps.fingerprints(one)) == brute([(1, "alone")])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = ps.op3_paragraph_sketch(spark, sf)
    assert got(out) == sorted(brute(rows))
    by = {}
    for r in out.collect():
        by.setdefault(rows[[d for d, _ in rows].index(r.doc_id)][1], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len({f for v in by.values() for f in v}) > 100


def test_null_and_hot_doc_ids(spark):
    """Half of the rows without a doc_id, a quarter with the same one: taken in order of their texts."""
    rng = random.Random(9)
    rows = [(rng.choice([None, None, 7, rng.randint(0, 30)]), "\n".join(rng.choice("abcdé") * rng.randint(1, 9) for _ in range(rng.randint(0, 12)))) for _ in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute([(-1 if d is None else d, t) for d, t in rows])
    have = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in ps.fingerprints(ps.texts(df)).collect()]
    assert sorted(have) == sorted(want)
