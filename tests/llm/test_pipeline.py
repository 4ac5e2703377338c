import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from headway.llm import bpe, decontaminate
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_repeats import brute_bytes


@pytest.fixture(scope="module")
def staged(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stage(f(spark, out[-1], sf)))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, staged):
    first, *_ = staged
    assert all(x.schema == first.schema for x in staged[:-1])
    good, near, cut, clean, coded = staged[1:]
    assert {r.doc_id for r in near.collect()} == {d for d, (_, c) in near_brute(rows(good), 5).items() if c == d}
    want = {d: x[3].decode("utf-8", "ignore") for d, x in brute_bytes(rows(near), 100).items()}
    assert dict(rows(cut)) == want and all(r.n_chars == len(r.text) for r in cut.collect())
    items = [decontaminate.normal(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert {d for d, _ in rows(clean)} == {d for d, t in want.items() if not any(decontaminate.distance(i, decontaminate.normal(t)) <= int(len(i) * 0.05) for i in items)}
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    ids = {d: tok.encode(t, add_special_tokens=False).ids for d, t in rows(clean)}
    assert {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.decoded_sha256) for r in coded.collect()} == {d: (x, len(x), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for d, x in ids.items()}
    assert len(ids) > 50


def test_quality_stage(spark, staged):
    """The stage keeps the rows that the classifier keeps, and catches what labels call bad."""
    first, good, *_ = staged
    kept, judged = {d for d, _ in rows(good)}, {d for d, _ in rows(first)}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect() if r.doc_id in judged]
    bad = {r.doc_id for r in labels if r.quality == 0 or r.toxic == 1}
    assert len(bad - kept) > 0.8 * len(bad)
    assert len({r.doc_id for r in labels} - bad - kept) < 0.03 * len(labels)


def test_edges(spark):
    rows = [(1, None, "en", "a", 0), (None, "x y z", None, None, None), (2, "", "en", "a", 0), (2, "twice here", "en", "a", 10), (3, "é" * 400, "fr", "b", 400), (4, "z" + "é" * 400, "fr", "b", 401)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES:
            df = corpus_pipeline.stage(f(spark, df, "/root/testdata/sf0.001"))
        n = df.count()
    assert n == 0
