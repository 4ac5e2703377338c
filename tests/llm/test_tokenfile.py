from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

from headway.llm import bpe, files, tokenfile


def expected(rows):
    tok, at, out = Tokenizer.from_file(bpe.default_tokenizer()), 0, []
    for doc, text in sorted(rows):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(tuple(r) for r in tokenfile.op5_token_files(spark, "/root/testdata/sf0.001").collect())
    assert got == expected(docs)


def test_edges(spark, tmp_path):
    rows = [(7, None), (3, ""), (-2, "a b"), (9, "word " * 3000), (8, "x")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int")
    made = tokenfile.write_tokens(df, f"file://{tmp_path}/t", chunk_chars=100)
    assert sorted(tuple(r) for r in tokenfile.read_tokens(made).collect()) == expected([(d, t or "") for d, t in rows])
    starts = [(r.start, r.n_tokens) for r in made.collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0 and len(starts) > 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, f"file://{tmp_path}/n")).count() == 0


def test_random_access(tmp_path):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2 ** rng.integers(1, 32, 5000), dtype=np.uint32)
    uri = files.write(f"file://{tmp_path}", "a.dac", tokenfile.pack(np.array([4, 9]), np.array([10, 5000]), ids))
    f = tokenfile.TokenFile(uri)
    assert f.tokens().tolist() == ids.tolist()
    assert all(f.token(i) == ids[i] for i in [*range(0, 5000, 37), 511, 512, 4999])
    empty = tokenfile.TokenFile(files.write(f"file://{tmp_path}", "b.dac", tokenfile.pack(np.zeros(0), np.zeros(0), np.zeros(0, np.uint32))))
    assert empty.tokens().tolist() == []


def test_null_and_repeated_doc_ids(spark, tmp_path):
    rows = [(None, "b c"), (5, "x"), (5, "x"), (None, ""), (5, "y z"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in tokenfile.read_tokens(tokenfile.write_tokens(df, f"file://{tmp_path}/r", chunk_chars=2)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 5, 5, 5]
    of = lambda rows: sorted(r[2:] for r in rows)
    want = expected([(-1 if d is None else d, t or "") for d, t in rows])
    assert of(got) == of(want) and got[-1][1] + got[-1][2] == want[-1][1] + want[-1][2]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
