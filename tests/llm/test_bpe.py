import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from headway.llm import bpe

TEXTS = ["", None, "It's a test, isn't it?  two  blanks\n\nend  ", "<|endoftext|> in <|endoftext|>  text", "é x y\x1cz\x85w ²½ ④ ⅷ 漢字 日本​", "'ll 'LL 've''s !'s", "a" * 30000, "\r\n\t x", "same", "same"]


def test_matches_library(spark):
    rng = random.Random(5)
    some = [chr(c) for c in [*range(9, 14), *range(28, 127), 0x85, 0xA0, 0xB2, 0xE9, 0x130, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x3000, 0x0663, 0x2167, 0x4E00, 0x1F600, 0x0301]]
    more = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts = TEXTS + more
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, chunk_chars=500)).collect()}
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    assert len(got) == len(texts)
    assert {(r.doc_id, bytes(r.ids), r.text) for r in bpe.round_trip(df, chunk_chars=500).collect()} == {(i, bytes(r.ids), r.text) for i, r in got.items()}
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, repr(t)
        assert got[i].text == tok.decode(want, skip_special_tokens=False)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df)).count() == 0


def test_null_and_repeated_doc_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (4, "c"), (4, "c"), (4, "")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in bpe.decode(bpe.encode(df, chunk_chars=2)).collect()]
    assert sorted(got, key=repr) == sorted([(None, "a b"), (None, ""), (4, "c"), (4, "c"), (4, "")], key=repr)


def test_decoding_of_any_ids(spark):
    """Bytes that aren't UTF-8, ids without a piece and no ids at all: as the library decodes them."""
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    some = [tok.encode("é漢", add_special_tokens=False).ids[:1], tok.encode("漢字", add_special_tokens=False).ids[1:], [], [10**6, 5], [tok.get_vocab_size() - 1]]
    df = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(some)], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in bpe.decode(df).collect()}
    assert [got[i] for i in range(len(some))] == [tok.decode(x, skip_special_tokens=False) for x in some]


def test_query(spark):
    rows = bpe.op7_bpe(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    assert len(rows) == len(docs)
    for r in rows:
        ids = tok.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
