"""BPE encoding and decoding by a distinct-word table.

Tasks split the texts into words and number the distinct words of each chunk of documents. The words
go to hash buckets; each bucket encodes every distinct word once, whatever number of chunks holds it,
and answers with its ids. The answers join the chunk's word numbers, position by position. There are so
many buckets that each has the words of BUCKET_BYTES of text at most. Decoding joins ids to the
vocabulary's pieces, a table that the vocabulary file bounds: it is broadcast, and the pieces are taken
by id for a slice of documents at a time. Ids without a piece are left out, as the library does.

Null and empty texts have no ids. A null doc_id stays null; rows that repeat a doc_id each give a row;
other columns are ignored; an empty table gives no rows. Very long texts are encoded whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import files
from headway.llm.common import freed, parts, release, shared_dir, slices, stage, table, text_bytes, texts

#: Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of Latin letters and common blanks, where the standard module is faster.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\r\f"
LATIN = f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
LATIN_TEXT = "[\x20-\x7e\t\n\r\f\xa1-ɏ]*"
CHUNK_CHARS = 8_000_000
#: Bytes of text whose words are in a bucket.
BUCKET_BYTES = 32_000_000
#: Words whose ids are joined at once.
WORDS = 2**18
ENCODED = "doc_id long, ids binary"
DECODED = ENCODED + ", text string"
NULL_ID = -(2**63)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _load(spec: str):
    """The tokenizer, once for each worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    return tok


def splitter(specials: list[str]):
    """text -> its words; a special token's string is a word of its own."""
    import regex

    whole, latin, is_latin = regex.compile(PATTERN), re.compile(LATIN), re.compile(LATIN_TEXT)
    cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None

    def plain(text: str) -> list[str]:
        return (latin if is_latin.fullmatch(text) else whole).findall(text)

    def words(text: str) -> list[str]:
        if cut is None or cut.search(text) is None:
            return plain(text)
        return [w for k, part in enumerate(cut.split(text)) for w in ([part] if k % 2 else plain(part))]

    return words


def _z(a: np.ndarray | bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(a if isinstance(a, bytes) else a.tobytes())


def _un(b: bytes, dtype=None):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    return raw if dtype is None else np.frombuffer(raw, dtype)


_CHUNK = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()), ("docs", pa.binary()), ("lens", pa.binary()), ("body", pa.binary())])
_CODED = "chunk string, bucket int, n int, docs binary, lens binary, body binary"


def _number(buckets: int, specials: list[str], chunk_chars: int, folder: str):
    """Batches of texts -> for each chunk a row (bucket -1) and rows of its distinct words by bucket; the word numbers stay in a file of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyspark import TaskContext

        words, part = splitter(specials), TaskContext.get().partitionId()
        seq, chars, ids, lens, codes = 0, 0, [], [], []
        seen: defaultdict = defaultdict()
        seen.default_factory = seen.__len__

        def flush() -> pa.RecordBatch:
            raw = [w.encode("utf-8") for w in seen]
            of = np.fromiter((crc32(w) % buckets for w in raw), np.int64, len(raw))
            order = np.argsort(of, kind="stable")
            rank = np.empty(len(raw), np.uint32)
            rank[order] = np.arange(len(raw), dtype=np.uint32)
            numbers = rank[np.concatenate(codes)] if len(raw) else np.zeros(0, np.uint32)
            name = f"{part:08d}-{seq:06d}"
            files.write(folder, name, _z(numbers))
            rows = [(name, -1, len(ids), _z(np.array(ids, np.int64)), _z(np.array(lens, np.uint32)), None)]
            at = np.flatnonzero(np.diff(of[order], prepend=-1)).tolist() if len(raw) else []
            for a, b in zip(at, [*at[1:], len(raw)]):
                own = [raw[i] for i in order[a:b].tolist()]
                rows.append((name, int(of[order[a]]), b - a, None, _z(np.fromiter(map(len, own), np.uint32, b - a)), _z(b"".join(own))))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK)], schema=_CHUNK)

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(text)
                ids.append(doc if doc is not None else NULL_ID)
                lens.append(len(own))
                codes.append(np.fromiter(map(seen.__getitem__, own), np.uint32, len(own)))
                chars += len(text)
                if chars >= chunk_chars:
                    yield flush()
                    seq, chars, ids, lens, codes = seq + 1, 0, [], [], []
                    seen.clear()
        if ids:
            yield flush()
        seen.clear()
        release()

    return run


def _word_tokenizer(spec: str):
    """The tokenizer for single words: it doesn't split again."""
    from tokenizers import pre_tokenizers

    tok = _load(spec)
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tok


def _encode_bucket(spec):
    """All the chunks' words of a bucket -> their ids; each distinct word is encoded once."""

    def run(t: pa.Table) -> pa.Table:
        tok, index, rows = _word_tokenizer(spec.value), {}, []
        for lens, body in zip(t["lens"].to_pylist(), t["body"].to_pylist()):
            ends = np.cumsum(_un(lens, np.uint32).astype(np.int64)).tolist()
            raw = _un(body)
            rows.append(np.fromiter((index.setdefault(raw[a:b], len(index)) for a, b in zip([0, *ends], ends)), np.int64, len(ends)))
        distinct = iter([w.decode("utf-8") for w in index])
        index.clear()
        size, flat = [], []
        while some := [w for _, w in zip(range(1000), distinct)]:
            coded = [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]
            size += map(len, coded)
            flat.append(np.array([i for ids in coded for i in ids], np.uint32))
        size, flat = np.array(size, np.int64), np.concatenate(flat)
        start, n = np.cumsum(size) - size, [size[of] for of in rows]
        return pa.table({
            "chunk": t["chunk"], "bucket": t["bucket"],
            "lens": pa.array([_z(k.astype(np.uint32)) for k in n], pa.binary()),
            "body": pa.array([_z(_gathered(flat, start[of], k)) for of, k in zip(rows, n)], pa.binary()),
        })

    return run


def _gathered(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of flat, one after the other."""
    return flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _join(folder: str, left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's word numbers and its words' ids -> its documents, their ends among the ids, and the ids."""
    docs, lens = _un(left["docs"][0].as_py(), np.int64), _un(left["lens"][0].as_py(), np.uint32)
    numbers = _un(files.read(f"{folder}/{left['chunk'][0].as_py()}"), np.uint32)
    answers = sorted(zip(right["bucket"].to_pylist(), right["lens"].to_pylist(), right["body"].to_pylist()))
    size = np.concatenate([_un(x, np.uint32) for _, x, _ in answers] or [np.zeros(0, np.uint32)]).astype(np.int64)
    flat = np.concatenate([_un(x, np.uint32) for *_, x in answers] or [np.zeros(0, np.uint32)])
    start, out, ends = np.cumsum(size) - size, [np.zeros(0, np.uint32)], np.zeros(len(numbers) + 1, np.int64)
    for k in range(0, len(numbers), WORDS):
        own = numbers[k : k + WORDS]
        out.append(_gathered(flat, start[own], size[own]))
        np.cumsum(size[own], out=ends[k + 1 : k + 1 + len(own)])
        ends[k + 1 : k + 1 + len(own)] += ends[k]
    return docs, ends[np.cumsum(lens.astype(np.int64))], np.concatenate(out)


def by_chunk(rows: DataFrame, total: int, folder: str, spec: str, chunk_chars: int, finish: Callable, schema: str) -> DataFrame:
    """rows: doc_id and text (of total bytes), taken in their order. finish: (chunk's name, documents, their ends, ids) -> a table of schema for each chunk."""
    import json

    spark = rows.sparkSession
    specials = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
    held = spark.sparkContext.broadcast(spec)  # the vocabulary file
    buckets = max(2 * parts(spark), -(-total // BUCKET_BYTES))
    words = stage(rows.mapInArrow(_number(buckets, specials, chunk_chars, folder), _CODED), "none")
    coded = words.where("bucket >= 0").select("chunk", "bucket", "lens", "body").groupBy("bucket").applyInArrow(freed(_encode_bucket(held)), "chunk string, bucket int, lens binary, body binary")

    def chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(left["chunk"][0].as_py(), *_join(folder, left, right))

    return words.where("bucket < 0").select("chunk", "docs", "lens").groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(freed(chunk), schema)


def spec_of(tokenizer: str | None) -> str:
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        return f.read()


def as_binary(body: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes cut at ends, as an array of binaries."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(body)])


def _coded(ids: np.ndarray, ends: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NULL_ID), as_binary(flat.astype("<u4"), 4 * ends)], ["doc_id", "ids"])


def encode(docs: DataFrame, tokenizer: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text, as the tokenizers library gives without special tokens added."""

    def finish(_: str, *found: np.ndarray) -> pa.Table:
        return pa.Table.from_batches([_coded(*found)])

    return by_chunk(texts(docs), text_bytes(docs), shared_dir(docs.sparkSession), spec_of(tokenizer), chunk_chars, finish, ENCODED)


def round_trip(docs: DataFrame, tokenizer: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """decode(encode(docs)), the ids joined to their pieces in the task that has just made them."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast([*pieces(tokenizer), b""])  # the vocabulary file bounds it

    def finish(_: str, *found: np.ndarray) -> pa.Table:
        return pa.Table.from_batches(list(_decoded(held.value)(iter([_coded(*found)]))))

    return by_chunk(texts(docs), text_bytes(docs), shared_dir(spark), spec_of(tokenizer), chunk_chars, finish, DECODED)


def pieces(tokenizer: str | None = None) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; an id without a piece has none."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    known = _load(spec_of(tokenizer)).get_vocab(with_added_tokens=True)
    out = [b""] * (max(known.values(), default=-1) + 1)
    for s, i in known.items():
        out[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode("utf-8")
    return out


def _said(piece: pa.Array, ids: pa.Array) -> list[str]:
    """The texts of a slice's ids: one look-up of all pieces, laid end to end, then cut at the documents' ends."""
    each = [np.frombuffer(x, "<u4") for x in ids.to_pylist()]
    flat = np.concatenate(each) if each else np.zeros(0, np.uint32)
    found = piece.take(pa.array(np.minimum(flat, len(piece) - 1)))  # the last piece is empty
    body, offsets = found.buffers()[2], np.frombuffer(found.buffers()[1], np.int32)[: len(flat) + 1]
    body = memoryview(body) if body is not None else memoryview(b"")
    cuts = offsets[np.append(0, np.cumsum([len(x) for x in each]))].tolist()
    return [str(body[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def _decoded(said: list[bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.array(said, pa.binary())
        for b in slices(batches, "ids", 1000, 4_000_000):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_said(piece, b.column(1)), pa.string())], ["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and text: each id joins its piece; bytes that aren't UTF-8 become replacement characters, as the library does."""
    held = encoded.sparkSession.sparkContext.broadcast([*pieces(tokenizer), b""])  # the vocabulary file bounds it
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(held.value)(batches), DECODED)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents"))
    return both.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
