"""Token files of directly addressable codes.

A file holds the ids of whole documents in ascending doc_id order. Ids are cut into chunks of eight
bits: level 0 has the lowest chunk of every id, level k the next chunk of those ids that go on, and a
bitmap says which do. A directory of ranks, one for every 512 bits, leads from a position in a level to
its position in the next one, so that any token is read by a few short range reads, without decoding.

Layout, little-endian: 8 bytes magic, int64 documents, int64 tokens, int64 levels; for each level int64
size; then doc ids (int64), document ends (int64); then for each level its chunks, bitmap and ranks
(int64 for every 512 bits), each padded to eight bytes.

A null text is empty and has the end id alone. A null doc_id sorts first and stays null only in the result's row
(it is stored as the least integer). Rows that repeat a doc_id stay separate and adjacent; other columns are ignored;
an empty table has no files. Very long texts are written whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.llm import bpe, files
from headway.llm.common import parts, shared_dir, stage, table, text_bytes, texts

MAGIC = b"DACTOK01"
BITS = 512
NULL_ID = bpe.NULL_ID


def _pad(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def pack(docs: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The file's bytes; ends are the documents' ends among ids."""
    cur, levels = ids.astype(np.uint32), []
    while True:
        more = cur > 0xFF
        counts = np.add.reduceat(more, np.arange(0, len(more), BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        levels.append(((cur & 0xFF).astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), (np.cumsum(counts) - counts).astype("<i8").tobytes()))
        cur = cur[more] >> 8
        if not len(cur):
            break
    head = MAGIC + np.array([len(docs), len(ids), len(levels), *(len(c) for c, *_ in levels)], "<i8").tobytes()
    return b"".join([head, docs.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), *(_pad(x) for level in levels for x in level)])


class TokenFile:
    """Reads a token file: all of it, or any token by its position."""

    def __init__(self, uri: str):
        self.f = files.opened(uri)
        head = self._at(0, 32)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.n_docs, self.n_tokens, n = np.frombuffer(head, "<i8", 3, 8).tolist()
        self.sizes = np.frombuffer(self._at(32, 8 * n), "<i8").tolist()
        at = 32 + 8 * n
        self.docs_at, self.levels = at, []
        at += 16 * self.n_docs
        for size in self.sizes:
            bits = at + size + -size % 8
            wide = (size + 7) // 8
            ranks = bits + wide + -wide % 8
            self.levels.append((at, bits, ranks))
            at = ranks + 8 * ((size + BITS - 1) // BITS)

    def _at(self, start: int, n: int) -> bytes:
        self.f.seek(start)
        return self.f.read(n)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(self._at(self.docs_at, 16 * self.n_docs), "<i8")
        return both[: self.n_docs], both[self.n_docs :]

    def token(self, i: int) -> int:
        """The token at a position, by one chunk, one word of the bitmap and one rank for each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (at, bits, ranks) in enumerate(self.levels):
            value |= self._at(at + i, 1)[0] << (8 * k)
            block = i // BITS
            first = block * BITS // 8
            word = int.from_bytes(self._at(bits + first, i // 8 - first + 1), "little")
            off = i - block * BITS
            if not word >> off & 1:
                break
            i = int.from_bytes(self._at(ranks + 8 * block, 8), "little") + (word & ((1 << off) - 1)).bit_count()
        return value

    def tokens(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for size, (at, bits, _) in zip(self.sizes[::-1], self.levels[::-1]):
            low = np.frombuffer(self._at(at, size), np.uint8).astype(np.uint32)
            more = np.unpackbits(np.frombuffer(self._at(bits, (size + 7) // 8), np.uint8), count=size, bitorder="little").astype(bool)
            low[more] |= out << 8
            out = low
        return out


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, chunk_chars: int = bpe.CHUNK_CHARS) -> DataFrame:
    """Encode, append end_id to each document, write a file for each chunk; returns name, uri, n_docs, n_tokens, start of each file in order."""
    spark = docs.sparkSession
    numbers = shared_dir(spark)
    # texts in ranges of doc_id, so that a chunk's ids are written where they are joined; rows of one doc_id may be split
    rows = texts(docs).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row")

    def finish(name: str, ids: np.ndarray, ends: np.ndarray, flat: np.ndarray) -> pa.Table:
        flat, ends = np.insert(flat, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)
        uri = files.write(folder, f"{name}.dac", pack(ids, ends, flat))
        return pa.table({"name": [name], "uri": [uri], "n_docs": [len(ids)], "n_tokens": [len(flat)]})

    made = stage(bpe.by_chunk(rows.drop("row"), text_bytes(docs), numbers, bpe.spec_of(tokenizer), chunk_chars, finish, "name string, uri string, n_docs long, n_tokens long"))
    if not made.isEmpty():
        files.remove(numbers)
    # a name is the range's number and the file's place there: starts of ranges (a row for each), then of files within
    made = made.withColumn("range", F.substring_index("name", "-", 1))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = made.groupBy("range").agg(F.sum("n_tokens").alias("n_tokens")).select("range", before(Window.orderBy("range")).alias("base"))
    start = (F.col("base") + before(Window.partitionBy("range").orderBy("name"))).alias("start")
    return made.join(ranges, "range").select("name", "uri", "n_docs", "n_tokens", start).orderBy("name")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = TokenFile(uri)
                docs, ends = f.documents()
                starts = np.append(0, ends[:-1]) if len(ends) else ends
                ids = f.tokens().astype("<u4")
                crc = [crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NULL_ID), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("uri", "start").repartition(parts(manifest.sparkSession), "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), shared_dir(spark)))


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}
