"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased with single blanks. An item may occur with up to `rate` times its length
in edits, its budget k. Cut into k + 1 pieces, one of them must occur exactly: an Aho-Corasick automaton
finds all pieces in one pass over a text, and the surroundings of an item's hits, where they overlap as one
stretch, are verified with Myers' bit-parallel distance. Items come in blocks of `block_chars` characters at most (one item at least), each
broadcast by itself and matched against all documents.

Returns a row for each document and item that match: doc_id, item_id, distance, the least found. Items that
are null or without a word match nothing. Rows that repeat a doc_id or an item_id give one row for the pair.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.common import table, texts

RATE = 0.05
BLOCK_CHARS = 4_000_000
MATCHES = "doc_id long, item_id long, distance int"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of like lengths, with their places."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def distance(pattern: str, text: str) -> int:
    """Least edits from the pattern to any stretch of the text (Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, score, best = full, 0, m, m
    for c in text:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best = score
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
    return best


def widen(spans: list[tuple[int, int]], start: int, stop: int) -> None:
    """Adds a stretch to sorted stretches that don't touch; those that it meets become one."""
    i = bisect_left(spans, start, key=lambda x: x[1])
    j = bisect_right(spans, stop, key=lambda x: x[0])
    if i < j:
        start, stop = min(start, spans[i][0]), max(stop, spans[j - 1][1])
    spans[i:j] = [(start, stop)]


def _automaton(items: list[tuple[int, str]], rate: float):
    import ahocorasick

    words: dict[str, list[tuple[int, int]]] = {}
    budgets = [int(len(t) * rate) for _, t in items]
    for n, (_, t) in enumerate(items):
        for at, piece in pieces(t, budgets[n]):
            words.setdefault(piece, []).append((n, at))
    found = ahocorasick.Automaton()
    for piece, places in words.items():
        found.add_word(piece, (len(piece), places))
    found.make_automaton()
    return found, budgets


def _match(held, rate: float, ident: pa.DataType = pa.int64()):
    """A row for each row (of a key and a text) and item that match; ident is the key's type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        found, budgets = _automaton(items, rate)
        for b in (x.slice(k, 200) for x in batches for k in range(0, x.num_rows, 200)):
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = normal(raw)
                best: dict[int, int] = {}
                spans: dict[int, list[tuple[int, int]]] = {}
                for end, (size, places) in found.iter(text):
                    for n, at in places:
                        if best.get(n) == 0:
                            continue
                        k, item, start = budgets[n], items[n][1], end + 1 - size - at
                        if start >= 0 and text.startswith(item, start):
                            best[n] = 0
                            spans.pop(n, None)
                        else:
                            widen(spans.setdefault(n, []), max(0, start - k), min(len(text), start + len(item) + k))
                for n, held_spans in spans.items():
                    d = min(distance(items[n][1], text[a:z]) for a, z in held_spans)
                    if d <= budgets[n]:
                        best[n] = d
                out += [(doc, items[n][0], d) for n, d in best.items()]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], ident), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], [b.schema.names[0], "item_id", "distance"])

    return run


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks, one block at a time on the driver."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("t IS NOT NULL").toLocalIterator():
        t = normal(r.t)
        if not t:
            continue
        if held and size + len(t) > block_chars:
            yield held
            held, size = [], 0
        held.append((r.i, t))
        size += len(t)
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    spark, rows = docs.sparkSession, texts(docs)
    each = [rows.mapInArrow(_match(spark.sparkContext.broadcast(b), rate), MATCHES) for b in blocks(benchmark, block_chars)]
    if not each:
        return spark.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionByName, each).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows whose own text has no match, with all their columns, whatever other rows of the doc_id have."""
    spark, digest = docs.sparkSession, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = docs.select(digest.alias("__hit"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    each = [rows.mapInArrow(_match(spark.sparkContext.broadcast(b), rate, pa.string()), "__hit string, item_id long, distance int").select("__hit") for b in blocks(benchmark, BLOCK_CHARS)]
    if not each:
        return docs
    hit = reduce(DataFrame.unionByName, each).distinct()
    return docs.join(hit, digest == F.col("__hit"), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES: dict[str, str] = {}
