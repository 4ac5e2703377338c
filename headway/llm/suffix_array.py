"""Suffix-array dedup of byte passages, by difference-cover blockwise construction.

The suffixes that matter (starts of windows of `length` bytes in blocks whose anchor recurs; see
repeats) are sorted in the tasks of their gram's bucket. There the positions of a difference cover
modulo 13 get their ranks first, by doubling. Then one bucket of suffixes at a time is sorted by its
first 13 bytes, and longer ties are resolved by the ranks of cover positions: any two positions have a
shift of less than 13 that takes both into the cover. Neighbours that agree on `length` bytes are equal
windows. Memory is bounded by the bucket and the cover's ranks.

Identical blocks count as one entry of the suffix array (a 128-bit digest tells them; see repeats).

Texts count as UTF-8 bytes; null is empty; matches don't cross documents. Rows that repeat a doc_id are
documents of their own, in reading order; a null doc_id comes first. Extra columns are carried on request.
Very long texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import repeats
from headway.llm.common import table

#: A difference cover: every residue modulo 13 is a difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
LENGTH = 100
#: Suffixes sorted at once.
BUCKET = 200_000
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


def units(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8) for x in raw]


def mixed(units_: np.ndarray) -> np.ndarray:
    return _BYTES[units_]


def shifts() -> np.ndarray:
    """[a, b]: the least shift that takes both residues into the cover."""
    return np.array([[min(k for k in range(PERIOD) if (a + k) % PERIOD in COVER and (b + k) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def cover_ranks(text: np.ndarray, end: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Rank of every suffix that starts at a cover position (elsewhere -1). A suffix ends with its block; equal ones rank by block."""
    n = len(text)
    pos = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    at = np.full(n, -1, np.int64)
    at[pos] = np.arange(len(pos))
    key = []
    for few in (range(7), range(7, PERIOD)):
        k = np.zeros(len(pos), np.uint64)
        for j in few:
            q = pos + j
            inside = q < end[pos]
            k = (k << np.uint64(9)) | np.where(inside, text[np.minimum(q, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        key.append(k)
    order = np.lexsort((key[1], key[0]))
    differs = np.concatenate([[False], (key[0][order][1:] != key[0][order][:-1]) | (key[1][order][1:] != key[1][order][:-1])])
    name, step, n_blocks = np.empty(len(pos), np.int64), PERIOD, int(block[-1]) + 1
    name[order] = np.cumsum(differs)
    while name.max(initial=0) + 1 < len(pos):
        q = pos + step
        inside = q < end[pos]
        nxt = np.where(inside, name[at[np.minimum(q, n - 1)]] + n_blocks, block[pos])
        both = (name.astype(np.uint64) << np.uint64(32)) | nxt.astype(np.uint64)
        order = np.argsort(both)
        name[order] = np.cumsum(np.concatenate([[False], both[order][1:] != both[order][:-1]]))
        step *= 2
    out = np.full(n, -1, np.int64)
    out[pos] = name
    return out


def sorted_bucket(text: np.ndarray, rank: np.ndarray, p: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Suffixes p (each with 13 bytes at least) in order."""
    keys = []
    for few in (range(8), range(8, PERIOD)):
        k = np.zeros(len(p), np.uint64)
        for j in few:
            k = (k << np.uint64(8)) | text[p + j].astype(np.uint64)
        keys.append(k)
    order = np.lexsort((keys[1], keys[0]))
    p, k0, k1 = p[order], keys[0][order], keys[1][order]
    tie = np.cumsum(np.concatenate([[False], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])]))
    start = np.searchsorted(tie, tie)  # where each tie begins
    residue = p % PERIOD
    own = [np.flatnonzero(residue == c) for c in range(PERIOD)]
    base = tie.astype(np.int64) << 32
    # a class in its order, whichever of its shifts into the cover is read
    own = [i[np.argsort(base[i] | rank[p[i] + table_[c, c]])] for c, i in enumerate(own)]
    place = np.zeros(len(p), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            if len(own[a]) and len(own[b]):
                k = table_[a, b]
                mine, theirs = base[own[a]] | rank[p[own[a]] + k], base[own[b]] | rank[p[own[b]] + k]
                place[own[a]] += np.searchsorted(theirs, mine) - np.searchsorted(tie[own[b]], tie[own[a]])
    out = np.empty_like(p)
    out[start + place] = p
    return out


def groups(text: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int, bucket: int = BUCKET) -> np.ndarray:
    """A number for each suffix start; equal for equal windows of length bytes."""
    size = np.diff(ends, prepend=0)
    block = np.repeat(np.arange(len(ends)), size)
    rank, table_ = cover_ranks(text, np.repeat(ends, size), block), shifts()
    out, seen = np.empty(len(text), np.int64), 0
    head = (text[starts].astype(np.int64) << 8) | text[starts + 1]
    by_head = np.argsort(head, kind="stable")
    counts = np.cumsum(np.bincount(head, minlength=65536))
    at = 0
    while at < len(starts):
        limit = np.searchsorted(counts, at + bucket, side="right")  # heads that fit
        end = int(counts[limit - 1]) if limit and counts[limit - 1] > at else int(counts[np.searchsorted(counts, at, side="right")])
        p = sorted_bucket(text, rank, starts[by_head[at:end]], table_)
        same = np.empty(len(p), bool)
        same[0] = False
        for k in range(1, len(p), 20_000):
            rows = np.arange(k, min(k + 20_000, len(p)))
            span = np.arange(length)
            same[rows] = (text[p[rows][:, None] + span] == text[p[rows - 1][:, None] + span]).all(axis=1)
        out[p] = seen + np.cumsum(~same)
        seen += len(p) + 1
        at = end
    return out[starts]


def _cut(raw: list[bytes], spans: list[np.ndarray]) -> dict:
    kept = []
    for x, s in zip(raw, spans):
        edges = [0, *np.column_stack([s["start"], s["end"]]).ravel().tolist(), len(x)]
        kept.append(b"".join(x[a:b] for a, b in zip(edges[::2], edges[1::2])) if len(s) else x)
    return {
        "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "n_removed": pa.array([len(x) - len(k) for x, k in zip(raw, kept)], pa.int64()),
        "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept": pa.array(kept, pa.binary()),
    }


def plan(length: int = LENGTH, **more) -> repeats.Plan:
    return repeats.Plan(units=units, mixed=mixed, groups=groups, length=length, gram=max(1, length // 3 - 1), same_doc=True, **more)


def dedup(docs: DataFrame, length: int = LENGTH, carried: list[str] = (), **more) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept: every byte of a passage of length bytes that also starts earlier is gone."""
    return repeats.removed(docs, plan(length, **more), _cut, "n_bytes long, n_removed long, n_spans long, kept binary", list(carried))


def _cut_text(raw: list[bytes], spans: list[np.ndarray]) -> dict:
    """The kept bytes as text, without the rests of characters that a cut went through."""
    made = _cut(raw, spans)
    return {"n_removed": made["n_removed"], "kept": pa.array([x.decode("utf-8", "ignore") for x in made["kept"].to_pylist()], pa.string())}


def dedup_text(docs: DataFrame, length: int = LENGTH, carried: list[str] = (), **more) -> DataFrame:
    """doc_id, n_removed and the text kept, as `dedup` has it in bytes."""
    return repeats.removed(docs, plan(length, **more), _cut_text, "n_removed long, kept string", list(carried))


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_array": op1_suffix_array}
ORACLES: dict[str, str] = {}
