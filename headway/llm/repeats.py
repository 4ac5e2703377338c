"""Repeated passages of a fixed length, over bytes or words: what both substring operators share.

Every window of `length` units picks one anchor in it, the gram of `gram` units with the least hash, so
equal windows pick the same anchor at the same offset. An anchor with the run of windows that picked it
is a block. Blocks go by their gram's hash to buckets, as a few bytes each:

1. scan: number the units of a chunk of documents, keep the chunk's rows in a file of the shared folder,
   send the blocks of the chunk to their buckets, once for each different block.
2. match: identical blocks (by a 128-bit digest of their units) are one entry of the suffix structure; all
   but the first are removed whole. Grams with several different blocks ask the chunks for their units.
3. resolve: the suffixes (window starts) of different blocks of a gram are put in groups of equal windows
   by the operator's own suffix structure; all but a group's first are removed. Where a gram has more than
   `hot` different blocks, its suffixes are split by a longer prefix, the whole window: each different
   window of a chunk travels with its units, to the bucket of its digest, and meets its equals there in
   the same suffix structure.
4. apply: each chunk reads its file again and cuts out what the buckets removed.

There are so many buckets that each has the blocks of `bucket` bytes of text at most. No step sends texts
through a shuffle, gathers a hot block's copies, or compares pairs. Anchors and hashes of grams only choose
where suffixes meet; which windows are equal is settled by digests of whole blocks and by units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm import files
from headway.llm.bpe import _un, _z
from headway.llm.common import freed, parts, release, shared_dir, stage, text_bytes

NULL_ID = -(2**63)
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
U = np.uint64
ROWS = "kind string, key long, n long, body binary"
_ROWS = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
#: One block: 48 bits of its gram's hash, both halves of its digest, document, row in the chunk, first window, anchor's offset from it, windows; the chunk.
BLOCK = np.dtype([("a", "<u8"), ("c", "<u8"), ("e", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("l", "<u4"), ("d", "<u2"), ("w", "<u2"), ("chunk", "<i8")])
SPAN = np.dtype([("row", "<u4"), ("start", "<u4"), ("end", "<u4")])


@dataclass(frozen=True)
class Plan:
    """units: batch of texts as bytes -> an array each. mixed: units -> 64-bit numbers for grams. groups: (units, ends, starts, length) -> group of each window, by a suffix structure."""

    units: Callable
    mixed: Callable
    groups: Callable
    length: int
    gram: int
    same_doc: bool  # an earlier start in the same document counts
    chunk: int = 8_000_000  # bytes of text in a chunk
    piece: int = 500_000  # units hashed at once
    hot: int = 5_000  # different blocks of a gram that meet in one task
    bucket: int = 32_000_000  # bytes of text whose blocks are in a bucket


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(MIX1)
    h = (h ^ (h >> U(27))) * U(MIX2)
    return h ^ (h >> U(31))


def packed(a: np.ndarray) -> bytes:
    """Columns of a record array, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(a[f]).view(np.uint8).reshape(len(a), -1).T.tobytes() for f in a.dtype.names]
    return _z(b"".join(planes))


def unpacked(b: bytes, dtype: np.dtype) -> np.ndarray:
    raw = _un(b, np.uint8)
    n, at = len(raw) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for f in dtype.names:
        k = dtype[f].itemsize
        out[f] = np.ascontiguousarray(raw[at : at + n * k].reshape(k, n).T).reshape(-1).view(dtype[f])
        at += n * k
    return out


class Hashes:
    """Hashes of any stretch of units, from sums of units times powers of an odd base: good enough to choose anchors and buckets, not to tell stretches apart."""

    def __init__(self, units: np.ndarray):
        n = len(units) + 1
        power = np.full(n, BASE, U)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.inverse = np.full(n, pow(BASE, -1, 2**64), U)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n, U)
        np.cumsum(units * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.inverse[:n]


def digests(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit digest of each stretch of units."""
    from xxhash import xxh3_128_digest

    body, k = memoryview(np.ascontiguousarray(units)).cast("B"), units.itemsize
    return np.frombuffer(b"".join([xxh3_128_digest(body[a:b]) for a, b in zip((start * k).tolist(), (end * k).tolist())]), "<u8").reshape(-1, 2)


def blocks_of(units: np.ndarray, ends: np.ndarray, length: int, gram: int, mix: Callable) -> tuple[np.ndarray, ...]:
    """Grams' hashes, blocks' digests, first windows, anchor offsets and numbers of windows, for texts laid end to end."""
    none = (np.zeros(0, U), np.zeros((0, 2), U), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(units) < length:
        return none
    wide = length - gram + 1
    g = mixed(Hashes(mix(units)).grams(gram))
    low = (g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U)
    s = 1
    while 2 * s <= wide:
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    if wide > s:
        low = np.minimum(low[: s - wide], low[wide - s :])
    anchor = (low & U(0xFFFFFFFF)).astype(np.int64)
    starts = np.append(0, ends[:-1])
    room = np.maximum(ends - starts - length + 1, 0)  # windows of each text
    p = np.repeat(starts - (np.cumsum(room) - room), room) + np.arange(int(room.sum()))
    if not len(p):
        return none
    anchor = anchor[p]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.append(first[1:] - 1, len(p) - 1)
    left, a = p[first], anchor[first]
    w, d = last - first + 1, a - left
    return g[a] & U(2**48 - 1), digests(units, left, left + w + length - 1), left, d, w


def blocks(plan: Plan, docs: list, raw: list[bytes], chunk: int) -> np.ndarray:
    found, held, size = [], [], 0

    def flush() -> None:
        ends = np.cumsum([len(u) for *_, u in held])
        a, c, left, d, w = blocks_of(np.concatenate([u for *_, u in held]), ends, plan.length, plan.gram, plan.mixed)
        at = np.searchsorted(ends, left, side="right")
        out = np.empty(len(a), BLOCK)
        out["a"], out["c"], out["e"], out["d"], out["w"], out["chunk"] = a, c[:, 0], c[:, 1], d, w, chunk
        row = np.array([r for r, *_ in held], np.int64)
        out["row"], out["doc"] = row[at], np.array(docs, np.int64)[row[at]]
        out["l"] = left - np.append(0, ends[:-1])[at] + np.array([o for _, o, _ in held], np.int64)[at]
        found.append(out)

    for k in range(0, len(raw), 256):
        for row, u in enumerate(plan.units(raw[k : k + 256]), k):
            for o in range(0, max(len(u) - plan.length + 1, 0), plan.piece):
                held.append((row, o, u[o : o + plan.piece + plan.length - 1]))
                size += len(held[-1][2])
                if size >= plan.piece:
                    flush()
                    held, size = [], 0
    if held:
        flush()
    return np.concatenate(found) if found else np.zeros(0, BLOCK)


def merged(s: np.ndarray) -> np.ndarray:
    """Spans in order, those that touch made one."""
    if not len(s):
        return s
    s = s[np.lexsort((s["start"], s["row"]))]
    base = s["row"].astype(np.int64) << 32
    reach = np.maximum.accumulate(base + s["end"])
    first = np.flatnonzero(np.concatenate([[True], (base + s["start"])[1:] > reach[:-1]]))
    out = s[first]
    out["end"] = (reach[np.append(first[1:] - 1, len(s) - 1)] - base[first]).astype(np.uint32)
    return out


def spans(b: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(b), SPAN)
    out["row"], out["start"], out["end"] = b["row"], b["l"], b["l"] + b["w"].astype(np.uint32) + np.uint32(length - 1)
    return out


def by_chunk(kind: str, b: np.ndarray, body: Callable) -> list[tuple]:
    b = b[np.argsort(b["chunk"], kind="stable")]
    at = np.flatnonzero(np.diff(b["chunk"], prepend=-1)).tolist()
    return [(kind, int(b["chunk"][i]), j - i, body(b[i:j])) for i, j in zip(at, [*at[1:], len(b)])]


def cut_rows(b: np.ndarray, length: int) -> list[tuple]:
    return by_chunk("cut", b, lambda x: packed(merged(spans(x, length))))


def block_rows(kind: str, b: np.ndarray, buckets: int) -> list[tuple]:
    to = (b["a"] % U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    at = np.flatnonzero(np.diff(to[order], prepend=-1)).tolist()
    return [(kind, int(to[order[i]]), j - i, packed(b[order[i:j]])) for i, j in zip(at, [*at[1:], len(order)])]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)


def repeated(b: np.ndarray, same_doc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in order of gram, block and place; which of them start a block; which have an equal block before them."""
    b = b[np.lexsort((b["l"], b["row"], b["chunk"], b["doc"], b["e"], b["c"], b["a"]))]
    new = np.concatenate([[True], (b["a"][1:] != b["a"][:-1]) | (b["c"][1:] != b["c"][:-1]) | (b["e"][1:] != b["e"][:-1])]) if len(b) else np.zeros(0, bool)
    if same_doc:
        return b, new, ~new
    first = b["doc"][np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))] if len(b) else b["doc"]
    return b, new, b["doc"] > first


def _scan(plan: Plan, folder: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def flush(held: list[pa.RecordBatch], seq: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids = t["doc_id"].fill_null(NULL_ID)
            t = t.take(pa.compute.sort_indices(ids))
            chunk = part * 2**20 + seq
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            files.write(folder, str(chunk), sink.getvalue().to_pybytes())
            raw = [x or b"" for x in t["text"].cast(pa.large_binary()).to_pylist()]
            b, _, seen = repeated(blocks(plan, t["doc_id"].fill_null(NULL_ID).to_pylist(), raw, chunk), plan.same_doc)
            rest = b[~seen]
            return batch([("chunk", chunk, len(raw), None), *cut_rows(b[seen], plan.length), *block_rows("block", rest[np.lexsort((rest["l"], rest["row"]))], buckets)])

        held, size, seq = [], 0, 0
        for b in batches:
            at = 0
            for k, n in enumerate((b.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()), 1):
                size += len(n)
                if size >= plan.chunk:
                    yield flush([*held, b.slice(at, k - at)], seq)
                    release()
                    held, size, seq, at = [], 0, seq + 1, k
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield flush(held, seq)
            held = []
        release()

    return run


def _match(plan: Plan, buckets: int):
    def run(t: pa.Table) -> pa.Table:
        b, new, seen = repeated(np.concatenate([unpacked(x, BLOCK) for x in t["body"].to_pylist()]), plan.same_doc)
        rows = cut_rows(b[seen], plan.length)
        gram = np.cumsum(np.concatenate([[True], b["a"][1:] != b["a"][:-1]])) - 1
        different = np.bincount(gram, weights=new)[gram]
        if not plan.same_doc:  # some block of the gram must be in an earlier document
            least = np.full(gram[-1] + 1, 2**63 - 1, np.int64)
            np.minimum.at(least, gram, b["doc"])
            most = np.full(gram[-1] + 1, NULL_ID, np.int64)
            np.maximum.at(most, gram, b["doc"])
            different[(least == most)[gram]] = 0
        asks = ~seen & (different > 1)
        for kind, which in (("ask", asks & (different <= plan.hot)), ("askhot", asks & (different > plan.hot))):
            rows += by_chunk(kind, b[which], packed)
        return pa.Table.from_batches([batch(rows)])

    return run


def _read(plan: Plan, folder: str, chunk: int) -> tuple[pa.Table, list[bytes]]:
    t = pa.ipc.open_stream(files.read(f"{folder}/{chunk}")).read_all()
    return t, [x or b"" for x in t["text"].cast(pa.large_binary()).to_pylist()]


#: Windows of a hot gram that are sent at once, and units of a suffix structure (one gram's at least).
WINDOWS, STRUCTURE = 20_000, 1_000_000


def _fetch(plan: Plan, folder: str, buckets: int):
    """Blocks asked of a chunk -> their units; for hot grams, each different window with its units. Both by bucket."""

    def sent(b: np.ndarray, u: list[np.ndarray], key: np.ndarray) -> list[tuple]:
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.diff(key[order], prepend=-1)).tolist()
        rows = []
        for i, j in zip(at, [*at[1:], len(order)]):
            own = order[i:j]
            head, body = packed(b[own]), _z(np.concatenate([u[k] for k in own.tolist()]))
            rows.append(("units", int(key[own[0]]), j - i, len(head).to_bytes(8, "little") + head + body))
        return rows

    def asked(batches: list[pa.RecordBatch], kind: str) -> Iterator[tuple[int, np.ndarray]]:
        """Rows of the chunk with their blocks, in order."""
        found = [unpacked(x, BLOCK) for t in batches for k, x in zip(t.column("kind").to_pylist(), t.column("body").to_pylist()) if k == kind]
        if found:
            b = np.concatenate(found)
            b = b[np.argsort(b["row"], kind="stable")]
            at = np.flatnonzero(np.diff(b["row"].astype(np.int64), prepend=-1)).tolist()
            yield from ((int(b["row"][i]), b[i:j]) for i, j in zip(at, [*at[1:], len(b)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # what a chunk is asked for is bounded by the chunk
        _, raw = _read(plan, folder, held[0].column("key")[0].as_py())
        u, b = [], []
        for row, own in asked(held, "ask"):
            text = plan.units([raw[row]])[0]
            u += [text[x : x + y + plan.length - 1] for x, y in zip(own["l"].tolist(), own["w"].tolist())]
            b.append(own)
        if b:
            b = np.concatenate(b)
            yield batch(sent(b, u, (b["a"] % U(buckets)).astype(np.int64)))
        windows = []
        for row, own in asked(held, "askhot"):
            p = np.unique(np.concatenate([np.arange(x, x + y) for x, y in zip(own["l"].tolist(), own["w"].tolist())]))
            c, out = digests(plan.units([raw[row]])[0], p, p + plan.length), np.empty(len(p), BLOCK)
            out["a"], out["c"], out["e"], out["doc"], out["row"], out["l"], out["d"], out["w"], out["chunk"] = c[:, 0] & U(2**48 - 1), c[:, 0], c[:, 1], own["doc"][0], row, p, 0, 1, own["chunk"][0]
            windows.append(out)
        if windows:
            w, _, seen = repeated(np.concatenate(windows), plan.same_doc)
            yield batch(cut_rows(w[seen], plan.length))
            w = w[~seen]
            w = w[np.argsort(w["row"], kind="stable")]
            now, text = -1, None
            for k in range(0, len(w), WINDOWS):
                own, u = w[k : k + WINDOWS], []
                for row, x in zip(own["row"].tolist(), own["l"].tolist()):
                    if row != now:
                        now, text = row, plan.units([raw[row]])[0]
                    u.append(text[x : x + plan.length])
                # buckets of their own, beside those of the blocks
                yield batch(sent(own, u, buckets + ((own["c"] >> U(16)) % U(buckets)).astype(np.int64)))
        del raw, u, b, windows, held
        release()

    return run


def _resolve(plan: Plan):
    """The different blocks of a bucket's grams -> what their suffixes remove."""

    def run(t: pa.Table) -> pa.Table:
        heads, bodies = [], []
        for x in t["body"].to_pylist():
            n = int.from_bytes(x[:8], "little")
            heads.append(unpacked(x[8 : 8 + n], BLOCK))
            bodies.append(_un(x[8 + n :], plan.units([b"x"])[0].dtype))
        b, units, rows = np.concatenate(heads), np.concatenate(bodies), []
        del heads, bodies
        size = b["w"].astype(np.int64) + plan.length - 1
        begin = np.cumsum(size) - size
        order = np.argsort(b["a"], kind="stable")
        grams = np.append(np.flatnonzero(np.diff(b["a"][order])) + 1, len(b))
        total, at = np.cumsum(size[order]), 0
        while at < len(b):  # whole grams, as many as a structure may have
            most = np.searchsorted(total, (total[at - 1] if at else 0) + STRUCTURE, side="right")
            k = np.searchsorted(grams, most, side="right") - 1
            end = int(grams[k]) if k >= 0 and grams[k] > at else int(grams[np.searchsorted(grams, at, side="right")])
            own = order[at:end]
            rows += some(b[own], units[np.repeat(begin[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(int(size[own].sum()))])
            at = end
        return pa.Table.from_batches([batch(rows)])

    def some(b: np.ndarray, units: np.ndarray) -> list[tuple]:
        w = b["w"].astype(np.int64)
        size = w + plan.length - 1
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(b)), w)  # of each window, its block
        off = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        group = plan.groups(units, begin + size, begin[of] + off, plan.length)
        win = b[of]
        win["l"] += off.astype(np.uint32)
        win["w"] = 1
        order = np.lexsort((win["l"], win["row"], win["chunk"], win["doc"], group))
        g, d = group[order], win["doc"][order]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        gone = ~new if plan.same_doc else d > d[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]
        return cut_rows(win[order[gone]], plan.length)

    return run


def removed(docs: DataFrame, plan: Plan, apply: Callable, schema: str, carried: list[str] = ()) -> DataFrame:
    """apply: (texts as bytes, spans as a list of arrays of start and end) -> columns of schema. Returns in_<column> for those carried, doc_id, and the columns of schema."""
    spark = docs.sparkSession
    folder, tasks = shared_dir(spark), 2 * parts(spark)
    buckets = max(tasks, -(-text_bytes(docs) // plan.bucket))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(f"in_{c}") for c in carried))
    kinds = {f"in_{c}": t for c, t in ((f.name, f.dataType.simpleString()) for f in docs.schema) if c in carried}
    scanned = stage(rows.mapInArrow(_scan(plan, folder, buckets), ROWS), "none")
    matched = stage(scanned.where("kind = 'block'").groupBy("key").applyInArrow(freed(_match(plan, buckets)), ROWS), "none")
    fetched = stage(matched.where("kind in ('ask', 'askhot')").groupBy("key").applyInArrow(_fetch(plan, folder, buckets), ROWS), "none")
    resolved = fetched.where("kind = 'units'").groupBy("key").applyInArrow(freed(_resolve(plan)), ROWS)
    cuts = reduce(DataFrame.unionByName, [x.where("kind = 'cut'") for x in (scanned, matched, fetched, resolved)])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        t, raw = _read(plan, folder, left["key"][0].as_py())
        s = merged(np.concatenate([unpacked(x, SPAN) for x in right["body"].to_pylist()] or [np.zeros(0, SPAN)]))
        at = np.searchsorted(s["row"], np.arange(len(raw) + 1)).tolist()
        made = apply(raw, [s[i:j] for i, j in zip(at, at[1:])])
        return pa.table({c: t[c] for c in ("doc_id", *kinds)} | made)

    out = ", ".join(["doc_id long", *(f"`{c}` {t}" for c, t in kinds.items()), schema])
    # a row stands for a whole chunk file here, so that row sizes must not decide how many tasks there are
    chunks = scanned.where("kind = 'chunk'").select("key").repartition(tasks, "key")
    return chunks.groupBy("key").cogroup(cuts.repartition(tasks, "key").groupBy("key")).applyInArrow(freed(cut), out)
