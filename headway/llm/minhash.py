"""MinHash near-dedup with odd sketches.

Texts are lower-cased (A-Z) and shingled; equal shingle sets are one class, named by a hash of the set, so that
rows are told apart by their texts and not by their doc_id. Each class has `BANDS * BAND` MinHash samples. Bands of equal samples give candidates; an odd
sketch (a parity bitmap of the samples, folded) bounds from the XOR population count how many samples of
a pair can differ, which drops pairs far below the threshold. What is left is confirmed on full sets.

Bands don't compare pairs. Classes that share a band belong to one cluster (the components of each
bucket's links to its least member). A cluster's sketches and sets meet in one task, which tries pairs in
order of their sketches' distance and leaves out those that are already linked; clusters of more than
CLUSTER classes are dealt into blocks, and each two blocks meet in a task, so that no pair is left out
and no task holds more than two blocks. Only links of a spanning forest come back.

With 56 bands of six samples a pair of similarity 0.8 is missed with probability 4e-8. Null, empty and
blank texts have empty sets and link with nothing. Rows that repeat a doc_id count as one document for
links (the union of their links) and each give a row. Rows without a doc_id link by their texts; their
component is null only if nobody in it has a doc_id. `dedup` doesn't count rows of one doc_id as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.bpe import _un, _z
from headway.llm.common import freed, slices, stage, table, texts
from headway.llm.suffix_tree import units

BANDS, BAND = 56, 6
SAMPLES = BANDS * BAND
#: Bits of an odd sketch.
ODD = 2048
#: Classes of a cluster that meet in one task.
CLUSTER = 2048
PERCENT = 80
U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(77)
_MUL, _ADD = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) | U(1), _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
SIGNED = "doc_id long, n_shingles long, class long, digest string, bands array<long>, odd binary"
#: A text with a word, as `units` has them.
WORD = r"[^\x20\x09-\x0D]"
#: Samples that may differ in a linked pair: the mean at the threshold and six standard deviations.
MOST_DIFFER = int(SAMPLES * (1 - PERCENT / 100) + 6 * (SAMPLES * PERCENT / 100 * (1 - PERCENT / 100)) ** 0.5)


def shingles(raw: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    mul = [U(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(words)]
    for w in units([x.translate(_LOWER) for x in raw]):
        n = min(words, len(w))
        if not n:
            out.append(np.zeros(0, U))
            continue
        h = np.zeros(len(w) - n + 1, U)
        for k in range(n):
            h += (w[k : len(w) - n + 1 + k] ^ (w[k : len(w) - n + 1 + k] >> U(29))) * mul[k]
        h = (h ^ (h >> U(32)) ^ U(n if len(w) < words else 0)) * U(0xBF58476D1CE4E5B9)
        out.append(np.unique(h ^ (h >> U(29))))
    return out


def samples(s: np.ndarray) -> np.ndarray:
    """The least of each of SAMPLES hash functions over a set, its upper halves."""
    out = np.full(SAMPLES, 2**64 - 1, U)
    for k in range(0, len(s), 2048):
        np.minimum(out, (s[k : k + 2048, None] * _MUL + _ADD).min(axis=0), out=out)
    return (out >> U(32)).astype(np.uint32)


def odd_sketch(m: np.ndarray) -> bytes:
    """Parities of how many samples (with their numbers) fall on each bit."""
    x = (m.astype(U) + (np.arange(SAMPLES, dtype=U) << U(32))) * U(0x94D049BB133111EB)
    bits = np.bincount(((x >> U(40)) % U(ODD)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _class(s: np.ndarray) -> int | None:
    """Equal for equal sets; none for the empty set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [x.encode() for x in b.column(1).to_pylist()]
            sets = shingles(raw, words)
            m = [samples(s) if len(s) else None for s in sets]
            keys = [None if x is None else ((x.reshape(BANDS, BAND).astype(U) * _MUL[:BAND]).sum(axis=1, dtype=U) * U(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=U)).view(np.int64) for x in m]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64()), b.column(2),
                pa.array(keys, pa.list_(pa.int64())), pa.array([None if x is None else odd_sketch(x) for x in m], pa.binary()),
            ], ["doc_id", "n_shingles", "class", "digest", "bands", "odd"])

    return run


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the least node of each component, by alternating star contractions (large, then small)."""
    state = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    # a round reads its edges several times
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = stage(small.where("u <> v").distinct())
        e, now = new, state(new)
        if now == was:
            break
        was = now
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _links(t: pa.Table) -> pa.Table:
    """The classes of a cluster, or of two blocks of it -> links of a spanning forest."""
    node, block = t["node"].to_numpy(), t["block"].to_numpy()
    sets = [np.frombuffer(_un(x), U) for x in t["set"].to_pylist()]
    odd = np.stack([np.frombuffer(x, U) for x in t["odd"].to_pylist()])
    size, root, out = np.array([len(x) for x in sets]), list(range(len(node))), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    found = []
    for k in range(0, len(node), 64):
        apart = np.bitwise_count(odd[k : k + 64, None] ^ odd[None]).sum(axis=2, dtype=np.int64)
        x, y = np.nonzero(apart <= 2 * MOST_DIFFER)  # a differing sample changes two bits at most
        x += k
        own = (x < y) & (100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y]))
        if (block != block[0]).any():
            own &= block[x] != block[y]
        x, y = x[own], y[own]
        found.append(np.stack([apart[x - k, y], x, y]))
    pairs = np.concatenate(found, axis=1)
    for x, y in pairs[1:, np.argsort(pairs[0], kind="stable")].T.tolist():
        a, b = find(x), find(y)
        if a == b:
            continue
        same = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * same >= PERCENT * (len(sets[x]) + len(sets[y]) - same):
            root[a] = b
            out.append((int(node[x]), int(node[y])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingles([x.encode() for x in b.column(1).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.int64()), pa.array([_z(s) for s in sets], pa.binary())], ["node", "set"])

    return run


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def _linked(docs: DataFrame, words: int, cluster: int) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, n_shingles, class, digest of the text; and the links a, b of classes."""
    rows = texts(docs).withColumn("digest", _digest())
    signed = stage(rows.mapInArrow(_sign(words), SIGNED))
    ids = signed.select("doc_id", "n_shingles", "class", "digest")
    nodes = stage(signed.where("class IS NOT NULL").select(F.col("class").alias("node"), "bands", "odd").dropDuplicates(["node"]))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("band", "hub")
    near = stage(banded.join(hubs, "band").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    clusters = components(near, ends)
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(cluster)).cast("int").alias("blocks"))
    placed = stage(clusters.join(sizes, "root").select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    # one text gives the set of a class
    asked = ids.join(placed.select(F.col("node").alias("class")), "class", "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "digest")).alias("one"))
    asked = asked.select(F.col("one.doc_id").alias("id"), F.col("one.digest").alias("by")).distinct()
    sets = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("by")), "left_semi").mapInArrow(_sets(words), "node long, set binary").dropDuplicates(["node"])
    held = placed.join(nodes.select("node", "odd"), "node").join(sets, "node")
    # each block meets itself and every other
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    held = held.select("node", "root", "block", "odd", "set", met.alias("m")).select("node", "root", "block", "odd", "set", "m.i", "m.j")
    return ids, stage(held.groupBy("root", "i", "j").applyInArrow(freed(_links), "a long, b long"))


def classes(docs: DataFrame, words: int = 5, cluster: int = CLUSTER) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of each row."""
    ids, links = _linked(docs, words, cluster)
    # a doc_id that stands in several rows ties their nodes together
    named = ids.where("class IS NOT NULL AND doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("doc_id", "a")
    tied = named.join(several, "doc_id").select("a", F.col("class").alias("b")).where("a <> b")
    least = ids.where("class IS NOT NULL").groupBy(F.col("class").alias("node")).agg(F.min("doc_id").alias("least"))
    found = components(links.unionByName(tied), least.select("node")).join(least, "node")
    found = stage(found)
    names = found.groupBy("root").agg(F.min("least").alias("component_id"))
    found = found.join(names, "root").select(F.col("node").alias("class"), "component_id")
    return ids.join(found, "class", "left").select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each group of near copies, with all its columns: the least doc_id, if any has one. Rows without a word stay."""
    ids, links = _linked(docs, words, CLUSTER)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    least = stage(ids.where("class IS NOT NULL").groupBy(F.col("class").alias("node")).agg(first))
    kept = components(links, least.select("node")).join(least, "node").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__of"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    # rows of the same doc_id and text are copies
    one = docs.where(worded).withColumn("__digest", _digest())
    one = one.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")), "left_semi")
    return one.dropDuplicates(["doc_id", "__digest"]).drop("__digest").unionByName(docs.where(~worded))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), 4).withColumn("kept", F.col("doc_id") == F.col("component_id"))


QUERIES = {"op2_minhash": op2_minhash}
ORACLES: dict[str, str] = {}
