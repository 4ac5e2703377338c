"""Merkle manifest of a dataset: a tree for each language, a tree of their roots, and a proof for each row.

Leaves are hashed by Spark, ranked in their language by a range partitioning and counts of its partitions, and reduced in
blocks of 4,096 leaves (four levels of eight). Blocks are reduced again until at most TOP nodes are left; the driver builds
the tree above them and broadcasts, for each, the path from it to the root. Executors work out each block once more,
now with the path above it, and finish proofs and folds row by row. Paths of whole rows are never stored: between the two
passes a block is known by its hash alone, and paths stand only beside upper nodes.

Defined cases: rows of a language that repeat a doc_id, or lack one (these come first), are leaves in the order of their hashes; a
null doc_id isn't tampered with. Equal rows are leaves each. Any column may be null. Very long texts are hashed whole; an
empty table gives no rows; other columns are ignored. Languages may be as many as rows: their roots are reduced in blocks too.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.llm.common import parts, stage, table

#: Children of a node, levels that a block takes together, and the most nodes that the driver builds the top from.
ARITY, LEVELS, TOP = 8, 4, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(text: Column) -> Column:
    """Hash of a row's fields, each with its length in bytes, so that no two rows run together; text stands for the field text."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(F.encode(c, "UTF-8")).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(field((text if name == "text" else F.col(name)).cast("string")) for name in FIELDS)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf and tampered (the leaf of the lower-cased text, for a third of the rows) of each row."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(lower))
    return docs.select(*FIELDS).select(F.col("lang").alias("tree"), "doc_id", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered"))


def ranked(rows: DataFrame, order: list[str], group: bool = True) -> DataFrame:
    """A column `at`, the place of each row in its tree (or in all) by the columns of order, and `n`, the number of the tree's rows.

    Rows are dealt by range, so that a large tree is spread over many tasks; equal rows are dealt at random. A partition counts
    its rows of each tree; counts of a tree are one row for each partition that it reaches into, and their running sum is small.
    """
    keys = (["tree"] if group else []) + order
    n = parts(rows.sparkSession)
    mixed = rows.withColumn("mix", F.rand(7))
    dealt = mixed.repartitionByRange(n, *(F.col(k).asc_nulls_first() for k in keys), "mix").sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys), "mix")
    row = F.monotonically_increasing_id()
    dealt = stage(dealt.drop("mix").withColumn("id", row).withColumn("part", F.shiftright("id", 33)))
    trees = ["tree"] if group else [F.lit(None).cast("string").alias("tree")]
    count = dealt.select(*trees, "part", "id").groupBy("tree", "part").agg(F.count(F.lit(1)).alias("own"), F.min("id").alias("first"))
    w = Window.partitionBy("tree")
    count = count.select(F.col("tree").alias("of"), F.col("part").alias("in"), "first", (F.sum("own").over(w.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(w).alias("n"))
    same = (F.col("in") == F.col("part")) & (F.col("of").eqNullSafe(F.col("tree")) if group else F.lit(True))
    return dealt.join(count, same).withColumn("at", F.col("id") - F.col("first") + F.col("before")).drop("id", "part", "of", "in", "first", "before")


def climb(nodes: list[str], levels: int | None) -> list[list[str]]:
    """Nodes level by level, so many levels up, or until one is left if that is sooner."""
    out = [nodes]
    while len(out[-1]) > 1 and len(out) - 1 != levels:
        last = out[-1]
        out.append([sha256("".join(last[k : k + ARITY]).encode()).hexdigest() for k in range(0, len(last), ARITY)])
    return out


def whole(nodes: list[str], levels: int) -> list[list[str]]:
    """Like climb, but a last block of a larger tree goes up all levels even when one node is left: it is hashed alone."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([sha256("".join(last[k : k + ARITY]).encode()).hexdigest() for k in range(0, len(last), ARITY)])
    return out


def path(tree: list[list[str]], k: int) -> str:
    """What stands left and right of node k's line of ancestors, level by level: "left|right/left|right"."""
    steps = []
    for level in tree[:-1]:
        start = k // ARITY * ARITY
        steps.append(f"{''.join(level[start:k])}|{''.join(level[k + 1 : start + ARITY])}")
        k //= ARITY
    return "/".join(steps)


def joined(*paths: str) -> str:
    return "/".join(p for p in paths if p)


def proof(way: str) -> str:
    """Digest of all siblings on a path."""
    return sha256(way.replace("|", "").replace("/", "").encode()).hexdigest()


def fold(node: str, way: str) -> str:
    """The root that a node gives with the siblings of its path."""
    for step in way.split("/") if way else ():
        left, _, right = step.partition("|")
        node = sha256(f"{left}{node}{right}".encode()).hexdigest()
    return node


def _block(rows: pa.Table, levels: int) -> tuple[list[str], list[list[str]], list[int]]:
    """A block's nodes level by level, and the order of its rows."""
    order = rows.column("at").to_numpy().argsort().tolist()
    hashes = rows.column("leaf").to_pylist()
    nodes = [hashes[k].hex() for k in order]
    n = rows.column("n")[0].as_py()
    # a tree that one block holds ends at its root; blocks of larger trees end all at the same level
    return nodes, climb(nodes, None) if n <= ARITY**levels else whole(nodes, levels), order


def reduced(rows: DataFrame, levels: int) -> DataFrame:
    """tree, at, n, leaf of the next nodes: a row for each block of tree, at, n, leaf."""

    def run(t: pa.Table) -> pa.Table:
        nodes, tree, _ = _block(t, levels)
        top = bytes.fromhex(tree[-1][0])
        size = ARITY**levels
        return pa.table({"tree": t.column("tree").slice(0, 1), "at": [t.column("at")[0].as_py() // size], "n": [-(-t.column("n")[0].as_py() // size)], "leaf": pa.array([top], pa.binary())})

    blocks = rows.select("tree", "at", "n", "leaf").withColumn("block", F.floor(F.col("at") / ARITY**levels))
    return blocks.groupBy("tree", "block").applyInArrow(run, "tree string, at long, n long, leaf binary")


def crown(rows: list, trees: list[tuple[str | None, str]] | None = None) -> tuple[dict, str]:
    """In the driver: from at most TOP nodes (tree, at, leaf), the subroot and the path to the root of each (tree, at), and the root."""
    by = lambda r: (r.tree is not None, (r.tree or "").encode())  # noqa: E731  null first, then bytes
    own = [(t, climb([r.leaf.hex() for r in g], None)) for t, g in ((k, list(g)) for k, g in groupby(sorted(rows, key=lambda r: (*by(r), r.at)), key=lambda r: r.tree))]
    above = climb([t[-1][0] for _, t in own], None)
    found = {}
    for k, (name, t) in enumerate(own):
        up = path(above, k)
        for i in range(len(t[0])):
            found[name, i] = (t[-1][0], joined(path(t, i), up))
    return found, above[-1][0]


def paths(rows: DataFrame, levels: int, top: int) -> tuple[DataFrame | dict, str]:
    """For each node of rows (tree, at, n, leaf) its subroot and path to the root, and the root: a dict from the driver if there
    are at most so many nodes, else staged rows tree, at, subroot, way. rows are staged; none gives no root."""
    count, trees = rows.count(), rows.groupBy("tree").agg(F.max("n").alias("n"))
    if count <= top:
        return crown(rows.collect()) if count else ({}, "")
    if trees.where("n > 1").isEmpty():
        # roots only, too many for the driver: they are the nodes of one tree
        order = rows.withColumnRenamed("tree", "name").select("name", "leaf")
        one = stage(ranked(order.withColumn("tree", F.lit(None).cast("string")), ["name"], group=False).select("name", F.lit(None).cast("string").alias("tree"), "at", "n", "leaf"))
        upper, root = paths(stage(reduced(one, levels)), levels, top)
        return stage(finished(one, levels, upper, ["name"]).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("at"), F.lower(F.hex("leaf")).alias("subroot"), "way")), root
    upper, root = paths(stage(reduced(rows, levels)), levels, top)
    return stage(finished(rows, levels, upper, []).select("tree", "at", "subroot", "way")), root


def finished(rows: DataFrame, levels: int, upper: DataFrame | dict, carried: list[str], judge=None, schema: str = "subroot string, way string") -> DataFrame:
    """The rows, each with what judge gives for its subroot and path: by default just these. Each block is worked out again, under
    the path of its own node: from a broadcast of at most TOP paths, or from a table with a row for each block."""
    spark, size = rows.sparkSession, ARITY**levels
    kept = [*dict.fromkeys(["tree", "at", "n", "leaf", *carried])]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", " + schema
    names = [x.split()[0] for x in schema.split(",")]
    judge = judge or (lambda row, subroot, way: (subroot, way))

    def done(t: pa.Table, subroot: str, above: str) -> pa.Table:
        _, tree, order = _block(t, levels)
        made: list = [None] * t.num_rows
        columns = {c: t.column(c).to_pylist() for c in carried}
        for k, r in enumerate(order):
            made[r] = judge({"leaf": tree[0][k]} | {c: v[r] for c, v in columns.items()}, subroot, joined(path(tree, k), above))
        plain = t.select(kept)
        for i, name in enumerate(names):
            plain = plain.append_column(name, pa.array([m[i] for m in made]))
        return plain

    blocks = rows.select(*kept).withColumn("block", F.floor(F.col("at") / size))
    if isinstance(upper, dict):
        known = spark.sparkContext.broadcast(upper)

        def alone(t: pa.Table) -> pa.Table:
            return done(t, *known.value[t.column("tree")[0].as_py(), t.column("block")[0].as_py()])

        return blocks.groupBy("tree", "block").applyInArrow(alone, out)

    def under(t: pa.Table, u: pa.Table) -> pa.Table:
        return done(t, u.column("subroot")[0].as_py(), u.column("way")[0].as_py())

    return blocks.groupBy("tree", "block").cogroup(upper.withColumnRenamed("at", "block").groupBy("tree", "block")).applyInArrow(under, out)


def manifest(docs: DataFrame, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified of each row."""
    rows = stage(ranked(stage(leaves(docs)), ["doc_id", "leaf"]))
    upper, root = paths(stage(reduced(rows, levels)), levels, top)

    def judge(row: dict, subroot: str, way: str) -> tuple:
        folded = fold(row["tampered"].hex() if row["tampered"] is not None else row["leaf"], way)
        return subroot, proof(way), folded, folded == root

    out = finished(rows, levels, upper, ["doc_id", "tampered"], judge, "subroot string, proof_sha256 string, folded_root string, verified boolean")
    return out.select("doc_id", F.col("tree").alias("lang"), F.lower(F.hex("leaf")).alias("leaf"), "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", "verified")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf, its proof, and whether the tampered table's row still verifies, for every document."""
    return manifest(table(spark, sf_dir, "documents")).drop("lang")


def _sql(levels: int = 7, tops: int = 3) -> str:
    """The same for up to 8^7 rows of a language and 8^3 languages: level after level, each node with what stands left and right of it."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    field = lambda e: f"coalesce(strlen({e}) || ':' || {e}, '-')"
    row = lambda text: "sha256(" + " || ".join(field(text if c == "text" else f"CAST({c} AS VARCHAR)") for c in FIELDS) + ")"
    # crc32 of the decimal doc_id, bit by bit
    crc = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"
    side = lambda part, rows: f"CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (PARTITION BY {part} ORDER BY pos ROWS BETWEEN {rows}), '') END"
    near = lambda part: f"{side(part, 'UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side(part, '1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r"
    out = [f"d AS MATERIALIZED (SELECT doc_id, lang, {row('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(f"translate(text, '{upper}', '{lower}')")} END AS other FROM documents)",
           "n0 AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d)"]
    for k in range(levels):
        out.append(f"s{k} AS MATERIALIZED (SELECT lang, pos, n, h, {near('lang, pos // 8')} FROM {'n0' if k == 0 else f'm{k}'})")
        out.append(f"m{k + 1} AS MATERIALIZED (SELECT lang, pos // 8 AS pos, CASE WHEN any_value(n) > 1 THEN (any_value(n) + 7) // 8 ELSE 1 END AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM s{k} GROUP BY lang, pos // 8)")
    out.append(f"t0 AS MATERIALIZED (SELECT lang, h AS subroot, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM m{levels})")
    for k in range(tops):
        out.append(f"u{k} AS MATERIALIZED (SELECT pos, n, h, {near('pos // 8')} FROM t{k})")
        out.append(f"t{k + 1} AS MATERIALIZED (SELECT pos // 8 AS pos, CASE WHEN any_value(n) > 1 THEN (any_value(n) + 7) // 8 ELSE 1 END AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM u{k} GROUP BY pos // 8)")
    steps = [(f"s{k}", f"s{k}.lang IS NOT DISTINCT FROM n0.lang AND s{k}.pos = n0.pos // {8**k}") for k in range(levels)] + [(f"u{k}", f"u{k}.pos = t0.pos // {8**k}") for k in range(tops)]
    folded = "coalesce(n0.other, n0.leaf)"
    joins = " JOIN t0 ON t0.lang IS NOT DISTINCT FROM n0.lang " + " ".join(f"JOIN {a} ON {on}" for a, on in steps)
    siblings = " || ".join(f"coalesce({a}.l || {a}.r, '')" for a, _ in steps)
    x = f"f0 AS (SELECT n0.doc_id, n0.leaf, t0.subroot, (SELECT h FROM t{tops}) AS root, sha256({siblings}) AS proof_sha256, {folded} AS f, {', '.join(f'{a}.l AS l{i}, {a}.r AS r{i}' for i, (a, _) in enumerate(steps))} FROM n0 {joins})"
    out.append(x)
    for i in range(len(steps)):
        out.append(f"f{i + 1} AS (SELECT * EXCLUDE (f), CASE WHEN l{i} IS NULL THEN f ELSE sha256(l{i} || f || r{i}) END AS f FROM f{i})")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}"


QUERIES = {"op13_merkle": op13_merkle}
ORACLES = {"op13_merkle": _sql()}
