"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a line of over a hundred characters is cut behind sentences. The set of a text's
64-bit paragraph digests fills a sketch: each digest belongs to a group and to one cell in each of three
rows of four there; a cell holds a count, the digests XORed and their checks XORed. Sketches of two
versions subtract cell by cell. Peeling takes a cell with one digest, removes that digest from its other
cells, and so on, until the digests that differ are all found; groups where that fails are tried again
larger, with other cells. The count of differing digests gives the Jaccard likeness exactly.

The fingerprint is the number of digests and the sketch of two groups (counts of four bytes, digests and checks
of eight), in base64. Two fingerprints subtract and peel if few digests differ; where that fails, larger sketches
are made from the texts' digests, which the fingerprints don't have. All of it is DataFrame operations. A null text
is empty; two texts without paragraphs have likeness 1. Rows are taken in order of doc_id (null first), rows that
repeat a doc_id in order of their texts; each gives a row. Other columns are ignored, an empty table gives
no rows, and very long texts are taken whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.llm.common import parts, stage, table, texts

PARAGRAPH = r"[^\n]{100,}?[.!?](?=\s)|[^\n]+"
ROWS, COLUMNS, GROUPS, LOAD, STEPS = 3, 4, 2, 4, 8
NULL_ID = -(2**63)


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda x: F.xxhash64(x)))


def _cell(h: Column, row: int) -> Column:
    return F.shiftrightunsigned(h, 8 * row).bitwiseAND(F.lit(COLUMNS - 1))


def group_of(digest: Column, groups: Column) -> Column:
    return F.shiftrightunsigned(digest, 20).bitwiseAND(groups.cast("long") - 1)


def sketch(rows: DataFrame, by: list[str], level: int) -> DataFrame:
    """rows: by, g, digest, one for each digest. Returns by, g, cells."""
    rows = rows.withColumns({"h": F.xxhash64("digest", F.lit(level)), "check": F.xxhash64("digest", F.lit(-1))})
    aggs = []
    for r in range(ROWS):
        for c in range(COLUMNS):
            own = _cell(F.col("h"), r) == c
            aggs += [F.count_if(own).alias(f"n{r}{c}"), F.bit_xor(F.when(own, F.col("digest")).otherwise(0)).alias(f"k{r}{c}"), F.bit_xor(F.when(own, F.col("check")).otherwise(0)).alias(f"c{r}{c}")]
    cells = F.array(*(F.struct(F.col(f"n{r}{c}").alias("n"), F.col(f"k{r}{c}").alias("k"), F.col(f"c{r}{c}").alias("c")) for r in range(ROWS) for c in range(COLUMNS)))
    return rows.groupBy(*by, "g").agg(*aggs).select(*by, "g", cells.alias("cells"))


_EMPTY = f"array_repeat(named_struct('n', 0L, 'k', 0L, 'c', 0L), {ROWS * COLUMNS})"


def subtracted(a: str, b: str) -> Column:
    return F.expr(f"zip_with(coalesce({a}, {_EMPTY}), coalesce({b}, {_EMPTY}), (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))")


def peeled(cells: str, level: int) -> Column:
    """struct of d, the digests found, and ok: nothing is left."""
    pure = "abs(c.n) = 1 and c.c = xxhash64(c.k, -1)"
    gone = f"(shiftrightunsigned(xxhash64(x.k, {level}), 8 * cast(j div {COLUMNS} as int)) & {COLUMNS - 1}) = j % {COLUMNS}"
    step = (
        f"transform(array(get(filter(acc.cells, c -> {pure}), 0)), x -> if(x is null, acc, named_struct('cells', "
        f"transform(acc.cells, (c, j) -> if({gone}, named_struct('n', c.n - x.n, 'k', c.k ^ x.k, 'c', c.c ^ x.c), c)), 'd', acc.d + 1)))[0]"
    )
    return F.expr(
        f"aggregate(sequence(1, {STEPS}), named_struct('cells', {cells}, 'd', 0), (acc, i) -> {step}, "
        f"acc -> named_struct('d', acc.d, 'ok', forall(acc.cells, c -> c.n = 0 and c.k = 0 and c.c = 0)))"
    )


def _place(x: str, cuts: list[int]) -> Column:
    """How many of the sorted cuts aren't larger than x, by bisection."""
    if not cuts:
        return F.lit(0)
    mid = "cast((s.lo + s.hi) div 2 as int)"
    found = (
        f"aggregate(sequence(1, {len(cuts).bit_length()}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> if(s.lo >= s.hi, s, if(get(cuts, {mid}) <= {x}, "
        f"named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid}))), s -> s.lo)"
    )
    said = ", ".join(f"{c}L" if c > NULL_ID else "cast(-9223372036854775808 as bigint)" for c in cuts)
    return F.expr(f"transform(array(array({said})), cuts -> {found})[0]")


def _ranges(docs: DataFrame) -> DataFrame:
    """docs with at and sub, in whose order ranges of (doc_id, text) follow one another. A doc_id (or none) with a large share of the rows is split by its texts' first bytes."""
    n = parts(docs.sparkSession)
    quantiles = lambda x, k: F.percentile_approx(x, [i / k for i in range(1, k)] or [0.5], 20 * k + 1000)
    q = docs.agg(quantiles("doc_id", n).alias("q"), F.count_if(F.col("doc_id").isNull()).alias("none"), F.count(F.lit(1)).alias("rows")).first()
    times = Counter(q.q or [])
    cuts = sorted(times)
    docs = docs.withColumn("at", F.when(F.col("doc_id").isNull(), -1).otherwise(_place("doc_id", cuts))).withColumn("sub", F.lit(0))
    # fewer than n, as each stands for a share of 1/n or more
    many = {c: k for c, k in times.items() if k > 1} | ({None: -(-n * q.none // q.rows)} if n * q.none > q.rows else {})
    if many:
        docs = docs.withColumn("first", F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long"))
        own = {c: F.col("doc_id").isNull() if c is None else F.col("doc_id") == c for c in many}
        found = docs.agg(*(quantiles(F.when(own[c], F.col("first")), k).alias(str(c)) for c, k in many.items())).first()
        sub = F.lit(0)
        for c in many:
            own_cuts = sorted(set(found[str(c)] or []))
            # those of the range that have larger ids follow
            behind = F.lit(False) if c is None else (F.col("at") == bisect_right(cuts, c)) & (F.col("doc_id") > c)
            sub = F.when(own[c], _place("first", own_cuts)).when(behind, len(own_cuts) + 1).otherwise(sub)
        docs = docs.withColumn("sub", sub).drop("first")
    return docs


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next, the text of the next document (after the last the first), by one shuffle of the texts."""
    rows = _ranges(docs)
    # the range that follows each range, the first one after the last: a few numbers for each partition
    alone = Window.orderBy("at", "sub")
    whole = alone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    this = F.struct("at", "sub")
    after = rows.select("at", "sub").distinct().select("at", "sub", F.coalesce(F.lead(this).over(alone), F.first(this).over(whole)).alias("after"))
    w = Window.partitionBy("at", "sub").orderBy("doc_id", "text")
    dealt = rows.repartition(parts(docs.sparkSession), "at", "sub").select("*", F.lead("text").over(w).alias("lead"), F.row_number().over(w).alias("place"))
    firsts = dealt.where("place = 1").select(this.alias("after"), F.col("text").alias("first")).join(after, "after").select("at", "sub", "first")
    return dealt.join(firsts, ["at", "sub"], "left").select("doc_id", "text", F.coalesce("lead", "first").alias("next"))


def edited(docs: DataFrame) -> DataFrame:
    """Each document with its edited text: the last half replaced by as much of the next document."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half))
    return rows.withColumn("edited", text)


def _exploded(pairs: DataFrame, sides: dict[str, str], groups: Column, kept: list[str]) -> DataFrame:
    both = F.concat(*(F.expr(f"transform({c}, x -> named_struct('side', '{s}', 'digest', x))") for s, c in sides.items()))
    rows = pairs.select(*kept, groups.alias("groups"), F.explode(both).alias("x")).select(*kept, "groups", "x.side", "x.digest")
    return rows.withColumn("g", group_of(F.col("digest"), F.col("groups")))


def _sided(sketches: DataFrame, by: list[str], sides: str) -> DataFrame:
    return sketches.groupBy(*by, "g").agg(*(F.first(F.when(F.col("side") == s, F.col("cells")), ignorenulls=True).alias(s) for s in sides))


def _text(n: str, side: str) -> Column:
    """A sketch in base64, from its groups' cells in order."""
    cell = "concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c), 16, '0'))"
    groups = F.expr(f"array_join(transform(flatten(transform(array_sort(collect_list(named_struct('g', g, 'cells', coalesce({side}, {_EMPTY})))), y -> y.cells)), c -> {cell}), '')")
    return F.base64(F.unhex(F.concat(F.lpad(F.hex(F.first(n)), 8, "0"), groups)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edited(docs).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), digests(F.col("next")).alias("b"),
    )
    rows = stage(rows.withColumn("id", F.monotonically_increasing_id()))
    by = ["id", *(f"n_{s}" for s in "aeb")]
    rows = rows.withColumns({f"n_{s}": F.size(s) for s in "aeb"}).repartition(parts(docs.sparkSession), "id")
    # every document has a group, even without paragraphs
    full = _sided(sketch(_exploded(rows, {"a": "a", "e": "e", "b": "b"}, F.lit(GROUPS), by), [*by, "side"], 0), by, "aeb")
    full = full.unionByName(rows.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long"))).alias("g")), allowMissingColumns=True)
    full = full.groupBy(*by, "g").agg(*(F.first(s, ignorenulls=True).alias(s) for s in "aeb"))
    first = full.withColumns({"x": subtracted("a", "e"), "y": subtracted("a", "b")}).withColumns({"x": peeled("x", 0), "y": peeled("y", 0)})
    head = first.groupBy(*by).agg(
        _text("n_a", "a").alias("fingerprint"), _text("n_e", "e").alias("edited_fingerprint"),
        F.sum("x.d").alias("d_e"), F.sum("y.d").alias("d_b"), F.collect_list(F.when(~F.col("x.ok"), F.col("g"))).alias("bad_e"), F.collect_list(F.when(~F.col("y.ok"), F.col("g"))).alias("bad_b"),
        F.sum(F.when(F.col("x.ok"), F.col("x.d")).otherwise(0)).alias("done_e"), F.sum(F.when(F.col("y.ok"), F.col("y.d")).otherwise(0)).alias("done_b"),
    )
    head = stage(head)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"done_{k}").cast("long").alias("d"), F.col(f"bad_{k}").alias("bad")) for k in "eb"))
    state = head.select("id", F.explode(kinds).alias("s")).select("id", "s.*").withColumn("size", F.lit(GROUPS).cast("long"))
    found = [state.select("id", "kind", "d")]
    own = rows.select("id", "a", F.explode(F.array(F.struct(F.lit("e").alias("kind"), F.col("e").alias("o")), F.struct(F.lit("b").alias("kind"), F.col("b").alias("o")))).alias("s")).select("id", "a", "s.kind", "s.o")
    # sizes double and cells are dealt anew, until nothing fails
    for level in count(1):
        failed = state.where(F.size("bad") > 0).select("id", "kind", "bad", F.col("size").alias("old"))
        pairs = failed.join(own, ["id", "kind"])
        for c in ("a", "o"):  # digests of groups that failed
            pairs = pairs.withColumn(c, F.expr(f"filter({c}, z -> array_contains(bad, shiftrightunsigned(z, 20) & (old - 1)))"))
        wanted = F.pow(F.lit(2.0), F.ceil(F.log2((F.size("a") + F.size("o")) / F.lit(float(LOAD)) + 1))).cast("long")
        sizes = F.greatest(F.col("old") * 2, wanted * F.ceil(F.col("old") / F.greatest(F.size("bad"), F.lit(1)))) if level == 1 else F.col("old") * 2
        exploded = _exploded(pairs.withColumn("size", F.least(sizes, F.lit(2**30))), {"a": "a", "b": "o"}, F.col("size"), ["id", "kind"])
        sides = _sided(sketch(exploded.withColumn("size", F.col("groups")), ["id", "kind", "size", "side"], level), ["id", "kind", "size"], "ab")
        out = sides.withColumn("x", subtracted("a", "b")).withColumn("x", peeled("x", level))
        state = stage(out.groupBy("id", "kind", "size").agg(F.sum(F.when(F.col("x.ok"), F.col("x.d")).otherwise(0)).cast("long").alias("d"), F.collect_list(F.when(~F.col("x.ok"), F.col("g"))).alias("bad")))
        found.append(state.select("id", "kind", "d"))
        if state.where(F.size("bad") > 0).isEmpty():
            break
    total = found[0]
    for x in found[1:]:
        total = total.unionByName(x)
    total = total.groupBy("id").agg(*(F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(f"d_{k}") for k in "eb"))

    def near(k: str) -> Column:
        n, d = F.col("n_a") + F.col(f"n_{k}"), F.col(f"d_{k}")
        return F.when(n == 0, 1.0).otherwise((n - d) / (n + d))

    head = head.select("id", "n_a", "n_e", "n_b", "fingerprint", "edited_fingerprint").join(total, "id").select("id", "fingerprint", "edited_fingerprint", near("e").alias("near_edited"), near("b").alias("near_next"))
    return rows.select("id", "doc_id", "n_chars", "edited_sha256").join(head, "id").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(texts(table(spark, sf_dir, "documents")))


QUERIES = {"op3_paragraph_sketch": op3_paragraph_sketch}
ORACLES: dict[str, str] = {}
