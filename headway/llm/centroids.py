"""Centroid clustering over integers, with Yinyang bounds.

Centroids are put into groups once. Each vector keeps the distance to its centroid (an upper bound) and one lower bound
for each group, the distance to the nearest other centroid there. Both are moved by what centroids moved. A vector whose
upper bound is below all its lower bounds keeps its cluster unseen; else its distance is worked out and only groups that
the bound lets through are scanned, exactly. Bounds are widened by far more than a double's rounding, and equal bounds are
scanned, so that clusters, ties included, are those of a full scan.

What Spark does: a pass maps the staged vectors with their bounds to the next staged table; sums of the vectors that changed
their cluster are added up in each task, then by Spark for each (cluster, component). The driver sees k centroids, their
sums and counts: k * (dim + 1) numbers, whatever the rows.

Defined cases: a vector that is null, has another length, or a component that is null, infinite or no number isn't kept.
Components beyond 2^27 either way (about 524,288 before scaling) count as 2^27, so that a distance fits a long. A null
vec_id is kept, but comes last among the starts; equal hashes go by components. Repeated rows are rows like others. With fewer vectors
than k there are as many centroids as vectors; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import files
from headway.llm.common import stage, table

#: Components are cut here, so that 64 squared differences fit a long; below EXACT doubles hold all sums of products.
CUT, EXACT = 1 << 27, 1 << 22
#: How far bounds are widened, in parts and in distance: rounding of a double is below a thousandth of it.
PART, STEP = 1e-12, 1e-6
STATE = "vec_id long, v array<long>, cluster int, was int, upper double, lower array<double>"


def kept(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component of the vectors that are whole."""
    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole_numbers = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(float(-CUT))), F.lit(float(CUT)))))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers.alias("v"))


def starts(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least sha256 of salt and decimal vec_id: Spark's top k, so many rows in the driver."""
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in rows.orderBy(by.asc_nulls_last(), "v").select("v").limit(k).collect()], dtype=np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        gap = x - c[j]
        out[:, j] = (gap * gap).sum(1)
    return out


def own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows of the same place."""
    gap = x - c
    return (gap * gap).sum(1)


def grouped(c: np.ndarray, n: int, rounds: int = 5) -> list[np.ndarray]:
    """Numbers of the centroids of each group: far-apart seeds, then a few rounds of means. Only k centroids take part."""
    seeds = [0]
    while len(seeds) < min(n, len(c)):
        seeds.append(int(distances(c, c[seeds]).min(1).argmax()))
    means = c[seeds].astype(np.float64)
    for _ in range(rounds):
        near = ((c[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([c[near == g].mean(0) if (near == g).any() else means[g] for g in range(len(means))])
    return [m for g in range(len(means)) if len(m := np.flatnonzero(near == g))]


@dataclass
class Pass:
    """What a pass over the vectors needs: centroids, how far each moved since the last pass, and the groups."""

    centroids: np.ndarray
    moved: np.ndarray
    groups: list[np.ndarray]

    def judge(self, x: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Clusters, upper and lower bounds after this pass, and the number of distances that were worked out. was: -1 if none yet."""
        new = was < 0
        seat = np.where(new, 0, was)
        upper = np.where(new, np.inf, (upper + self.moved[seat]) * (1 + PART) + STEP)
        fall = np.array([self.moved[g].max() for g in self.groups])
        lower = np.where(new[:, None], -np.inf, (lower - fall) * (1 - PART * np.sign(lower - fall)) - STEP)
        ask = np.flatnonzero(new | (lower.min(1) <= upper))
        cluster, done = was.copy(), 0
        if not len(ask):
            return cluster, upper, lower, done
        xs, fresh, first = x[ask], new[ask], seat[ask]
        before = np.where(fresh, np.iinfo(np.int64).max, own(xs, self.centroids[first]))
        best, at = before.copy(), np.where(fresh, len(self.centroids), first)
        done += int((~fresh).sum())
        low, scans = lower[ask], []
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(fresh | (low[:, g] <= np.sqrt(best.astype(np.float64)) * (1 + PART) + STEP))
            if not len(rows):
                continue
            d = distances(xs[rows], self.centroids[members])
            done += d.size
            nearest = d.argmin(1)
            least = d[np.arange(len(rows)), nearest]
            d[np.arange(len(rows)), nearest] = np.iinfo(np.int64).max
            scans.append((g, rows, members[nearest], least, d.min(1)))
            better = (least < best[rows]) | ((least == best[rows]) & (members[nearest] < at[rows]))
            best[rows[better]], at[rows[better]] = least[better], members[nearest][better]
        # the centroid that a vector left counts for its group, if that one was not scanned
        for g, members in enumerate(self.groups):
            left = ~fresh & (at != first) & np.isin(first, members)
            low[left, g] = np.minimum(low[left, g], np.sqrt(before[left].astype(np.float64)) * (1 - PART) - STEP)
        for g, rows, nearest, least, second in scans:
            low[rows, g] = np.sqrt(np.where(nearest == at[rows], second, least).astype(np.float64)) * (1 - PART) - STEP
        cluster[ask], upper[ask], lower[ask] = at, np.sqrt(best.astype(np.float64)) * (1 + PART) + STEP, low
        return cluster, upper, lower, done


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], a.ravel())


def moves(rows: DataFrame, at: Pass) -> DataFrame:
    """The rows after one pass: new cluster, the one before in `was`, and the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                was = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                cluster, upper, lower, _ = at.judge(_matrix(b.column("v"), np.int64), was, b.column("upper").to_numpy(), _matrix(b.column("lower"), np.float64))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), _lists(lower)], ["vec_id", "v", "cluster", "was", "upper", "lower"])

    return rows.mapInArrow(run, STATE)


def changes(rows: DataFrame, k: int, dim: int) -> np.ndarray:
    """k rows of what clusters gained less what they lost, the count last: summed in each task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for b in batches:
            one = np.hstack([_matrix(b.column("v"), np.int64), np.ones((b.num_rows, 1), np.int64)]) if b.num_rows else np.zeros((0, dim + 1), np.int64)
            for name, sign in (("cluster", 1), ("was", -1)):
                c = b.column(name).to_numpy(zero_copy_only=False)
                np.add.at(total, c[c >= 0], sign * one[c >= 0])
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), _lists(total[some])], ["cluster", "total"])

    parts = rows.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, total array<long>")
    out = np.zeros((k, dim + 1), np.int64)
    for r in parts.select("cluster", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect():
        out[r.cluster, r.i] = r.x
    return out


def fit(vectors: DataFrame, k: int, rounds: int, dim: int = 64, scale: int = 256, salt: str = "2:", group: int = 10) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v, cluster, distance of each kept vector after so many rounds and a last assignment, and the centroids."""
    rows = stage(kept(vectors, dim, scale))
    c = starts(rows, k, salt)
    if not len(c):
        return rows.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dim), np.int64)
    groups = grouped(c, max(1, len(c) // group))
    sums, moved, old = np.zeros((len(c), dim + 1), np.int64), np.zeros(len(c)), rows
    state = rows.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(0.0).alias("upper"), F.array(*[F.lit(0.0)] * len(groups)).alias("lower"))
    for _ in range(rounds):
        state = stage(moves(state, Pass(c, moved, groups)))
        drop(old)
        old = state
        sums += changes(state, len(c), dim)
        full = sums[:, -1] > 0
        new = np.where(full[:, None], sums[:, :-1] // np.maximum(sums[:, -1:], 1), c)
        moved, c = np.sqrt(own(new, c).astype(np.float64)) * (1 + PART) + STEP, new
    last, centroids = Pass(c, moved, groups), c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), np.int64)
                cluster = last.judge(x, b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy(), _matrix(b.column("lower"), np.float64))[0]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(own(x, centroids[cluster]))], ["vec_id", "v", "cluster", "distance"])

    out = stage(state.mapInArrow(run, "vec_id long, v array<long>, cluster int, distance long"))
    drop(old)
    return out, c


def drop(staged: DataFrame) -> None:
    """Delete a staged table that no later job reads."""
    if found := staged.inputFiles():
        files.remove(found[0].rpartition("/")[0])


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector of embeddings with its cluster of 40 after five rounds."""
    rows, c = fit(table(spark, sf_dir, "embeddings"), 40, 5)
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(k, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for k, row in enumerate(c.tolist())]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # k rows at most on the small side
    each = inertia.crossJoin(F.broadcast(inertia.agg(F.sum("cluster_inertia").alias("inertia")))).join(F.broadcast(names), "cluster")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """The same by a full scan of all centroids in each round; sums are exact, and floors of negatives too."""
    near = lambda c, v: f"list_sum(list_transform(list_zip({v}, {c}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    out = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM kept ORDER BY sha256('2:' || vec_id), v LIMIT {k})"]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min({{'d': {near('c.v', 'k.v')}, 'c': c.c}}) AS m FROM kept k, c{n} c GROUP BY r)")
        if n < rounds:
            out.append(f"""c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(s.v, c{n}.v) AS v FROM c{n} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM
                (SELECT m.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, {dim + 1}) t(i) GROUP BY 1, 2) GROUP BY c) s ON s.c = c{n}.c)""")  # fmt: skip
    return f"""WITH {', '.join(out)} SELECT vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.c = m.c"""


QUERIES = {"op11_yinyang": op11_yinyang}
ORACLES = {"op11_yinyang": _sql()}
