"""Yinyang clustering against full scans, bounds, ties and odd rows."""

import hashlib

import numpy as np
import pytest

from headway.llm import centroids as Y


def brute(rows, k, rounds, salt="2:"):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=object)
    order = sorted(range(len(ids)), key=lambda r: (ids[r] is None, hashlib.sha256(f"{salt}{ids[r]}".encode()).hexdigest() if ids[r] is not None else "", list(x[r])))
    c = [list(x[r]) for r in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for v in x]
        c = [[sum(col) // len(own) for col in zip(*own)] if (own := [v for v, a in zip(x, at) if a == j]) else m for j, m in enumerate(c)]
    return sorted((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in zip(ids, x)), c


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.selectExpr("*", "1 AS cluster", "'x' AS v", "0 AS distance") if extra else df


@pytest.mark.parametrize("seed", [0, 1])
def test_like_a_full_scan(spark, seed):
    g = np.random.default_rng(seed)
    points = np.vstack([g.normal(m, 0.4, (60, 4)) for m in g.normal(0, 1, (6, 4))]).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(1000 + i, points[7].tolist()) for i in range(100)]  # a hot vector
    want, c = brute([(i, [int(np.floor(256 * float(a))) for a in p]) for i, p in rows], 23, 4)
    got, centroids = Y.fit(frame(spark, rows, extra=True).repartition(5), 23, 4, dim=4)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want
    assert centroids.tolist() == c


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 2, 1, 1, 1, 4, 3, 0, 2])]
    want, _ = brute([(i, [int(256 * a) for a in p]) for i, p in rows], 4, 3)
    got, _ = Y.fit(frame(spark, rows), 4, 3, dim=2, group=1)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [3.0, 4.0]), (3, None), (4, [1.0]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 0.0]), (8, []), (9, [3e38, -3e38]), (10, [-0.001, 0.0])]
    kept = [(1, [0, 256]), (1, [0, 256]), (None, [768, 1024]), (9, [Y.CUT, -Y.CUT]), (10, [-1, 0])]
    for k in (2, 5, 40):
        got, c = Y.fit(frame(spark, rows), k, 3, dim=2)
        want, means = brute(kept, k, 3)
        assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.collect()) == want
        assert c.tolist() == means
    empty, c = Y.fit(frame(spark, rows).limit(0), 3, 2, dim=2)
    assert empty.count() == 0 and len(c) == 0


def test_bounds_save_distances():
    g = np.random.default_rng(5)
    x = np.vstack([g.normal(m, 20, (200, 8)) for m in g.normal(0, 900, (20, 8))]).astype(np.int64)
    c = x[g.choice(len(x), 40, replace=False)]
    groups = Y.grouped(c, 4)
    assert sorted(np.concatenate(groups).tolist()) == list(range(40))
    state, moved, done = (np.full(len(x), -1), np.zeros(len(x)), np.zeros((len(x), len(groups)))), np.zeros(40), []
    for _ in range(6):
        cluster, upper, lower, n = Y.Pass(c, moved, groups).judge(x, *state)
        assert (cluster == Y.distances(x, c).argmin(1)).all()
        done.append(n)
        new = np.array([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(40)])
        moved, c, state = np.sqrt(Y.own(new, c)) * (1 + Y.PART) + Y.STEP, new, (cluster, upper, lower)
    assert done[0] == x.shape[0] * 40 and sum(done[1:]) < 0.5 * 5 * done[0]


def test_large_components_are_exact():
    g = np.random.default_rng(2)
    x, c = g.integers(-Y.CUT, Y.CUT, (30, 64)), g.integers(-Y.CUT, Y.CUT, (5, 64))
    assert Y.distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, m)) for m in c] for r in x]
