"""Queries of the transit library over their whole job."""

import pytest
from pyspark.sql import functions as F

from headway import catalog
from headway.operators import relational as R
from headway.streaming import fixes as streamed

SF = "/root/testdata/sf0.001"


def test_stream_has_every_window(spark):
    """The stream's windows are those of the batch aggregation, with the newest."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.start, r.event_type): (r.n, r.v) for r in streamed.epochs(events, 3600).collect()}
    got = {(r.start, r.event_type): (r.n, r.v) for r in streamed.r_stream_epochs(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and got[k][1] == pytest.approx(v) for k, (n, v) in want.items())


def test_trailing_miss_of_every_fix(spark):
    got = [r.fix for r in catalog.QUERIES["a_trailing_miss"](spark, SF).collect()]
    assert sorted(got) == sorted(r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").collect())


def test_components_of_all_orders(spark):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in spark.read.parquet(f"{SF}/orders.parquet").where("o_custkey IS NOT NULL").collect():
        a, b = sorted((find(r.o_custkey), find(1000000 + r.o_orderkey % 211)))
        root[b] = a
    assert {r.node: r.root for r in catalog.QUERIES["g_components"](spark, SF).collect()} == {x: find(x) for x in root}


def test_next_departure_at_all_stops(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.stop for r in catalog.QUERIES["j_next_departure"](spark, sf).collect()}
    assert got == {r.s_suppkey for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}


def test_services_without_a_calendar_row(spark):
    """They run by exceptions only, unless there are neither calendars nor exceptions at all."""
    trips = spark.sql("SELECT * FROM VALUES (1, 'known', DATE '2024-01-01'), (2, 'unknown', DATE '2024-01-01'), (3, 'added', DATE '2024-01-01'), (4, 'known', DATE '2024-01-06') AS t(trip, service, day)")
    calendar = spark.sql("SELECT 'known' AS service, DATE '2023-01-01' AS start, DATE '2024-12-31' AS `end`, array(0, 1, 2, 3, 4) AS weekdays")
    exceptions = spark.sql("SELECT 'added' AS service, DATE '2024-01-01' AS day, true AS added")
    run = lambda c, x: sorted(r.trip for r in R.runs_on(trips, c, x).collect())
    assert run(calendar, exceptions) == [1, 3]
    assert run(calendar.limit(0), exceptions) == [3]
    assert run(calendar.limit(0), exceptions.limit(0)) == [1, 2, 3, 4]


def test_route_confidence(spark):
    """A seen route is live even with few trips due; an unseen one with two due is quiet, with fewer it goes by the schedule."""
    from headway.plans.service import route_confidence

    rows = spark.createDataFrame([(1, 0), (3, 9), (0, 2), (0, 1), (0, 0)], "seen int, due int").select(route_confidence(F.col("seen"), F.col("due")).alias("c")).collect()
    assert [r.c for r in rows] == ["live", "live", "quiet", "schedule", "schedule"]


def test_house_numbers_are_no_names(spark):
    from headway.plans.service import named

    words = ["7а", "12/2б", "7", "7A", "12/2", "7аб", "Зелена 7", "7 а", "/2", "x7", "12/"]
    got = [r.n for r in spark.createDataFrame([(w,) for w in words], "w string").select(named(F.col("w")).alias("n")).collect()]
    assert got == [False] * 5 + [True] * 6


def test_trips_chain_to_the_horizon(spark):
    from headway.plans.service import chained

    trips = spark.createDataFrame([(k, 1, 100 * k) for k in range(12)] + [(50, 2, 0), (51, 2, 0), (52, 2, 2700), (53, 2, 2701)], "trip long, block long, dep long")
    running = spark.createDataFrame([(9, True)], "trip long, elsewhere boolean")
    got = {}
    for r in chained(trips, running, 2700).collect():
        got.setdefault(r.trip, []).append((r.k, r.later))
    got = {t: sorted(v) for t, v in got.items()}
    assert got[0] == [(k, k) for k in range(1, 9)]  # trip 9 already runs elsewhere
    assert got[9] == [(1, 10), (2, 11)] and 8 not in got
    assert got[50] == [(1, 51), (2, 52)] and got[51] == [(1, 52)] and got[52] == [(1, 53)]


def test_skipped_stops(spark):
    listed = spark.createDataFrame([("p", i, s) for i, s in enumerate("abcdef")] + [("q", i, s) for i, s in enumerate("abc")], "pattern string, i int, stop string")
    served = [("p", s, t, d) for s in "bde" for t in range(20) for d in range(2)] + [("p", "d", 0, 0), ("p", "c", 1, 1), ("p", "c", 1, 1), ("q", "b", 1, 1), ("p", "zz", 1, 1)]
    got = [tuple(r) for r in R.skipped(listed, spark.createDataFrame(served, "pattern string, stop string, trip int, day int")).collect()]
    assert got == [("p", "c", 1, 40.0, 0.025)]
    nobody = [r for r in served if r[1] != "c"]
    got = [tuple(r) for r in R.skipped(listed, spark.createDataFrame(nobody, "pattern string, stop string, trip int, day int")).collect()]
    assert got == [("p", "c", 0, 40.0, 0.0)]  # a stop that no trip served
