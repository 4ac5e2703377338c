"""What larger tables need: small tables are broadcast by their size in a file, of which keys that follow each other take next to nothing."""

from headway import catalog
from headway.operators import relational as R, tracker as T
from headway.plans.engine import _trailing_miss

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(catalog.QUERIES["j_first_misses"](spark, SF))


def test_city_miss_broadcasts_no_passings(spark):
    assert "BroadcastHashJoin" not in plan(catalog.QUERIES["a_city_miss"](spark, SF))


def test_departures_broadcast_no_trips(spark):
    assert "BroadcastHashJoin" not in plan(catalog.QUERIES["r_departures"](spark, SF))


def test_newest_rows_are_joined_to_nothing(spark):
    """What a bucket inherits comes by rows, so that no array of many rows goes through a join or a shuffle."""
    asks, events = spark.range(3).selectExpr("id AS ask", "'a' AS key", "id * 1.5D AS now"), spark.range(9).selectExpr("'a' AS key", "id / 4D AS t", "id AS e")
    got = R.newest_before(asks, events, ["key"], "now", "t", ["e"], 4, 1.0)
    assert "Join" not in plan(got)
    assert {r.ask: [g.e for g in r.got] for r in got.collect()} == {0: [0], 1: [3, 4, 5, 6], 2: [5, 6, 7, 8]}


def test_vehicles_are_folded_once(spark):
    """Runs are numbered through from the fold's own rows, not from a second fold."""
    schema = "veh long, fix long, trip long, ts double, x double, y double, speed double, odometer double"
    line = spark.sql("SELECT 1L AS trip, array(named_struct('x', 0D, 'y', 0D, 'cum', 0D), named_struct('x', 1000D, 'y', 0D, 'cum', 1000D)) AS line")
    fixes = spark.createDataFrame([(5, k, 1, t, 8.0 * k, 0.0, 8.0, None) for k, t in enumerate((0.0, 1.0, 2.0, 900.0, 901.0))], schema)
    got = T.track(fixes, line)
    assert plan(got).count("InArrow") == 1
    assert [r.run for r in got.orderBy("ts").collect()] == [1, 1, 1, 2, 2]


def test_short_searches_equal_long_ones():
    line = T.Line([{"x": 100.0 * k, "y": 30.0 * (k % 3), "cum": 110.0 * k} for k in range(12)])
    places = [(37.0 * k, 11.0 * k % 70 - 20) for k in range(35)]
    short = [line.nearest(x, y) for x, y in places]
    line.SHORT = 0
    assert short == [line.nearest(x, y) for x, y in places]


def test_timetable_broadcasts_nothing(spark):
    assert "BroadcastHashJoin" not in plan(catalog.QUERIES["a_prior"](spark, SF))


def test_places_are_looked_up_once(spark):
    """A thousand points and others of two places make few pairs, not a million; of others at one place the least wins."""
    points = spark.range(1000).selectExpr("id AS fix", "id % 2 * 50D AS x", "0D AS y")
    others = spark.range(1000).selectExpr("id + 7 AS stop", "id % 2 * 50D AS x", "1D AS y")
    got = R.nearest(points, others, "fix", "stop", 400.0, 400.0)
    assert {(r.stop, r.metres) for r in got.collect()} == {(7, 1.0), (8, 1.0)} and got.count() == 1000
    most = max(made(got))
    assert most < 20000


def made(df):
    """Rows that each step of a query made."""
    rows, open_ = [], [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while open_:
        p = open_.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            open_.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            open_.append(p.plan())
        if p.metrics().contains("numOutputRows"):
            rows.append(p.metrics().apply("numOutputRows").value())
        open_ += [p.children().apply(k) for k in range(p.children().size())]
    return rows


def test_trailing_miss_makes_no_pairs(spark):
    """The median of the trailing day, both ends included and those of the same second too, without a join of fixes with fixes."""
    day = 86400
    rows = [(0, 1, 5, 0.4), (1, 1, 5, 0.1), (2, 1, 5 + day, 0.9), (3, 1, 6 + day, 0.3), (4, 1, 7 + 3 * day, None), (5, 2, 6, 0.7)]
    got = _trailing_miss(spark.createDataFrame(rows, "fix long, trip long, veh_ts long, ratio double"))
    assert "Join" not in plan(got)
    assert {r.fix: (r.n, r.miss) for r in got.collect()} == {0: (2, 0.25), 1: (2, 0.25), 2: (3, 0.4), 3: (2, 0.6), 4: (1, None), 5: (1, 0.7)}


def test_chains_are_not_sorted(spark):
    """Pairs of trips come out of the join as they are; windows are over trips."""
    text = plan(catalog.QUERIES["j_chain"](spark, SF))
    assert text.index("Join") < text.index("Window")


def test_forecasts_meet_trips_by_a_merge_join(spark, monkeypatch):
    from headway.plans import layovers

    plans, stage = [], layovers.stage
    monkeypatch.setattr(layovers, "stage", lambda df: plans.append(plan(df)) or stage(df))
    catalog.QUERIES["m_arrivals"](spark, SF)
    assert plans and "BroadcastHashJoin" not in plans[0]
