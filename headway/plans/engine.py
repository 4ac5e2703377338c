"""Queries of the engine over the star-schema tables, each with SQL that an oracle runs."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.functions import scalar as S
from headway.operators import graph, relational as R
from headway.sources.tables import relation, sql

QUERIES, ORACLES = {}, {}
#: Half-lives and clips of the travel-time model, seconds and ratios.
TAU, K, HORIZON = 5400 / 0.6931471805599453, 4.0, 2700


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


@query(sql("fixes") + " SELECT fix, round((lon - 24.03) * 111320.0 * cos(radians(49.84)), 3) AS x, round((lat - 49.84) * 111320.0, 3) AS y FROM fixes")
def p_projection(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "fixes").select("fix", F.round(S.to_x(F.col("lon")), 3).alias("x"), F.round(S.to_y(F.col("lat")), 3).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) * 3600 + l_linenumber * 60 + l_suppkey % 60 AS secs,
 ((CAST(l_quantity AS BIGINT) * 3600 + 43200) % 86400) - 43200 AS late FROM lineitem""")
def p_service_time(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = F.format_string("%02d:%02d:%02d", F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_suppkey") % 60)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", S.hms(text).cast("long").alias("secs"), S.lateness(F.col("l_quantity").cast("long") * 3600).alias("late"))


@query("""SELECT c_custkey, s, CASE WHEN starts_with(s, 'Тр') THEN 'trolleybus' WHEN starts_with(s, 'Т') THEN 'tram' ELSE 'bus' END AS kind,
 coalesce(CAST(nullif(regexp_replace(s, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS number FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Тр' WHEN 1 THEN 'Т' ELSE 'А' END || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey % 60 AS VARCHAR) END AS s FROM customer)""")
def p_vehicle_type(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    s = F.concat(F.when(c % 3 == 0, "Тр").when(c % 3 == 1, "Т").otherwise("А"), F.when(c % 7 == 0, "").otherwise((c % 60).cast("string")))
    df = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", s.alias("s"))
    return df.select("c_custkey", "s", S.vehicle_type(F.col("s")).alias("kind"), S.natural(F.col("s"))[0].alias("number"))


@query(sql("fixes", "trips") + " SELECT f.fix, f.veh, f.trip FROM fixes f WHERE poll_ts - veh_ts BETWEEN -60 AND 300 AND EXISTS (SELECT 1 FROM trips t WHERE t.trip = f.trip)")
def f_admissible(spark: SparkSession, sf: str) -> DataFrame:
    f = relation(spark, sf, "fixes").where("poll_ts - veh_ts BETWEEN -60 AND 300")
    return f.join(relation(spark, sf, "trips"), "trip", "left_semi").select("fix", "veh", "trip")


@query(sql("fixes") + " SELECT fix, CASE WHEN speed < 0.5 THEN 1 ELSE 0 END + CASE WHEN poll_ts - veh_ts > 120 THEN 2 ELSE 0 END + CASE WHEN kind = 'error' THEN 4 ELSE 0 END AS flags FROM fixes")
def f_flags(spark: SparkSession, sf: str) -> DataFrame:
    f = relation(spark, sf, "fixes")
    return f.select("fix", S.flags(F.col("speed") < 0.5, F.col("poll_ts") - F.col("veh_ts") > 120, F.col("kind") == "error").alias("flags"))


_CALENDAR = "(SELECT DISTINCT service, DATE '1993-01-01' AS start, DATE '1997-06-30' AS \"end\" FROM trips WHERE service NOT LIKE '5%')"


@query(sql("trips") + f""", x AS (SELECT DISTINCT service, day, trip % 2 = 0 AS added FROM (SELECT service, day, min(trip) AS trip FROM trips WHERE trip % 11 = 0 GROUP BY 1, 2))
 SELECT t.trip, t.service, t.day FROM trips t LEFT JOIN {_CALENDAR} c ON c.service = t.service LEFT JOIN x ON x.service = t.service AND x.day = t.day
 WHERE coalesce(x.added, isodow(t.day) <= 5 AND t.day BETWEEN c.start AND c."end", false)""")
def f_service_runs(spark: SparkSession, sf: str) -> DataFrame:
    t = relation(spark, sf, "trips")
    cal = t.where("service NOT LIKE '5%'").select("service").distinct().select("service", F.lit("1993-01-01").cast("date").alias("start"), F.lit("1997-06-30").cast("date").alias("end"), F.array(*map(F.lit, range(5))).alias("weekdays"))
    x = t.where("trip % 11 = 0").groupBy("service", "day").agg((F.min("trip") % 2 == 0).alias("added"))
    return R.runs_on(t, cal, x).select("trip", "service", "day")


@query(sql("trips") + " SELECT trip, block, lead(trip) OVER (PARTITION BY block ORDER BY dep, trip) AS next_trip FROM trips")
def j_next_trip(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("block").orderBy("dep", "trip")
    return relation(spark, sf, "trips").select("trip", "block", F.lead("trip").over(w).alias("next_trip"))


@query(sql("fixes") + """ SELECT fix, trip, lag(fix) OVER w AS follower, lead(fix) OVER w AS leader, lead(dist) OVER w - dist AS gap FROM fixes WINDOW w AS (PARTITION BY trip, veh_ts // 3600 ORDER BY dist, fix)""")
def j_leader_follower(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("trip", "hour").orderBy("dist", "fix")
    f = relation(spark, sf, "fixes").withColumn("hour", F.floor(F.col("veh_ts") / 3600))
    return f.select("fix", "trip", F.lag("fix").over(w).alias("follower"), F.lead("fix").over(w).alias("leader"), (F.lead("dist").over(w) - F.col("dist")).alias("gap"))


_XY = "(lon - 24.03) * 111320.0 * cos(radians(49.84)) AS x, (lat - 49.84) * 111320.0 AS y"


@query(sql("fixes", "stops") + f""", f AS (SELECT fix, {_XY} FROM fixes WHERE speed < 0.5), s AS (SELECT stop, {_XY} FROM stops),
 m AS (SELECT fix, stop, round(sqrt((f.x - s.x) ** 2 + (f.y - s.y) ** 2), 6) AS metres FROM f JOIN s ON abs(f.x - s.x) < 400 AND abs(f.y - s.y) < 400)
 SELECT fix, stop, round(metres, 3) AS metres FROM m WHERE metres < 400 QUALIFY row_number() OVER (PARTITION BY fix ORDER BY metres, stop) = 1""")
def j_nearest_stop(spark: SparkSession, sf: str) -> DataFrame:
    xy = [S.to_x(F.col("lon")).alias("x"), S.to_y(F.col("lat")).alias("y")]
    f = relation(spark, sf, "fixes").where("speed < 0.5").select("fix", *xy)
    out = R.nearest(f, relation(spark, sf, "stops").select("stop", *xy), "fix", "stop", 400.0, 400.0)
    return out.withColumn("metres", F.round("metres", 3))


@query(sql("fixes", "stops", "times") + """, a AS (SELECT fix, dist % (SELECT max(stop) + 1 FROM stops) AS stop, fix * 37 % 90000 AS t FROM fixes)
 SELECT a.fix, a.stop, a.t, min(b.t) AS next_at FROM a LEFT JOIN times b ON b.stop = a.stop AND b.t >= a.t GROUP BY 1, 2, 3""")
def j_next_departure(spark: SparkSession, sf: str) -> DataFrame:
    """The next departure where fixes ask at all stops."""
    last = relation(spark, sf, "stops").agg(F.max("stop").alias("last"))
    a = relation(spark, sf, "fixes").crossJoin(F.broadcast(last)).selectExpr("fix", "dist % (last + 1) AS stop", "fix * 37 % 90000 AS t")
    b = relation(spark, sf, "times").select("stop", "t", "trip").distinct()
    return R.asof_next(a, b, "stop", "t", "trip").select("fix", "stop", "t", "next_at")


@query(sql("times") + """, s AS (SELECT trip, min(t) AS dep, max(t) AS arr FROM times GROUP BY 1), g AS (SELECT unnest(range(0, 91000, 600)) AS slot)
 SELECT slot, count(trip) AS under_way, count(trip) >= 50 AS enough FROM g LEFT JOIN s ON dep <= slot AND slot <= arr GROUP BY slot""")
def j_under_way(spark: SparkSession, sf: str) -> DataFrame:
    """Trips under way at each ten minutes: every trip counts in the grid points that it spans."""
    s = relation(spark, sf, "times").groupBy("trip").agg(F.min("t").alias("dep"), F.max("t").alias("arr"))
    first, last = F.ceil(F.col("dep") / 600), F.floor(F.col("arr") / 600)
    hit = s.where(first <= last).select(F.explode(F.sequence(first, last)).alias("k")).groupBy((F.col("k") * 600).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    out = spark.range(0, 91000, 600).toDF("slot").join(hit, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("under_way"))
    return out.withColumn("enough", F.col("under_way") >= 50)


@query(sql("fixes") + """, a AS (SELECT veh, max(dist) AS d FROM fixes WHERE fix % 2 = 0 GROUP BY 1), b AS (SELECT veh, max(dist) AS d FROM fixes WHERE fix % 3 <> 0 GROUP BY 1)
 SELECT coalesce(a.veh, b.veh) AS veh, CASE WHEN a.veh IS NULL THEN 'new' WHEN b.veh IS NULL THEN 'gone' ELSE 'changed' END AS state, b.d AS d FROM a FULL JOIN b ON a.veh = b.veh WHERE a.veh IS NULL OR b.veh IS NULL OR a.d <> b.d""")
def j_changed(spark: SparkSession, sf: str) -> DataFrame:
    f = relation(spark, sf, "fixes")
    at = lambda c: f.where(c).groupBy("veh").agg(F.max("dist").alias("d"))
    return R.changed(at("fix % 2 = 0"), at("fix % 3 <> 0"), "veh", ["d"])


@query(sql("fixes") + " SELECT trip, round(sum(ratio * weight) / sum(weight), 9) AS mean, round(sum(weight), 6) AS w FROM fixes WHERE weight > 0 GROUP BY 1")
def a_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    return R.weighted_mean(relation(spark, sf, "fixes"), ["trip"], "ratio", "weight").select("trip", F.round("mean", 9).alias("mean"), F.round("w", 6).alias("w"))


_W = f"weight * exp(-least((now - veh_ts) / {TAU!r}, 700.0))"


@query(sql("fixes") + f", n AS (SELECT max(veh_ts) AS now FROM fixes), f AS (SELECT *, {_W} AS w FROM fixes, n) SELECT trip, round(sum(ratio * w) / sum(w), 6) AS mean FROM f GROUP BY 1 HAVING sum(w) > 0")
def a_decayed_mean(spark: SparkSession, sf: str) -> DataFrame:
    f = relation(spark, sf, "fixes")
    rows = f.crossJoin(F.broadcast(f.agg(F.max("veh_ts").alias("now"))))  # one row
    return R.decayed(rows, ["trip"], "ratio", "weight", "veh_ts", F.col("now"), TAU).where("w > 0").select("trip", F.round("mean", 6).alias("mean"))


@query(sql("fixes") + " SELECT trip, veh_ts // 3600 % 24 AS slot, round(sum(ratio * weight) / sum(weight), 9) AS mean, count(*) AS n FROM fixes WHERE weight > 0 GROUP BY GROUPING SETS ((trip), (trip, veh_ts // 3600 % 24), ())")
def a_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Unit, unit by hour and global levels from one pass."""
    f = relation(spark, sf, "fixes").where("weight > 0").withColumn("slot", F.floor(F.col("veh_ts") / 3600) % 24)
    out = f.groupingSets([["trip"], ["trip", "slot"], []], "trip", "slot")
    return out.agg(F.round(F.sum(F.col("ratio") * F.col("weight")) / F.sum("weight"), 9).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(sql("fixes") + f""", g AS (SELECT sum(ratio * weight) / sum(weight) AS m FROM fixes), c AS (SELECT trip % 8 AS corridor, sum(ratio * weight) AS s, sum(weight) AS w FROM fixes GROUP BY 1), u AS (SELECT trip, sum(ratio * weight) AS s, sum(weight) AS w FROM fixes GROUP BY 1)
 SELECT trip, round(({K} * (({K} * g.m + c.s) / ({K} + c.w)) + u.s) / ({K} + u.w), 9) AS ratio FROM u JOIN c ON c.corridor = u.trip % 8, g""")
def a_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """A unit's estimate shrinks to its corridor's, and that to the global mean."""
    f = relation(spark, sf, "fixes").withColumn("corridor", F.col("trip") % 8)
    own = (F.sum(F.col("ratio") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    u = f.groupBy("trip", "corridor").agg(*own)
    c = u.groupBy("corridor").agg(F.sum("s").alias("cs"), F.sum("w").alias("cw"))
    g = c.agg(F.sum("cs"), F.sum("cw")).first()  # one row
    base = (K * F.lit(g[0] / g[1] if g[1] else 1.0) + F.col("cs")) / (K + F.col("cw"))
    return u.join(c, "corridor").select("trip", F.round((K * base + F.col("s")) / (K + F.col("w")), 9).alias("ratio"))


@query("SELECT l_suppkey, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75 FROM lineitem GROUP BY 1")
def a_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").agg(q.alias("q")).select("l_suppkey", *(F.col("q")[k].alias(f"q{n}") for k, n in enumerate((25, 50, 75))))


@query(sql("trips") + """, r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY dep DESC, trip DESC) AS k FROM trips)
 SELECT route, round(avg(CASE WHEN trip % 3 = 0 THEN 1.0 ELSE 0.0 END), 9) AS waited, count(*) AS n, count(*) < 10 OR avg(CASE WHEN trip % 3 = 0 THEN 1.0 ELSE 0.0 END) >= 0.3 AS waits FROM r WHERE k <= 50 GROUP BY 1""")
def a_habit(spark: SparkSession, sf: str) -> DataFrame:
    """Share that waited among the newest fifty turnarounds of each route; under ten, the timetable is taken to be kept."""
    r = R.newest(relation(spark, sf, "trips"), "route", ["dep", "trip"], 50)
    share = F.avg(F.when(F.col("trip") % 3 == 0, 1.0).otherwise(0.0))
    return r.groupBy("route").agg(F.round(share, 9).alias("waited"), F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) < 10) | (share >= 0.3)).alias("waits"))


@query("""WITH listed AS (SELECT pattern, stop FROM (SELECT *, min(stop) OVER (PARTITION BY pattern) AS a, max(stop) OVER (PARTITION BY pattern) AS z FROM (SELECT DISTINCT p_partkey % 40 AS pattern, p_size % 12 AS stop FROM part)) WHERE stop > a AND stop < z),
 p AS (SELECT pattern, stop, count(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN (l_orderkey, CAST(l_shipdate AS DATE)) END) AS n FROM listed LEFT JOIN lineitem ON l_suppkey % 40 = pattern AND l_partkey % 12 = stop AND l_partkey % 7 <> 3 GROUP BY 1, 2),
 m AS (SELECT pattern, median(n) AS usual FROM p GROUP BY 1) SELECT p.pattern, stop, n, usual, round(n / usual, 9) AS share FROM p JOIN m ON m.pattern = p.pattern WHERE usual >= 5 AND n < 0.9 * usual""")
def a_skipped_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Stops that a pattern's trips serve on far fewer trip days than its usual stop; these tables' stops hardly differ."""
    served = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_partkey % 7 <> 3").select((F.col("l_suppkey") % 40).alias("pattern"), (F.col("l_partkey") % 12).alias("stop"), F.col("l_orderkey").alias("trip"), F.col("l_shipdate").cast("date").alias("day"))
    listed = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey % 40 AS pattern", "p_size % 12 AS stop").distinct().withColumn("i", F.col("stop"))
    return R.skipped(listed, served, 0.9, 5).select("pattern", "stop", "n", "usual", F.round("share", 9).alias("share"))


@query(sql("fixes") + " SELECT dist // 500 AS line, CASE WHEN sum(weight) >= 3.0 THEN round(sum(ratio * weight) / sum(weight), 3) END AS ratio FROM fixes GROUP BY 1")
def a_street_ratio(spark: SparkSession, sf: str) -> DataFrame:
    f = relation(spark, sf, "fixes").groupBy(F.floor(F.col("dist") / 500).alias("line")).agg(F.sum(F.col("ratio") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    return f.select("line", F.when(F.col("w") >= 3.0, F.round(F.col("s") / F.col("w"), 3)).alias("ratio"))


@query(sql("fixes") + ", c AS (SELECT trip, dist // 500 AS line, count(*) AS n FROM fixes GROUP BY 1, 2) SELECT trip, line, n FROM c QUALIFY row_number() OVER (PARTITION BY trip ORDER BY n DESC, line) = 1")
def a_mode_line(spark: SparkSession, sf: str) -> DataFrame:
    c = relation(spark, sf, "fixes").groupBy("trip", F.floor(F.col("dist") / 500).alias("line")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("trip").agg(F.max(F.struct("n", (-F.col("line")).alias("l"))).alias("m")).select("trip", (-F.col("m.l")).alias("line"), "m.n")


@query(sql("times") + " SELECT stop, array_agg(DISTINCT trip % 20 ORDER BY trip % 20)::VARCHAR AS routes, count(DISTINCT trip) AS trips FROM times GROUP BY 1")
def a_routes_of_stop(spark: SparkSession, sf: str) -> DataFrame:
    g = relation(spark, sf, "times").groupBy("stop").agg(F.sort_array(F.collect_set(F.col("trip") % 20)).alias("r"), F.count_distinct("trip").alias("trips"))
    return g.select("stop", F.concat(F.lit("["), F.array_join("r", ", "), F.lit("]")).alias("routes"), "trips")


def _trailing_miss(fixes: DataFrame) -> DataFrame:
    """fix, trip, n, miss: a fold over a trip's day and the day before it, that keeps the ratios of the trailing day in order, so that no pairs are made."""
    f = fixes.select("fix", "trip", "veh_ts", F.col("ratio").cast("double").alias("ratio"), F.floor(F.col("veh_ts") / 86400).alias("d")).dropna(subset=["trip", "veh_ts"])
    both = f.select("fix", "trip", "veh_ts", "ratio", F.explode(F.array(F.struct("d", F.lit(True).alias("asks")), F.struct((F.col("d") + 1).alias("d"), F.lit(False).alias("asks")))).alias("g"))
    rows = both.select("fix", "trip", "veh_ts", "ratio", "g.d", "g.asks")
    kinds = dict(rows.dtypes)
    return rows.groupBy("trip", "d").applyInArrow(_medians, f"fix {kinds['fix']}, trip {kinds['trip']}, n long, miss double")


def _medians(group: pa.Table) -> pa.Table:
    group = group.sort_by("veh_ts")
    fix, ts, ratio, asks = (group.column(c).to_pylist() for c in ("fix", "veh_ts", "ratio", "asks"))
    held, out, first, last = [], [], 0, 0
    for k, now in enumerate(ts):
        if not asks[k]:
            continue
        while last < len(ts) and ts[last] <= now:  # those of the same second are in
            if ratio[last] is not None:
                insort(held, ratio[last])
            last += 1
        while ts[first] < now - 86400:
            if ratio[first] is not None:
                del held[bisect_left(held, ratio[first])]
            first += 1
        m = len(held)
        out.append((k, last - first, (held[(m - 1) // 2] + held[m // 2]) / 2 if m else None))
    at = pa.array([r[0] for r in out], pa.int64())
    return pa.table({"fix": group.column("fix").take(at), "trip": group.column("trip").take(at), "n": pa.array([r[1] for r in out], pa.int64()), "miss": pa.array([r[2] for r in out], pa.float64())})


@query(sql("fixes") + " SELECT a.fix, a.trip, count(b.fix) AS n, median(b.ratio) AS miss FROM fixes a JOIN fixes b ON b.trip = a.trip AND b.veh_ts BETWEEN a.veh_ts - 86400 AND a.veh_ts GROUP BY 1, 2")
def a_trailing_miss(spark: SparkSession, sf: str) -> DataFrame:
    """Median of the trailing day at every fix."""
    return _trailing_miss(relation(spark, sf, "fixes"))


@query(sql("times") + """, u AS (SELECT trip, i, min(part) AS part, max(d) AS d, max(wait) AS wait FROM times GROUP BY 1, 2)
 SELECT trip, i, max(d) OVER w AS d, sum(wait * 10) OVER w AS secs FROM u WINDOW w AS (PARTITION BY trip ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def w_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """Distances made monotone and seconds summed along each trip."""
    w = Window.partitionBy("trip").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    u = relation(spark, sf, "times").groupBy("trip", "i").agg(F.max("d").alias("d"), F.max("wait").alias("wait"))
    return u.select("trip", "i", F.max("d").over(w).alias("d"), F.sum(F.col("wait") * 10).over(w).alias("secs"))


@query(sql("fixes") + """, g AS (SELECT *, veh_ts - lag(veh_ts) OVER w AS gap, trip <> lag(trip) OVER w AS turned FROM fixes WINDOW w AS (PARTITION BY veh ORDER BY veh_ts, fix))
 SELECT fix, veh, CAST(sum(CASE WHEN gap > 30000 OR turned AND trip % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY veh ORDER BY veh_ts, fix ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g""")
def w_runs(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("veh").orderBy("veh_ts", "fix")
    g = relation(spark, sf, "fixes").withColumns({"gap": F.col("veh_ts") - F.lag("veh_ts").over(w), "turned": F.col("trip") != F.lag("trip").over(w)})
    return R.islands(g, "veh", ["veh_ts", "fix"], (F.col("gap") > 30000) | (F.col("turned") & (F.col("trip") % 4 == 0))).select("fix", "veh", "run")


@query(sql("fixes") + """, g AS (SELECT *, sum(CASE WHEN speed >= 7.0 THEN 1 ELSE 0 END) OVER (PARTITION BY veh ORDER BY veh_ts, fix ROWS UNBOUNDED PRECEDING) AS island FROM fixes)
 SELECT fix, veh, CASE WHEN speed < 7.0 THEN min(CASE WHEN speed < 7.0 THEN veh_ts END) OVER (PARTITION BY veh, island) END AS still_since FROM g""")
def w_still_since(spark: SparkSession, sf: str) -> DataFrame:
    g = R.islands(relation(spark, sf, "fixes"), "veh", ["veh_ts", "fix"], F.col("speed") >= 7.0)
    still = F.min(F.when(F.col("speed") < 7.0, F.col("veh_ts"))).over(Window.partitionBy("veh", "run"))
    return g.select("fix", "veh", F.when(F.col("speed") < 7.0, still).alias("still_since"))


@query(sql("fixes") + " SELECT veh, veh_ts // 60 * 60 AS epoch, count(*) AS n, round(avg(speed), 6) AS speed FROM fixes GROUP BY 1, 2")
def r_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "fixes").groupBy("veh", (F.floor(F.col("veh_ts") / 60) * 60).alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("speed"), 6).alias("speed"))


@query(sql("fixes") + " SELECT fix, veh, trip FROM fixes QUALIFY row_number() OVER (PARTITION BY veh, trip ORDER BY poll_ts, fix) = 1")
def k_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_wins(relation(spark, sf, "fixes"), ["veh", "trip"], ["poll_ts", "fix"]).select("fix", "veh", "trip")


@query(sql("fixes", "times") + f""", u AS (SELECT trip, i, max(d) AS d, max(t) AS t FROM times GROUP BY 1, 2), l AS (SELECT veh, trip, dist % 3000 AS s, fix % 3600 AS now FROM fixes QUALIFY row_number() OVER (PARTITION BY veh ORDER BY veh_ts DESC, fix DESC) = 1)
 SELECT veh, l.trip, i, l.now + u.t - u.t // {HORIZON} * {HORIZON} AS eta FROM l JOIN u ON u.trip = l.trip AND u.d > l.s WHERE u.t % {HORIZON} <= {HORIZON} - 200""")
def r_etas(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals at the stops ahead of each vehicle's latest fix, within the horizon."""
    u = relation(spark, sf, "times").groupBy("trip", "i").agg(F.max("d").alias("d"), F.max("t").alias("t"))
    last = relation(spark, sf, "fixes").groupBy("veh").agg(F.max_by(F.struct("trip", (F.col("dist") % 3000).alias("s"), (F.col("fix") % 3600).alias("now")), F.struct("veh_ts", "fix")).alias("l")).select("veh", "l.*")
    ahead = last.join(u, "trip").where((F.col("d") > F.col("s")) & (F.col("t") % HORIZON <= HORIZON - 200))
    return ahead.select("veh", "trip", "i", (F.col("now") + F.col("t") % HORIZON).alias("eta"))


@query(sql("trips") + " SELECT trip, route FROM trips t WHERE NOT EXISTS (SELECT 1 FROM trips o WHERE o.route = t.route AND o.dep <= t.dep AND o.trip % 97 <= t.trip % 97 AND (o.dep < t.dep OR o.trip % 97 < t.trip % 97))")
def t_skyline(spark: SparkSession, sf: str) -> DataFrame:
    t = relation(spark, sf, "trips").select("trip", "route", "dep", (F.col("trip") % 97).alias("walk"))
    # the best of each walk are enough to beat with
    best = t.groupBy("route", "walk").agg(F.min("dep").alias("dep"))
    kept = R.skyline(best.withColumn("trip", F.lit(0)), "route", "trip", ["dep", "walk"])
    return t.join(kept.select("route", "walk", "dep"), ["route", "walk", "dep"], "left_semi").select("trip", "route")


@query(sql("trips") + ", d AS (SELECT trip, route, dep + k * 86400 AS dep FROM trips, (SELECT unnest([-1, 0, 1]) AS k)) SELECT trip, route, dep FROM d WHERE dep BETWEEN 80000 AND 100000")
def u_three_days(spark: SparkSession, sf: str) -> DataFrame:
    t = relation(spark, sf, "trips")
    days = [t.select("trip", "route", (F.col("dep") + k * 86400).alias("dep")) for k in (-1, 0, 1)]
    return days[0].unionByName(days[1]).unionByName(days[2]).where("dep BETWEEN 80000 AND 100000")


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part), q AS (SELECT unnest(['part', 'part#1', '7', 'a', 's']) AS q),
 s AS (SELECT p_partkey, q, max(CASE WHEN word = q THEN 1.0e0 WHEN starts_with(word, q) THEN 1.0e0 WHEN contains(word, q) THEN 0.9e0 ELSE 0.0e0 END) AS score FROM w, q GROUP BY 1, 2)
 SELECT p_partkey, round(sum(score), 6) AS score FROM s WHERE score > 0 GROUP BY 1""")
def x_word_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Places by the best score of each query word; the words asked for are an array, not a join."""
    asked = ("part", "part#1", "7", "a", "s")
    words = F.split(F.lower("p_name"), " ")
    one = lambda q: F.array_max(F.transform(words, lambda w: F.when(w.startswith(q), 1.0).when(w.contains(q), 0.9).otherwise(0.0)))
    total = sum((one(q) for q in asked[1:]), one(asked[0]))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.round(total, 6).alias("score")).where("score > 0")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 1000000 + o_orderkey % 211 AS b FROM orders WHERE o_custkey IS NOT NULL), u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, min(r.root) FROM r JOIN u ON u.a = r.node JOIN recurring.r o ON o.node = u.b WHERE r.root < o.root GROUP BY u.b) SELECT node, root FROM r""")
def g_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey IS NOT NULL").selectExpr("o_custkey AS a", "1000000 + o_orderkey % 211 AS b").distinct())


@query("""WITH RECURSIVE e AS (SELECT a, b, min(c) AS c FROM (SELECT l_suppkey AS a, l_suppkey % 97 + l_linenumber AS b, CAST(l_linenumber * 40 + l_suppkey % 30 AS DOUBLE) AS c FROM lineitem) GROUP BY 1, 2),
 r AS (SELECT 1 AS node, CAST(0.0 AS DOUBLE) AS cost UNION SELECT e.b, r.cost + e.c FROM r JOIN e ON e.a = r.node WHERE r.cost + e.c <= 300) SELECT CAST(1 AS BIGINT) AS source, CAST(node AS BIGINT) AS node, min(cost) AS cost FROM r GROUP BY 2""")
def g_reach(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey AS a", "l_suppkey % 97 + l_linenumber AS b", "CAST(l_linenumber * 40 + l_suppkey % 30 AS DOUBLE) AS cost").groupBy("a", "b").agg(F.min("cost").alias("cost"))
    return graph.reach(e, spark.range(1, 2).toDF("node"), 300.0)


@query(sql("times") + ", a AS (SELECT stop, trip % 20 AS route, t FROM times WHERE t >= 30000) SELECT stop, route, min(t) AS soonest, CASE WHEN min(t) - 30000 < 30 THEN 'now' WHEN min(t) - 30000 < 90 THEN '1 min' ELSE 'later' END AS shown FROM a GROUP BY 1, 2")
def c_soonest(spark: SparkSession, sf: str) -> DataFrame:
    a = relation(spark, sf, "times").where("t >= 30000").groupBy("stop", (F.col("trip") % 20).alias("route")).agg(F.min("t").alias("soonest"))
    left = F.col("soonest") - 30000
    return a.withColumn("shown", F.when(left < 30, "now").when(left < 90, "1 min").otherwise("later"))


@query(sql("trips") + """, g AS (SELECT route, dep, dep - lag(dep) OVER (PARTITION BY route ORDER BY dep) AS gap FROM trips WHERE dep BETWEEN 20000 AND 60000),
 n AS (SELECT route, gap, row_number() OVER (PARTITION BY route ORDER BY gap) AS k, count(*) OVER (PARTITION BY route) AS n FROM g WHERE gap IS NOT NULL),
 s AS (SELECT route, min(dep) AS first, max(dep) AS last FROM g GROUP BY 1) SELECT s.route, first, last, gap AS headway FROM s LEFT JOIN n ON n.route = s.route AND k = n // 2 + 1 WHERE n IS NULL OR k = n // 2 + 1""")
def c_headway(spark: SparkSession, sf: str) -> DataFrame:
    """First and last departure and the upper median gap."""
    w = Window.partitionBy("route").orderBy("dep")
    g = relation(spark, sf, "trips").where("dep BETWEEN 20000 AND 60000").select("route", "dep", (F.col("dep") - F.lag("dep").over(w)).alias("gap"))
    by = Window.partitionBy("route").orderBy("gap")
    n = g.where("gap IS NOT NULL").select("route", "gap", F.row_number().over(by).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("route")).alias("n")).where("k = floor(n / 2) + 1")
    s = g.groupBy("route").agg(F.min("dep").alias("first"), F.max("dep").alias("last"))
    return s.join(n.select("route", F.col("gap").alias("headway")), "route", "left")
