"""Joins, aggregations, windows, sorts and set operations of the engine, on any DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean and weight of each key; weights of nothing are dropped."""
    return df.where(F.col(weight) > 0).groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("w"))


def decayed(df: DataFrame, by: list[str], value: str, weight: str, time: str, now: Column, tau: float) -> DataFrame:
    """The exponentially decayed mean in closed form: one aggregation, whatever the order of arrival."""
    w = F.col(weight) * F.exp(-F.least((now - F.col(time)) / tau, F.lit(700.0)))
    return df.groupBy(*by).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("mean"), F.sum(w).alias("w"))


def large(df: DataFrame) -> DataFrame:
    """The table or stream, not to be broadcast by the size that Spark takes it to have: keys that follow each other take few bytes of a file,
    and rows made of a row (trips of a vehicle, fixes of a trip) aren't counted."""
    return df if df.isStreaming else df.hint("merge")


def nearest(points: DataFrame, others: DataFrame, key: str, other: str, radius: float, cell: float) -> DataFrame:
    """The nearest of others within the radius, by cells of a grid: each point looks into nine. Places are looked up once, whatever stands on
    them: of others at one place the least wins in any case."""
    grid = lambda c: F.floor(F.col(c) / cell)
    around = F.explode(F.array(*(F.struct((grid("x") + a).alias("gx"), (grid("y") + b).alias("gy")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    left = points.select("x", "y").distinct().select("*", around.alias("g")).select("*", "g.gx", "g.gy").drop("g")
    right = others.groupBy(F.col("x").alias("ox"), F.col("y").alias("oy")).agg(F.min(other).alias(other)).select("*", F.floor(F.col("ox") / cell).alias("gx"), F.floor(F.col("oy") / cell).alias("gy"))
    met = left.join(large(right), ["gx", "gy"]).withColumn("metres", F.round(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")), 6)).where(F.col("metres") < radius)
    best = met.groupBy("x", "y").agg(F.min(F.struct("metres", other)).alias("m"))
    return points.join(large(best), ["x", "y"]).groupBy(key).agg(F.min("m").alias("m")).select(key, f"m.{other}", "m.metres")


def asof_next(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """For each left row the first right row at or after it: both in one sort, no range join."""
    both = left.select("*", F.lit(None).cast("long").alias("next_at"), F.lit(None).cast("long").alias("next"), F.lit(0).alias("side")).unionByName(
        right.select(by, at, F.col(at).cast("long").alias("next_at"), F.col(value).cast("long").alias("next"), F.lit(1).alias("side")), allowMissingColumns=True
    )
    # backwards in time, so that the frame only grows
    w = Window.partitionBy(by).orderBy(F.desc(at), F.desc("side"), F.desc("next")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"next_at": F.last("next_at", ignorenulls=True).over(w), "next": F.last("next", ignorenulls=True).over(w)})
    return out.where("side = 0").drop("side")


def newest_before(asks: DataFrame, events: DataFrame, by: list[str], ask: str, at: str, order: list[str], n: int, bucket: float, name: str = "got") -> DataFrame:
    """Each ask with an array of the n newest events of its key up to its time, oldest first: structs of what events have beside the key.

    Events of one time go by `order`, and before asks of that time. A key is worked on by buckets of time, so that one key may hold any
    share of all rows; what a bucket inherits is n events at most. Events without a key or a time are left out; asks without either
    get an empty array.
    """
    cell = lambda c: F.floor(F.col(c) / bucket).alias("_b")
    e = events.dropna(subset=[*by, at]).select(*by, F.col(at).alias("_t"), cell(at), F.lit(0).alias("_side"), F.struct(*(c for c in events.columns if c not in by)).alias("_e"))
    kind = dict(e.dtypes)["_e"]
    own = Window.partitionBy(*by, "_b")
    ranked = e.withColumn("_k", F.row_number().over(own.orderBy(F.desc("_t"), *(F.desc(f"_e.{c}") for c in order)))).where(F.col("_k") <= n)
    ends = ranked.groupBy(*by, "_b").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_k")).alias("k"), "_e"))), lambda r: r["_e"]).alias("_end"))
    key = Window.partitionBy(*by).orderBy("_b")
    tail = lambda a: F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, F.lit(n))
    ends = ends.withColumn("_end", tail(F.flatten(F.collect_list("_end").over(key.rowsBetween(1 - n, 0)))))
    asked = asks.dropna(subset=[*by, ask]).select(*by, cell(ask)).distinct()
    buckets = ends.unionByName(asked, allowMissingColumns=True).groupBy(*by, "_b").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = buckets.withColumn("_before", F.last("_end", ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, -1)))
    # what a bucket inherits are rows of it, so that arrays are made once, behind the last shuffle
    inherited = before.select(*by, "_b", F.explode("_before").alias("_e")).select(*by, F.col(f"_e.{at}").alias("_t"), "_b", F.lit(0).alias("_side"), "_e")
    both = asks.select("*", F.col(ask).alias("_t"), cell(ask), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_e"))
    both = both.unionByName(e, allowMissingColumns=True).unionByName(inherited, allowMissingColumns=True)
    # the running number of events is shared by the asks after one, so that a range of it is the newest n for both
    both = both.withColumn("_n", F.count("_e").over(own.orderBy("_t", "_side", *(f"_e.{c}" for c in order)).rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_own", F.collect_list("_e").over(own.orderBy("_n").rangeBetween(1 - n, 0))).where("_side = 1")
    return both.select(*asks.columns, F.col("_own").alias(name))


def islands(df: DataFrame, by: str, order: list[str], new: Column) -> DataFrame:
    """Numbers the runs of each key; new says where one starts."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def newest(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).where(F.col("place") <= n)


def skyline(df: DataFrame, group: str, ident: str, costs: list[str]) -> DataFrame:
    """Rows of a group that no other row beats: as good in all costs and better in one. Equal rows stay."""
    o = df.select(F.col(group).alias("_g"), *(F.col(c).alias(f"_{c}") for c in costs)).distinct()
    no_worse = reduce(lambda a, b: a & b, [F.col(f"_{c}") <= F.col(c) for c in costs])
    better = reduce(lambda a, b: a | b, [F.col(f"_{c}") < F.col(c) for c in costs])
    return df.join(o, (F.col("_g") == F.col(group)) & no_worse & better, "left_anti")


def changed(before: DataFrame, now: DataFrame, key: str, values: list[str]) -> DataFrame:
    """What a delta frame carries: rows that are new, different or gone."""
    a = before.select(key, *(F.col(v).alias(f"{v}_was") for v in values), F.lit(True).alias("was"))
    b = now.select(key, *values, F.lit(True).alias("is"))
    same = reduce(lambda x, y: x & y, [F.col(v).eqNullSafe(F.col(f"{v}_was")) for v in values])
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").otherwise("changed")
    return a.join(b, key, "full_outer").where(F.col("was").isNull() | F.col("is").isNull() | ~same).select(key, state.alias("state"), *values)


def runs_on(trips: DataFrame, calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Trips whose service runs on their day: an exception decides, else weekday and window. A service without a calendar
    row doesn't run; where there are neither calendars nor exceptions at all, every service does."""
    some = calendar.select(F.lit(1).alias("k")).limit(1).unionByName(exceptions.select(F.lit(1).alias("k")).limit(1))
    free = some.agg((F.count(F.lit(1)) == 0).alias("free"))  # one row
    x = trips.join(calendar, "service", "left").join(exceptions, ["service", "day"], "left").crossJoin(F.broadcast(free))
    usual = F.array_contains("weekdays", F.weekday("day")) & F.col("day").between(F.col("start"), F.col("end"))
    return x.where(F.coalesce(F.col("added"), usual, F.col("free"))).drop("free")


def skipped(listed: DataFrame, served: DataFrame, share: float = 0.1, least: int = 30) -> DataFrame:
    """pattern, stop, n, usual, share of the stops of a pattern (listed: pattern, i, stop) that were served (pattern, stop, trip, day) on
    fewer than a share of the trip days of its median stop, if that has enough. Stops that no trip served count 0; the
    ends are left out, as no call is seen there; worst first within `share`, then the busiest pattern."""
    ends = Window.partitionBy("pattern")
    inner = listed.withColumns({"a": F.min("i").over(ends), "z": F.max("i").over(ends)}).where("i > a AND i < z").select("pattern", "stop").distinct()
    days = served.select("pattern", "stop", "trip", "day").distinct().groupBy("pattern", "stop").agg(F.count(F.lit(1)).alias("n"))
    rows = inner.join(days, ["pattern", "stop"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    usual = rows.groupBy("pattern").agg(F.median("n").alias("usual"))
    out = rows.join(usual, "pattern").where((F.col("usual") >= least) & (F.col("n") < share * F.col("usual")))
    return out.select("pattern", "stop", "n", "usual", (F.col("n") / F.col("usual")).alias("share"))
