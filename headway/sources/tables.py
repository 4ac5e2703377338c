"""Transit relations over the star-schema tables: vehicle fixes, stops, trips, stop times.

Each has its DataFrame and, for the oracle, the same relation as an SQL expression of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"
_EPOCH_SQL = "date_diff('second', TIMESTAMP '1970-01-01 00:00:00', {})"

#: columns of a relation: name -> expression that both engines read; {epoch} is the epoch seconds of a timestamp
_FIXES = {
    "fix": "event_id", "veh": "user_id", "trip": "event_id % 40", "veh_ts": "{ts}", "poll_ts": "{ts} + event_id * 37 % 420 - 90",
    "lat": "49.84e0 + (event_id * 7919 % 2000 - 1000) / 50000.0e0", "lon": "24.03e0 + (event_id * 6151 % 2000 - 1000) / 33000.0e0",
    "speed": "event_id * 31 % 150 / 10.0e0", "dist": "event_id * 13 % 9000", "kind": "event_type", "weight": "event_id % 5 * 0.5e0", "ratio": "0.15e0 + event_id * 17 % 300 / 100.0e0",
}
_STOPS = {"stop": "s_suppkey", "name": "s_name", "lat": "49.84e0 + (s_suppkey * 7907 % 2000 - 1000) / 50000.0e0", "lon": "24.03e0 + (s_suppkey * 6133 % 2000 - 1000) / 33000.0e0"}
_TRIPS = {"trip": "o_orderkey", "block": "o_custkey % 50", "route": "o_custkey % 20", "service": "o_orderpriority", "dep": "o_orderkey * 613 % 90000", "day": "CAST(o_orderdate AS DATE)"}
_TIMES = {"trip": "l_orderkey", "i": "l_linenumber", "stop": "l_suppkey", "part": "l_partkey", "t": "l_orderkey * 613 % 90000 + l_linenumber * 97 + l_partkey % 60", "d": "l_linenumber * 400 + l_suppkey % 90", "wait": "l_quantity"}

RELATIONS = {"fixes": ("events", _FIXES), "stops": ("supplier", _STOPS), "trips": ("orders", _TRIPS), "times": ("lineitem", _TIMES)}


def _text(name: str, epoch: str) -> str:
    table, columns = RELATIONS[name]
    return f"SELECT {', '.join(f'{e.replace("{ts}", epoch.format("ts"))} AS {c}' for c, e in columns.items())} FROM {table}"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Only the columns that a query names are read from Parquet."""
    table, columns = RELATIONS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    out = df.selectExpr(*(f"{e.replace('{ts}', _EPOCH.format('ts'))} AS {c}" for c, e in columns.items()))
    return out.selectExpr(*(f"CAST({c} AS DOUBLE) AS {c}" if t.startswith("decimal") else c for c, t in out.dtypes))


def sql(*names: str) -> str:
    """WITH clauses of the relations named, decimals as doubles."""
    doubles = {"fixes": ("lat", "lon", "speed", "weight", "ratio"), "stops": ("lat", "lon")}
    out = []
    for n in names:
        own = doubles.get(n, ())
        cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in own else c for c in RELATIONS[n][1])
        out.append(f"{n} AS (SELECT {cols} FROM ({_text(n, _EPOCH_SQL)}))")
    return "WITH " + ", ".join(out)
