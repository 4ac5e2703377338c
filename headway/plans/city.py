"""Queries of the city's places, its timetable's pace, journeys and boards; each with SQL that an oracle runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headway.functions import scalar as S, words as W
from headway.operators import folds, relational as R
from headway.plans.service import _CALLS, calls
from headway.sources.tables import relation, sql

QUERIES, ORACLES = {}, {}
#: The pace without a timetable and the clip of paces in seconds a metre, of ratios, and of holds in seconds.
PACE, PACES, RATIOS, HOLDS = 1 / 7.0, (0.02, 2.0), (0.15, 8.0), (0.0, 240.0)
#: Seconds of a near tie and of a narrow win, of grace, of a better plan, of the shortest wait that is shown.
TIE, CLOSE, GRACE, BETTER, WAIT = 300, 300, 10, 120, 60
#: Seconds a forecast waits for its passing, and between the fixes of a passing.
PENDING, GAP = 7200, 120
#: Metres of a cell of these tables' shapes, and how many a shape has.
CELL, CELLS = 200, 45
#: Names and house numbers that the tables stand for.
NAMES = ("вулиця Зелена", "Згурський провулок", "площа Ринок (Львів, Україна)", "Їжакевича", "п’ять кутів", "Юр’ївська", "Щирецька", "Ґалицька площа", "Złota ulica", "Café Львів (Личаків,  , Львів)", "Ёлка йод", "Цитадель")
NUMBERS = ("15-А", "15а", "15A", "3/2", "7 б", "12", "км")


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def _case(key: str, values: tuple[str, ...]) -> str:
    """One of the values by the remainder of a key, as both engines read it."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_PLACES = f"SELECT c_custkey, {_case('c_custkey', NAMES)} AS s, CASE WHEN c_custkey % 5 = 4 THEN '' ELSE {_case('c_custkey', NAMES)} || ' ' END || {_case('c_custkey // 7', NUMBERS)} AS street FROM customer"
_FOLD = "replace(strip_accents(lower({})), 'ł', 'l')"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    name, number = F.expr(_case("c_custkey", NAMES)), F.expr(_case("(c_custkey div 7)", NUMBERS))
    return c.select("c_custkey", name.alias("s"), F.concat(F.when(F.col("c_custkey") % 5 == 4, "").otherwise(F.concat(name, F.lit(" "))), number).alias("street"))


@query(f"SELECT c_custkey, {_FOLD.format('s')} AS folded, translate(strip_accents(lower(s)), 'ʼ’', '') AS typed FROM ({_PLACES})")
def x_folded(spark: SparkSession, sf: str) -> DataFrame:
    """Names as they are compared, and as the client's stop search does, without apostrophes."""
    client = F.translate(W._bare(F.col("s")), "ʼ’'", "")
    return _places(spark, sf).select("c_custkey", W.folded(F.col("s")).alias("folded"), client.alias("typed"))


def _romanised_sql(first: bool) -> str:
    letters = W.LETTERS | ({a: b for a, (_, b) in W.STARTS.items()} if first else W.TYPED)
    text = "lower(s)"
    if first:
        text = f"replace({text}, 'зг', 'zgh')"
        for a, (b, _) in W.STARTS.items():
            text = rf"regexp_replace({text}, '(^|[^\p{{L}}]){a}', '\1{b}', 'g')"
    for a, b in letters.items():
        text = f"replace({text}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return text


@query(rf"""SELECT c_custkey, official, typed, CASE WHEN NOT regexp_matches(s, '[Ѐ-ӿ]') THEN '' WHEN trim(official) = trim(typed) THEN trim(official) ELSE trim(official) || '|' || trim(typed) END AS both
 FROM (SELECT c_custkey, s, {_romanised_sql(True)} AS official, {_romanised_sql(False)} AS typed FROM ({_PLACES}))""")
def x_romanised(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s")
    return _places(spark, sf).select("c_custkey", W.romanised(s).alias("official"), W.typed(s).alias("typed"), F.array_join(W.romanisations(s), "|").alias("both"))


_KEY = "regexp_replace(translate({}, 'аеіорсух', 'aeiopcyx'), '[^0-9a-zа-яіїєґ]', '', 'g')"
_HAS = r"(regexp_matches(line, '^(.+?)((?: [0-9][^ ]*)+(?: [^0-9 ])?)$') AND NOT regexp_matches(line, '^[0-9][^ ]*( [0-9][^ ]*)*( [^0-9 ])?$'))"


@query(rf"""SELECT c_custkey, CASE WHEN {_HAS} THEN regexp_extract(line, '^(.+?)((?: [0-9][^ ]*)+(?: [^0-9 ])?)$', 1) ELSE line END AS street,
 CASE WHEN {_HAS} THEN {_KEY.format("regexp_extract(line, '^(.+?)((?: [0-9][^ ]*)+(?: [^0-9 ])?)$', 2)")} ELSE '' END AS number
 FROM (SELECT c_custkey, array_to_string(regexp_extract_all({_FOLD.format('street')}, '[\p{{L}}\p{{N}}_]+'), ' ') AS line FROM ({_PLACES}))""")
def x_street_number(spark: SparkSession, sf: str) -> DataFrame:
    """A query's street and the key of the house number behind it."""
    street, number = W.street_and_number(F.col("f"))
    return _places(spark, sf).withColumn("f", W.folded(F.col("street"))).select("c_custkey", street.alias("street"), number.alias("number"))


_CATEGORY = _case("c_custkey // 5", ("place=city", "boundary=administrative;8", "shop=place=", "highway=bus_stop"))


@query(rf"""SELECT c_custkey, CASE WHEN strpos(s, ' (') = 0 THEN s ELSE substr(s, 1, strpos(s, ' (') - 1) END AS name, starts_with(c, 'place=') OR starts_with(c, 'boundary=administrative') AS area,
 CASE WHEN strpos(s, ' (') = 0 THEN '' ELSE array_to_string(list_filter(list_transform(string_split(substr(s, strpos(s, ' (') + 2, length(s) - strpos(s, ' (') - 2), ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS context
 FROM (SELECT *, {_CATEGORY} AS c FROM ({_PLACES}))""")
def x_names(spark: SparkSession, sf: str) -> DataFrame:
    name, context = W.name_and_context(F.col("s"))
    category = F.expr(_CATEGORY.replace("c_custkey // 5", "(c_custkey div 5)"))
    return _places(spark, sf).select("c_custkey", name.alias("name"), F.array_join(context, "|").alias("context"), W.area(category).alias("area"))


@query(r"""SELECT c_custkey, CASE WHEN regexp_matches(u, '^[a-z0-9][a-z0-9._-]{1,30}[a-z0-9]$') THEN u END AS username FROM (SELECT c_custkey, lower(trim(CASE c_custkey % 4 WHEN 0 THEN ' ' || c_name WHEN 1 THEN replace(c_name, '#', '.') || ' ' WHEN 2 THEN 'u' || c_custkey % 9 ELSE c_mktsegment END)) AS u FROM customer)""")
def x_usernames(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), "c_name")).when(k % 4 == 1, F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("u"), (k % 9).cast("string"))).otherwise(F.col("c_mktsegment"))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", W.username(raw).alias("username"))


@query(sql("fixes") + ", e AS (SELECT max(veh_ts) AS top FROM fixes) SELECT fix, veh, trip, veh_ts FROM fixes, e WHERE poll_ts - veh_ts BETWEEN -60 AND 300 AND veh_ts > top - 2592000 AND veh_ts <= top AND speed < 0.5")
def s_slow_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """The recording's admissible fixes of its last thirty days that hardly move."""
    f = relation(spark, sf, "fixes")
    top = f.agg(F.max("veh_ts").alias("top")).withColumn("one", F.lit(1))
    rows = f.where("poll_ts - veh_ts BETWEEN -60 AND 300 AND speed < 0.5").withColumn("one", F.lit(1)).join(F.broadcast(top), "one")  # one row
    return rows.where("veh_ts > top - 2592000 AND veh_ts <= top").select("fix", "veh", "trip", "veh_ts")


_CODE = "CASE stop % 5 WHEN 0 THEN 'A' || CAST(stop AS STRING) WHEN 1 THEN lpad(CAST(stop AS STRING), 6, '0') WHEN 2 THEN '7' ELSE CAST(stop AS STRING) END"


@query(sql("stops", "times") + f""", codes AS (SELECT stop, {_CODE} AS code FROM stops), n AS (SELECT stop, count(*) AS n FROM times GROUP BY stop), one AS (SELECT code FROM codes GROUP BY code HAVING count(*) = 1)
 SELECT stop, coalesce(nullif(ltrim(code, '0'), ''), '0') AS code, coalesce(n, 0) AS n FROM codes JOIN one USING (code) LEFT JOIN n USING (stop) WHERE regexp_matches(code, '^[0-9]+$') ORDER BY coalesce(n, 0) DESC, stop LIMIT 60""")
def s_sample_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The 60 stops with the most calls of those whose code is a number and theirs alone."""
    codes = relation(spark, sf, "stops").select("stop", F.expr(_CODE).alias("code"))
    one = codes.groupBy("code").agg(F.count(F.lit(1)).alias("c"), F.min("stop").alias("stop")).where("c = 1").where(F.col("code").rlike("^[0-9]+$"))
    n = relation(spark, sf, "times").groupBy("stop").agg(F.count(F.lit(1)).alias("n"))
    rows = one.join(n, "stop", "left").select("stop", F.expr("coalesce(nullif(ltrim('0', code), ''), '0')").alias("code"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.orderBy(F.desc("n"), "stop").limit(60)


@query(sql("fixes") + " SELECT kind, max(veh_ts) AS newest, max(max(veh_ts)) OVER () - max(veh_ts) > 900 AS stale FROM fixes GROUP BY kind")
def s_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """The newest fix of each kind, and whether the others are ahead of it by a quarter of an hour."""
    newest = relation(spark, sf, "fixes").groupBy("kind").agg(F.max("veh_ts").alias("newest"))
    top = newest.agg(F.max("newest").alias("top")).withColumn("one", F.lit(1))
    return newest.withColumn("one", F.lit(1)).join(F.broadcast(top), "one").select("kind", "newest", (F.col("top") - F.col("newest") > 900).alias("stale"))


@query("WITH RECURSIVE " + sql("fixes")[5:] + """, o AS (SELECT fix, veh, veh_ts // 86400 AS day, kind, dist % 40 AS t, row_number() OVER (PARTITION BY veh, veh_ts // 86400 ORDER BY veh_ts, fix) AS n FROM fixes),
 f AS (SELECT veh, day, n, fix, kind, t, true AS sent FROM o WHERE n = 1 UNION ALL SELECT o.veh, o.day, o.n, o.fix, CASE WHEN o.kind = f.kind AND abs(o.t - f.t) <= 5 THEN f.kind ELSE o.kind END, CASE WHEN o.kind = f.kind AND abs(o.t - f.t) <= 5 THEN f.t ELSE o.t END, NOT (o.kind = f.kind AND abs(o.t - f.t) <= 5) FROM f JOIN o ON o.veh = f.veh AND o.day = f.day AND o.n = f.n + 1)
 SELECT fix, veh, kind, t FROM f WHERE sent""")
def s_deadband(spark: SparkSession, sf: str) -> DataFrame:
    """Of each vehicle's day, what differs in kind, or by more than five, from what was last let through."""
    f = relation(spark, sf, "fixes").select("veh", F.floor(F.col("veh_ts") / 86400).alias("day"), "veh_ts", "fix", "kind", (F.col("dist") % 40).alias("t"))
    return folds.deadband(f, ["veh", "day"], ["veh_ts", "fix"], "kind", "t", 5).select("fix", "veh", "kind", "t")


@query(sql("fixes") + f""", o AS (SELECT trip, least(dist // {CELL}, {CELLS - 1}) AS cell, avg(least(greatest(ratio, 0.15), 8.0)) AS ratio, avg(least(greatest(weight * 200, 0.0), 240.0)) AS hold FROM fixes GROUP BY 1, 2),
 c AS (SELECT t.trip, k.cell, coalesce(ratio, 1.0) * {CELL} / 7.0e0 + coalesce(hold, 0.0) AS secs FROM (SELECT DISTINCT trip FROM fixes) t CROSS JOIN (SELECT unnest(range(0, {CELLS})) AS cell) k LEFT JOIN o ON o.trip = t.trip AND o.cell = k.cell),
 u AS (SELECT *, coalesce(sum(secs) OVER (PARTITION BY trip ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
 SELECT f.fix, round(greatest(b.before + (f.d1 / {CELL}.0e0 - b.cell) * b.secs - a.before - (f.dist / {CELL}.0e0 - a.cell) * a.secs, 0), 6) AS secs FROM (SELECT fix, trip, dist, least(dist + 1500, {CELL * CELLS}) AS d1 FROM fixes) f
 JOIN u a ON a.trip = f.trip AND a.cell = least(f.dist // {CELL}, {CELLS - 1}) JOIN u b ON b.trip = f.trip AND b.cell = least(f.d1 // {CELL}, {CELLS - 1})""")
def e_between(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds from each fix to 1,500 m on (or the shape's end): observed ratios and holds by cell, summed along the shape, one sum less the other."""
    f = relation(spark, sf, "fixes")
    clip = lambda x, b: F.least(F.greatest(x, F.lit(b[0])), F.lit(b[1]))
    at = lambda d: F.least(F.floor(F.col(d) / CELL), F.lit(CELLS - 1))
    seen = f.groupBy("trip", at("dist").alias("cell")).agg(F.avg(clip(F.col("ratio"), RATIOS)).alias("ratio"), F.avg(clip(F.col("weight") * 200, HOLDS)).alias("hold"))
    every = f.select("trip").distinct().select("trip", F.explode(F.expr(f"sequence(0L, {CELLS - 1}L)")).alias("cell"))
    secs = every.join(seen, ["trip", "cell"], "left").select("trip", "cell", (F.coalesce("ratio", F.lit(1.0)) * CELL * PACE + F.coalesce("hold", F.lit(0.0))).alias("secs"))
    w = Window.partitionBy("trip").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = secs.select("trip", "cell", "secs", F.coalesce(F.sum("secs").over(w), F.lit(0.0)).alias("before"))
    # a shape's cells are one short array, so that one join answers both ends
    line = sums.groupBy("trip").agg(F.sort_array(F.collect_list(F.struct("cell", "secs", "before"))).alias("line"))
    rows = f.select("fix", "trip", "dist", F.least(F.col("dist") + 1500, F.lit(CELL * CELLS)).alias("d1")).join(line, "trip")

    def upto(d: str) -> Column:
        c = F.element_at("line", (at(d) + 1).cast("int"))
        return c["before"] + (F.col(d) / CELL - c["cell"]) * c["secs"]

    return rows.select("fix", F.round(F.greatest(upto("d1") - upto("dist"), F.lit(0.0)), 6).alias("secs"))


@query(sql("fixes", "times") + f", {_CALLS} SELECT f.fix, count(c.d) FILTER (c.d <= f.dist) AS passed FROM fixes f JOIN calls c ON c.trip = f.trip GROUP BY f.fix")
def v_next_stop(spark: SparkSession, sf: str) -> DataFrame:
    """How many of its trip's stops a vehicle has behind it: the place of the next one."""
    stops = calls(spark, sf).groupBy("trip").agg(F.collect_list("d").alias("ds"))
    rows = relation(spark, sf, "fixes").select("fix", "trip", "dist").join(stops, "trip")
    return rows.select("fix", F.size(F.filter("ds", lambda d: d <= F.col("dist"))).cast("long").alias("passed"))


@query(sql("stops") + " SELECT round(min(lat) - 0.02, 5) AS south, round(max(lat) + 0.02, 5) AS north, round(min(lon) - 0.02, 5) AS west, round(max(lon) + 0.02, 5) AS east FROM stops")
def v_box(spark: SparkSession, sf: str) -> DataFrame:
    five = lambda c: F.round(c, 5)
    return relation(spark, sf, "stops").agg(five(F.min("lat") - 0.02).alias("south"), five(F.max("lat") + 0.02).alias("north"), five(F.min("lon") - 0.02).alias("west"), five(F.max("lon") + 0.02).alias("east"))


_XY = "(lon - 24.03) * 111320.0 * cos(radians(49.84)) AS x, (lat - 49.84) * 111320.0 AS y"


@query(sql("fixes", "stops") + f""", f AS (SELECT fix, {_XY}, radians(CAST(fix * 53 % 360 AS DOUBLE)) AS h FROM fixes), s AS (SELECT stop, {_XY}, radians(CAST(stop * 37 % 360 AS DOUBLE)) AS h FROM stops)
 SELECT fix, arg_min(stop, ((s.x - f.x) ** 2 + (s.y - f.y) ** 2, stop)) AS stop FROM f JOIN s ON (s.x - f.x) ** 2 + (s.y - f.y) ** 2 < 40000 AND cos(s.h) * cos(f.h) + sin(s.h) * sin(f.h) > 0.7 GROUP BY fix""")
def j_same_way(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest drawn point within 200 m that heads the same way; the points, not the fixes, go to the neighbouring squares."""
    def of(df: DataFrame, k: str, turn: int) -> DataFrame:
        return df.select(k, S.to_x(F.col("lon")).alias(f"{k}_x"), S.to_y(F.col("lat")).alias(f"{k}_y"), F.radians((F.col(k) * turn % 360).cast("double")).alias(f"{k}_h"))

    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    # a place and heading is looked up once, whatever stands on it
    fixes, drawn = of(relation(spark, sf, "fixes"), "fix", 53), ["stop_x", "stop_y", "stop_h"]
    asked = ["fix_x", "fix_y", "fix_h"]
    f = fixes.select(*asked).distinct().withColumn("gx", F.floor(F.col("fix_x") / 200)).withColumn("gy", F.floor(F.col("fix_y") / 200))
    s = of(relation(spark, sf, "stops"), "stop", 37).groupBy(*drawn).agg(F.min("stop").alias("stop")).withColumn("i", F.explode(near)).withColumn("j", F.explode(near))
    s = s.withColumn("gx", F.floor(F.col("stop_x") / 200) + F.col("i")).withColumn("gy", F.floor(F.col("stop_y") / 200) + F.col("j"))
    d = F.pow(F.col("stop_x") - F.col("fix_x"), F.lit(2)) + F.pow(F.col("stop_y") - F.col("fix_y"), F.lit(2))
    same = F.cos("stop_h") * F.cos("fix_h") + F.sin("stop_h") * F.sin("fix_h") > 0.7
    met = f.join(R.large(s), ["gx", "gy"]).withColumn("d", d).where((F.col("d") < 200 * 200) & same)
    best = met.groupBy(*asked).agg(F.min(F.struct("d", "stop")).alias("m"))
    return fixes.join(R.large(best), asked).groupBy("fix").agg(F.min("m").alias("m")).select("fix", "m.stop")


@query(sql("fixes") + f""", told AS (SELECT fix, veh, veh_ts FROM fixes WHERE kind = 'view'), went AS (SELECT veh, veh_ts, dist % 240 AS gap FROM fixes WHERE kind = 'purchase'),
 p AS (SELECT t.fix, t.veh, t.veh_ts AS at, min(w.veh_ts) AS passed FROM told t JOIN went w ON w.veh = t.veh AND w.veh_ts > t.veh_ts AND w.veh_ts <= t.veh_ts + {PENDING} * 24 GROUP BY ALL)
 SELECT p.fix, p.passed - p.at AS secs FROM p JOIN (SELECT veh, veh_ts, min(gap) AS gap FROM went GROUP BY ALL) g ON g.veh = p.veh AND g.veh_ts = p.passed WHERE gap <= {GAP}""")
def j_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A forecast meets the first passing after it, within two days for these tables, if that is well timed; equal on buckets of the bound."""
    bound = PENDING * 24
    f = relation(spark, sf, "fixes")
    told = f.where("kind = 'view'").select("fix", "veh", F.col("veh_ts").alias("at"), F.explode(F.array(F.floor(F.col("veh_ts") / bound), F.floor(F.col("veh_ts") / bound) + 1)).alias("b"))
    went = f.where("kind = 'purchase'").select("veh", "veh_ts", (F.col("dist") % 240).alias("gap")).groupBy("veh", "veh_ts").agg(F.min("gap").alias("gap")).withColumn("b", F.floor(F.col("veh_ts") / bound))
    met = told.join(went, ["veh", "b"]).where((F.col("veh_ts") > F.col("at")) & (F.col("veh_ts") <= F.col("at") + bound))
    first = met.groupBy("fix").agg(F.min(F.struct("veh_ts", "gap", "at")).alias("m"))
    return first.where(F.col("m.gap") <= GAP).select("fix", (F.col("m.veh_ts") - F.col("m.at")).alias("secs"))


@query("SELECT p_partkey, i, CAST(floor((i + 0.5e0) * p_size / (p_size % 7 + 3)) AS BIGINT) AS was FROM (SELECT p_partkey, p_size, unnest(range(0, p_size % 7 + 3)) AS i FROM part)")
def j_recelled(spark: SparkSession, sf: str) -> DataFrame:
    """The old cell that the middle of each new cell lies in, when a line of so many cells is cut anew."""
    new = F.col("p_size") % 7 + 3
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", new.alias("new"), F.explode(F.sequence(F.lit(0), new - 1)).alias("i"))
    return rows.select("p_partkey", F.col("i").cast("long").alias("i"), F.floor((F.col("i") + 0.5) * F.col("p_size") / F.col("new")).alias("was"))


_LEGS = "legs AS (SELECT trip, i, t AS dep, t + d % 97 AS arr, i % 3 > 0 AS ride, stop % 4 AS sure, d % 5 AS backups, count(*) FILTER (i % 3 > 0) OVER (PARTITION BY trip ORDER BY i) AS rides FROM calls)"


def _legs(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).select("trip", "i", F.col("t").alias("dep"), (F.col("t") + F.col("d") % 97).alias("arr"), (F.col("i") % 3 > 0).alias("ride"), (F.col("stop") % 4).alias("sure"), (F.col("d") % 5).alias("backups"), F.count_if(F.col("i") % 3 > 0).over(Window.partitionBy("trip").orderBy("i")).alias("rides"))


@query(sql("times") + f", {_CALLS}, {_LEGS} SELECT trip, CAST(coalesce(sum(arr - dep) FILTER (NOT ride), 0) AS BIGINT) AS walked, count(*) FILTER (ride) AS rides, coalesce(min(sure) FILTER (ride), -1) AS weakest, coalesce(min(backups) FILTER (ride), -1) AS backups FROM legs GROUP BY trip")
def a_journeys(spark: SparkSession, sf: str) -> DataFrame:
    """Of each journey the seconds walked, its rides, and the confidence and backups of the weakest (-1 without rides)."""
    ride, rows = F.col("ride"), _legs(spark, sf)
    return rows.groupBy("trip").agg(F.sum(F.when(ride, 0).otherwise(F.col("arr") - F.col("dep"))).alias("walked"), F.count_if(ride).alias("rides"), F.coalesce(F.min(F.when(ride, F.col("sure"))), F.lit(-1)).alias("weakest"), F.coalesce(F.min(F.when(ride, F.col("backups"))), F.lit(-1)).alias("backups"))


@query(sql("times") + f", {_CALLS}, {_LEGS}, w AS (SELECT *, lag(arr) OVER (PARTITION BY trip ORDER BY i) AS since FROM legs) SELECT trip, i, since, dep FROM w WHERE ride AND dep - since >= {WAIT}")
def c_waits(spark: SparkSession, sf: str) -> DataFrame:
    """Waits of a minute or more before a ride."""
    rows = _legs(spark, sf).withColumn("since", F.lag("arr").over(Window.partitionBy("trip").orderBy("i")))
    return rows.where(F.col("ride") & (F.col("dep") - F.col("since") >= WAIT)).select("trip", "i", "since", "dep")


@query(sql("times") + f""", {_CALLS}, {_LEGS} SELECT o.trip, o.i AS i, j.i AS other, j.dep >= o.dep - {TIE} AND j.dep < o.dep AND j.arr <= o.arr + {TIE} AS near, j.arr <= o.arr + {CLOSE} AND j.rides <= o.rides AS close, greatest(j.dep * 0.6e0 - {GRACE}, 0) AS hurried
 FROM legs o JOIN legs j ON j.trip = o.trip AND j.i <> o.i AND o.ride AND j.ride""")
def f_near_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Of two options of a search: a near tie, a narrow win, and the seconds of its walk when hurrying; the pairs are of one short list."""
    legs = _legs(spark, sf).where("ride")
    o, j = legs.alias("o"), legs.alias("j")
    c = F.col
    near = (c("j.dep") >= c("o.dep") - TIE) & (c("j.dep") < c("o.dep")) & (c("j.arr") <= c("o.arr") + TIE)
    close = (c("j.arr") <= c("o.arr") + CLOSE) & (c("j.rides") <= c("o.rides"))
    rows = o.join(j, (c("o.trip") == c("j.trip")) & (c("o.i") != c("j.i")))
    return rows.select(c("o.trip").alias("trip"), c("o.i").alias("i"), c("j.i").alias("other"), near.alias("near"), close.alias("close"), F.greatest(c("j.dep") * 0.6 - GRACE, F.lit(0.0)).alias("hurried"))


@query("""SELECT o_orderkey, w <= 615.0 AND d + w * 0.4 < 2400.0 AS worth FROM (SELECT o_orderkey, o_orderkey * 7 % 900 + 0.5 AS w, o_orderkey * 13 % 3600 AS d FROM orders)""")
def f_worth_hurrying(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a journey only hurrying catches is offered: a short dash, which still beats walking."""
    k = F.col("o_orderkey")
    w, d = k * 7 % 900 + 0.5, k * 13 % 3600
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", ((w <= 615.0) & (d + w * (1 - 0.6) < 2400.0)).alias("worth"))


@query(sql("trips") + f""", o AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY dep, trip) AS n, dep % 7 = 0 AS broken FROM trips), f AS (SELECT block, trip, dep FROM o WHERE n = 1)
 SELECT o.trip, CASE WHEN o.broken OR f.dep <= o.dep - {BETTER} THEN f.trip ELSE -1 END AS better FROM o JOIN f USING (block)""")
def c_better_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The best option in place of a plan that is broken or slower by two minutes; -1 where the plan stands."""
    trips = relation(spark, sf, "trips").select("trip", "block", "dep")
    best = trips.groupBy("block").agg(F.min(F.struct("dep", "trip")).alias("best"))
    better = (F.col("dep") % 7 == 0) | (F.col("best.dep") <= F.col("dep") - BETTER)
    return trips.join(best, "block").select("trip", F.when(better, F.col("best.trip")).otherwise(-1).alias("better"))


@query(sql("fixes") + """ SELECT fix, round(h0 + ((h1 - h0 + 540) % 360 - 180) * e, 9) AS heading, round((lon + 180) / 360, 9) AS mx, round(0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi()), 9) AS my,
 round(40075016.686 * cos(radians(lat)) / (512 * pow(2, 14)), 6) AS mpp, CASE WHEN ratio <= 0.85 THEN 0.0 WHEN ratio >= 1.6 THEN 4.0 WHEN ratio < 1.0 THEN round((ratio - 0.85) / 0.15, 6) WHEN ratio < 1.15 THEN round(1 + (ratio - 1.0) / 0.15, 6) WHEN ratio < 1.3 THEN round(2 + (ratio - 1.15) / 0.15, 6) ELSE round(3 + (ratio - 1.3) / 0.3, 6) END AS ramp
 FROM (SELECT *, fix % 360 AS h0, fix * 7 % 360 AS h1, k * (2 - k) AS e FROM (SELECT *, least(1.0e0, fix % 100 / 80.0e0) AS k FROM fixes))""")
def c_marker(spark: SparkSession, sf: str) -> DataFrame:
    """A marker's eased heading by the short way, its Mercator place, metres a pixel there, and its place on the traffic colours' ramp."""
    fix, lat, ratio, pi = F.col("fix"), F.col("lat"), F.col("ratio"), F.pi()
    k = F.least(F.lit(1.0), fix % 100 / 80.0)
    h0, h1, e, s = fix % 360, fix * 7 % 360, k * (2 - k), F.sin(F.radians(lat))
    stops = (0.85, 1.0, 1.15, 1.3, 1.6)
    ramp = F.when(ratio <= stops[0], 0.0).when(ratio >= stops[-1], 4.0)
    for i, (a, b) in enumerate(zip(stops, stops[1:])):
        ramp = ramp.when(ratio < b, F.round(i + (ratio - a) / (0.3 if i == 3 else 0.15), 6))
    return relation(spark, sf, "fixes").select(
        "fix", F.round(h0 + ((h1 - h0 + 540) % 360 - 180) * e, 9).alias("heading"), F.round((F.col("lon") + 180) / 360, 9).alias("mx"), F.round(0.5 - F.log((1 + s) / (1 - s)) / (4 * pi), 9).alias("my"),
        F.round(40075016.686 * F.cos(F.radians(lat)) / (512 * 2**14), 6).alias("mpp"), ramp.alias("ramp"),
    )


@query(sql("fixes") + " SELECT veh, kind, place FROM (SELECT veh, kind, row_number() OVER (PARTITION BY veh ORDER BY last DESC, kind) AS place FROM (SELECT veh, kind, max(veh_ts) AS last FROM fixes GROUP BY ALL)) WHERE place <= 3")
def c_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The three different things each rider picked last, the newest first."""
    last = relation(spark, sf, "fixes").groupBy("veh", "kind").agg(F.max("veh_ts").alias("last"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("veh").orderBy(F.desc("last"), "kind"))).where("place <= 3").select("veh", "kind", "place")


@query(sql("stops") + " SELECT stop, round(m, 3) AS metres FROM (SELECT stop, sqrt(power((lat - 49.84) * 111320, 2) + power((lon - 24.03) * 111320 * cos(radians(lat)), 2)) AS m FROM stops) WHERE m <= 2000 ORDER BY m, stop LIMIT 20")
def c_stops_near(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty stops next to a point, within two kilometres."""
    m = F.hypot((F.col("lat") - 49.84) * 111320, (F.col("lon") - 24.03) * 111320 * F.cos(F.radians("lat")))
    return relation(spark, sf, "stops").select("stop", m.alias("m")).where("m <= 2000").orderBy("m", "stop").limit(20).select("stop", F.round("m", 3).alias("metres"))


@query("SELECT c_custkey FROM customer ORDER BY c_custkey % 11 = 0 DESC, c_nationkey % 3 = 0 DESC, c_custkey * 7 % 10 DESC, c_custkey * 31 % 5000, c_name LIMIT 25")
def t_search_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 first hits: exact names, then areas, then by score, by metres and by name."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf}/customer.parquet").orderBy((k % 11 == 0).desc(), (F.col("c_nationkey") % 3 == 0).desc(), (k * 7 % 10).desc(), k * 31 % 5000, "c_name")
    return rows.limit(25).select("c_custkey")


@query(r"SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || CAST(p_partkey % 1500 AS VARCHAR)), '[\p{L}\p{N}_]+')) AS w FROM part) ORDER BY length(w), w LIMIT 500")
def t_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The 500 shortest words of all names."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_type", (F.col("p_partkey") % 1500).cast("string")))
    return spark.read.parquet(f"{sf}/part.parquet").select(F.explode(W.words(text)).alias("w")).distinct().orderBy(F.length("w"), "w").limit(500)


@query(sql("fixes", "times") + f""", {_CALLS}, hops AS (SELECT trip, i, stop, lead(stop) OVER w AS to_stop, t FROM calls WINDOW w AS (PARTITION BY trip ORDER BY i)), late AS (SELECT trip, max(dist) % 600 AS late FROM fixes GROUP BY trip)
 SELECT h.trip, i, stop, to_stop, t + coalesce(late, 0) AS dep, late IS NOT NULL AS live FROM hops h LEFT JOIN late l ON l.trip = h.trip WHERE to_stop IS NOT NULL""")
def u_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Hops of trips that are seen, shifted by their lateness, beside the timetable's hops of all other trips."""
    w = Window.partitionBy("trip").orderBy("i")
    hops = calls(spark, sf).select("trip", "i", "stop", F.lead("stop").over(w).alias("to_stop"), "t").where("to_stop IS NOT NULL")
    late = relation(spark, sf, "fixes").groupBy("trip").agg((F.max("dist") % 600).alias("late"))
    live = hops.join(late, "trip").select("trip", "i", "stop", "to_stop", (F.col("t") + F.col("late")).alias("dep"), F.lit(True).alias("live"))
    planned = hops.join(late, "trip", "left_anti").select("trip", "i", "stop", "to_stop", F.col("t").alias("dep"), F.lit(False).alias("live"))
    return live.unionByName(planned)


@query(sql("times") + f", {_CALLS} SELECT DISTINCT least(stop, to_stop) AS a, greatest(stop, to_stop) AS b FROM (SELECT stop, lead(stop) OVER (PARTITION BY trip ORDER BY i) AS to_stop FROM calls) WHERE to_stop IS NOT NULL")
def u_corridors(spark: SparkSession, sf: str) -> DataFrame:
    hops = calls(spark, sf).select("stop", F.lead("stop").over(Window.partitionBy("trip").orderBy("i")).alias("to_stop")).where("to_stop IS NOT NULL")
    return hops.select(F.least("stop", "to_stop").alias("a"), F.greatest("stop", "to_stop").alias("b")).distinct()


@query("""SELECT k, arg_min(src, (src, id)) AS src, arg_min(id, (src, id)) AS id FROM (SELECT 0 AS src, c_custkey AS id, c_custkey % 700 AS k FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT 1, s_suppkey, s_suppkey * 3 % 900 FROM supplier) GROUP BY k""")
def u_two_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Two geocoders' answers, each place once, the first list's before the other's."""
    a = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 3 > 0").selectExpr("0 AS src", "c_custkey AS id", "c_custkey % 700 AS k")
    b = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("1 AS src", "s_suppkey AS id", "s_suppkey * 3 % 900 AS k")
    return a.unionByName(b).groupBy("k").agg(F.min(F.struct("src", "id")).alias("m")).select("k", "m.src", "m.id")


@query(sql("fixes") + """, last AS (SELECT veh, arg_max(speed, (veh_ts, fix)) < 0.7 AS stuck, max(veh_ts) AS seen FROM fixes GROUP BY veh), now AS (SELECT max(veh_ts) AS now FROM fixes)
 SELECT o_orderkey, CASE WHEN stuck THEN 'stuck' WHEN seen IS NULL OR now - seen > 86400 THEN 'silent' ELSE 'none' END AS doubt FROM orders CROSS JOIN now LEFT JOIN last ON veh = o_custkey""")
def r_doubt(spark: SparkSession, sf: str) -> DataFrame:
    """Why an arrival is doubted: its vehicle stands still, or else has not reported for a day."""
    f = relation(spark, sf, "fixes")
    last = f.groupBy("veh").agg((F.max_by("speed", F.struct("veh_ts", "fix")) < 0.7).alias("stuck"), F.max("veh_ts").alias("seen"))
    now = f.agg(F.max("veh_ts").alias("now")).withColumn("one", F.lit(1))
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("veh"), F.lit(1).alias("one")).join(last, "veh", "left").join(F.broadcast(now), "one")
    silent = F.col("seen").isNull() | (F.col("now") - F.col("seen") > 86400)
    return rows.select("o_orderkey", F.when(F.col("stuck"), "stuck").when(silent, "silent").otherwise("none").alias("doubt"))
