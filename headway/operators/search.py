"""Place search: an inverted index of words, written as tables, and many queries at once, which are a table too.

Index: `places` (place, display, category, lat, lon, name, context: folded words), `vocab` (word, block, places, refs: postings of places
by blocks of their numbers, as delta-coded bytes), `prefixes` (prefix, word, places) and `grams` (gram, word) for misspelt words. A query
word reads the vocabulary by its prefix, an equi-join, and where that finds too few places, by a three-letter probe. Scores of all words meet at
(query, place); places that lack a word are read in full, as many as are worth it. No group is larger than a block of postings.

Defined cases: a query without words finds nothing; nulls are empty; equal places stay apart; a place's words count once.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F, types as T

from headway.functions import scalar as S, words as W

#: The least score of a word, letters that words may differ in length, words of a prefix, places of a word before only names
#: count, places that make a prefix sure, letters of a word that may be misspelt, letters cut from its probe and left in it, what a match in the
#: context loses, places that are read in full.
LEAST, LENGTH_GAP, WORDS, REFS, SURE, FUZZY, TRIM, PROBE, CONTEXT, INCOMPLETE = 0.6, 3, 500, 20_000, 50, 6, 2, 3, 0.01, 400
#: Places of a block of postings.
BLOCK = 1 << 14


def delta_coded(refs: list[int]) -> bytes:
    """Ascending numbers as differences, seven bits a byte, the high bit set where more follow."""
    out, last = bytearray(), 0
    for r in refs:
        gap, last = r - last, r
        while gap > 127:
            out.append(gap & 127 | 128)
            gap >>= 7
        out.append(gap)
    return bytes(out)


def delta_decoded(body: bytes) -> list[int]:
    out, last, gap, shift = [], 0, 0, 0
    for b in body:
        gap |= (b & 127) << shift
        shift += 7
        if b < 128:
            last += gap
            out.append(last)
            gap = shift = 0
    return out


@F.pandas_udf(T.BinaryType())
def _encode(refs: pd.Series) -> pd.Series:
    return refs.map(lambda r: delta_coded([int(x) for x in r]))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _decode(body: pd.Series) -> pd.Series:
    return body.map(delta_decoded)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's likeness, in this order of the two words."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def similarity(word: Column, candidate: Column, ratio: Column) -> Column:
    """Of a typed word and an indexed one: a beginning is as good as the whole, a part nearly; else their likeness, if their lengths allow it."""
    return F.when(candidate.startswith(word), 1.0).when(candidate.contains(word), 0.9).when(F.abs(F.length(word) - F.length(candidate)) > LENGTH_GAP, 0.0).otherwise(ratio)


def index(places: DataFrame, keep) -> dict[str, DataFrame]:
    """The index's tables of places (place, display, category, lat, lon); keep writes a table and reads it again."""
    name, context = W.name_and_context(F.coalesce("display", F.lit("")))
    text = lambda c: F.array_distinct(W.words(W.folded(c)))
    rows = keep(places.select("place", "display", "category", "lat", "lon", text(name).alias("name"), text(F.concat_ws(" ", context)).alias("context")))
    named = rows.select(F.col("place").cast("long").alias("place"), F.explode("name").alias("word"), F.lit(1).alias("named"))
    near = rows.select(F.col("place").cast("long").alias("place"), F.explode("context").alias("word"), F.lit(0).alias("named"))
    refs = named.unionByName(near).select("word", F.floor(F.col("place") / BLOCK).alias("block"), (F.col("place") * 2 + F.col("named")).alias("ref"), "place")
    posted = refs.groupBy("word", "block").agg(F.count_distinct("place").alias("places"), F.sort_array(F.collect_set("ref")).alias("refs"))
    vocab = keep(posted.select("word", "block", "places", _encode("refs").alias("refs")))
    sizes = keep(vocab.groupBy("word").agg(F.sum("places").alias("places")))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring(F.col("word"), F.lit(1), k)))
    grams = sizes.where(F.length("word") >= PROBE).select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - PROBE + 1), lambda k: F.substring(F.col("word"), k, F.lit(PROBE))))).alias("gram"))
    return {"places": rows, "vocab": vocab, "prefixes": keep(sizes.select(cut.alias("prefix"), "word", "places")), "grams": keep(grams)}


def resolved(asked: DataFrame, ix: dict[str, DataFrame]) -> DataFrame:
    """typed, word, score, exact, names: the indexed words that each typed word could be; names: only names are worth reading."""
    w = Window.partitionBy("typed").orderBy(F.length("word"), "word")
    met = asked.join(ix["prefixes"].select(F.col("prefix").alias("typed"), "word", "places"), "typed").withColumn("n", F.row_number().over(w)).where(F.col("n") <= WORDS)
    met = met.withColumn("before", F.sum("places").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("many", F.max(F.col("before") > REFS).over(Window.partitionBy("typed")))
    begun = met.where(F.col("before") <= REFS)
    found = begun.select("typed", "word", F.lit(1.0).alias("score"), (F.col("word") == F.col("typed")).alias("exact"), F.col("many").alias("names"))
    total = met.groupBy("typed").agg(F.sum("places").alias("total"))
    weak = asked.join(total, "typed", "left").where((F.coalesce("total", F.lit(0)) < SURE) & (F.length("typed") >= FUZZY))
    probe = F.substring(F.col("typed"), F.lit(1), F.greatest(F.lit(PROBE), F.length("typed") - TRIM))
    near = weak.select("typed", probe.alias("probe"), F.substring(probe, 1, PROBE).alias("gram")).join(ix["grams"], "gram").where(F.col("word").contains(F.col("probe")))
    near = near.join(begun.select("typed", "word"), ["typed", "word"], "left_anti").withColumn("ratio", _ratio("typed", "word"))
    likely = near.select("typed", "word", similarity(F.col("typed"), F.col("word"), F.col("ratio")).alias("score"), F.lit(False).alias("exact"), F.lit(False).alias("names"))
    return found.unionByName(likely.where(F.col("score") >= LEAST))


def search(queries: DataFrame, ix: dict[str, DataFrame], keep, limit: int = 20) -> DataFrame:
    """q, rank, place, score, exact, named, area of the hits of queries (q, text, and lat, lon, null for none), best first."""
    tokens = queries.select("q", F.posexplode(W.words(W.folded(F.coalesce("text", F.lit(""))))).alias("j", "typed"))
    tokens = keep(tokens.withColumn("width", F.count(F.lit(1)).over(Window.partitionBy("q"))))
    words = keep(resolved(tokens.select("typed").distinct(), ix))
    posts = words.join(ix["vocab"].select("word", _decode("refs").alias("refs")), "word").select("typed", "score", "exact", "names", F.explode("refs").alias("ref"))
    posts = posts.select("typed", F.shiftright("ref", 1).alias("place"), (F.col("ref") % 2 == 1).alias("named"), "score", "exact", "names").where("named OR NOT names")
    here = F.struct(F.when(F.col("named"), F.col("score")).otherwise(F.col("score") - CONTEXT).alias("score"), (F.col("named") & F.col("exact")).alias("exact"), F.col("named"))
    best = posts.groupBy("typed", "place").agg(F.max(here).alias("b"))
    hits = tokens.join(best, "typed").groupBy("q", "width", "place").agg(F.map_from_entries(F.collect_list(F.struct("j", "b"))).alias("m"))
    got = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda j: F.coalesce(F.try_element_at("m", j), F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("exact"), F.lit(False).alias("named"))))
    hits = keep(hits.select("q", "width", "place", got.alias("b")))
    low, high = F.array_min(F.transform("b", lambda x: x["score"])), F.array_max(F.transform("b", lambda x: x["score"]))
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + x["score"])
    whole = hits.where(low >= LEAST)
    few = queries.select("q").join(whole.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "q", "left").where(F.coalesce("n", F.lit(0)) < limit).select("q")
    part = hits.where((low < LEAST) & (high >= LEAST)).join(few, "q").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(total), "place"))).where(F.col("n") <= INCOMPLETE)
    text = ix["places"].select(F.col("place").cast("long").alias("place"), F.concat("name", "context").alias("own"))
    lacks = part.join(text, "place").select("q", "place", "own", F.posexplode("b").alias("j", "x")).where(F.col("x.score") < LEAST).join(tokens.select("q", "j", "typed"), ["q", "j"])
    pairs = lacks.select("q", "place", "j", "typed", F.explode_outer(F.filter(F.array_distinct("own"), lambda o: F.substring(o, 1, 1) == F.substring("typed", 1, 1))).alias("word"))
    read = pairs.withColumn("ratio", _ratio("typed", F.coalesce("word", F.lit(""))))
    filled = read.groupBy("q", "place", "j").agg(F.coalesce(F.max(F.when(F.col("word").isNotNull(), similarity(F.col("typed"), F.col("word"), F.col("ratio")))), F.lit(0.0)).alias("score")).groupBy("q", "place").agg(F.map_from_entries(F.collect_list(F.struct("j", "score"))).alias("f"))
    mended = part.join(filled, ["q", "place"]).withColumn("b", F.transform("b", lambda x, j: F.struct(F.coalesce(F.try_element_at("f", j), x["score"]).alias("score"), x["exact"].alias("exact"), x["named"].alias("named")))).where(low >= LEAST)
    rows = whole.select("q", "width", "place", "b").unionByName(mended.select("q", "width", "place", "b"))
    rows = rows.select("q", "place", (total / F.col("width")).alias("score"), F.size(F.filter("b", lambda x: x["exact"])).alias("exact"), F.forall("b", lambda x: x["named"]).alias("named"))
    # distance only orders what scores alike: a few times the limit are enough
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "place"))).where(F.col("n") <= limit * 10)
    at = ix["places"].select(F.col("place").cast("long").alias("place"), "display", "category", "lat", "lon")
    rows = rows.join(at, "place").join(queries.select("q", F.col("lat").alias("qlat"), F.col("lon").alias("qlon")), "q")
    metres = F.coalesce(S.ground_metres(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    name, _ = W.name_and_context(F.coalesce("display", F.lit("")))
    rows = rows.withColumns({"area": F.coalesce(W.area(F.col("category")), F.lit(False)), "metres": metres, "name": name})
    order = Window.partitionBy("q").orderBy(F.desc("exact"), F.desc("area"), F.desc("score"), "metres", "name", "place")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("q", "rank", "place", "score", "exact", "named", "area")
