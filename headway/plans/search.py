"""Queries of the place index over names that the documents open with, asked for by the benchmark's openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.operators import search as X
from headway.sources.stages import stage

_WORDS = "filter(split(substring(text, 1, 400), '[^A-Za-z]+'), w -> w <> '')"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Two words are the name, three the context; what lies where and what it is follow from the number."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.expr(_WORDS).alias("w"))
    display = F.concat(F.concat_ws(" ", F.slice("w", 1, 2)), F.lit(" ("), F.concat_ws(", ", F.slice("w", 3, 3)), F.lit(")"))
    kind = F.when(F.col("doc_id") % 10 == 0, "place=town").otherwise("highway=residential")
    return d.select(F.col("doc_id").alias("place"), display.alias("display"), kind.alias("category"), (F.col("doc_id") % 90 / 1000 + 49.8).alias("lat"), (F.col("doc_id") % 70 / 1000 + 24).alias("lon"))


def x_search(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best places for every benchmark item's first two words, the second one misspelt."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("q"), F.expr(_WORDS).alias("w"))
    text = F.concat(F.get("w", F.lit(0)), F.lit(" "), F.substring(F.get("w", F.lit(1)), F.lit(1), F.greatest(F.lit(2), F.length(F.get("w", F.lit(1))) - 1)))
    asked = b.select("q", text.alias("text"), F.lit(49.84).alias("lat"), F.lit(24.03).alias("lon"))
    return X.search(asked, X.index(_places(spark, sf), stage), stage)


def x_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the index with its places, and how many of them have it in their name, from the postings read back."""
    v = X.index(_places(spark, sf), stage)["vocab"].select("word", F.explode(X._decode("refs")).alias("ref"))
    return v.groupBy("word").agg(F.count_distinct(F.shiftright("ref", 1)).alias("places"), F.count_if(F.col("ref") % 2 == 1).alias("named"))


_LISTS = "list_filter(regexp_split_to_array(substring(text, 1, 400), '[^A-Za-z]+'), lambda w: w <> '')"
QUERIES = {f.__name__: f for f in (x_search, x_vocabulary)}
ORACLES = {
    "x_vocabulary": f"""WITH d AS (SELECT doc_id, {_LISTS} AS w FROM documents), x AS (SELECT doc_id, unnest(w[1:2]) AS word, true AS named FROM d UNION ALL SELECT doc_id, unnest(w[3:5]), false FROM d)
    SELECT lower(word) AS word, count(DISTINCT doc_id) AS places, count(DISTINCT doc_id) FILTER (named) AS named FROM x GROUP BY 1"""
}
