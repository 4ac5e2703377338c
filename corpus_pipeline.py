"""A training-data pipeline: each stage works on all that the one before kept.

Stages 1 to 4 return the columns of documents. Rows are told apart by their texts: rows without a doc_id, or
that repeat one, are judged each by itself; nulls are empty texts. n_chars follows the text. Of near copies the
row with the least doc_id stays (then the least digest of its text; of rows that agree in both, any). Other columns
are kept by stages 1 to 4; an empty table gives no rows; very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import bpe, decontaminate, minhash, quality, suffix_array
from headway.llm.common import stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither score of the quality classifier rejects. It judges texts, so that copies share a fate."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.filtered(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link."""
    return minhash.dedup(docs, 5)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of a hundred bytes that start earlier; a character that is cut in two goes."""
    kept = suffix_array.dedup_text(docs, carried=docs.columns)
    out = kept.withColumn("text", F.when(F.col("n_removed") == 0, F.col("in_text")).otherwise(F.col("kept")))
    columns = {c: F.col(f"in_{c}") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length(F.coalesce("text", F.lit(""))).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and a digest of what they decode to."""
    both = bpe.round_trip(docs)
    return both.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("suffix_array", substring_stage), ("decontaminate", benchmark_stage), ("encode", encode_stage)]
#: The stages have no SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs)
    return docs
