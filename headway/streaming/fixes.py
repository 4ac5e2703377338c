"""Streams of vehicle fixes: epochs by event time, and the per-vehicle filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.operators import folds
from headway.sources import stages
from headway.sources.tables import relation

#: Variances of the tracker's position, speed and acceleration, and its limits.
SNAP, SPEED, ACCEL, STALE = 12.0**2, 1.5**2, 0.8, 300


def epochs(stream: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Counts and mean speed of each tumbling epoch; what is later than the watermark is dropped."""
    w = F.window("ts", f"{seconds} seconds")
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), "event_type", "n", "v")


def tracked(fixes: DataFrame) -> DataFrame:
    """fix, veh, s, v: a Kalman filter of distance and speed along each vehicle's run, in order of time; runs end after STALE seconds."""
    return folds.tracked(fixes, SNAP, SPEED, ACCEL, STALE)


def r_stream_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream, run to its end: every window, the newest too. Each batch's changed windows
    go to its own folder, written over if the batch runs twice; a window's last batch holds its whole count."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = stages.folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = epochs(stream, 3600).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n long, v double, batch long").parquet(f"{out}/rows")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "v"), "batch").alias("last"))
    return last.select("start", "event_type", "last.n", "last.v")


def r_tracked(spark: SparkSession, sf: str) -> DataFrame:
    return tracked(relation(spark, sf, "fixes").select("fix", "veh", "veh_ts", "dist", "speed"))


QUERIES = {"r_tracked": r_tracked, "r_stream_epochs": r_stream_epochs}
ORACLES: dict[str, str] = {}
