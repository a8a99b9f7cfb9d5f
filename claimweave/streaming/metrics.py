"""The metrics log as a stream: hourly counts by event time, with a watermark for what comes late."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.tables import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """window_start, event, n, total by tumbling hours. State is kept for the hours that the watermark hasn't passed."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), F.col("event_type").alias("event"), "n", "total")


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over what is there, in update mode, and returns the latest row of each window."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1000).parquet(sf_dir)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out")

    hourly(source).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy("window_start", "event").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("window_start", "event", "x.n", "x.total")
