"""Incremental warm as a stream of files: each micro-batch appends its manifest rows; the latest row of a path counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.ids import git_blob
from claimweave.tables import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def manifest(files: DataFrame) -> DataFrame:
    return files.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), git_blob(F.coalesce("text", F.lit(""))).alias("blob"))


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # the driver's tables are single files or folders of parts
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out")

    manifest(source).writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("path").agg(F.max_by("blob", "batch").alias("blob"))
