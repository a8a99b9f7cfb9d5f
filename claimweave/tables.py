"""Tables in the folder that a cluster's executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where a local session names none (tests), a temporary one that goes at exit. A cluster must
    name one, since executors don't see the driver's disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="claimweave-shared-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def spread(files: DataFrame, *keys: str) -> DataFrame:
    """files dealt by the hash of their keys, for work that is far more than reading them, if their scan has fewer tasks than cores: large
    tables are read by tasks enough, and stay as they are."""
    spark = files.sparkSession
    scan = files._jdf.queryExecution().sparkPlan().toString()
    want = 2 * spark.sparkContext.defaultParallelism
    if not any(x in scan for x in ("Join", "Aggregate", "Exchange", "Window")) and files.rdd.getNumPartitions() >= want:
        return files
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), want), *keys)


def settled(df: DataFrame) -> DataFrame:
    """df written once and read back, so that what it numbered or drew at random stays as it is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
