"""Helpers that the training-data operators share: tables, text normalisation, cut lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, NumericType, StringType, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of ASCII-lowered text: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows that a broadcast table of a few narrow columns may have (tens of MB); beyond that a shuffled join is used.
BROADCAST_ROWS = 500_000
#: Bytes that a broadcast table may have, by the lengths of its values.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where a local session names none (tests), a temporary one is set and removed at exit;
    a cluster must name one, since executors don't see the driver's disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="claimweave-shared-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later plans start from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(kind: DataType, value: Column) -> Column:
    """Bytes of a value in memory, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        own = F.coalesce(F.size(value), F.lit(0))
        return 16 + (own * 8 if isinstance(kind.elementType, NumericType) else F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(0), lambda a, x: a + width(kind.elementType, x)))
    if isinstance(kind, StructType):
        return reduce(lambda a, f: a + width(f.dataType, value[f.name]), kind.fields, F.lit(16))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, hinted as a broadcast side if it has at most so many rows and bytes; otherwise left to a shuffled join. df should be materialised."""
    if all(f.dataType.simpleString() in ("int", "bigint", "boolean", "double") for f in df.schema):
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    own = reduce(lambda a, f: a + width(f.dataType, F.col(f"`{f.name}`")), df.schema.fields, F.lit(16))
    n, held = df.select(own.cast("long").alias("w")).limit(rows + 1).agg(F.count("w"), F.sum("w")).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def same_row(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    cond = a[names[0]].eqNullSafe(b[names[0]])
    for n in names[1:]:
        cond &= a[n].eqNullSafe(b[n])
    return cond
