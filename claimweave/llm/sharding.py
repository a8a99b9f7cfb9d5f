"""Sharding (9): vector bin packing. Bytes, tokens and rows are balanced jointly: each group of equal texts goes to the shard where
the dot product of its size with the shard's residual capacity is highest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimweave.llm.common import materialise, table

#: A group of over 1/HEAVY of a shard in any dimension is packed by itself, lighter groups in BUCKETS hashed buckets a shard, each group
#: whole. So the driver packs at most 3 * HEAVY + BUCKETS vectors a shard, at any input size; where no group is lighter, groups alone.
HEAVY, BUCKETS = 1024, 192
#: A group of over a whole shard is split into pieces of about 1/PIECES of a shard.
PIECES = 8
#: A shard's slots are numbered in so many blocks, each by one task.
BLOCKS = 64
DIMS = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, n_shards: int) -> np.ndarray:
    """A shard for each row of items (sizes in each dimension), largest first, by the highest dot product with residual capacity.

    A shard in which an item would overrun the capacity of the first dimension takes it only if all would. Then items of the first
    dimension are moved from the fullest to the emptiest shard while that narrows their gap. Ties go to the lower shard.
    """
    where = np.zeros(len(items), int)
    if not len(items):
        return where
    size = items / np.maximum(items.sum(0), 1e-12) * n_shards  # in capacities
    free = np.ones((n_shards, size.shape[1]))
    for i in np.lexsort((np.arange(len(size)), -size.max(1))):
        score = free @ size[i]
        fits = free[:, 0] >= size[i, 0] - 1e-12
        k = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(free[:, 0]))
        where[i] = k
        free[k] -= size[i]
    for _ in range(min(4 * len(items), 256 * n_shards)):
        lo, hi = int(np.argmax(free[:, 0])), int(np.argmin(free[:, 0]))
        gap = free[lo, 0] - free[hi, 0]
        own = np.flatnonzero((where == hi) & (size[:, 0] < gap) & (size[:, 0] > 0))
        if not len(own):
            break
        i = own[np.argmin(np.abs(size[own, 0] - gap / 2))]
        if min(size[i, 0], gap - size[i, 0]) < 1e-6:
            break
        where[i] = lo
        free[hi] += size[i]
        free[lo] -= size[i]
    return where


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, tokens, shard, slot. Sizes in bytes of the shards are near equal.

    A row's size is its text's UTF-8 bytes (null: none) plus 8; tokens are its words between white space, about. Rows of equal text form a
    group that stays in one shard, unless it is larger than a shard in one of the three dimensions; then its rows are dealt into pieces by a hash of doc_id. A text
    larger than a shard's share stays whole. The result follows from the rows alone, however they are stored; repeated rows are rows of
    their own, and interchangeable. Null doc_ids are equal and come first. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
        (F.char_length(text) - F.char_length(F.translate(text, " \n", "")) + F.when(text != "", 1).otherwise(0)).cast("long").alias("tokens"),
    )
    rows = materialise(rows, "sizes")
    groups = materialise(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "groups")
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMS]).first()
    share = F.greatest(*[F.col(d) / max(1.0, (total[d] or 0) / n_shards) for d in DIMS])
    # Heavy groups are over 1/HEAVY of a shard in one of three dimensions, so there are at most 3 * n_shards * HEAVY of them.
    pieces = F.when((share > 1) & (F.col("rows") > 1), F.least(F.ceil(share * PIECES), F.col("rows"))).otherwise(1).cast("int")
    heavy = groups.where(share > 1 / HEAVY).select("grp", pieces.alias("pieces"))
    rows = rows.join(F.broadcast(heavy), "grp", "left")
    # A group, a piece of one or a bucket of groups is one item of the packing.
    spread = F.xxhash64("grp", F.pmod(F.xxhash64("doc_id", F.lit(3)), "pieces"))
    rows = rows.withColumn("item", F.when(F.col("pieces") > 1, spread).when(F.col("pieces") == 1, F.col("grp")).otherwise(F.pmod("grp", F.lit(n_shards * BUCKETS)))).drop("pieces")
    sizes = rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).orderBy("item").collect()
    where = pack(np.array([[r[d] for d in DIMS] for r in sizes], float).reshape(-1, len(DIMS)), n_shards)
    placed = docs.sparkSession.createDataFrame([(r["item"], int(k)) for r, k in zip(sizes, where, strict=True)], "item long, shard int")
    rows = rows.join(F.broadcast(placed), "item").withColumn("block", F.pmod(F.xxhash64("doc_id", "grp", F.lit(7)), F.lit(BLOCKS)).cast("int"))
    rows = materialise(rows.select("grp", "doc_id", "size", "text_crc32", "tokens", "shard", "block"), "placed")
    # Slots: a block's offset from the bounded table of block sizes, plus the place in the block.
    blocks = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("offset"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "grp")) - 1)
    return rows.join(F.broadcast(blocks), ["shard", "block"]).select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
