"""Metrics, coverage and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics_stats(log: DataFrame, since: str | None = None) -> DataFrame:
    """One row of totals over a metrics log (ts, event, duration_ms, read_bytes); values that aren't numbers count as 0."""
    if since is not None:
        log = log.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))

    def n(event: str):
        return F.count_if(F.col("event") == event)

    ms = F.sum(F.when(F.col("event") == "rederive", F.col("duration_ms").try_cast("double")))
    out = log.agg(
        F.count(F.lit(1)).alias("events"),
        n("cache_hit").alias("hits"),
        n("miss").alias("misses"),
        n("stale_detected").alias("stale_detected"),
        n("rederive").alias("rederive_count"),
        F.round(F.coalesce(ms, F.lit(0.0)), 3).alias("rederive_duration_ms_total"),
        F.coalesce(F.sum(F.col("read_bytes").try_cast("long")), F.lit(0)).alias("read_bytes"),
    )
    return out.withColumn("hit_rate", F.round(F.try_divide(F.col("hits").cast("double"), (F.col("hits") + F.col("misses") + F.col("stale_detected")).cast("double")), 6))


def resolution_coverage(edges: DataFrame) -> DataFrame:
    """language, relation_kind, resolved, unresolved, rate. edges: language, relation_kind, reason (null: resolved)."""
    out = edges.groupBy("language", "relation_kind").agg(F.count_if(F.col("reason").isNull()).alias("resolved"), F.count_if(F.col("reason").isNotNull()).alias("unresolved"))
    return out.withColumn("rate", F.round(F.col("resolved") / (F.col("resolved") + F.col("unresolved")), 6))


def unresolved_reasons(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("reason").isNotNull()).groupBy("language", "relation_kind", "reason").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall of rows with expected and actual; an empty denominator gives 1."""
    t = pairs.agg(F.count_if(F.col("expected") & F.col("actual")).alias("tp"), F.count_if(~F.col("expected") & F.col("actual")).alias("fp"), F.count_if(F.col("expected") & ~F.col("actual")).alias("fn"))
    one = F.lit(1.0)
    return t.withColumn("precision", F.round(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), one), 6)).withColumn("recall", F.round(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), one), 6))


def inventory_digest(rows: DataFrame, key: str, content: str, buckets: int = 256) -> DataFrame:
    """n, digest of a table, in the order of nothing: rows are hashed, rolled up by the first byte of the hash, and the bucket digests are
    put together in order. So no task and no string holds more than a bucket's hashes, sorted."""
    h = rows.select(F.sha2(F.concat_ws("\0", F.col(key).cast("string"), F.col(content)), 256).alias("h"))
    wide = h.select(F.substring("h", 1, 2).alias("b"), F.conv(F.substring("h", 3, 15), 16, 10).cast("decimal(38,0)").alias("x"), F.conv(F.substring("h", 18, 15), 16, 10).cast("decimal(38,0)").alias("y"))
    per = wide.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    one = F.concat_ws(":", "b", F.col("n").cast("string"), F.col("x").cast("string"), F.col("y").cast("string"))
    return per.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(one)), ","), 256).alias("digest"))  # at most 256 rows


def release_verdict(checks: DataFrame) -> DataFrame:
    """The worst of the verdicts GO, WARN and NO-GO."""
    level = F.when(F.col("value") > F.col("hard_limit"), 2).when(F.col("value") > F.col("target_limit"), 1).otherwise(0)
    return checks.groupBy("name").agg(F.max(level).alias("level")).select("name", F.element_at(F.array(F.lit("GO"), F.lit("WARN"), F.lit("NO-GO")), F.col("level") + 1).alias("verdict"))
