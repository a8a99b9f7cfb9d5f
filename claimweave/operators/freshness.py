"""Freshness: does what a claim was bound to still have the hash that was stored?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JAVA_VERSION = "java.derive.v8"


def expected_version(path: Column) -> Column:
    return F.when(path.endswith(".java"), JAVA_VERSION)


def fresh_nodes(nodes: DataFrame) -> DataFrame:
    """Ids of nodes that are there and unchanged."""
    return nodes.where(F.col("current_hash") == F.col("stored_hash")).select("node_id")


def binding_states(bindings: DataFrame, files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Each binding (claim_id, path, file_blob, and for symbols qualname, node_kind, fn_hash) with `stale`: its reason or null.

    files: path, blob as they are now. symbols: path, qualname, node_kind, hash as they are now; a binding of a symbol is fresh if any of
    its namesakes has the stored hash (overloads share a name). A binding whose file is unchanged needs no symbol.
    """
    now = files.select(F.col("path").alias("now_path"), F.col("blob").alias("now_blob"))
    b = bindings.join(now, F.col("path") == F.col("now_path"), "left")
    missing, same = F.col("now_path").isNull(), F.col("file_blob").eqNullSafe(F.col("now_blob"))
    if symbols is None:
        return b.withColumn("stale", F.when(missing, F.concat("path", F.lit(": missing"))).when(~same, F.concat("path", F.lit(": file blob changed")))).drop("now_path", "now_blob")
    s = symbols.select(F.col("path").alias("s_path"), F.col("qualname").alias("s_name"), F.col("node_kind").alias("s_kind"), F.col("hash").alias("s_hash")).distinct()
    on = (F.col("path") == F.col("s_path")) & (F.col("qualname") == F.col("s_name")) & (F.col("node_kind") == F.col("s_kind")) & (F.col("fn_hash") == F.col("s_hash"))
    b = b.join(s, on, "left")
    stale = (
        F.when(missing, F.concat("path", F.lit(": missing")))
        .when(F.col("fn_hash").isNull() & ~same, F.concat("path", F.lit(": file blob changed")))
        .when(F.col("fn_hash").isNull() | same, None)
        .when(F.col("s_hash").isNull(), F.concat("path", F.lit(":"), "qualname", F.lit(": symbol hash changed")))
    )
    return b.withColumn("stale", stale).drop("now_path", "now_blob", "s_path", "s_name", "s_kind", "s_hash")


def claim_freshness(claims: DataFrame, states: DataFrame) -> DataFrame:
    """claim_id, fresh, stale_reasons. A claim without bindings is fresh; a version that differs from the expected one makes it stale."""
    per = states.groupBy("claim_id").agg(F.sort_array(F.collect_set("stale")).alias("reasons"))
    out = claims.join(per, "claim_id", "left")
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    if "derivation_version" in claims.columns:
        want = expected_version(F.col("path"))
        bad = want.isNotNull() & ~want.eqNullSafe(F.col("derivation_version"))
        reasons = F.when(bad, F.concat(F.array(F.lit("derivation version mismatch")), reasons)).otherwise(reasons)
    return out.select("claim_id", (F.size(reasons) == 0).alias("fresh"), reasons.alias("stale_reasons"))


def edge_freshness(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """edges with `fresh`: both ends are."""
    a, b = fresh.select(F.col("node_id").alias("source_id"), F.lit(True).alias("fa")), fresh.select(F.col("node_id").alias("target_id"), F.lit(True).alias("fb"))
    return edges.join(a, "source_id", "left").join(b, "target_id", "left").withColumn("fresh", F.coalesce("fa", F.lit(False)) & F.coalesce("fb", F.lit(False))).drop("fa", "fb")


def fresh_edges(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    out = edges
    for end in ("source_id", "target_id"):
        out = out.join(fresh.select(F.col("node_id").alias(end)), end, "left_semi")
    return out
