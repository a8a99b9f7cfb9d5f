"""Claim corpora over the driver's tables: a graph of nodes and relations, documents as files, events as a metrics log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.ids import git_blob, hashed_id, stable_id
from claimweave.functions.text import WORD

TOPICS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(kind + ":"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _relation(df: DataFrame, kind: str, source: tuple[str, str | Column], target: tuple[str, str | Column], relation: str | None = None, distinct: bool = False) -> DataFrame:
    """The relations between a kind of node with a key and another; keys are made distinct before they are named, since they are shorter."""
    key = lambda k: F.col(k) if isinstance(k, str) else k
    df = df.select(key(source[1]).alias("s"), key(target[1]).alias("t"))
    df = df.distinct() if distinct else df
    return df.select(F.lit(kind).alias("relation_kind"), _node(source[0], "s").alias("source_id"), _node(target[0], "t").alias("target_id"), F.lit(relation).cast("string").alias("relation"))


def edge_identity() -> Column:
    """The id of an edge, by its kind's preimage."""
    a, b = F.col("source_id"), F.col("target_id")
    topic = F.substring_index(b, ":", -1)
    kind = F.col("relation_kind")
    return (
        F.when(kind == "calls", stable_id("calls", a, b))
        .when(kind == "reads", stable_id("reads", a, b))
        .when(kind == "writes", stable_id("writes", a, b))
        .when(kind == "inherits", stable_id("inherits", F.col("relation"), a, b))
        .when(kind == "uses_type", stable_id("uses_type", F.col("relation"), a, b))
        .when(kind == "publishes_to", stable_id("publishes_to", a, topic))
        .when(kind == "subscribes_to", stable_id("subscribes_to", a, topic))
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation_kind, source_id, target_id, relation (sub-kind): edges without their ids, for what makes few of them or makes them last."""
    t = lambda n: table(spark, sf_dir, n)
    item, events = t("lineitem"), t("events")
    topic = F.pmod("event_id", F.lit(TOPICS))
    parts = [
        _relation(t("orders"), "calls", ("customer", "o_custkey"), ("order", "o_orderkey")),
        _relation(item, "reads", ("order", "l_orderkey"), ("part", "l_partkey"), distinct=True),
        _relation(item.where("l_returnflag = 'R'"), "writes", ("order", "l_orderkey"), ("supplier", "l_suppkey"), distinct=True),
        _relation(t("nation"), "inherits", ("nation", "n_nationkey"), ("region", "n_regionkey"), "extends"),
        _relation(t("customer"), "inherits", ("customer", "c_custkey"), ("nation", "c_nationkey"), "implements"),
        _relation(t("supplier"), "inherits", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "implements"),
        _relation(t("part"), "uses_type", ("part", "p_partkey"), ("brand", "p_brand"), "field"),
        _relation(events.where("event_type in ('click', 'view')"), "publishes_to", ("user", "user_id"), ("topic", topic), distinct=True),
        _relation(events.where("event_type = 'purchase'"), "subscribes_to", ("user", "user_id"), ("topic", topic), distinct=True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, relation_kind, source_id, target_id, relation (sub-kind)."""
    return relations(spark, sf_dir).withColumn("edge_id", edge_identity())


EDGES_SQL = r"""
rel AS (
  SELECT 'calls' AS relation_kind, 'customer:' || o_custkey AS source_id, 'order:' || o_orderkey AS target_id, NULL::VARCHAR AS relation FROM orders
  UNION ALL SELECT DISTINCT 'reads', 'order:' || l_orderkey, 'part:' || l_partkey, NULL FROM lineitem
  UNION ALL SELECT DISTINCT 'writes', 'order:' || l_orderkey, 'supplier:' || l_suppkey, NULL FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 'inherits', 'nation:' || n_nationkey, 'region:' || n_regionkey, 'extends' FROM nation
  UNION ALL SELECT 'inherits', 'customer:' || c_custkey, 'nation:' || c_nationkey, 'implements' FROM customer
  UNION ALL SELECT 'inherits', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'implements' FROM supplier
  UNION ALL SELECT 'uses_type', 'part:' || p_partkey, 'brand:' || p_brand, 'field' FROM part
  UNION ALL SELECT DISTINCT 'publishes_to', 'user:' || user_id, 'topic:' || (event_id % 16), NULL FROM events WHERE event_type IN ('click', 'view')
  UNION ALL SELECT DISTINCT 'subscribes_to', 'user:' || user_id, 'topic:' || (event_id % 16), NULL FROM events WHERE event_type = 'purchase'
), edges AS (
  SELECT *, CASE relation_kind
    WHEN 'calls' THEN 'claim_edge_' || substr(sha256(source_id || chr(0) || target_id), 1, 16)
    WHEN 'reads' THEN 'claim_read_edge_' || substr(sha256('reads' || chr(0) || source_id || chr(0) || target_id), 1, 16)
    WHEN 'writes' THEN 'claim_write_edge_' || substr(sha256('writes' || chr(0) || source_id || chr(0) || target_id), 1, 16)
    WHEN 'inherits' THEN 'claim_inherit_edge_' || substr(sha256('inherits' || chr(0) || relation || chr(0) || source_id || chr(0) || target_id), 1, 16)
    WHEN 'uses_type' THEN 'claim_type_use_edge_' || substr(sha256('uses_type' || chr(0) || relation || chr(0) || source_id || chr(0) || target_id), 1, 16)
    WHEN 'publishes_to' THEN 'claim_topic_pub_edge_' || substr(sha256('publishes_to' || chr(0) || source_id || chr(0) || split_part(target_id, ':', 2)), 1, 16)
    WHEN 'subscribes_to' THEN 'claim_topic_sub_edge_' || substr(sha256('subscribes_to' || chr(0) || source_id || chr(0) || split_part(target_id, ':', 2)), 1, 16)
  END AS edge_id FROM rel
)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, scope, qualname, path, stored_hash, current_hash (null: gone): what the relations may point to.

    One node in 13 has changed since it was stored and one part in 17 is gone, so that freshness and dangling ends have work.
    """
    t = lambda n: table(spark, sf_dir, n)
    kinds = [
        (t("customer"), "customer", "c_custkey", "function"),
        (t("orders"), "order", "o_orderkey", "function"),
        (t("part").where("p_partkey % 17 <> 0"), "part", "p_partkey", "declaration"),
        (t("supplier"), "supplier", "s_suppkey", "declaration"),
        (t("nation"), "nation", "n_nationkey", "class"),
        (t("region"), "region", "r_regionkey", "class"),
        (t("part").select("p_brand").distinct(), "brand", "p_brand", "class"),
        (t("events").select("user_id").distinct(), "user", "user_id", "function"),
        (t("events").select(F.pmod("event_id", F.lit(TOPICS)).alias("k")).distinct(), "topic", "k", "api"),
    ]
    out = None
    for df, kind, key, scope in kinds:
        one = df.select(_node(kind, key).alias("node_id"), F.lit(scope).alias("scope"))
        out = one if out is None else out.unionByName(one)
    kind, key = F.substring_index("node_id", ":", 1), F.substring_index("node_id", ":", -1)
    stored = F.sha2("node_id", 256)
    return out.select(
        "node_id",
        "scope",
        F.concat_ws(".", kind, key).alias("qualname"),
        F.concat(F.lit("src/"), kind, F.lit("/"), F.substring(F.md5("node_id"), 1, 2), F.lit(".py")).alias("path"),
        stored.alias("stored_hash"),
        F.when(F.conv(F.substring(F.md5("node_id"), 1, 4), 16, 10).cast("int") % 13 == 0, F.sha2(F.concat("node_id", F.lit("!")), 256)).otherwise(stored).alias("current_hash"),
    )


NODES_SQL = r"""
node0 AS (
  SELECT 'customer:' || c_custkey AS node_id, 'function' AS scope FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'function' FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'declaration' FROM part WHERE p_partkey % 17 <> 0
  UNION ALL SELECT 'supplier:' || s_suppkey, 'declaration' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'class' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'class' FROM region
  UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'class' FROM part
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'function' FROM events
  UNION ALL SELECT DISTINCT 'topic:' || (event_id % 16), 'api' FROM events
), nodes AS (
  SELECT node_id, scope, replace(node_id, ':', '.') AS qualname,
         'src/' || split_part(node_id, ':', 1) || '/' || substr(md5(node_id), 1, 2) || '.py' AS path, sha256(node_id) AS stored_hash,
         CASE WHEN ('0x' || substr(md5(node_id), 1, 4))::INT % 13 = 0 THEN sha256(node_id || '!') ELSE sha256(node_id) END AS current_hash
  FROM node0
)"""


def stored_files(spark: SparkSession, sf_dir: str, deal: Callable[..., DataFrame] | None = None) -> DataFrame:
    """The stored snapshot of documents as files: doc_id, path, text, blob. deal: how rows are spread over tasks, if at all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    d = (deal(d, "doc_id") if deal else d).select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text", git_blob(F.col("text")).alias("blob"))


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current snapshot: every seventh document edited, every eleventh deleted, every thirteenth moved."""
    d = stored_files(spark, sf_dir).where("doc_id % 11 <> 0")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nedited"))).otherwise(F.col("text"))
    path = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return d.select("doc_id", path.alias("path"), text.alias("text")).withColumn("blob", git_blob(F.col("text")))


FILES_SQL = r"""
stored AS (
  SELECT doc_id, source || '/' || doc_id AS path, coalesce(text, '') AS text, sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, '')) AS blob FROM documents
), cur0 AS (
  SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'edited' ELSE text END AS text FROM stored WHERE doc_id % 11 <> 0
), cur AS (SELECT *, sha1('blob ' || strlen(text) || chr(0) || text) AS blob FROM cur0)"""


def file_claims(spark: SparkSession, sf_dir: str, deal: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Claims of documents as files: claim_id, scope, path, qualname, name, node_kind, keywords, text, confidence, evidence."""
    d = stored_files(spark, sf_dir, deal)
    return d.select(
        "doc_id",
        stable_id("file", "path").alias("claim_id"),
        F.when(F.col("doc_id") % 5 == 0, "api").when(F.col("doc_id") % 5 == 1, "class").otherwise("file").alias("scope"),
        "path",
        F.concat_ws(".", F.substring_index("path", "/", 1), F.regexp_extract("text", WORD, 0)).alias("qualname"),
        F.lower(F.regexp_extract("text", WORD, 0)).alias("name"),
        F.when(F.col("doc_id") % 5 == 1, "class").alias("node_kind"),
        "text",
        "blob",
    )


CLAIMS_SQL = (
    FILES_SQL
    + r""", claims AS (
  SELECT doc_id, 'claim_file_' || substr(sha256(path), 1, 16) AS claim_id, CASE WHEN doc_id % 5 = 0 THEN 'api' WHEN doc_id % 5 = 1 THEN 'class' ELSE 'file' END AS scope, path,
         split_part(path, '/', 1) || '.' || regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]{2,}', 0) AS qualname, lower(regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]{2,}', 0)) AS name,
         CASE WHEN doc_id % 5 = 1 THEN 'class' END AS node_kind, text, blob FROM stored
)"""
)


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a metrics log: ts, event, duration_ms, read_bytes."""
    kind = F.col("event_type")
    event = F.when(kind == "view", "cache_hit").when(kind == "error", "stale_detected").when(kind == "signup", "miss").when(kind == "purchase", "rederive").otherwise("degrade_to_source")
    return table(spark, sf_dir, "events").select("ts", event.alias("event"), F.col("value").alias("duration_ms"), F.get_json_object("props", "$.k").alias("read_bytes"))


METRICS_SQL = r"""
log AS (
  SELECT ts, CASE event_type WHEN 'view' THEN 'cache_hit' WHEN 'error' THEN 'stale_detected' WHEN 'signup' THEN 'miss' WHEN 'purchase' THEN 'rederive' ELSE 'degrade_to_source' END AS event,
         value AS duration_ms, json_extract_string(props, '$.k') AS read_bytes FROM events
)"""

__all__ = ["edges", "nodes", "stored_files", "current_files", "file_claims", "metrics_log", "hashed_id"]
