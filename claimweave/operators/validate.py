"""Audits: constraint queries that return what breaks a rule, and scores against gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators.aggregate import precision_recall
from claimweave.operators.graph import edge_endpoints

CAPS = (("attributed", 0.6), ("inferred", 0.6))


def invariants(claims: DataFrame) -> DataFrame:
    """claim_id, rule of every violation: caps by evidence, confidence in range, bindings of nodes, ends of edges, model claims."""
    rules = [F.when((F.col("evidence") == e) & (F.col("confidence") > cap), f"{e}_confidence_above_{cap}") for e, cap in CAPS]
    rules += [
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence_out_of_range"),
        F.when(F.col("edge_kind").isNull() & (F.size("bindings") == 0) & ~F.col("scope").isin("config", "api"), "node_without_binding"),
        F.when(F.col("edge_kind").isNotNull() & ~F.col("edge_kind").startswith("declares_") & (F.col("source_id").isNull() | F.col("target_id").isNull()), "edge_without_end"),
        F.when((F.col("provenance") == "model") & (F.col("evidence") == "observed") & (F.col("confidence") > 0.6), "model_claim_above_cap"),
    ]
    return claims.select("claim_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def unsupported(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Observed claims whose first keywords aren't all in their file any more."""
    c = claims.where("evidence = 'observed' and keywords is not null and scope in ('function', 'class', 'declaration')").join(files.select(F.col("path").alias("owner_path"), "text"), "owner_path")
    return c.where(~F.forall(F.slice("keywords", 1, 8), lambda k: F.contains(F.col("text"), k))).select("claim_id", "owner_path")


def low_confidence_is_anchored(claims: DataFrame) -> DataFrame:
    """Claims of low confidence that name no place to look."""
    return claims.where("confidence < 0.5 and edge_kind is null and (bindings is null or size(bindings) = 0)").select("claim_id")


def production_audit(claims: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: claims, stale, dangling ends of edges."""
    nodes = claims.where("edge_kind is null").select(F.col("claim_id").alias("endpoint"))
    edges = claims.where("edge_kind is not null and source_id is not null and target_id is not null and edge_kind not in ('reads_env', 'publishes_to', 'subscribes_to')").select(F.col("claim_id").alias("edge_id"), F.col("edge_kind").alias("relation_kind"), "source_id", "target_id")
    lost = edge_endpoints(edges).join(nodes, "endpoint", "left_anti").count()
    return fresh.agg(F.count(F.lit(1)).alias("claims"), F.count_if(~F.col("fresh")).alias("stale")).withColumn("dangling", F.lit(lost).cast("long"))


def expected_stale(claims: DataFrame, path: str, line: int) -> DataFrame:
    """Claims that an edit behind a line of a path must make stale: nodes around it, the file's own, and edges at those nodes."""
    b = claims.select("claim_id", "scope", F.explode("bindings").alias("b"))
    nodes = b.where((F.col("b.path") == path) & ((F.col("scope") == "file") | ((F.col("b.line_start") <= line) & (F.col("b.line_end") > line)))).select("claim_id").distinct()
    at = nodes.select(F.col("claim_id").alias("end"))
    edges = claims.where("edge_kind is not null").select("claim_id", F.explode(F.array("source_id", "target_id")).alias("end")).join(at, "end", "left_semi").select("claim_id")
    return nodes.union(edges).distinct()


def stale_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall of ids that are stale against those that should be."""
    e, a = expected.select("claim_id", F.lit(True).alias("e")), actual.select("claim_id", F.lit(True).alias("a"))
    both = e.join(a, "claim_id", "full_outer").select(F.coalesce("e", F.lit(False)).alias("expected"), F.coalesce("a", F.lit(False)).alias("actual"))
    return precision_recall(both)


def golden(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Recall of golden symbols (task, path, qualname) among answers, by category."""
    hit = gold.join(answers.select("task", "path", "qualname").distinct().withColumn("hit", F.lit(1)), ["task", "path", "qualname"], "left")
    per = hit.groupBy("category", "task").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
    return per.groupBy("category").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg("recall"), 6).alias("mean_recall"))


def runtime_boundaries(edges: DataFrame) -> DataFrame:
    """Topics that different nodes publish and subscribe to: topic_id, publishers, subscribers, only_publishers, only_subscribers."""
    own = edges.where(F.col("relation_kind").isin("publishes_to", "subscribes_to"))
    per = own.groupBy("target_id", "source_id").agg(F.max((F.col("relation_kind") == "publishes_to").cast("int")).alias("p"), F.max((F.col("relation_kind") == "subscribes_to").cast("int")).alias("s"))
    out = per.groupBy(F.col("target_id").alias("topic_id")).agg(F.sum("p").alias("publishers"), F.sum("s").alias("subscribers"), F.count_if((F.col("p") == 1) & (F.col("s") == 0)).alias("only_publishers"), F.count_if((F.col("s") == 1) & (F.col("p") == 0)).alias("only_subscribers"))
    return out.where("publishers > 0 and subscribers > 0 and only_publishers + only_subscribers > 0")
