"""Queries of the rules and reports over claims, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.text import WORD
from claimweave.operators import review
from claimweave.plans.registry import query
from claimweave.sources.corpora import table

_SETS = ["main", "test", "unclassified", "integration"]


@query(
    "java_index_policy",
    "WITH f AS (SELECT 'src/' || p_partkey || '.java' AS path, list_extract(['main', 'test', 'unclassified', 'integration'], (p_partkey % 4 + 1)::INT) AS source_set, p_size % 10 = 0 AS generated FROM part) SELECT path, source_set, generated FROM f WHERE NOT generated AND source_set IN ('main', 'integration')",
)
def java_index_policy(spark: SparkSession, sf: str) -> DataFrame:
    sets = F.element_at(F.array(*map(F.lit, _SETS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    f = table(spark, sf, "part").select(F.format_string("src/%d.java", "p_partkey").alias("path"), sets.alias("source_set"), (F.col("p_size") % 10 == 0).alias("generated"))
    return review.indexed(f, {"generated": False, "test": False, "unclassified": False})


_SEMANTIC = ["semantic_depends_on", "semantic_calls", "semantic_uses_type"]


@query(
    "overlay_claims",
    """WITH k AS (SELECT o_orderkey AS k, 'claim_' || o_orderkey AS claim_id, CASE o_orderkey % 3 WHEN 0 THEN 'compiler-attributed' WHEN 1 THEN 'semantic-resolved' ELSE 'syntactic' END AS extraction_tier, CASE WHEN o_orderkey % 5 = 0 THEN 'semantic-resolved' END AS tier,
  CASE o_orderkey % 4 WHEN 0 THEN 'semantic_calls' WHEN 1 THEN 'calls' WHEN 2 THEN 'semantic_uses_type' END AS edge_kind, (o_orderkey % 10) / 10.0::DOUBLE AS confidence FROM orders)
SELECT claim_id, CASE WHEN extraction_tier = 'compiler-attributed' THEN extraction_tier ELSE 'semantic-resolved' END AS tier, edge_kind, 'attributed' AS evidence, round(least(confidence, 0.6), 6)::DOUBLE AS confidence FROM k
WHERE k % 7 <> 0 AND (extraction_tier <> 'syntactic' OR tier IS NOT NULL) AND (edge_kind IS NULL OR edge_kind <> 'calls')""",
)
def overlay_claims(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        k,
        F.concat(F.lit("claim_"), k.cast("string")).alias("claim_id"),
        F.when(k % 3 == 0, "compiler-attributed").when(k % 3 == 1, "semantic-resolved").otherwise("syntactic").alias("extraction_tier"),
        F.when(k % 5 == 0, "semantic-resolved").alias("tier"),
        F.when(k % 4 == 0, "semantic_calls").when(k % 4 == 1, "calls").when(k % 4 == 2, "semantic_uses_type").alias("edge_kind"),
        ((k % 10) / F.lit(10.0)).alias("confidence"),
    )
    return review.overlays(o, o.where("o_orderkey % 7 = 0"), _SEMANTIC).select("claim_id", "tier", "edge_kind", "evidence", F.round("confidence", 6).alias("confidence"))


@query("provenance_support", "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) SELECT doc_id, len(list_filter(ls, lambda x: contains(x, 'th') AND contains(x, 'er')))::BIGINT AS supported, len(ls)::BIGINT AS evidence FROM l")
def provenance_support(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"))
    return d.select("doc_id", F.size(review.supporting(F.col("ls"), F.array(F.lit("th"), F.lit("er")))).cast("long").alias("supported"), F.size("ls").cast("long").alias("evidence"))


@query(
    "provenance_items",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'https://t/' || o_orderkey ELSE 'p/' || o_orderkey END AS ref, 'p/' || o_orderkey AS path, 'docstring' AS type, o_orderpriority AS quoted FROM orders",
)
def provenance_items(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    item = F.struct(
        F.lit("docstring").alias("source_type"),
        F.when(k % 3 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).when(k % 3 == 1, "").alias("commit"),
        F.when(k % 3 == 1, F.concat(F.lit("https://t/"), k.cast("string"))).alias("url"),
        F.concat(F.lit("p/"), k.cast("string")).alias("path"),
        F.lit(1).alias("line_start"),
        F.lit(2).alias("line_end"),
        F.col("o_orderpriority").alias("text"),
    )
    o = table(spark, sf, "orders").select(k, review.provenance_items(F.array(item))[0].alias("i"))
    return o.select("o_orderkey", "i.ref", "i.path", "i.type", F.col("i.quoted_text_untrusted_data").alias("quoted"))


@query("embedding_texts", "SELECT p_partkey, coalesce(p_name, '') || ' ' || coalesce(p_type, '') || ' ' || array_to_string(string_split(p_name, ' '), ' ') || ' ' || coalesce(p_brand, '') AS text FROM part")
def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", review.embedding_text(F.col("p_name"), F.col("p_type"), F.split("p_name", " ", -1), F.col("p_brand")).alias("text"))


@query(
    "edges_without_end_kinds",
    "WITH e AS (SELECT 'src/O' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN '.java' ELSE '.py' END AS owner_path, CASE WHEN o_custkey % 2 = 0 THEN 'java' ELSE 'python' END AS language, CASE WHEN o_orderkey % 3 > 0 THEN 'method' END AS s, CASE WHEN o_orderkey % 5 > 0 THEN 'class' ELSE '' END AS t FROM orders) SELECT owner_path, count(*) AS claims FROM e WHERE language = 'java' AND (coalesce(s, '') = '' OR coalesce(t, '') = '') AND owner_path IN (SELECT 'src/O' || c_custkey || '.java' FROM customer WHERE c_custkey % 4 = 0) GROUP BY owner_path",
)
def edges_without_end_kinds(spark: SparkSession, sf: str) -> DataFrame:
    java = F.col("o_custkey") % 2 == 0
    e = table(spark, sf, "orders").select(F.concat(F.lit("src/O"), F.col("o_custkey").cast("string"), F.when(java, ".java").otherwise(".py")).alias("owner_path"), F.when(java, "java").otherwise("python").alias("language"), F.when(F.col("o_orderkey") % 3 > 0, "method").alias("source_node_kind"), F.when(F.col("o_orderkey") % 5 > 0, "class").otherwise("").alias("target_node_kind"))
    paths = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.format_string("src/O%d.java", "c_custkey").alias("path"))
    return review.without_end_kinds(e, paths)


@query(
    "merged_coverage",
    "WITH p AS (SELECT l_linestatus AS language, l_returnflag AS relation_kind, l_linenumber::BIGINT AS resolved, (l_linenumber % 3)::BIGINT AS unresolved FROM lineitem) SELECT language, relation_kind, sum(resolved)::BIGINT AS resolved, sum(unresolved)::BIGINT AS unresolved, round(sum(resolved)::DOUBLE / (sum(resolved) + sum(unresolved)), 6) AS resolution_rate FROM p GROUP BY ALL",
)
def merged_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return review.merged_coverage(table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("language"), F.col("l_returnflag").alias("relation_kind"), F.col("l_linenumber").cast("long").alias("resolved"), (F.col("l_linenumber") % 3).cast("long").alias("unresolved")))


@query("sanitiser_actions", "SELECT CASE WHEN toxic = 1 THEN 'drop_side_effect' ELSE 'keep' END AS action, CASE WHEN quality = 0 THEN 'unsupported' END AS reason, count(*) AS n FROM labels GROUP BY ALL")
def sanitiser_actions(spark: SparkSession, sf: str) -> DataFrame:
    return review.counted(table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "drop_side_effect").otherwise("keep").alias("action"), F.when(F.col("quality") == 0, "unsupported").alias("reason")), "action", "reason")


@query("contract_versions", "SELECT 'v' || (o_orderkey % 3) AS version, count(*) AS n FROM orders GROUP BY 1")
def contract_versions(spark: SparkSession, sf: str) -> DataFrame:
    return review.counted(table(spark, sf, "orders").select(F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")).alias("version")), "version")


_COUNT = " + ".join(f"(length(h) - length(replace(h, '{t}', ''))) // {len(t)}" for t in ("the", "ment", "token"))


@query("baseline_rank", f"WITH d AS (SELECT source || '/' || doc_id AS path, lower(source || '/' || doc_id || chr(10) || coalesce(text, '')) AS h FROM documents) SELECT path, ({_COUNT})::BIGINT AS score FROM d WHERE {_COUNT} > 0 ORDER BY score DESC, path LIMIT 20")
def baseline_rank(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    return review.by_occurrences(d, ["the", "ment", "token"], 20)


@query(
    "mean_recalls",
    "WITH r AS (SELECT l_orderkey AS task, l_linestatus AS category, CASE WHEN l_linenumber % 2 = 0 THEN 'index' ELSE 'grep' END AS strategy, (l_quantity::INT % 5) / 4.0::DOUBLE AS recall FROM lineitem), b AS (SELECT task, max(recall) AS high, min(recall) AS low FROM r GROUP BY task) SELECT category, strategy, count(*) AS tasks, round(avg(recall), 6) AS mean_recall, count(*) FILTER (WHERE recall = high AND high > low) AS wins, count(*) FILTER (WHERE recall < high) AS losses FROM r JOIN b USING (task) GROUP BY ALL",
)
def mean_recalls(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linestatus").alias("category"), F.when(F.col("l_linenumber") % 2 == 0, "index").otherwise("grep").alias("strategy"), ((F.col("l_quantity").cast("int") % 5) / F.lit(4.0)).alias("recall"))
    return review.mean_recalls(r)


@query("probe_choice", "SELECT source || '/' || doc_id AS path, strlen(coalesce(text, ''))::BIGINT AS size FROM documents WHERE doc_id % 2 = 1 AND NOT contains(coalesce(text, ''), 'the') ORDER BY size, path LIMIT 1")
def probe_choice(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    return review.probe(d, d.where("doc_id % 2 = 0"), "the")


@query(
    "query_intents",
    f"WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '') || CASE turn WHEN 0 THEN ' where' WHEN 1 THEN ' persists' ELSE '' END), '{WORD}')) AS w FROM conversations) SELECT conv_id, turn, list_has_any(w, ['declare', 'declares', 'declared', 'source', 'where', 'which']) AS declaration_intent, list_has_any(w, ['repository', 'repositories', 'persists', 'persistence']) AS repository_intent FROM t",
)
def query_intents(spark: SparkSession, sf: str) -> DataFrame:
    more = F.when(F.col("turn") == 0, " where").when(F.col("turn") == 1, " persists").otherwise("")
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower(F.concat(F.coalesce("text", F.lit("")), more)), F.lit(WORD), F.lit(0)).alias("terms"))
    return t.select("conv_id", "turn", *review.intents(F.col("terms")))


@query(
    "ordered_gaps",
    "WITH g AS (SELECT l_orderkey AS query, l_linestatus AS gap, min(l_linenumber) AS first_at FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL) SELECT query, string_agg(gap, ',' ORDER BY first_at, gap) AS gaps FROM g GROUP BY query",
)
def ordered_gaps(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("at"), F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("gap"))
    return review.gaps_of(r, "query", "at", "gap").select("query", F.array_join("gaps", ",").alias("gaps"))


@query(
    "renamed_bodies",
    """SELECT c_custkey, '{"path":"lib/p' || c_custkey || '.py","note":"see p' || c_custkey || '.py","deep":[{"lib/p' || c_custkey || '.py":["lib/p' || c_custkey || '.py",1]}]}' AS body FROM customer""",
)
def renamed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    old = F.format_string("p%d.py", "c_custkey")
    body = F.concat(F.lit('{"path":"'), old, F.lit('","note":"see '), old, F.lit('","deep":[{"'), old, F.lit('":["'), old, F.lit('",1]}]}'))
    return table(spark, sf, "customer").select("c_custkey", review.renamed(body, old, F.concat(F.lit("lib/"), old)).alias("body"))


@query(
    "explained_edges",
    "WITH e AS (SELECT 'customer:' || o_custkey AS s, 'order:' || o_orderkey AS t FROM orders), a AS (SELECT s, list_sort(list_distinct(list(t))) AS ts FROM e GROUP BY s) SELECT 'customer:' || c_custkey AS node_id, array_to_string(list_concat(['order:0'], coalesce(list_filter(ts, lambda x: x <> 'order:0'), [])), ',') AS callees, 0::BIGINT AS callers FROM customer LEFT JOIN a ON s = 'customer:' || c_custkey",
)
def explained_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node_id"), F.array(F.lit("order:0")).alias("callees"), F.lit(None).cast("array<string>").alias("callers"))
    edges = table(spark, sf, "orders").select(F.lit("calls").alias("relation_kind"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("target_id"))
    return review.with_fresh_edges(nodes, edges).select("node_id", F.array_join("callees", ",").alias("callees"), F.size("callers").cast("long").alias("callers"))
