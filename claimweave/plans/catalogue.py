"""Queries of the operators over the driver's tables, each with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimweave.functions import numbers
from claimweave.functions.ids import git_blob, stable_id
from claimweave.functions.text import WORD, first_by_case, identifier_keywords, stems
from claimweave.operators import aggregate, freshness, graph, incremental, index, retrieve
from claimweave.plans.registry import query
from claimweave.sources import corpora as c
from claimweave.tables import settled, spread

G, N, FILES, CLAIMS, METRICS = c.EDGES_SQL, c.NODES_SQL, c.FILES_SQL, c.CLAIMS_SQL, c.METRICS_SQL
FRESH = N + ", fresh AS (SELECT node_id FROM nodes WHERE current_hash = stored_hash)"
ASK = "the loser under thing with ments booking tested"


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return c.edges(spark, sf), freshness.fresh_nodes(c.nodes(spark, sf))


# --- identities and texts -------------------------------------------------------------------------------------------------------------


@query("claim_ids", f"WITH {G} SELECT relation_kind, source_id, target_id, edge_id FROM edges")
def claim_ids(spark: SparkSession, sf: str) -> DataFrame:
    return c.edges(spark, sf).select("relation_kind", "source_id", "target_id", "edge_id")


@query("git_blob_ids", "SELECT doc_id, sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, '')) AS blob FROM documents")
def git_blob_ids(spark: SparkSession, sf: str) -> DataFrame:
    return c.table(spark, sf, "documents").select("doc_id", git_blob(F.coalesce("text", F.lit(""))).alias("blob"))


_STOP_SQL = "('the','and','for','from','with','return','class','def','import','const','let','var')"


@query(
    "keyword_extract",
    rf"""WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents)),
f AS (SELECT doc_id, word, pos, row_number() OVER (PARTITION BY doc_id, lower(word) ORDER BY pos) AS rn FROM w WHERE lower(word) NOT IN {_STOP_SQL}),
r AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM f WHERE rn = 1)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, word AS keyword FROM r WHERE pos <= 16""",
)
def keyword_extract(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.keywords_table(c.table(spark, sf, "documents"))


@query(
    "identifier_keywords",
    """WITH w AS (SELECT p_partkey, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT p_partkey, list_filter(string_split(replace(replace(p_brand || '.' || p_name || '_' || p_type, ' ', '_'), '.', '_'), '_'), lambda x: x <> '') AS ws FROM part)),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(word) ORDER BY pos) AS rn FROM w)
SELECT p_partkey, string_agg(word, ' ' ORDER BY pos) AS keywords FROM f WHERE rn = 1 GROUP BY p_partkey""",
)
def identifier_keywords_(spark: SparkSession, sf: str) -> DataFrame:
    name = F.translate(F.concat(F.col("p_brand"), F.lit("."), F.col("p_name"), F.lit("_"), F.col("p_type")), " ", "_")
    return c.table(spark, sf, "part").select("p_partkey", F.array_join(identifier_keywords(name), " ").alias("keywords"))


@query(
    "stem_terms",
    rf"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{WORD}'))) AS word FROM benchmark),
s AS (SELECT word, suffix, substr(word, 1, length(word) - length(suffix)) AS stem FROM w, (SELECT unnest(['ations','ation','ments','ment','ing','ers','er','ed','s']) AS suffix) WHERE ends_with(word, suffix) AND length(word) - length(suffix) >= 4),
a AS (SELECT word, word AS term FROM w UNION SELECT word, stem FROM s
      UNION SELECT word, substr(stem, 1, length(stem) - 1) FROM s WHERE suffix IN ('ing', 'ed') AND substr(stem, length(stem), 1) = substr(stem, length(stem) - 1, 1))
SELECT word, term FROM a""",
)
def stem_terms(spark: SparkSession, sf: str) -> DataFrame:
    words = c.table(spark, sf, "benchmark").select(F.explode(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lower)).alias("word")).distinct()
    return words.select("word", F.explode(stems(F.col("word"))).alias("term"))


@query(
    "observed_support",
    r"""WITH l AS (SELECT d.doc_id, d.text, list_slice(list_transform(string_split(p.p_name, ' '), lambda x: lower(x)), 1, 8) AS k, 0.6::DOUBLE AS c FROM documents d JOIN part p ON p.p_partkey = d.doc_id)
SELECT doc_id, len(list_filter(k, lambda x: NOT contains(lower(text), x))) = 0 AS supported,
       CASE WHEN len(list_filter(k, lambda x: NOT contains(lower(text), x))) = 0 THEN least(c, 0.45) ELSE least(c, 0.2) END::DOUBLE AS confidence FROM l""",
)
def observed_support(spark: SparkSession, sf: str) -> DataFrame:
    d = c.table(spark, sf, "documents").join(c.table(spark, sf, "part").select("p_partkey", "p_name"), F.col("doc_id") == F.col("p_partkey"))
    d = d.select("doc_id", F.lower("text").alias("hay"), F.slice(F.split(F.lower("p_name"), " "), 1, 8).alias("words"))
    ok = F.forall("words", lambda w: F.contains(F.col("hay"), w))
    return d.select("doc_id", ok.alias("supported"), numbers.observed_confidence(ok, F.lit(0.6)).alias("confidence"))


# --- retrieval ------------------------------------------------------------------------------------------------------------------------

_TERMS = retrieve.query_terms(ASK)
_HAY = "lower(concat_ws(' ', text, '', path, qualname, name))"
_BASE = r"regexp_replace(lower(split_part(path, '/', -1)), '(.)\.[^.]*$', '\1')"
_SCORE = " + ".join(f"(CASE WHEN contains(hay, '{t}') THEN 10 ELSE 0 END) + (CASE WHEN base = '{t}' OR last = '{t}' OR lower(name) = '{t}' THEN 35 ELSE 0 END)" for t in _TERMS)
_SCORED = f"""{CLAIMS}, h AS (SELECT *, {_HAY} AS hay, {_BASE} AS base, split_part(lower(qualname), '.', -1) AS last FROM claims),
scored AS (SELECT *, ({_SCORE} - CASE WHEN scope = 'api' THEN 8 ELSE 0 END)::BIGINT AS score FROM h WHERE {" OR ".join(f"contains(hay, '{t}')" for t in _TERMS)})"""
_DIVERSE = f"""{_SCORED}, pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, claim_id) AS rank FROM scored WHERE score <> 0 QUALIFY rank <= 60),
deep AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank) - 1 AS depth, min(rank) OVER (PARTITION BY path) AS path_rank FROM pool),
picked AS (SELECT *, row_number() OVER (ORDER BY depth, path_rank) AS place FROM deep QUALIFY place <= 10)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    # Paths are the sources alone, so that several claims share one and diversification has work.
    return c.file_claims(spark, sf, spread)


@query("lexical_candidates", f"WITH {_SCORED} SELECT doc_id, claim_id FROM scored")
def lexical_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return index.lexical_candidates(retrieve.with_search_text(_claims(spark, sf)), _TERMS).select("doc_id", "claim_id")


@query("lexical_score_topk", f"WITH {_SCORED} SELECT claim_id, path, score FROM scored WHERE score <> 0 ORDER BY score DESC, path, claim_id LIMIT 20")
def lexical_score_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.top(retrieve.scored(_claims(spark, sf), ASK), 20).select("claim_id", "path", "score")


@query("diversified_topk", f"WITH {_DIVERSE} SELECT claim_id, score, CAST(place AS BIGINT) AS place FROM picked")
def diversified_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.diversified(retrieve.scored(_claims(spark, sf), ASK), 10).select("claim_id", "score", F.col("place").cast("long").alias("place"))


@query(
    "retrieve_ranked",
    f"WITH {_DIVERSE} SELECT claim_id, picked.path, score, CAST(place AS BIGINT) AS place FROM picked JOIN cur ON cur.path = picked.path AND cur.blob = picked.blob",
)
def retrieve_ranked(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf)
    # Blobs are worked out of the answer's files only: ten rows, by which both snapshots are cut down before anything is hashed.
    best = settled(retrieve.diversified(retrieve.scored(claims, ASK), 10).select("claim_id", "path", "score", F.col("place").cast("long").alias("place")))
    stored = claims.join(F.broadcast(best.select("claim_id")), "claim_id", "left_semi").select("claim_id", "path", "blob")
    now = c.current_files(spark, sf).join(F.broadcast(best.select("path").distinct()), "path", "left_semi").select("path", F.col("blob").alias("now"))
    fresh = stored.join(now, "path").where(F.col("blob") == F.col("now"))
    return best.join(fresh.select("claim_id"), "claim_id", "left_semi").orderBy("place")


_BM = ["thing", "ment", "the"]
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(_BM))
_BM25 = " + ".join(f"ln(1 + (docs - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / length))" for i in range(len(_BM)))


@query(
    "bm25_candidates",
    f"WITH {CLAIMS}, s AS (SELECT claim_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM claims), t AS (SELECT claim_id, len(w) AS n, {_TF} FROM s), a AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS length, {', '.join(f'count(*) FILTER (WHERE t{i} > 0) AS d{i}' for i in range(len(_BM)))} FROM t) SELECT claim_id, round({_BM25}, 6) AS bm25 FROM t, a WHERE t0 + t1 + t2 > 0 ORDER BY bm25 DESC, claim_id LIMIT 500",
)
def bm25_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.bm25_candidates(_claims(spark, sf).withColumn("search_text", F.col("text")), _BM, 500)


@query("exact_name_lookup", f"WITH {CLAIMS} SELECT DISTINCT claim_id FROM claims WHERE name = 'the' OR qualname = 'the' OR split_part(qualname, '.', -1) = 'the'")
def exact_name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf).withColumn("bindings", F.array(F.struct("path")))
    return index.names_at_path(index.exact_names(claims), index.binding_paths(claims), "the")


@query(
    "name_at_path",
    f"WITH {CLAIMS} SELECT DISTINCT claim_id FROM claims WHERE (name = 'the' OR split_part(qualname, '.', -1) = 'The') AND path = (SELECT min(path) FROM claims WHERE name = 'the')",
)
def name_at_path(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf).withColumn("bindings", F.array(F.struct("path")))
    names = index.exact_names(claims).where(F.col("value").isin("the", "The")).select("claim_id")
    first = claims.where("name = 'the'").agg(F.min("path").alias("value"))
    at = index.binding_paths(claims).join(F.broadcast(first), "value", "left_semi").select("claim_id")  # one row
    return names.join(at, "claim_id").distinct()


@query(
    "name_resolution_status",
    f"""WITH {CLAIMS}, n AS (SELECT DISTINCT value, claim_id FROM (SELECT qualname AS value, claim_id FROM claims UNION ALL SELECT split_part(qualname, '.', -1), claim_id FROM claims UNION ALL SELECT name, claim_id FROM claims) WHERE value <> ''),
asked AS (SELECT DISTINCT lower(regexp_extract(text, '{WORD}', 0)) AS value FROM benchmark), k AS (SELECT value, count(*) AS n, min(claim_id) AS claim_id FROM n GROUP BY value)
SELECT asked.value, coalesce(n, 0) AS n_candidates, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN claim_id END AS claim_id FROM asked LEFT JOIN k ON k.value = asked.value""",
)
def name_resolution_status(spark: SparkSession, sf: str) -> DataFrame:
    asked = c.table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", WORD, 0)).alias("value")).distinct()
    return index.resolved_names(index.exact_names(_claims(spark, sf)), asked)


@query(
    "candidate_window",
    f"WITH {CLAIMS}, o AS (SELECT claim_id, row_number() OVER (ORDER BY claim_id) AS rank, count(*) OVER () AS n FROM claims) SELECT claim_id, CAST(rank AS BIGINT) AS rank, n > 256 AS truncated FROM o WHERE rank <= 256",
)
def candidate_window(spark: SparkSession, sf: str) -> DataFrame:
    return index.window_with_flag(_claims(spark, sf).select("claim_id"), ["claim_id"], 256).select("claim_id", F.col("rank").cast("long").alias("rank"), "truncated")


@query(
    "trigram_postings",
    f"WITH {CLAIMS}, h AS (SELECT claim_id, lower(concat_ws(' ', name, path)) AS s FROM claims), g AS (SELECT DISTINCT claim_id, substr(s, i, 3) AS gram FROM (SELECT claim_id, s, unnest(range(1, length(s) - 1)) AS i FROM h WHERE length(s) >= 3)) SELECT gram, count(*) AS postings FROM g GROUP BY gram",
)
def trigram_postings(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf).select("claim_id", F.lower(F.concat_ws(" ", "name", "path")).alias("search_text"))
    return index.trigrams(claims).groupBy("gram").agg(F.count(F.lit(1)).alias("postings"))


_COS = "SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query("embedding_topk", f"WITH s AS ({_COS}) SELECT vec_id, cosine FROM s WHERE cosine > 0 ORDER BY cosine DESC, vec_id LIMIT 20")
def embedding_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = c.table(spark, sf, "embeddings")
    return retrieve.vector_top(v, v.where("vec_id = 0"), 20)


@query(
    "embedding_with_neighbours",
    f"""WITH {G}, s AS ({_COS}), t AS (SELECT vec_id, cosine, row_number() OVER (ORDER BY cosine DESC, vec_id) AS seed_rank FROM s WHERE cosine > 0 QUALIFY seed_rank <= 10),
seeds AS (SELECT seed_rank, 'customer:' || (vec_id + 1) AS node_id FROM t)
SELECT CAST(seed_rank AS BIGINT) AS seed_rank, seeds.node_id, other FROM seeds JOIN (SELECT source_id AS node_id, target_id AS other FROM edges WHERE relation_kind IN ('calls', 'inherits') UNION ALL SELECT target_id, source_id FROM edges WHERE relation_kind IN ('calls', 'inherits')) e ON e.node_id = seeds.node_id""",
)
def embedding_with_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    v = c.table(spark, sf, "embeddings")
    seeds = retrieve.vector_top(v, v.where("vec_id = 0"), 10).withColumn("seed_rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "vec_id")).cast("long"))  # ten rows
    seeds = seeds.select("seed_rank", F.concat(F.lit("customer:"), (F.col("vec_id") + 1).cast("string")).alias("node_id"))
    near = graph.neighbours(c.edges(spark, sf).where(F.col("relation_kind").isin("calls", "inherits")), seeds)
    return near.join(seeds, "node_id").select("seed_rank", "node_id", "other")


@query(
    "retrieval_mrr",
    rf"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS terms FROM benchmark), w AS (SELECT item_id, unnest(terms) AS term FROM q),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{WORD}'))) AS term FROM documents WHERE doc_id < 1000000),
s AS (SELECT item_id, doc_id, count(*) AS score FROM w JOIN d USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
gold AS (SELECT item_id, doc_id FROM (SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)),
h AS (SELECT gold.item_id, min(rank) AS rank FROM gold LEFT JOIN r ON r.item_id = gold.item_id AND r.doc_id = gold.doc_id GROUP BY gold.item_id)
SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg((rank IS NOT NULL)::INT), 6) AS recall FROM h""",
)
def retrieval_mrr(spark: SparkSession, sf: str) -> DataFrame:
    b, d = c.table(spark, sf, "benchmark"), c.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def terms(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term"))

    asked = terms(b, "item_id")
    scores = terms(d, "doc_id").join(asked, "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    answers = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).where("rank <= 10")
    # Documents that hold an item whole hold all its terms: of those that the index finds, the smallest.
    size = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    gold = scores.join(size, "item_id").where(F.col("score") == F.col("size")).select("item_id", "doc_id").join(d, "doc_id").join(b.withColumnRenamed("text", "item"), "item_id").where(F.contains("text", F.col("item")))
    gold = gold.groupBy("item_id").agg(F.min("doc_id").alias("id"))
    return retrieve.reciprocal_ranks(answers.select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"), "rank"), gold.withColumnRenamed("item_id", "query"))


@query(
    "context_pack",
    f"WITH {_SCORED}, t AS (SELECT claim_id, score, path, length(text) AS n FROM scored WHERE score <> 0 ORDER BY score DESC, path, claim_id LIMIT 12), r AS (SELECT claim_id, CAST(sum(n) OVER (ORDER BY score DESC, path, claim_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM t) SELECT claim_id, used FROM r WHERE used <= 20000",
)
def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieve.top(retrieve.scored(_claims(spark, sf), ASK), 12).withColumn("n", F.char_length("text"))
    ordered = best.withColumn("order", F.row_number().over(Window.orderBy(F.desc("score"), "path", "claim_id")))  # twelve rows
    return retrieve.prefix_fit(ordered, 20000, ["order"], "n").select("claim_id", "used")


@query("context_greedy")
def context_greedy(spark: SparkSession, sf: str) -> DataFrame:
    best = retrieve.top(retrieve.scored(_claims(spark, sf), ASK), 12)
    return retrieve.packed(best.withColumn("order", -F.col("score")), 20000, ["order", "path", "claim_id"])


# --- edges, reverse lookups, graph ----------------------------------------------------------------------------------------------------

_ENDS = f"{G}, ends AS (SELECT relation_kind, source_id AS endpoint, edge_id, 'source' AS endpoint_role FROM edges UNION ALL SELECT relation_kind, target_id, edge_id, 'target' FROM edges)"


@query("edge_endpoints_index", f"WITH {_ENDS} SELECT relation_kind, endpoint, edge_id, endpoint_role FROM ends")
def edge_endpoints_index(spark: SparkSession, sf: str) -> DataFrame:
    return index.edge_endpoints(c.edges(spark, sf)).select("relation_kind", "endpoint", "edge_id", "endpoint_role")


@query("edge_lookup", f"WITH {_ENDS} SELECT DISTINCT edge_id FROM ends WHERE endpoint = 'supplier:1' AND relation_kind IN ('writes', 'inherits') ORDER BY edge_id LIMIT 128")
def edge_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return index.edges_of(index.edge_endpoints(c.edges(spark, sf)), "supplier:1", ["writes", "inherits"], 128)


@query("status_rollup", f"WITH {_ENDS} SELECT relation_kind, count(DISTINCT edge_id) AS edges, count(*) AS endpoint_rows FROM ends GROUP BY relation_kind")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return index.status_rollup(index.edge_endpoints(c.edges(spark, sf)))


#: Kinds that the tables have edges of; the others are looked up in relations derived from sources.
_OF_TABLES = ("callers", "readers", "writers", "subtypes", "implementors", "used_by_types", "topic_publishers", "topic_subscribers")


def _register_reverse(what: str) -> None:
    kind, relation = graph.REVERSE[what]
    cond = f"relation_kind = '{kind}'" + (f" AND relation = '{relation}'" if relation else "")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        edges, fresh = _graph(spark, sf)
        return graph.reverse(edges, fresh, edges.where(cond).select("target_id").distinct(), what)

    ends = "f AS MATERIALIZED (SELECT DISTINCT node_id FROM fresh), own AS MATERIALIZED (SELECT target_id, source_id, edge_id FROM edges WHERE " + cond + ")"
    query(f"reverse_{what}", f"WITH {G}, {FRESH}, {ends} SELECT own.* FROM own JOIN f t ON t.node_id = target_id JOIN f s ON s.node_id = source_id")(run)


for _what in _OF_TABLES:
    _register_reverse(_what)


@query("reverse_index", f"WITH {G} SELECT target_id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources, count(*) AS n FROM edges WHERE relation_kind = 'calls' GROUP BY target_id")
def reverse_index(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reverse_index(c.edges(spark, sf)).select("target_id", F.array_join("sources", ",").alias("sources"), "n")


@query(
    "adjacency_lists",
    f"WITH {G}, a AS (SELECT source_id AS node_id, relation_kind, 'out' AS direction, target_id AS other FROM edges UNION ALL SELECT target_id, relation_kind, 'in', source_id FROM edges) SELECT node_id, relation_kind, direction, count(*) AS n, min(other) AS first, max(other) AS last FROM a GROUP BY ALL",
)
def adjacency_lists(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency(c.edges(spark, sf))


@query(
    "topic_graph",
    f"WITH {G}, p AS (SELECT target_id, source_id, max((relation_kind = 'publishes_to')::INT) AS p, max((relation_kind = 'subscribes_to')::INT) AS s FROM edges WHERE relation_kind IN ('publishes_to', 'subscribes_to') GROUP BY ALL) SELECT target_id AS topic_id, sum(p)::BIGINT AS publishers, sum(s)::BIGINT AS subscribers, sum(p * s)::BIGINT AS both FROM p GROUP BY target_id",
)
def topic_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.topic_graph(c.edges(spark, sf))


@query(
    "shared_topics",
    f"WITH {G} SELECT p.target_id AS topic_id FROM (SELECT DISTINCT target_id FROM edges WHERE relation_kind = 'publishes_to') p JOIN (SELECT DISTINCT target_id FROM edges WHERE relation_kind = 'subscribes_to') s ON p.target_id = s.target_id",
)
def shared_topics(spark: SparkSession, sf: str) -> DataFrame:
    return graph.topic_graph(c.edges(spark, sf)).where("publishers > 0 and subscribers > 0").select("topic_id")


_WALK = ["calls", "writes", "inherits"]


def _walk_sql(hops: int) -> str:
    steps = [f"h0 AS (SELECT node_id, 0 AS hop FROM fresh WHERE node_id = 'customer:4'), s0 AS (SELECT * FROM h0)"]
    for i in range(1, hops + 1):
        steps.append(
            f"h{i} AS (SELECT DISTINCT p.b AS node_id, {i} AS hop FROM h{i - 1} JOIN pairs p ON p.a = h{i - 1}.node_id WHERE p.b IN (SELECT node_id FROM fresh) AND p.b NOT IN (SELECT node_id FROM s{i - 1})), s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM h{i})"
        )
    return f"{G}, {FRESH}, pairs AS (SELECT source_id AS a, target_id AS b FROM edges WHERE relation_kind IN ('calls', 'writes', 'inherits') UNION ALL SELECT target_id, source_id FROM edges WHERE relation_kind IN ('calls', 'writes', 'inherits')), " + ", ".join(steps)


def _entry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("customer:4",)], "node_id string")


def _register_walk(hops: int) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        edges, fresh = _graph(spark, sf)
        return graph.reached(edges, fresh, _entry(spark), _WALK, hops).select("node_id", F.col("hop").cast("long").alias("hop"))

    query(f"fragment_{hops}hop", f"WITH {_walk_sql(hops)} SELECT node_id, CAST(hop AS BIGINT) AS hop FROM s{hops}")(run)


for _hops in (1, 2, 4):
    _register_walk(_hops)


@query("boundary_nodes", f"WITH {_ENDS} SELECT DISTINCT endpoint AS node_id FROM ends WHERE relation_kind IN ('writes', 'publishes_to')")
def boundary_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.boundary_nodes(c.edges(spark, sf))


@query(
    "routing_shape",
    f"""WITH {_walk_sql(2)}, e AS (SELECT e.*, least(a.hop, b.hop) + 1 AS hop FROM edges e JOIN s2 a ON a.node_id = e.source_id JOIN s2 b ON b.node_id = e.target_id WHERE e.relation_kind IN ('calls', 'writes', 'inherits')),
k AS (SELECT hop, count(DISTINCT n) AS next_hop_count FROM (SELECT hop, source_id AS n FROM e UNION ALL SELECT hop, target_id FROM e) GROUP BY hop)
SELECT CAST(e.hop AS BIGINT) AS hop, count(*) AS edges, min(next_hop_count) AS next_hop_count, CASE WHEN min(next_hop_count) = 1 THEN 'single' ELSE 'branching' END AS shape, false AS async_handoff, false AS polymorphic FROM e JOIN k ON k.hop = e.hop GROUP BY e.hop""",
)
def routing_shape(spark: SparkSession, sf: str) -> DataFrame:
    edges, fresh = _graph(spark, sf)
    seen = graph.reached(edges, fresh, _entry(spark), _WALK, 2)
    return graph.hop_shapes(edges, seen, _WALK).withColumn("hop", F.col("hop").cast("long"))


@query("bounded_fragment")
def bounded_fragment(spark: SparkSession, sf: str) -> DataFrame:
    edges, fresh = _graph(spark, sf)
    out = graph.bounded_fragment(edges, fresh, "customer:4", _WALK, 2, stop=graph.BOUNDARY)
    return spark.createDataFrame([(out["entry"], h["hop"], len(h["edges"]), h["shape"], out["stop_reason"], out["coverage"]) for h in out["hops"]], "entry string, hop long, edges long, shape string, stop_reason string, coverage string")


@query(
    "fresh_neighbours",
    f"WITH {G}, {FRESH}, f AS (SELECT * FROM edges WHERE source_id IN (SELECT node_id FROM fresh) AND target_id IN (SELECT node_id FROM fresh) AND relation_kind IN ('calls', 'inherits', 'publishes_to', 'subscribes_to')) SELECT source_id AS node_id, 'out' AS direction, target_id AS other FROM f WHERE source_id IN ('customer:4', 'nation:3') UNION ALL SELECT target_id, 'in', source_id FROM f WHERE target_id IN ('customer:4', 'nation:3')",
)
def fresh_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    edges, fresh = _graph(spark, sf)
    own = edges.where(F.col("relation_kind").isin("calls", "inherits", "publishes_to", "subscribes_to") & (F.col("source_id").isin("customer:4", "nation:3") | F.col("target_id").isin("customer:4", "nation:3")))
    asked = spark.createDataFrame([("customer:4",), ("nation:3",)], "node_id string")
    return graph.neighbours(freshness.fresh_edges(own, fresh), asked).select("node_id", "direction", "other")


@query("dangling_endpoints", f"WITH {_ENDS}, {N} SELECT edge_id, endpoint_role, endpoint FROM ends WHERE endpoint NOT IN (SELECT node_id FROM nodes)")
def dangling_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dangling(c.relations(spark, sf), c.nodes(spark, sf), c.edge_identity())


@query("uniqueness_gate", f"WITH {FILES} SELECT doc_id, blob FROM stored WHERE blob IN (SELECT blob FROM stored GROUP BY blob HAVING count(*) = 1)")
def uniqueness_gate(spark: SparkSession, sf: str) -> DataFrame:
    return index.unique_only(c.stored_files(spark, sf).select("doc_id", "blob"), "blob").select("doc_id", "blob")


# --- freshness and incremental --------------------------------------------------------------------------------------------------------


@query(
    "freshness_file",
    f"WITH {CLAIMS} SELECT c.claim_id, cur.path IS NOT NULL AND cur.blob = c.blob AS fresh, CASE WHEN cur.path IS NULL THEN c.path || ': missing' WHEN cur.blob <> c.blob THEN c.path || ': file blob changed' ELSE '' END AS reasons FROM claims c LEFT JOIN cur ON cur.path = c.path",
)
def freshness_file(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf).select("claim_id", "path", "blob")
    states = freshness.binding_states(claims.withColumnRenamed("blob", "file_blob"), c.current_files(spark, sf))
    return freshness.claim_freshness(claims, states).select("claim_id", "fresh", F.array_join("stale_reasons", ";").alias("reasons"))


@query("freshness_edges", f"WITH {G}, {FRESH} SELECT edge_id, source_id IN (SELECT node_id FROM fresh) AND target_id IN (SELECT node_id FROM fresh) AS fresh FROM edges")
def freshness_edges(spark: SparkSession, sf: str) -> DataFrame:
    return freshness.edge_freshness(c.relations(spark, sf), freshness.fresh_nodes(c.nodes(spark, sf))).select(c.edge_identity().alias("edge_id"), "fresh")


@query(
    "freshness_versions",
    f"""WITH {CLAIMS}, v AS (SELECT c.claim_id, CASE WHEN doc_id % 2 = 0 THEN path || '.java' ELSE path || '.py' END AS p, 'java.derive.v' || (7 + doc_id % 3) AS version FROM claims c)
SELECT claim_id, NOT (ends_with(p, '.java') AND version <> 'java.derive.v8') AS fresh FROM v""",
)
def freshness_versions(spark: SparkSession, sf: str) -> DataFrame:
    claims = _claims(spark, sf).select("claim_id", F.concat("path", F.when(F.col("doc_id") % 2 == 0, ".java").otherwise(".py")).alias("path"), F.concat(F.lit("java.derive.v"), (7 + F.col("doc_id") % 3).cast("string")).alias("derivation_version"), F.col("blob").alias("file_blob"))
    files = claims.select("path", F.col("file_blob").alias("blob"))
    return freshness.claim_freshness(claims, freshness.binding_states(claims.select("claim_id", "path", "file_blob"), files)).select("claim_id", "fresh")


@query(
    "manifest_diff",
    f"WITH {FILES} SELECT coalesce(s.path, c.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN s.blob <> c.blob THEN 'changed' ELSE 'same' END AS status FROM stored s FULL JOIN cur c ON s.path = c.path",
)
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.manifest_diff(c.stored_files(spark, sf), c.current_files(spark, sf)).select("path", "status")




@query(
    "changed_functions_manifest",
    f"WITH {FILES}, a AS (SELECT path, 'f' || (doc_id % 3) AS qualname, blob FROM stored), b AS (SELECT path, 'f' || (doc_id % 3) AS qualname, blob FROM cur) SELECT coalesce(a.path, b.path) AS path, coalesce(a.qualname, b.qualname) AS qualname, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path AND a.qualname = b.qualname WHERE a.path IS NULL OR b.path IS NULL OR a.blob <> b.blob",
)
def changed_functions_manifest(spark: SparkSession, sf: str) -> DataFrame:
    def fns(d: DataFrame) -> DataFrame:
        return d.select("path", F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("qualname"), F.col("blob").alias("fn_hash"))

    return incremental.symbol_changes(fns(c.stored_files(spark, sf)), fns(c.current_files(spark, sf))).select("path", "qualname", "status")


_RENAMES = f"""{FILES}, gone AS (SELECT blob, min(path) AS old_path FROM stored WHERE path NOT IN (SELECT path FROM cur) GROUP BY blob HAVING count(*) = 1),
new AS (SELECT blob, min(path) AS new_path FROM cur WHERE path NOT IN (SELECT path FROM stored) GROUP BY blob HAVING count(*) = 1), moves AS (SELECT old_path, new_path, gone.blob FROM gone JOIN new ON gone.blob = new.blob)"""


@query("rename_detect", f"WITH {_RENAMES} SELECT old_path, new_path, blob FROM moves")
def rename_detect(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.renames(c.stored_files(spark, sf), c.current_files(spark, sf))


@query("rename_rebind_ids", f"WITH {_RENAMES} SELECT old_path, new_path, 'claim_file_' || substr(sha256(old_path), 1, 16) AS old_id, 'claim_file_' || substr(sha256(new_path), 1, 16) AS new_id FROM moves")
def rename_rebind_ids(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.rebound_ids(incremental.renames(c.stored_files(spark, sf), c.current_files(spark, sf)))


@query("tombstones", f"WITH {FILES} SELECT 'claim_file_' || substr(sha256(path), 1, 16) AS claim_id FROM stored WHERE path NOT IN (SELECT path FROM cur)")
def tombstones(spark: SparkSession, sf: str) -> DataFrame:
    ids = [d.select(stable_id("file", "path").alias("claim_id")) for d in (c.stored_files(spark, sf), c.current_files(spark, sf))]
    return incremental.tombstones(*ids)


_OWNED = f"{G}, {N}, owned AS (SELECT e.*, n.path AS owner_path FROM edges e JOIN nodes n ON n.node_id = e.source_id)"


@query(
    "reconcile_edges",
    f"WITH {_OWNED} SELECT edge_id, owner_path FROM owned WHERE owner_path LIKE 'src/order/0%' AND ('0x' || substr(md5(edge_id), 1, 4))::INT % 5 = 0",
)
def reconcile_edges(spark: SparkSession, sf: str) -> DataFrame:
    owners = c.nodes(spark, sf).where("path like 'src/order/0%'").select(F.col("node_id").alias("source_id"), F.col("path").alias("source_path"))
    # of the paths' own relations only are the ids made
    stored = c.relations(spark, sf).join(owners, "source_id").withColumn("owner_path", incremental.owner_path(F.col("relation_kind"), F.col("source_path"), F.lit(None).cast("string"))).withColumn("edge_id", c.edge_identity())
    derived = stored.where(F.conv(F.substring(F.md5("edge_id"), 1, 4), 16, 10).cast("int") % 5 != 0)
    paths = owners.select(F.col("source_path").alias("path"))
    return incremental.reconcile_edges(stored, derived, paths).select("edge_id", "owner_path")


@query(
    "claim_upsert",
    f"WITH {FILES}, a AS (SELECT 'claim_file_' || substr(sha256(path), 1, 16) AS claim_id, blob FROM stored), b AS (SELECT 'claim_file_' || substr(sha256(path), 1, 16) AS claim_id, blob FROM cur) SELECT * FROM a WHERE claim_id NOT IN (SELECT claim_id FROM b) UNION ALL SELECT * FROM b",
)
def claim_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, new = (d.select(stable_id("file", "path").alias("claim_id"), "blob") for d in (c.stored_files(spark, sf), c.current_files(spark, sf)))
    return incremental.upsert(old, new)


@query(
    "dependent_owners",
    f"""WITH {G}, {N}, b AS (SELECT e.edge_id AS claim_id, s.path AS owner_path, x.path FROM edges e JOIN nodes s ON s.node_id = e.source_id JOIN nodes t ON t.node_id = e.target_id, LATERAL (SELECT unnest([s.path, t.path]) AS path) x WHERE e.relation_kind IN ('inherits', 'writes')),
changed AS (SELECT DISTINCT path FROM nodes WHERE path LIKE 'src/nation/%' OR path LIKE 'src/supplier/0%')
SELECT DISTINCT owner_path AS path FROM b WHERE claim_id IN (SELECT claim_id FROM b WHERE path IN (SELECT path FROM changed)) AND claim_id IN (SELECT claim_id FROM b WHERE path <> owner_path) AND owner_path NOT IN (SELECT path FROM changed)""",
)
def dependent_owners(spark: SparkSession, sf: str) -> DataFrame:
    n = c.nodes(spark, sf)
    at = lambda end, name: n.select(F.col("node_id").alias(end), F.col("path").alias(name))
    e = c.edges(spark, sf).where(F.col("relation_kind").isin("inherits", "writes")).join(at("source_id", "owner_path"), "source_id").join(at("target_id", "target_path"), "target_id")
    bindings = e.select(F.col("edge_id").alias("claim_id"), "owner_path", F.explode(F.array("owner_path", "target_path")).alias("path"))
    changed = n.where("path like 'src/nation/%' or path like 'src/supplier/0%'").select("path").distinct()
    return incremental.dependents(bindings, changed)


@query(
    "module_prefix_match",
    """WITH p AS (SELECT DISTINCT regexp_extract(url, '://(.*)$', 1) AS path FROM pages), m AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM p UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE split_part(path, '/', 2) IN ('en', 'fr'))
SELECT p.path, arg_max('module:' || m.root, length(m.root)) AS module FROM p JOIN m ON p.path = m.root OR starts_with(p.path, m.root || '/') GROUP BY p.path""",
)
def module_prefix_match(spark: SparkSession, sf: str) -> DataFrame:
    p = c.table(spark, sf, "pages").select(F.regexp_extract("url", "://(.*)$", 1).alias("path")).distinct()
    one = p.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root"))
    two = p.where(F.split_part("path", F.lit("/"), F.lit(2)).isin("en", "fr")).select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("root"))
    modules = one.union(two).distinct().withColumn("module", F.concat(F.lit("module:"), "root"))
    return incremental.module_of(p, modules)


@query(
    "anchor_containment",
    """WITH a AS (SELECT 'o' || (o_orderkey % 50) AS path, o_orderkey AS anchor_id, o_custkey % 400 AS line_start, o_custkey % 400 + o_orderkey % 90 AS line_end FROM orders),
p AS (SELECT DISTINCT 'o' || (l_orderkey % 50) AS path, l_partkey % 500 AS line FROM lineitem WHERE l_linenumber = 1)
SELECT p.path, p.line, count(*) AS anchors, min(anchor_id) AS first_anchor FROM p JOIN a ON a.path = p.path AND p.line BETWEEN a.line_start AND a.line_end GROUP BY ALL""",
)
def anchor_containment(spark: SparkSession, sf: str) -> DataFrame:
    o = c.table(spark, sf, "orders")
    anchors = o.select(F.concat(F.lit("o"), (F.col("o_orderkey") % 50).cast("string")).alias("path"), F.col("o_orderkey").alias("anchor_id"), (F.col("o_custkey") % 400).alias("line_start"), (F.col("o_custkey") % 400 + F.col("o_orderkey") % 90).alias("line_end"))
    points = c.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("o"), (F.col("l_orderkey") % 50).cast("string")).alias("path"), (F.col("l_partkey") % 500).alias("line")).distinct()
    return incremental.anchored(points, anchors).groupBy("path", "line").agg(F.count(F.lit(1)).alias("anchors"), F.min("anchor_id").alias("first_anchor"))


# --- aggregates, trust, projections ---------------------------------------------------------------------------------------------------

_STATS = """count(*) AS events, count(*) FILTER (WHERE event = 'cache_hit') AS hits, count(*) FILTER (WHERE event = 'miss') AS misses, count(*) FILTER (WHERE event = 'stale_detected') AS stale_detected,
count(*) FILTER (WHERE event = 'rederive') AS rederive_count, round(coalesce(sum(duration_ms) FILTER (WHERE event = 'rederive'), 0), 3) AS rederive_duration_ms_total, coalesce(sum(try_cast(read_bytes AS BIGINT)), 0)::BIGINT AS read_bytes,
round(count(*) FILTER (WHERE event = 'cache_hit')::DOUBLE / nullif(count(*) FILTER (WHERE event IN ('cache_hit', 'miss', 'stale_detected')), 0), 6) AS hit_rate"""


@query("metrics_stats", f"WITH {METRICS} SELECT {_STATS} FROM log")
def metrics_stats(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.metrics_stats(c.metrics_log(spark, sf))


@query("metrics_since", f"WITH {METRICS} SELECT {_STATS} FROM log WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def metrics_since(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.metrics_stats(c.metrics_log(spark, sf), "2024-01-10 00:00:00")


_REASON = "CASE WHEN ('0x' || substr(md5(edge_id), 1, 4))::INT % 7 = 0 THEN 'ambiguous_type' WHEN ('0x' || substr(md5(edge_id), 1, 4))::INT % 11 = 0 THEN 'dynamic_call_not_resolved' END"


def _reasoned(spark: SparkSession, sf: str) -> DataFrame:
    h = F.conv(F.substring(F.md5("edge_id"), 1, 4), 16, 10).cast("int")
    language = F.when(F.col("relation_kind").isin("calls", "reads", "writes"), "python").otherwise("java")
    return c.edges(spark, sf).select("relation_kind", language.alias("language"), F.when(h % 7 == 0, "ambiguous_type").when(h % 11 == 0, "dynamic_call_not_resolved").alias("reason"))


_REASONED = f"{G}, r AS (SELECT relation_kind, CASE WHEN relation_kind IN ('calls', 'reads', 'writes') THEN 'python' ELSE 'java' END AS language, {_REASON} AS reason FROM edges)"


@query("resolution_coverage", f"WITH {_REASONED} SELECT language, relation_kind, count(*) FILTER (WHERE reason IS NULL) AS resolved, count(*) FILTER (WHERE reason IS NOT NULL) AS unresolved, round(count(*) FILTER (WHERE reason IS NULL)::DOUBLE / count(*), 6) AS rate FROM r GROUP BY ALL")
def resolution_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.resolution_coverage(_reasoned(spark, sf))


@query("unresolved_reasons", f"WITH {_REASONED} SELECT language, relation_kind, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL")
def unresolved_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.unresolved_reasons(_reasoned(spark, sf))


@query(
    "precision_recall",
    f"WITH {FILES}, x AS (SELECT s.doc_id % 7 = 0 OR s.doc_id % 11 = 0 AS expected, c.path IS NULL OR c.blob <> s.blob AS actual FROM stored s LEFT JOIN cur c ON c.path = s.path), t AS (SELECT count(*) FILTER (WHERE expected AND actual) AS tp, count(*) FILTER (WHERE NOT expected AND actual) AS fp, count(*) FILTER (WHERE expected AND NOT actual) AS fn FROM x) SELECT tp, fp, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 1), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 1), 6) AS recall FROM t",
)
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    now = c.current_files(spark, sf).select("path", F.col("blob").alias("now"))
    x = c.stored_files(spark, sf).join(now, "path", "left").select(((F.col("doc_id") % 7 == 0) | (F.col("doc_id") % 11 == 0)).alias("expected"), (~F.col("blob").eqNullSafe(F.col("now"))).alias("actual"))
    return aggregate.precision_recall(x)


@query("inventory_digest")
def inventory_digest(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.inventory_digest(c.stored_files(spark, sf), "path", "blob")


_CASES = """SELECT l.doc_id, l.quality, l.toxic, CASE l.doc_id % 4 WHEN 0 THEN 'usage' WHEN 1 THEN 'verified' WHEN 2 THEN 'falsified' ELSE 'hunch' END AS kind, (l.doc_id % 100) / 100.0::DOUBLE AS confidence,
CASE WHEN quality = 1 THEN 'observed' WHEN l.doc_id % 5 = 0 THEN 'verified' ELSE 'inferred' END AS evidence, CASE WHEN l.doc_id % 9 = 0 THEN 'reviewer' END AS endorsed_by,
CASE l.doc_id % 5 WHEN 0 THEN 'source_support_literal' WHEN 1 THEN 'attributed_external_provenance' WHEN 2 THEN 'intent_requires_external_provenance' WHEN 3 THEN 'unsupported_or_unverifiable' END AS verification,
toxic = 1 AS is_foreign, l.doc_id % 7 <> 0 AS fresh, CASE WHEN l.doc_id % 2 = 0 THEN 'source-verifiable' ELSE 'intent-needs-provenance' END AS evidence_class FROM labels l"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda n, *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (i % n + 1).cast("int"))
    return c.table(spark, sf, "labels").select(
        "doc_id",
        pick(4, "usage", "verified", "falsified", "hunch").alias("kind"),
        ((i % 100) / F.lit(100.0)).alias("confidence"),
        F.when(F.col("quality") == 1, "observed").when(i % 5 == 0, "verified").otherwise("inferred").alias("evidence"),
        F.when(i % 9 == 0, "reviewer").alias("endorsed_by"),
        pick(5, "source_support_literal", "attributed_external_provenance", "intent_requires_external_provenance", "unsupported_or_unverifiable", None).alias("verification"),
        (F.col("toxic") == 1).alias("is_foreign"),
        (i % 7 != 0).alias("fresh"),
        F.when(i % 2 == 0, "source-verifiable").otherwise("intent-needs-provenance").alias("evidence_class"),
    )


@query(
    "confidence_policy",
    f"""WITH x AS ({_CASES}) SELECT doc_id, round(CASE kind WHEN 'verified' THEN greatest(confidence, 0.75) WHEN 'falsified' THEN least(confidence, 0.15) WHEN 'hunch' THEN least(confidence, 0.3) ELSE confidence END, 6)::DOUBLE AS after_feedback,
round(CASE WHEN evidence_class = 'source-verifiable' AND fresh THEN least(greatest(confidence, 0.4), 0.6) WHEN evidence_class = 'intent-needs-provenance' AND is_foreign THEN least(greatest(confidence, 0.35), 0.6) WHEN evidence_class = 'intent-needs-provenance' THEN least(confidence, 0.25) ELSE least(confidence, 0.2) END, 6)::DOUBLE AS as_candidate FROM x""",
)
def confidence_policy(spark: SparkSession, sf: str) -> DataFrame:
    x = _cases(spark, sf)
    return x.select("doc_id", F.round(numbers.feedback_confidence(F.col("kind"), F.col("confidence")), 6).alias("after_feedback"), F.round(numbers.candidate_confidence(F.col("evidence_class"), F.col("fresh"), F.col("is_foreign"), F.col("confidence")), 6).alias("as_candidate"))


_LEVEL = """CASE WHEN is_foreign THEN 'unverified_foreign' WHEN evidence = 'verified' THEN 'hard_verified' WHEN coalesce(endorsed_by, '') <> '' THEN 'endorsed' WHEN evidence = 'observed' AND verification = 'source_support_literal' THEN 'source_observed'
WHEN evidence = 'observed' THEN 'observed' WHEN verification = 'attributed_external_provenance' THEN 'attributed' WHEN verification = 'intent_requires_external_provenance' THEN 'unsupported_intent' WHEN coalesce(verification, 'none') IN ('unsupported_or_unverifiable', 'none') THEN 'unsupported' ELSE 'unknown' END"""
_HINT = """CASE WHEN NOT fresh THEN 'degrade_to_source_or_rederive' WHEN level IN ('hard_verified', 'endorsed', 'source_observed', 'observed') THEN 'can_use_with_source_anchor_for_precision' WHEN level = 'attributed' THEN 'use_as_attributed_context_verify_behavior_in_source'
WHEN level IN ('unsupported_intent', 'unsupported') THEN 'treat_as_hint_read_source_before_acting' ELSE 'inspect_manually' END"""


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).withColumn("level", numbers.trust_level(F.col("is_foreign"), F.col("evidence"), F.col("endorsed_by"), F.col("verification")))


@query("trust_label", f"WITH x AS ({_CASES}) SELECT doc_id, {_LEVEL} AS level FROM x")
def trust_label(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("doc_id", "level")


@query("action_hint", f"WITH x AS ({_CASES}), l AS (SELECT *, {_LEVEL} AS level FROM x) SELECT doc_id, {_HINT} AS hint FROM l")
def action_hint(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("doc_id", numbers.action_hint(F.col("fresh"), F.col("level")).alias("hint"))


@query(
    "thin_view",
    f"""WITH x AS ({_CASES}), l AS (SELECT *, {_LEVEL} AS level FROM x) SELECT doc_id, level, {_HINT} AS action_hint, fresh, CASE WHEN is_foreign THEN 0.0 ELSE confidence END::DOUBLE AS confidence,
array_to_string(list_filter([CASE WHEN is_foreign THEN 'UNVERIFIED_FOREIGN' END, CASE WHEN NOT fresh THEN 'STALE_BUT_STORED' END, CASE WHEN level IN ('hard_verified', 'endorsed') THEN 'HIGH_TRUST_IS_NOT_SOURCE' END, CASE WHEN level IN ('unsupported_intent', 'unsupported') THEN 'LOW_SUPPORT' END], lambda w: w IS NOT NULL), ',') AS warnings FROM l""",
)
def thin_view(spark: SparkSession, sf: str) -> DataFrame:
    x = _levels(spark, sf)
    return x.select("doc_id", "level", numbers.action_hint(F.col("fresh"), F.col("level")).alias("action_hint"), "fresh", F.when(F.col("is_foreign"), 0.0).otherwise(F.col("confidence")).alias("confidence"), F.array_join(numbers.warnings(F.col("is_foreign"), F.col("fresh"), F.col("level"), F.lit(False)), ",").alias("warnings"))


# --- configuration and declarations in texts ------------------------------------------------------------------------------------------


@query("json_config_flatten", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, sha256(json_extract_string(props, '$.k')) AS config_hash FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_config_flatten(spark: SparkSession, sf: str) -> DataFrame:
    e = c.table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).where(F.col("value").isNotNull())
    return e.select("event_id", "key", "value", F.sha2("value", 256).alias("config_hash"))


@query(
    "sql_declarations",
    r"""WITH t AS (SELECT p_partkey, 'create ' || CASE WHEN p_partkey % 2 = 0 THEN 'table' ELSE 'VIEW' END || CASE WHEN p_partkey % 3 = 0 THEN ' if not exists ' ELSE ' ' END || replace(p_name, ' ', '_') || ' (a int);' AS s FROM part)
SELECT p_partkey, 'sql_' || lower(regexp_extract(s, '(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][A-Za-z0-9_$.]*)', 1)) AS declaration_kind, regexp_extract(s, '(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][A-Za-z0-9_$.]*)', 2) AS qualname,
sha256(regexp_extract(s, '(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][A-Za-z0-9_$.]*)', 0)) AS declaration_hash FROM t WHERE regexp_matches(s, '(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][A-Za-z0-9_$.]*)')""",
)
def sql_declarations(spark: SparkSession, sf: str) -> DataFrame:
    from claimweave.operators.extract.sql import declarations

    i = F.col("p_partkey")
    text = F.concat(F.lit("create "), F.when(i % 2 == 0, "table").otherwise("VIEW"), F.when(i % 3 == 0, " if not exists ").otherwise(" "), F.translate("p_name", " ", "_"), F.lit(" (a int);"))
    out = declarations(c.table(spark, sf, "part").select(F.concat(i.cast("string"), F.lit(".sql")).alias("path"), text.alias("text")))
    return out.select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("p_partkey"), "declaration_kind", "qualname", "declaration_hash")


@query(
    "event_listener_join",
    """WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'view')), t AS (SELECT 'listener:' || event_type AS listener, event_type, count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events))
SELECT s.user_id, t.listener, s.event_type FROM s JOIN t ON t.event_type = s.event_type AND t.n = 1""",
)
def event_listener_join(spark: SparkSession, sf: str) -> DataFrame:
    e = c.table(spark, sf, "events").select("user_id", "event_type").distinct()
    listeners = index.unique_only(e.select("event_type").distinct().select(F.concat(F.lit("listener:"), "event_type").alias("listener"), "event_type"), "event_type")
    return e.where(F.col("event_type").isin("click", "view")).join(listeners, "event_type").select("user_id", "listener", "event_type")


__all__ = ["first_by_case"]
