"""Index tables over claims and edges, and their lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """relation_kind, endpoint, edge_id, endpoint_role: two rows an edge, from one pass over the edges."""
    ends = F.array(
        F.struct(F.col("source_id").alias("endpoint"), F.lit("source").alias("endpoint_role")),
        F.struct(F.col("target_id").alias("endpoint"), F.lit("target").alias("endpoint_role")),
    )
    return edges.select("relation_kind", "edge_id", F.inline(ends))


def exact_names(claims: DataFrame) -> DataFrame:
    """value, claim_id, kind: qualname, its last segment, and name."""
    rows = F.array(
        F.struct(F.col("qualname").alias("value"), F.lit("qualname").alias("kind")),
        F.struct(F.substring_index("qualname", ".", -1).alias("value"), F.lit("simple").alias("kind")),
        F.struct(F.col("name").alias("value"), F.lit("name").alias("kind")),
    )
    return claims.select("claim_id", F.inline(rows)).where(F.coalesce("value", F.lit("")) != "").distinct()


def binding_paths(claims: DataFrame) -> DataFrame:
    """value, claim_id for every path that a claim is bound to."""
    return claims.select(F.explode("bindings.path").alias("value"), "claim_id").where(F.col("value").isNotNull()).distinct()


def trigrams(claims: DataFrame) -> DataFrame:
    """The posting table of search texts: gram, claim_id. A term of three letters or more occurs only where all of its grams do."""
    n = F.char_length("search_text")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(F.col("search_text"), i, F.lit(3)))
    return claims.where(n >= 3).select("claim_id", F.explode(F.array_distinct(grams)).alias("gram"))


def lexical_candidates(claims: DataFrame, terms: list[str]) -> DataFrame:
    """Claims whose search text holds any term as a substring."""
    any_term = F.lit(False)
    for t in terms:
        any_term = any_term | F.contains("search_text", F.lit(t))
    return claims.where(any_term)


def names_at_path(names: DataFrame, paths: DataFrame, value: str, path: str | None = None) -> DataFrame:
    """Ids by exact name, of those at a path if one is given."""
    out = names.where(F.col("value") == value).select("claim_id")
    if path is not None:
        out = out.join(paths.where(F.col("value") == path).select("claim_id"), "claim_id")
    return out.distinct().orderBy("claim_id")


def edges_of(endpoints: DataFrame, endpoint: str, kinds: list[str], limit: int) -> DataFrame:
    """Edges that touch an endpoint in either role, by id."""
    hit = endpoints.where((F.col("endpoint") == endpoint) & F.col("relation_kind").isin(*kinds))
    return hit.select("edge_id").distinct().orderBy("edge_id").limit(limit)


def window_with_flag(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows by an order, with whether there were more: one row more is fetched to tell."""
    head = df.orderBy(*order).limit(limit + 1)
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows
    return ranked.withColumn("truncated", F.max("rank").over(Window.partitionBy()) > limit).where(F.col("rank") <= limit)


def resolved_names(names: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (value), with n_candidates and status: resolved, ambiguous or not_found. asked is the smaller side; its groups are combined before the shuffle."""
    hits = names.select("value", "claim_id").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("claim_id"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "not_found").when(n == 1, "resolved").otherwise("ambiguous")
    return asked.join(hits, "value", "left").select("value", n.alias("n_candidates"), status.alias("status"), F.when(n == 1, F.col("claim_id")).alias("claim_id"))


def status_rollup(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("relation_kind").agg(F.countDistinct("edge_id").alias("edges"), F.count(F.lit(1)).alias("endpoint_rows"))


def unique_only(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key stands alone. Counted first and joined, so that a hot key isn't gathered in a window."""
    alone = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return df.join(alone, list(keys), "left_semi")
