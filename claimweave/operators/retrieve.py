"""Ranked retrieval: lexical scores, diversification by path, vectors, context packing, and its measures."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimweave.functions.numbers import cosine
from claimweave.functions.text import STOP, WORD, lexical_score, query_terms, search_text, text_words
from claimweave.operators.index import lexical_candidates
from claimweave.session import ship

POOL = 6  #: times the limit that diversification looks at


def keywords_table(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 16) -> DataFrame:
    """key, pos (from 1), keyword: the first spellings of the distinct words of a text, stop words aside.

    Words are made distinct by case within the row before anything is exploded, so that a shuffle carries few rows a text.
    """
    low = F.transform("words", lambda w: F.lower(w))
    d = docs.select(F.col(key), text_words(F.coalesce(F.col(text), F.lit(""))).alias("words")).select(key, "words", low.alias("low"))
    d = d.select(key, "words", "low", F.slice(F.array_except(F.array_distinct("low"), F.array(*map(F.lit, STOP))), 1, limit).alias("kept"))
    return d.select(key, "words", "low", F.posexplode("kept").alias("i", "k")).select(key, (F.col("i") + 1).cast("long").alias("pos"), F.get("words", (F.array_position("low", F.col("k")) - 1).cast("int")).alias("keyword"))


def with_search_text(claims: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    words = F.col("keywords") if "keywords" in claims.columns else none
    return claims.withColumn("search_text", search_text(F.col("text"), words, F.col("path"), F.col("qualname"), F.col("name")))


def scored(claims: DataFrame, query: str) -> DataFrame:
    """claims (claim_id, text, path, qualname, name, node_kind, scope) with a score above 0."""
    terms = query_terms(query)
    hits = lexical_candidates(with_search_text(claims), terms)
    s = lexical_score(terms, F.col("search_text"), F.col("path"), F.col("qualname"), F.col("name"), F.col("node_kind"), F.col("scope"))
    return hits.withColumn("score", s.cast("long")).where(F.col("score") != 0)


#: Saturation of a term's count, weight of a text's length, and how many candidates are kept.
K1, LENGTH, MOST = 1.2, 0.75, 2000


def bm25_candidates(claims: DataFrame, terms: list[str], limit: int = MOST, key: str = "claim_id") -> DataFrame:
    """The claims (with search_text) that rank highest by BM25 over whole words: key, bm25. Two passes: one row of counts over all claims, then the
    scores. Ties go by key; claims without any term aren't candidates."""
    words = F.regexp_extract_all(F.lower("search_text"), F.lit(WORD), F.lit(0))
    t = claims.select(key, words.alias("w")).select(key, F.size("w").alias("n"), *[F.size(F.filter("w", _is(q))).alias(f"t{i}") for i, q in enumerate(terms)])
    total = t.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("length"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"t{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        weight = math.log(1 + (total["docs"] - total[f"t{i}"] + 0.5) / (total[f"t{i}"] + 0.5))
        score = score + weight * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - LENGTH + LENGTH * F.col("n") / (total["length"] or 1.0)))
    return t.withColumn("bm25", F.round(score, 6)).where("bm25 > 0").select(key, "bm25").orderBy(F.desc("bm25"), key).limit(limit)


def _is(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def top(claims: DataFrame, limit: int) -> DataFrame:
    return claims.orderBy(F.desc("score"), "path", "claim_id").limit(limit)


def diversified(claims: DataFrame, limit: int) -> DataFrame:
    """Round-robin over paths: of the best POOL * limit, the first of each path in the order of the paths' bests, then the seconds, and so on."""
    pool = top(claims, max(limit * POOL, limit))  # bounded from here on
    order = Window.orderBy(F.desc("score"), "path", "claim_id")
    pool = pool.withColumn("rank", F.row_number().over(order))
    own = F.when(F.coalesce("path", F.lit("")) == "", F.concat(F.lit("@"), "claim_id")).otherwise(F.col("path"))
    pool = pool.withColumn("depth", F.row_number().over(Window.partitionBy(own).orderBy("rank")) - 1).withColumn("path_rank", F.min("rank").over(Window.partitionBy(own)))
    picked = pool.orderBy("depth", "path_rank").limit(limit)
    return picked.withColumn("place", F.row_number().over(Window.orderBy("depth", "path_rank")))


def retrieve(claims: DataFrame, fresh: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The ranked, diversified answer. Stale claims are left out after diversification, and not made up for."""
    return diversified(scored(claims, query), limit).join(fresh.select("claim_id"), "claim_id", "left_semi").orderBy("place")


def vector_top(vectors: DataFrame, query: DataFrame, limit: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The nearest vectors to one query row (q), by cosine above 0. The single query row is broadcast."""
    one = F.broadcast(query.select(F.col(vector).alias("q")).limit(1))
    near = vectors.join(one, F.lit(True)).withColumn("cosine", F.round(cosine(F.col(vector), F.col("q")), 6)).where(F.col("cosine") > 0)
    return near.select(key, "cosine").orderBy(F.desc("cosine"), key).limit(limit)


def reciprocal_ranks(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """answers (query, id, rank), gold (query, id): queries, mean reciprocal rank, recall."""
    hit = gold.join(answers, ["query", "id"], "left").groupBy("query").agg(F.min("rank").alias("rank"))
    return hit.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall"))


def packed(claims: DataFrame, budget: int, order: list[str], text: str = "text", stub: int = 120) -> DataFrame:
    """Greedy packing of ranked claims into a budget of characters: whole while they fit, then as a stub, then not at all. The rows of one
    answer are few; they are packed in one task, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, shut = 0, False
        for b in batches:
            forms, sums = [], []
            for t in b[text]:
                own = t or ""
                form = "none"
                if not shut:
                    if used + len(own) <= budget:
                        form, used = "full", used + len(own)
                    elif used + min(stub, len(own)) <= budget:
                        form, used = "stub", used + min(stub, len(own))
                    else:
                        shut = True
                forms.append(form)
                sums.append(used)
            yield b[["claim_id"]].assign(form=forms, used=sums)

    ship(claims.sparkSession)
    return claims.orderBy(*order).coalesce(1).select("claim_id", text).mapInPandas(run, "claim_id string, form string, used long")


def prefix_fit(claims: DataFrame, budget: int, order: list[str], size: str) -> DataFrame:
    """The part of packing that is a running sum: rows that fit whole, with the sum up to them. For one answer's bounded rows."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return claims.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
