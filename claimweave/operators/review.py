"""Rules and reports over claims and their evidence: what may enter the store, what supports it, and how well it serves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers of claims that external tools make, the stronger last, and the confidence that they may have.
TIERS, CAP = ("semantic-resolved", "compiler-attributed"), 0.6
#: Words of a question that ask for a declaration, and for a repository.
DECLARATION = ("declare", "declares", "declared", "source", "where", "which")
REPOSITORY = ("repository", "repositories", "persists", "persistence")
#: Fields that say of what kind an edge's ends are.
END_KINDS = ("source_node_kind", "target_node_kind")


def indexed(files: DataFrame, policy: dict[str, bool]) -> DataFrame:
    """files (source_set, generated) that a policy takes in: generated ones by `generated`, others by their set, unknown sets by `custom`.
    What the policy doesn't name is taken in."""
    named = reduce(lambda c, s: c.when(F.col("source_set") == s, F.lit(policy.get(s, True))), ("main", "test", "unclassified"), F.when(F.col("generated"), F.lit(policy.get("generated", True))))
    return files.where(named.otherwise(F.lit(policy.get("custom", True))))


def overlays(claims: DataFrame, known: DataFrame, kinds: list[str]) -> DataFrame:
    """claims (claim_id, extraction_tier, tier, edge_kind, confidence) of external tools that may be added: never in place of a known one
    (known: claim_id), of an accepted tier, and of an accepted kind if it is an edge. They are attributed, at a confidence of CAP at most."""
    tiers = F.array("extraction_tier", "tier")
    best = reduce(lambda c, t: c.when(F.array_contains(tiers, t), t), reversed(TIERS), F.when(F.lit(False), ""))
    ok = claims.withColumn("__tier", best).where(F.col("__tier").isNotNull() & (F.col("edge_kind").isNull() | F.col("edge_kind").isin(kinds)))
    ok = ok.join(known.select("claim_id").distinct(), "claim_id", "left_anti")
    return ok.withColumn("extraction_tier", F.col("__tier")).withColumn("tier", F.col("__tier")).drop("__tier").withColumn("evidence", F.lit("attributed")).withColumn("confidence", F.least("confidence", F.lit(CAP)))


def supporting(evidence: Column, support: Column) -> Column:
    """Of an array of texts, those that hold all of the support strings literally; none without support."""
    return F.when(F.size(support) > 0, F.filter(evidence, lambda e: F.forall(support, lambda s: F.contains(e, s)))).otherwise(F.array().cast("array<string>"))


def provenance_items(items: Column) -> Column:
    """Evidence (array<struct<source_type,commit,url,path,line_start,line_end,text>>) as it is shown: the first reference that isn't
    empty, and the text marked as quoted, untrusted data."""
    given = lambda x, n: F.when(x[n] != "", x[n])
    return F.transform(items, lambda x: F.struct(x["source_type"].alias("type"), F.coalesce(given(x, "commit"), given(x, "url"), given(x, "path")).alias("ref"), x["path"].alias("path"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end"), x["text"].alias("quoted_text_untrusted_data")))


def embedding_text(claim: Column, summary: Column, keywords: Column, qualname: Column) -> Column:
    """What a claim is embedded by."""
    none = F.lit("")
    return F.concat_ws(" ", F.coalesce(claim, none), F.coalesce(summary, none), F.coalesce(F.array_join(keywords, " "), none), F.coalesce(qualname, none))


def without_end_kinds(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """owner_path, claims: owners among the paths of Java edges that don't say of what kind their ends are, and so must be derived anew."""
    old = edges.where("language = 'java'").where(reduce(lambda a, c: a | (F.coalesce(c, F.lit("")) == ""), [F.col(k) for k in END_KINDS], F.lit(False)))
    old = old.where(F.endswith("owner_path", F.lit(".java"))).join(paths.select(F.col("path").alias("owner_path")).distinct(), "owner_path", "left_semi")
    return old.groupBy("owner_path").agg(F.count(F.lit(1)).alias("claims"))


def merged_coverage(parts: DataFrame) -> DataFrame:
    """language, relation_kind, resolved, unresolved, resolution_rate (null without any) over all parts, whoever measured them."""
    s = parts.groupBy("language", "relation_kind").agg(F.sum("resolved").alias("resolved"), F.sum("unresolved").alias("unresolved"))
    n = F.col("resolved") + F.col("unresolved")
    return s.withColumn("resolution_rate", F.when(n > 0, F.round(F.col("resolved") / n, 6)))


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """How many rows there are of each version, action or reason, nulls apart."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def occurrences(text: Column, terms: list[str]) -> Column:
    """How often terms stand in a lower-cased text, each counted without overlap."""
    low = F.lower(text)
    return reduce(lambda a, t: a + ((F.char_length(low) - F.char_length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("long"), terms, F.lit(0).cast("long"))


def by_occurrences(files: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """The plain search that retrieval is compared with: files by the number of hits in path and text, ties by path."""
    s = files.withColumn("score", occurrences(F.concat_ws("\n", "path", F.coalesce("text", F.lit(""))), terms))
    return s.where("score > 0").orderBy(F.desc("score"), "path").limit(limit).select("path", "score")


def mean_recalls(rows: DataFrame) -> DataFrame:
    """category, strategy, tasks, mean_recall, wins, losses: a task is won by the strategy of the higher recall, lost by others; ties count for
    none. rows: task, category, strategy, recall."""
    best = rows.groupBy("task").agg(F.max("recall").alias("high"), F.min("recall").alias("low"))
    j = rows.join(best, "task").withColumn("won", (F.col("recall") == F.col("high")) & (F.col("high") > F.col("low"))).withColumn("lost", F.col("recall") < F.col("high"))
    return j.groupBy("category", "strategy").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.count_if("won").alias("wins"), F.count_if("lost").alias("losses"))


def probe(files: DataFrame, dirty: DataFrame, marker: str) -> DataFrame:
    """The file that a mutation is tried on: the smallest (then the first by path) that isn't dirty and doesn't hold the marker."""
    clean = files.join(dirty.select("path"), "path", "left_anti").where(~F.contains(F.coalesce("text", F.lit("")), F.lit(marker)))
    return clean.select("path", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")).orderBy("size", "path").limit(1)


def intents(terms: Column) -> list[Column]:
    words = lambda ws: F.array(*map(F.lit, ws))
    return [F.arrays_overlap(terms, words(DECLARATION)).alias("declaration_intent"), F.arrays_overlap(terms, words(REPOSITORY)).alias("repository_intent")]


def gaps_of(rows: DataFrame, key: str, order: str, gap: str) -> DataFrame:
    """key, gaps: each gap once, in the order in which it came first. A key has no more gaps than there are reasons."""
    first = rows.where(F.col(gap).isNotNull()).groupBy(key, gap).agg(F.min(order).alias("at"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", gap))), lambda x: x[gap]).alias("gaps"))


def renamed(body: Column, old: Column, new: Column) -> Column:
    """A JSON text in which each string that is old as a whole is new, at any depth, as value or key. Strings that only contain it stay."""
    quoted = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.substring(quoted(c), F.lit(2), F.char_length(quoted(c)) - 2)
    return F.replace(body, inner(old), inner(new))


def with_fresh_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node_id, callees, callers) with what fresh edges add that isn't listed yet, sorted behind what is."""
    def ends(key: str, other: str) -> DataFrame:
        return edges.where("relation_kind = 'calls'").groupBy(F.col(key).alias("node_id")).agg(F.sort_array(F.collect_set(other)).alias(f"__{other}"))

    out = nodes.join(ends("source_id", "target_id"), "node_id", "left").join(ends("target_id", "source_id"), "node_id", "left")
    none = F.array().cast("array<string>")
    for listed, found in (("callees", "__target_id"), ("callers", "__source_id")):
        out = out.withColumn(listed, F.array_union(F.coalesce(listed, none), F.coalesce(found, none)))
    return out.select(*nodes.columns)
