"""What a user asks of a store: the calls behind the command line and the JSON-RPC loop."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.text import WORD, query_terms
from claimweave.operators import aggregate, freshness, graph, index, retrieve, validate, views
from claimweave.operators.store import ClaimStore
from claimweave.plans import warm as warm_
from claimweave.sources import files as sources
from claimweave.tables import settled

BUDGETS = ((2000, 8), (6000, 12))


class Service:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None, ignore: list[str] | None = None) -> None:
        self.spark, self.root, self.ignore = spark, root, ignore or []
        self.store = ClaimStore(spark, store or f"{root.rstrip('/')}/.claims")
        self._fresh: DataFrame | None = None

    def files(self) -> DataFrame:
        return sources.source_tree(self.spark, self.root, self.ignore)

    def warm(self) -> dict:
        self._fresh = None
        return warm_.warm(self.store, self.files())

    def fresh(self) -> DataFrame:
        """claim_id, fresh, stale_reasons of all claims, worked out once for this service."""
        if self._fresh is None:
            f = self.files()
            self._fresh = settled(warm_.freshness_of(self.store.read(), f, warm_.symbols_of(f)))
        return self._fresh

    def _good(self) -> DataFrame:
        local = self.store.read().where(F.coalesce("trust", F.lit("local")) != "unverified_foreign").select("claim_id")
        return self.fresh().where("fresh").join(local, "claim_id", "left_semi")

    def edges(self) -> DataFrame:
        good = self._good()
        e = self.store.read().where("edge_kind is not null and target_id is not null").join(good, "claim_id", "left_semi")
        return e.select(F.col("claim_id").alias("edge_id"), F.col("edge_kind").alias("relation_kind"), "source_id", "target_id", F.lit(None).cast("string").alias("relation"))

    def nodes(self) -> DataFrame:
        return self._good().select(F.col("claim_id").alias("node_id"))

    def retrieve(self, query: str, limit: int = 5) -> list[dict]:
        limit = max(1, min(50, limit))
        claims = self.store.read().where("edge_kind is null").withColumn("text", F.col("claim")).withColumn("path", F.col("owner_path"))
        if not query_terms(query):
            return []
        return self._thin(retrieve.retrieve(claims, self._good(), query, limit).select("claim_id", "place"))

    def _thin(self, ids: DataFrame) -> list[dict]:
        ids = ids if "place" in ids.columns else ids.withColumn("place", F.lit(0))
        view = views.explained(self.store.read().join(ids.select("claim_id"), "claim_id", "left_semi"), self.fresh())
        return [r.asDict(recursive=True) for r in views.thin(view).join(ids, "claim_id").orderBy("place", "claim_id").drop("place").collect()]

    def path(self, path: str) -> list[dict]:
        if PurePosixPath(path).is_absolute() or ".." in PurePosixPath(path).parts:
            raise ValueError("the path must lie inside of the root")
        return self._thin(self.store.by_path(path).select("claim_id"))

    def resolve(self, name: str, path: str | None = None) -> dict:
        claims = self.store.read().where("edge_kind is null")
        if self.store.get([name]).limit(1).count():
            return {"status": "resolved", "claim_id": name}
        hit = index.names_at_path(index.exact_names(claims), index.binding_paths(claims), name, path).limit(21).collect()
        status = "not_found" if not hit else "resolved" if len(hit) == 1 else "ambiguous"
        return {"status": status, "claim_id": hit[0].claim_id if len(hit) == 1 else None, "candidates": [r.claim_id for r in hit[:20]]}

    def explain(self, claim_id: str) -> str:
        rows = views.reviewer_text(views.explained(self.store.get([claim_id]), self.fresh())).collect()
        return rows[0].text if rows else "not found"

    def reverse(self, what: str, target: str) -> list[str]:
        asked = self.spark.createDataFrame([(target,)], "target_id string")
        e = self.edges()
        kind, relation = graph.REVERSE[what]
        if relation:
            rel = self.store.read().select(F.col("claim_id").alias("edge_id"), F.lit(relation).alias("relation"))
            e = e.drop("relation").join(rel, "edge_id")
        return sorted(r.source_id for r in graph.reverse(e, self.nodes(), asked, what).collect())

    def fragment(self, entry: str, relations: list[str], hops: int = 2, **caps) -> dict:
        e = self.edges()
        return graph.bounded_fragment(e, self.nodes(), entry, relations, hops, stop=graph.BOUNDARY, **caps)

    def context(self, question: str, max_chars: int = 3000) -> dict:
        """Claims of a question and one hop around each, whole while they fit, then as stubs."""
        limit = next((n for chars, n in BUDGETS if max_chars <= chars), 16)
        claims, used, out = self.retrieve(question, limit), 0, {"claims": [], "relations": []}
        for c in claims:
            for f in [self.fragment(c["claim_id"], list(graph.KINDS), 1, most_edges=8)]:
                size = sum(len(i) for h in f["hops"] for i in h["edges"])
                if f["hops"] and used + size <= max_chars // 2:
                    out["relations"].append({"entry": c["claim_id"], "hops": f["hops"]})
                    used += size
        for c in claims:
            full, stub = str(c), {k: c[k] for k in ("claim_id", "anchor", "level")}
            if used + len(full) <= max_chars:
                out["claims"].append(c)
                used += len(full)
            elif used + len(str(stub)) <= max_chars:
                out["claims"].append(stub)
                used += len(str(stub))
            else:
                break
        return out | {"used_chars": used}

    def status(self) -> dict:
        claims = self.store.read()
        kinds = {r.edge_kind: r["n"] for r in claims.where("edge_kind is not null").groupBy("edge_kind").agg(F.countDistinct("claim_id").alias("n")).collect()}
        sample = self.fresh().orderBy("claim_id").limit(20).collect()
        return {"version": self.store.current(), "claims": claims.count(), "edges": kinds, "sample_fresh": sum(r.fresh for r in sample), "sample_stale": sum(not r.fresh for r in sample)}

    def feedback(self, claim_id: str, kind: str) -> None:
        if kind not in ("usage", "verified", "falsified", "hunch"):
            raise ValueError(f"unknown feedback: {kind}")
        given = self.spark.createDataFrame([(claim_id, kind)], "claim_id string, kind string")
        self.store.update([claim_id], lambda own: views.with_feedback(own, given))

    def stats(self, log: str, since: str | None = None) -> dict:
        return aggregate.metrics_stats(sources.metrics_log(self.spark, log, since)).first().asDict()

    def validate(self) -> dict:
        claims = self.store.read()
        audit = validate.production_audit(claims, self.fresh()).first().asDict()
        return audit | {"violations": validate.invariants(claims).count(), "unsupported": validate.unsupported(claims, self.files()).count()}

    def stale_in(self, path: str) -> list[str]:
        """Stale claims of functions of a path, as an editor asks before an edit."""
        own = self.store.by_path(path).where("scope = 'function'").select("claim_id", "qualname")
        return sorted(r.qualname for r in own.join(self.fresh().where("not fresh"), "claim_id").collect())

    def stale_calls(self, text: str) -> list[str]:
        """Names that a new text mentions, that one function has, and whose claim is stale."""
        words = self.spark.createDataFrame([(text,)], "t string").select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))).alias("value"))
        fns = self.store.read().where("scope = 'function'")
        one = index.resolved_names(index.exact_names(fns).where("kind = 'simple'"), words).where("status = 'resolved'")
        return sorted(r.value for r in one.join(self.fresh().where("not fresh"), "claim_id").collect())


def consumed(manifests: DataFrame, done: DataFrame, most: int = 80) -> DataFrame:
    """Entries of the latest manifest (id, ts, entries) that wasn't consumed yet."""
    left = manifests.join(done.select("id"), "id", "left_anti")
    last = left.agg(F.max_by("id", "ts").alias("id"))
    return left.join(F.broadcast(last), "id").select("id", F.explode(F.slice("entries", 1, most)).alias("entry"))  # one row


__all__ = ["freshness"]
