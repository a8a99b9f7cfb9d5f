"""Warm: sources to claims, all of them or those that a change touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ids import stable_id
from claimweave.functions.numbers import observed_confidence
from claimweave.functions.text import identifier_keywords
from claimweave.operators import freshness, incremental
from claimweave.operators.extract.config import config_keys
from claimweave.operators.extract.java import java_rows
from claimweave.operators.extract.limits import SECONDS
from claimweave.operators.extract.python import python_rows
from claimweave.operators.extract.sql import declarations as sql_declarations
from claimweave.operators.resolve import annotations
from claimweave.operators.resolve import java as rj
from claimweave.operators.resolve import python as rp
from claimweave.operators.store import ClaimStore
from claimweave.schema import conform
from claimweave.tables import settled


def _binding(path: str, qualname: str | None = None, fn_hash: str | None = None, kind: str | None = None, first: str | None = None, last: str | None = None, role: str | None = None):
    col = lambda c, t: (F.col(c) if c else F.lit(None)).cast(t)
    return F.struct(F.col(path).alias("path"), F.lit(None).cast("string").alias("file_blob"), col(fn_hash, "string").alias("fn_hash"), col(qualname, "string").alias("qualname"), F.lit(role).cast("string").alias("role"), col(first, "int").alias("line_start"), col(last, "int").alias("line_end"), F.lit(kind).cast("string").alias("node_kind"))


def _node(df: DataFrame, scope: str, ident, confidence: float, claim, language: str, node_kind) -> DataFrame:
    return df.select(
        ident.alias("claim_id"), claim.alias("claim"), F.lit("structure").alias("kind"), F.lit(scope).alias("scope"), F.array(_binding("path", "qualname", "hash", scope, "line_start", "line_end")).alias("bindings"),
        F.lit("git").alias("provenance"), F.lit("observed").alias("evidence"), F.lit(confidence).alias("confidence"), F.col("path").alias("owner_path"), "qualname", F.lower(F.substring_index("qualname", ".", -1)).alias("name"),
        node_kind.alias("node_kind"), F.lit(language).alias("language"), identifier_keywords(F.col("qualname")).alias("keywords"), (F.col("detail") if "detail" in df.columns else F.lit("{}")).alias("body"),
    )


def _edge(df: DataFrame, kind: str, path: str, language: str, confidence: float = 0.55, evidence: str = "observed", source: tuple | None = None, target: tuple | None = None) -> DataFrame:
    """Claims of edges. source and target: (qualname, hash, node kind) of what the edge is bound to on either side, where that is known;
    an edge that isn't bound to its source's symbol is bound to its file."""
    ends = [_binding(path, *(source or (None, None, None)), role="source")] + ([_binding("target_path", *target, role="target")] if target else [])
    how = F.col("resolution") if "resolution" in df.columns else F.col("how") if "how" in df.columns else F.lit(None).cast("string")
    return df.where("edge_id is not null").select(F.col("edge_id").alias("claim_id"), F.concat_ws(" ", "source_id", F.lit(kind), "target_id").alias("claim"), F.lit("architecture").alias("kind"), F.lit("cross-repo").alias("scope"), F.array(*ends).alias("bindings"), F.lit("git").alias("provenance"), F.lit(evidence).alias("evidence"), F.lit(confidence).alias("confidence"), F.col(path).alias("owner_path"), F.lit(language).alias("language"), F.lit(kind).alias("edge_kind"), "source_id", "target_id", how.alias("resolution")).dropDuplicates(["claim_id"])


def parsed(files: DataFrame, seconds: float = SECONDS) -> dict[str, DataFrame]:
    """The rows of files by the store's table, each file read once."""
    return {"python": settled(python_rows(files, seconds)), "java": settled(java_rows(files, seconds)), "config": settled(config_keys(files)), "sql": settled(sql_declarations(files))}


def symbols_of(files: DataFrame) -> DataFrame:
    """path, qualname, node_kind, hash of all that bindings are compared with."""
    return _symbols(**parsed(files))


def _symbols(python: DataFrame, java: DataFrame, config: DataFrame, sql: DataFrame) -> DataFrame:
    py, jv, cf, sq = python, java, config, sql
    out = rp.symbols(py).unionByName(cf.select("path", F.col("key").alias("qualname"), F.lit("config").alias("node_kind"), F.col("config_hash").alias("hash")))
    out = out.unionByName(rj.types(jv).select("path", "qualname", F.lit("class").alias("node_kind"), "hash")).unionByName(rj.members(jv).select("path", "qualname", F.lit("function").alias("node_kind"), "hash"))
    return out.unionByName(sq.select("path", "qualname", F.lit("declaration").alias("node_kind"), F.col("declaration_hash").alias("hash")))


def derive(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, symbols) of files (path, text, blob). Each file is parsed once; the rest are joins and projections, put together by union."""
    rows = parsed(files)
    return derived(files, **rows), _symbols(**rows)


def derived(files: DataFrame, python: DataFrame, java: DataFrame, config: DataFrame, sql: DataFrame) -> DataFrame:
    """The claims of files whose rows are these."""
    py, jv, cf, sq = python, java, config, sql
    say = lambda *cs: F.concat_ws(" ", *cs)
    f = files.select("path", F.col("path").alias("qualname"), F.lit(None).cast("string").alias("hash"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    parts = [
        _node(f, "file", stable_id("file", "path"), 0.35, say(F.lit("File"), "path"), "text", F.lit("file")).withColumn("keywords", identifier_keywords(F.regexp_replace("qualname", "[/-]", "."))),
        _node(py.where("kind = 'function'"), "function", stable_id("function", "path", "qualname"), 0.4, say(F.lit("Function"), "qualname", F.lit("in"), "path"), "python", F.lit("function")),
        _node(py.where("kind = 'class'"), "class", stable_id("class", "path", "qualname"), 0.4, say(F.lit("Class"), "qualname", F.lit("in"), "path"), "python", F.lit("class")),
        _node(py.where("kind = 'declaration'"), "declaration", stable_id("declaration", "path", "qualname"), 0.35, say(F.lit("Declaration"), "qualname", F.lit("in"), "path"), "python", F.lit("declaration")),
        _node(py.where("kind = 'api'"), "api", stable_id("api", "path", F.get_json_object("detail", "$.method"), F.get_json_object("detail", "$.route_path"), "qualname"), 0.45, say(F.lit("Route"), F.get_json_object("detail", "$.method"), F.get_json_object("detail", "$.route_path")), "python", F.lit("api")),
        _node(sq.select("path", "qualname", F.col("declaration_hash").alias("hash"), "line_start", F.col("line_start").alias("line_end"), F.to_json(F.struct("declaration_kind")).alias("detail")), "declaration", stable_id("declaration", "path", "qualname"), 0.35, say(F.lit("Declaration"), "qualname", F.lit("in"), "path"), "sql", F.lit("declaration")),
        _node(cf.select("path", F.col("key").alias("qualname"), F.col("config_hash").alias("hash"), "line_start", F.col("line_start").alias("line_end"), F.to_json(F.struct("config_kind")).alias("detail")), "config", stable_id("config", "path", "qualname"), 0.35, say(F.lit("Key"), "qualname", F.lit("in"), "path"), "config", F.lit("config")),
    ]
    types, members = rj.types(jv), rj.members(jv)
    parts += [
        _node(types.select("path", "qualname", "hash", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), "node_id", "node_kind"), "class", F.col("node_id"), 0.35, say(F.lit("Java type"), "qualname"), "java", F.lit("class")),
        _node(members, "function", F.col("node_id"), 0.35, say(F.lit("Java member"), "identity"), "java", F.lit("function")),
    ]
    calls, _ = rp.calls(py, files)
    parts += [
        _edge(calls, "calls", "path", "python", source=("caller", "caller_hash", "function"), target=("target", "callee_hash", "function")),
        _edge(rp.declaration_relations(py, files, "read"), "reads", "path", "python", target=("target", "declaration_hash", "declaration")),
        _edge(rp.declaration_relations(py, files, "write"), "writes", "path", "python", target=("target", "declaration_hash", "declaration")),
        _edge(rp.env_reads(py), "reads_env", "path", "python"),
        _edge(rp.config_reads(py, cf), "reads_config_key", "path", "python"),
        _edge(rj.inherits(jv), "inherits", "path", "java"),
        _edge(rj.calls(jv), "calls", "path", "java"),
        _edge(rj.overrides(jv), "overrides", "path", "java", evidence="inferred"),
        _edge(rj.type_uses(jv), "uses_type", "path", "java"),
        _edge(rj.field_uses(jv).where("use = 'read'"), "reads", "path", "java"),
        _edge(rj.field_uses(jv).where("use = 'write'"), "writes", "path", "java"),
        _edge(annotations.injections(jv), "injects", "path", "java", evidence="attributed"),
        _edge(annotations.event_edges(jv), "listens_type", "path", "java"),
    ]
    notes = annotations.annotation_metadata(jv).where("claim_id is not null")
    parts.append(notes.select("claim_id", F.concat_ws(" ", "owner", "edge_kind").alias("claim"), F.lit("structure").alias("kind"), F.lit("declaration").alias("scope"), F.array(_binding("path")).alias("bindings"), F.lit("git").alias("provenance"), F.lit("observed").alias("evidence"), F.lit(1.0).alias("confidence"), F.col("path").alias("owner_path"), F.col("owner").alias("qualname"), F.lit("java").alias("language"), "edge_kind", F.col("owner_id").alias("source_id"), F.col("metadata").alias("body")))
    out = None
    for p in parts:
        c = settled(conform(p))  # each family by itself, so that no plan holds all of them
        out = c if out is None else out.unionByName(c)
    blobs = files.select(F.col("path").alias("owner_path"), "blob")
    out = out.join(blobs, "owner_path", "left")
    # a target in another file is compared by its symbol's hash alone, so that it needs no blob
    out = out.withColumn("bindings", F.transform("bindings", lambda b: b.withField("file_blob", F.when(b["path"] == F.col("owner_path"), F.col("blob"))))).drop("blob")
    out = out.withColumn("derivation_version", freshness.expected_version(F.col("owner_path")))
    text = files.select(F.col("path").alias("owner_path"), F.col("text").alias("source"))
    out = out.join(text, "owner_path", "left")
    ok = F.forall(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 8), lambda k: F.contains(F.col("source"), k))
    heuristic = F.col("scope").isin("function", "class", "declaration") & F.col("edge_kind").isNull()
    out = out.withColumn("confidence", F.when(heuristic, observed_confidence(ok, F.col("confidence"))).otherwise(F.col("confidence"))).withColumn("evidence", F.when(heuristic & ~ok, "inferred").otherwise(F.col("evidence"))).drop("source")
    return out.dropDuplicates(["claim_id"])


def bindings_of(claims: DataFrame) -> DataFrame:
    b = claims.select("claim_id", "owner_path", "derivation_version", F.explode("bindings").alias("b"))
    return b.select("claim_id", "owner_path", "derivation_version", "b.path", "b.file_blob", "b.fn_hash", "b.qualname", "b.node_kind")


def freshness_of(claims: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    states = freshness.binding_states(bindings_of(claims), files, symbols)
    return freshness.claim_freshness(claims.withColumn("path", F.col("owner_path")), states)


def failures(rows: dict[str, DataFrame]) -> DataFrame:
    """path, reason of the files that couldn't be read in time."""
    both = [rows[t].where("kind = 'failed'").select("path", F.col("qualname").alias("reason")) for t in ("python", "java")]
    return both[0].unionByName(both[1])


def with_moved_feedback(claims: DataFrame, stored: DataFrame, moves: DataFrame) -> DataFrame:
    """claims, where those of a moved file take over what was said about them under their old path: endorsement, verification, evidence
    and confidence. moves: old_path, new_path."""
    said = stored.where("endorsed_by is not null or last_verified is not null").join(moves, stored.owner_path == moves.old_path)
    keys = ["owner_path", "scope", "qualname", "node_kind", "edge_kind"]
    said = said.select(F.col("new_path").alias("owner_path"), *keys[1:], *[F.col(c).alias(f"__{c}") for c in ("endorsed_by", "last_verified", "evidence", "confidence")]).where("qualname is not null").dropDuplicates(keys)
    hit = reduce(lambda a, k: a & claims[k].eqNullSafe(said[k]), keys[1:], claims["owner_path"] == said["owner_path"])
    out = claims.join(said, hit, "left").select(*[claims[c] for c in claims.columns], *[c for c in said.columns if c.startswith("__")])
    known = F.col("__endorsed_by").isNotNull() | F.col("__last_verified").isNotNull()
    for c in ("endorsed_by", "last_verified", "evidence", "confidence"):
        out = out.withColumn(c, F.when(known, F.col(f"__{c}")).otherwise(F.col(c)))
    return out.select(*claims.columns)


def warm(store: ClaimStore, files: DataFrame, seconds: float = SECONDS, wait: float = 0.0) -> dict:
    """Brings the store up to the files: nothing where nothing changed, else the changed paths and those whose claims depend on them.

    Only files that changed are parsed; what was parsed of the others is in the store, so that relations are joins over stored rows. Claims
    are replaced of the owners that changed, that are bound to a path that did, or whose relations came or went. A file that takes too
    long is kept as failed, and read again by the next warm. Moved files keep what was said about their claims.
    """
    with store.change(wait) as change:
        known, stored = change.read("files"), change.read("claims")
        diff = settled(incremental.manifest_diff(known.select("path", F.when(F.col("reason").isNull(), F.col("blob")).alias("blob")), files).where("status <> 'same' and (old_blob is not null or new_blob is not null)"))
        counts = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
        if not counts:
            return {"derived": 0, "removed": 0, "failed": {}, "status": "complete", "noop": True}
        rows = parsed(files.join(diff.where("new_blob is not null").select("path"), "path", "left_semi"), seconds)
        owners = diff.select(F.col("path").alias("owner"))
        for table, new in rows.items():
            change.replace(table, owners, new)
        now = {t: change.now(t) for t in rows}
        failed = settled(failures(now))
        change.write("files", files.select("path", "blob").join(failed.dropDuplicates(["path"]), "path", "left"))
        claims = derived(files.join(failed, "path", "left_anti"), **now)
        if stored.isEmpty():
            change.write("claims", store.stamped(claims))
        else:
            moves = settled(incremental.renames(known, files))
            claims = settled(with_moved_feedback(claims, stored, moves))
            edges = lambda df: df.where("edge_kind is not null").select("claim_id", F.col("owner_path").alias("path"))
            lost = edges(stored).join(edges(claims).select("claim_id"), "claim_id", "left_anti").select("path")
            come = edges(claims).join(edges(stored).select("claim_id"), "claim_id", "left_anti").select("path")
            bound = incremental.dependents(bindings_of(stored).select("claim_id", "path", "owner_path"), diff.select("path"))
            paths = settled(diff.select("path").union(lost).union(come).union(bound).distinct())
            change.replace("claims", paths.select(F.col("path").alias("owner")), store.stamped(claims.join(paths.select(F.col("path").alias("owner_path")), "owner_path", "left_semi")))
        bad = {r.path: r.reason for r in failed.orderBy("path").limit(1000).collect()}
    return {"derived": counts.get("added", 0) + counts.get("changed", 0), "removed": counts.get("removed", 0), "failed": bad, "status": "partial" if bad else "complete", "noop": False}
