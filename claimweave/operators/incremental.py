"""Incremental maintenance: what changed between snapshots, renames, tombstones, dependents, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ids import stable_id

#: Edge kinds, and whether the source's or the target's path owns the edge.
OWNER_IS_SOURCE = ("calls", "reads", "writes", "inherits", "overrides", "uses_type", "reads_env", "reads_config_key", "injects", "publishes_to", "subscribes_to", "publishes_type", "listens_type")


def manifest_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, status (added, removed, changed, same) by a full outer join on paths."""
    s, c = stored.select("path", F.col("blob").alias("old_blob")), current.select("path", F.col("blob").alias("new_blob"))
    status = F.when(F.col("old_blob").isNull(), "added").when(F.col("new_blob").isNull(), "removed").when(F.col("old_blob") != F.col("new_blob"), "changed").otherwise("same")
    return s.join(c, "path", "full_outer").select("path", status.alias("status"), "old_blob", "new_blob")


def renames(stored: DataFrame, current: DataFrame) -> DataFrame:
    """old_path, new_path: vanished and new paths whose blob is the only such on either side."""

    def alone(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias(name)).where("n = 1").select("blob", name)

    gone = stored.select("path", "blob").join(current.select("path"), "path", "left_anti")
    new = current.select("path", "blob").join(stored.select("path"), "path", "left_anti")
    return alone(gone, "old_path").join(alone(new, "new_path"), "blob").select("old_path", "new_path", "blob")


def rebound_ids(moves: DataFrame, kind: str = "file") -> DataFrame:
    return moves.select("old_path", "new_path", stable_id(kind, "old_path").alias("old_id"), stable_id(kind, "new_path").alias("new_id"))


def rebind_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with moved ends (ids: old_id, new_id) replaced; the ids of the edges themselves are made anew by the caller."""
    out = edges
    for end in ("source_id", "target_id"):
        m = ids.select(F.col("old_id").alias(end), F.col("new_id").alias("__new"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return out


def tombstones(old: DataFrame, new: DataFrame, key: str = "claim_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti")


def owner_path(kind: Column, source_path: Column, target_path: Column) -> Column:
    return F.when(kind.isin(*OWNER_IS_SOURCE), source_path).otherwise(target_path)


def reconcile_edges(stored: DataFrame, derived: DataFrame, paths: DataFrame) -> DataFrame:
    """Stored edges that one of the paths owns and that weren't derived again. stored has owner_path, and so may derived: then an edge was
    derived again by the same owner, and those of other owners aren't compared."""
    paths = paths.select(F.col("path").alias("owner_path")).distinct()
    own = stored.join(paths, "owner_path", "left_semi")
    if "owner_path" in derived.columns:
        derived = derived.join(paths, "owner_path", "left_semi")
    return own.join(derived.select("edge_id"), "edge_id", "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str = "claim_id") -> DataFrame:
    """The stored rows that aren't replaced, and the new ones."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def dependents(bindings: DataFrame, changed: DataFrame) -> DataFrame:
    """Owners of claims that are bound to several paths, one of them changed; the changed paths themselves aside.

    bindings: claim_id, path, owner_path.
    """
    touched = bindings.join(changed.select("path").distinct(), "path", "left_semi").select("claim_id").distinct()
    several = bindings.where(F.col("path") != F.col("owner_path")).select("claim_id").distinct()
    owners = bindings.join(touched, "claim_id", "left_semi").join(several, "claim_id", "left_semi").select(F.col("owner_path").alias("path")).distinct()
    return owners.join(changed.select("path"), "path", "left_anti")


def symbol_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, qualname, status (changed, deleted, added) of functions whose hash differs between two revisions."""
    b, a = before.select("path", "qualname", F.col("fn_hash").alias("old_fn_hash")), after.select("path", "qualname", F.col("fn_hash").alias("new_fn_hash"))
    status = F.when(F.col("old_fn_hash").isNull(), "added").when(F.col("new_fn_hash").isNull(), "deleted").when(F.col("old_fn_hash") != F.col("new_fn_hash"), "changed")
    return b.join(a, ["path", "qualname"], "full_outer").select("path", "qualname", "old_fn_hash", "new_fn_hash", status.alias("status")).where(F.col("status").isNotNull())


def module_of(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """The module with the longest root that a path starts with. A path's own prefixes, cut at its slashes, are joined by equality, so no
    pair of path and foreign module is ever made."""
    cuts = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split(F.col("path"), "/"), 1, i), "/"))
    p = paths.select("path", F.explode(F.concat(F.array(F.lit("")), cuts)).alias("root"))
    return p.join(modules.select("root", "module"), "root").groupBy("path").agg(F.max_by("module", F.char_length("root")).alias("module"))


def anchored(points: DataFrame, anchors: DataFrame, bucket: int = 64) -> DataFrame:
    """Points (path, line) inside of anchors (path, anchor_id, line_start, line_end): an interval join by buckets of lines.

    An anchor is in every bucket that it spans, a point in one; the pair meets there by equality.
    """
    a = anchors.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / bucket), F.floor(F.col("line_end") / bucket))))
    p = points.withColumn("bucket", F.floor(F.col("line") / bucket))
    return p.join(a, ["path", "bucket"]).where((F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end"))).drop("bucket")
