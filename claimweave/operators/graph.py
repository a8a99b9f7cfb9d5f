"""Reverse lookups, adjacency, and bounded fragments of the relation graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.index import edge_endpoints
from claimweave.tables import settled

ASYNC = ("publishes_to", "subscribes_to", "publishes_type", "listens_type")
KINDS = ("calls", "reads", "writes", "inherits", "overrides", "uses_type", "reads_env", "reads_config_key", "injects", *ASYNC)
BOUNDARY = ("writes", "publishes_to")
MOST_HOPS, MOST_NODES, MOST_EDGES = 4, 64, 128

#: Reverse lookups: relation kind, and its sub-kind where only one counts.
REVERSE = {
    "callers": ("calls", None),
    "readers": ("reads", None),
    "writers": ("writes", None),
    "subtypes": ("inherits", "extends"),
    "implementors": ("inherits", "implements"),
    "overridden_by": ("overrides", None),
    "used_by_types": ("uses_type", None),
    "env_readers": ("reads_env", None),
    "config_readers": ("reads_config_key", None),
    "injected_by": ("injects", None),
    "topic_publishers": ("publishes_to", None),
    "topic_subscribers": ("subscribes_to", None),
}


def reverse(edges: DataFrame, fresh: DataFrame, targets: DataFrame, what: str) -> DataFrame:
    """Sources of fresh edges to the targets (target_id): target_id, source_id, edge_id. The kind's filter comes first, the few targets
    next, so that only their edges meet the freshness of nodes."""
    kind, relation = REVERSE[what]
    e = edges.where(F.col("relation_kind") == kind)
    if relation:
        e = e.where(F.col("relation") == relation)
    e = e.join(targets.select("target_id").distinct(), "target_id", "left_semi")
    for end in ("target_id", "source_id"):
        e = e.join(fresh.select(F.col("node_id").alias(end)), end, "left_semi")
    return e.select("target_id", "source_id", "edge_id")


def reverse_index(edges: DataFrame, kind: str = "calls") -> DataFrame:
    """target_id, sources (sorted), n: the complete reverse index of a kind."""
    own = edges.where(F.col("relation_kind") == kind)
    return own.groupBy("target_id").agg(F.sort_array(F.collect_set("source_id")).alias("sources"), F.count(F.lit(1)).alias("n"))


def adjacency(edges: DataFrame) -> DataFrame:
    """node_id, relation_kind, direction, n, nearest and farthest neighbour: a node's lists in digest form.

    Whole lists of hubs grow without bound, so only their sizes, ends and an order-free digest are kept; neighbours() gives the lists.
    """
    out = edges.select(F.col("source_id").alias("node_id"), "relation_kind", F.lit("out").alias("direction"), F.col("target_id").alias("other"))
    into = edges.select(F.col("target_id").alias("node_id"), "relation_kind", F.lit("in").alias("direction"), F.col("source_id").alias("other"))
    return out.unionByName(into).groupBy("node_id", "relation_kind", "direction").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first"), F.max("other").alias("last"))


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """node_id, relation_kind, direction, other for the nodes asked."""
    both = [
        edges.select(F.col(a).alias("node_id"), "relation_kind", F.lit(d).alias("direction"), F.col(b).alias("other"), "edge_id")
        for a, b, d in (("source_id", "target_id", "out"), ("target_id", "source_id", "in"))
    ]
    return both[0].unionByName(both[1]).join(of.select("node_id").distinct(), "node_id", "left_semi")


def topic_graph(edges: DataFrame) -> DataFrame:
    """topic_id, publishers, subscribers, shared: how many of each a topic has, and how many are both."""
    own = edges.where(F.col("relation_kind").isin("publishes_to", "subscribes_to"))
    per = own.groupBy("target_id", "source_id").agg(F.max((F.col("relation_kind") == "publishes_to").cast("int")).alias("p"), F.max((F.col("relation_kind") == "subscribes_to").cast("int")).alias("s"))
    return per.groupBy(F.col("target_id").alias("topic_id")).agg(F.sum("p").alias("publishers"), F.sum("s").alias("subscribers"), F.sum(F.col("p") * F.col("s")).alias("both"))


def boundary_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that any write or publication touches, in either role."""
    return edge_endpoints(edges.where(F.col("relation_kind").isin(*BOUNDARY))).select(F.col("endpoint").alias("node_id")).distinct()


def reached(edges: DataFrame, fresh: DataFrame, entry: DataFrame, kinds: list[str], hops: int, stop: DataFrame | None = None) -> DataFrame:
    """Nodes within some hops of the entries over fresh edges, undirected: node_id, hop (the first).

    Nodes of stop, and nodes that an asynchronous relation leads to, are reached but not gone beyond. Each hop joins the frontier with
    the endpoints by hash, drops what was seen, and is written before the next, so that plans stay short; nothing is collected, so
    fragments may be of any size.
    """
    if not 0 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be 0 to {MOST_HOPS}")
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"unknown relations: {sorted(unknown)}")
    e = edges.where(F.col("relation_kind").isin(*kinds)).select("source_id", "target_id", F.col("relation_kind").isin(*ASYNC).alias("handoff"))
    ends = F.array(F.struct(F.col("source_id").alias("at"), F.col("target_id").alias("to")), F.struct(F.col("target_id").alias("at"), F.col("source_id").alias("to")))
    pairs = settled(e.select("handoff", F.inline(ends)).join(fresh.select(F.col("node_id").alias("to")), "to", "left_semi"))
    step = settled(entry.select("node_id").distinct().join(fresh, "node_id", "left_semi").select("node_id", F.lit(False).alias("handoff"), F.lit(0).alias("hop")))
    seen = step
    for hop in range(1, hops + 1):
        frontier = step.where(~F.col("handoff")).select(F.col("node_id").alias("at"))
        if stop is not None and hop > 1:
            frontier = frontier.join(stop.select(F.col("node_id").alias("at")), "at", "left_anti")
        ahead = pairs.join(frontier, "at", "left_semi").groupBy(F.col("to").alias("node_id")).agg(F.min("handoff").alias("handoff"))
        step = settled(ahead.join(seen.select("node_id"), "node_id", "left_anti").select("node_id", "handoff", F.lit(hop).alias("hop")))
        seen = seen.unionByName(step)
    return seen.select("node_id", "hop")


def hop_shapes(edges: DataFrame, seen: DataFrame, kinds: list[str]) -> DataFrame:
    """hop, edges, next_hop_count, shape, async_handoff, polymorphic of the edges that a fragment took at each hop: those between a node
    of the hop before and one reached no earlier. Both ends count as next hops, so that an ordinary edge makes a hop `branching`."""
    e = edges.where(F.col("relation_kind").isin(*kinds))
    a, b = seen.select(F.col("node_id").alias("source_id"), F.col("hop").alias("ha")), seen.select(F.col("node_id").alias("target_id"), F.col("hop").alias("hb"))
    e = e.join(a, "source_id").join(b, "target_id").withColumn("hop", F.least("ha", "hb") + 1)
    e = e.where(F.col("hop") <= F.lit(MOST_HOPS))
    ends = e.select("hop", F.explode(F.array("source_id", "target_id")).alias("node")).groupBy("hop").agg(F.countDistinct("node").alias("next_hop_count"))
    per = e.groupBy("hop").agg(F.count(F.lit(1)).alias("edges"), F.max(F.col("relation_kind").isin(*ASYNC)).alias("async_handoff"), F.max(F.col("relation_kind") == "overrides").alias("polymorphic"))
    n = F.col("next_hop_count")
    return per.join(ends, "hop").select("hop", "edges", "next_hop_count", F.when(n == 0, "unresolved").when(n == 1, "single").otherwise("branching").alias("shape"), "async_handoff", "polymorphic")


def bounded_fragment(edges: DataFrame, fresh: DataFrame, entry: str, kinds: list[str], hops: int = 2, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES, stop: tuple[str, ...] = ()) -> dict:
    """The capped walk from one entry, edges in the order of their ids: entry, hops (each with its edges and shape), nodes, boundaries,
    stale_or_unknown, stop_reason, coverage. Caps make it depend on that order, so it runs hop by hop from the driver, which holds at
    most most_nodes nodes; each hop fetches at most most_edges + 1 edges of a node. The few ids that are asked for are filters, which reach
    the tables. stop: the walk doesn't go beyond nodes that an edge of these kinds touches."""
    if not entry or not kinds:
        raise ValueError("an entry and relations are needed")
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"unknown relations: {sorted(unknown)}")
    if not 0 <= hops <= MOST_HOPS or not 1 <= most_nodes <= MOST_NODES or not 1 <= most_edges <= MOST_EDGES:
        raise ValueError("caps are out of range")
    out: dict = {"entry": entry, "hops": [], "nodes": [], "boundaries": [], "stale_or_unknown": [], "stop_reason": "frontier_exhausted"}

    def among(ids: set[str], df: DataFrame) -> set[str]:
        if not ids:
            return set()
        return {r.node_id for r in df.select("node_id").where(F.col("node_id").isin(sorted(ids))).distinct().collect()}

    def touching(ids: set[str], df: DataFrame) -> DataFrame:
        return df.where(F.col("source_id").isin(sorted(ids)) | F.col("target_id").isin(sorted(ids)))

    def ends(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array("source_id", "target_id")).alias("node_id"))

    if not among({entry}, fresh):
        return out | {"stop_reason": "entry_stale_or_unknown", "coverage": "partial"}
    own = edges.where(F.col("relation_kind").isin(*kinds))
    nodes, taken, frontier = {entry}, set(), {entry}
    for hop in range(1, hops + 1):
        rows = touching(frontier, own).orderBy("edge_id").limit(len(taken) + most_edges + 1).collect()
        met = {i for r in rows for i in (r.source_id, r.target_id)}
        ok = among(met, fresh)
        boundary = among(met, ends(touching(met, edges.where(F.col("relation_kind").isin(*stop))))) if stop and met else set()
        record, ahead, full = [], set(), None
        for r in rows:
            if r.edge_id in taken:
                continue
            if len(taken) >= most_edges:
                full = "max_edges"
                break
            if not {r.source_id, r.target_id} <= ok:
                out["stale_or_unknown"].append(r.edge_id)
                continue
            new = {r.source_id, r.target_id} - nodes
            if len(nodes) + len(new) > most_nodes:
                full = "max_nodes"
                break
            taken.add(r.edge_id)
            record.append(r)
            nodes |= new
            for i in sorted(new):
                if i in boundary:
                    out["boundaries"].append(i)
                elif r.relation_kind not in ASYNC:
                    ahead.add(i)
        if record:
            both = {i for r in record for i in (r.source_id, r.target_id)}
            out["hops"].append({"hop": hop, "edges": [r.edge_id for r in record], "shape": "single" if len(both) == 1 else "branching", "next_hop_count": len(both), "async_handoff": any(r.relation_kind in ASYNC for r in record), "polymorphic": any(r.relation_kind == "overrides" for r in record)})
        frontier = ahead
        if full:
            out["stop_reason"] = full
            break
        if not frontier:
            break
    else:
        if frontier and hops:
            out["stop_reason"] = "hop_limit"
    out["nodes"] = sorted(nodes)
    natural = out["stop_reason"] == "frontier_exhausted" and not out["stale_or_unknown"]
    return out | {"coverage": "complete_for_indexed_bounded_query" if natural else "partial"}


def dangling(edges: DataFrame, nodes: DataFrame, ident: Column | None = None) -> DataFrame:
    """Ends of edges that no node has: edge_id, endpoint_role, endpoint. ident: the id of an edge by its other columns, where edges come
    without; it is made of dangling edges only, and moved with none. Each end is joined by itself, since two rows an edge take more room."""
    parts = []
    for end, role in (("source_id", "source"), ("target_id", "target")):
        e = edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_anti")
        parts.append(e.select((F.col("edge_id") if ident is None else ident).alias("edge_id"), F.lit(role).alias("endpoint_role"), F.col(end).alias("endpoint")))
    return parts[0].unionByName(parts[1])
