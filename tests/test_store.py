"""The store, warm, freshness scenarios, sources and hooks."""

import json
import sys

import pytest
from claimweave.operators import graph, incremental
from claimweave.operators.aggregate import inventory_digest, metrics_stats, release_verdict
from claimweave.operators.store import ClaimStore
from claimweave.plans import samples, warm
from claimweave.schema import CLAIM, conform
from claimweave.sources import files as sources
from claimweave.sources import corpora, hooks
from pyspark.sql import functions as F


def frame(spark, tree):
    from pyspark.sql import functions as F

    return spark.createDataFrame(sorted(tree.items()), "path string, text string").withColumn("blob", sources.git_blob(F.col("text")))


TREE = {"b.py": "def helper():\n    return 1\n\n\ndef spare():\n    return 2\n", "a.py": "from b import helper\n\n\ndef main():\n    return helper()\n", "app.json": '{"k": 1}'}


def stale(claims, tree, spark):
    f = frame(spark, tree)
    symbols = warm.symbols_of(f)
    return {r.claim_id for r in warm.freshness_of(claims, f, symbols).where("not fresh").collect()}


def test_warm_and_freshness(spark, tmp_path):
    store = ClaimStore(spark, str(tmp_path / "s"))
    assert warm.warm(store, frame(spark, TREE))["derived"] == 3
    assert warm.warm(store, frame(spark, TREE))["noop"]
    claims = store.read().cache()
    named = {r.qualname: r.claim_id for r in claims.where("scope = 'function'").collect()}
    edges = claims.where("edge_kind = 'calls'").collect()
    assert len(edges) == 1 and edges[0].target_id == named["helper"]
    edited = TREE | {"b.py": TREE["b.py"].replace("return 1", "return 3")}
    gone = stale(claims, edited, spark)
    assert named["helper"] in gone and named["spare"] not in gone and named["main"] not in gone
    comment = TREE | {"b.py": "# hello\n" + TREE["b.py"]}
    assert named["helper"] not in stale(claims, comment, spark)
    renamed = {**TREE, "b.py": TREE["b.py"].replace("helper", "renamed")}
    done = warm.warm(store, frame(spark, renamed))
    assert done["derived"] == 1 and not done["noop"]
    now = {r.qualname for r in store.read().where("scope = 'function'").collect()}
    assert now == {"main", "renamed", "spare"} and store.read().where("edge_kind = 'calls'").count() == 0
    warm.warm(store, frame(spark, {k: v for k, v in renamed.items() if k != "app.json"}))
    assert store.read().where("owner_path = 'app.json'").count() == 0


def test_store_versions_and_trust(spark, tmp_path):
    a = ClaimStore(spark, str(tmp_path / "s"), "one")
    row = conform(spark.createDataFrame([("x", 3.0)], "claim_id string, confidence double"))
    v1 = a.commit(row)
    v2 = a.put(conform(spark.createDataFrame([("y", 0.5)], "claim_id string, confidence double")))
    assert v1 != v2 == a.current() and {r.claim_id for r in a.read().collect()} == {"x", "y"} and a.get(["x"]).first().confidence == 1.0
    b = ClaimStore(spark, str(tmp_path / "s"), "two")
    assert {r.trust for r in b.read().collect()} == {"unverified_foreign"} and {r.trust for r in a.read().collect()} == {"local"}
    a.delete(spark.createDataFrame([("x",)], "claim_id string"))
    assert [r.claim_id for r in a.read().collect()] == ["y"]
    with a.change(), pytest.raises(RuntimeError):
        b.commit(row)


def test_all_samples_derive(spark):
    claims, symbols = warm.derive(frame(spark, samples.PYTHON | samples.CONFIG | samples.JAVA))
    kinds = {r.edge_kind for r in claims.select("edge_kind").distinct().collect()}
    assert {"calls", "reads", "writes", "reads_env", "reads_config_key", "uses_type", "injects", "listens_type", "declares_service_presence"} <= kinds
    assert claims.select("claim_id").distinct().count() == claims.count() and symbols.count() > 20
    assert claims.where("confidence < 0 or confidence > 1").count() == 0


def test_edges_without_ids(spark):
    """Dangling ends are the same whether edges come with ids or get them at the end; reconciliation compares the edges of the paths alone."""
    rows = [("calls", "a", "b", None), ("calls", "a", "gone", None), ("inherits", "lost", "b", "extends"), ("calls", "gone", "gone", None)]
    e = spark.createDataFrame(rows, "relation_kind string, source_id string, target_id string, relation string")
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    known = e.withColumn("edge_id", corpora.edge_identity())
    late, early = graph.dangling(e, nodes, corpora.edge_identity()), graph.dangling(known, nodes)
    assert sorted(late.collect()) == sorted(early.collect()) and sorted((r.endpoint_role, r.endpoint) for r in late.collect()) == [("source", "gone"), ("source", "lost"), ("target", "gone"), ("target", "gone")]
    owned = known.withColumn("owner_path", F.concat("source_id", F.lit(".py")))
    again = owned.where("target_id = 'b'")
    paths = spark.createDataFrame([("a.py",), ("lost.py",)], "path string")
    for derived in (again, again.drop("owner_path")):
        assert [r.target_id for r in incremental.reconcile_edges(owned, derived, paths).collect()] == ["gone"]


def test_bounded_fragment_stops_at_kinds(spark):
    """The walk reaches what a write touches and doesn't go beyond it; without a stop it does."""
    e = spark.createDataFrame([("e1", "calls", "a", "b"), ("e2", "calls", "b", "c"), ("e3", "writes", "x", "b"), ("e4", "calls", "a", "d"), ("e5", "calls", "d", "f")], "edge_id string, relation_kind string, source_id string, target_id string")
    fresh = spark.createDataFrame([(x,) for x in "abcdfx"], "node_id string")
    out = graph.bounded_fragment(e, fresh, "a", ["calls"], 2, stop=graph.BOUNDARY)
    assert (out["nodes"], out["boundaries"]) == (["a", "b", "d", "f"], ["b"])
    assert graph.bounded_fragment(e, fresh, "a", ["calls"], 2)["nodes"] == ["a", "b", "c", "d", "f"]


def test_bounded_fragment_rules(spark):
    e = spark.createDataFrame([(f"e{i}", "calls", "n0", f"n{i}", None) for i in range(1, 90)] + [("f1", "publishes_to", "n1", "t", None), ("f2", "calls", "t", "u", None)], "edge_id string, relation_kind string, source_id string, target_id string, relation string")
    fresh = spark.createDataFrame([(f"n{i}",) for i in range(90)] + [("t",), ("u",)], "node_id string")
    out = graph.bounded_fragment(e, fresh, "n0", ["calls"], 2)
    assert out["stop_reason"] == "max_nodes" and len(out["nodes"]) == graph.MOST_NODES and out["coverage"] == "partial"
    out = graph.bounded_fragment(e, fresh, "n1", ["publishes_to", "calls"], 1, most_edges=5)
    assert {"n0", "t"} <= set(out["nodes"]) and out["stop_reason"] == "hop_limit"
    far = {r.node_id for r in graph.reached(e, fresh, spark.createDataFrame([("n1",)], "node_id string"), ["publishes_to", "calls"], 3).collect()}
    assert "t" in far and "u" not in far
    assert graph.bounded_fragment(e, fresh, "nobody", ["calls"])["stop_reason"] == "entry_stale_or_unknown"
    for bad in ({"hops": 9}, {"most_nodes": 65}, {"kinds": ["nope"]}):
        with pytest.raises(ValueError):
            graph.bounded_fragment(e, fresh, "n0", bad.pop("kinds", ["calls"]), **bad)


def test_source_tree(spark, tmp_path):
    for p, t in {"a.py": "x = 1\n", "lib/b.json": "{}", "skip/c.py": "y", ".git/d.py": "z", "e.bin": "q"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text(t)
    got = {r.path: r.blob for r in sources.source_tree(spark, str(tmp_path), ["# note", "skip/"]).collect()}
    assert set(got) == {"a.py", "lib/b.json"}
    assert got["lib/b.json"] == "9e26dfeeb6e641a33dae4961196235bdb965b21b"


def test_logs_and_records(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps({"ts": "2024-01-02T00:00:00", "event": e, "duration_ms": d}) for e, d in (("cache_hit", None), ("miss", None), ("rederive", "1.5"), ("rederive", "bad"))]) + "\nnot json\n")
    r = metrics_stats(sources.metrics_log(spark, str(tmp_path / "log.jsonl"))).first()
    assert (r.events, r.hits, r.misses, r.rederive_duration_ms_total, r.hit_rate) == (4, 1, 1, 1.5, 0.5)
    (tmp_path / "c.jsonl").write_text('{"claim_id": "a", "schema_version": "v1"}\n{"claim_id": "b", "schema_version": "v9"}\n{bad\n')
    assert [x.claim_id for x in sources.claim_records(spark, str(tmp_path / "c.jsonl"), CLAIM).collect()] == ["a"]


def test_digest_is_free_of_order(spark):
    d = spark.range(1000).selectExpr("id as k", "cast(id * 7 as string) as v")
    assert inventory_digest(d, "k", "v").first() == inventory_digest(d.orderBy("v").repartition(7), "k", "v").first()
    assert inventory_digest(d.where("k <> 5"), "k", "v").first().digest != inventory_digest(d, "k", "v").first().digest
    v = release_verdict(spark.createDataFrame([("a", 5.0, 10.0, 3.0), ("a", 1.0, 10.0, 3.0), ("b", 11.0, 10.0, 3.0)], "name string, value double, hard_limit double, target_limit double"))
    assert {r.name: r.verdict for r in v.collect()} == {"a": "WARN", "b": "NO-GO"}


def test_hooks(spark, tmp_path):
    ok = [sys.executable, "-c", "import json,sys; t=json.load(sys.stdin)['texts']; print(json.dumps({'vectors': [[float(len(x))] for x in t]}))"]
    d = spark.createDataFrame([("a", "xx"), ("b", "xxx")], "claim_id string, claim string")
    assert sorted(r.v[0] for r in d.select(hooks.embedder(ok)("claim").alias("v")).collect()) == [2.0, 3.0]
    assert [r.v for r in d.select(hooks.embedder(["/no/such"])("claim").alias("v")).collect()] == [None, None]
    router = [sys.executable, "-c", "print('{\"ids\": [\"b\", \"zz\", \"b\", \"a\"]}')"]
    assert hooks.route("q", d, router, 5) == ["b", "a"] and hooks.route("q", d, ["/no/such"], 5) == []
    f = spark.createDataFrame([("i", "def go(): pass", "k.go")], "claim_id string, source string, qualname string")
    assert hooks.candidates(f, hooks.NameDeriver()).first().supported


def _digest(store):
    return {(r.claim_id, r.confidence, str(r.bindings), r.body) for r in store.read().collect()}


def test_warm_after_an_edit_is_a_clean_warm(spark, tmp_path):
    tree = TREE | {"pkg/c.py": "import b\n\n\ndef go():\n    b.helper()\n    b.late()\n", "J.java": "class J { void m() { } void n() { m(); } }"}
    store = ClaimStore(spark, str(tmp_path / "s"))
    warm.warm(store, frame(spark, tree))
    before = {t: dict(m) for t, m in store.version()["tables"].items()}
    edited = {k: v for k, v in tree.items() if k != "app.json"} | {"b.py": TREE["b.py"].replace("return 1", "return 3") + "\n\ndef late():\n    return 4\n"}
    done = warm.warm(store, frame(spark, edited))
    assert (done["derived"], done["removed"]) == (1, 1)
    clean = ClaimStore(spark, str(tmp_path / "clean"))
    warm.warm(clean, frame(spark, edited))
    assert _digest(store) == _digest(clean)
    after = store.version()["tables"]
    assert before["java"] == after["java"] and before["claims"] != after["claims"] and any(before["claims"].get(b) == f for b, f in after["claims"].items())
    assert {r.owner_path for r in store.owned_by("b.py").collect()} == {"b.py"}


def test_moved_files_keep_what_was_said(spark, tmp_path):
    from claimweave.operators import views

    store = ClaimStore(spark, str(tmp_path / "s"))
    warm.warm(store, frame(spark, TREE))
    old = store.read().where("qualname = 'spare'").first()
    given = spark.createDataFrame([(old.claim_id, "verified")], "claim_id string, kind string")
    store.update([old.claim_id], lambda own: views.with_feedback(own, given))
    said = store.get([old.claim_id]).first()
    moved = {("lib/b.py" if k == "b.py" else k): v for k, v in TREE.items()}
    warm.warm(store, frame(spark, moved))
    new = store.read().where("qualname = 'spare'").first()
    assert new.claim_id != old.claim_id and (new.endorsed_by, new.evidence, new.confidence) == (said.endorsed_by, said.evidence, said.confidence)


def test_a_slow_file_fails_alone_and_is_tried_again(spark, tmp_path):
    tree = TREE | {"slow.py": "def slow():\n    " + "\n    ".join(f"a{i} = b{i}.c(d[{i}])" for i in range(8_000)) + "\n"}
    store = ClaimStore(spark, str(tmp_path / "s"))
    done = warm.warm(store, frame(spark, tree), seconds=0.02)
    assert done["status"] == "partial" and done["failed"] == {"slow.py": "timeout"}
    assert store.read().where("owner_path = 'b.py'").count() > 0 and store.read().where("owner_path = 'slow.py'").count() == 0
    done = warm.warm(store, frame(spark, tree))
    assert (done["derived"], done["failed"], done["status"]) == (1, {}, "complete") and store.read().where("qualname = 'slow'").count() == 1
    assert warm.warm(store, frame(spark, tree))["noop"]


def test_two_writers_lose_no_update(spark, tmp_path):
    import threading

    store = ClaimStore(spark, str(tmp_path / "s"))
    rows = [conform(spark.createDataFrame([(f"c{i}", 0.5, f"p{i}.py")], "claim_id string, confidence double, owner_path string")) for i in range(4)]
    errors = []

    def write(r):
        try:
            ClaimStore(spark, str(tmp_path / "s")).put(r, wait=120)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(r,)) for r in rows]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and {r.claim_id for r in store.read().collect()} == {"c0", "c1", "c2", "c3"} and store.current() == "4"
    with store.change():
        with pytest.raises(RuntimeError):
            ClaimStore(spark, str(tmp_path / "s")).put(rows[0])
    first = store.version(2)
    assert len(store.children("_versions")) == 3 and first["number"] == 2


def test_the_lock_of_a_dead_writer_expires(spark, tmp_path, monkeypatch):
    from claimweave.operators import store as module

    store = ClaimStore(spark, str(tmp_path / "s"))
    (tmp_path / "s" / "LOCK").write_text("")
    with pytest.raises(RuntimeError):
        with store.change():
            pass
    monkeypatch.setattr(module, "EXPIRES", -1.0)
    with store.change():
        assert (tmp_path / "s" / "LOCK").exists()
    assert not (tmp_path / "s" / "LOCK").exists()


def test_git_source(spark, tmp_path):
    import subprocess

    from claimweave.sources import git

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t.org", *a], check=True, capture_output=True)
    assert git.head(str(tmp_path)) is None and git.tracked(spark, str(tmp_path)).count() == 0
    run("init", "-q")
    (tmp_path / "a b.py").write_text("x = 1\n")
    (tmp_path / "new.py").write_text("y = 1\n")
    run("add", "a b.py")
    run("commit", "-q", "-m", "first")
    (tmp_path / "a b.py").write_text("x = 2\n")
    assert len(git.head(str(tmp_path))) == 40 and [r.path for r in git.tracked(spark, str(tmp_path)).collect()] == ["a b.py"]
    old = git.head_blob(str(tmp_path), "a b.py")
    assert {(r.path, r.blob) for r in git.committed(spark, str(tmp_path)).collect()} == {("a b.py", old)} and git.head_blob(str(tmp_path), "new.py") is None
    now = {r.path: r.blob for r in sources.source_tree(spark, str(tmp_path)).collect()}
    assert now["a b.py"] != old


def test_metrics_append(spark, tmp_path):
    log = str(tmp_path / "log")
    d = spark.createDataFrame([("miss", "n1", "secret"), ("cache_hit", "n2", "secret")], "event string, node_id string, source_text string")
    sources.append_metrics(d, log)
    sources.append_metrics(d.limit(1), log)
    assert sources.metrics_log(spark, log).count() == 3
    assert all("secret" not in f.read_text() for f in (tmp_path / "log").glob("*.json"))
