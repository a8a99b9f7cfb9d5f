"""The calls of a user over a small tree, as the command line and the JSON-RPC loop make them."""

import io
import json

import pytest
from claimweave import rpc
from claimweave.functions.ids import stable_id_of
from claimweave.operators import validate, views
from claimweave.plans.service import Service, consumed

B = "def helper():\n    return 1\n\n\ndef spare():\n    return 2\n"


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "a.py").write_text("from b import helper\n\n\ndef main():\n    return helper()\n")
    (root / "b.py").write_text(B)
    s = Service(spark, str(root), str(tmp_path_factory.mktemp("store") / "s"))
    assert s.warm()["derived"] == 2
    return s, root


def test_questions(service):
    s, root = service
    helper, main = stable_id_of("function", "b.py", "helper"), stable_id_of("function", "a.py", "main")
    assert s.reverse("callers", helper) == [main]
    hits = s.retrieve("where is helper defined", 3)
    assert helper in {h["claim_id"] for h in hits} and all(h["fresh"] for h in hits)
    assert "b.py:1" in s.explain(helper) and s.explain("nope") == "not found"
    assert s.resolve("helper")["claim_id"] == helper and s.resolve("zzz")["status"] == "not_found"
    f = s.fragment(main, ["calls"], 1)
    assert set(f["nodes"]) == {main, helper}
    assert s.context("helper main", 4000)["used_chars"] <= 4000
    assert s.status()["edges"] == {"calls": 1}
    v = s.validate()
    assert v["violations"] == 0 and v["dangling"] == 0 and v["stale"] == 0 and v["unsupported"] == 0
    with pytest.raises(ValueError):
        s.path("../x")
    assert {h["claim_id"] for h in s.path("b.py")} >= {helper}


def test_rpc_and_staleness(service):
    s, root = service
    helper = stable_id_of("function", "b.py", "helper")
    lines = [{"id": 1, "method": "tools/list"}, {"id": 2, "method": "callers", "params": {"node_id": helper}}, {"id": 3, "method": "nope"}, {"method": "status"}, {"id": 4, "method": "tools/call", "params": {"name": "fragment", "arguments": {"entry": helper, "relations": ["x"]}}}]
    sink = io.StringIO()
    rpc.serve(s, io.StringIO("\n".join(map(json.dumps, lines)) + "\n{bad\n"), sink)
    out = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert len(out[0]["result"]["tools"]) == 10 and out[1]["result"] == [stable_id_of("function", "a.py", "main")]
    assert [o["error"]["code"] for o in out[2:]] == [-32601, -32602, -32700]
    s.feedback(helper, "verified")
    assert s.store.get([helper]).first().evidence == "verified"
    (root / "b.py").write_text(B.replace("return 1", "return 9"))
    s._fresh = None
    assert s.stale_in("b.py") == ["helper"] and s.stale_calls("x = helper() + spare()") == ["helper"]
    assert s.reverse("callers", helper) == []
    expected = validate.expected_stale(s.store.read(), "b.py", 1)
    actual = s.fresh().where("not fresh").select("claim_id")
    r = validate.stale_scores(expected, actual).first()
    assert r.recall == 1.0
    (root / "b.py").write_text(B)
    s._fresh = None


def test_views_of_foreign_claims(spark, service):
    s, _ = service
    foreign = s.store.read().withColumn("trust", views.F.lit("unverified_foreign"))
    r = views.explained(foreign, s.fresh()).first()
    assert r.claim == views.PLACEHOLDER and r.confidence == 0 and r.level == "unverified_foreign"


def test_manifest_consumption(spark):
    m = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, ["y", "z"]), ("c", 3, ["w"])], "id string, ts int, entries array<string>")
    done = spark.createDataFrame([("c",)], "id string")
    assert [r.entry for r in consumed(m, done).collect()] == ["y", "z"]
