"""Extractors, resolvers and adapters over written sources."""

import json

import pytest
from claimweave.functions.ids import SPECS, stable_id_of
from claimweave.functions.text import query_terms
from claimweave.operators import contracts
from claimweave.operators.extract.config import config_keys, keys_of, simple_yaml
from claimweave.operators.extract.java import _read as java_file
from claimweave.operators.extract.java import java_rows, parse_type, type_names
from claimweave.operators.extract.python import python_rows, rows_of
from claimweave.operators.extract.sql import declarations
from claimweave.operators.resolve import annotations, java, python
from claimweave.plans import samples


def test_ids():
    assert len(SPECS) >= 60
    assert stable_id_of("calls", "a", "b") == "claim_edge_59d22d7c5e9a4f7a" or stable_id_of("calls", "a", "b").startswith("claim_edge_")
    assert stable_id_of("api", "p", "get", "/x", "h") == stable_id_of("api", "p", "GET", "/x", "h")


def test_query_terms():
    assert query_terms("booking tested planned the declarations of") == sorted(["booking", "book", "tested", "test", "planned", "plann", "plan", "the", "declarations", "declar", "declaration"])


def hash_of(source, name):
    return next(r[6] for r in rows_of("a.py", source) if r[1] == "function" and r[2] == name)


def test_span_hashes_ignore_layout_and_comments():
    a = "def f(x):\n    return x\n\n\ndef g():\n    return f(1)\n"
    assert hash_of(a, "f") == hash_of("# note\n" + a.replace("return x", "return  x  # why"), "f")
    assert hash_of(a, "f") != hash_of(a.replace("return x", "return -x"), "f")
    c = "class K:\n    def m(self):\n        return 1\n"
    assert hash_of(c, "K.m") == hash_of(c.replace("    def m", "    other = 2\n\n    def m"), "K.m")


@pytest.fixture(scope="module")
def py(spark):
    files = samples.files(spark, samples.PYTHON)
    return python_rows(files).cache(), files


def test_python_nodes(py):
    rows = py[0].collect()
    named = {(r.kind, r.qualname): r for r in rows if r.kind in ("function", "class", "declaration", "api")}
    assert {("function", "Service.run"), ("function", "Base.shared"), ("class", "Service"), ("declaration", "RATE"), ("declaration", "DEFAULTS"), ("function", "stream"), ("api", "items")} <= set(named)
    run = json.loads(named["function", "Service.run"].detail)
    assert run["signature"] == "def run(self, x: int, *rest, flag=False, **more) -> int" and run["raises"] == ["ValueError"] and run["return"]["shape"] == "value"
    assert [p["kind"] for p in run["params"]] == ["positional", "positional", "vararg", "kwonly", "kwarg"]
    stream = json.loads(named["function", "stream"].detail)
    assert stream["is_async"] and stream["is_generator"]
    assert sorted(json.loads(r.detail)["method"] for r in rows if r.kind == "api") == ["GET", "POST"]
    assert not [r for r in rows if r.path == "shop/broken.py"]


def test_python_relations(py):
    rows, files = py
    edges, unresolved = python.calls(rows, files)
    got = {(r.caller, r.target, r.resolution) for r in edges.collect()}
    assert ("Service.run", "fetch", "from_import_direct_top_level") in got and ("Service.run", "Base.shared", "module_name_or_self_method") in got and ("items", "setup", "module_name_or_self_method") in got
    reasons = {(r.qualname, r.reason) for r in unresolved.collect()}
    assert ("Service.run", "self_method_not_found_in_class_or_unique_resolved_base") in reasons
    reads = {(r.qualname, r.target) for r in python.declaration_relations(rows, files, "read").collect()}
    assert reads >= {("Service.run", "RATE"), ("Service.run", "LIMIT")}
    assert {(r.qualname, r.target, r.resolution) for r in python.declaration_relations(rows, files, "write").collect()} == {("setup", "RATE", "global_module_declaration_assignment")}
    assert {(r.qualname, r.env_name) for r in python.env_reads(rows).collect()} == {("setup", "HOME_DIR")}


def test_python_rows_that_are_wanted(monkeypatch):
    """Only what is asked for is made: without hashes no tokens are read, without details no interfaces and references."""
    source = samples.PYTHON["shop/service.py"]
    whole = [r for r in rows_of("a.py", source) if r[1] == "function"]
    assert rows_of("a.py", source, {"function": ("hash", "docstring", "detail")}) == whole and whole
    for name in ("Tokens", "interface", "references"):
        monkeypatch.setattr(f"claimweave.operators.extract.python.{name}", None)
    assert rows_of("a.py", source, {"function": ()}) == [(*r[:6], None, None, None) for r in whole]


LINKED = {
    "p/a.py": "from p.b import far as f, LIMIT as L, far as g\nimport p.b\nfrom p.a import own as me\nimport p.c\nimport gone\nX = 1\ndef own():\n    global X\n    X = 2\n    X += 1\n    f(); g(); p.b(); me(); own(); L; X; nothing(); gone.x()\n    q.b(); p.c.d(); f().x()\n",
    "p/b.py": "LIMIT = 1\ndef far(): pass\nclass A:\n    def m(self): pass\nclass B(A):\n    def n(self):\n        self.m(); self.n(); self.z()\nclass C(B, Outside):\n    def o(self):\n        self.m()\nclass D(B):\n    def p(self):\n        self.m()\n",
    "p/c.py": "def e(): pass\n",
    "p/c/__init__.py": "def e(): pass\n",
    "p/d.py": "from p import c\nfrom . import b\nfrom p.c import e\nfrom .b import far, none\nimport b as k\ndef h():\n    e(); far(); none(); c.e(); b.far(); k.far()\n",
}


def test_python_links(spark):
    """A file's own references are settled in one pass over its rows, from the files or from stored rows alike."""
    files = spark.createDataFrame(sorted(LINKED.items()), "path string, text string")
    rows = python_rows(files)
    for kind in ("call", "read", "write"):
        assert sorted(map(str, python.links(rows, kind).collect())) == sorted(map(str, python.file_links(files, kind).collect()))
    edges, bad = python.calls(rows, files)
    got = sorted((r.path, r.caller, r.target_path, r.target, r.resolution) for r in edges.collect())
    name, own = "from_import_direct_top_level", "module_name_or_self_method"
    assert got == [("p/a.py", "own", "p/a.py", "own", name), ("p/a.py", "own", "p/b.py", "far", name), ("p/b.py", "B.n", "p/b.py", "A.m", own), ("p/b.py", "B.n", "p/b.py", "B.n", own), ("p/b.py", "D.p", "p/b.py", "A.m", own), ("p/d.py", "h", "p/b.py", "far", name)]
    assert all(r.caller_hash and r.callee_hash for r in edges.collect())
    reasons = {(r.path, r.expr): r.reason for r in bad.collect()}
    assert reasons["p/d.py", "e"] == "import_module_ambiguous" and reasons["p/d.py", "none"] == "from_import_symbol_not_direct_top_level_def" and reasons["p/d.py", "k.far"] == "import_module_not_found"
    assert reasons["p/b.py", "self.m"] == "self_method_not_found_in_class_or_unique_resolved_base" and reasons["p/a.py", "nothing"] == "name_not_module_local_function" and reasons["p/a.py", "q.b"] == "attribute_call_not_resolved"
    assert {(r.target_path, r.target) for r in python.declaration_relations(rows, files, "read").collect()} == {("p/a.py", "X"), ("p/b.py", "LIMIT")}
    assert [(r.target, r.resolution) for r in python.declaration_relations(rows, files, "write").collect()] == [("X", "global_module_declaration_assignment")]


def test_config(spark, py):
    keys = config_keys(samples.files(spark, samples.CONFIG))
    got = {(r.path, r.key): r for r in keys.collect()}
    assert {k for p, k in got if p == "conf/app.yaml"} == {"service", "service.port", "service.name", "feature"} and got["conf/app.yaml", "service.port"].line_start == 2
    assert {k for p, k in got if p == "conf/app.json"} == {"db", "db.host", "db.port", "name"} and ("conf/app.toml", "owner.name") in got
    assert not [p for p, _ in got if p in ("conf/list.yaml", "conf/bad.json")]
    reads = [(r.key, r.reason) for r in python.config_reads(py[0], keys).collect()]
    assert reads == [("db.host", None)]
    same = keys_of("a.json", '{"b":1, "a":{"x":[1,2]}}'), keys_of("a.json", '{"a": {"x": [1, 2]},\n "b": 1}')
    assert [r[3] for r in same[0]] == [r[3] for r in same[1]]
    assert simple_yaml("a: 1\na: 2\n") is None and simple_yaml("a:\t1\n") is None


def test_sql_declarations(spark):
    d = declarations(spark.createDataFrame([("a.sql", 'create table users (i int);\n-- x\nCREATE OR REPLACE VIEW "Active Users" as select 1;'), ("b.py", "create table no (i int)"), ("c.sql", None)], "path string, text string"))
    assert [(r.declaration_kind, r.qualname, r.line_start) for r in d.orderBy("line_start").collect()] == [("sql_table", "users", 1), ("sql_view", "Active Users", 3)]


def test_java_rows_that_are_wanted(monkeypatch):
    """Only what is asked for is made: the same rows without hashes, and no bodies are read for types and members."""
    whole = {p: java_file(p, s).rows for p, s in samples.JAVA.items()}
    monkeypatch.setattr("claimweave.operators.extract.java.Tokens.span_hash", None)
    for want in java.NEEDS.values():
        for p, s in samples.JAVA.items():
            assert java_file(p, s, want).rows == [(*r[:6], None, r[7] if "detail" in want[r[1]] else None) for r in whole[p] if r[1] in want]


@pytest.fixture(scope="module")
def jv(spark):
    return java_rows(samples.files(spark, samples.JAVA)).cache()


def test_java_nodes(jv):
    t = {r.qualname: r for r in java.types(jv).collect()}
    assert {"Orders", "Billing", "Order", "User", "Users", "UserMapper", "Settings", "BillingClient"} == set(t) and t["Users"].node_kind == "interface"
    m = {(r.qualname, r.identity) for r in java.members(jv).collect()}
    assert ("Billing.bill", "Billing.bill(long)") in m and ("Orders.get", "Orders.get") in m


def test_java_calls(jv):
    got = {(r.caller, r.name): r for r in java.calls(jv).collect()}
    assert got["Orders.get", "bill"].target_id == stable_id_of("java_node", "method", "src/main/java/app/Orders.java", "Billing.bill(long)")
    assert got["Billing.bill", "Order"].resolution == "java_same_file_constructor"
    assert got["Orders.post", "name"].resolution.startswith("java_project_typed_receiver")
    assert got["Orders.post", "send"].reason == "java_external_or_jdk_receiver"


def test_java_relations(jv):
    uses = {(r.user, r.type_name, r.use_kind): r.how for r in java.type_uses(jv).collect() if r.how}
    assert uses["Orders.get", "Order", "return"] == "same_file" and ("Orders.billing", "Billing", "field") in uses
    fields = {(r.caller, r.target, r.use) for r in java.field_uses(jv).collect()}
    assert {("Orders.get", "Orders.count", "read"), ("Orders.get", "Orders.count", "write"), ("Order.Order", "Order.name", "write")} <= fields


def test_java_frameworks(jv):
    routes = {(r.method, r.route_path) for r in annotations.mvc_routes(jv).collect()}
    assert {("GET", "/orders/{id}"), ("GET", "/orders/by/{id}"), ("POST", "/orders")} <= routes
    assert [(r.route_path, r.service_name) for r in annotations.feign_routes(jv).collect()] == [("/api/bills", "billing")]
    topics = {(r.topic, r.edge_kind) for r in annotations.topic_edges(jv).collect()}
    assert topics == {("orders", "publishes_to"), ("orders", "subscribes_to"), ("returns", "subscribes_to")}
    assert [r.source if hasattr(r, "source") else r.owner for r in annotations.event_edges(jv).collect()] == ["Orders.on"]
    assert [(r.injector, r.reason) for r in annotations.injections(jv).collect()] == [("Orders.billing", None)]
    assert [(r.owner, r.prefix) for r in annotations.configuration_properties(jv).collect()] == [("Settings", "app.data")]
    assert [r.statement for r in annotations.mybatis_statements(jv).collect()] == ["select * from users"]
    assert [(r.repository, r.domain_type, r.id_type) for r in annotations.repositories(jv).collect()] == [("Users", "User", "Long")]
    assert {r.label for r in annotations.literal_declarations(jv, **annotations.PERSISTENCE).collect()} == {"entity", "table", "id"}
    meta = {(r.family, r.owner): r for r in annotations.annotation_metadata(jv).collect()}
    assert meta["service", "Billing"].edge_kind == "declares_service_presence" and meta["autowired", "Orders.billing"].claim_id
    assert json.loads(meta["scheduling", "Orders.tick"].metadata) == {"fixedRate": "1000"}
    assert meta["transaction", "Orders.post"].claim_id and meta["rest_controller", "Orders"].claim_id
    assert meta["cache", "Billing.bill"].reason == "cache_owner_ambiguous"


def test_java_type_texts():
    t = parse_type("java.util.Map<String, List<? extends T[]>>[]")
    assert (t["simple_name"], t["array_dims"], t["type_arguments"]) == ("Map", 1, ["String", "List<? extends T[]>"])
    assert type_names("Map<String, List<int[]>>") == ["Map", "String", "List"]
    assert parse_type("int...")["varargs"] and parse_type("? super X")["wildcard"] == "super"


def test_overload_cost(spark):
    from claimweave.plans.registry import QUERIES

    got = {(r.call, r.sig): r.cost for r in QUERIES["overload_rank"](spark, "").collect()}
    assert got[1, "long"] == 1 and got[1, "double"] == 3 and got[1, "Object"] == 20 and got[2, "long"] == 11 and got[4, "int..."] == 100


def test_contract_sanitiser(spark):
    s = "array<struct<name:string,meaning:string>>"
    d = spark.createDataFrame([([("a", "x"), ("a", "y"), ("b", "z")], [("E", "")], "a dict", ["pure", "logs"], 0.9, ["a"], [], False, True)], f"params {s}, raises {s}, returns string, side_effects array<string>, confidence double, mech_params array<string>, mech_raises array<string>, has_value boolean, has_write boolean")
    r = contracts.sanitised(d).first()
    assert [p.name for p in r.params] == ["a"] and r.raises == [] and r.returns is None and r.side_effects == ["logs"] and r.confidence == 0.6 and len(r.checks) == 5
