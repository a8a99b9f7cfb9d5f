"""Java references to relations. Every rule is a join; a reference is linked only if one target is left, else it has a reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimweave.functions.ids import stable_id
from claimweave.tables import settled

JDK = r"^(java|javax|jdk)\."
#: The kinds of rows, and what of them, that types are resolved by; and what each relation needs besides.
TYPES = {"package": (), "import": ("detail",), "type": ("detail",)}
MEMBERS = dict.fromkeys(("method", "constructor", "field"), ("detail",))
NEEDS = {
    "types": {"type": ("detail",)},
    "inherits": TYPES,
    "overrides": TYPES | {"method": ("detail",)},
    "field_uses": TYPES | MEMBERS | {"field_use": ("detail",)},
    "calls": TYPES | MEMBERS | {"call": ("detail",)},
    "injections": TYPES | MEMBERS | {"annotation": ("detail",)},
    "aggregate_channels": TYPES | {"method": ("detail",)},
}


def _d(key: str) -> Column:
    return F.get_json_object("detail", f"$.{key}")


def once(rows: DataFrame, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table over rows that several resolvers need, written once for these rows."""
    done = rows.__dict__.setdefault("_settled", {})
    if name not in done:
        done[name] = settled(make())
    return done[name]


def types(rows: DataFrame) -> DataFrame:
    return once(rows, "types", lambda: _types(rows))


def members(rows: DataFrame) -> DataFrame:
    return once(rows, "members", lambda: _members(rows))


def inherits(rows: DataFrame) -> DataFrame:
    return once(rows, "inherits", lambda: _inherits(rows))


def supertypes(rows: DataFrame, only: str | None = None) -> DataFrame:
    return once(rows, f"supertypes-{only}", lambda: ancestors(inherits(rows), only=only))


def _types(rows: DataFrame) -> DataFrame:
    """path, qualname, simple, package, fqn, node_kind, hash, node_id of all types."""
    t = rows.where("kind = 'type'").select("path", "qualname", "hash", _d("node_kind").alias("node_kind"), _d("package").alias("package"))
    fqn = F.when(F.col("package") == "", F.col("qualname")).otherwise(F.concat_ws(".", "package", "qualname"))
    return t.withColumn("simple", F.substring_index("qualname", ".", -1)).withColumn("fqn", fqn).withColumn("node_id", stable_id("java_node", "node_kind", "path", "qualname"))


def _members(rows: DataFrame) -> DataFrame:
    """Methods, constructors and fields: path, owner, qualname, simple, node_kind, identity, arity, varargs, generic, params, return_type, type, hash, node_id.

    Overloads have an identity with their parameter types; a name that stands alone is its own identity.
    """
    m = rows.where("kind in ('method', 'constructor', 'field')")
    params = F.from_json(_d("params"), "array<struct<type:string,name:string,varargs:boolean>>")
    kind = F.when(F.col("kind") == "field", _d("node_kind")).otherwise(F.col("kind"))
    m = m.select("path", "owner", "qualname", F.substring_index("qualname", ".", -1).alias("simple"), kind.alias("node_kind"), _d("arity").cast("int").alias("arity"), _d("varargs").cast("boolean").alias("varargs"), _d("generic").cast("boolean").alias("generic"), params["type"].alias("params"), _d("return_type").alias("return_type"), _d("type").alias("type"), "line_start", "line_end", "hash")
    same = F.count(F.lit(1)).over(Window.partitionBy("path", "qualname", "node_kind"))  # bounded by a class's overloads
    identity = F.when(F.col("n") > 1, F.concat("qualname", F.lit("("), F.array_join("params", ","), F.lit(")"))).otherwise(F.col("qualname"))
    return m.withColumn("n", same).withColumn("identity", identity).drop("n").withColumn("node_id", stable_id("java_node", "node_kind", "path", "identity"))


def resolve_types(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """refs (path, type_name, ...) with target_path, target, target_id, target_kind, fqn, how, reason.

    In order: the only type of that name in the file; the explicit import; a qualified name; the only type of that name in the package;
    else a JDK or external placeholder, or a reason. A name that is unique in another package isn't linked.
    """
    t = types(rows)
    imports = rows.where("kind = 'import'").where(_d("static") == "false").where(_d("wildcard") == "false").select("path", F.col("qualname").alias("simple_ref"), _d("fqn").alias("imported"))
    wild = (F.col("kind") == "import") & (_d("wildcard") == "true")
    scope = rows.where("kind in ('package', 'import')").where((F.col("kind") == "package") | wild).groupBy("path").agg(F.min(F.when(F.col("kind") == "package", F.col("qualname"))).alias("own_package"), F.max(F.when(wild, F.lit(True))).alias("has_wild"))
    names = refs.select("path", "type_name").distinct().withColumn("simple_ref", F.substring_index("type_name", ".", -1))
    names = names.join(scope, "path", "left").withColumn("own_package", F.coalesce("own_package", F.lit("")))

    def only(df: DataFrame, *keys: str) -> DataFrame:
        one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "qualname", "node_id", "node_kind", "fqn")).alias("hit"))
        return one.select(*keys, F.when(F.col("n") == 1, F.col("hit")).alias("hit"), "n")

    # what a simple name is in its file: the types of that name, the import
    types_here = t.select("path", F.col("simple").alias("simple_ref"), F.struct("path", "qualname", "node_id", "node_kind", "fqn").alias("hit"), F.lit(None).cast("string").alias("imported"))
    here = types_here.unionByName(imports.withColumn("hit", F.lit(None).cast(types_here.schema["hit"].dataType)))
    here = here.groupBy("path", "simple_ref").agg(F.count("hit").alias("n1"), F.min("hit").alias("h1"), F.min("imported").alias("imported"))
    here = here.select("path", "simple_ref", F.when(F.col("n1") == 1, F.col("h1")).alias("h1"), F.when(F.col("n1") > 0, F.col("n1")).alias("n1"), "imported")
    by_fqn = only(t, "fqn")
    near = only(t.where(~F.contains("qualname", F.lit("."))), "package", "simple").select(F.col("package").alias("own_package"), F.col("simple").alias("simple_ref"), F.col("hit").alias("h4"), F.col("n").alias("n4"))
    names = names.join(here, ["path", "simple_ref"], "left")
    names = names.join(by_fqn.select(F.col("fqn").alias("imported"), F.col("hit").alias("h2"), F.col("n").alias("n2")), "imported", "left")
    names = names.join(by_fqn.select(F.col("fqn").alias("type_name"), F.col("hit").alias("h3"), F.col("n").alias("n3")), "type_name", "left")
    names = names.join(near, ["own_package", "simple_ref"], "left")
    plain = ~F.contains("type_name", F.lit("."))
    steps = [("h1", "n1", plain, "same_file"), ("h2", "n2", F.col("imported").isNotNull(), "explicit_import"), ("h3", "n3", ~plain, "fqn"), ("h4", "n4", plain & F.col("imported").isNull(), "same_package")]
    hit, how, shut = F.lit(None), F.lit(None), F.lit(False)
    for h, n, applies, name in reversed(steps):
        use = applies & F.col(n).isNotNull()
        hit, how, shut = F.when(use, F.col(h)).otherwise(hit), F.when(use, F.lit(name)).otherwise(how), F.when(use, F.col(n) > 1).otherwise(shut)
    names = names.withColumn("hit", hit).withColumn("how", how).withColumn("many", shut)
    outside = F.coalesce("imported", F.when(~plain, F.col("type_name")))
    reason = F.when(F.col("hit").isNotNull(), None).when(F.col("many"), "ambiguous_type").when(outside.rlike(JDK), "jdk_type").when(outside.isNotNull(), "external_type").when(F.col("has_wild"), "wildcard_import_not_expanded").otherwise("type_not_found")
    done = names.select("path", "type_name", F.col("hit.path").alias("target_path"), F.col("hit.qualname").alias("target"), F.col("hit.node_id").alias("target_id"), F.col("hit.node_kind").alias("target_kind"), F.coalesce("hit.fqn", outside).alias("fqn"), F.when(F.col("hit").isNotNull(), F.col("how")).alias("how"), reason.alias("reason"))
    return refs.join(done, ["path", "type_name"])


def _inherits(rows: DataFrame) -> DataFrame:
    """edge_id, source_id, target_id, relation (extends, implements, permits), child and parent path and qualname, how, reason."""
    def said(relation: str) -> Column:
        names = F.coalesce(F.from_json(_d(relation), "array<string>"), F.array().cast("array<string>"))
        return F.transform(names, lambda x: F.struct(F.lit(relation).alias("relation"), x.alias("text")))

    parts = rows.where("kind = 'type'").select("path", F.col("qualname").alias("child"), _d("node_kind").alias("child_kind"), F.inline(F.concat(*map(said, ("extends", "implements", "permits")))))
    refs = parts.withColumn("type_name", F.regexp_replace("text", r"[<\[].*$", "")).drop("text")
    e = resolve_types(refs, rows).withColumn("source_id", stable_id("java_node", "child_kind", "path", "child"))
    return e.withColumn("edge_id", F.when(F.col("target_id").isNotNull(), stable_id("inherits", "relation", "source_id", "target_id")))


def ancestors(edges: DataFrame, depth: int = 6, only: str | None = None) -> DataFrame:
    """path, cls, up_path, up, level: all known supertypes, with the nearest level of each. Levels are joined one by one, to a fixed depth."""
    e = edges.where("target_id is not null and relation <> 'permits'")
    if only:
        e = e.where(F.col("relation") == only)
    step = settled(e.select(F.col("path").alias("p"), F.col("child").alias("c"), F.col("target_path").alias("up_path"), F.col("target").alias("up")).distinct())
    every = level = step.select(F.col("p").alias("path"), F.col("c").alias("cls"), "up_path", "up", F.lit(1).alias("level"))
    for k in range(2, depth + 1):
        nxt = step.select(F.col("p").alias("up_path"), F.col("c").alias("up"), F.col("up_path").alias("next_path"), F.col("up").alias("next"))
        level = settled(level.join(nxt, ["up_path", "up"]).select("path", "cls", F.col("next_path").alias("up_path"), F.col("next").alias("up"), F.lit(k).alias("level")).distinct())
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every.groupBy("path", "cls", "up_path", "up").agg(F.min("level").alias("level"))


def type_uses(rows: DataFrame) -> DataFrame:
    """Types that fields, parameters, returns, record components and annotations name."""
    refs = rows.where("kind = 'type_use'").select("path", F.col("owner").alias("user"), F.col("qualname").alias("type_name"), _d("use_kind").alias("use_kind"))
    notes = rows.where("kind = 'annotation'").select("path", F.col("owner").alias("user"), F.col("qualname").alias("type_name"), F.lit("annotation").alias("use_kind"))
    refs = refs.unionByName(notes).distinct()
    owner = members(rows).groupBy("path", F.col("qualname").alias("user")).agg(F.min("node_id").alias("source_id")).unionByName(types(rows).select("path", F.col("qualname").alias("user"), F.col("node_id").alias("source_id")))
    e = resolve_types(refs, rows).join(owner, ["path", "user"])
    return e.withColumn("edge_id", F.when(F.col("target_id").isNotNull(), stable_id("uses_type", "use_kind", "source_id", "target_id")))


def overrides(rows: DataFrame) -> DataFrame:
    """Methods and the one of their nearest supertype level with the same name, arity and erased parameters."""
    m = members(rows).where("node_kind = 'method'").withColumn("erased", F.array_join(F.transform("params", lambda p: F.regexp_replace(p, r"<.*>", "")), ","))
    up = supertypes(rows)
    mine = m.select("path", F.col("owner").alias("cls"), "simple", "erased", "qualname", F.col("node_id").alias("source_id"))
    theirs = m.select(F.col("path").alias("up_path"), F.col("owner").alias("up"), "simple", "erased", F.col("qualname").alias("target"), F.col("node_id").alias("target_id"))
    hit = mine.join(up, ["path", "cls"]).join(theirs, ["up_path", "up", "simple", "erased"])
    per = hit.groupBy("path", "qualname", "source_id", "level").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("target_id", "up_path", "target")).alias("t"))
    near = per.groupBy("path", "qualname", "source_id").agg(F.min_by(F.struct("n", "t"), "level").alias("b")).where("b.n = 1")
    return near.select("path", "qualname", "source_id", F.col("b.t.target_id").alias("target_id"), F.col("b.t.up_path").alias("target_path"), F.col("b.t.target").alias("target")).withColumn("edge_id", stable_id("overrides", "source_id", "target_id"))


def calls(rows: DataFrame) -> DataFrame:
    """Java calls: path, caller, name, shape, source_id, target_id, edge_id, resolution, reason.

    A call has a class to look in (its own, its supertypes', the type of a typed receiver, an imported type, the declared return type of one
    call before it, or what `new` names); the candidates of that name are filtered by arity and by arguments whose types show, and one must
    be left.
    """
    m = members(rows).where("node_kind in ('method', 'constructor')")
    c = rows.where("kind = 'call'").select(
        "path", F.col("owner").alias("caller"), F.col("qualname").alias("name"), "line_start", _d("shape").alias("shape"), _d("owner").alias("cls"), _d("argc").cast("int").alias("argc"),
        F.from_json(_d("args"), "array<string>").alias("args"), _d("base").alias("base"), _d("base_type").alias("base_type"), _d("inner.name").alias("inner_name"), _d("inner.base_type").alias("inner_type"), _d("inner.base").alias("inner_base"),
    ).withColumn("ref", F.monotonically_increasing_id())
    c = settled(c)
    fields = members(rows).where("type is not null").select("path", F.col("owner").alias("cls"), F.col("simple").alias("base"), F.col("type").alias("field_type")).dropDuplicates(["path", "cls", "base"])
    c = c.join(fields, ["path", "cls", "base"], "left")
    c = c.join(fields.select("path", "cls", F.col("base").alias("inner_base"), F.col("field_type").alias("inner_field")), ["path", "cls", "inner_base"], "left")
    shape = F.col("shape")
    plain = lambda x: F.regexp_replace(x, r"[<\[].*$", "")
    asked = F.when(shape == "variable", plain(F.coalesce("base_type", "field_type", "base"))).when(shape == "new", plain(F.col("name"))).when(shape == "chained", plain(F.coalesce("inner_type", "inner_field", "inner_base")))
    c = c.withColumn("type_name", asked)
    found = resolve_types(c.where("type_name is not null").select("path", "type_name").distinct(), rows).select("path", "type_name", F.col("target_path").alias("t_path"), F.col("target").alias("t_cls"), F.col("how").alias("t_how"), F.col("reason").alias("t_reason"))
    c = c.join(found, ["path", "type_name"], "left")
    # one chained step: the declared return type of the inner call, if all of its namesakes agree
    returns = m.where("node_kind = 'method'").groupBy(F.col("path").alias("t_path"), F.col("owner").alias("t_cls"), F.col("simple").alias("inner_name")).agg(F.countDistinct("return_type").alias("rn"), F.min(plain(F.col("return_type"))).alias("return_name")).where("rn = 1")
    chained = c.where("shape = 'chained'").join(returns, ["t_path", "t_cls", "inner_name"])
    far = resolve_types(chained.select(F.col("t_path").alias("path"), F.col("return_name").alias("type_name")).distinct(), rows).select(F.col("path").alias("t_path"), F.col("type_name").alias("return_name"), F.col("target_path").alias("r_path"), F.col("target").alias("r_cls"))
    chained = chained.join(far, ["t_path", "return_name"]).select("ref", "r_path", "r_cls")
    c = c.join(chained, "ref", "left")
    c = settled(c)
    up, parents = supertypes(rows), supertypes(rows, "extends")

    def at(df: DataFrame, path: str, cls: str, rank: int, how: Column | str) -> DataFrame:
        return df.select("ref", F.col(path).alias("m_path"), F.col(cls).alias("owner"), F.lit(rank).alias("rank"), (F.lit(how) if isinstance(how, str) else how).alias("how"))

    own = c.where("shape in ('bare', 'this', 'this_constructor')")
    looks = at(own, "path", "cls", 1, F.when(shape == "bare", "java_same_class_method").when(shape == "this", "java_this_method").otherwise("java_this_constructor"))
    looks = looks.unionByName(at(c.where("shape = 'bare'").join(up, ["path", "cls"]), "up_path", "up", 2, "java_direct_parent_method"))
    looks = looks.unionByName(at(c.where("shape in ('super', 'super_constructor')").join(parents, ["path", "cls"]).where("shape = 'super' or level = 1"), "up_path", "up", 1, F.when(shape == "super", "java_super_method").otherwise("java_super_constructor")))
    typed = c.where("shape in ('variable', 'new') and t_cls is not null")
    looks = looks.unionByName(at(typed, "t_path", "t_cls", 1, F.when(shape == "new", F.when(F.col("t_how") == "same_file", "java_same_file_constructor").otherwise(F.concat(F.lit("java_project_constructor_"), "t_how"))).when(F.coalesce("base_type", "field_type").isNull(), "java_explicit_import_static_method").otherwise(F.concat(F.lit("java_project_typed_receiver_"), "t_how"))))
    looks = looks.unionByName(at(c.where("r_cls is not null"), "r_path", "r_cls", 1, "java_chained_declared_return"))
    statics = rows.where("kind = 'import'").where(_d("static") == "true").where(_d("wildcard") == "false").select("path", F.col("qualname").alias("name"), F.regexp_replace(_d("fqn"), r"\.[^.]*$", "").alias("fqn"))
    by_fqn = types(rows).select("fqn", F.col("path").alias("s_path"), F.col("qualname").alias("s_cls")).dropDuplicates(["fqn"])
    looks = looks.unionByName(at(c.where("shape = 'bare'").join(statics, ["path", "name"]).join(by_fqn, "fqn"), "s_path", "s_cls", 3, "java_static_import_method"))
    calls_ = c.select("ref", "shape", "argc", "args", F.when(shape.isin("new", "this_constructor", "super_constructor"), "constructor").otherwise("method").alias("node_kind"), F.col("name").alias("simple"))
    targets = m.select(F.col("path").alias("m_path"), "owner", "simple", "node_kind", "arity", "varargs", "generic", "params", F.col("node_id").alias("target_id"))
    key = F.when(F.col("node_kind") == "constructor", "").otherwise(F.col("simple"))  # so that a call never meets a class's other methods
    pairs = looks.join(calls_.withColumn("key", key).drop("simple"), "ref").join(targets.withColumn("key", key).drop("simple"), ["m_path", "owner", "node_kind", "key"])
    pairs = settled(pairs)
    nearest = pairs.groupBy("ref").agg(F.min("rank").alias("rank"))
    pairs = pairs.join(nearest, ["ref", "rank"]).withColumn("named", F.lit(True))
    fits = F.when(F.col("varargs"), F.col("argc") >= F.col("arity") - 1).otherwise(F.col("argc") == F.col("arity"))
    pairs = settled(pairs)
    ok = pairs.where(fits).withColumn("cost", overload_cost(F.col("args"), F.col("params"), F.col("varargs")))
    ok = settled(ok)
    best = ok.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("target_id").alias("only"), F.min("cost").alias("low"), F.min("how").alias("how"))
    tied = ok.join(best.select("ref", "low"), "ref").where(F.col("cost") == F.col("low")).groupBy("ref").agg(F.count(F.lit(1)).alias("ties"), F.min("target_id").alias("cheapest"))
    named = pairs.groupBy("ref").agg(F.first("named").alias("named"))
    out = c.join(best, "ref", "left").join(tied, "ref", "left").join(named, "ref", "left")
    target = F.when(F.col("n") == 1, F.col("only")).when((F.col("n") > 1) & F.forall("args", lambda x: x.isNotNull()) & (F.col("ties") == 1), F.col("cheapest"))
    reason = (
        F.when(F.col("named"), "java_overloaded_or_ambiguous_method")
        .when(shape == "variable", F.when(F.col("t_reason").isin("jdk_type", "external_type"), "java_external_or_jdk_receiver").otherwise("java_ambiguous_or_unknown_receiver"))
        .when(shape == "chained", "java_chained_return_type_unresolved")
        .when(shape == "new", "java_constructor_type_not_resolved")
        .when(shape == "other", "java_variable_or_unknown_receiver")
        .otherwise("java_method_not_found")
    )
    caller = members(rows).groupBy("path", F.col("qualname").alias("caller")).agg(F.min("node_id").alias("source_id"))
    out = out.withColumn("target_id", target).join(caller, ["path", "caller"], "left")
    return out.select("path", "caller", "name", "shape", "line_start", "source_id", "target_id", F.when(F.col("target_id").isNotNull(), stable_id("calls", "source_id", "target_id")).alias("edge_id"), F.when(F.col("target_id").isNotNull(), F.col("how")).alias("resolution"), F.when(F.col("target_id").isNull(), reason).alias("reason"))


WIDER = {"byte": "short int long float double", "short": "int long float double", "char": "int long float double", "int": "long float double", "long": "float double", "float": "double"}
BOXES = {"byte": "Byte", "short": "Short", "char": "Character", "int": "Integer", "long": "Long", "float": "Float", "double": "Double", "boolean": "Boolean"}


def conversion_cost(source: Column, target: Column) -> Column:
    """0 exact, 1 and up for widening by its steps, 10 boxing or unboxing, 11 and up for unboxing and widening, 20 to Object; null if the
    source isn't known or can't become the target."""
    out = F.when(source == target, 0)
    for a, wider in WIDER.items():
        for k, b in enumerate(wider.split(), 1):
            out = out.when((source == a) & (target == b), k).when((source == BOXES[a]) & (target == b), 10 + k)
    for a, b in BOXES.items():
        out = out.when((source == a) & (target == b), 10).when((source == b) & (target == a), 10)
    return out.when(target.isin("Object", "java.lang.Object"), 20)


def overload_cost(args: Column, params: Column, varargs: Column) -> Column:
    """The summed cost of a call's arguments, 100 more for a variable arity; null if any can't be told."""
    last = F.regexp_replace(F.element_at(params, -1), r"\[\]$", "")
    spread = F.when(F.coalesce(varargs, F.lit(False)) & (F.size(params) > 0), F.concat(F.slice(params, 1, F.size(params) - 1), F.array_repeat(last, F.greatest(F.size(args) - F.size(params) + 1, F.lit(0))))).otherwise(params)
    costs = F.zip_with(args, spread, lambda a, p: conversion_cost(a, F.regexp_replace(p, "<.*>", "")))
    return F.when(F.size(args) == 0, F.lit(0)).otherwise(F.aggregate(costs, F.lit(0), lambda s, x: s + x)) + F.when(F.coalesce(varargs, F.lit(False)), 100).otherwise(0)


def field_uses(rows: DataFrame) -> DataFrame:
    """Reads and writes of fields: of the own class, else of the one supertype that has the name."""
    f = members(rows).where("type is not null").select(F.col("path").alias("f_path"), F.col("owner").alias("f_cls"), F.col("simple").alias("name"), F.col("node_id").alias("target_id"), F.col("qualname").alias("target"))
    u = rows.where("kind = 'field_use'").select("path", F.col("owner").alias("caller"), F.col("qualname").alias("name"), _d("use").alias("use"), _d("owner").alias("cls")).distinct()
    own = u.join(f.withColumnsRenamed({"f_path": "path", "f_cls": "cls"}), ["path", "cls", "name"]).withColumn("level", F.lit(0)).withColumn("f_path", F.col("path"))
    far = u.join(supertypes(rows), ["path", "cls"]).join(f.withColumnsRenamed({"f_path": "up_path", "f_cls": "up"}), ["up_path", "up", "name"]).select("path", "caller", "name", "use", "cls", "target_id", "target", "level", F.col("up_path").alias("f_path"))
    every = own.select("path", "caller", "name", "use", "cls", "target_id", "target", "level", "f_path").unionByName(far)
    per = every.groupBy("path", "caller", "name", "use", "level").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("target_id", "f_path", "target")).alias("t"))
    near = per.groupBy("path", "caller", "name", "use").agg(F.min_by(F.struct("n", "t"), "level").alias("b")).where("b.n = 1")
    caller = members(rows).groupBy("path", F.col("qualname").alias("caller")).agg(F.min("node_id").alias("source_id"))
    e = near.select("path", "caller", "use", F.col("b.t.target_id").alias("target_id"), F.col("b.t.f_path").alias("target_path"), F.col("b.t.target").alias("target")).join(caller, ["path", "caller"])
    return e.withColumn("edge_id", F.when(F.col("use") == "read", stable_id("reads", "source_id", "target_id")).otherwise(stable_id("writes", "source_id", "target_id")))
