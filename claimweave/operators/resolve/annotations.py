"""Annotation metadata: one plan over a table of annotation families, and the relations that frameworks declare with annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.ids import SPECS, hashed_id, stable_id
from claimweave.operators.resolve.java import members, resolve_types, supertypes, types

_W, _C, _B, _S = "org.springframework.web.bind.annotation.", "org.springframework.context.annotation.", "org.springframework.beans.factory.annotation.", "org.springframework.stereotype."
_J, _R, _SEC = "jakarta.", "io.github.resilience4j.", "org.springframework.security.access."
#: family | accepted names | owner kinds | flags | attributes that are kept (none: presence only)
FAMILIES = [
    *[(f, [_W + a], "class interface", "", "") for f, a in (("rest_controller_advice", "RestControllerAdvice"), ("session_attributes", "SessionAttributes"), ("rest_controller", "RestController"))],
    *[(f, [_W + a], k, "nested", "") for f, a, k in (("init_binder", "InitBinder", "method"), ("model_attribute", "ModelAttribute", "method"), ("response_status", "ResponseStatus", "class interface method"), ("cross_origin", "CrossOrigin", "class interface method"), ("response_body", "ResponseBody", "class interface method"))],
    *[(f, [_S + a], "class interface", "", "") for f, a in (("controller", "Controller"), ("service", "Service"), ("component", "Component"), ("repository", "Repository"))],
    ("configuration", [_C + "Configuration"], "class interface", "", ""),
    ("bean", [_C + "Bean"], "method", "", ""),
    *[(f, [_C + a], "class interface method", "", "") for f, a in (("primary", "Primary"), ("lazy", "Lazy"), ("scope", "Scope"))],
    ("post_construct", [_J + "annotation.PostConstruct"], "method", "", ""),
    ("pre_destroy", [_J + "annotation.PreDestroy"], "method", "", ""),
    ("autowired", [_B + "Autowired"], "constructor field method", "static anonymous", ""),
    ("resource", [_J + "annotation.Resource", "javax.annotation.Resource"], "class field method", "static anonymous", ""),
    ("inject", [_J + "inject.Inject", "javax.inject.Inject"], "constructor field method", "static anonymous", ""),
    ("named", [_J + "inject.Named", "javax.inject.Named"], "class field method", "anonymous", ""),
    ("singleton", [_J + "inject.Singleton", "javax.inject.Singleton"], "class", "", ""),
    ("controller_advice", [_W + "ControllerAdvice"], "class interface", "", ""),
    ("cache", ["org.springframework.cache.annotation." + a for a in ("Cacheable", "CachePut", "CacheEvict")], "method", "nested", "value cacheNames key condition unless"),
    ("scheduling", ["org.springframework.scheduling.annotation.Scheduled"], "method", "nested", "fixedRate fixedDelay initialDelay cron zone timeUnit fixedRateString fixedDelayString initialDelayString"),
    ("transaction", ["org.springframework.transaction.annotation.Transactional"], "class interface method", "nested", "value propagation isolation readOnly timeout transactionManager rollbackFor noRollbackFor rollbackForClassName noRollbackForClassName"),
    ("async", ["org.springframework.scheduling.annotation.Async"], "class interface method", "nested", "value"),
    ("retry", ["org.springframework.retry.annotation." + a for a in ("Retryable", "Recover", "CircuitBreaker", "Backoff")], "class interface method", "nested", "value include exclude retryFor noRetryFor maxAttempts label stateful recover backoff"),
    *[(f, [_R + p], "class method", "nested", "name fallbackMethod type") for f, p in (("circuit_breaker", "circuitbreaker.annotation.CircuitBreaker"), ("rate_limiter", "ratelimiter.annotation.RateLimiter"), ("bulkhead", "bulkhead.annotation.Bulkhead"), ("time_limiter", "timelimiter.annotation.TimeLimiter"), ("resilience4j_retry", "retry.annotation.Retry"))],
    *[(f, [_SEC + "prepost." + a], "class interface method", "nested", k) for f, a, k in (("pre_authorize", "PreAuthorize", "value"), ("post_authorize", "PostAuthorize", "value"), ("pre_filter", "PreFilter", "value filterTarget"), ("post_filter", "PostFilter", "value"))],
    ("roles_allowed", [_J + "annotation.security.RolesAllowed", "javax.annotation.security.RolesAllowed"], "class interface method", "nested", "value"),
    ("secured", [_SEC + "annotation.Secured"], "class interface method", "nested", "value"),
    ("exception_handler", [_W + "ExceptionHandler"], "method", "nested", "value exception"),
]


def families(spark: SparkSession) -> DataFrame:
    """family, fqn, simple, owner_kinds, flags, kept: one row an accepted annotation; a few dozen rows, fixed."""
    rows = [(f, n, n.rsplit(".", 1)[-1], k.split(), g.split(), a.split()) for f, names, k, g, a in FAMILIES for n in names]
    return spark.createDataFrame(rows, "family string, fqn string, simple string, owner_kinds array<string>, flags array<string>, kept array<string>")


def _d(key: str) -> Column:
    return F.get_json_object("detail", f"$.{key}")


def imports_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'import'").where((_d("static") == "false") & (_d("wildcard") == "false")).select("path", F.col("qualname").alias("simple"), _d("fqn").alias("imported")).dropDuplicates(["path", "simple"])


def owner_nodes(rows: DataFrame) -> DataFrame:
    """path, owner, owner_kind, owner_id, n (how many have that name and kind)."""
    m = members(rows).select("path", F.col("qualname").alias("owner"), F.when(F.col("type").isNotNull(), "field").otherwise(F.col("node_kind")).alias("owner_kind"), "node_id")
    t = types(rows).select("path", F.col("qualname").alias("owner"), F.col("node_kind").alias("owner_kind"), "node_id")
    return m.unionByName(t).groupBy("path", "owner", "owner_kind").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("owner_id"))


def annotation_metadata(rows: DataFrame) -> DataFrame:
    """family, path, owner, owner_kind, owner_id, metadata (JSON of the kept literals), claim_id, edge_kind; or a reason.

    An annotation counts if its exact name is imported (or written out), its owner is of an accepted kind and alone of its name, it stands
    once, and its arguments are literals of the family's attributes. Presence families take no arguments.
    """
    spark = rows.sparkSession
    a = rows.where("kind = 'annotation'").select("path", F.col("qualname").alias("name"), "owner", "line_start", "hash", _d("owner_kind").alias("owner_kind"), _d("args").alias("args"), *[_d(k).cast("boolean").alias(k) for k in ("literal", "static", "anonymous")], *[_d(k).cast("int").alias(k) for k in ("n_args", "count", "declarators", "nested")])
    a = a.withColumn("simple", F.substring_index("name", ".", -1)).join(F.broadcast(families(spark)), "simple")  # fixed size
    a = a.join(imports_of(rows), ["path", "simple"], "left").join(owner_nodes(rows), ["path", "owner", "owner_kind"], "left")
    exact = (F.col("imported") == F.col("fqn")) | (F.col("name") == F.col("fqn"))
    # of a family's several accepted names, the one that is meant
    a = a.withColumn("exact", F.coalesce(exact, F.lit(False)))
    a = a.withColumn("best", F.struct("exact", "fqn")).groupBy("path", "owner", "owner_kind", "name", "line_start", "hash", "family").agg(F.max_by(F.struct("exact", "fqn", "owner_kinds", "flags", "kept", "args", "literal", "static", "anonymous", "n_args", "count", "declarators", "nested", "n", "owner_id"), "best").alias("x")).select("path", "owner", "owner_kind", "name", "line_start", "hash", "family", "x.*")
    # a name that several families know is that of the family that it is exactly, if any
    a = a.withColumn("any", F.max("exact").over(Window.partitionBy("path", "owner", "owner_kind", "name", "line_start"))).where("exact or not any")
    keys = F.json_object_keys("args")
    presence = F.size("kept") == 0
    flag = lambda f: F.array_contains("flags", f)
    bad_args = F.when(presence, F.col("n_args") > 0).otherwise(~F.col("literal") | (F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), "kept")) > 0))
    reason = (
        F.when(~F.col("exact"), "annotation_not_exact_explicit_import")
        .when(F.col("count") > 1, "duplicate_annotation")
        .when(flag("static") & F.col("static"), "static_owner_unsupported")
        .when(flag("anonymous") & F.col("anonymous"), "owner_ambiguous")
        .when(~F.array_contains("owner_kinds", F.col("owner_kind")) | (F.coalesce("n", F.lit(0)) != 1) | (~flag("nested") & (F.col("owner_kind") == "method") & (F.col("nested") > 0)), "owner_ambiguous")
        .when(F.col("declarators") > 1, "multi_declarator_owner_unsupported")
        .when(bad_args, "metadata_unsupported")
    )
    a = a.withColumn("why", reason)
    kind = F.concat(F.lit("declares_"), "family", F.when(presence, "_presence").otherwise("_metadata"))
    # the families' prefixes and tags follow one pattern; three have more in their preimage
    own = hashed_id("", F.concat("family", F.lit("_declaration")), F.col("owner_id"))
    claim = F.concat(F.lit("claim_"), "family", F.lit("_decl_"), own)
    claim = F.when(F.col("family") == "cache", stable_id("cache_declaration", "owner_id", F.lower(F.regexp_replace("name", ".*Cache", "")), F.coalesce(F.get_json_object("args", "$.value"), F.get_json_object("args", "$.cacheNames"), F.lit("")))).when(F.col("family") == "retry", stable_id("retry_declaration", "owner_id", "name")).otherwise(claim)
    return a.select("family", "path", "owner", "owner_kind", "owner_id", "line_start", F.when(F.col("why").isNull(), F.col("args")).alias("metadata"), F.when(F.col("why").isNull(), claim).alias("claim_id"), F.when(F.col("why").isNull(), kind).alias("edge_kind"), F.concat_ws("_", "family", "why").alias("reason")).withColumn("reason", F.when(F.col("claim_id").isNull(), F.col("reason")))


def _noted(rows: DataFrame, **wanted: str) -> DataFrame:
    """Annotations by exactly imported name: path, owner, owner_kind, label (of wanted: label -> fqn), args."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(k, v.rsplit(".", 1)[-1], v) for k, v in wanted.items()], "label string, simple string, fqn string")
    a = rows.where("kind = 'annotation'").select("path", F.substring_index("qualname", ".", -1).alias("simple"), F.col("qualname").alias("name"), "owner", "line_start", "line_end", _d("owner_kind").alias("owner_kind"), _d("args").alias("args"), _d("literal").cast("boolean").alias("literal"), _d("n_args").cast("int").alias("n_args"), F.from_json(_d("texts"), "array<string>").alias("texts"))
    a = a.join(F.broadcast(dim), "simple").join(imports_of(rows), ["path", "simple"], "left")
    wild = rows.where("kind = 'import'").where((_d("wildcard") == "true") & (_d("static") == "false")).select("path", _d("fqn").alias("package")).groupBy("path").agg(F.collect_set("package").alias("packages"))
    a = a.join(wild, "path", "left")
    spring = F.array_contains(F.coalesce("packages", F.array().cast("array<string>")), F.lit(_W.rstrip("."))) & F.col("fqn").startswith(_W)
    return a.where((F.col("imported") == F.col("fqn")) | (F.col("name") == F.col("fqn")) | (F.col("imported").isNull() & spring)).drop("simple", "name", "imported", "fqn", "packages")


def _texts(*keys: str, sure: bool = False) -> Column:
    """Literal texts of the first attribute given: one or an array. With sure, names of constants don't count."""
    out = F.lit(None).cast("array<string>")
    for k in reversed(keys):
        one = F.get_json_object("args", f"$.{k}")
        one = F.when(F.array_contains("texts", k), one) if sure else one
        out = F.when(one.isNotNull(), F.when(one.startswith("["), F.from_json(one, "array<string>")).otherwise(F.array(one))).otherwise(out)
    return out


def mvc_routes(rows: DataFrame) -> DataFrame:
    """Spring MVC: path, handler, method, route_path, api id. Class prefixes x method paths x verbs; overloaded handlers are left out."""
    n = _noted(rows, request=_W + "RequestMapping", get=_W + "GetMapping", post=_W + "PostMapping", put=_W + "PutMapping", delete=_W + "DeleteMapping", patch=_W + "PatchMapping").where("literal")
    paths = F.coalesce(_texts("value", "path"), F.array(F.lit("")))
    cls = n.where("owner_kind in ('class', 'interface') and label = 'request'").select("path", F.col("owner").alias("cls"), paths.alias("prefixes")).dropDuplicates(["path", "cls"])
    verbs = F.when(F.col("label") == "request", F.transform(F.coalesce(_texts("method"), F.array(F.lit("GET"))), lambda v: F.substring_index(v, ".", -1))).otherwise(F.array(F.upper("label")))
    m = n.where("owner_kind = 'method'").select("path", F.col("owner").alias("handler"), F.regexp_replace("owner", r"\.[^.]*$", "").alias("cls"), paths.alias("paths"), verbs.alias("verbs"))
    single = members(rows).where("node_kind = 'method'").groupBy("path", F.col("qualname").alias("handler")).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("handler_id")).where("n = 1").drop("n")
    m = m.join(cls, ["path", "cls"], "left").join(single, ["path", "handler"])
    m = m.withColumn("prefix", F.explode(F.coalesce("prefixes", F.array(F.lit(""))))).withColumn("own", F.explode("paths")).withColumn("method", F.explode("verbs"))
    parts = F.filter(F.array(F.btrim("prefix", F.lit("/")), F.btrim("own", F.lit("/"))), lambda x: x != "")
    m = m.withColumn("route_path", F.concat(F.lit("/"), F.array_join(parts, "/")))
    return m.select("path", "handler", "handler_id", "method", "route_path", stable_id("api", "path", "method", "route_path", "handler").alias("claim_id")).distinct()


def feign_routes(rows: DataFrame) -> DataFrame:
    """Routes that Feign client interfaces call: service, url, and the mapping of each method."""
    c = _noted(rows, client="org.springframework.cloud.openfeign.FeignClient").where("owner_kind = 'interface' and literal").select("path", F.col("owner").alias("cls"), F.coalesce(_texts("name", "value"), F.array(F.lit(None).cast("string")))[0].alias("service_name"), F.get_json_object("args", "$.url").alias("service_url"), F.coalesce(F.get_json_object("args", "$.path"), F.lit("")).alias("base"))
    r = mvc_routes(rows).withColumn("cls", F.regexp_replace("handler", r"\.[^.]*$", ""))
    full = F.concat(F.lit("/"), F.array_join(F.filter(F.array(F.btrim("base", F.lit("/")), F.btrim("route_path", F.lit("/"))), lambda x: x != ""), "/"))
    return r.join(c, ["path", "cls"]).select("path", "handler", "method", full.alias("route_path"), "service_name", "service_url")


def topic_edges(rows: DataFrame) -> DataFrame:
    """Kafka: literal topics of listeners (subscribes_to) and of template sends (publishes_to): path, source, topic, edge_kind, edge_id, reason."""
    owner = owner_nodes(rows).where("n = 1").select("path", "owner", "owner_kind", F.col("owner_id").alias("source_id"))
    sub = _noted(rows, listener="org.springframework.kafka.annotation.KafkaListener").join(owner, ["path", "owner", "owner_kind"])
    sub = sub.select("path", F.col("owner").alias("source"), "source_id", F.explode_outer(_texts("topics", sure=True)).alias("topic"), F.lit("subscribes_to").alias("edge_kind"))
    template = members(rows).where("type like 'KafkaTemplate%'").select("path", F.col("owner").alias("cls"), F.col("simple").alias("base")).distinct()
    calls = rows.where("kind = 'call'").select("path", F.col("owner").alias("owner"), F.col("qualname").alias("name"), _d("owner").alias("cls"), _d("base").alias("base"), _d("args").alias("args"), _d("first").alias("topic")).where("name = 'send'")
    pub = calls.join(template, ["path", "cls", "base"]).join(owner.where("owner_kind in ('method', 'constructor')"), ["path", "owner"])
    pub = pub.select("path", F.col("owner").alias("source"), "source_id", "topic", F.lit("publishes_to").alias("edge_kind"))
    e = sub.unionByName(pub).distinct()
    ids = F.when(F.col("edge_kind") == "publishes_to", stable_id("publishes_to", "source_id", "topic")).otherwise(stable_id("subscribes_to", "source_id", "topic"))
    return e.withColumn("edge_id", F.when(F.col("topic").isNotNull(), ids)).withColumn("reason", F.when(F.col("topic").isNull(), "topic_not_literal"))


def event_edges(rows: DataFrame) -> DataFrame:
    """Event types that listener methods take: path, source, target_id, edge_kind listens_type, edge_id, reason."""
    n = _noted(rows, event="org.springframework.context.event.EventListener", tx="org.springframework.transaction.event.TransactionalEventListener").where("owner_kind = 'method'")
    m = members(rows).where("node_kind = 'method' and arity = 1").select("path", F.col("qualname").alias("owner"), F.col("node_id").alias("source_id"), F.regexp_replace(F.col("params")[0], r"[<\[].*$", "").alias("type_name"))
    e = resolve_types(n.select("path", "owner").join(m, ["path", "owner"]), rows)
    return e.withColumn("edge_kind", F.lit("listens_type")).withColumn("edge_id", F.when(F.col("target_id").isNotNull(), stable_id("event_type", "edge_kind", "source_id", "target_id")))


def injections(rows: DataFrame) -> DataFrame:
    """Spring injection: path, injector, target bean, edge_id, reason. Beans are stereotype classes and @Bean methods; of a type's beans the
    qualified one counts, else the only one, else the only primary."""
    stereo = _noted(rows, **{a.lower(): p + a for p, a in ((_S, "Service"), (_S, "Component"), (_S, "Repository"), (_S, "Controller"), (_C, "Configuration"), (_W, "RestController"))})
    primary = _noted(rows, primary=_C + "Primary").select("path", "owner", F.lit(True).alias("primary")).distinct()
    t = types(rows).select("path", F.col("qualname").alias("owner"), "fqn", "node_id")
    own = stereo.where("owner_kind = 'class'").select("path", "owner", F.coalesce(F.get_json_object("args", "$.value"), F.expr("concat(lower(left(substring_index(owner, '.', -1), 1)), substring(substring_index(owner, '.', -1), 2))")).alias("bean_name")).distinct()
    made = _noted(rows, bean=_C + "Bean").where("owner_kind = 'method'").select("path", "owner", F.coalesce(_texts("name", "value")[0], F.substring_index("owner", ".", -1)).alias("bean_name")).distinct()
    method = members(rows).where("node_kind = 'method'").select("path", F.col("qualname").alias("owner"), F.col("node_id").alias("bean_id"), F.regexp_replace("return_type", r"[<\[].*$", "").alias("type_name"))
    made = resolve_types(made.join(method, ["path", "owner"]), rows).where("fqn is not null").select("path", "owner", "bean_name", "bean_id", F.col("fqn").alias("as_type"))
    classes = own.join(t, ["path", "owner"])
    up = supertypes(rows).join(t.select(F.col("path").alias("up_path"), F.col("owner").alias("up"), F.col("fqn").alias("as_type")), ["up_path", "up"]).select("path", F.col("cls").alias("owner"), "as_type")
    beans = classes.select("path", "owner", "bean_name", F.col("node_id").alias("bean_id"), F.col("fqn").alias("as_type")).unionByName(classes.select("path", "owner", "bean_name", F.col("node_id").alias("bean_id")).join(up, ["path", "owner"])).unionByName(made)
    beans = beans.join(primary, ["path", "owner"], "left").select("as_type", "bean_name", "bean_id", F.coalesce("primary", F.lit(False)).alias("primary")).distinct()
    asks = _noted(rows, autowired=_B + "Autowired", inject=_J + "inject.Inject").where("owner_kind = 'field'").select("path", "owner").distinct()
    qualifier = _noted(rows, qualifier=_B + "Qualifier").select("path", "owner", F.get_json_object("args", "$.value").alias("qualifier")).dropDuplicates(["path", "owner"])
    f = members(rows).where("type is not null").select("path", F.col("qualname").alias("owner"), F.col("node_id").alias("source_id"), F.regexp_replace("type", r"[<\[].*$", "").alias("type_name"))
    asks = resolve_types(asks.join(f, ["path", "owner"]), rows).select("path", "owner", "source_id", "fqn").join(qualifier, ["path", "owner"], "left")
    per = asks.join(beans, asks.fqn == beans.as_type, "left").withColumn("named", F.col("qualifier").isNull() | (F.col("qualifier") == F.col("bean_name")))
    per = per.groupBy("path", "owner", "source_id", "qualifier").agg(F.count("bean_id").alias("all"), F.count_if(F.col("named") & F.col("bean_id").isNotNull()).alias("n"), F.min(F.when(F.col("named"), F.col("bean_id"))).alias("one"), F.count_if(F.col("primary")).alias("np"), F.min(F.when(F.col("primary"), F.col("bean_id"))).alias("prime"))
    target = F.when(F.col("n") == 1, F.col("one")).when(F.col("qualifier").isNull() & (F.col("np") == 1), F.col("prime"))
    reason = F.when(F.col("all") == 0, "spring_injection_type_not_resolved").when(F.col("n") == 0, "spring_injection_qualifier_not_found").otherwise("spring_injection_multiple_beans")
    per = per.withColumn("target_id", target).withColumn("inject_kind", F.lit("field"))
    return per.select("path", F.col("owner").alias("injector"), "source_id", "target_id", F.when(F.col("target_id").isNotNull(), stable_id("injects", "inject_kind", "source_id", "target_id")).alias("edge_id"), F.when(F.col("target_id").isNull(), reason).alias("reason"))


def configuration_properties(rows: DataFrame) -> DataFrame:
    """Literal prefixes of configuration classes and bean factories."""
    n = _noted(rows, props="org.springframework.boot.context.properties.ConfigurationProperties").join(owner_nodes(rows).where("n = 1"), ["path", "owner", "owner_kind"])
    p = F.coalesce(_texts("prefix", "value", sure=True)[0], F.lit(None).cast("string"))
    n = n.where("owner_kind in ('class', 'method')").withColumn("prefix", p)
    return n.select("path", "owner", "owner_kind", "prefix", F.when(F.col("prefix").isNotNull(), stable_id("configuration_properties", "owner_id", "prefix")).alias("edge_id"), F.when(F.col("prefix").isNull(), "configuration_properties_prefix_not_literal").alias("reason"))


def literal_declarations(rows: DataFrame, texts: bool = False, **wanted: str) -> DataFrame:
    """What exactly imported annotations of any kind say in literals: path, owner, owner_kind, label, args. For profiles, scopes,
    conditions, and the like, whose texts stay opaque. texts: which attributes are literal texts."""
    return _noted(rows, **wanted).where("literal").select("path", "owner", "owner_kind", "label", "args", *(["texts"] if texts else []))


_P = "jakarta.persistence."
SPRING = {"profile": _C + "Profile", "scope": _C + "Scope", "depends_on": _C + "DependsOn", "lazy": _C + "Lazy", "primary": _C + "Primary", "transactional": "org.springframework.transaction.annotation.Transactional", "on_property": "org.springframework.boot.autoconfigure.condition.ConditionalOnProperty", "on_class": "org.springframework.boot.autoconfigure.condition.ConditionalOnClass", "on_missing_bean": "org.springframework.boot.autoconfigure.condition.ConditionalOnMissingBean"}
PERSISTENCE = {k: _P + v for k, v in {"entity": "Entity", "embeddable": "Embeddable", "mapped_superclass": "MappedSuperclass", "id": "Id", "table": "Table", "column": "Column", "join_column": "JoinColumn", "id_class": "IdClass"}.items()}
MYBATIS = {"mapper": "org.apache.ibatis.annotations.Mapper", **{v.lower(): "org.apache.ibatis.annotations." + v for v in ("Select", "Insert", "Update", "Delete")}}


def mybatis_statements(rows: DataFrame) -> DataFrame:
    """Methods of exact mappers with one literal statement: path, owner, operation, statement (opaque)."""
    n = literal_declarations(rows, True, **MYBATIS)
    mapper = n.where("label = 'mapper' and owner_kind = 'interface'").select("path", F.col("owner").alias("cls")).distinct()
    s = n.where("label <> 'mapper' and owner_kind = 'method'").withColumn("cls", F.regexp_replace("owner", r"\.[^.]*$", "")).join(mapper, ["path", "cls"], "left_semi")
    one = s.groupBy("path", "owner").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("operation"), F.min("args").alias("args"), F.min("texts").alias("texts")).where("n = 1")
    return one.select("path", "owner", "operation", _texts("value", sure=True)[0].alias("statement")).where("statement is not null")


def repositories(rows: DataFrame) -> DataFrame:
    """Spring Data repositories: path, repository, base, domain_type, id_type, domain_id, reason."""
    t = rows.where("kind = 'type'").where(_d("node_kind") == "interface").select("path", F.col("qualname").alias("repository"), F.explode(F.from_json(_d("extends"), "array<string>")).alias("text"))
    t = t.select("path", "repository", F.regexp_extract("text", r"^([\w.]+)<\s*([\w.]+)\s*,\s*([\w.]+)\s*>$", 1).alias("base"), F.regexp_extract("text", r"<\s*([\w.]+)\s*,", 1).alias("type_name"), F.regexp_extract("text", r",\s*([\w.]+)\s*>$", 1).alias("id_type"))
    t = t.where(F.col("base").isin("Repository", "CrudRepository", "PagingAndSortingRepository", "ListCrudRepository", "JpaRepository", "MongoRepository", "ReactiveCrudRepository"))
    e = resolve_types(t, rows)
    return e.select("path", "repository", "base", F.col("type_name").alias("domain_type"), "id_type", F.col("target_id").alias("domain_id"), "reason")


__all__ = ["SPECS"]
