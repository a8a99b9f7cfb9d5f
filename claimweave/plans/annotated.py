"""Queries over Java sources generated from the tables, a file a row: each annotation family in use, out of use, and misused, and the
relations that frameworks declare. The SQL states what must come of each template."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.extract.java import java_rows
from claimweave.operators.resolve import annotations
from claimweave.operators.resolve import java as rj
from claimweave.plans.registry import query
from claimweave.sources.corpora import table
from claimweave.tables import settled

_WEB, _BEANS, _CTX, _STEREO = "org.springframework.web.bind.annotation.", "org.springframework.beans.factory.annotation.", "org.springframework.context.annotation.", "org.springframework.stereotype."
_R4J, _SECURITY = "io.github.resilience4j.", "org.springframework.security.access."
#: family, annotation, owner kind, arguments, metadata; without arguments the family marks presence only.
_USES = [
    ("rest_controller_advice", _WEB + "RestControllerAdvice", "class", "", ""),
    ("init_binder", _WEB + "InitBinder", "method", "", ""),
    ("model_attribute", _WEB + "ModelAttribute", "method", "", ""),
    ("response_status", _WEB + "ResponseStatus", "class", "", ""),
    ("session_attributes", _WEB + "SessionAttributes", "class", "", ""),
    ("cross_origin", _WEB + "CrossOrigin", "method", "", ""),
    ("rest_controller", _WEB + "RestController", "class", "", ""),
    ("controller", _STEREO + "Controller", "class", "", ""),
    ("service", _STEREO + "Service", "class", "", ""),
    ("component", _STEREO + "Component", "class", "", ""),
    ("repository", _STEREO + "Repository", "class", "", ""),
    ("configuration", _CTX + "Configuration", "class", "", ""),
    ("bean", _CTX + "Bean", "method", "", ""),
    ("primary", _CTX + "Primary", "class", "", ""),
    ("lazy", _CTX + "Lazy", "method", "", ""),
    ("post_construct", "jakarta.annotation.PostConstruct", "method", "", ""),
    ("autowired", _BEANS + "Autowired", "field", "", ""),
    ("resource", "jakarta.annotation.Resource", "field", "", ""),
    ("singleton", "javax.inject.Singleton", "class", "", ""),
    ("inject", "jakarta.inject.Inject", "field", "", ""),
    ("named", "javax.inject.Named", "class", "", ""),
    ("pre_destroy", "jakarta.annotation.PreDestroy", "method", "", ""),
    ("scope", _CTX + "Scope", "class", "", ""),
    ("response_body", _WEB + "ResponseBody", "method", "", ""),
    ("controller_advice", _WEB + "ControllerAdvice", "class", "", ""),
    ("scheduling", "org.springframework.scheduling.annotation.Scheduled", "method", 'cron = "0 * * * * *"', '{"cron":"0 * * * * *"}'),
    ("transaction", "org.springframework.transaction.annotation.Transactional", "method", "readOnly = true", '{"readOnly":"true"}'),
    ("async", "org.springframework.scheduling.annotation.Async", "method", '"pool"', '{"value":"pool"}'),
    ("circuit_breaker", _R4J + "circuitbreaker.annotation.CircuitBreaker", "method", 'name = "cb", fallbackMethod = "m"', '{"fallbackMethod":"m","name":"cb"}'),
    ("rate_limiter", _R4J + "ratelimiter.annotation.RateLimiter", "method", 'name = "rl"', '{"name":"rl"}'),
    ("bulkhead", _R4J + "bulkhead.annotation.Bulkhead", "method", 'name = "bh"', '{"name":"bh"}'),
    ("time_limiter", _R4J + "timelimiter.annotation.TimeLimiter", "method", 'name = "tl"', '{"name":"tl"}'),
    ("resilience4j_retry", _R4J + "retry.annotation.Retry", "method", 'name = "rt"', '{"name":"rt"}'),
    ("pre_authorize", _SECURITY + "prepost.PreAuthorize", "method", '"hasRole(1)"', '{"value":"hasRole(1)"}'),
    ("post_authorize", _SECURITY + "prepost.PostAuthorize", "method", '"isOwner()"', '{"value":"isOwner()"}'),
    ("pre_filter", _SECURITY + "prepost.PreFilter", "method", '"mine"', '{"value":"mine"}'),
    ("post_filter", _SECURITY + "prepost.PostFilter", "method", '"mine"', '{"value":"mine"}'),
    ("roles_allowed", "jakarta.annotation.security.RolesAllowed", "method", '"admin"', '{"value":"admin"}'),
    ("secured", _SECURITY + "annotation.Secured", "class", '"ROLE_A"', '{"value":"ROLE_A"}'),
    ("exception_handler", _WEB + "ExceptionHandler", "method", "IllegalStateException.class", '{"value":"IllegalStateException.class"}'),
    ("cache", "org.springframework.cache.annotation.Cacheable", "method", 'value = "c", key = "#i"', '{"key":"#i","value":"c"}'),
    ("retry", "org.springframework.retry.annotation.Retryable", "method", "maxAttempts = 3", '{"maxAttempts":"3"}'),
]
_BODY = {
    "class": "{imports}\n@{note}\nclass A{p} {\n}\n",
    "method": "{imports}\nclass A{p} {\n  @{note}\n  void m(int i) { }\n}\n",
    "field": "{imports}\nclass A{p} {\n  @{note}\n  private Object f;\n}\n",
}


def _templates() -> tuple[list[str], list[tuple[int, str, str, str, str, str]]]:
    """Sources, four of each family; and what comes of them: number of the source, family, owner kind, name as written, metadata, reason."""
    sources, out = [], []
    for family, fqn, kind, args, meta in _USES:
        simple = fqn.rsplit(".", 1)[-1]
        good = f"{simple}({args})" if args else simple
        for case, (imports, note, data, why) in enumerate(
            (
                (f"import {fqn};", good, meta or "{}", ""),
                ("", good, "", "annotation_not_exact_explicit_import"),
                (f"import {fqn};", f"{simple}(other = X.Y)", "", "metadata_unsupported"),
                ("", f"{fqn}({args})" if args else fqn, meta or "{}", ""),
            )
        ):
            body = _BODY[kind].replace("{imports}", imports).replace("{note}", note)
            # a name that two families know is out of use in both
            out += [(len(sources), f, kind, fqn if case == 3 else simple, data, why) for f in (family, *(["retry"] if family == "circuit_breaker" and case == 1 else []))]
            sources.append("package a;\n" + body)
    return sources, out


_SOURCES, _WANT = _templates()


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    """A file a part: template p_partkey modulo their number."""
    one = spark.createDataFrame(list(enumerate(_SOURCES)), "k long, body string")
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % len(_SOURCES)).alias("k"))
    return p.join(F.broadcast(one), "k").select(F.format_string("src/main/java/a/A%d.java", F.col("p_partkey")).alias("path"), F.replace("body", F.lit("{p}"), F.col("p_partkey").cast("string")).alias("text"))  # fixed size


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return settled(java_rows(_annotated(spark, sf)))


_VALUES = ", ".join(f"({i}, {_text(f)}, {_text(k)}, {_text(n)}, {_text(m)}, {_text(w)})" for i, f, k, n, m, w in _WANT)
_PATH = "'src/main/java/a/A' || p_partkey || '.java'"

ANNOTATED_SQL = f"""WITH t(k, family, kind, name, metadata, why) AS (VALUES {_VALUES}),
x AS (SELECT {_PATH} AS path, 'A' || p_partkey || CASE kind WHEN 'method' THEN '.m' WHEN 'field' THEN '.f' ELSE '' END AS owner, t.* FROM part JOIN t ON p_partkey % {len(_SOURCES)} = k),
y AS (SELECT *, 'claim_java_' || substr(sha256('java' || chr(0) || kind || chr(0) || path || chr(0) || owner), 1, 16) AS owner_id FROM x)
SELECT path, owner, kind AS owner_kind, family, owner_id, CASE WHEN why = '' THEN metadata END AS metadata,
  CASE WHEN why = '' THEN 'claim_' || family || '_decl_' || substr(sha256(family || '_declaration' || chr(0) || owner_id || CASE family WHEN 'cache' THEN chr(0) || 'able' || chr(0) || 'c' WHEN 'retry' THEN chr(0) || name ELSE '' END), 1, 16) END AS claim_id,
  CASE WHEN why = '' THEN 'declares_' || family || CASE WHEN metadata = '{{}}' THEN '_presence' ELSE '_metadata' END END AS edge_kind,
  CASE WHEN why <> '' THEN family || '_' || why END AS reason FROM y"""


@query("java_annotation_families", ANNOTATED_SQL)
def java_annotation_families(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.annotation_metadata(_rows(spark, sf)).select("path", "owner", "owner_kind", "family", "owner_id", "metadata", "claim_id", "edge_kind", "reason")
