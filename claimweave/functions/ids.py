"""Deterministic identities: every id is a prefix and 16 hex digits of a sha256 over NUL-separated parts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: node or relation -> (prefix, tag that leads the preimage or None, names of the parts that follow). A part named upper:x is upper-cased.
SPECS: dict[str, tuple[str, str | None, tuple[str, ...]]] = {
    "file": ("claim_file_", None, ("path",)),
    "function": ("claim_fn_", None, ("path", "qualname")),
    "class": ("claim_class_", "class", ("path", "qualname")),
    "declaration": ("claim_decl_", "declaration", ("path", "qualname")),
    "config": ("claim_config_", "config", ("path", "key")),
    "api": ("claim_api_", "api", ("path", "upper:method", "route_path", "handler_qualname")),
    "api_relationship": ("claim_api_rel_", "api_relationship_v2", ("route_path_source", "upper:method", "route_path", "handler_node_id")),
    "java_node": ("claim_java_", "java", ("node_kind", "path", "identity")),
    "calls": ("claim_edge_", None, ("caller_id", "callee_id")),
    "reads": ("claim_read_edge_", "reads", ("reader_id", "declaration_id")),
    "writes": ("claim_write_edge_", "writes", ("writer_id", "declaration_id")),
    "inherits": ("claim_inherit_edge_", "inherits", ("relation", "child_id", "parent_id")),
    "contract": ("claim_contract_", "contract", ("path", "qualname")),
    "overrides": ("claim_override_edge_", "overrides", ("method_id", "overridden_id")),
    "uses_type": ("claim_type_use_edge_", "uses_type", ("use_kind", "user_id", "type_id")),
    "event_type": ("claim_event_type_edge_", "event_type", ("edge_kind", "source_id", "type_id")),
    "env": ("claim_env_", "env", ("env_name",)),
    "reads_env": ("claim_env_read_edge_", "reads_env", ("reader_id", "env_name")),
    "reads_config_key": ("claim_config_read_edge_", "reads_config_key", ("reader_id", "config_id")),
    "injects": ("claim_inject_edge_", "injects", ("inject_kind", "injector_id", "bean_id")),
    "configuration_properties": ("claim_configuration_properties_edge_", "configuration_properties", ("source_id", "prefix")),
    "topic": ("claim_topic_", "topic", ("topic_name",)),
    "publishes_to": ("claim_topic_pub_edge_", "publishes_to", ("publisher_id", "topic_name")),
    "subscribes_to": ("claim_topic_sub_edge_", "subscribes_to", ("subscriber_id", "topic_name")),
    "cache_declaration": ("claim_cache_decl_", "cache_declaration", ("method_id", "operation", "cache_names")),
    "scheduling_declaration": ("claim_scheduling_decl_", "scheduling_declaration", ("method_id",)),
    "retry_declaration": ("claim_retry_decl_", "retry_declaration", ("owner_id", "annotation_kind")),
}
#: Declarations that are told apart by their owner alone.
_OWNED = """transaction async circuit_breaker rate_limiter bulkhead time_limiter resilience4j_retry pre_authorize roles_allowed secured
post_authorize exception_handler controller_advice rest_controller_advice init_binder model_attribute response_status session_attributes
cross_origin rest_controller controller service component repository configuration bean primary lazy post_construct autowired resource
singleton inject named pre_destroy scope response_body pre_filter post_filter""".split()
SPECS |= {f"{n}_declaration": (f"claim_{n}_decl_", f"{n}_declaration", ("owner_id",)) for n in _OWNED}


def hashed_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16))


def stable_id(kind: str, *parts: Column | str) -> Column:
    """The id of a node or relation kind; parts are columns or column names, in the order of SPECS."""
    prefix, tag, names = SPECS[kind]
    if len(parts) != len(names):
        raise ValueError(f"{kind} takes {', '.join(names)}")
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    cols = [F.upper(c) if n.startswith("upper:") else c for n, c in zip(names, cols, strict=True)]
    return hashed_id(prefix, *([F.lit(tag)] if tag else []), *[c.cast("string") for c in cols])


def stable_id_of(kind: str, *parts: str) -> str:
    """stable_id for plain strings, for extractors in Python workers and for tests."""
    prefix, tag, names = SPECS[kind]
    own = [p.upper() if n.startswith("upper:") else p for n, p in zip(names, parts, strict=True)]
    return prefix + hashlib.sha256("\0".join(([tag] if tag else []) + own).encode()).hexdigest()[:16]


def git_blob(text: Column) -> Column:
    """The Git blob id of a text's UTF-8 bytes; filters of a work tree aren't applied."""
    raw = text.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(raw).cast("string").cast("binary"), F.unhex(F.lit("00")), raw))
