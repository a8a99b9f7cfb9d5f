"""Vectors, confidence and trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 where either vector has no length or the lengths differ."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def observed_confidence(supported: Column, confidence: Column) -> Column:
    """Second pass over observed claims: at most 0.45 if their keywords stand in the source, else at most 0.2."""
    return F.when(supported, F.least(confidence, F.lit(0.45))).otherwise(F.least(confidence, F.lit(0.2)))


def feedback_confidence(kind: Column, confidence: Column) -> Column:
    return F.when(kind == "verified", F.greatest(confidence, F.lit(0.75))).when(kind == "falsified", F.least(confidence, F.lit(0.15))).when(kind == "hunch", F.least(confidence, F.lit(0.3))).otherwise(confidence)


def candidate_confidence(evidence_class: Column, supported: Column, attributed: Column, confidence: Column) -> Column:
    """Caps for what a model proposed, by what supports it."""
    return (
        F.when((evidence_class == "source-verifiable") & supported, F.least(F.greatest(confidence, F.lit(0.4)), F.lit(0.6)))
        .when((evidence_class == "intent-needs-provenance") & attributed, F.least(F.greatest(confidence, F.lit(0.35)), F.lit(0.6)))
        .when(evidence_class == "intent-needs-provenance", F.least(confidence, F.lit(0.25)))
        .otherwise(F.least(confidence, F.lit(0.2)))
    )


def trust_level(foreign: Column, evidence: Column, endorsed_by: Column, verification: Column) -> Column:
    return (
        F.when(foreign, "unverified_foreign")
        .when(evidence == "verified", "hard_verified")
        .when(F.coalesce(endorsed_by, F.lit("")) != "", "endorsed")
        .when((evidence == "observed") & (verification == "source_support_literal"), "source_observed")
        .when(evidence == "observed", "observed")
        .when((evidence == "inferred") & (verification == "attributed_external_provenance"), "attributed")
        .when((evidence == "inferred") & (verification == "intent_requires_external_provenance"), "unsupported_intent")
        .when((evidence == "inferred") & F.coalesce(verification, F.lit("none")).isin("unsupported_or_unverifiable", "none"), "unsupported")
        .otherwise("unknown")
    )


def action_hint(fresh: Column, level: Column) -> Column:
    return (
        F.when(~fresh, "degrade_to_source_or_rederive")
        .when(level.isin("hard_verified", "endorsed", "source_observed", "observed"), "can_use_with_source_anchor_for_precision")
        .when(level == "attributed", "use_as_attributed_context_verify_behavior_in_source")
        .when(level.isin("unsupported_intent", "unsupported"), "treat_as_hint_read_source_before_acting")
        .otherwise("inspect_manually")
    )


def warnings(foreign: Column, fresh: Column, level: Column, unmatched: Column) -> Column:
    """The warnings that apply, by code."""
    return F.array_compact(
        F.array(
            F.when(foreign, "UNVERIFIED_FOREIGN"),
            F.when(~fresh, "STALE_BUT_STORED"),
            F.when(level.isin("hard_verified", "endorsed"), "HIGH_TRUST_IS_NOT_SOURCE"),
            F.when(level.isin("unsupported_intent", "unsupported"), "LOW_SUPPORT"),
            F.when(unmatched, "PROVENANCE_AVAILABLE_NOT_MATCHED"),
        )
    )
