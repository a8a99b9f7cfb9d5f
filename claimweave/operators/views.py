"""Views of claims for readers: explanations, thin records, text, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.numbers import action_hint, feedback_confidence, trust_level, warnings

PLACEHOLDER = "unverified claim of another store; derive it from the source"


def explained(claims: DataFrame, fresh: DataFrame) -> DataFrame:
    """claims with fresh, stale_reasons, trust level, hint, warnings, and the text and confidence that may be shown.

    fresh: claim_id, fresh, stale_reasons. What came from elsewhere and wasn't derived here has no confidence and shows a placeholder.
    """
    c = claims.join(fresh, "claim_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    foreign = F.coalesce(F.col("trust") == "unverified_foreign", F.lit(False))
    verification = F.get_json_object("body", "$.verification")
    raw = F.get_json_object("body", "$.raw_confidence").try_cast("double")
    c = c.withColumn("level", trust_level(foreign, F.col("evidence"), F.col("endorsed_by"), verification))
    shown = F.when(foreign, 0.0).otherwise(F.col("confidence"))
    unmatched = F.get_json_object("body", "$.available_provenance").isNotNull() & F.get_json_object("body", "$.provenance_evidence").isNull()
    return c.select(
        "claim_id",
        F.when(foreign, PLACEHOLDER).otherwise(F.col("claim")).alias("claim"),
        "fresh",
        F.when(F.col("fresh"), F.array().cast("array<string>")).otherwise(F.col("stale_reasons")).alias("stale_reasons"),
        "level",
        action_hint(F.col("fresh"), F.col("level")).alias("action_hint"),
        warnings(foreign, F.col("fresh"), F.col("level"), unmatched).alias("warnings"),
        "evidence",
        shown.alias("confidence"),
        raw.alias("raw_confidence"),
        F.coalesce(raw > shown, F.lit(False)).alias("confidence_cap_applied"),
        "kind", "scope", "model", "last_verified", "endorsed_by", "qualname", "language", "node_kind", "owner_path", "bindings", "body",
    )


def anchor(bindings: str = "bindings"):
    b = F.col(bindings)[0]
    return F.when(b["line_start"].isNotNull(), F.concat_ws(":", b["path"], b["line_start"].cast("string"))).otherwise(b["path"])


def thin(view: DataFrame) -> DataFrame:
    """The few columns that fit into a context: short hashes, no quoted text."""
    short = F.transform("bindings", lambda b: F.struct(b["path"].alias("path"), F.left(b["file_blob"], F.lit(12)).alias("file_blob"), F.left(b["fn_hash"], F.lit(12)).alias("fn_hash"), b["line_start"].alias("line_start"), b["line_end"].alias("line_end")))
    return view.select("claim_id", "claim", "fresh", "stale_reasons", "level", "action_hint", "warnings", "evidence", "confidence", "scope", "qualname", "language", "node_kind", anchor().alias("anchor"), short.alias("bindings"))


def reviewer_text(view: DataFrame) -> DataFrame:
    claim = F.left(F.regexp_replace("claim", r"\s+", " "), F.lit(240))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("claim: "), claim),
        F.concat(F.lit("id: "), "claim_id"),
        F.concat(F.lit("state: "), F.when(F.col("fresh"), "fresh").otherwise("stale"), F.lit(", trust "), "level", F.lit(", confidence "), F.format_number("confidence", 2)),
        F.concat(F.lit("where: "), anchor()),
        F.concat(F.lit("do: "), "action_hint"),
        F.when(F.size("stale_reasons") > 0, F.concat(F.lit("stale: "), F.array_join("stale_reasons", "; "))),
        F.when(F.size("warnings") > 0, F.concat(F.lit("warnings: "), F.array_join("warnings", "; "))),
    )
    return view.select("claim_id", lines.alias("text"))


def with_feedback(claims: DataFrame, events: DataFrame) -> DataFrame:
    """claims after feedback (claim_id, kind): use changes nothing, verification raises, falsification and hunches lower. Of a claim's
    events the strongest counts: falsified, then verified, then hunch."""
    rank = F.when(F.col("kind") == "falsified", 3).when(F.col("kind") == "verified", 2).when(F.col("kind") == "hunch", 1).otherwise(0)
    e = events.groupBy("claim_id").agg(F.max_by("kind", rank).alias("__kind"))
    c = claims.join(e, "claim_id", "left").withColumn("__kind", F.coalesce("__kind", F.lit("usage")))
    c = c.withColumn("confidence", feedback_confidence(F.col("__kind"), F.col("confidence")))
    c = c.withColumn("evidence", F.when(F.col("__kind") == "verified", "verified").otherwise(F.col("evidence")))
    return c.withColumn("last_verified", F.when(F.col("__kind") == "verified", F.date_trunc("second", F.current_timestamp())).otherwise(F.col("last_verified"))).drop("__kind")


def candidate_view(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", "qualname", "owner_path", "scope", "node_kind", "language", anchor().alias("anchor"))
