"""Contracts of functions: what a model proposed, held against what the source shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAP = 0.6
VALUE_WORDS = ("return", "value", "object", "dict", "list", "result")
PURE_WORDS = ("no side", "pure", "does not write")


def sanitised(cands: DataFrame) -> DataFrame:
    """cands: params and raises (array<struct<name,meaning>>), returns, side_effects (array<string>), confidence, mech_params, mech_raises,
    has_value, has_write, and any key columns. The slots that the source contradicts go, with a check for each; confidence is capped.

    Parameters must be in the signature, once; exceptions must be raised in the source; a returned value can't be claimed where none is,
    nor purity where something is written. All of it stays in the JVM.
    """
    low = F.lower("returns")
    claims_value = F.lit(False)
    for w in VALUE_WORDS:
        claims_value = claims_value | F.contains(low, F.lit(w))

    def impure(s):
        hit = F.lit(False)
        for w in PURE_WORDS:
            hit = hit | F.contains(F.lower(s), F.lit(w))
        return hit & F.col("has_write")

    names = F.col("params.name")
    ok_param = lambda p, i: F.array_contains("mech_params", p["name"]) & (F.array_position(names, p["name"]) == i + 1)
    ok_raise = lambda r: F.array_contains("mech_raises", r["name"])
    reject_return = F.col("returns").isNotNull() & ~F.col("has_value") & claims_value
    checks = F.concat(
        F.transform(F.filter("params", lambda p: ~F.array_contains("mech_params", p["name"])), lambda p: F.concat(F.lit("param_not_in_signature:"), p["name"])),
        F.transform(F.filter("params", lambda p, i: F.array_contains("mech_params", p["name"]) & (F.array_position(names, p["name"]) != i + 1)), lambda p: F.concat(F.lit("duplicate_param:"), p["name"])),
        F.transform(F.filter("raises", lambda r: ~ok_raise(r)), lambda r: F.concat(F.lit("exception_not_mechanically_observed:"), r["name"])),
        F.when(reject_return, F.array(F.lit("claims_return_value_but_mechanical_return_has_no_value"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter("side_effects", impure), lambda s: F.concat(F.lit("claims_no_side_effects_but_mechanical_writes_exist:"), s)),
    )
    out = cands.withColumn("checks", checks).withColumn("omitted", F.array_except("mech_params", names)).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.coalesce("confidence", F.lit(CAP)), F.lit(CAP))))
    out = out.withColumn("returns", F.when(~reject_return, F.col("returns"))).withColumn("side_effects", F.filter("side_effects", lambda s: ~impure(s))).withColumn("raises", F.filter("raises", ok_raise))
    return out.withColumn("params", F.filter("params", ok_param))


def mechanical(interfaces: DataFrame) -> DataFrame:
    """Slots from interfaces alone: params and raises named, the return's shape, and whether anything is written (n_writes)."""
    return interfaces.select(
        "*",
        F.transform("params", lambda p: F.struct(p["name"].alias("name"), F.coalesce(p["annotation"], F.lit("unannotated")).alias("meaning"))).alias("param_slots"),
        F.transform("raises", lambda r: F.struct(r.alias("name"), F.lit("raised in the body").alias("meaning"))).alias("raise_slots"),
        F.when(F.col("n_writes") > 0, F.array(F.lit("writes module state"))).otherwise(F.array().cast("array<string>")).alias("side_effect_slots"),
    )
