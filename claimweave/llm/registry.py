"""The training-data queries, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import decontaminate, html_text, language, licenses, line_dedup, media, mixing, near_dup, pii, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_licenses": licenses.op2_licenses,
    "op3_html": html_text.op3_html,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_language": language.op5_language,
    "op6_media": media.op6_media,
    "op7_near_dup": near_dup.op7_near_dup,
    "op8_mixing": mixing.op8_mixing,
    "op9_sharding": sharding.op9_sharding,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
}
