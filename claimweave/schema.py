"""The claim record and its derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "v2"
READABLE = ("v0", "v1", "v2")
BINDING = "struct<path:string,file_blob:string,fn_hash:string,qualname:string,role:string,line_start:int,line_end:int,node_kind:string>"
CLAIM = (
    "claim_id string, claim string, kind string, scope string, "
    f"bindings array<{BINDING}>, "
    "provenance string, evidence string, confidence double, endorsed_by string, last_verified timestamp, model string, "
    "owner_path string, qualname string, name string, node_kind string, language string, keywords array<string>, edge_kind string, source_id string, target_id string, "
    "resolution string, origin string, trust string, derivation_version string, body string, schema_version string"
)


def conform(df: DataFrame) -> DataFrame:
    """df with exactly the claim columns, missing ones null, and confidence within 0 and 1."""
    fields = df.sparkSession.createDataFrame([], CLAIM).schema.fields
    out = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence"))).withColumn("schema_version", F.lit(VERSION))
