"""Table and view declarations of .sql files, in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import identifier_keywords

CREATE = r"""(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][A-Za-z0-9_$.]*|"[^"]+"|`[^`]+`|\[[^\]]+\])"""


SCHEMA = "path string, declaration_kind string, qualname string, line_start int, declaration_hash string, keywords array<string>"


def declarations(files: DataFrame) -> DataFrame:
    """files (path, text): path, declaration_kind, qualname, line_start, declaration_hash, keywords. Text that isn't in a .sql file is left alone."""
    f = files.where(F.col("path").endswith(".sql") & F.col("text").isNotNull())
    parts = F.arrays_zip(F.regexp_extract_all("text", F.lit(CREATE), F.lit(0)).alias("whole"), F.split("text", CREATE, -1).alias("gap"))
    f = f.select("path", F.posexplode(parts).alias("i", "m"), F.split("text", CREATE, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(CREATE), F.lit(0)).alias("all")).where(F.col("m.whole").isNotNull())
    before = F.concat(F.array_join(F.slice("gaps", 1, F.col("i") + 1), ""), F.array_join(F.slice("all", 1, F.col("i")), ""))
    name = F.regexp_extract("m.whole", CREATE, 2)
    plain = F.regexp_replace(name, r'^["`\[]|["`\]]$', "")
    return f.select(
        "path",
        F.concat(F.lit("sql_"), F.lower(F.regexp_extract("m.whole", CREATE, 1))).alias("declaration_kind"),
        plain.alias("qualname"),
        (F.char_length(before) - F.char_length(F.translate(before, "\n", "")) + 1).alias("line_start"),
        F.sha2("m.whole", 256).alias("declaration_hash"),
        identifier_keywords(plain).alias("keywords"),
    )
