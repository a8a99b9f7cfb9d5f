"""Line dedup (4), native: hashes of lines are range-partitioned with a secondary sort by document and position; the first occurrence of
each line in each document is streamed off the sorted runs, and the result is a run-length compressed keep bitmap per document instead
of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.common import ascii_lower, broadcast_if_small, materialise, same_row, table

BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = 20, min_docs: int = 3) -> DataFrame:
    """Keep bitmaps of the documents that lose a line: (doc_id, text_key, n_lines, n_dropped, keep_runs array<struct<start,len>>).

    A line's key is the line stripped of ASCII white space and lower-cased (A-Z). Keys of at least `min_points` code points in at
    least `min_docs` documents lose their lines everywhere but in the largest doc_id. Documents are told apart by doc_id; rows that
    repeat a doc_id count as one document, each keeps its own bitmap (by text_key, a hash of its text). A null doc_id counts as
    one document, smaller than any other. A null text is one empty line. An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), lines_of(F.col(text_col)).alias("ls"))
    rows = src.select("doc_id", "text_key", F.size("ls").alias("n_lines"), F.posexplode("ls").alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.char_length("line") >= min_points)
    lines = materialise(rows.select("doc_id", "text_key", "n_lines", "pos", F.unhex(F.md5(ascii_lower(F.col("line")))).alias("h")), "lines")

    # Sorted runs: a hot line spreads over as many ranges as it needs, since doc_id is part of the range key. The window asks for rows of
    # (h, doc_id) together and in order of pos, which the runs are, so it neither shuffles nor sorts anew.
    runs = lines.select("h", "doc_id", "pos").repartitionByRange("h", "doc_id").sortWithinPartitions("h", "doc_id", "pos")
    first = runs.withColumn("nth", F.row_number().over(Window.partitionBy("h", "doc_id").orderBy("pos"))).where("nth = 1")
    # One row per (line, document) is left, the largest document of a line last; both are combined before they are shuffled.
    often = first.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    often = broadcast_if_small(materialise(often.select("h", "keeper"), "often"))

    lost = lines.join(often, "h").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("doc_id", "text_key", "n_lines").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    cuts = lost.withColumn("cuts", F.concat(F.array(F.lit(-1)), "lost", F.array("n_lines")))
    gap = F.transform(F.sequence(F.lit(0), F.size("lost")), lambda i: F.struct((F.get("cuts", i) + 1).alias("start"), (F.get("cuts", i + 1) - F.get("cuts", i) - 1).alias("len")))
    return cuts.select("doc_id", "text_key", "n_lines", F.size("lost").alias("n_dropped"), F.filter(gap, lambda r: r["len"] > 0).alias("keep_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept_text. Rows without a bitmap keep their whole text (null: empty)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.xxhash64(F.col(text_col)).alias("text_key"))
    b = bitmaps.withColumnRenamed("n_lines", "b_lines")
    j = d.join(b, same_row(d, b, "doc_id", "text_key"), "left").select(d.doc_id, "body", "n_dropped", "keep_runs")
    ls = F.split("body", "\n", -1)
    kept = F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice("ls", r["start"] + 1, r["len"]))), "\n")
    j = j.withColumn("ls", ls)
    return j.select(
        "doc_id",
        F.size("ls").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep_runs").isNull(), F.col("body")).otherwise(kept).alias("kept_text"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line,
         translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), often AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE often.k IS NOT NULL AND l.doc_id <> keeper) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often.k IS NULL OR l.doc_id = keeper), '')) AS kept_sha256
FROM l LEFT JOIN often ON l.k = often.k GROUP BY l.doc_id
"""
