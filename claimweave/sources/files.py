"""Sources: trees of files, claim records, metrics logs, provenance and semantic facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.ids import git_blob
from claimweave.schema import READABLE

SUFFIXES = (".py", ".json", ".toml", ".java", ".yaml", ".yml", ".sql")


def ignored(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is an ignored prefix or below one. Blank lines and comments are no prefixes."""
    out = F.lit(False)
    for p in (x.strip() for x in prefixes):
        if p and not p.startswith("#"):
            bare = p.rstrip("/")
            out = out | (path == bare) | path.startswith(p if p.endswith("/") else p)
    return out


def source_tree(spark: SparkSession, root: str, prefixes: list[str] | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path (below the root), text, blob of the files that are kept. Undecodable bytes become replacement characters."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*(?=/)", "")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), F.concat(F.lit("^"), F.regexp_replace(base, r"([.+$^()\[\]{}|*?\\])", r"\\$1"), F.lit("/")), "")
    df = df.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"))
    kept = F.lit(False)
    for s in suffixes:
        kept = kept | F.col("path").endswith(s)
    df = df.where(kept & ~ignored(F.col("path"), [".git/", ".claims/", *(prefixes or [])]))
    return df.withColumn("blob", git_blob(F.col("text")))


def claim_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Claims from JSON records, one a line; corrupt records and unknown versions are left out."""
    df = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where(F.col("_corrupt").isNull() & F.col("claim_id").isNotNull() & F.coalesce("schema_version", F.lit("v0")).isin(*READABLE)).drop("_corrupt")


def metrics_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """ts, event, node_id, duration_ms, read_bytes, cache_bytes of a log of JSON lines; lines that don't parse are left out."""
    df = spark.read.schema("ts string, event string, node_id string, duration_ms string, read_bytes string, cache_bytes_estimate string").option("mode", "DROPMALFORMED").json(path)
    df = df.withColumn("ts", F.try_to_timestamp("ts").cast("timestamp_ntz")).where("event is not null")
    return df if since is None else df.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))


#: Fields that would carry sources into a log.
CONTENT = ("source", "source_text", "content", "code")


def append_metrics(events: DataFrame, path: str) -> None:
    """Appends events (event, ts or none, any fields) to a log of JSON lines, without fields that hold sources. Appending adds files, so
    writers don't meet."""
    kept = events.drop(*CONTENT)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    kept = kept.withColumn("ts", F.coalesce(F.col("ts").cast("string"), now) if "ts" in kept.columns else now)
    kept.select(*sorted(kept.columns)).write.mode("append").json(path)


def semantic_facts(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Facts of external tools, from JSON documents: those whose source hash is that of the file now, and of which no two documents tell
    different things about a symbol."""
    fact = "struct<kind:string,source_symbol:string,target_symbol:string>"
    df = spark.read.schema(f"path string, provider string, tool string, tool_version string, content_sha256 string, facts array<{fact}>").option("mode", "DROPMALFORMED").json(path)
    now = files.select("path", F.sha2("text", 256).alias("now"))
    df = df.where("provider is not null and tool is not null and path not like '/%' and path not like '%..%'").join(now, "path").where(F.col("content_sha256") == F.col("now"))
    f = df.select("path", "provider", "tool", "tool_version", F.explode("facts").alias("f")).select("path", "provider", "tool", "tool_version", "f.*").distinct()
    one = f.groupBy("path", "kind", "source_symbol").agg(F.countDistinct("target_symbol").alias("n")).where("n = 1").drop("n")
    return f.join(one, ["path", "kind", "source_symbol"], "left_semi")


def blame_evidence(blame: DataFrame, spans: DataFrame) -> DataFrame:
    """The most frequent commit of each span's lines, the first seen of equals. blame: path, line, commit; spans: path, span, line_start, line_end."""
    from claimweave.operators.incremental import anchored

    hit = anchored(blame, spans).groupBy("path", "span", "commit").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    return hit.groupBy("path", "span").agg(F.max_by(F.struct("commit", "n"), F.struct("n", -F.col("first"))).alias("x")).select("path", "span", "x.commit", F.col("x.n").alias("lines"))
