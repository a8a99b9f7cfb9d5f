"""Benchmark decontamination (10), native: winnowing. Documents and items keep the smallest k-gram hash, with its position, of every run
of `8 - k + 1` k-grams, so any shared span of 8 words shares a fingerprint; the hits of the join are extended to exact spans around
their positions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import broadcast_if_small, materialise, same_row, table, words_of

SPAN = 8  #: words of a window
GRAM = 5  #: words of a fingerprinted k-gram; SPAN - GRAM + 1 of them are one winnowing window
#: A mark is a hash above PLACE bits of position (Spark's texts have fewer words), so that the least mark is the least hash's first place.
PLACE = 30
#: Rows that carry a document's word count through the join of its fingerprints, by so many keys.
CARRIERS = 1024


def _upto(last: Column) -> Column:
    """0 .. last, empty if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _at(hashes: str, i: Column, m: int) -> list[Column]:
    return [F.get(hashes, i + j) for j in range(m)]


def marks(hashes: str, m: int) -> Column:
    """The marks of all m-grams of an array of word hashes."""
    return F.transform(_upto(F.size(hashes) - m), lambda i: F.xxhash64(F.lit(m), *_at(hashes, i, m)).bitwiseAND(F.lit((1 << 63) - (1 << PLACE))).bitwiseOR(i.cast("long")))


def winnowed(of: str) -> Column:
    """The distinct minima of all windows of SPAN - GRAM + 1 successive marks."""
    w = SPAN - GRAM + 1
    return F.array_distinct(F.transform(_upto(F.size(of) - w), lambda i: F.least(*_at(of, i, w))))


def fingerprint(mark: Column) -> Column:
    return F.shiftright(mark, PLACE)


def _marked(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (with words) with marks: winnowed ones for windows of SPAN words, those of all m-grams for the shorter windows of short items."""
    df = df.withColumn("__h", F.transform("words", lambda w: F.xxhash64(w)))
    if SPAN in lengths:
        df = df.withColumn("__all", marks("__h", GRAM)).withColumn("marks", winnowed("__all")).drop("__all")
    else:
        df = df.withColumn("marks", F.array().cast("array<long>"))
    for m in lengths:
        if m < SPAN:
            df = df.withColumn("marks", F.concat("marks", marks("__h", m)))
    return df.drop("__h")


def _window(m: int) -> Callable[[Column], Column]:
    """Place, length and two independent hashes of the words of the window at a place."""

    def at(i: Column) -> Column:
        own = _at("words", i, m)
        return F.struct(i.alias("pos"), F.lit(m).alias("m"), F.xxhash64(*own).alias("ga"), F.hash(*own).alias("gb"))

    return at


def _extended(df: DataFrame, lengths: list[int]) -> DataFrame:
    """The windows around the hits of df (words, hits array<struct<p,m>>), a row each: a hit of a winnowed k-gram is in the windows of SPAN words
    that hold it, that of a short item's window is it."""
    def around(m: int) -> Column:
        own = F.transform(F.filter("hits", lambda h: h["m"] == m), lambda h: h["p"])
        if m == SPAN:
            own = F.flatten(F.transform(own, lambda p: F.sequence(F.greatest(p - (SPAN - GRAM), F.lit(0)), p)))
        return F.transform(F.filter(F.array_distinct(own), lambda i: i + m <= F.size("words")), _window(m))

    return df.withColumn("spot", F.explode(F.concat(*map(around, lengths)))).select(*[c for c in df.columns if c not in ("words", "hits")], "spot.*")


def benchmark_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text_key, n_words, n_hit, n_items, item_ids (strings, sorted).

    Null texts have no words, items without words no windows. Items of fewer than SPAN words are one window of their own length.
    Repeated rows get equal results, one for each; rows that share a doc_id but not the text are looked at each on its own.
    Repeated item_ids count once. Empty tables give empty results or zero hits.
    """
    items = bench.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    items = materialise(items.withColumn("m", F.least(F.size("words"), F.lit(SPAN))), "items")
    lengths = sorted(r.m for r in items.select("m").distinct().collect())  # at most SPAN values
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    zero = F.coalesce(F.lit(None).cast("long"), F.lit(0))
    if not lengths:
        return src.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"), F.array().cast("array<string>").alias("item_ids"))
    known, wins = [], []
    for m in lengths:
        own = items.where(F.col("m") == m).drop("m")
        known.append(_marked(own, [m]).select(F.explode("marks").alias("mark")).select(fingerprint(F.col("mark")).alias("fp"), F.lit(m).alias("m")))
        wins.append(own.select("item", F.explode(F.transform(_upto(F.size("words") - m), _window(m))).alias("w")).select("item", "w.m", "w.ga", "w.gb"))
    carriers = docs.sparkSession.range(CARRIERS).select((-1 - F.col("id")).alias("fp"), F.lit(0).alias("m"))
    fps = broadcast_if_small(materialise(reduce(DataFrame.unionByName, known).distinct().unionByName(carriers), "fps"))
    wins = materialise(reduce(DataFrame.unionByName, wins).distinct(), "windows")

    # Which fingerprints of a row an item has, and where. Every row comes through by a carrier of its own (negative; fingerprints aren't).
    carrier = (F.lit(-1) - F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(CARRIERS))).cast("long")
    rows = _marked(src, lengths).select("doc_id", "text_key", F.size("words").alias("n_words"), F.explode(F.concat(F.array(F.shiftleft(carrier, PLACE)), "marks")).alias("mark"))
    rows = rows.withColumn("fp", fingerprint(F.col("mark"))).join(fps, "fp")
    rows = materialise(rows.select("doc_id", "text_key", "n_words", F.col("mark").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("p"), "m"), "hits")
    base = rows.where("m = 0").select("doc_id", "text_key", "n_words")
    # The hits of a text are no more than its words. They are extended in the text itself, not beyond the windows that hold them.
    hits = rows.where("m > 0").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("p", "m")).alias("hits"))
    hits = broadcast_if_small(materialise(hits, "candidates"))
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    near = text.join(hits, same_row(text, hits, "doc_id", "text_key")).select(text.doc_id, text.text_key, words_of(F.col("text")).alias("words"), "hits")
    grams = broadcast_if_small(wins.select("m", "ga", "gb").distinct())
    hits = _extended(near, lengths).join(grams, ["m", "ga", "gb"]).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("pos", "m"))).alias("spans"), F.collect_set(F.struct("m", "ga", "gb")).alias("found"))
    hits = materialise(hits, "spans")
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(F.greatest(a["end"], s["pos"] + s["m"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["pos"] + s["m"] - F.greatest(a["end"], s["pos"])).cast("long")).alias("n")))["n"]
    by_item = hits.select("doc_id", "text_key", F.explode("found").alias("g")).select("doc_id", "text_key", "g.*").join(broadcast_if_small(wins), ["m", "ga", "gb"])
    by_item = by_item.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    found = hits.select("doc_id", "text_key", covered.alias("n_hit")).alias("h")
    found = found.join(by_item.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.text_key") == F.col("i.text_key"))).select("h.doc_id", "h.text_key", "n_hit", "item_ids")
    out = base.join(found, same_row(base, found, "doc_id", "text_key"), "left")
    return out.select(base.doc_id, base.text_key, F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, min_items: int = 1) -> DataFrame:
    """docs without the rows in which windows of at least min_items benchmark items occur."""
    bad = benchmark_hits(docs, bench).where(F.col("n_items") >= min_items).select("doc_id", "text_key").distinct()
    bad = broadcast_if_small(materialise(bad, "contaminated"))
    d = docs.withColumn("__text_key", F.xxhash64("text"))
    return d.join(bad, d["doc_id"].eqNullSafe(bad["doc_id"]) & (d["__text_key"] == bad["text_key"]), "left_anti").select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


OP10_SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS g FROM (SELECT item_id, w, least(8, len(w)) AS m, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS p FROM it WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, greatest(1, len(w) - m + 2))) AS p FROM low, lens)),
hit AS (SELECT dw.doc_id, dw.p, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM low LEFT JOIN cov ON low.doc_id = cov.doc_id LEFT JOIN ids ON low.doc_id = ids.doc_id
"""
