"""Mixing sources to target weights (8), native: Poisson replication. A hash-seeded uniform number per document is put through the
inverse Poisson distribution of its source's target repetition rate; copies are exploded and shuffled globally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import broadcast_if_small, materialise, table

#: Sources weigh as their bytes to this power; the whole output is EPOCHS times the input's bytes.
TEMPERATURE, EPOCHS, SEED = 0.5, 1.0, "mix-1"
#: Rates above this are drawn as a sum of equal parts, since exp(-rate) must not underflow.
PART = 500.0
#: The largest number that uniform gives.
ALL = 1 - 2.0**-53


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def poisson_table(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ...: up to 12 deviations and 30 beyond the mean, or to where it is all but 1. Made once
    for a rate, not for a draw."""
    last = F.ceil(rate + F.sqrt(rate) * 12 + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(a: Column, j: Column) -> Column:
        p = a["p"] * rate / j
        c = F.element_at(a["c"], -1)
        return F.struct(p.alias("p"), F.when(c < ALL, F.concat(a["c"], F.array(c + p))).otherwise(a["c"]).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def poisson_inverse(u: Column, table_: Column) -> Column:
    """The smallest k whose Poisson distribution function reaches u: so many entries of the table are below u."""
    return F.size(F.filter(table_, lambda c: c < u))


def poisson_parts(rate: Column) -> Column:
    """Draws that make up one of this rate."""
    return F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")


def poisson_count(table_: Column, parts: Column, *seed: Column) -> Column:
    """A Poisson draw of any mean, seeded by the hash of the seed: the sum of `parts` draws from the table; 0 for a rate of 0."""
    rest = F.aggregate(F.sequence(F.lit(2), parts), F.lit(0), lambda a, i: a + poisson_inverse(uniform(*seed, i.cast("string")), table_))
    return poisson_inverse(uniform(*seed, F.lit("1")), table_) + F.when(parts > 1, rest).otherwise(0)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", text_col: str = "text", epochs: float = EPOCHS, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n_docs, n_bytes, rate): the mean repetitions that give each source its target share of the output's bytes.

    weights: targets by source (sources that it lacks get 0); None: bytes to the power `temperature`. A null source is a source of its
    own. Sources without bytes get rate 0 under weights by bytes; an empty table gives no rows.
    """
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    per = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_bytes"))
    per = materialise(per, "sources")
    if weights is None:
        per = per.withColumn("weight", F.pow(F.col("n_bytes").cast("double"), F.lit(temperature)))
    else:
        known = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "s string, weight double").dropDuplicates(["s"])
        per = per.join(known, per.source.eqNullSafe(known.s), "left").drop("s").fillna(0.0, ["weight"])
    total = per.agg(F.sum("weight").alias("weight"), F.sum("n_bytes").alias("n_bytes")).first()
    if not total["weight"]:
        return per.select("source", "n_docs", "n_bytes", F.lit(0.0).alias("rate"))
    rate = F.when(F.col("n_bytes") > 0, F.col("weight") / F.lit(total["weight"]) * F.lit(total["n_bytes"]) * float(epochs) / F.col("n_bytes")).otherwise(0.0)
    return per.select("source", "n_docs", "n_bytes", rate.alias("rate"))


def mix(docs: DataFrame, rates: DataFrame, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with n_copies, copy_no (from 1), rate and shuffle_key, a row for each copy drawn, in the order of shuffle_key.

    Draws depend on seed and doc_id alone: rows that repeat a doc_id are drawn alike, a null doc_id counts as the word null. Columns of
    those four names are replaced.
    """
    docs = docs.drop("rate", "n_copies", "copy_no", "shuffle_key")
    return drawn(docs, rates, seed, id_col, source_col).withColumnsRenamed({"__rate": "rate", "__n_copies": "n_copies", "__copy_no": "copy_no", "__shuffle_key": "shuffle_key"})


def drawn(docs: DataFrame, rates: DataFrame, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """mix, but with columns named __rate, __n_copies, __copy_no and __shuffle_key; docs keep all of theirs.

    Shuffle keys are uniform, so the ranges of the output's partitions are known without sampling, and each draw is made once.
    """
    rates = rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    parts = poisson_parts(F.col("__rate"))
    rates = broadcast_if_small(materialise(rates.withColumn("__parts", parts).withColumn("__table", poisson_table(F.col("__rate") / parts)), "rates"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    d = docs.join(rates, docs[source_col].eqNullSafe(rates["__source"]))
    d = d.withColumn("__n_copies", poisson_count(F.col("__table"), F.col("__parts"), F.lit(seed), key)).where(F.col("__n_copies") > 0)
    d = d.drop("__source", "__parts", "__table").withColumn("__copy_no", F.explode(F.sequence(F.lit(1), F.col("__n_copies"))))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + "-place"), key, F.col("__copy_no").cast("string"))), 1, 15), 16, 10).cast("long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("__shuffle_key", place)
    return d.repartitionById(n, F.floor(F.col("__shuffle_key") / F.lit(2.0**60) * n).cast("int")).sortWithinPartitions("__shuffle_key", "__copy_no")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates = source_rates(docs)
    out = mix(docs.select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), rates)
    return out.select("doc_id", "source", "n_bytes", F.col("n_copies").cast("long").alias("n_copies"), F.col("copy_no").cast("long").alias("copy_no"), F.round("rate", 6).alias("rate"), "shuffle_key")


OP8_SQL = r"""
WITH RECURSIVE per AS (SELECT source, sum(strlen(coalesce(text, '')))::BIGINT AS b FROM documents GROUP BY source),
tot AS (SELECT sum(CASE WHEN b > 0 THEN pow(b::DOUBLE, 0.5) ELSE 0 END) AS w, sum(b)::BIGINT AS b FROM per),
rates AS (SELECT source, CASE WHEN per.b > 0 THEN pow(per.b::DOUBLE, 0.5) / tot.w * tot.b / per.b ELSE 0.0 END AS rate FROM per, tot),
cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
),
u AS (SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
        (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, u.source, u.n_bytes, min(cdf.rate) AS rate, count(*) FILTER (WHERE cdf.c < u.u) AS n_copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY ALL),
e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM n WHERE n_copies > 0)
SELECT doc_id, source, n_bytes, n_copies::BIGINT AS n_copies, copy_no::BIGINT AS copy_no, round(rate, 6) AS rate,
       ('0x' || substr(md5('mix-1-place:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no), 1, 15))::BIGINT AS shuffle_key FROM e
"""
