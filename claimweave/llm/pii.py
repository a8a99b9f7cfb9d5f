"""PII (1), native: information-theoretic sanitisation. Pattern matches are the protected entities; how strongly a term nearby reveals
one is its pointwise mutual information with the entity over the corpus, as a share of the entity's information content. Terms beyond
the disclosure thresholds are generalised or removed along with the entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.common import LOWER, UPPER, broadcast_if_small, materialise, same_row, table

#: kind, pattern as given, and the same language for Java's matcher without quadratic scans: a match can start only where a run of its
#: first class starts, or where the match before ended.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: What a text must contain to be searched for a kind at all.
GATES = ("@", r"[0-9]\.[0-9]", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "+")
IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
TERM = r"[A-Za-z\x{80}-\x{10FFFF}]{3,}"
TERM_SQL = r"[A-Za-z\x{80}-\x{10FFFF}]{3,}"

#: Code points on either side of an entity, up to its neighbour of the same kind, in which terms are looked at.
REACH = 80
#: A term must stand near an entity in so many different contexts, and documents, for its statistics to count.
SUPPORT = 3
#: Shares of an entity's information content from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.75, 0.9
#: A term's class is all terms of its first letters; it stands for a generalised term if it doesn't itself disclose the entity.
LETTERS = 2


def located(text: str, pattern: str, gate: Column) -> Column:
    """Matches of the pattern in a column: array of struct(s, e, m, before, after), in code points; the gaps come from split, which finds the same matches."""
    raw = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    none = F.array().cast("array<struct<m:string,gap:string>>")
    return F.when(gate, raw).otherwise(none)


def placed(zipped: str) -> Column:
    """Positions for the result of located."""
    kind = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("got"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.char_length(x["gap"])
        e = s + F.coalesce(F.char_length(x["m"]), F.lit(0))
        return F.struct(e.alias("at"), F.when(x["m"].isNull(), a["got"]).otherwise(F.concat(a["got"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))))).alias("got"))

    got = F.aggregate(zipped, start, step)["got"]
    near = F.transform(got, lambda g, i: F.struct(g["s"].alias("s"), g["e"].alias("e"), g["m"].alias("m"), F.right(F.get(F.col(zipped), i)["gap"], F.lit(REACH)).alias("before"), F.left(F.get(F.col(zipped), i + 1)["gap"], F.lit(REACH)).alias("after")))
    return F.when(F.size(zipped) > 1, near).otherwise(F.array()).cast(kind)


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(IP)
    if kind == "card":
        return F.char_length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def _entity(kind: str, m: Column) -> Column:
    value = F.translate(m, UPPER, LOWER) if kind == "email" else m if kind == "ip" else F.regexp_replace(m, "[^0-9]", "")
    return F.concat(F.lit(kind + ":"), value)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (without the text) with base: the valid matches of all kinds, by start and then kind:
    array<struct<s,k,e,kind,entity,before,after>>."""
    keep = [c for c in docs.columns if c != text]
    gates = [F.contains(F.col(text), F.lit(GATES[0])), F.col(text).rlike(GATES[1]), F.col(text).rlike(GATES[2]), F.contains(F.col(text), F.lit(GATES[3]))]
    df = docs.select(*keep, *[located(text, java, g).alias(f"z_{kind}") for (kind, _, java), g in zip(KINDS, gates, strict=True)])
    df = df.select(*keep, *[placed(f"z_{kind}").alias(f"p_{kind}") for kind, _, _ in KINDS])

    def rows(k: int, kind: str) -> Column:
        ok = F.filter(f"p_{kind}", lambda x: _valid(kind, x["m"]))
        return F.transform(ok, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), _entity(kind, x["m"]).alias("entity"), x["before"].alias("before"), x["after"].alias("after")))

    return df.select(*keep, F.array_sort(F.concat(*[rows(k, kind) for k, (kind, _, _) in enumerate(KINDS)])).alias("base"))


def _terms(base: DataFrame) -> DataFrame:
    """(row keys, entity, ctx, term, s, e): the terms around each entity. ctx is a hash of the context, equal for copied passages."""
    m = base.select("doc_id", "text_key", F.explode("base").alias("b")).select("doc_id", "text_key", "b.*")
    m = m.withColumn("ctx", F.xxhash64("before", "after"))
    always = F.lit(True)
    sides = m.select("doc_id", "text_key", "entity", "ctx", "s", "e", "before", located("before", TERM, always).alias("zb"), located("after", TERM, always).alias("za"))
    sides = sides.select("doc_id", "text_key", "entity", "ctx", (F.col("s") - F.char_length("before")).alias("from_b"), F.col("e").alias("from_a"), placed("zb").alias("pb"), placed("za").alias("pa"))

    def at(side: str, start: str) -> Column:
        return F.transform(side, lambda x: F.struct(F.translate(x["m"], UPPER, LOWER).alias("term"), (x["s"] + F.col(start)).alias("s"), (x["e"] + F.col(start)).alias("e")))

    # A term that the reach cuts off is not a whole term, so its piece is left out.
    cut_b = F.filter(at("pb", "from_b"), lambda x: x["s"] > F.col("from_b"))
    cut_a = F.filter(at("pa", "from_a"), lambda x: x["e"] < F.col("from_a") + REACH)
    return sides.select("doc_id", "text_key", "entity", "ctx", F.explode(F.concat(cut_b, cut_a)).alias("t")).select("doc_id", "text_key", "entity", "ctx", "t.*")


def disclosures(docs: DataFrame, base: DataFrame, terms: DataFrame) -> DataFrame:
    """(entity, term, disclosure, open): pairs whose share of the entity's information content reaches GENERALISE; open, if the term's class does so too.

    Probabilities are over documents: PMI(t, e) = log2(N n(t,e) / (df(t) df(e))), disclosure = PMI / log2(N / df(e)).
    """
    terms = terms.select("entity", "ctx", "doc_id", "text_key", F.explode(F.array("term", class_of(F.col("term")))).alias("term"))
    pairs = terms.groupBy("entity", "term", "ctx").agg(F.min("doc_id").alias("one")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.countDistinct("one").alias("ones")).where(F.col("contexts") >= SUPPORT)
    pairs = materialise(pairs.select("entity", "term"), "pairs")
    both = terms.select("entity", "term", "doc_id", "text_key").join(broadcast_if_small(pairs), ["entity", "term"]).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= SUPPORT)
    both = materialise(both, "joint")
    n_docs = docs.count()
    df_e = base.select("doc_id", "text_key", F.explode(F.array_distinct(F.col("base.entity"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= SUPPORT)
    known = broadcast_if_small(materialise(both.select("term").distinct(), "terms"))
    words = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    words = docs.select(words.alias("w")).select(F.explode(F.concat("w", F.array_distinct(F.transform("w", class_of)))).alias("term"))
    # Counted before the join: partial counts are of a task's vocabulary, however many of its terms are known.
    df_t = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(known, "term")
    out = both.join(df_e, "entity").join(df_t, "term")
    n = F.lit(float(n_docs))
    pmi = F.log2(n * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    content = F.log2(n / F.col("n_e"))
    out = out.withColumn("disclosure", F.when(content > 0, F.least(pmi / content, F.lit(1.0))).otherwise(F.lit(0.0)))
    out = materialise(out.select("entity", "term", "disclosure").where(F.col("disclosure") >= GENERALISE), "revealed")
    kinds = out.where(F.endswith("term", F.lit("*"))).select("entity", F.col("term").alias("kind"), F.lit(True).alias("open"))
    own = out.where(~F.endswith("term", F.lit("*"))).withColumn("kind", class_of(F.col("term")))
    return own.join(broadcast_if_small(kinds), ["entity", "kind"], "left").select("entity", "term", "disclosure", F.coalesce("open", F.lit(False)).alias("open"))


def class_of(term: Column) -> Column:
    return F.concat(F.left(term, F.lit(LETTERS)), F.lit("*"))


def _everywhere(src: DataFrame, some: DataFrame, reveal: DataFrame) -> DataFrame:
    """(doc_id, text_key, term, s, e, disclosure, open): the terms of reveal in the whole texts of the documents that hold the entity, but for those
    inside an entity."""
    held = some.select("doc_id", "text_key", "base", F.explode(F.array_distinct(F.col("base.entity"))).alias("entity")).join(reveal, "entity")
    held = materialise(held.groupBy("doc_id", "text_key", "term").agg(F.max("disclosure").alias("disclosure"), F.max("open").alias("open"), F.first("base").alias("base")), "held")
    keys = held.select(F.col("doc_id").alias("id"), F.col("text_key").alias("tk")).distinct()
    text = src.join(keys, src["doc_id"].eqNullSafe(keys["id"]) & (src["text_key"] == keys["tk"]), "left_semi").dropDuplicates(["doc_id", "text_key"])
    part = text.select("doc_id", "text_key", F.posexplode(located("text", TERM, F.lit(True))).alias("i", "z")).select("doc_id", "text_key", "i", F.col("z.m").alias("m"), F.char_length("z.gap").alias("gap"))
    so_far = Window.partitionBy("doc_id", "text_key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    word = part.withColumn("e", F.sum(F.col("gap") + F.coalesce(F.char_length("m"), F.lit(0))).over(so_far).cast("int")).where("m is not null")
    word = word.select("doc_id", "text_key", F.translate("m", UPPER, LOWER).alias("term"), (F.col("e") - F.char_length("m")).alias("s"), "e")
    both = word.join(held, same_row(word, held, "doc_id", "text_key", "term")).select(word.doc_id, word.text_key, word.term, "s", "e", "disclosure", "open", "base")
    return both.where(~F.exists("base", lambda x: (x["s"] <= F.col("s")) & (F.col("e") <= x["e"]))).drop("base")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text_key, base (see base_spans), terms, array<struct<s,k,e,kind,disclosure,put>>, by start, clean, the sanitised
    text (null where it is the text itself), and sha256, that of the text.

    A null text is empty. Repeated rows (equal id and text) get equal results; rows that share an id but not the text are told apart by
    a hash of the text. Terms are learned near entities and marked in the whole of the documents that hold the entity which they reveal, so a document without entities
    keeps its whole text.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    # The texts of documents with entities go along, so that they are rewritten without a join of all texts.
    base = base_spans(src.withColumn("body", F.col("text")).withColumn("sha256", F.sha2("text", 256)))
    base = materialise(base.withColumn("body", F.when(F.size("base") > 0, F.col("body"))), "spans")
    some = base.where(F.size("base") > 0)
    terms = materialise(_terms(some), "near")
    reveal = broadcast_if_small(materialise(disclosures(src, some, terms), "disclosures"))
    near = terms.join(reveal, ["entity", "term"]).select("doc_id", "text_key", "term", "s", "e", "disclosure", "open")
    hit = near.unionByName(_everywhere(src, some, reveal)).groupBy("doc_id", "text_key", "s", "e").agg(F.max("disclosure").alias("disclosure"), F.max("open").alias("open"), F.min("term").alias("term"))
    put = F.when(F.col("disclosure") >= REMOVE, "").when(F.col("open"), "[TERM]").otherwise(F.concat(F.lit("["), class_of(F.col("term")), F.lit("]")))
    one = F.struct(F.col("s"), F.lit(len(KINDS)).alias("k"), F.col("e"), F.lit("term").alias("kind"), F.col("disclosure"), put.alias("put"))
    hit = hit.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(one)).alias("terms"))
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string,disclosure:double,put:string>>")
    out = base.join(hit, same_row(base, hit, "doc_id", "text_key"), "left").select(base.doc_id, base.text_key, "base", F.coalesce("terms", none).alias("terms"), "body", "sha256")
    return out.withColumn("clean", F.when(F.size("base") > 0, rewritten("body", "base", "terms"))).drop("body")


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def rewritten(text: str, base: str, terms: str) -> Column:
    """The text with entities as [KIND], terms beyond REMOVE left out, other found terms as their class, [ab*], or [TERM] if that discloses
    the entity as well. Overlapping spans are one: the first by start, then kind, names it."""
    mark = F.concat(
        F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("put"))),
        F.transform(terms, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["put"].alias("put"))),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        more = F.array(F.substring(F.col(text), a["at"] + 1, x["s"] - a["at"]), x["put"])
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], F.concat(a["out"], more)).otherwise(a["out"]).alias("out"))

    return F.aggregate(F.array_sort(mark), start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), a["at"] + 1, F.char_length(text))))


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text rewritten as find_pii found (clean); other rows keep theirs, null ones too."""
    d = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    f = found.where("clean is not null").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__tk"), F.col("clean").alias("__clean")).dropDuplicates(["__id", "__tk"])
    j = d.join(f, d[id_col].eqNullSafe(f["__id"]) & (d["__key"] == f["__tk"]), "left")
    return j.withColumn(text_col, F.coalesce("__clean", text_col)).select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    count = [_count(kind) for kind, _, _ in KINDS]
    light = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    more = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    every = F.array_sort(F.concat(light, more))
    return out.select("doc_id", *count, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(every).alias("spans"), F.size("terms").cast("long").alias("n_terms"), F.size(F.filter("terms", lambda x: x["put"] == "")).cast("long").alias("n_removed"), F.coalesce(F.sha2("clean", 256), "sha256").alias("clean_sha256"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
