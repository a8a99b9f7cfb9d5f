"""PII, line dedup, mixing and decontamination against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from claimweave.llm import decontaminate, line_dedup, mixing, pii
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, docs, empty, low, rows, words


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, pat, _) in enumerate(pii.KINDS):
        for m in re.finditer(pat, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_base_spans(spark):
    tricky = [(20, "a@b.c_d@e.f a@b a@b.c.d- x@-.y"), (21, "1.2.3.4.5.6.7.8 00001.2.3.4 1.2.3 256.1.1.1"), (22, "+1-(2) 3.4 555 666 77 8+49 30 1234567 +"), (23, "4111 1111-11111111 3 4242424242424242" + "9" * 30), (24, "é" * 50 + " z@y.xx"), (25, "9" * 20000 + "." + "a" * 20000)]
    got = pii.find_pii(docs(spark, tricky)).collect()
    assert len(got) == len(rows()) + len(tricky)
    have = Counter((r.doc_id, tuple((b.s, b.k, b.e, b.kind) for b in r.base)) for r in got)
    assert have == Counter((r[0], tuple(base(r[1]))) for r in [*rows(), *tricky])
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_terms_that_disclose(spark):
    owner = [(100 + i, f"note {i} from zanzibarian desk ask boss@corp.org about item {i}") for i in range(6)]
    other = [(200 + i, f"note {i} from the desk about item {i} with nothing in it") for i in range(60)]
    d = spark.createDataFrame([(i, t) for i, t in owner + other], "doc_id long, text string")
    found = pii.find_pii(d)
    terms = {r.doc_id: [r2 for r2 in r.terms] for r in found.collect()}
    text = dict(owner + other)
    named = {i: {text[i][t.s : t.e] for t in ts} for i, ts in terms.items()}
    assert all("zanzibarian" in named[i] for i, _ in owner)
    assert all(not named[i] for i, _ in other)  # a document without entities keeps its whole text
    assert all("about" not in named[i] and "desk" not in named[i] for i, _ in owner)
    clean = {r.doc_id: r.text for r in pii.sanitised(d, found).collect()}
    assert all("boss@corp.org" not in clean[i] and "[EMAIL]" in clean[i] and "zanzibarian" not in clean[i] for i, _ in owner)
    assert all(clean[i] == t for i, t in other)


def test_pii_terms_far_from_their_entity(spark):
    owner = [(100 + i, f"note {i} from zanzibarian desk ask boss@corp.org about item {i} {'and so on ' * 20} é Zanzibarian {i}") for i in range(6)]
    other = [(200 + i, f"note {i} from the desk about item {i} and so on") for i in range(60)]
    d = spark.createDataFrame(owner + other, "doc_id long, text string")
    found = pii.find_pii(d)
    clean = {r.doc_id: r.text for r in pii.sanitised(d, found).collect()}
    assert all("zanzibarian" not in clean[i].lower() and "[EMAIL]" in clean[i] for i, _ in owner)
    text = dict(owner)
    terms = {r.doc_id: [text[r.doc_id][x.s : x.e] for x in r.terms] for r in found.collect() if r.doc_id < 200}
    assert all(x.count("zanzibarian") == 1 and x.count("Zanzibarian") == 1 and "boss" not in x for x in terms.values())


def test_pii_terms_are_generalised_to_a_class(spark):
    """A term below REMOVE becomes its class, if the class is common enough not to disclose the entity."""
    owner = [(100 + i, f"ask boss@corp.org or zanzibar{'' if i < 6 else 'i'} desk {i}") for i in range(8)] + [(120 + i, f"zanzibar is far {i}") for i in range(4)]
    other = [(200 + i, f"the zany desk writes of item {i} on its own") for i in range(40)] + [(300 + i, f"nothing of it {i}") for i in range(400)]
    d = spark.createDataFrame(owner + other, "doc_id long, text string")
    found = {x.doc_id: x for x in pii.find_pii(d).collect()}
    puts = {(owner_text[t.s : t.e], t.put) for i, owner_text in owner for t in found[i].terms}
    shares = {owner_text[t.s : t.e]: t.disclosure for i, owner_text in owner for t in found[i].terms}
    n, n_t, n_e, n_te = 452, 10, 8, 6
    share = math.log2(n * n_te / (n_t * n_e)) / math.log2(n / n_e)
    assert pii.GENERALISE <= share < pii.REMOVE and abs(shares["zanzibar"] - share) < 1e-9
    assert ("zanzibar", "[za*]") in puts
    assert "[EMAIL] or [za*] desk" in found[100].clean and found[300].clean is None
    assert found[120].terms == []


def test_line_dedup(spark):
    shared, rare = "  This Line is shared by many documents \t", "A line that only two documents have"
    more = [(30 + i, f"own {i}\n{shared if i % 2 else shared.upper()}\nshort\n{rare if i < 2 else ''}") for i in range(5)] + [(40, f"{shared}\n{shared}\n")]
    d = docs(spark, more)
    got = line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).collect()
    all_rows = [(r[0], r[1]) for r in rows()] + more
    at = defaultdict(set)
    for i, t in all_rows:
        for line in (t or "").split("\n"):
            key = low(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 20:
                at[key].add(i)
    want = Counter()
    for i, t in all_rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(at[k := low(x.strip(" \t\n\x0b\x0c\r"))]) >= 3 and i != max((j for j in at[k] if j is not None), default=None))]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == want
    assert line_dedup.keep_bitmaps(empty(spark)).count() == 0


def test_line_dedup_streams_sorted_runs(spark):
    """The ranges are sorted once, by line, document and position, and the window takes them as they are."""
    d = docs(spark)
    plans = []
    keep = line_dedup.materialise
    line_dedup.materialise = lambda df, tag: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), keep(df, tag))[1]
    try:
        line_dedup.keep_bitmaps(d).count()
    finally:
        line_dedup.materialise = keep
    plan = next(p for tag, p in plans if tag == "often")
    before = plan[plan.index("Window") : plan.index("rangepartitioning")]
    assert before.count("Sort [") == 1 and "Exchange hashpartitioning" not in before and "pos#" in before


def test_poisson_inverse_and_shares(spark):
    r = spark.range(2000).select((F.col("id") / 2000 + 0.00025).alias("u"), F.lit(3.7).alias("rate")).select("u", mixing.poisson_inverse(F.col("u"), mixing.poisson_table(F.col("rate"))).alias("k")).collect()
    for x in r:
        cdf = [0.0]
        for j in range(80):
            cdf.append(cdf[-1] + math.exp(-3.7) * 3.7**j / math.factorial(j))
        assert cdf[x.k] < x.u + 1e-12 and x.u <= cdf[x.k + 1] + 1e-12
    big = spark.range(300).select(mixing.poisson_count(mixing.poisson_table(F.lit(2000.0) / mixing.poisson_parts(F.lit(2000.0))), mixing.poisson_parts(F.lit(2000.0)), F.lit("s"), F.col("id").cast("string")).alias("k")).agg(F.avg("k"), F.stddev("k")).first()
    assert abs(big[0] - 2000) < 15 and 35 < big[1] < 55
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    out = mixing.mix(d, mixing.source_rates(d, {"small": 1.0, "large": 1.0}))
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] - 3000) < 350 and abs(n["large"] - 3000) < 350
    assert out.columns[:3] == ["doc_id", "text", "source"]


def test_mixing_edges(spark):
    d = docs(spark)
    out = mixing.mix(d, mixing.source_rates(d))
    again = mixing.mix(d, mixing.source_rates(d))
    key = lambda o: sorted(map(str, o.select("doc_id", "copy_no", "n_copies").collect()))
    assert key(out) == key(again)
    order = [r.shuffle_key for r in out.collect()]
    assert order == sorted(order)
    assert mixing.mix(empty(spark), mixing.source_rates(empty(spark))).count() == 0
    none = mixing.mix(d, mixing.source_rates(d, {"a": 1.0}))
    assert {r.source for r in none.collect()} <= {"a"}


def hits(docs_, items):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(8, len(w))
        for p in range(len(w) - m + 1) if m else ():
            wins[tuple(w[p : p + m])].add(str(i))
    out = Counter()
    for i, t in docs_:
        w, hit, found = words(t), set(), set()
        for m in {len(k) for k in wins}:
            for p in range(len(w) - m + 1):
                if ids := wins.get(tuple(w[p : p + m])):
                    hit |= set(range(p, p + m))
                    found |= ids
        out[i, len(w), len(hit), tuple(sorted(found))] += 1
    return out


def test_decontamination(spark):
    items = [(1, "One two three four FIVE six seven eight nine ten"), (2, "tiny item"), (3, None), (4, "..."), (5, "One two three four five six seven eight nine ten"), (10, LONG[2000:2400]), (11, "日本語"), (11, "日本語"), (12, "a b c d e")]
    more = [(50, "x tiny, item y"), (51, "one two three four five six seven eight zero one two three four five six seven eight nine"), (52, "two three four five six seven eight"), (53, "a b c d e"), (54, "a b c d a b c d e")]
    d, b = docs(spark, more), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.benchmark_hits(d, b).collect())
    assert got == hits([(r[0], r[1]) for r in rows()] + more, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_hits(d, none).where("n_hit > 0").count() == 0
    assert decontaminate.benchmark_hits(empty(spark), b).count() == 0
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns
    dirty = {k[0] for k in got if k[3]}
    assert {r.doc_id for r in kept.collect()} == {k[0] for k in got if not k[3]} and dirty
