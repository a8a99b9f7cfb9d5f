"""License scans, HTML, language, media, near copies and sharding."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
from claimweave.llm import html_text, language, licenses, media, mixing, near_dup, sharding
from claimweave.llm.common import materialise
from pyspark.sql import functions as F

from tests.llm.helpers import docs, empty, rows, words


def test_license_base_and_rules(spark):
    more = [(30, "CC-BY cc by GENERAL public License all rights, reserved all all rights reserved"), (31, "Released under the GNU General Public License, version 3 or later."), (32, "mit dem Auto"), (33, "SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0 (the License)")]
    got = licenses.scan_licenses(docs(spark, more)).collect()
    want = Counter()
    for i, t in [(r[0], r[1]) for r in rows()] + more:
        w = words(t)
        places = [(p, label) for phrase, label in licenses.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        want[i, len(w), tuple(sorted(places))] += 1
    assert Counter((r.doc_id, r.n_words, tuple(sorted((h["first"], h["label"]) for h in r.base_hits))) for r in got) == want
    labels = {r.doc_id: {h["label"] for h in r.detections} for r in got}
    assert "gpl-3.0-or-later" in labels[31] and not labels[32] and "apache-2.0" in labels[33] and "apache" not in labels[33]
    assert licenses.scan_licenses(empty(spark)).count() == 0
    assert len(licenses.rules()[0]) > 300


def test_license_suppression():
    n, base, found = licenses.scan("x licensed under the GNU General Public License version 2 or any later y")
    spans = [(a, b, label) for a, b, label, _ in found]
    assert not any(o != s and o[0] <= s[0] and s[1] <= o[1] and o[2] != s[2] and o[2] == "gpl-2.0-or-later" and s[2].startswith("gpl") for o in spans for s in spans)
    assert any(s[2] == "gpl-2.0-or-later" for s in spans) and base == [(5, "gpl")] and n == 14


def test_html_blocks(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>One&nbsp; two<br>three <b>four<p>Five<script>var x = "<p>no</p>";</script>
<ul><li>six<li>seven</ul><aside>side</aside><form><input value="x">ask</form><div class=ad>buy</div><!-- c --><blockquote>eight</blockquote>
<section class="comments"><p>nice</p></section></article><footer>foot</footer>"""
    assert html_text.extract(page) == "Title & more\nOne two three four\nFive\nsix\nseven\neight"
    assert html_text.extract(None) == "" and html_text.extract("") == "" and html_text.extract("plain  text") == "plain text"
    assert html_text.extract("<p>a < b &lt; c &#233;") == "a < b < c é"
    assert html_text.extract("<div id='x' class='a>b'>in</div>") == "in"
    assert html_text.extract("<p" * 5000).count("\n") == 0
    deep = "<div>" * 20000 + "x"
    assert html_text.extract(deep) == "x"


def test_html_site_templates(spark):
    banner = "<div><p>Best shop in town</p></div>"
    pages = [(i, f"http://a.org/{i}", f"<body>{banner}<div><p>story {i} goes here</p></div></body>") for i in range(6)]
    pages += [(10 + i, f"http://b{i}.org/", f"<body>{banner}<p>other {i}</p></body>") for i in range(3)] + [(20, None, "<p>x</p>"), (21, "http://a.org/", None), (21, "http://a.org/", None)]
    d = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    text = defaultdict(list)
    for r in html_text.extract_pages(d).collect():
        text[r.page_id].append(r.main_text)
    assert all(text[i] == [f"story {i} goes here"] for i in range(6))
    assert all(text[10 + i] == [f"Best shop in town\nother {i}"] for i in range(3)) and text[20] == ["x"] and text[21] == ["", ""]
    assert html_text.extract_pages(d.limit(0)).count() == 0


def test_html_article_is_never_cut():
    art = "<article><h1>T</h1><p>body</p></article>"
    for page in (f'<div class="layout has-sidebar">{art}</div>', f'<form id="aspnetForm">{art}</form>', f'<div class="sidebar">{art}</div>', art.replace("<article", '<article class="post no-comments"'), art.replace("<h1>T</h1>", "<header><h1>T</h1></header>")):
        assert html_text.extract(page) == "T\nbody", page
    assert html_text.extract(f'<aside><article>card</article></aside>{art}<section class="comments"><article>me too</article></section>') == "T\nbody"
    assert html_text.extract('<body><form id="f"><p>all of this page is one form</p><input></form><footer>x</footer>') == "all of this page is one form"
    assert html_text.extract("<p title=it's>one</p><p>it's two</p>") == "one\nit's two"
    assert html_text.extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert html_text.extract("<![CDATA[x < y]]> z<!--> q") == "x < y z q" and html_text.extract("a <!-- b > c") == "a"


def test_html_hostile_pages_take_linear_time():
    n = 40_000
    hostile = ["<a \"" * n, "<a x=\"" * n, "<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<ul>" + "<div>" * n + "<li></li>" * n, "<article>" * n + "x", "<p>" * n, "<!--" * n, "<" * n, "<tr><td>" * n, "&" * n]
    for page in hostile:
        start = time.process_time()
        html_text.extracted(page + "x", {1})
        assert time.process_time() - start < 8, page[:20]


def test_html_templates_against_brute_force(spark):
    """No class or tag tells what is template: only its recurrence over pages of the host does."""
    r = random.Random(5)

    def box(x):
        return f"<div><section>{x}</section></div>"

    pages = []
    for i in range(60):
        host = "abc"[i % 3] if i % 7 else "big"
        parts = [box(f"story {i}-{k} of <b>{r.random()}</b>") for k in range(3)] + [box(f"{host} part {r.randrange(9)}") for _ in range(3)] + [box("everywhere")] * (i % 2)
        r.shuffle(parts)
        pages.append((i, f"https://{host}.org/{i}", "<html><body class='x'>" + "".join(parts) + "</body></html>"))
    pages += [(70 + k, f"https://a.org/m{k}", pages[0][2]) for k in range(4)] + [(80, "https://big.org/e", ""), (81, "https://big.org/n", None), (82, "https://big.org/0", pages[7][2])]
    on = defaultdict(set)
    for _, url, page in pages:
        for x in set(re.findall(r"<section>.*?</section>", page or "")):
            on[url.split("/")[2], x].add(page)

    def brute(url, page):
        kept = [x for x in re.findall(r"<section>(.*?)</section>", page or "") if len(on[url.split("/")[2], f"<section>{x}</section>"]) < html_text.MIN_PAGES]
        return "\n".join(re.sub("<.*?>", "", x) for x in kept)

    got = {x.page_id: x for x in html_text.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages) and all(got[i].main_text == brute(url, page) for i, url, page in pages)
    assert sum(x.n_template for x in got.values()) > 60
    # a host's size doesn't decide: the same boxes are template among any number of other pages
    assert all("everywhere" not in x.main_text for x in got.values())


SOUNDS = {"aa": ["ka", "mo", "ri", "tu"], "bb": ["sche", "ung", "ein", "ver"], "cc": ["ción", "ado", "que", "ñe"]}


def speech(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language(spark):
    plain = [(i, speech(lang := sorted(SOUNDS)[i % 3], 5 + i % 60, i), lang) for i in range(240)]
    d = spark.createDataFrame([(i, t, g, "clash", 1.0) for i, t, g in plain], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.learn(language.training(d))
    out = language.predict(d.withColumn("held", language.held_out()), model).where("held").collect()
    assert len(out) > 30 and np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    mixed = spark.createDataFrame([(1, speech("aa", 120, 1) + " " + speech("bb", 40, 2)), (2, None), (3, "12 ..."), (4, ""), (5, speech("cc", 3, 5)), (5, speech("cc", 3, 5))], "doc_id long, text string")
    got = {r.doc_id: r for r in language.predict(mixed, model).collect()}
    assert got[1].lang_pred == "aa" and 0.55 < got[1].lang_score < 0.9 and set(x.split(":")[0] for x in got[1].lang_set.split(",")) == {"aa", "bb"}
    assert [got[i].lang_pred for i in (2, 3, 4, 5)] == ["und", "und", "und", "cc"] and got[2].lang_score == 0
    assert language.predict(empty(spark), model).count() == 0
    assert language.predict(mixed, language.learn(empty(spark))).where("lang_pred <> 'und'").count() == 0
    assert language.accepted(docs(spark)).columns == docs(spark).columns


def test_language_long_text_in_blocks():
    logp = np.zeros((language.GRAMS, 2), np.float32)
    a = np.frombuffer(b"abc " * 300_000, np.uint8)
    g = language.trigrams(a[:8])
    logp[g, 0] = 1.0
    logp[0] = 0
    p, _ = language.mixtures(a, np.array([0, len(a)]), logp)
    assert p[0].argmax() == 0 and p[0, 0] > 0.99


def test_media_round_trip(spark):
    r = random.Random(1)
    body = "".join(r.choice("abcdefgh \n") for _ in range(90_000))
    more = [(60, body), (61, body[:40_000] + "EDIT" + body[40_000:]), (62, body), (63, "x" * 64), (64, "é" * 70_000)]
    got = media.media_features(docs(spark, more)).collect()
    assert len(got) == len(rows()) + len(more)
    for x in got:
        pass
    by_text = defaultdict(set)
    texts = defaultdict(list)
    for i, t in [(q[0], q[1]) for q in rows()] + more:
        texts[i].append(t)
    for x in got:
        assert any(_expected(t) == (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for t in texts[x.doc_id])
        by_text[x.payload_sha256].add((x.media_sha256, x.feature, x.media_bytes))
    assert all(len(v) == 1 for v in by_text.values())
    d = docs(spark, more)
    lists = media.chunk_lists(d).collect()
    shared = Counter(c.digest for c in lists)
    edited = [c.digest for c in lists if sum(shared[c.digest] > 1 for _ in (0,))]
    assert len(edited) > 10  # most chunks of the edited copy are those of the original
    assert media.media_features(empty(spark)).count() == 0


def _expected(t):
    b = (t or "").encode()
    n = len(b)
    b += bytes(64 if not b else -len(b) % 64)
    return n, len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-64:])


def test_gear_hash_by_definition():
    data = np.random.default_rng(3).integers(0, 256, 500, np.uint8)
    fast = media.gear_hashes(data)
    for i in (0, 5, 31, 32, 200, 499):
        want = 0
        for j in range(max(0, i - media.WINDOW + 1), i + 1):
            want = (want + (int(media.GEAR[data[j]]) << (i - j))) & 0xFFFFFFFF
        assert fast[i] == want
    whole = np.random.default_rng(4).integers(0, 256, 300_000, np.uint8)
    assert media.cuts(whole) == media.cuts(whole, 10_000)
    sizes = np.diff([0, *media.cuts(whole)])
    assert sizes.sum() == len(whole) and sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST


def near_classes(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 300))]
        texts.append(" ".join(base))
        for _ in range(k % 4):
            own = list(base)
            for _ in range(r.choice([0, 1, max(1, len(own) // 60), len(own) // 8])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(own).title())
    texts += [None, "", "...", "one two", "One, two!", "two one"]
    r.shuffle(texts)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, node int, text_key string")
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(d).collect()}
    want = near_classes(texts)
    assert [got[i] for i in range(len(texts))] == want
    kept = near_dup.drop_near_duplicates(d)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want)) and kept.columns == d.columns
    recall, n = near_dup.audit(d, 40)
    assert recall > 0.95 and n > 40


def test_near_duplicates_edges(spark):
    d = docs(spark)
    out = near_dup.near_duplicates(d).collect()
    assert len(out) == len(rows())
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    kept = near_dup.drop_near_duplicates(d).collect()
    assert Counter(x.doc_id for x in kept)[7] == 0 and Counter(x.doc_id for x in kept)[6] == 1
    again = d.unionByName(d)
    assert near_dup.drop_near_duplicates(again).count() == len(kept)


def test_hot_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(2600):
        own = list(base)
        own[r.randrange(120)] = f"x{i}"
        texts.append(" ".join(own))
    texts += [" ".join(f"y{r.randrange(5000)}" for _ in range(100)) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dup.near_duplicates(d).groupBy("class_id").count().orderBy(F.desc("count")).collect()
    assert got[0]["count"] == 2600 and len(got) == 201


def passage_pairs(n, pairs, swaps, seed):
    """n documents of which 235 of 290 words are one passage, and edited copies of the first ones, which have a similarity of 0.8 to 0.9."""
    r = random.Random(seed)
    passage = [f"p{r.randrange(900)}" for _ in range(235)]
    own = [[f"d{k}x{j}" for j in range(55)] for k in range(n)]
    texts = [" ".join(passage + o) for o in own]
    for k in range(pairs):
        texts.append(" ".join(passage + own[k][:-swaps] + [f"c{k}x{j}" for j in range(swaps)]))
    return texts


def assert_pairs_found(spark, n, pairs, swaps, seed):
    texts = passage_pairs(n, pairs, swaps, seed)
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in (texts[0], texts[1], texts[n])]
    assert len(sets[0] & sets[1]) < 0.75 * len(sets[0] | sets[1]) and len(sets[0] & sets[2]) >= 0.8 * len(sets[0] | sets[2])
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(d).collect()}
    assert sum(got[n + k] == got[k] for k in range(pairs)) == pairs
    assert all(got[k] == k for k in range(n))


def test_pairs_among_many_that_are_alike(spark):
    assert_pairs_found(spark, 700, 100, 25, 3)


def test_pairs_in_a_hot_group(spark):
    assert_pairs_found(spark, 2600, 60, 20, 6)


def test_hot_passages_against_brute_force(spark, monkeypatch):
    """Documents that share a passage of 75 words, below 0.8 with one another, and copies of some of them with one or two words changed: the
    classes are those of all pairs. The hot groups are compared by their other shingles alone: no document has too few of them."""
    monkeypatch.setattr(near_dup, "SHARD", 64)
    r = random.Random(12)
    own = lambda k: [f"w{r.randrange(40_000)}" for _ in range(k)]
    passage, base = own(75), [own(29 + i % 7) for i in range(420)]
    texts = [passage + b for b in base]
    for j in range(90):
        copy = list(base[r.randrange(420)])
        copy[-5] = f"new{j}"
        if j % 2:
            copy[-15] = f"old{j}"
        texts.append(passage + copy)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)], links = min(a, b), links + 1
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = []
    blocks = near_dup._blocks
    monkeypatch.setattr(near_dup, "_blocks", lambda *a: (seen.append(b := blocks(*a)), b)[1])
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(d).collect()}
    assert links >= 90 and got == {i: root(i) for i in range(len(texts))}
    assert seen and seen[0].count() == 0


def test_versions_in_many_copies():
    g = np.random.default_rng(8)

    def flipped(sig, bits):
        out = sig.copy()
        for k in g.choice(128, bits, False):
            out[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
        return out

    first = g.integers(0, 2**63, 2, np.uint64)
    second = flipped(first, 18)
    sigs = np.stack([flipped(v, 5) for v in (first, second) for _ in range(100)] + [g.integers(0, 2**63, 2, np.uint64) for _ in range(300)])
    pairs, rest = near_dup.candidates(sigs)
    across = (pairs < 100).any(1) & ((pairs >= 100) & (pairs < 200)).any(1)
    assert across.sum() >= 100 and set(rest) == set(range(200))


def test_shared_shingles():
    g = np.random.default_rng(4)
    sets = [np.unique(g.integers(0, 60 if k % 2 else 4000, 40).astype(np.uint64)) for k in range(120)]
    got = near_dup.shared(sets[:50], sets)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:50]]).all()


def test_small_world_recall():
    g = np.random.default_rng(2)
    base = g.integers(0, 2**63, (300, 2), np.uint64)
    sigs = np.concatenate([base, base ^ (np.uint64(1) << g.integers(0, 63, (300, 2), np.uint64)), base ^ (np.uint64(7) << g.integers(0, 60, (300, 2), np.uint64))])
    ids, d = near_dup.SmallWorld(sigs).search(sigs, 32)
    exact = near_dup.distance(sigs[:, None], sigs[None])
    want = exact <= near_dup.RADIUS
    found = sum(len(set(ids[i][d[i] <= near_dup.RADIUS]) & set(np.flatnonzero(want[i]))) for i in range(len(sigs)))
    assert found >= 0.98 * want.sum()


def test_simhash_by_definition():
    s = np.random.default_rng(1).integers(0, 2**63, 700, np.uint64)
    first = np.array([0, 1, 300, 700])
    got = near_dup.simhash(s, first)
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        for half in range(2):
            x = near_dup.mixed(s[a:b] ^ near_dup._SEEDS[half])
            want = sum(1 << i for i in range(64) if 2 * sum(int(v) >> i & 1 for v in x) > b - a)
            assert int(got[k, half]) == want


def test_sharding(spark):
    big = [(100 + i, "a copied text of some length " * 3) for i in range(400)]
    other = [(1000 + i, f"text {i} " * (1 + i % 40)) for i in range(900)]
    d = materialise(docs(spark, big + other).where("doc_id is null or doc_id <> 9"), "t")
    out = sharding.shard(d, 8).collect()
    assert len(out) == d.count()
    slots = defaultdict(list)
    size = Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(8))
    mean = sum(size.values()) / 8
    assert max(abs(v - mean) for v in size.values()) < 0.01 * mean
    by_id = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id >= 100}
    assert all(by_id[i].size == len(t.encode()) + 8 and by_id[i].text_crc32 == zlib.crc32(t.encode()) for i, t in big + other)
    none = next(r for r in out if r.doc_id == 2)
    assert none.size == 8 and none.text_crc32 == 0
    assert sharding.shard(empty(spark), 8).count() == 0


def test_pack_is_joint():
    items = np.random.default_rng(0).lognormal(0, 1, (3000, 3))
    where = sharding.pack(items, 24)
    load = np.array([items[where == k].sum(0) for k in range(24)])
    assert (np.abs(load / load.mean(0) - 1).max(0) < [0.001, 0.05, 0.05]).all()
    assert len(sharding.pack(np.zeros((0, 3)), 4)) == 0


def _by_hand(items, n_shards):
    """The packing by hand: largest first, each where the dot product with what is free is highest, first among those with bytes left."""
    total = [sum(x[d] for x in items) or 1e-12 for d in range(3)]
    size = [[x[d] / total[d] * n_shards for d in range(3)] for x in items]
    free, where = [[1.0] * 3 for _ in range(n_shards)], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(size[i]), i)):
        fits = [k for k in range(n_shards) if free[k][0] >= size[i][0] - 1e-12]
        k = max(fits, key=lambda k: (sum(f * s for f, s in zip(free[k], size[i], strict=True)), -k)) if fits else max(range(n_shards), key=lambda k: (free[k][0], -k))
        where[i] = k
        free[k] = [f - s for f, s in zip(free[k], size[i], strict=True)]
    return where


def test_sharding_packs_as_by_hand():
    r = random.Random(3)
    items = [(r.randrange(1, 1 << 20) << 8, r.randrange(1, 1 << 12) << 8, r.randrange(1, 8) << 8) for _ in range(61)]
    moved = sum(a != b for a, b in zip(sharding.pack(np.array(items, float), 4), _by_hand(items, 4), strict=True))
    assert moved <= 6  # those that the last step moves between the fullest and the emptiest shard
    assert not len(sharding.pack(np.zeros((0, 3)), 4))


def test_sharding_groups_stay_together_in_any_layout(spark):
    r = random.Random(4)
    data = [(i, f"copied text {i % 37} " * (1 + i % 37)) for i in range(600)] + [(1000 + i, f"own text {i} {r.random()} " * r.randrange(1, 30)) for i in range(800)]
    d = docs(spark, data)
    one, two = (sharding.shard(x, 8).toPandas().sort_values(["doc_id", "text_crc32", "slot"]).reset_index(drop=True) for x in (d.coalesce(1), d.repartition(7, F.rand(1))))
    assert one.equals(two)
    assert (one[one.text_crc32 != 0].groupby("text_crc32").shard.nunique() == 1).all()
    # a group of over a shard is split, by doc_id alone
    big = spark.createDataFrame([(i, "the same text in each") for i in range(4000)] + [(9000 + i, f"other {i}") for i in range(200)], "doc_id long, text string")
    got = sharding.shard(big, 8).toPandas()
    assert got[got.doc_id < 4000].shard.nunique() > 4 and got.groupby("shard")["size"].sum().max() < 1.25 * got["size"].sum() / 8


def test_sharding_very_long_rows(spark):
    out = {x.doc_id: x for x in sharding.shard(spark.createDataFrame([(1, "x" * 3_000_000), (2, "b"), (3, None), (4, "")], "doc_id long, text string"), 3).collect()}
    assert out[1].size == 3_000_008 and out[1].shard not in {out[i].shard for i in (2, 3, 4)}


def test_stages_keep_columns_of_clashing_names(spark):
    """Columns with names that an operator gives to its own keep the input's values."""
    d = spark.createDataFrame([(i, speech("aa", 30, i), "aa", f"p{i}", 0.5 + i, f"s{i}", f"r{i}", 100 + i, 200 + i) for i in range(40)] + [(90, None, None, "p", 1.0, "s", "r", 1, 2), (91, "12 ...", "aa", "p", 1.0, "s", "r", 1, 2)], "doc_id long, text string, lang string, lang_pred string, lang_score double, source string, rate string, n_copies long, shuffle_key long")
    kept = {x.doc_id: x for x in language.accepted(d).collect()}
    assert set(kept) == set(range(40)) and all((x.lang_pred, x.lang_score, x.rate) == (f"p{i}", 0.5 + i, f"r{i}") for i, x in kept.items())
    out = mixing.drawn(d, mixing.source_rates(d))
    assert out.columns[: len(d.columns)] == d.columns and all(x.rate == f"r{x.doc_id}" and x.n_copies == 100 + x.doc_id and x.shuffle_key == 200 + x.doc_id for x in out.where("doc_id < 40").collect())
    assert language.accepted(d.limit(0)).count() == 0


def test_mixtures_of_many_languages_are_told_and_kept(spark):
    """Six languages in equal parts: no limit ends the set, and the pipeline's stage keeps the text."""
    sounds = {chr(97 + k) * 2: [f"{a}{b}" for a in "bdfgklmnprst"[2 * k : 2 * k + 2] for b in ("a", "e", "i", "o")] for k in range(6)}
    r = random.Random(3)
    say = lambda lang, n: " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    d = spark.createDataFrame([(i, say(lang := sorted(sounds)[i % 6], 60), lang) for i in range(240)] + [(999, " ".join(say(lang, 150) for lang in sorted(sounds)), None)], "doc_id long, text string, lang string")
    model = language.learn(language.training(d))
    mixed = language.predict(d.where("doc_id = 999"), model).first()
    shares = dict(x.split(":") for x in mixed.lang_set.split(","))
    assert set(shares) == set(sounds) and all(abs(float(v) - 1 / 6) < 0.06 for v in shares.values())
    assert language.accepted(d).where("doc_id = 999").count() == 1
