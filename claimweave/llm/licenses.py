"""License scans (2): ordered signature rules. Hand-written patterns over the words of a text, gated by a keyword automaton; a rule of
higher priority suppresses the detections that lie within its own."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from claimweave.llm.common import table
from claimweave.session import ship

#: Phrases that always count, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
WORDS = {label: len(phrase.split()) for phrase, label in PHRASES}

#: label | keyword that must occur | further patterns of names and notices, over lower-case words with one space between.
#: `v` before a number stands for an optional "version", "v" or "ver"; # for an optional "the". The SPDX tag and the URL have rules of their own.
NAMES = r"""
mit|mit license|mit license;#mit license(?: mit)?;licensed under #mit;released under #mit
mit|permission is hereby granted free of charge|permission is hereby granted free of charge to any person obtaining a copy
mit|without restriction including|without restriction including without limitation the rights to use copy modify merge publish
mit|expat|expat license;#expat mit
mit-0|mit 0|mit no attribution;mit 0
apache-2.0|apache|apache license v2(?: 0)?;apache 2 0 license;apache software license v2(?: 0)?;asl 2 0;apache license version 2 0 january 2004
apache-2.0|you may not use this file except in compliance|you may not use this file except in compliance with the license
apache-1.1|apache|apache software license v1 1;apache license v1 1
apache-1.0|apache|apache license v1 0;apache software license v1 0
apache|apache|apache license;apache software license
bsd-2-clause|bsd|bsd 2 clause;2 clause bsd;simplified bsd license;freebsd license;two clause bsd
bsd-3-clause|bsd|bsd 3 clause;3 clause bsd;new bsd license;modified bsd license;revised bsd license;three clause bsd
bsd-4-clause|bsd|bsd 4 clause;4 clause bsd;original bsd license;four clause bsd
bsd-3-clause|endorse or promote products|may be used to endorse or promote products derived from this software
bsd-2-clause|redistribution and use in source|redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause|all advertising materials mentioning|all advertising materials mentioning features or use of this software must display
bsd|bsd|bsd licen[sc]ed?;bsd style license;berkeley software distribution license
0bsd|0bsd|0bsd;zero clause bsd
gpl-3.0-or-later|general public license|general public license v3(?: 0)? or (?:at your option )?(?:any )?later
gpl-3.0-or-later|either version 3|either version 3 of the license or at your option any later version
gpl-2.0-or-later|general public license|general public license v2(?: 0)? or (?:at your option )?(?:any )?later
gpl-2.0-or-later|either version 2|either version 2 of the license or at your option any later version
gpl-3.0|general public license|(?:gnu )?general public license v3(?: 0)?;general public license as published by the free software foundation v3
gpl-2.0|general public license|(?:gnu )?general public license v2(?: 0)?;general public license as published by the free software foundation v2
gpl-1.0|general public license|(?:gnu )?general public license v1(?: 0)?
gpl-3.0|gpl|gplv3;gpl v3(?: 0)?;gnu gpl 3
gpl-2.0|gpl|gplv2;gpl v2(?: 0)?;gnu gpl 2
gpl|gpl|gnu gpl;gpl licen[sc]ed?;#gpl license;under #gpl
gpl|general public license|gnu general public license;general public license
agpl-3.0|affero|(?:gnu )?affero general public license v3(?: 0)?
agpl|affero|(?:gnu )?affero general public license;affero gpl
agpl-3.0|agpl|agplv3;agpl v3(?: 0)?;gnu agpl
lgpl-3.0|lesser general|(?:gnu )?lesser general public license v3(?: 0)?
lgpl-2.1|lesser general|(?:gnu )?lesser general public license v2 1
lgpl|lesser general|(?:gnu )?lesser general public license
lgpl-2.0|library general|(?:gnu )?library general public license(?: v2(?: 0)?)?
lgpl-3.0|lgpl|lgplv3;lgpl v3(?: 0)?
lgpl-2.1|lgpl|lgplv2 1;lgpl v2 1;lgpl 2 1
lgpl|lgpl|gnu lgpl;lgpl licen[sc]ed?;under #lgpl
gfdl-1.3|free documentation|(?:gnu )?free documentation license v1 3
gfdl-1.2|free documentation|(?:gnu )?free documentation license v1 2
gfdl|free documentation|(?:gnu )?free documentation license
mpl-2.0|mozilla public|mozilla public license v2(?: 0)?
mpl-1.1|mozilla public|mozilla public license v1 1
mpl-1.0|mozilla public|mozilla public license v1 0
mpl|mozilla public|mozilla public license
mpl-2.0|subject to the terms of the mozilla|this source code form is subject to the terms of the mozilla public license
epl-2.0|eclipse public|eclipse public license v2(?: 0)?
epl-1.0|eclipse public|eclipse public license v1(?: 0)?
epl|eclipse public|eclipse public license
edl-1.0|eclipse distribution|eclipse distribution license(?: v1(?: 0)?)?
cpl-1.0|common public license|common public license(?: v1(?: 0)?)?
cddl-1.1|common development and distribution|common development and distribution license v1 1
cddl-1.0|common development and distribution|common development and distribution license(?: v1(?: 0)?)?
cddl|cddl|cddl(?: v?1 [01])?
eupl-1.2|european union public|european union public licen[cs]e v1 2
eupl-1.1|european union public|european union public licen[cs]e v1 1
eupl|european union public|european union public licen[cs]e
cecill-2.1|cecill|cecill(?: free software license agreement)? v?2 1
cecill-b|cecill|cecill b
cecill-c|cecill|cecill c
cecill|cecill|cecill
artistic-2.0|artistic license|artistic license v?2(?: 0)?
artistic-1.0|artistic license|artistic license(?: v?1(?: 0)?)?
perl|same terms as perl|(?:under )?the same terms as perl(?: itself)?
isc|isc license|isc license
isc|permission to use copy modify and|permission to use copy modify and or distribute this software for any purpose with or without fee
zlib|zlib|zlib license;zlib libpng license
zlib|warranty in no event will the authors|in no event will the authors be held liable for any damages arising from the use of this software
libpng|libpng|libpng license
bsl-1.0|boost software|boost software license(?: v1(?: 0)?)?
wtfpl|what the fuck|do what the fuck you want to public license
wtfpl|wtfpl|wtfpl
unlicense|unlicense|#unlicense
unlicense|free and unencumbered|this is free and unencumbered software released into the public domain
beerware|beer ware|beer ware license
x11|x11 license|x11 license
ntp|ntp license|ntp license
openssl|openssl license|openssl license
ssleay|ssleay|ssleay license
python-2.0|python software foundation|python software foundation license(?: v2)?;psf license
php-3.01|php license|php license v3 01
php-3.0|php license|php license(?: v3(?: 0)?)?
ruby|ruby license|ruby license
tcl|tcl tk|tcl tk license
vim|vim license|vim license
postgresql|postgresql|postgresql licen[cs]e
ofl-1.1|open font|(?:sil )?open font license(?: v1 1)?
upl-1.0|universal permissive|universal permissive license(?: v1(?: 0)?)?
afl-3.0|academic free|academic free license v3(?: 0)?
afl-2.1|academic free|academic free license v2 1
afl|academic free|academic free license
osl-3.0|open software license|open software license v3(?: 0)?
osl|open software license|open software license
ecl-2.0|educational community|educational community license(?: v2(?: 0)?)?
ncsa|illinois ncsa|university of illinois ncsa open source license
apsl-2.0|apple public source|apple public source license(?: v2(?: 0)?)?
ms-pl|microsoft public|microsoft public license
ms-rl|microsoft reciprocal|microsoft reciprocal license
ipl-1.0|ibm public|ibm public license(?: v1(?: 0)?)?
npl-1.1|netscape public|netscape public license(?: v1 1)?
qpl-1.0|q public|q public license(?: v1(?: 0)?)?
sleepycat|sleepycat|sleepycat license
spl-1.0|sun public|sun public license(?: v1(?: 0)?)?
sissl|sun industry standards|sun industry standards source license
w3c|w3c software|w3c software (?:notice and )?license
zpl-2.1|zope public|zope public license v2 1
zpl|zope public|zope public license
lppl-1.3c|latex project public|latex project public license v1 3c
lppl|latex project public|latex project public license
rpl-1.5|reciprocal public|reciprocal public license(?: v1 5)?
eudatagrid|eu datagrid|eu datagrid software license
nasa-1.3|nasa open source|nasa open source agreement(?: v1 3)?
cal-1.0|cryptographic autonomy|cryptographic autonomy license(?: v1(?: 0)?)?
mulanpsl-2.0|mulan|mulan permissive software license(?: v?2)?
blueoak-1.0.0|blue oak|blue oak model license(?: v?1 0 0)?
hpnd|historical permission notice|historical permission notice and disclaimer
icu|icu license|icu license
unicode|unicode license|unicode license;unicode inc license agreement
intel|intel open source|intel open source license
curl|curl license|curl license
json|used for good not evil|shall be used for good not evil
bittorrent|bittorrent open source|bittorrent open source license
sspl-1.0|server side public|server side public license(?: v1(?: 0)?)?
sspl-1.0|sspl|sspl(?: v1(?: 0)?)?
busl-1.1|business source|business source license(?: v?1 1)?
elastic-2.0|elastic license|elastic license(?: v?2(?: 0)?)?
commons-clause|commons clause|commons clause(?: license condition)?
confluent|confluent community|confluent community license(?: agreement)?
polyform|polyform|polyform (?:noncommercial|small business|shield|perimeter|strict) license
parity|parity public|parity public license
hippocratic|hippocratic|hippocratic license
rail|responsible ai license|(?:open )?responsible ai license;openrail(?: m)?
llama|llama|llama \d? ?(?:\d )?community license
odbl-1.0|open database|open database license(?: v1(?: 0)?)?
odc-by-1.0|open data commons attribution|open data commons attribution license
pddl-1.0|public domain dedication|public domain dedication and license
cdla-permissive|community data license|community data license agreement permissive(?: v?[12] 0)?
cdla-sharing|community data license|community data license agreement sharing(?: v?1 0)?
ogl-uk-3.0|open government|open government licen[cs]e(?: v?3(?: 0)?)?
cc0-1.0|cc0|cc0(?: 1 0)?(?: universal)?
cc0-1.0|creative commons zero|creative commons zero
cc-by-nc-nd|cc by|cc by nc nd(?: [1-4] \d)?
cc-by-nc-sa|cc by|cc by nc sa(?: [1-4] \d)?
cc-by-nc|cc by|cc by nc(?: [1-4] \d)?
cc-by-nd|cc by|cc by nd(?: [1-4] \d)?
cc-by-sa|cc by|cc by sa(?: [1-4] \d)?
cc-by-4.0|cc by|cc by 4 0
cc-by-3.0|cc by|cc by 3 0
cc-by-2.0|cc by|cc by 2 [05]
cc-by|cc by|cc by
cc-by-nc-nd|creative commons|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa|creative commons|creative commons attribution non ?commercial share ?alike
cc-by-nc|creative commons|creative commons attribution non ?commercial
cc-by-nd|creative commons|creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-sa|creative commons|creative commons attribution share ?alike
cc-by|creative commons|creative commons attribution
cc|creative commons|creative commons licen[cs]e
public-domain|public domain|(?:released|placed|dedicated) (?:in|into|to) #public domain;in #public domain
reserved|all rights reserved|all rights reserved
copyright|copyright|copyright c? ?(?:19|20)\d\d
proprietary|proprietary and confidential|proprietary and confidential
proprietary|unauthorized copying|unauthorized copying of this file
proprietary|end user license|end user license agreement
proprietary|without the prior written permission|without #prior written permission of
license-reference|license file|see #license file;found in #license file
license-reference|licensed under|licensed under the [a-z]+ license
license-reference|terms of the license|under the terms of the license
"""

#: Host and path words of license pages.
URLS = """
apache-2.0|apache org licenses license 2 0
mit|opensource org licenses? mit
bsd-3-clause|opensource org licenses? bsd 3 clause
bsd-2-clause|opensource org licenses? bsd 2 clause
isc|opensource org licenses? isc
gpl-3.0|gnu org licenses gpl 3 0
gpl-2.0|gnu org licenses (?:old licenses )?gpl 2 0
gpl|gnu org licenses gpl
agpl-3.0|gnu org licenses agpl
lgpl|gnu org licenses lgpl
gfdl|gnu org licenses fdl
mpl-2.0|mozilla org mpl 2 0
mpl|mozilla org mpl
epl-2.0|eclipse org legal epl 2 0
epl-1.0|eclipse org legal epl v10
bsl-1.0|boost org license 1 0
unlicense|unlicense org
ofl-1.1|scripts sil org ofl
wtfpl|wtfpl net
artistic-2.0|perlfoundation org artistic license 2 0
cc0-1.0|creativecommons org publicdomain zero
public-domain|creativecommons org publicdomain mark
cc-by-nc-nd|creativecommons org licenses by nc nd
cc-by-nc-sa|creativecommons org licenses by nc sa
cc-by-nc|creativecommons org licenses by nc
cc-by-nd|creativecommons org licenses by nd
cc-by-sa|creativecommons org licenses by sa
cc-by|creativecommons org licenses by
odbl-1.0|opendatacommons org licenses odbl
odc-by-1.0|opendatacommons org licenses by
"""


@lru_cache(1)
def rules() -> tuple[list[tuple[int, str, float, re.Pattern]], ahocorasick.Automaton]:
    """(priority, label, score, pattern) in order, and the automaton of keywords that maps to the rules they open."""
    out: list[tuple[int, str, float, str, str]] = []
    names = [x.split("|", 2) for x in NAMES.strip().splitlines()]
    for label in dict.fromkeys(x[0] for x in names):
        out.append((0, label, 1.0, "spdx license identifier", "spdx license identifier " + label.replace(".", " ").replace("-", " ") + "(?: only)?"))
    for x in URLS.strip().splitlines():
        label, pat = x.split("|")
        out.append((1, label, 0.95, re.split(r"[(?\[]", pat)[0].strip().rsplit(" ", 1)[0] if re.search(r"[(?\[]", pat) else pat, pat))
    for k, (label, key, pats) in enumerate(names):
        weak = label in ("copyright", "license-reference", "reserved", "public-domain", "proprietary")
        for pat in pats.split(";"):
            pat = re.sub(r"(?<![a-z])v(?=[?\d])\??", "(?:version |ver |v ?)?", pat).replace("#", "(?:the )?")
            long = len(pat) > 60 and not weak
            out.append((2 if long else 4 if weak else 3, label, 0.9 if long else 0.4 if weak else 0.8, key, pat))
    order = sorted(range(len(out)), key=lambda i: (out[i][0], i))
    made, auto, by_key = [], ahocorasick.Automaton(), {}
    for i in order:
        prio, label, score, key, pat = out[i]
        by_key.setdefault(key, []).append(len(made))
        made.append((prio, label, score, re.compile(f"(?<= ){pat}(?= )")))
    for key, own in by_key.items():
        auto.add_word(key, own)
    auto.make_automaton()
    return made, auto


def _word_numbers(norm: str, spots: set[int]) -> dict[int, int]:
    """The spaces of norm before each of the places, counted in one pass."""
    out, at, n = {}, 0, 0
    for spot in sorted(spots):
        n += norm.count(" ", at, spot)
        out[spot], at = n, spot
    return out


_SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Number of words, base places (first word, label), and detections (first word, end, label, score) by priority, none within another's words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    norm = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base = []
    for phrase, label in PHRASES:
        at = norm.find(f" {phrase} ")
        while at >= 0:
            base.append((at, label))
            at = norm.find(f" {phrase} ", at + 1)
    made, auto = rules()
    opened = sorted({r for _, own in auto.iter(norm) for r in own})
    found = []
    for r in opened:
        prio, label, score, pat = made[r]
        found += [(prio, r, m.start(), m.end(), label, score) for m in pat.finditer(norm)]
    reach = max((f[3] - f[2] for f in found), default=0) // 256 + 1
    kept: dict[int, list[tuple]] = {}  # by the 256 characters in which they start
    for f in sorted(found, key=lambda f: (f[0], f[2] - f[3], f[1], f[2])):
        at = f[2] // 256
        if not any(g[2] <= f[2] and f[3] <= g[3] for b in range(at - reach, at + 1) for g in kept.get(b, ())):
            kept.setdefault(at, []).append(f)
    hits = sorted((f for own in kept.values() for f in own), key=lambda f: (f[2], f[3]))
    number = _word_numbers(norm, {at for at, _ in base} | {s - 1 for _, _, s, _, _, _ in hits} | {e for _, _, _, e, _, _ in hits})
    return len(words), sorted((number[at], label) for at, label in base), [(number[s - 1], number[e], label, score) for _, _, s, e, label, score in hits]


FOUND = ArrayType(StructType([StructField("first", LongType()), StructField("last", LongType()), StructField("label", StringType()), StructField("score", DoubleType())]))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, base_hits (places of the fixed phrases) and detections (of the rules), in order of place.

    Words are counted from 0, `last` is a detection's last word. A null or empty text has no words and no hits. Rows are looked at
    one by one, so repeated rows and ties need no rule; columns of those three names are replaced.
    """
    docs = docs.drop("n_words", "base_hits", "detections")
    names, at = docs.columns, docs.columns.index(text_col)
    hit = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, base, found = [], [], []
            for text in b.column(at):
                k, places, hits = scan(text.as_py())
                n.append(k)
                base.append([{"first": i, "last": i + WORDS[label] - 1, "label": label, "score": 0.5} for i, label in places])
                found.append([{"first": i, "last": j - 1, "label": label, "score": score} for i, j, label, score in hits])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(base, hit), pa.array(found, hit)], [*names, "n_words", "base_hits", "detections"])

    schema = StructType([*docs.schema.fields]).add("n_words", "long").add("base_hits", FOUND).add("detections", FOUND)
    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.col("base_hits.label")))
    both = F.array_sort(F.array_distinct(F.concat("base_hits.label", "detections.label")))
    first = F.col("base_hits.first")
    return out.select(
        "doc_id",
        "n_words",
        F.size("base_hits").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.coalesce(F.array_max(F.concat("base_hits.score", "detections.score")), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
