import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(low(text))


#: Nulls, empty and blank texts, repeated rows and ids, non-ASCII, a long text, ties; more columns, some with names the operators use.
LONG = " ".join(f"word{i % 977} and {i}" for i in range(30_000))
TEXTS = [
    (1, "Mail a.b+c@ex-am.ple.org, 10.0.0.255 or 999.1.1.1; call +1 (743) 555-3824 now.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "   \n\t\n", "fr", None),
    (5, "Straße é ñ 日本語 — card 4111 1111 1111 1111 and 4111-1111-1111-1112.", "de", "b"),
    (5, "the same id, another text with the words one two three four five six seven eight nine ten", "en", "b"),
    (6, "All rights reserved. Licensed under the MIT License; CC BY 4.0, cc-by.", "en", "a"),
    (7, "All rights reserved. Licensed under the MIT License; CC BY 4.0, cc-by.", "en", "c"),
    (7, "All rights reserved. Licensed under the MIT License; CC BY 4.0, cc-by.", "en", "c"),
    (None, "no id but a text that has some words in it", "en", "a"),
    (None, None, None, None),
    (8, "12345", "en", "a"),
    (9, LONG, "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, words int, rate string, base int, lines string, shard int"


def rows():
    return [(i, t, g, s, len(t or ""), "k", 1, "r", 2, "l", 9) for i, t, g, s in TEXTS]


def docs(spark, more=()):
    return spark.createDataFrame(rows() + [(i, t, "en", "a", len(t or ""), "k", 1, "r", 2, "l", 9) for i, t in more], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
