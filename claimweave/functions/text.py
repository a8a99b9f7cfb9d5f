"""Terms of texts and identifiers, and the lexical score."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z_][A-Za-z0-9_]{2,}"
STOP = ("the", "and", "for", "from", "with", "return", "class", "def", "import", "const", "let", "var")
#: Longer suffixes first; every one that fits gives a stem.
SUFFIXES = ("ations", "ation", "ments", "ment", "ing", "ers", "er", "ed", "s")
LEAST_STEM = 4
DECLARING = ("declare", "declares", "declared", "source", "where", "which")
PERSISTING = ("repository", "repositories", "persists", "persistence")
ROUTING = ("http", "endpoint", "route", "api")
DECLARED_KINDS = ("class", "interface", "method", "field", "constructor")


def first_by_case(words: Column, limit: int) -> Column:
    """The first spelling of each word, case aside, in order, at most limit of them. Linear in words but for array_position's scans, so
    meant for the words of a name or a bounded prefix of distinct ones; long texts go through keywords_table."""
    low = F.transform(words, lambda w: F.lower(w))
    kept = F.filter(F.arrays_zip(words.alias("w"), low.alias("l"), F.transform(low, lambda x: F.array_position(low, x)).alias("p"), F.sequence(F.lit(1), F.size(words)).alias("i")), lambda x: x["p"] == x["i"])
    return F.slice(F.transform(kept, lambda x: x["w"]), 1, limit)


def identifier_keywords(name: Column, limit: int = 16) -> Column:
    parts = F.filter(F.split(F.translate(name, ".", "_"), "_"), lambda p: p != "")
    return F.when(F.size(parts) > 0, first_by_case(parts, limit)).otherwise(F.array().cast("array<string>"))


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Terms of a question: its words, and a stem for every suffix that leaves enough of one."""
    raw = {w.lower() for w in re.findall(WORD, query)}
    out = set(raw)
    for w in raw:
        for suffix in (s for s in SUFFIXES if w.endswith(s) and len(w) - len(s) >= LEAST_STEM):
            stem = w.removesuffix(suffix)
            out.add(stem)
            if suffix in ("ing", "ed") and stem[-1] * 2 == stem[-2:]:
                out.add(stem[:-1])
    return sorted(out)


def stems(word: Column) -> Column:
    """query_terms for one lower-case word in a column: the word and its stems, sorted."""

    def one(suffix: str) -> Column:
        stem = F.left(word, F.char_length(word) - len(suffix))
        fits = word.endswith(suffix) & (F.char_length(word) - len(suffix) >= LEAST_STEM)
        out = [F.when(fits, stem)]
        if suffix in ("ing", "ed"):
            out.append(F.when(fits & (F.substring(stem, -1, 1) == F.substring(stem, -2, 1)), F.left(stem, F.char_length(stem) - 1)))
        return out

    return F.array_sort(F.array_distinct(F.array_compact(F.array(word, *[c for s in SUFFIXES for c in one(s)]))))


def search_text(claim: Column, keywords: Column, path: Column, qualname: Column, name: Column) -> Column:
    none = F.lit("")
    return F.lower(F.concat_ws(" ", F.coalesce(claim, none), F.coalesce(F.array_join(keywords, " "), none), F.coalesce(path, none), F.coalesce(qualname, none), F.coalesce(name, none)))


def basename_stem(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.substring_index(path, "/", -1)), r"(?<=.)\.[^.]*$", "")


def lexical_score(terms: list[str], hay: Column, path: Column, qualname: Column, name: Column, node_kind: Column, scope: Column) -> Column:
    """10 for each term in the search text, 35 for each that names the thing, and the adjustments for intents."""
    if not terms:
        return F.lit(0)
    base, last, own = basename_stem(path), F.substring_index(F.lower(F.coalesce(qualname, F.lit(""))), ".", -1), F.lower(F.coalesce(name, F.lit("")))
    score = F.lit(0)
    for t in terms:
        score = score + F.when(F.contains(hay, F.lit(t)), 10).otherwise(0) + F.when((base == t) | (last == t) | (own == t), 35).otherwise(0)
    if set(terms) & set(DECLARING):
        score = score + F.when(node_kind.isin(*DECLARED_KINDS), 12).otherwise(0)
    if set(terms) & set(PERSISTING):
        score = score + F.when(base.endswith("repository") | own.endswith("repository"), 30).otherwise(0)
    if not set(terms) & set(ROUTING):
        score = score - F.when(scope == "api", 8).otherwise(0)
    return score
