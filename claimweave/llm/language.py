"""Language ID (5): multilingual mixture inference. Character trigram models are learned from labelled texts; each document's language
proportions come from expectation-maximisation over its blocks, and its set of languages from a penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from claimweave.llm.arrow import STEP, buffer_of, steps
from claimweave.llm.common import table
from claimweave.session import ship

BITS = 6  #: of a byte class
GRAMS = 1 << 3 * BITS
BLOCK = 64  #: bytes of a block, the unit that one language has
SMOOTH = 0.2
ROUNDS = 12  #: of expectation-maximisation
#: Half of this many log(blocks) must be gained in log-likelihood by each further language.
PENALTY = 12.0
#: Mean log-probability of a trigram below which a text is in none of the languages; as if drawn from 60,000 at random.
LEAST = -11.0

_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37


def trigrams(data: np.ndarray) -> np.ndarray:
    """The class trigram that starts at each byte (the last two are of spaces); 0 has no letter."""
    c = _CLASS[data]
    out = np.zeros(len(c), np.uint32)
    if len(c) > 2:
        out[:-2] = c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:]
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.asarray(b.column(1).to_pylist(), object)
        for lang in dict.fromkeys(langs):
            own = seen.setdefault(lang, np.zeros(GRAMS, np.int64))
            data, off = buffer_of(pc.utf8_lower(b.column(0).filter(pa.array(langs == lang))))
            for i, j in steps(off):
                for at in range(off[i], off[j], STEP):
                    own += np.bincount(trigrams(data[at : min(at + STEP, off[j])]), minlength=GRAMS)
    for lang, own in seen.items():
        own[0] = 0
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at])], ["lang", "gram", "n"])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Labels and log-probabilities (GRAMS x labels) of the trigrams, from all rows of docs with a text and a label.

    Counted on the executors; the driver gets at most GRAMS counts a label. Without such rows there are no labels.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(counts.lang.unique())
    c = np.zeros((GRAMS, len(labels)))
    c[counts.gram.to_numpy(), np.searchsorted(labels, counts.lang.to_numpy(str))] = counts.n
    seen = max(1, int((c.sum(1) > 0).sum()))
    logp = np.log((c + SMOOTH) / (c.sum(0) + SMOOTH * (seen + 1)))
    logp[0] = 0
    return labels, logp.astype(np.float32)


def _block_scores(data: np.ndarray, off: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (blocks x labels) of all blocks of the documents, and each document's first block (one more than documents)."""
    size = np.diff(off)
    n = -(-size // BLOCK)
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(size)), n)
    start = off[:-1][doc] + (np.arange(first[-1]) - first[:-1][doc]) * BLOCK
    out = np.zeros((first[-1], logp.shape[1]))
    for a, b in steps(np.concatenate([start, off[-1:]])):
        lo, hi = start[a], start[b] if b < len(start) else off[-1]
        g = trigrams(data[lo:hi])
        ends = off[np.searchsorted(off, lo, "right") : np.searchsorted(off, hi, "right")] - lo
        for back in (1, 2):  # no trigram runs on into the next document
            cut = ends - back
            g[cut[cut >= 0]] = 0
        for k in range(logp.shape[1]):
            out[a:b, k] = np.add.reduceat(logp[:, k][g], start[a:b] - lo)
    return out, first


def _fit(like: np.ndarray, first: np.ndarray, doc: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed labels in each document, and the log-likelihood that they give."""
    p = allowed / allowed.sum(1, keepdims=True)
    n = np.diff(first)[:, None]
    for _ in range(ROUNDS):
        r = p[doc] * like
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        p = np.add.reduceat(r, first[:-1], 0) / n
    return p, np.add.reduceat(np.log(np.maximum((p[doc] * like).sum(1), 1e-300)), first[:-1])


def mixtures(data: np.ndarray, off: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions and log-likelihoods of the whole texts (documents x labels); documents must not be empty. The sets tried are
    nested, in the order of an unrestricted fit."""
    score, first = _block_scores(data, off, logp)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    top = score.max(1, keepdims=True)
    like = np.exp(score - top)
    full, most = _fit(like, first, doc, np.ones((len(off) - 1, logp.shape[1])))
    cost = 0.5 * PENALTY * np.log(np.diff(first) + 1.0)
    total = np.add.reduceat(score, first[:-1], 0)
    rank = np.argsort(np.argsort(-np.round(full, 6) - 1e-9 * total / np.abs(total).max(1, keepdims=True).clip(1), 1, "stable"), 1, "stable")
    best, value = None, None
    for m in range(1, logp.shape[1] + 1):
        if best is not None and not (most - (m - 1) * cost > value).any():
            break  # no larger set can pay for its size: none is likelier than the unrestricted fit
        p, ll = _fit(like, first, doc, (rank < m).astype(float))
        v = ll - (m - 1) * cost
        if best is None:
            # of single languages, the one of the highest likelihood
            best = np.eye(logp.shape[1])[total.argmax(1)]
            value = np.take_along_axis(total, total.argmax(1)[:, None], 1)[:, 0] - np.add.reduceat(top[:, 0], first[:-1])
        else:
            better = v > value
            best[better], value[better] = p[better], v[better]
    return best, total


def _tell(texts: pa.Array, labels: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, its proportion and the set with proportions of each text."""
    lang, score, sets = np.array(["und"] * len(texts), object), np.zeros(len(texts)), np.array([""] * len(texts), object)
    has = np.flatnonzero(pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)) if labels else []
    if len(has):
        data, off = buffer_of(pc.utf8_lower(texts.take(pa.array(has))))
        for i, j in steps(off):
            p, total = mixtures(data[off[i] : off[j]], off[i : j + 1] - off[i], logp)
            first = np.where(p >= p.max(1, keepdims=True) - 1e-3, total, -np.inf).argmax(1)  # of equal shares, that of the likelier language
            lang[has[i:j]], score[has[i:j]] = np.array(labels, object)[first], np.minimum(np.take_along_axis(p, first[:, None], 1)[:, 0], 1.0)
            sets[has[i:j]] = [",".join(f"{labels[k]}:{q[k]:.4f}" for k in np.argsort(-q, kind="stable") if q[k] > 0) for q in p]
    return lang, score, sets


def _fits(texts: pa.Array, labels: list[str], logp: np.ndarray, least: float) -> np.ndarray:
    """Which texts have letters and, under their mixture, a mean log-probability of a trigram of at least `least`."""
    out = np.zeros(len(texts), bool)
    has = np.flatnonzero(pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)) if labels else []
    if len(has):
        data, off = buffer_of(pc.utf8_lower(texts.take(pa.array(has))))
        for i, j in steps(off):
            own = off[i : j + 1] - off[i]
            score, first = _block_scores(data[off[i] : off[j]], own, logp)
            p, _ = mixtures(data[off[i] : off[j]], own, logp)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            top = score.max(1, keepdims=True)
            like = np.add.reduceat(np.log(np.maximum((p[doc] * np.exp(score - top)).sum(1), 1e-300)) + top[:, 0], first[:-1])
            grams = np.add.reduceat((trigrams(data[off[i] : off[j]]) != 0).astype(np.int64), own[:-1])
            out[has[i:j]] = like >= least * np.maximum(grams, 1)
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (that language's proportion of the text) and lang_set (label:proportion of the chosen set).

    A null text or one without a letter is `und` with score 0, as is any text under a model without labels. Each row is looked at by
    itself, repeated rows get equal results; columns of those three names are replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "lang_set")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most GRAMS floats a label
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, sets = _tell(b.column(at), *sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(sets, pa.string())], [*names, "lang_pred", "lang_score", "lang_set"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType()).add("lang_set", StringType())
    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those with a doc_id whose crc32 isn't 2 modulo 4."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the rows whose language can't be told: without letters, or under `least` in the mean log-probability of a trigram
    under the chosen mixture. A text in several languages is kept, however small the share of each. Null and empty texts go, repeated
    rows are treated alike, an empty table gives an empty result; columns of any name stay as they are."""
    labels, logp = model = learn(training(docs))
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most GRAMS floats a label
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_fits(b.column(at), *sent.value, least)))

    return docs.mapInArrow(run, docs.schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), learn(training(docs)))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_set")
