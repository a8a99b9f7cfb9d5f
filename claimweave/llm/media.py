"""Media columns (6): content-defined payload chunking. A rolling gear hash cuts payloads of 8-bit samples into chunks; chunk digests are
deduplicated by joins, and ordered chunk lists rebuild the media, which is verified against its digest."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import broadcast_if_small, materialise, table
from claimweave.session import ship

#: A cut falls behind a byte where the low CUT bits of the gear hash of the WINDOW bytes up to it are 0, between LEAST and MOST bytes.
CUT, LEAST, MOST, WINDOW = 12, 1024, 32768, 32
PAD = 64
RATE = 8000  #: of the samples that the container's header names
GEAR = np.random.default_rng(20240607).integers(0, 2**32, 256, np.uint32)
#: Payloads that a task remembers, so that it stores the copies of a text once.
RECENT = 100_000


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, by doubling the window."""
    h = GEAR[data]
    w = 1
    while w < WINDOW:
        h[w:] += h[:-w] << np.uint32(w)
        w *= 2
    return h


def cuts(data: np.ndarray, piece: int = 4 << 20) -> list[int]:
    """Ends of the chunks of a payload; the hash is taken piece by piece."""
    marks = []
    for a in range(0, len(data), piece):
        lo = max(0, a - WINDOW + 1)
        h = gear_hashes(data[lo : a + piece])[a - lo :]
        marks.append(np.flatnonzero((h & np.uint32((1 << CUT) - 1)) == 0) + a + 1)
    spots = np.concatenate(marks) if marks else np.zeros(0, int)
    out, at, n = [], 0, len(data)
    while at < n:
        i = int(np.searchsorted(spots, at + LEAST))
        end = min(int(spots[i]) if i < len(spots) else n, at + MOST, n)
        out.append(end)
        at = end
    return out


def header(n: int) -> bytes:
    """Of a RIFF container of n 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", (36 + n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n & 0xFFFFFFFF)


def samples(media: bytes) -> bytes:
    """The samples of a container made by header; its fields are checked."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not an 8-bit sample container")
    payload = media[44:]
    if struct.unpack("<I", media[40:44])[0] != len(payload) & 0xFFFFFFFF:
        raise ValueError("sample container of another length")
    return payload


def padded(text: Column) -> Column:
    """UTF-8 bytes with bytes 0 up to a positive multiple of PAD."""
    body = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(body)
    fill = F.when(n == 0, PAD).otherwise(F.pmod(-n, F.lit(PAD)))
    return F.concat(body, F.unhex(F.repeat(F.lit("00"), fill)))


def payload_key(payload: Column) -> Column:
    """128 bits of a payload's sha256."""
    return F.unhex(F.substring(F.sha2(payload, 256), 1, 32))


def _chunks(docs: DataFrame, text_col: str, stored: bool) -> DataFrame:
    """Chunks of the payloads: key, seq, digest, size and, if stored, the packed bytes z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes, None] = OrderedDict()
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            held = 0
            for x in b.column(0):
                body = (x.as_py() or "").encode()
                body += bytes(PAD if not body else -len(body) % PAD)
                key = hashlib.sha256(body).digest()[:16]
                if key in known:
                    known.move_to_end(key)
                    continue
                known[key] = None
                if len(known) > RECENT:
                    known.popitem(last=False)
                at = 0
                for seq, end in enumerate(cuts(np.frombuffer(body, np.uint8))):
                    own = body[at:end]
                    for col, v in zip(cols, (key, seq, hashlib.blake2b(own, digest_size=16).digest(), end - at, pack.compress(own) if stored else None), strict=True):
                        col.append(v)
                    held += end - at if stored else 64
                    at = end
                if held > 8 << 20:
                    yield _batch(cols, stored)
                    cols, held = [[], [], [], [], []], 0
            yield _batch(cols, stored)

    ship(docs.sparkSession)
    kind = "key binary, seq int, digest binary, size int" + ", z binary" * stored
    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, kind)


def _batch(cols: list[list], stored: bool) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    n = 4 + stored
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds[:n], strict=True)], ["key", "seq", "digest", "size", "z"][:n])


def chunk_lists(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The ordered chunk lists of all distinct payloads: key, seq, digest, size."""
    return _chunks(docs, text_col, False).groupBy("key", "seq").agg(F.first("digest").alias("digest"), F.first("size").alias("size"))


def chunk_store(docs: DataFrame, lists: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The stored chunks, each once: (own, shared). own has (key, seq, z) of chunks that one payload has; shared has (digest, z) of
    chunks that several payloads or places have, whose owner is the smallest (key, seq)."""
    owner = lists.groupBy("digest").agg(F.min(F.struct("key", "seq")).alias("o"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    owner = materialise(owner.select("digest", F.col("o.key").alias("o_key"), F.col("o.seq").alias("o_seq")), "owners")
    keys = broadcast_if_small(materialise(owner.select(F.col("o_key").alias("__key")).distinct(), "owner_keys"))
    owner = broadcast_if_small(owner)
    own = _chunks(docs, text_col, True).join(owner, "digest", "left_anti").select("key", "seq", "z")
    # Only the texts that own a shared chunk are cut once more.
    few = docs.join(keys, payload_key(padded(F.col(text_col))) == keys["__key"], "left_semi")
    kept = _chunks(few, text_col, True).join(owner, "digest")
    shared = kept.where((F.col("key") == F.col("o_key")) & (F.col("seq") == F.col("o_seq"))).select("digest", "z")
    return own, materialise(shared, "shared").dropDuplicates(["digest"])


def rebuild(lists: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """Reads the media back: key, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each payload.

    Chunks come from the store by joins and are put together in the order of their lists; a payload whose digest isn't its key, or
    that lacks a chunk, raises an error.
    """
    other = lists.select("digest", "key", "seq").join(shared, "digest").select("key", "seq", "z")
    ends = lists.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = own.unionByName(other).withColumn("n", F.lit(-1)).unionByName(ends.select("key", F.lit(-1).alias("seq"), F.lit(None).cast("binary").alias("z"), "n"))
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("key", "seq", "z", "n").repartition(parts, "key").sortWithinPartitions("key", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        key, want, got, last = None, 0, [], -1

        def done() -> tuple:
            if len(got) != want:
                raise ValueError(f"payload {key.hex()}: {len(got)} of {want} chunks")
            return (key, *features(header(sum(map(len, got))) + b"".join(got), len(got), key))

        for b in batches:
            out = []
            for k, seq, z, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if key is not None:
                        out.append(done())
                    key, want, got, last = k, n, [], -1
                elif seq != last:  # several tasks may have stored a copied text
                    got.append(unpack.decompress(z))
                    last = seq
            yield _rows(out)
        yield _rows([done()] if key is not None else [])

    return rows.mapInArrow(run, "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def features(media: bytes, chunks: int, key: bytes) -> tuple:
    payload = samples(media)
    sha = hashlib.sha256(payload)
    if sha.digest()[:16] != key:
        raise ValueError(f"payload {key.hex()}: other bytes were read back")
    x = np.frombuffer(payload, np.uint8)
    high = x >= 128
    feature = f"chunks={chunks};sum={int(x.sum(dtype=np.int64))};peak={int(x.max())};low={int(x.min())};crossings={int(np.count_nonzero(high[1:] != high[:-1]))};distinct={np.count_nonzero(np.bincount(x, minlength=256))}"
    return len(payload), sha.hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, key and what rebuild gives for the row's text.

    A null text is empty; its payload is PAD bytes 0. Each distinct text is stored and read back once, so equal texts have equal values
    and repeated rows cost nothing more. An empty table gives an empty result.
    """
    lists = materialise(chunk_lists(docs, text_col), "chunks")
    own, shared = chunk_store(docs, lists, text_col)
    read = materialise(rebuild(lists, own, shared), "media")
    d = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), payload_key(padded(F.col(text_col))).alias("key"))
    return d.join(broadcast_if_small(read, 20_000), "key")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_features(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
