"""SimHash near-dedup (7): navigable small-world graphs over Hamming distance. Documents are dealt into shards of bounded size, each shard
builds a graph of its sketches and is searched with expanding beams whose recall is audited against exact search; candidate edges are
verified on the texts' five-word shingles and united into classes.

A shard is asked only by documents that share a minimum hash with it (several shards a document), since sending every document to
every shard would cost the square of the corpus. Documents whose minimum hash lies in a passage that very many share are told apart by
minimum hashes of their other shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.arrow import buffer_of, steps
from claimweave.llm.common import broadcast_if_small, materialise, same_row, table
from claimweave.session import ship

SHINGLE, SIMILAR = 5, 0.8
#: Shards that a document is in; near copies miss one another in all of them with probability (1 - similarity) to this power.
REPLICAS = 4
#: Documents of a shard, about. More of them that share a minimum hash are a hot group: its shingles in over SHARD documents, the HOTTEST
#: most frequent of them at most, are left out, and COLD_KEYS minimum hashes of the others bring its pairs together. If one document of a
#: pair of similarity 0.8 has a share of at least COLD of other shingles, the others' similarity is 0.2 at least, and no hash is common
#: with probability 0.8 ** COLD_KEYS = 0.0008. Documents below that share are compared as a whole, by pairs of blocks of PIECE rows.
SHARD, PIECE = 1024, 2048
COLD_KEYS, COLD, HOTTEST = 32, 0.25, 1 << 20
#: Rows of a group of a cold minimum hash up to which all of its pairs within RADIUS are candidates.
FEW = 16
#: Bits of 128 that candidates may differ in: at similarity 0.8 they differ in 19.4 on average, with a deviation of 4.1.
RADIUS = 36
#: Graph neighbours, beam to begin with, queries of a shard that are audited, recall that they must reach.
LINKS, BEAM, AUDIT, RECALL = 10, 16, 32, 0.98
#: A beam that lies within the radius grows to this; beyond it, the row is compared with its whole shard.
WIDEST = 64
#: Of the neighbours within the radius, the nearest and a spread of the others become candidates. The others are verified too, in a second
#: pass, unless they are in one class by then.
NEAR, SPREAD = 6, 3
#: Rows of a block of the second pass, shingles in it, about; shingles in more documents than this are counted by a matrix product.
ROWS, GRAINS, HEAVY = 256, 100_000, 32

U = np.uint64
_RNG = np.random.default_rng(7)
_TABLE = _RNG.integers(1, 2**63, 256, U)
_POW = _RNG.integers(1, 2**63, 4096, U) | U(1)
_SEEDS = _RNG.integers(1, 2**63, 64, U)
_MUL = _RNG.integers(1, 2**63, 8, U) | U(1)
_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_LOW = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and each document's first word (one more than documents)."""
    low = _LOW[data]
    word = _WORD[low]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    start[heads] = word[heads]
    at = np.flatnonzero(start)
    first = np.searchsorted(at, off)
    if not len(at):
        return np.zeros(0, U), first
    place = np.arange(len(data)) - np.repeat(at, np.diff(np.append(at, len(data)))) if at[0] == 0 else np.concatenate([np.zeros(at[0], int), np.arange(at[0], len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))])
    h = _TABLE[low] * _POW[place & 4095]
    h[~word] = 0
    return mixed(np.add.reduceat(h, at)), first


def shingles(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Each document's distinct shingles, sorted; a document of fewer words has one of all of them."""
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        s = sum((words[i : n + i] * _MUL[i] for i in range(1, SHINGLE)), words[:n] * _MUL[0])
        s = mixed(s)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            own = np.sort(s[a : b - SHINGLE + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(mixed((words[a:b] * _MUL[: b - a]).sum(keepdims=True, dtype=U) + np.array([b - a], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def simhash(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits (two words) for each document's shingles s[first[i]:first[i+1]], none of them empty. Bits are summed in byte lanes, 255 at a time."""
    block = np.concatenate([np.arange(a, b, 255) for a, b in zip(first[:-1], first[1:], strict=True)])
    per = np.searchsorted(block, first[:-1])
    size = np.diff(first)
    out = np.zeros((len(size), 2), U)
    for half in range(2):
        x = mixed(s ^ _SEEDS[half])
        for j in range(8):
            lanes = np.add.reduceat((x >> U(j)) & U(0x0101010101010101), block)
            total = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), per, 0)
            bits = (2 * total > size[:, None]).astype(U)
            for lane in range(8):
                out[:, half] |= bits[:, lane] << U(8 * lane + j)
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_key, node (128 bits of the words' sequence, as two longs), simhash (two longs), mins (2 * REPLICAS longs)."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffer_of(b.column(2))
            n = b.num_rows
            cols = np.zeros((n, 4 + 2 * REPLICAS), U)
            for i, j in steps(off):
                words, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                sets = shingles(words, first)
                full = np.flatnonzero(np.diff(first) > 0)
                if not len(full):
                    continue
                begin = first[:-1][full]
                place = np.arange(len(words)) - np.repeat(begin, np.diff(first)[full])
                for c in range(2):
                    mark = mixed(words + _SEEDS[60 + c]) * mixed(place.astype(U) + _SEEDS[62 + c])
                    cols[i + full, c] = mixed(np.add.reduceat(mark, begin))
                s = np.concatenate(sets)
                edge = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])])
                cols[i + full, 2:4] = simhash(s, edge)
                for r in range(2 * REPLICAS):
                    cols[i + full, 4 + r] = np.minimum.reduceat(mixed(s ^ _SEEDS[2 + r]), edge[:-1])
            x = cols.view(np.int64)
            mins = pa.ListArray.from_arrays(np.arange(0, n * 2 * REPLICAS + 1, 2 * REPLICAS, np.int32), pa.array(x[:, 4:].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(4)], mins], ["doc_id", "text_key", "n1", "n2", "s1", "s2", "mins"])

    return src.mapInArrow(run, f"doc_id {kind}, text_key long, n1 long, n2 long, s1 long, s2 long, mins array<long>")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


class SmallWorld:
    """A navigable small-world graph over the rows of sigs (n x 2 words), built by inserting batches that double the graph."""

    def __init__(self, sigs: np.ndarray, links: int = LINKS, beam: int = BEAM) -> None:
        self.sigs, self.beam = sigs, beam
        n = len(sigs)
        self.near = np.full((n, 2 * links), -1, np.int32)
        self.far = np.full((n, 2 * links), 999, np.int32)
        self.n = 0
        head = min(n, 2 * links + 1)
        if head:
            d = distance(sigs[:head, None], sigs[None, :head])
            np.fill_diagonal(d, 999)
            order = np.argsort(d, 1, "stable")[:, : min(2 * links, head - 1)]
            self.near[:head, : order.shape[1]] = order
            self.far[:head, : order.shape[1]] = np.take_along_axis(d, order, 1)
            self.n = head
        while self.n < n:
            new = np.arange(self.n, min(n, 2 * self.n))
            ids, d = self.search(sigs[new], beam)
            ids, d = ids[:, :links], d[:, :links]
            self.near[new, : ids.shape[1]], self.far[new, : ids.shape[1]] = ids, d
            self.n = int(new[-1]) + 1
            self._link_back(np.repeat(new, ids.shape[1]), ids.ravel(), d.ravel())

    def _link_back(self, src: np.ndarray, dst: np.ndarray, d: np.ndarray) -> None:
        """Links dst to src as well; of a node's links the nearest stay, with half of its places held for links of its own insertion."""
        ok = dst >= 0
        src, dst, d = src[ok], dst[ok], d[ok]
        order = np.lexsort((d, dst))
        src, dst, d = src[order], dst[order], d[order]
        head = np.append(True, dst[1:] != dst[:-1])
        rank = np.arange(len(dst)) - np.maximum.accumulate(np.where(head, np.arange(len(dst)), 0))
        width = self.near.shape[1]
        ok = rank < width
        who, at = np.unique(dst[ok], return_inverse=True)
        ids = np.full((len(who), width), -1, np.int32)
        far = np.full((len(who), width), 999, np.int32)
        ids[at, rank[ok]], far[at, rank[ok]] = src[ok], d[ok]
        ids, far = np.hstack([self.near[who], ids]), np.hstack([self.far[who], far])
        keep = np.argsort(far, 1, "stable")
        half = width // 2
        # the nearest, and of the rest every other one: long links keep the graph navigable
        pick = np.hstack([keep[:, :half], keep[:, half : half + 2 * (width - half) : 2]])
        pick = pick[:, :width]
        self.near[who], self.far[who] = np.take_along_axis(ids, pick, 1), np.take_along_axis(far, pick, 1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of up to beam near rows for each query, nearest first; -1 and 999 where there are fewer."""
        n, m = self.n, len(q)
        beam = min(beam, n)
        seen = np.zeros((m, n), bool)
        entry = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        ids = np.full((m, beam + len(entry)), -1, np.int32)
        d = np.full(ids.shape, 999, np.int32)
        ids[:, : len(entry)] = entry
        d[:, : len(entry)] = distance(q[:, None], self.sigs[None, entry])
        seen[:, entry] = True
        done = np.zeros(ids.shape, bool)
        order = np.argsort(d, 1, "stable")[:, :beam]
        ids, d, done = (np.take_along_axis(x, order, 1) for x in (ids, d, done))
        live = np.arange(m)
        while len(live):
            open_ = np.where(done[live] | (ids[live] < 0), 9999, d[live])
            step = np.argpartition(open_, min(3, beam - 1), 1)[:, : min(4, beam)]
            value = np.take_along_axis(open_, step, 1)
            go = value.min(1) < 9999
            live, step, value = live[go], step[go], value[go]
            if not len(live):
                break
            picked = np.take_along_axis(ids[live], step, 1)
            valid = value < 9999
            mark = done[live]
            np.put_along_axis(mark, step, np.take_along_axis(mark, step, 1) | valid, 1)
            done[live] = mark
            nxt = np.where(valid[:, :, None], self.near[np.maximum(picked, 0)], -1).reshape(len(live), -1)
            ok = nxt >= 0
            row = np.repeat(live, ok.sum(1))
            col = nxt[ok]
            fresh = ~seen[row, col]
            row, col = row[fresh], col[fresh]
            pair = np.unique(row.astype(np.int64) * n + col)
            row, col = pair // n, (pair % n).astype(np.int32)
            if not len(row):
                continue
            seen[row, col] = True
            dist = distance(q[row], self.sigs[col])
            worst = d[row, -1]
            good = dist < worst
            row, col, dist = row[good], col[good], dist[good]
            if not len(row):
                continue
            head = np.append(True, row[1:] != row[:-1])
            rank = np.arange(len(row)) - np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))
            rows = row[head]
            slot = np.cumsum(head) - 1
            extra = np.full((len(rows), int(rank.max()) + 1), -1, np.int32)
            extra_d = np.full(extra.shape, 999, np.int32)
            extra[slot, rank], extra_d[slot, rank] = col, dist
            all_i, all_d = np.hstack([ids[rows], extra]), np.hstack([d[rows], extra_d])
            all_x = np.hstack([done[rows], np.zeros(extra.shape, bool)])
            order = np.argsort(all_d, 1, "stable")[:, :beam]
            ids[rows], d[rows], done[rows] = (np.take_along_axis(x, order, 1) for x in (all_i, all_d, all_x))
        return ids, d


    def exact(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """search, but over all rows, in blocks of queries."""
        beam = min(beam, self.n)
        out = []
        for i in range(0, len(q), 256):
            d = distance(q[i : i + 256, None], self.sigs[None, : self.n])
            near = np.argpartition(d, beam - 1, 1)[:, :beam]
            own = np.take_along_axis(d, near, 1)
            order = np.argsort(own, 1, "stable")
            out.append((np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def candidates(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within RADIUS: for each row the nearest and a spread of the others; and the rows that have more. While an audit against exact search falls short
    of RECALL, the beam doubles for all rows; a shard that the graph doesn't serve at WIDEST is searched exactly. The beam also doubles for
    rows whose whole beam lies within the radius, until it ends outside or is the shard."""
    n = len(sigs)
    if n < 2:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    graph = SmallWorld(sigs)
    asked = np.linspace(0, n - 1, min(n, AUDIT)).astype(int)
    want = (distance(sigs[asked, None], sigs[None]) <= RADIUS).sum(1)
    search, beam = graph.search, BEAM
    while True:
        ids, d = search(sigs[asked], beam)
        found = ((ids >= 0) & (d <= RADIUS)).sum(1)
        could = np.minimum(want, beam)  # a beam that is full isn't the graph's miss
        if found.sum() >= RECALL * could.sum() or beam >= n:
            break
        if beam >= WIDEST:
            search, beam = graph.exact, BEAM
        else:
            beam *= 2
    pairs, rest, todo = [], [], np.arange(n)
    while len(todo):
        if beam > WIDEST:
            search, beam = graph.exact, n
        now, later = (todo[:ROWS], todo[ROWS:]) if beam == n else (todo, todo[:0])  # a row's beam may be the shard
        ids, d = search(sigs[now], beam)
        ok = (ids >= 0) & (d <= RADIUS) & (ids != now[:, None])
        more = (d[:, -1] <= RADIUS) & (ids[:, -1] >= 0) if beam < n else np.zeros(len(now), bool)
        for row in np.flatnonzero(~more & ok.any(1)):
            own = ids[row][ok[row]]
            far = own[NEAR:]
            pick = np.concatenate([own[:NEAR], far[np.linspace(0, len(far) - 1, min(SPREAD, len(far))).astype(int)]])
            pairs.append(np.stack([np.full(len(pick), now[row]), pick], 1))
            if len(own) > len(pick):
                rest.append(now[row])
        todo = np.concatenate([now[more], later])
        beam = beam if beam == n else min(2 * beam, n)
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64), np.array(rest, np.int64)


def _minima(nodes: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(node, s1, s2, r, k1, k2, more columns) for each minimum hash of each node, and the hot ones (r, k1, hot)."""
    rows = nodes.select("node", "s1", "s2", *more, F.posexplode(F.slice("mins", 1, REPLICAS)).alias("r", "k1"), "mins").withColumn("k2", F.element_at("mins", F.col("r") + REPLICAS + 1)).drop("mins")
    # Heavy keys: at most REPLICAS * n / SHARD.
    hot = materialise(rows.groupBy("r", "k1").agg(F.count(F.lit(1)).alias("c1")).where(F.col("c1") > SHARD).select("r", "k1", F.lit(True).alias("hot")), "hot1")
    return rows, broadcast_if_small(hot)


def _dealt(nodes: DataFrame) -> DataFrame:
    """(shard, node, s1, s2): each node once for each of its minimum hashes."""
    n = nodes.count()
    shards = max(1, -(-n // SHARD))
    rows, hot1 = _minima(nodes)
    rows = rows.join(hot1, ["r", "k1"], "left").withColumn("k2", F.when(F.col("hot"), F.col("k2")).otherwise(F.lit(0)))
    hot2 = rows.where("hot").groupBy("r", "k1", "k2").agg(F.count(F.lit(1)).alias("c2")).where(F.col("c2") > SHARD)
    hot2 = broadcast_if_small(materialise(hot2.select("r", "k1", "k2", F.ceil(F.col("c2") / SHARD).cast("int").alias("deal")), "hot2"))
    rows = rows.join(hot2, ["r", "k1", "k2"], "left")
    salt = F.when(F.col("deal").isNotNull(), F.pmod(F.xxhash64("node", "r"), "deal")).otherwise(F.lit(0))
    return rows.select((F.col("r") * shards + F.pmod(F.xxhash64("r", "k1", "k2", salt), F.lit(shards))).alias("shard"), "node", "s1", "s2")


def searched(nodes: DataFrame) -> DataFrame:
    """(shard, a, b): pairs a < b of nodes that a shard's graph has found near, and, with b null, nodes that have more near rows there."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sigs = np.stack([t["s1"].to_numpy(), t["s2"].to_numpy()], 1).view(U)
        node = t["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        pairs, rest = candidates(sigs[order])
        pairs = np.unique(np.sort(node[order][pairs].reshape(-1, 2), 1), axis=0)
        b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(rest), pa.int64())])
        return pa.table({"shard": pa.array([t["shard"][0].as_py()] * len(b), pa.int64()), "a": np.concatenate([pairs[:, 0], node[order][rest]]), "b": b})

    # Each task's work is far more than its bytes, so that the number of tasks follows the number of shards.
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * REPLICAS // (SHARD * 8)))
    return _dealt(nodes).repartition(parts, "shard").groupBy("shard").applyInArrow(run, "shard long, a long, b long")


def texts_of(docs: DataFrame, nodes: DataFrame, ends: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes in ends; a repeated row's text comes more than once."""
    ends = broadcast_if_small(materialise(ends.join(nodes.select("node", "doc_id", "text_key"), "node"), "ends"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    return d.join(ends, same_row(d, ends, "doc_id", "text_key")).select("node", "text")


def cold_keys(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(node, share, keys) of the nodes in hot groups: the share of their shingles that are cold, and COLD_KEYS minimum hashes of those (null
    without any). None if no group is hot."""
    rows, hot = _minima(nodes)
    held = materialise(rows.join(hot, ["r", "k1"], "left_semi").select("node").distinct(), "in_hot")
    if not held.limit(1).count():
        return None
    text = materialise(texts_of(docs, nodes, held, id_col, text_col).dropDuplicates(["node"]), "hot_texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffer_of(b.column(1))
            seen, n = np.zeros(0, U), np.zeros(0, np.int64)
            for i, j in steps(off):
                own, times = np.unique(np.concatenate(shingles(*word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i]))), return_counts=True)
                seen, at = np.unique(np.concatenate([seen, own[times > 1]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, times[times > 1]]), len(seen)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n)], ["s", "n"])

    often = text.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > SHARD)
    known = np.sort(np.array([r.s for r in often.orderBy(F.desc("n"), "s").limit(HOTTEST).select("s").collect()], np.int64).view(U))
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffer_of(b.column(1))
            share, keys = np.zeros(b.num_rows), np.zeros((b.num_rows, COLD_KEYS), U)
            has = np.zeros(b.num_rows, bool)
            for i, j in steps(off):
                sets = shingles(*word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                s = np.concatenate(sets)
                first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                at = np.searchsorted(sent.value, s)
                cold = np.append(sent.value, U(0))[at] != s if len(sent.value) else np.ones(len(s), bool)
                so_far = np.concatenate([[0], np.cumsum(cold)])[first]
                n = np.diff(so_far)
                share[i:j], has[i:j] = n / np.maximum(np.diff(first), 1), n > 0
                own, full = s[cold], np.flatnonzero(n)
                for r in range(COLD_KEYS):
                    if len(full):
                        keys[i + full, r] = np.minimum.reduceat(mixed(own ^ _SEEDS[10 + r]), so_far[:-1][full])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * COLD_KEYS, COLD_KEYS, np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(share), pa.array(has), lists], ["node", "share", "has", "keys"])

    cold = text.mapInArrow(run, "node long, share double, has boolean, keys array<long>")
    return materialise(cold.select("node", "share", F.when(F.col("has"), F.col("keys")).alias("keys")), "cold")


def _cold_groups(nodes: DataFrame, cold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(few, many): rows (unit, node) of the groups of a cold minimum hash with 2 to SHARD nodes, and of those with more."""
    rows = materialise(cold.select("node", F.posexplode("keys").alias("r", "key")).select(F.xxhash64("r", "key").alias("unit"), "node"), "cold_rows")
    per = materialise(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cold_groups")
    many = broadcast_if_small(materialise(per.where(F.col("n") > SHARD).select("unit"), "cold_many"))
    return rows.join(per.where(F.col("n") <= SHARD).select("unit"), "unit"), rows.join(many, "unit")


def searched_cold(nodes: DataFrame, few: DataFrame) -> DataFrame:
    """searched, for groups of a cold minimum hash: each group by itself, one after another off the sorted partitions."""
    rows = few.join(nodes.select("node", "s1", "s2"), "node").select("unit", "node", "s1", "s2")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def of(unit: int, node: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(node) <= FEW:
            i, j = np.nonzero(np.triu(distance(sigs[:, None], sigs[None]) <= RADIUS, 1))
            return np.sort(np.stack([node[i], node[j]], 1), 1), node[:0]
        pairs, rest = candidates(sigs)
        return np.unique(np.sort(node[pairs].reshape(-1, 2), 1), axis=0), node[rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in _and_end(batches):
            if b is not None:
                x = np.stack([c.to_numpy() for c in b.columns], 1)
                held = x if held is None else np.concatenate([held, x])
            if held is None or not len(held):
                continue
            heads = np.flatnonzero(np.append(True, held[1:, 0] != held[:-1, 0]))
            whole = len(held) if b is None else heads[-1]
            out = []
            for at, end in zip(heads, np.append(heads[1:], len(held)), strict=True):
                if end <= whole and end - at > 1:
                    unit, node, sigs = held[at, 0], held[at:end, 1], np.ascontiguousarray(held[at:end, 2:]).view(U)
                    pairs, rest = of(unit, node, sigs)
                    out += [(unit, a, c) for a, c in pairs.tolist()] + [(unit, a, None) for a in rest.tolist()]
            held = held[whole:]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["shard", "a", "b"])

    return rows.repartition(parts, "unit").sortWithinPartitions("unit", "node").mapInArrow(run, "shard long, a long, b long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs whose texts' shingle sets have a Jaccard similarity of SIMILAR or more. A node's text goes to its smaller pairs' task once."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    text = texts_of(docs, nodes, ends, id_col, text_col)
    left = text.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(text, pairs.b == text.node).select("a", "b", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.unionByName(right).repartition(parts, "a").sortWithinPartitions("a", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, last = None, np.zeros(0, U), None
        for batch in batches:
            data, off = buffer_of(batch.column(2))
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i, j in steps(off):
                words, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for k, own in zip(range(i, j), shingles(words, first), strict=True):
                    if b[k] is None:
                        at, base, last = a[k], own, None
                    elif a[k] == at and b[k] != last:  # a repeated row's text comes more than once
                        last = b[k]
                        both = len(np.intersect1d(base, own, True))
                        if both >= SIMILAR * (len(base) + len(own) - both) - 1e-9:
                            out.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of a unit's two sides, and whether they are the same: a unit without a side 1 is compared with itself."""
    side = t["side"].to_numpy()
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1)
    return (x, y, False) if len(y) else (x, x, True)


def _open(sigs: np.ndarray, label: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> np.ndarray:
    """Which rows of x are within RADIUS of which of y under another label; of equal sides each pair once."""
    mask = (distance(sigs[x][:, None], sigs[y][None]) <= RADIUS) & (label[x][:, None] != label[y][None])
    return mask & (x[:, None] < y[None]) if same else mask


def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles, len(x) x len(y)."""
    value, owner = np.concatenate(y), np.repeat(np.arange(len(y)), [len(s) for s in y])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    mine, row = np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])
    a, b = np.searchsorted(value, mine), np.searchsorted(value, mine, "right")
    light = b - a <= HEAVY
    n = np.where(light, b - a, 0)
    at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
    out = np.bincount(np.repeat(row, n) * len(y) + owner[at], minlength=len(x) * len(y)).reshape(len(x), len(y))
    first, col = np.unique(a[~light], return_inverse=True)
    last = np.searchsorted(value, value[first], "right")
    for i in range(0, len(first), 4096):
        own = (col >= i) & (col < i + 4096)
        left = np.zeros((len(x), min(4096, len(first) - i)), np.float32)
        left[row[~light][own], col[own] - i] = 1
        right = np.zeros((len(y), left.shape[1]), np.float32)
        n = last[i : i + 4096] - first[i : i + 4096]
        right[owner[np.repeat(first[i : i + 4096] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(n)), n)] = 1
        out += (left @ right.T).astype(out.dtype)
    return out


def unsettled(units: DataFrame) -> DataFrame:
    """The rows of units (unit, side, node, s1, s2, label) that have a pair within RADIUS of different labels in a unit."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        label = t["label"].to_numpy()
        if (label == label[0]).all():
            return t.slice(0, 0)
        sigs = np.stack([t["s1"].to_numpy(), t["s2"].to_numpy()], 1).view(U)
        x, y, same = _sides(t)
        keep = np.zeros(len(label), bool)
        for i in range(0, len(x), ROWS):
            mask = _open(sigs, label, x[i : i + ROWS], y, same)
            keep[x[i : i + ROWS]] |= mask.any(1)
            keep[y] |= mask.any(0)
        return t.filter(pa.array(keep))

    return units.groupBy("unit").applyInArrow(run, units.schema)


def linked(rows: DataFrame) -> DataFrame:
    """(a, b): labels of unsettled rows (with texts) of which two texts in a unit have a similarity of SIMILAR or more. Every pair within
    RADIUS of different labels is compared, by the shingles themselves."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        label = t["label"].to_numpy()
        sigs = np.stack([t["s1"].to_numpy(), t["s2"].to_numpy()], 1).view(U)
        data, off = buffer_of(t["text"].combine_chunks())
        sets = []
        for i, j in steps(off):
            sets += shingles(*word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i]))
        size = np.array([len(s) for s in sets])
        x, y, same = _sides(t)
        step = np.minimum(np.cumsum(size[x]) // GRAINS, len(x)) * len(x) + np.arange(len(x)) // ROWS
        found = np.zeros((0, 2), np.int64)
        other = [sets[k] for k in y]
        for own in np.split(x, np.flatnonzero(np.diff(step)) + 1):
            mask = _open(sigs, label, own, y, same)
            if mask.any():
                both = shared([sets[k] for k in own], other)
                i, j = np.nonzero(mask & (both >= SIMILAR * (size[own][:, None] + size[y][None] - both) - 1e-9))
                found = np.unique(np.concatenate([found, np.sort(np.stack([label[own[i]], label[y[j]]], 1), 1)]), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return rows.groupBy("unit").applyInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label): the smallest node of each connected component, by minimum labels and pointer jumping until nothing changes."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        step = materialise(labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label")), "labels")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = materialise(step.join(up, "label").select("node", F.least("label", "top").alias("label"), (F.least("label", "top") != F.col("old")).alias("moved")), "labels")
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def _blocks(named: DataFrame, cold: DataFrame, many: DataFrame) -> DataFrame:
    """Units of all pairs of blocks of those rows of a hot group that have too few cold shingles, and of each group of a cold minimum hash
    that is hot itself. Blocks are cut in the order of labels, so that pairs of blocks of one label, such as copies of a text, need no comparison."""
    rows, hot = _minima(named, "label")
    rows = rows.join(hot, ["r", "k1"]).join(cold.where(F.col("share") < COLD).select("node"), "node", "left_semi").select("r", "k1", "node", "s1", "s2", "label")
    rows = rows.unionByName(many.join(named, "node").select(F.lit(-1).alias("r"), F.col("unit").alias("k1"), "node", "s1", "s2", "label"))
    order = Window.partitionBy("r", "k1").orderBy("label", "node")
    rows = materialise(rows.withColumn("i", F.floor((F.row_number().over(order) - 1) / PIECE)), "pieces")
    per = materialise(rows.groupBy("r", "k1", "i").agg(F.min("label").alias("low"), F.max("label").alias("high")), "blocks")
    other = per.select("r", "k1", F.col("i").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    both = per.join(other, ["r", "k1"]).where((F.col("i") <= F.col("j")) & (F.least("low", "low_j") < F.greatest("high", "high_j")))
    both = both.select("r", "k1", "i", "j", F.xxhash64("r", "k1", "i", "j").alias("unit"))
    ends = both.select("r", "k1", "i", "unit", F.lit(0).alias("side")).union(both.where("i < j").select("r", "k1", "j", "unit", F.lit(1)))
    return rows.join(broadcast_if_small(materialise(ends, "block_pairs")), ["r", "k1", "i"]).select("unit", "side", "node", "s1", "s2", "label")


def _settled(docs: DataFrame, named: DataFrame, found: DataFrame, blocks: Callable[[DataFrame], DataFrame] | None, id_col: str, text_col: str) -> DataFrame:
    """named with the labels united of which a pair within RADIUS, not among the candidates, is alike: in the shards, and in the groups of
    hot minimum hashes, of which a shard has but a piece."""
    units = found.where("b is null").select(F.col("shard").alias("unit"), F.lit(0).alias("side"), F.col("a").alias("node"))
    units = units.join(named.select("node", "s1", "s2", "label"), "node").select("unit", "side", "node", "s1", "s2", "label")
    units = units.unionByName(blocks(named.where("worded"))) if blocks else units
    rows = materialise(unsettled(units), "unsettled")
    if not rows.limit(1).count():
        return named
    text = texts_of(docs, named, rows.select("node").distinct(), id_col, text_col).dropDuplicates(["node"])
    more = materialise(linked(rows.join(text, "node")), "more")
    if not more.limit(1).count():
        return named
    top = components(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return materialise(named.join(top, "label", "left").withColumn("label", F.coalesce("top", "label")).drop("top"), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text_key, class_id, class_rows, keep_key.

    A class is a connected component of documents whose sets of five-word shingles have a similarity of 0.8 or more; documents with the
    same words in the same order are in one class, as are all without words (null and empty texts too). class_id is the class's
    smallest doc_id (null ids are larger than others), keep_key the smallest text_key of the rows with that id, so that (class_id,
    keep_key) names one document of the class, or its repeated rows.
    """
    marks = materialise(sketches(docs, id_col, text_col).withColumn("node", F.xxhash64("n1", "n2")), "sketches")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("o")
    nodes = marks.groupBy("node").agg(one, F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("mins").alias("mins"), F.count(F.lit(1)).alias("rows"), F.first("n1").alias("n1"))
    nodes = materialise(nodes.select("node", F.col("o.doc_id").alias("doc_id"), F.col("o.text_key").alias("text_key"), "s1", "s2", "mins", "rows", ((F.col("n1") != 0)).alias("worded")), "nodes")
    worded = nodes.where("worded")
    found, blocks = materialise(searched(worded), "found"), None
    if (cold := cold_keys(docs, worded, id_col, text_col)) is not None:
        few, many = _cold_groups(worded, cold)
        found = found.unionByName(materialise(searched_cold(worded, few), "found_cold"))
        many = materialise(many, "many")

        def blocks(named: DataFrame) -> DataFrame:
            return _blocks(named, cold, many)

    pairs = materialise(found.where("b is not null").select("a", "b").distinct(), "pairs")
    edges = materialise(verified(docs, nodes, pairs, id_col, text_col), "edges")
    named = nodes.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialise(named.select("node", "doc_id", "text_key", "rows", "s1", "s2", "mins", "worded", "label"), "named")
    named = _settled(docs, named, found, blocks, id_col, text_col)
    per = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("o"), F.sum("rows").alias("class_rows"))
    per = materialise(per.select("label", F.col("o.doc_id").alias("class_id"), F.col("o.text_key").alias("keep_key"), "class_rows"), "classes")
    of_node = materialise(named.select("node", "label").join(per, "label").drop("label"), "members")
    return marks.select("doc_id", "text_key", "node").join(of_node, "node").select("doc_id", "text_key", "class_id", "class_rows", "keep_key")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id (nulls last; of rows that share it, the smallest hash of the text). All texts
    without words, null and empty ones too, are one class. Repeated rows are one row; an empty table gives an empty result; columns of any
    name stay as they are."""
    found = near_duplicates(docs)
    mine = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("text_key").eqNullSafe(F.col("keep_key")))
    kept = materialise(mine.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "kept")
    repeated = kept.where("n > 1").limit(1).count() > 0
    kept = broadcast_if_small(kept.select("doc_id", "text_key"))
    d = docs.withColumn("__text_key", F.xxhash64("text"))
    out = d.join(kept, d["doc_id"].eqNullSafe(kept["doc_id"]) & (d["__text_key"] == kept["text_key"]), "left_semi")
    if repeated:  # rows with the same id and text, down to one
        out = out.dropDuplicates(["doc_id", "__text_key"])
    return out.select(*docs.columns)


def audit(docs: DataFrame, queries: int = 64, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, int]:
    """Recall of the verified links' classes against exact search, over a bounded set of queries (smallest hashes of their ids):
    the share of documents within similarity 0.8 of a query that are in its class, and their number. Only for audits: texts of the
    queries are broadcast."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = d.orderBy(F.xxhash64("doc_id")).limit(queries).collect()
    sets = {}
    for r in asked:
        own = np.frombuffer((r.text or "").encode(), np.uint8)
        sets[r.doc_id] = shingles(*word_hashes(own, np.array([0, len(own)])))[0]
    sent = docs.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffer_of(b.column(1))
            out = []
            for i, j in steps(off):
                for k, own in zip(range(i, j), shingles(*word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])), strict=True):
                    for q, s in sent.value.items():
                        small, large = sorted((len(own), len(s)))
                        if small and small >= SIMILAR * large:
                            both = len(np.intersect1d(own, s, True))
                            if both >= SIMILAR * (len(own) + len(s) - both) - 1e-9:
                                out.append((q, b.column(0)[k].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["q", "doc_id"])

    exact = d.mapInArrow(run, "q long, doc_id long")
    cls = materialise(near_duplicates(docs, id_col, text_col).select("doc_id", "class_id"), "audit")
    got = exact.join(cls, "doc_id").join(cls.select(F.col("doc_id").alias("q"), F.col("class_id").alias("q_class")), "q")
    r = got.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("class_id") == F.col("q_class")).cast("long")).alias("hit")).first()
    return (r.hit / r.n if r.n else 1.0), r.n


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    keep = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("text_key").eqNullSafe(F.col("keep_key"))
    return out.select("doc_id", "class_id", F.col("class_rows").cast("long").alias("class_rows"), keep.alias("keep"))
