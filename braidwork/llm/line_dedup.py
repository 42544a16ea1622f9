"""Line deduplication by sharded minimal perfect hashing.

One pass hashes every long line, counts its documents with map-side sums, and keeps the lines that repeat.
Their 64-bit hashes are dealt into shards of bounded size; each shard gets a minimal perfect hash (levels of
collision-free bit arrays) that indexes compact arrays: a second, independent 64-bit fingerprint, the number of
documents and the largest holder. A second pass over the documents probes the arrays, so lines are never
joined and text is never shuffled. A line that is not in the index hits a foreign slot and fails its
fingerprint; keys are 128 bits in all.

If all shards together are within `broadcast_bytes` each task holds them. Beyond it probes travel to the
shards: (hash, fingerprint, document) rows stream past one shard at a time, each shard standing on `salts`
partitions so that a line found in every document doesn't meet in one task. A line that many documents of a batch hold is
one probe with a list of its places; only the hits come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.llm.common import extended, materialise

#: Keys of one shard, bits a key at each level of the hash, bytes of index that tasks may hold.
SHARD_KEYS, GAMMA, BROADCAST_BYTES, SALTS = 500_000, 2, 64 << 20, 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
NOBODY = -(2**63)


def _level_hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """A position below `size` for each key, independent from level to level (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = keys + _MIX[0] * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        x ^= x >> np.uint64(31)
    return x % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash of distinct uint64 keys: each level keeps the keys that are alone at their position."""

    def __init__(self, levels: list[np.ndarray], tail: np.ndarray):
        self.levels, self.tail, self.ranks, base = levels, tail, [], 0
        for bits in levels:  # bits: one byte each while building, packed words after
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(base + np.concatenate(([0], np.cumsum(ones)[:-1])))
            base += int(ones.sum())
        self.base = base

    @staticmethod
    def build(keys: np.ndarray, most_levels: int = 48) -> PerfectHash:
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left) and len(levels) < most_levels:
            size = -(-len(left) * GAMMA // 64) * 64
            at = _level_hash(left, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return PerfectHash(levels, np.sort(left))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; a key that was never put in gets any index or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = _level_hash(keys[todo], n, len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = ranks[word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
        if len(self.tail) and len(todo):
            at = np.minimum(np.searchsorted(self.tail, keys[todo]), len(self.tail) - 1)
            out[todo] = np.where(self.tail[at] == keys[todo], self.base + at, -1)
        return out


class Shard:
    """The arrays of one shard: perfect hash, fingerprints, numbers of documents, largest holders; and lines whose key another line has."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray, holders: np.ndarray, clashes: tuple[np.ndarray, ...]):
        self.hash, self.prints, self.counts, self.holders, self.clashes = hash_, prints, counts, holders, clashes

    @staticmethod
    def build(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, holders: np.ndarray) -> Shard:
        distinct, first = np.unique(keys, return_index=True)
        rest = np.setdiff1d(np.arange(len(keys)), first)
        h = PerfectHash.build(distinct)
        order = first[np.argsort(h(distinct))]
        return Shard(h, prints[order], counts[order], holders[order], (keys[rest], prints[rest], counts[rest], holders[rest]))

    def dump(self) -> bytes:
        arrays = [*self.hash.levels, self.hash.tail, self.prints, self.counts, self.holders, *self.clashes]
        return b"".join(p.tobytes() for p in (np.array([len(self.hash.levels), *map(len, arrays)], np.int64), *arrays))

    @staticmethod
    def load(blob: bytes) -> Shard:
        n_levels = int(np.frombuffer(blob, np.int64, 1)[0])
        sizes = np.frombuffer(blob, np.int64, n_levels + 8, 8)
        at, parts = 8 * (n_levels + 9), []
        for size in sizes:
            parts.append(np.frombuffer(blob, np.uint64, size, at))
            at += 8 * size
        tail, prints, counts, holders, *clashes = parts[n_levels:]
        return Shard(PerfectHash(parts[:n_levels], tail), prints, counts.view(np.int64), holders.view(np.int64), (*clashes[:2], *(c.view(np.int64) for c in clashes[2:])))

    def look_up(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each line how many documents hold it (0: it isn't in the index), and the largest of them."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = self.hash(keys)
        counts, holders = np.where((at >= 0) & (self.prints[at] == prints), self.counts[at], 0), self.holders[at]
        for key, print_, count, holder in zip(*self.clashes):
            same = (keys == key) & (prints == print_)
            counts, holders = np.where(same, count, counts), np.where(same, holder, holders)
        return counts, holders


def keyed_lines(text: str, least: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """A text's lines; the numbers of those whose key has `least` code points; these keys' 16-byte hashes."""
    raw = text.encode("utf-8", "surrogatepass")
    lines, at, keys = raw.split(b"\n"), [], []
    for i, line in enumerate(lines):
        if len(line) >= least:
            key = line.strip().lower()  # bytes: the six ASCII white-space characters, A-Z alone
            if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                at.append(i)
                keys.append(xxhash.xxh3_128_digest(key))
    return lines, at, keys


def _split(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of 16-byte hashes."""
    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def line_counts(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(h1, h2, n, holder) of the lines found in at least `least_docs` documents."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, ids = [], []
            for i, t in zip(b.column(0), b.column(1)):
                own = set(keyed_lines(t.as_py() or "", least_chars)[2]) if t.is_valid else ()
                h += own
                ids += [i.as_py()] * len(own)
            h1, h2 = _split(h)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    lines = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(hashed, "h1 bigint, h2 bigint, doc_id bigint")
    return lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= least_docs).select("h1", "h2", "n", F.coalesce("holder", F.lit(NOBODY)).alias("holder"))


def build_shards(lines: DataFrame, n_shards: int) -> DataFrame:
    """(shard, blob): the arrays of each shard of the index."""

    def one(part: pa.Table) -> pa.Table:
        col = lambda c, t: part.column(c).to_numpy().view(t)
        blob = Shard.build(col("h1", np.uint64), col("h2", np.uint64), col("n", np.int64), col("holder", np.int64)).dump()
        return pa.table({"shard": pa.array([part.column("shard")[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    dealt = lines.withColumn("shard", F.pmod(F.shiftright("h1", 40), F.lit(n_shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(one, "shard int, blob binary")


def _shard_of(h1: np.ndarray, n_shards: int) -> np.ndarray:
    return np.mod(h1.view(np.int64) >> np.int64(40), n_shards)


def _dropped(keys: list[bytes], doc_ids: np.ndarray, blobs: dict[int, Shard], n_shards: int, least_docs: int) -> np.ndarray:
    """Which lines (of these documents, line by line) go: held by enough documents, the largest another one."""
    h1, h2 = _split(keys)
    shard, out = _shard_of(h1, n_shards), np.zeros(len(keys), bool)
    for s in np.unique(shard):
        if s in blobs:
            own = np.flatnonzero(shard == s)
            count, holder = blobs[s].look_up(h1[own], h2[own])
            out[own] = (count >= least_docs) & (holder != doc_ids[own]) & (holder != NOBODY)
    return out


def _cut(text: str | None, drop: set[int]) -> tuple[str | None, int]:
    """The text without these lines, and how many lines it had."""
    lines = (text or "").split("\n")
    return (text if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop)), len(lines)


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with each text cut to the lines it keeps, plus n_lines and n_dropped long.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least `least_chars`
    code points that at least `least_docs` rows hold lose all their lines but those of the largest doc_id that
    holds them. Rows are documents: a repeated row counts again, and rows with the largest doc_id all keep the
    line. A null doc_id is below any other and never the holder; if only null ids hold a line it stays. A null
    text stays null and counts as one empty line. Other columns pass; n_lines and n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    index = materialise(line_counts(docs, least_chars, least_docs), "lines")
    n = index.count()
    n_shards = max(1, -(-n // SHARD_KEYS))
    if n * 32 <= broadcast_bytes:
        return _probe_held(docs, index, n_shards, least_chars, least_docs)
    return _probe_sent(docs, index, n_shards, least_chars, least_docs)


def _probe_held(docs: DataFrame, index: DataFrame, n_shards: int, least: int, least_docs: int) -> DataFrame:
    """Every task holds all shards, whose size has been checked."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in build_shards(index, n_shards).toLocalIterator()})
    names, at_id, at_text = docs.columns, docs.columns.index("doc_id"), docs.columns.index("text")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = {s: Shard.load(b) for s, b in held.value.items()}
        for b in batches:
            texts, ids = b.column(at_text).to_pylist(), b.column(at_id).to_pylist()
            keys, owner, at = [], [], []
            for i, t in enumerate(texts):
                _, where, own = keyed_lines(t or "", least)
                keys += own
                at += where
                owner += [i] * len(own)
            lost: dict[int, set[int]] = {}
            if keys and blobs:
                of = np.array([NOBODY if i is None else i for i in ids], np.int64)[owner]
                for k in np.flatnonzero(_dropped(keys, of, blobs, n_shards, least_docs)):
                    lost.setdefault(owner[k], set()).add(at[k])
            cut = [_cut(t, lost.get(i, set())) for i, t in enumerate(texts)]
            columns = list(b.columns)
            columns[at_text] = pa.array([c[0] for c in cut], b.schema.field(at_text).type)
            columns += [pa.array([c[1] for c in cut], pa.int64()), pa.array([len(lost.get(i, ())) for i in range(len(cut))], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"])

    return docs.mapInArrow(probe, extended(docs.schema, "n_lines bigint, n_dropped bigint"))


def _probe_sent(docs: DataFrame, index: DataFrame, n_shards: int, least: int, least_docs: int, salts: int = SALTS) -> DataFrame:
    """Probes stream past the shards; the line numbers that go come back to their documents."""
    keyed = docs.withColumn("_row", F.struct(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("t")))

    place = T.StructType.fromDDL("id bigint, t bigint, line int")
    places = pa.list_(pa.struct([("id", pa.int64()), ("t", pa.int64()), ("line", pa.int32())]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[bytes, list[tuple[int, int]]] = {}
            for i, t in enumerate(b.column(1).to_pylist()):
                _, where, own = keyed_lines(t or "", least)
                for line, key in zip(where, own):
                    held.setdefault(key, []).append((i, line))
            if not held:
                continue
            h1, h2 = _split(list(held))
            owner, line = np.array([x for own in held.values() for x in own], np.int64).T
            rows = b.column(0).take(pa.array(owner))
            flat = pa.StructArray.from_arrays([rows.field(0), rows.field(1), pa.array(line.astype(np.int32))], ["id", "t", "line"])
            edges = np.concatenate(([0], np.cumsum([len(own) for own in held.values()]))).astype(np.int32)
            salt = (pc.fill_null(rows.field(0), 0).to_numpy()[edges[:-1]] + (h2.view(np.int64) >> 8)) % salts
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(h1, n_shards).astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array(edges), flat)], ["shard", "salt", "h1", "h2", "places"])

    kind = "shard int, salt int, h1 bigint, h2 bigint, places array<struct<id:bigint,t:bigint,line:int>>"
    probes = keyed.select("_row", "text").mapInArrow(ask, kind).withColumn("blob", F.lit(None).cast("binary"))
    blobs = build_shards(index, n_shards).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = probes.unionByName(blobs, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            shard, blob = b.column(0).to_numpy(), b.column(5)
            starts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | blob.is_valid().to_numpy(zero_copy_only=False)[1:]) + 1), len(shard)]
            for lo, hi in zip(starts, starts[1:]):
                if hi <= lo:
                    continue
                if blob[lo].is_valid:
                    now, held = shard[lo], Shard.load(blob[lo].as_py())
                    lo += 1
                if lo < hi and now == shard[lo]:
                    part = b.slice(lo, hi - lo)
                    count, holder = held.look_up(part.column(2).to_numpy().view(np.uint64), part.column(3).to_numpy().view(np.uint64))
                    known = np.flatnonzero((count >= least_docs) & (holder != NOBODY))
                    own = part.column(4).take(pa.array(known))
                    sizes, flat = pc.list_value_length(own).to_numpy(), own.flatten()
                    stays = flat.field(0).fill_null(NOBODY).to_numpy() == np.repeat(holder[known], sizes)
                    yield pa.RecordBatch.from_arrays([flat.field(i) for i in range(3)], ["id", "t", "line"]).filter(pa.array(~stays))

    found = both.select("shard", "salt", "h1", "h2", "places", "blob").mapInArrow(answer, place)
    lost = found.groupBy(F.struct("id", "t").alias("_row")).agg(F.collect_set("line").alias("_lost"))
    joined = keyed.join(lost.withColumnRenamed("_row", "_of"), F.col("_row").eqNullSafe(F.col("_of")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_lost", i)), "\n")
    return joined.select(*[F.when(F.col("_lost").isNull(), F.col(c)).otherwise(kept).alias(c) if c == "text" else c for c in docs.columns], F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(F.size("_lost"), F.lit(0)).cast("bigint").alias("n_dropped"))
