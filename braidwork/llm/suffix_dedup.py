"""Exact substring deduplication: suffix arrays of content-defined shards, built by external induced sorting.

A string of `least` bytes that starts at two places has the same grams of GRAM bytes in both, so it picks the same
gram as its minimiser (the least hash in it). Only minimisers are gathered: a hash, the document's key and a
position, about two in every `least` - GRAM bytes. A minimiser that stands at one place alone starts no repeat and
is dropped. Around each of the others the document gives its region, the bytes of all strings that have picked
it, and regions are dealt into shards by the minimiser's hash; so all copies of a string meet in one shard, whatever
documents they are in. A shard's suffixes are sorted with their common prefixes, and neighbours that share `least`
bytes at different places of the corpus are repeats. Runs of repeats go back to their documents as intervals.

Where a region stands is kept apart from its bytes: a task sends equal regions once, places stay where they are stored, and
what a shard finds in a region is joined to its places. A minimiser that very many regions share, as one in a passage of a
third of all documents, is hot: its regions differ around the passage, and its shard would be one task's. Such regions are
cut into blocks of starts. A block stays if what its strings have in common stands at two places, and is dealt by the
hash of that; inside the passage blocks are equal bytes, which collapse. Where a run of blocks ends, in any region, the
strings of the block are told apart one by one, by 128-bit hashes as equal regions and equal texts are.

Equal texts have one key, so a text that a third of all documents share sends its regions once a task. Tables that
go back to the documents are held by the tasks while they are small and joined by key beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import extended, materialise, set_aside
from braidwork.llm.induced import SEPARATOR, suffixes

#: Length of a repeat, of the grams that shards are dealt by, bytes of a shard, of its queues in memory, of held tables.
LEAST, GRAM, SHARD_BYTES, QUEUE_BYTES, HELD_BYTES = 400, 100, 1 << 20, 32 << 20, 32 << 20
#: Places of a minimiser beyond which it is hot, starts of a block.
HOT, STARTS = 1024, 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64, up to n at least."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[0] = tuple(out)
    return _powers[0]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at each position (polynomial, then mixed)."""
    up, down = _powers_to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """The least or greatest (of) of each `width` neighbours, by doubling."""
    out, done = x, 1
    while done * 2 <= width:
        out, done = of(out[:-done], out[done:]), done * 2
    rest = width - done
    return of(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(raw: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are least in some string of `least` bytes; all of those that tie."""
    if len(raw) < least:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(raw, gram)
    width = least - gram + 1
    low = _sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), width, np.maximum) == h)
    return at, h[at]


def chains(at: np.ndarray, h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers of one hash that follow within `least` bytes as one: (first, last, hash, whether there are several)."""
    order = np.lexsort((at, h))
    at, h = at[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (at[1:] - at[:-1] > least)))) if len(at) else np.empty(0, np.int64)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return at[first], at[last], h[first], last > first


def text_key(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _attached(docs: DataFrame, found: DataFrame, held_bytes: int):
    """docs with found's `blob` by the text's key: a broadcast dictionary if that is small, or None and a joined column."""
    size = found.agg(F.sum(F.octet_length("blob") + 64)).first()[0] or 0
    if size <= held_bytes:
        return docs.sparkSession.sparkContext.broadcast({bytes(r[0]): bytes(r[1]) for r in found.select("_t", "blob").toLocalIterator()}), docs.withColumn("blob", F.lit(None).cast("binary"))
    return None, _with_key(docs).join(found, "_t", "left")


def _anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(_t, at, to, h, many): the chains of all minimisers; each text once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keys, found = [], []
            for t in b.column(0):
                raw = _raw(t.as_py())
                if len(raw) < least or (key := text_key(raw)) in seen:
                    continue
                if len(seen) < 1 << 17:
                    seen.add(key)
                found.append(chains(*minimisers(np.frombuffer(raw, np.uint8), least, gram), least))
                keys += [key] * len(found[-1][0])
            if found:
                at, to, h, many = map(np.concatenate, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(at.astype(np.int32)), pa.array(to.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(many)], ["_t", "at", "to", "h", "many"])

    return docs.select("text").mapInArrow(run, "_t binary, at int, to int, h bigint, many boolean")


_ENTRY = np.dtype([("at", "<i4"), ("to", "<i4"), ("h", "<i8"), ("hot", "?")])


def _repeated_anchors(anchors: DataFrame, hot: int) -> DataFrame:
    """(_t, blob): each text's minimisers that stand at two places or more, with whether each is hot."""
    place = F.xxhash64("_t", "at")
    counted = anchors.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("many").alias("many"), F.count(F.lit(1)).alias("n"))
    repeated = counted.where((F.col("a") != F.col("b")) | F.col("many")).select("h", (F.col("n") > hot).alias("hot"))

    def pack(part: pa.Table) -> pa.Table:
        out = np.empty(part.num_rows, _ENTRY)
        for c in _ENTRY.names:
            out[c] = part.column(c).to_numpy()
        return pa.table({"_t": part.column("_t")[:1], "blob": pa.array([np.unique(out).tobytes()], pa.binary())})

    return anchors.select("_t", "at", "to", "h").join(repeated, "h").distinct().groupBy("_t").applyInArrow(pack, "_t binary, blob binary")


def _regions(docs: DataFrame, anchors: DataFrame, least: int, gram: int, held_bytes: int) -> DataFrame:
    """(h, _t, lo, region, hot), stored: for each repeated minimiser the bytes of all strings that pick it; neighbours of one hash as one."""
    held, rows = _attached(docs.select("text"), anchors, held_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            out, total = ([], [], [], [], []), 0
            for t, blob in zip(b.column(0), b.column(1)):
                raw = _raw(t.as_py())
                if len(raw) < least or (key := text_key(raw)) in seen:
                    continue
                if len(seen) < 1 << 17:
                    seen.add(key)
                found = held.value.get(key) if held else blob.as_py()
                if not found:
                    continue
                for at, to, h, hot in np.frombuffer(found, _ENTRY).tolist():
                    lo, hi = max(0, at + gram - least), min(len(raw), to + least)
                    for part, value in zip(out, (h, key, lo, raw[lo:hi], hot)):
                        part.append(value)
                    total += hi - lo
                if total > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out, total = ([], [], [], [], []), 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    names, kinds = ["h", "_t", "lo", "region", "hot"], [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()]
    regions = materialise(rows.select("text", "blob").mapInArrow(run, f"{REGION}, hot boolean"), "regions")
    if held:
        held.destroy()
    return regions


REGION = "h bigint, _t binary, lo bigint, region binary"


def starts_by_block(region: bytes, h: int, least: int, gram: int, width: int) -> list[tuple[int, int, int, int]]:
    """(block, begin of what its strings have in common, first start, end of starts) of the strings of a region that hold the gram h.

    A string belongs to the first such gram in it, and to a block by its start's distance from that; so equal strings are in
    equal blocks wherever they stand, and all strings of a block have `least` - width + 1 bytes in common.
    """
    raw = np.frombuffer(region, np.uint8)
    if len(raw) < least:
        return []
    at, out, before = np.flatnonzero(gram_hashes(raw, gram).view(np.int64) == h).tolist(), [], -1
    for p in at:
        lo, hi = max(before + 1, p - (least - gram)), min(p, len(raw) - least)
        before = p
        for block in range((p - hi) // width, (p - lo) // width + 1) if lo <= hi else ():
            out.append((block, p - block * width, max(lo, p - block * width - width + 1), min(hi, p - block * width) + 1))
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, for what makes many rows of one."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _repeated_blocks(regions: DataFrame, least: int, gram: int, width: int) -> DataFrame:
    """(core, h, _t, lo, a, b): the blocks of starts [a, b) of regions whose common bytes (core, a 128-bit hash) stand at two places.

    regions may have starts array<struct<a, b>>, the ranges to look at.
    """
    wanted = "starts" in regions.columns

    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out = ([], [], [], [], [], [])
            ranges = b.column(4).to_pylist() if wanted else [None] * b.num_rows
            for h, t, lo, region, own in zip(*(b.column(i).to_pylist() for i in range(4)), ranges):
                looked = None
                if own is not None:
                    looked = np.zeros(len(region) + 1, bool)
                    for r in own:
                        looked[r["a"] : r["b"]] = True
                for block, begin, first, end in starts_by_block(region, h, least, gram, width):
                    if looked is None or looked[first:end].any():
                        core = xxhash.xxh3_128_digest(region[begin : begin - width + 1 + least], block)
                        for part, value in zip(out, (core, h, t, lo, first, end)):
                            part.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["core", "h", "_t", "lo", "a", "b"])

    found = materialise(regions.select("h", "_t", "lo", "region", *["starts"] * wanted).mapInArrow(cores, "core binary, h bigint, _t binary, lo bigint, a int, b int"), "cores")
    place = F.xxhash64("_t", F.col("lo") + F.col("a"))
    again = found.groupBy("core").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("core")
    return materialise(_among(found, again), "blocks")


#: Hashes of blocks that tasks may hold.
HELD_CORES = 1 << 20


def _among(blocks: DataFrame, cores: DataFrame) -> DataFrame:
    """The blocks with one of these cores."""
    cores = materialise(cores, "some")
    return blocks.join(F.broadcast(cores) if cores.count() <= HELD_CORES else cores, "core", "left_semi")


def _cut(regions: DataFrame, least: int, gram: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Regions (stored) of hot minimisers as (blocks to be sorted, as regions with a shard for each core; intervals (_t, lo, hi) that are decided).

    Where a run of blocks ends in some region, its strings are decided one by one, in all regions that have the block: equal
    strings are in blocks of one core.
    """
    of = ["h", "_t", "lo"]
    blocks = _repeated_blocks(regions, least, gram, width)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for own in b.column(0).to_pylist():
                edge = {x["b"] for x in own} ^ {x["a"] for x in own}  # a start that one block begins or ends at, and no other
                out.update(x["core"] for x in own if x["a"] in edge or x["b"] in edge)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.binary())], ["core"])

    at_ends = materialise(blocks.groupBy(*of).agg(F.collect_set(F.struct("a", "b", "core")).alias("x")).select("x").mapInArrow(ends, "core binary").distinct(), "ends")
    single = blocks.join(F.broadcast(at_ends) if at_ends.count() <= HELD_CORES else at_ends, "core", "left_semi")
    inner = blocks.join(F.broadcast(at_ends) if at_ends.count() <= HELD_CORES else at_ends, "core", "left_anti")
    ranges = lambda rows, name, *more: rows.groupBy(*of).agg(F.collect_set(F.struct("a", "b", *more)).alias(name))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out = ([], [], [], [])
            for t, lo, region, inner in zip(*(b.column(i).to_pylist() for i in range(4))):
                for x in inner:
                    for part, value in zip(out, (int.from_bytes(x["core"][:8], "little", signed=True), t, lo + x["a"], region[x["a"] : x["b"] - 1 + least])):
                        part.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["h", "_t", "lo", "region"])

    sorted_ = regions.join(ranges(inner, "inner", "core"), of).select("_t", "lo", "region", "inner").mapInArrow(parts, REGION)
    looked = regions.join(ranges(single, "starts"), of)
    strings = _repeated_blocks(looked, least, gram, 1)
    return sorted_, strings.select("_t", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("a") + least).alias("hi"))


def _placed(regions: DataFrame) -> DataFrame:
    """(h, rk, _t, lo, n, region): regions named by a hash of their bytes, which only the first of a task's equal ones carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for b in _slices(batches, 2048):
            hs, raws = b.column(0).to_pylist(), b.column(3).to_pylist()
            keys, first = [], []
            for h, raw in zip(hs, raws):
                keys.append(text_key(raw))
                first.append((h, keys[-1]) not in seen)
                if len(seen) < 1 << 17:
                    seen.add((h, keys[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), b.column(1), b.column(2), pa.array([len(r) for r in raws], pa.int64()), pa.array([r if f else None for r, f in zip(raws, first)], pa.binary())], ["h", "rk", "_t", "lo", "n", "region"])

    return regions.mapInArrow(run, "h bigint, rk binary, _t binary, lo bigint, n bigint, region binary")


def _with_key(docs: DataFrame) -> DataFrame:
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text_key(_raw(t.as_py())) for t in b.column(at)], pa.binary())], [*names, "_t"])

    return docs.mapInArrow(run, extended(docs.schema, "_t binary"))


def repeats(regions: list[tuple[bytes, bytes, int, bytes]], least: int, memory: int = QUEUE_BYTES) -> list[tuple[bytes, int, int]]:
    """Different regions (name, a text they stand in, where, bytes) of one shard. Gives the intervals (name, from, to) of them covered by
    strings that start at two places of the shard."""
    some = [r for r in regions if len(r[3]) >= least]
    if not some:
        return []
    sizes = np.array([len(r[3]) + 1 for r in some])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    text = np.frombuffer(b"\0".join(r[3] for r in some) + b"\0", np.uint8).astype(np.uint16) + 1
    text[begin[1:] - 1] = SEPARATOR
    # A place of the corpus: text number and offset; the same place may be in regions of neighbouring minimisers.
    number = {key: i for i, key in enumerate(dict.fromkeys(r[1] for r in some))}
    base = np.array([(number[r[1]] << 40) + r[2] for r in some], np.int64)
    hit = np.zeros(len(text), bool)
    owner = np.repeat(np.arange(len(some)), sizes)
    for at, lcp in suffixes(text, least, memory):
        run = np.cumsum(lcp < least) - 1
        if run[-1] + 1 == len(at):
            continue
        place = base[owner[at]] + (at - begin[owner[at]])
        heads = np.flatnonzero(lcp < least)
        many = np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)
        hit[at[many[run]]] = True
    out = []
    for (name, _, _, raw), lo in zip(some, begin):
        step = np.flatnonzero(np.diff(hit[lo : lo + len(raw) - least + 1].astype(np.int8), prepend=0, append=0))
        out += [(name, a, b - 1 + least) for a, b in zip(step[::2].tolist(), step[1::2].tolist())]
    return out


def _intervals(placed: DataFrame, least: int, shard_bytes: int) -> DataFrame:
    """(rk, lo, hi): the runs of repeats in each region (stored, as _placed gives them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = {}, 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*repeats([(k, *v) for k, v in shard.items()], least))) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["rk", "lo", "hi"])

        now = None
        for b in _slices(batches, 2048):
            for h, rk, t, lo, raw in zip(*(b.column(i).to_pylist() for i in range(5))):
                if h != now and size >= shard_bytes:
                    yield out()
                    shard, size = {}, 0
                now = h
                if rk not in shard:
                    shard[rk] = (t, lo, raw)
                    size += len(raw)
        if shard:
            yield out()

    rows = placed.where(F.col("region").isNotNull()).select("h", "rk", "_t", "lo", "region")
    inside = rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "rk binary, lo bigint, hi bigint")
    # A region that stands at two places repeats throughout.
    place = F.xxhash64("_t", "lo")
    whole = placed.groupBy("rk").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("n").alias("hi")).where((F.col("x") != F.col("y")) & (F.col("hi") >= least)).select("rk", F.lit(0).cast("bigint").alias("lo"), "hi")
    return inside.unionByName(whole)


def _joined(intervals: np.ndarray) -> np.ndarray:
    """Sorted (lo, hi) rows with those that touch or overlap as one."""
    x = intervals[np.argsort(intervals[:, 0], kind="stable")]
    top = np.maximum.accumulate(x[:, 1])
    first = np.flatnonzero(np.concatenate(([True], x[1:, 0] > top[:-1])))
    return np.stack([x[first, 0], np.append(top[first[1:] - 1], top[-1])], 1)


def dedup_substrings(docs: DataFrame, least: int = LEAST, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, held_bytes: int = HELD_BYTES, hot: int = HOT) -> DataFrame:
    """docs with kept binary (the bytes that stay), n_bytes, n_removed and n_spans long in place of text.

    Every byte that lies in a string of `least` bytes which also starts elsewhere, in this document or another, is
    removed, all copies alike; strings are judged on the input. Null and empty texts have no bytes; a repeated row
    repeats its whole text. Extra columns pass; those of the result's names are replaced.
    """
    docs, back = set_aside(docs.drop("kept", "n_bytes", "n_removed", "n_spans"), "_t", "blob")
    anchors = materialise(_anchors(docs, least, gram), "anchors")
    repeated = materialise(_repeated_anchors(anchors, hot), "repeated")
    regions = _regions(docs, repeated, least, gram, held_bytes)
    own, decided = regions.where("NOT hot").drop("hot"), None
    if not (wide := regions.where("hot").drop("hot")).isEmpty():
        blocks, decided = _cut(wide, least, gram, min(STARTS, max(1, least - gram)))
        own = own.unionByName(materialise(blocks, "blocks"))
    placed = materialise(_placed(own), "placed")
    inside = materialise(_intervals(placed, least, shard_bytes).distinct(), "inside")
    found = placed.select("rk", "_t", F.col("lo").alias("base")).join(inside, "rk").select("_t", (F.col("base") + F.col("lo")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi"))
    if decided is not None:
        found = found.unionByName(decided)

    def gather(part: pa.Table) -> pa.Table:
        spans = _joined(np.stack([part.column("lo").to_numpy(), part.column("hi").to_numpy()], 1))
        return pa.table({"_t": part.column("_t")[:1], "blob": pa.array([spans.astype("<i8").tobytes()], pa.binary())})

    spans = found.distinct().groupBy("_t").applyInArrow(gather, "_t binary, blob binary")
    # Texts that several rows have repeat as a whole: marked by an interval of their own.
    lengths = _with_key(docs.select("text")).select("_t", F.octet_length("text").alias("n")).where(F.col("n") >= least)
    copies = lengths.groupBy("_t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("_t", F.lit(b"").alias("blob"))
    table = materialise(copies.unionByName(spans.join(copies.select("_t"), "_t", "left_anti")), "spans")
    names = [c for c in docs.columns if c != "text"]
    at_text = len(names)
    held, rows = _attached(docs.select(*names, "text"), table, held_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, counts = [], []
            for t, blob in zip(b.column(at_text), b.column(at_text + 1)):
                raw = _raw(t.as_py())
                own = held.value.get(text_key(raw)) if held else blob.as_py()
                if own is None:
                    kept.append(raw)
                    counts.append((len(raw), 0, 0))
                    continue
                ranges = np.frombuffer(own, "<i8").reshape(-1, 2) if own else np.array([[0, len(raw)]])
                edges = [0, *ranges.ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[lo:hi] for lo, hi in zip(edges[::2], edges[1::2])))
                counts.append((len(raw), len(raw) - len(kept[-1]), len(ranges)))
            n = list(zip(*counts)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at_text], pa.array(kept, pa.binary()), *[pa.array(c, pa.int64()) for c in n]], [*names, "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.select(*names, "text", "blob").mapInArrow(cut, extended(docs.select(*names).schema, "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")).withColumnsRenamed(back)
