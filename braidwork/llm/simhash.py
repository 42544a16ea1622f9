"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints collapse to one row before anything is compared, so copies cost a count. Distinct ones are
indexed under every choice of two of their four 16-bit quarters: two fingerprints with at most two differing
bits agree in at least two quarters, so they meet under one of six keys. Rows sorted by key stream through a
comparer that stores a block's bit planes vertically (one bit a row, 64 planes) and updates the distances of
all rows of the block to a query at once with carry-save counters: `ones`, `twos` and a sticky overflow. Work
on a block ends when all its counters have passed the radius. A key that many rows share is compared in blocks
of bounded size, and what leaves a key is a forest (a row per linked fingerprint), never its pairs; the
components of the forests are those of the pairs. A hot key's rows fall into blocks, and each pair of blocks is a cell
that any task compares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.llm.common import extended, materialise
from braidwork.llm.components import connected_components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Queries compared at once against a block, and rows of a block.
QUERIES, BLOCK = 64, 4096
QUARTERS = tuple(combinations(range(4), 2))
#: Rows of a key beyond which it is dealt as pairs of blocks (fingerprints; rows whose sets are compared), hot keys that a task may hold.
HOT_PRINTS, HOT_SETS, HELD_KEYS = 1 << 16, 1 << 12, 1 << 17


def _majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes."""
    counts, bits = np.zeros(64, np.int64), hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(bits), 16384):
        counts += np.unpackbits(bits[lo : lo + 16384], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """SimHash over 3-word shingles, repeats included; without words zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return h(b" ".join(words), SEED)
    join = b" ".join
    return _majority(np.array([h(join(s), SEED) for s in zip(words, words[1:], words[2:])], np.uint64))


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of text as a (signed) long; null texts have no words; a column of this name is replaced."""
    docs = docs.drop(name)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py()) for t in b.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found.view(np.int64))], [*names, name])

    return docs.mapInArrow(run, extended(docs.schema, f"{name} bigint"))


def planes(fingerprints: np.ndarray) -> np.ndarray:
    """bits x words: bit r of plane p is bit p of fingerprint r (rows x 64-bit words)."""
    bits = np.unpackbits(np.ascontiguousarray(fingerprints, "<u8").view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], -(-len(bits) // 64) * 64), np.uint8)
    padded[:, : len(bits)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the rows of a block of planes within `radius` bits of each query (rows x words).

    Carry-save: a differing bit goes into the first counter plane, its carry into the next, a carry out of the last
    into a sticky overflow. Every sixteen planes the block is given up if all its counters have overflowed.
    """
    counters = [np.zeros((len(queries), block.shape[1]), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros_like(counters[0])
    for p in range(len(block)):
        flip = np.uint64(0) - ((queries[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1))
        carry = block[p] ^ flip[:, None]
        for c in counters:
            c ^= carry
            carry &= ~c  # it carries where the bit was set before, so is clear now
        over |= carry
        if p % 16 == 15 and (over == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
            break
    near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
    q, row = np.nonzero(near)
    word, bit, distance = row // 64, (row % 64).astype(np.uint64), np.zeros(len(q), np.int64)
    for k, c in enumerate(counters):
        distance += ((c[q, word] >> bit) & np.uint64(1)).astype(np.int64) << k
    ok = distance <= radius
    return q[ok], row[ok], distance[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the pairs make a spanning forest of least distances over positions 0..n-1."""
    root, chosen = np.arange(n), []
    order = np.argsort(distance, kind="stable")
    while len(order):
        order = order[root[i[order]] != root[j[order]]]
        step, order = order[:4096], order[4096:]
        up = dict(zip(root[i[step]].tolist(), root[i[step]].tolist())) | dict(zip(root[j[step]].tolist(), root[j[step]].tolist()))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for k, a, b in zip(step.tolist(), root[i[step]].tolist(), root[j[step]].tolist()):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                chosen.append(k)
        to = np.arange(n)
        for x in up:
            to[x] = find(x)
        root = to[root]
    return np.array(chosen, np.int64)


#: Runs up to this length are compared together with others.
SHORT = 64


def _met(f: np.ndarray, key: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Rows (x words) sorted by key, keys whole: all pairs of a key within the radius, in blocks.

    Gives positions, distances and, where a block is of one long key, the key's first position and number of rows (else zeros).
    """
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    sizes = np.diff(starts)
    # Many short keys at once: pairs at each step d of the sorted order; their differences are a block of planes, and
    # its distances to zero are those of the pairs.
    short = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT), sizes))
    zero = np.zeros((1, f.shape[1]), np.uint64)
    own = key[short]
    for d in range(1, SHORT):
        at = np.flatnonzero(own[d:] == own[:-d])
        if not len(at):
            break
        for lo in range(0, len(at), BLOCK * 4):
            a, b = short[at[lo : lo + BLOCK * 4]], short[at[lo : lo + BLOCK * 4] + d]
            _, row, distance = within(zero, planes(f[a] ^ f[b]), radius)
            row, distance = row[row < len(a)], distance[row < len(a)]
            yield a[row], b[row], distance, 0, 0
    for lo, n in zip(starts[:-1][sizes > SHORT], sizes[sizes > SHORT]):
        for b in range(0, n, BLOCK):
            block = planes(f[lo + b : lo + min(b + BLOCK, n)])
            for q in range(0, min(n, b + BLOCK), QUERIES):
                i, j, distance = within(f[lo + q : lo + min(q + QUERIES, n)], block, radius)
                ok = (q + i < b + j) & (b + j < n)
                yield lo + q + i[ok], lo + b + j[ok], distance[ok], int(lo), int(n)


#: Pairs of a long key that are held before a forest is taken of them.
HELD_PAIRS = 1 << 20


def compare(f: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x words) sorted by key, keys whole: positions of pairs that span the pairs within the radius of each key."""
    left, right, far = [], [], []
    own, held, of = [], 0, (0, 0)

    def span_own() -> None:
        x, y, z = map(np.concatenate, zip(*own))
        span = forest(of[1], x - of[0], y - of[0], z)
        left.append(x[span])
        right.append(y[span])
        far.append(z[span])

    for x, y, z, lo, n in _met(f, key, radius):
        if own and (of != (lo, n) or held > HELD_PAIRS):
            span_own()
            own, held = [], 0
        if n:
            own.append((x, y, z))
            held, of = held + len(x), (lo, n)
        else:
            left.append(x)
            right.append(y)
            far.append(z)
    if own:
        span_own()
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y, z = map(np.concatenate, (left, right, far))
    # The least distances come first, so a pair that is left out is joined by nearer ones.
    span = forest(len(f), x, y, z)
    return x[span], y[span]


def untested(f: np.ndarray, key: np.ndarray, group: np.ndarray, size: np.ndarray, of: np.ndarray, radius: int, similarity: float, masks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by key, keys whole, with the tables that they are of: all pairs within the radius that are of different groups.

    Pairs whose sets' sizes rule the similarity out are passed over. A pair comes from the first of the tables (masks: tables x words) it agrees in.
    """
    for x, y, _, _, _ in _met(f, key, radius):
        ok = (group[x] != group[y]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9)
        x, y = x[ok], y[ok]
        table, differ, first = of[x], f[x] ^ f[y], np.ones(len(x), bool)
        for n in range(int(table.max()) if len(x) else 0):
            first &= (table <= n) | ((differ & masks[n]) != 0).any(1)
        if first.any():
            yield x[first], y[first]


def _streamed(batches: Iterator[pa.RecordBatch], words: int, find: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]], members: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches (key, id, word..., other...) sorted by key: edges (u, v) of the ids whose positions find(words, key, other...) gives, key by key.

    With `members` no pairs leave, only (key, id) of the rows in some pair, as often as blocks give them.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> Iterator[pa.RecordBatch]:
        key, ids, f, *other = (np.concatenate(x) for x in zip(*held))
        for u, v in find(f, key, *other):
            if members and len(u):
                at = np.unique(np.concatenate((u, v)))
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(ids[at])], ["key", "id"])
            elif len(u):
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        key, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
        f = np.stack([b.column(2 + w).to_numpy().view(np.uint64) for w in range(words)], 1)
        cols = (key, ids, f, *(b.column(c).to_numpy() for c in range(2 + words, b.num_columns)))
        cut = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
        if cut:
            held.append(tuple(c[:cut] for c in cols))
        if held and (cut or held[-1][0][-1] != key[-1]):
            yield from out()
            held = []
        held.append(tuple(c[cut:] for c in cols))
    if held:
        yield from out()


def hot_keys(rows: DataFrame, most: int) -> DataFrame | None:
    """(key, _blocks) of the keys that over `most` rows share, or None."""
    hot = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("_blocks")), "hot")
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= HELD_KEYS else hot


def dealt(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows (key, id, ...) by cells: a hot key's rows go to every pair of blocks with their own, under a key of that pair.

    Should two cells have the same key, their rows are compared as well, which changes nothing where pairs are decided by what they hold.
    """
    if hot is None:
        return rows
    n = F.coalesce("_blocks", F.lit(1))
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    cells = rows.join(hot, "key", "left").withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    key = F.when(F.col("_blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(own, "_other"), F.greatest(own, "_other")))
    return cells.withColumn("key", key).select(*rows.columns)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, hot_rows: int = HOT_PRINTS) -> DataFrame:
    """prints (fingerprint long, distinct). Gives edges (u, v) whose components are those of all pairs within the radius."""
    f = F.col("fingerprint")
    quarter = lambda k: F.shiftrightunsigned(f, 16 * k).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*[(F.lit(n).cast("bigint") * (1 << 32)) + quarter(a) * (1 << 16) + quarter(b) for n, (a, b) in enumerate(QUARTERS)])
    keyed = prints.select(F.explode(keys).alias("key"), F.col("fingerprint").alias("id"), "fingerprint")
    rows = dealt(keyed, hot_keys(keyed, hot_rows)).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(lambda batches: _streamed(batches, 1, lambda f, key: [compare(f, key, radius)]), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint long, component_id): fingerprints within `radius` bits link; the least doc_id reachable.

    Documents without words have fingerprint zero and link like any other. Repeated rows are two documents of
    one id. A null doc_id takes part and is reported, but names a component only if that has no other id.
    """
    prints = materialise(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fingerprint"), "simhash")
    each = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(each.select("fingerprint"), radius))
    rooted = each.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint").select("fingerprint", "root", "least")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fingerprint", "component_id")
    own = each.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(own, "fingerprint").select("doc_id", "fingerprint", "component_id")


# Similarity of five-word shingle sets: fingerprints of 128 bits find candidates, the sets decide.

WORDS, WIDE = 5, 2
#: Rows that a key of a table should have, the chance sought of meeting in one of the tables, deviations that the radius allows.
ROWS_A_KEY, SOUGHT, DEVIATIONS = 48, 0.9995, 3
#: Shingles up to which a set is joined exactly: in so small sets bits differ more often than the angle says.
FEW = 24


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """The distinct shingles' 128-bit hashes as sorted rows of two words (fewer words: the whole sequence; none: no row)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty((0, WIDE), np.uint64)
    join, h = b" ".join, xxhash.xxh3_128_digest
    found = {h(join(w)) for w in zip(*(words[k:] for k in range(size)))} if len(words) >= size else {h(join(words))}
    return np.frombuffer(b"".join(sorted(found)), np.uint64).reshape(-1, WIDE)


def table_bits(n: int, similarity: float) -> tuple[int, int, int]:
    """(bits of a key, tables, radius) for n rows at a Jaccard similarity: the angle of the sets gives the chance that a bit agrees."""
    agree = 1 - np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    bits = int(min(40, max(8, np.log2(max(n, 1) / ROWS_A_KEY))))
    size = 64 * WIDE
    radius = size * (1 - agree) + DEVIATIONS * np.sqrt(size * agree * (1 - agree))
    return bits, int(np.ceil(np.log(1 - SOUGHT) / np.log(1 - agree**bits))), min(size // 2 - 1, int(np.ceil(radius)))


def similar_documents(docs: DataFrame, similarity: float = 0.8, seed: int = 3, hot_rows: int = HOT_SETS) -> DataFrame:
    """(doc_id, component_id): documents whose sets of five-word shingles have a Jaccard similarity of `similarity` or more link.

    Equal sets are one class. Classes meet under random choices of fingerprint bits and are compared bit-sliced.
    First each key hands on the pairs of least distance that span its candidates, whose sets are compared exactly. Then
    the sets of all rows that have a candidate in another component go to the keys they have it under and are compared
    there, so no pairs are listed. Sets of few shingles are compared under the least of their shingles, which similar
    sets share. Documents without words are one class. Null ids name a component only if it has no other.
    """
    sketch = lambda batches: (_sketched(b, similarity) for b in batches)
    prints = materialise(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sketch, "doc_id bigint, own bigint, own2 bigint, f0 bigint, f1 bigint, n bigint, few array<bigint>"), "sketch")
    # The class is named by its least document; hashes of the whole set tell classes apart.
    classes = materialise(prints.groupBy("own", "own2").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("f0", "f1", "n", "few")]), "classes")
    bits, tables, radius = table_bits(classes.count(), similarity)
    rng = np.random.default_rng(seed)
    chosen = [sorted(rng.choice(64 * WIDE, bits, replace=False).tolist()) for _ in range(tables)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.stack([b.column(1 + w).to_numpy() for w in range(WIDE)], 1)
            own = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
            for n, places in enumerate(chosen):
                key = (own[:, places] << np.arange(bits)).sum(1) | (n << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns, pa.array(np.full(b.num_rows, n))], ["key", *b.schema.names, "table"])

    def in_tables(named: DataFrame) -> DataFrame:
        return named.mapInArrow(keyed, T.StructType([T.StructField("key", T.LongType()), *named.schema.fields, T.StructField("table", T.LongType())]))

    def met(named: DataFrame, find: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]], members: bool = False) -> DataFrame:
        rows = dealt(in_tables(named), hot).repartition("key").sortWithinPartitions("key")
        return rows.mapInArrow(lambda batches: _streamed(batches, WIDE, find, members), "key bigint, id bigint" if members else "u bigint, v bigint")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py())[:, 0].view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "s"])

    def sets_of(ids: DataFrame) -> DataFrame:
        needed = materialise(ids.distinct(), "needed")  # stored: its size is known
        return docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(needed, "id", "left_semi").mapInArrow(sets, "id bigint, s array<bigint>").dropDuplicates(["id"])

    def similar(pairs: DataFrame) -> DataFrame:
        texts = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("id")))
        both = pairs.join(texts.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v")

    named = classes.where(F.col("id").isNotNull())
    small = named.where(F.size("few") > 0).select(F.explode(F.slice("few", F.lit(1), _prefix(F.col("n"), similarity))).alias("key"), "id", F.col("few").alias("s"))

    def compared(rows: DataFrame, keys: DataFrame) -> DataFrame:
        return dealt(rows, hot_keys(keys.select("key"), hot_rows)).repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _exact_links(batches, similarity), "u bigint, v bigint")

    hot = hot_keys(in_tables(named.select("id", "f0", "f1")).select("key"), hot_rows)
    nearest = materialise(met(named.select("id", "f0", "f1"), lambda f, key, of: [compare(f, key, radius)]).distinct(), "candidates")
    links = materialise(similar(nearest).unionByName(compared(small, small)), "links")
    # What the forests left out: pairs of a key that no link so far connects.
    masks = np.zeros((tables, 64 * WIDE), np.uint8)
    for n, places in enumerate(chosen):
        masks[n, places] = 1
    masks = np.packbits(masks, axis=1, bitorder="little").view("<u8")
    grouped = named.join(connected_components(links).select(F.col("node").alias("id"), "root"), "id", "left").select("id", "f0", "f1", F.coalesce("root", "id").alias("g"), "n")
    others = materialise(met(grouped, lambda f, key, group, size, of: untested(f, key, group, size, of, radius, similarity, masks), members=True).distinct(), "others")
    links = links.unionByName(compared(others.join(sets_of(others.select("id")), "id").select("key", "id", "s"), others))
    roots = connected_components(links)
    own = classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("own", "own2", F.coalesce("root", "id").alias("component_id"))
    return prints.join(own, ["own", "own2"]).select("doc_id", "component_id")


def _prefix(n: Column, similarity: float) -> Column:
    """How many of its least shingles a set of n is found by: similar sets share one of them, whatever else they hold."""
    return (n - F.ceil(n * similarity - 1e-9) + 1).cast("int")


def _exact_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Batches (key, id, set) sorted by key: edges (u, v) that span each key's pairs of that similarity, by exact counts."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (s.values.to_numpy() for s in b.column(2))))
    for _, run in groupby(rows, key=lambda r: r[0]):
        own = list(run)
        if len(own) < 2:
            continue
        sizes = np.array([len(r[2]) for r in own])
        owner, (_, token) = np.repeat(np.arange(len(own)), sizes), np.unique(np.concatenate([r[2] for r in own]), return_inverse=True)
        order = np.argsort(token, kind="stable")
        posting = np.split(owner[order], np.flatnonzero(np.diff(token[order])) + 1)
        begin, up = np.concatenate(([0], np.cumsum(sizes))), np.arange(len(own))
        u, v = [], []
        for i in range(len(own)):
            shared = np.bincount(np.concatenate([posting[t] for t in token[begin[i] : begin[i + 1]]]), minlength=len(own))
            near = np.flatnonzero(shared >= similarity * (sizes[i] + sizes - shared))
            # Every row points at its group's name; one edge a group that joins.
            names, at = np.unique(up[near], return_index=True)
            for name, k in zip(names.tolist(), near[at].tolist()):
                if name != up[i]:
                    u.append(own[i][1])
                    v.append(own[k][1])
            up[np.isin(up, names)] = up[i]
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _sketched(b: pa.RecordBatch, similarity: float) -> pa.RecordBatch:
    """(doc_id, hash of the shingle set in two words, 128-bit SimHash of the set in two words, its size, the set if it is small)."""
    few, sizes = [], np.zeros(b.num_rows, np.int64)
    out = np.zeros((b.num_rows, 2 + WIDE), np.uint64)
    for i, t in enumerate(b.column(1)):
        s = shingle_set(t.as_py())
        sizes[i] = len(s)
        few.append(s[:, 0].view(np.int64) if len(s) <= FEW / similarity else [])
        out[i, :2] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.uint64)
        if len(s):
            out[i, 2:] = [_majority(s[:, w]) for w in range(WIDE)]
    return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[:, k].view(np.int64)) for k in range(2 + WIDE)], pa.array(sizes), pa.array(few, pa.list_(pa.int64()))], ["doc_id", "own", "own2", "f0", "f1", "n", "few"])


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar_documents: the one whose doc_id names it; columns as they are.

    Of repeated rows of one doc_id the least stays, by text and then by all columns. Rows with a null doc_id can't be told from each other and stay.
    """
    groups = materialise(similar_documents(docs, similarity), "groups")
    # What goes is the smaller part, so texts are shuffled only if there is much of it.
    gone = materialise(groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "gone")
    repeated = materialise(groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"), "repeated")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.coalesce("text", F.lit("")), F.xxhash64(F.to_json(row)))).alias("_row")).select("_row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
