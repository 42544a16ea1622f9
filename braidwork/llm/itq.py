"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation is learned on a bounded sample so that the signs of rotated principal components are balanced binary
codes. Codes are cut into substrings, each the key of a table. Substrings lengthen with the number of vectors, and further
rotations supply more tables, so that a pair at the threshold is found with at least `sought` probability while
buckets stay small. Equal vectors collapse to one class first.

Retrieval and reranking are two steps. Only ids and codes go to the tables: a bucket keeps the vectors that have
another one within the Hamming radius of pairs at the threshold, which nearly all chance neighbours fail. The
vectors themselves go to those places alone, where pairs are decided by their cosine in double precision. A bucket reports,
for each vector, how many links it found and a forest of them, never its pairs. A pair that meets in several tables
counts in the first alone, which both sides can tell from the codes. Buckets over BLOCK rows are dealt as pairs of blocks to many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import extended, materialise
from braidwork.llm.components import connected_components

#: Sample for the rotation, rounds of ITQ, chance of finding a pair at the threshold, rows of a block.
SAMPLE, ROUNDS, SOUGHT, BLOCK = 4096, 30, 0.98, 2048
BITS = 64
#: Rows of a bucket up to which buckets are compared together, hot buckets that a task may hold, deviations that the Hamming radius allows.
SHORT, HELD_BUCKETS, DEVIATIONS = 32, 1 << 17, 4


def learn(sample: np.ndarray, rotations: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """rotations x dimensions x bits: learned rotations of the principal axes of unit vectors.

    Axes go through the origin, not the mean: vectors at a small angle then agree in most bits wherever they lie,
    while planes through the mean would cut a dense cluster in the middle whatever the rotation.
    """
    rng = np.random.default_rng(seed)
    _, _, axes = np.linalg.svd(sample, full_matrices=False)
    axes = axes[:BITS].T
    flat = sample @ axes
    out = []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ v).T
        out.append(axes @ turn)
    return np.stack(out)


def codes(x: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """rows x rotations of 64-bit codes; vectors of another length are cut or filled with zeros for their code."""
    width = projections.shape[1]
    fit = np.zeros((len(x), width))
    fit[:, : min(x.shape[1], width)] = x[:, :width]
    out = np.zeros((len(x), len(projections), BITS), np.uint8)
    for r, p in enumerate(projections):
        out[:, r, : p.shape[1]] = fit @ p > 0
    return np.packbits(out, axis=2, bitorder="little").view("<u8")[:, :, 0]


def table_shape(n: int, bits: int, threshold: float, sought: float = SOUGHT) -> tuple[int, int]:
    """(bits of a substring, tables) for n vectors of one label: about 16 a bucket, and the chance sought at the threshold."""
    size = int(min(24, bits, max(8, math.log2(max(n, 1) / 16))))
    same = (1 - math.acos(threshold) / math.pi) ** size
    return size, max(bits // size, math.ceil(math.log(1 - sought) / math.log(1 - same)))


def keys(code: np.ndarray, size: int, bits: int, tables: int) -> np.ndarray:
    """rows x tables: the substring of each table."""
    per, mask = bits // size, np.uint64((1 << size) - 1)
    return np.stack([(code[:, t // per] >> np.uint64(t % per * size)) & mask for t in range(tables)], 1)


def radius(bits: int, threshold: float) -> int:
    """Bits in which codes of vectors at the threshold may differ: the angle's share of planes, and some deviations more."""
    share = math.acos(threshold) / math.pi
    return min(bits, math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share))))


def accompanied(code: np.ndarray, starts: np.ndarray, within: int) -> np.ndarray:
    """Which rows of buckets (sorted, beginning at `starts`) have another of their bucket within the radius."""
    out, sizes = np.zeros(len(code), bool), np.diff(np.append(starts, len(code)))
    # Short buckets all at once, by steps of the sorted order; the others in blocks.
    bucket = np.repeat(np.arange(len(starts)), sizes)
    short = np.flatnonzero((sizes[bucket] > 1) & (sizes[bucket] <= SHORT))
    for d in range(1, SHORT):
        at = np.flatnonzero(bucket[short[d:]] == bucket[short[:-d]])
        if not len(at):
            break
        a, b = short[at], short[at + d]
        near = np.bitwise_count(code[a] ^ code[b]) <= within
        out[a[near]] = out[b[near]] = True
    for lo, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        own = code[lo : lo + n]
        for a in range(0, n, BLOCK):
            for b in range(a, n, BLOCK):
                near = np.bitwise_count(own[a : a + BLOCK, None] ^ own[None, b : b + BLOCK]) <= within
                if a == b:
                    np.fill_diagonal(near, False)
                out[lo + a : lo + a + BLOCK][: len(near)] |= near.any(1)
                out[lo + b : lo + b + BLOCK][: near.shape[1]] |= near.any(0)
    return out


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each position's component under the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _bucket(x: np.ndarray, substrings: np.ndarray, block: np.ndarray, cell: tuple[int, int], copies: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row found here first, root position of each row) among rows of unit vectors."""
    links, left, right = np.zeros(len(x), np.int64), [], []
    for a in range(0, len(x), BLOCK):
        for b in range(a, len(x), BLOCK):
            i, j = np.nonzero(x[a : a + BLOCK] @ x[b : b + BLOCK].T >= threshold)
            i, j = i + a, j + b
            ok = (i < j) & ((cell[0] == cell[1]) | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            for lo in range(0, len(i), 1 << 20):
                p, q = i[lo : lo + (1 << 20)], j[lo : lo + (1 << 20)]
                new = substrings[p, table] == substrings[q, table]
                for t in range(table):
                    new &= substrings[p, t] != substrings[q, t]
                p, q = p[new], q[new]
                links += np.bincount(p, copies[q], len(x)).astype(np.int64) + np.bincount(q, copies[p], len(x)).astype(np.int64)
                left.append(p)
                right.append(q)
    return links, _components(len(x), np.concatenate(left or [links[:0]]), np.concatenate(right or [links[:0]]))


def _whole_cells(batches: Iterator[pa.RecordBatch], cell: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by the columns of cell as tables that no cell goes over the end of."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = np.logical_and.reduce([(x := b.column(c).to_numpy(zero_copy_only=False)) == x[-1] for c in cell])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut or held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in cell):
            if whole := held + [b.slice(0, cut)] * (cut > 0):
                yield pa.Table.from_batches(whole)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE, sought: float = SOUGHT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Only vectors of equal labels and lengths are compared. Rows with a null label, or a vector that is null, empty,
    zero or holds null or non-finite components, link with nothing. Equal vectors link with one another and with
    the same others. Repeated rows count as vectors of their own; null ids take part but name no component that
    has another id. Extra columns are left out.
    """
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(e, lambda v: v != 0)
    fit = F.col("label").isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(True))
    rows = vectors.select("vec_id", e.cast("array<float>").alias("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else e.cast("array<double>").alias("embedding"), "label", fit.alias("_fit")).withColumns({"_a": F.xxhash64("embedding"), "_b": F.xxhash64(F.lit(1), "embedding")})
    # Equal vectors by two hashes; what a hash tells apart (a zero's sign) links as any other.
    classes = materialise(rows.where("_fit").groupBy("label", "_a", "_b").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("cls", F.monotonically_increasing_id()), "vectors")
    spark = vectors.sparkSession
    drawn = [r.embedding for r in classes.orderBy(F.xxhash64("embedding"), "cls").limit(sample).select("embedding").collect()]
    if not drawn:
        return vectors.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = int(np.bincount([len(d) for d in drawn]).argmax())
    learned = np.array([d for d in drawn if len(d) == width], np.float64)
    learned /= np.linalg.norm(learned, axis=1, keepdims=True)
    bits = min(BITS, width, max(8, len(learned)))
    most = classes.groupBy("label").count().agg(F.max("count").alias("m")).first().m
    size, tables = table_shape(most, bits, threshold, sought)
    held = spark.sparkContext.broadcast(learn(learned, -(-tables // max(1, bits // size))))

    def unit(column: pa.Array) -> list[np.ndarray]:
        out = [np.array(v.values.to_numpy(), np.float64) for v in column]
        # Scaled by the largest component first, so that no square overflows or vanishes.
        return [v / np.linalg.norm(v) for v in (v / np.abs(v).max() for v in out)]

    per, within = max(1, bits // size), radius(bits, threshold)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(b.column(at_vector))
            wide = max(map(len, x), default=0)
            padded = np.zeros((len(x), max(wide, 1)))
            for r, v in enumerate(x):
                padded[r, : len(v)] = v
            code = codes(padded, held.value).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(v) for v in x], pa.int32()), pa.array(list(code), pa.list_(pa.int64()))], [*names, "dims", "codes"])

    names, at_vector = classes.columns, classes.columns.index("embedding")
    whole = materialise(classes.mapInArrow(index, extended(classes.schema, "dims int, codes array<bigint>")), "codes")
    # A place is a bucket: label, length of the vectors, table and substring, by their hash with the table's number below it.
    code = F.element_at("codes", F.floor(F.col("table") / per).cast("int") + 1)
    substring = F.call_function("shiftrightunsigned", code, ((F.col("table") % per) * size).cast("int")).bitwiseAND(F.lit((1 << size) - 1))
    slots = whole.select("cls", "label", "dims", "codes", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table"))
    place = F.shiftleft(F.xxhash64("label", "dims", "table", substring), 16).bitwiseOR(F.col("table").cast("bigint"))
    slots = slots.select(place.alias("place"), "cls", code.alias("code"))
    hot = materialise(slots.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("place", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    n_hot = hot.count()
    if n_hot:
        block = F.pmod(F.xxhash64("cls"), F.coalesce("blocks", F.lit(1))).cast("int")
        dealt = slots.join(F.broadcast(hot) if n_hot <= HELD_BUCKETS else hot, "place", "left").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        slots = dealt.select("place", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cls", "code")
    else:
        slots = slots.select("place", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("block"), "cls", "code")
    cell = ["place", "lo", "hi"]

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches, cell):
            sig = np.stack([rows.column(c).to_numpy() for c in cell])
            starts = np.concatenate(([0], np.flatnonzero((sig[:, 1:] != sig[:, :-1]).any(0)) + 1))
            kept = accompanied(rows.column("code").to_numpy().view(np.uint64), starts, within)
            if kept.any():
                yield from rows.filter(pa.array(kept)).select([*cell, "block", "cls"]).combine_chunks().to_batches()

    met = materialise(slots.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(retrieve, "place bigint, lo int, hi int, block int, cls bigint"), "met")
    at = ["label", "dims", *cell]
    cells = met.join(whole.select("cls", "label", "dims", "embedding", "copies", "codes"), "cls").repartition(*at).sortWithinPartitions(*at)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches, at):
            sig = [rows.column(c).to_numpy() for c in at]
            cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in sig], axis=0)) + 1), rows.num_rows]
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = rows.slice(lo, hi - lo)
                col = lambda c: part.column(c).to_numpy()  # noqa: B023, E731
                x = np.stack(unit(part.column("embedding")))
                k = keys(np.stack([v.values.to_numpy() for v in part.column("codes")]).view(np.uint64), size, bits, tables)
                cls, ends, table = col("cls"), (int(col("lo")[0]), int(col("hi")[0])), int(col("place")[0]) & 0xFFFF
                links, root = _bucket(x, k, col("block"), ends, col("copies"), table, threshold)
                own = np.flatnonzero(links)
                out.append((cls[own], cls[root[own]], links[own]))
            cols = [np.concatenate(c) for c in zip(*out)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["u", "v", "n"])

    found = materialise(cells.mapInArrow(search, "u bigint, v bigint, n bigint"), "links")
    number = found.groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.select("u", "v")).withColumnRenamed("node", "cls")
    tied = classes.select("cls", "rep").join(roots, "cls")
    named = tied.join(tied.groupBy("root").agg(F.min("rep").alias("first")), "root").select("cls", "first")
    known = classes.select("cls", "label", "_a", "_b", "rep", "copies").join(number, "cls", "left").join(named, "cls", "left").select(F.col("label").alias("_l"), F.col("_a").alias("_x"), F.col("_b").alias("_y"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id"))
    linked = rows.where("_fit").select("vec_id", "label", "_a", "_b").join(known, (F.col("label") == F.col("_l")) & (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("_fit")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
