"""Graph operators over edges (src, dst): src must come before dst.

A graph of up to SMALL edges, a size that is counted first, is walked in numpy: by one task where one pass over the whole
graph is the work, or by all tasks, each with the edges, where every node has a walk of its own. A larger one falls into what its edges
join either way (`weak_components`): pieces of up to SMALL edges are walked in numpy, many at a time in every task. In larger pieces loops
run a Spark job a step over frontiers that shrink and cut their lineage in the shared folder. All ways give the same rows, and no node list
of a large graph ever reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions.text import dirname
from braidwork.operators.claims import ancestors
from braidwork.plans.session import cut_lineage

#: Edges up to which a graph, or a piece of a larger one, is walked in numpy, unless a call says another number (0: always by joins).
SMALL = 1 << 20
#: Rows that a task gathers of whole pieces before it walks them.
GATHERED = 1 << 17


def _is_small(edges: DataFrame, small: int | None) -> bool:
    return edges.count() <= (SMALL if small is None else small)


def _coded(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """src and dst of a table of edges as numbers of the ids, which are in order."""
    both = pa.chunked_array([*table.column("src").chunks, *table.column("dst").chunks], table.column("src").type)
    code, ids = pd.factorize(both.to_pandas(), sort=True)
    return code[: table.num_rows], code[table.num_rows :], pa.array(ids, both.type)


def _adjacent(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, after): what follows node i is after[first[i]:first[i + 1]], in order."""
    order = np.lexsort((dst, src))
    return np.searchsorted(src[order], np.arange(n + 1)), dst[order]


def _follow(first: np.ndarray, after: np.ndarray, at: np.ndarray) -> np.ndarray:
    """All that follows the nodes `at`, with repeats."""
    n = first[at + 1] - first[at]
    return after[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _in_one_task(edges: DataFrame, run: Callable[[pa.Table], dict[str, pa.Array]], schema: T.StructType) -> DataFrame:
    """run over all of a small graph's edges (stored)."""
    names = schema.names

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            out = run(pa.Table.from_batches(held))
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

    return edges.coalesce(1).mapInArrow(whole, schema)


def _in_pieces(rows: DataFrame, keys: list[str], by: list[str], run: Callable[[pa.Table], dict[str, pa.Array]], schema: T.StructType) -> DataFrame:
    """run over rows, some pieces at a time and each whole: what the keys say together. In a piece rows are in the order of the columns `by`."""
    names = schema.names

    def walked(table: pa.Table) -> pa.RecordBatch:
        out = run(table)
        return pa.RecordBatch.from_arrays([out[c] for c in names], names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, GATHERED
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                table = pa.Table.from_batches(held)
                same = None
                for c in keys:
                    own = pc.equal(table.column(c), table.column(c)[n - 1])
                    same = own if same is None else pc.and_(same, own)
                if cut := pc.index(same, True).as_py():
                    yield walked(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut  # the last piece may go on
                most = max(GATHERED, 2 * n)
        if n:
            yield walked(pa.Table.from_batches(held))

    return _dealt(rows, *keys).sortWithinPartitions(*keys, *by).mapInArrow(pieces, schema)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by key over as many tasks as shuffles have: Spark would put slim rows into few, however long they are walked."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _joined(table: pa.Table) -> dict[str, pa.Array]:
    """Weakly connected components of a small graph, by the least of their nodes."""
    src, dst, ids = _coded(table)
    label, before = np.arange(len(ids)), None
    while before is None or (label != before).any():
        before, label = label, label.copy()
        np.minimum.at(label, src, before[dst])
        np.minimum.at(label, dst, label[src])
        label = label[label]
    return {"id": ids, "component": ids.take(pa.array(label))}


def weak_components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """(id, component): nodes of edges between different nodes; those that edges join either way have one of them in common.

    In each round a node goes to its neighbour of least hash, if that is less than its own; hashes are new in every round, so that half of the nodes go, as
    expected, in any graph. What is left is joined in one task once it is small, and the rounds' steps are followed from the last to the first.
    """
    ends = lambda a, b: [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]
    now = cut_lineage(edges.where("src <> dst").select(*ends("src", "dst")).distinct(), "links")
    steps: list[DataFrame] = []
    while not _is_small(now, small):
        h = lambda c: F.xxhash64(F.lit(len(steps)), c)  # noqa: B023, E731
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = both.groupBy("src").agg(F.min_by("dst", h("dst")).alias("near"))
        step = cut_lineage(near.select(F.col("src").alias("id"), F.when(h("near") < h("src"), F.col("near")).otherwise(F.col("src")).alias("to")), "steps")
        at = lambda df, c: df.join(step.select(F.col("id").alias(c), F.col("to").alias(f"_{c}")), c)  # noqa: B023, E731
        now = cut_lineage(at(at(now, "src"), "dst").where("_src <> _dst").select(*ends("_src", "_dst")).distinct(), "links")
        steps.append(step)
    kind = T.StructType([T.StructField("id", now.schema["src"].dataType), T.StructField("component", now.schema["src"].dataType)])
    label = _in_one_task(now, _joined, kind)
    for step in reversed(steps):
        label = step.join(label.withColumnRenamed("id", "to"), "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    return label


def _pieces(edges: DataFrame, small: int | None) -> tuple[DataFrame, DataFrame | None]:
    """edges with their weakly connected `component` that are few enough in it to be walked in numpy, stored, and the others without it, if there are any."""
    label = weak_components(edges, small)
    named = cut_lineage(edges.join(label.withColumnRenamed("id", "src"), "src", "left").withColumn("component", F.coalesce("component", "src")), "pieces")
    large = cut_lineage(named.groupBy("component").count().where(F.col("count") > (SMALL if small is None else small)).select("component"), "large")  # a row for each so many edges at most
    if large.isEmpty():
        return named, None
    return named.join(F.broadcast(large), "component", "left_anti"), named.join(F.broadcast(large), "component", "left_semi").drop("component")


def _sound(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct edges between nodes, stored."""
    left = edges.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return cut_lineage(left.select("src", "dst"), "edges")


def _levels(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The longest path to each node from those that nothing leads to; -1 on or behind a cycle."""
    first, after = _adjacent(src, dst, n)
    waits, depth = np.bincount(dst, minlength=n), np.full(n, -1)
    now, level = np.flatnonzero(waits == 0), 0
    while len(now):
        depth[now] = level
        hit, k = np.unique(_follow(first, after, now), return_counts=True)
        waits[hit] -= k
        now, level = hit[waits[hit] == 0], level + 1
    return depth


def depths(nodes: DataFrame, edges: DataFrame, small: int | None = None) -> DataFrame:
    """(id, depth): longest path from the roots; nodes on or behind a cycle have a null depth (see `cyclic`).

    Peels roots level by level: a node's level is final when its last predecessor has been peeled.
    """
    left = _sound(nodes, edges)
    found = nodes.select("id").distinct()
    few = _is_small(left, small)
    if few or small != 0:
        some, large = (left, None) if few else _pieces(left, small)
        kind = T.StructType([T.StructField("id", left.schema["src"].dataType), T.StructField("_depth", T.IntegerType())])

        def peel(table: pa.Table) -> dict[str, pa.Array]:
            src, dst, ids = _coded(table)
            return {"id": ids, "_depth": pa.array(_levels(src, dst, len(ids)), pa.int32())}

        known = _in_one_task(left, peel, kind) if few else _in_pieces(some, ["component"], [], peel, kind)
        if large is not None:
            far = _peeled(large.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), large)
            known = known.unionByName(far.select("id", F.coalesce("depth", F.lit(-1)).alias("_depth")))
        depth = F.coalesce("_depth", F.lit(0))
        return found.join(known, "id", "left").select("id", F.when(depth >= 0, depth).alias("depth"))
    return _peeled(found, left)


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one edge in and one out as (id, p, off): the first node before them that isn't one, off edges back; and those on rings (id).

    Pointers jump, so a chain takes as many rounds as its length has bits.
    """
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("p")).where("n = 1")
    out = edges.groupBy(F.col("src").alias("id")).count().where("count = 1").select("id")
    now = cut_lineage(into.join(out, "id", "left_semi").select("id", "p", F.lit(1).cast("bigint").alias("off"), F.lit(True).alias("moves")), "chains")
    n = now.count()
    for _ in range(n.bit_length() + 1 if n else 0):
        before = now.select(F.col("id").alias("p"), F.col("p").alias("_p"), F.col("off").alias("_off"))
        now = cut_lineage(now.join(before, "p", "left").select("id", F.coalesce("_p", "p").alias("p"), (F.col("off") + F.coalesce("_off", F.lit(0))).alias("off"), F.col("_p").isNotNull().alias("moves")), "chains")
        if now.where("moves").isEmpty():
            break
    return now.where("NOT moves").select("id", "p", "off"), now.where("moves").select("id")


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """depths of a large graph: chains count as one edge of their length, the rest is peeled level by level, a Spark job each."""
    chains, rings = _chains(edges)
    inner = chains.select("id").unionByName(rings)
    outer = edges.join(inner.select(F.col("id").alias("dst")), "dst", "left_anti")  # what leads into a chain is the chain's own
    far = outer.join(chains.select(F.col("id").alias("src"), "p", "off"), "src", "left").select(F.coalesce("p", "src").alias("src"), "dst", (F.coalesce("off", F.lit(0)) + 1).alias("w"))
    left = cut_lineage(far.groupBy("src", "dst").agg(F.max("w").alias("w")).withColumn("at", F.lit(0).cast("bigint")), "edges")
    done = None
    while True:
        # An edge goes when nothing leads to its source any more: then its source's depth (at) is known.
        waits = left.select(F.col("dst").alias("src"), F.lit(True).alias("waits")).distinct()
        step = cut_lineage(left.join(waits, "src", "left"), "level")
        gone = step.where(F.col("waits").isNull()).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("at") + F.col("w")).alias("depth"))
        if gone.isEmpty():
            break
        left = cut_lineage(step.where("waits").join(gone.select(F.col("id").alias("src"), F.col("depth").alias("_d")), "src", "left").select("src", "dst", "w", F.greatest("at", F.coalesce("_d", "at")).alias("at")), "left")
        done = gone if done is None else done.unionByName(gone)
    own = nodes.join(inner, "id", "left_anti")
    own = own.join(done.groupBy("id").agg(F.max("depth").alias("depth")), "id", "left") if done is not None else own.withColumn("depth", F.lit(None).cast("bigint"))
    stuck = left.select(F.col("dst").alias("id"), F.lit(True).alias("stuck")).distinct()
    own = cut_lineage(own.join(stuck, "id", "left").select("id", F.when(F.col("stuck").isNull(), F.coalesce("depth", F.lit(0))).alias("depth")), "outer")
    on = chains.join(own.select(F.col("id").alias("p"), "depth"), "p").select("id", (F.col("depth") + F.col("off")).alias("depth"))
    return own.unionByName(on).unionByName(rings.select("id", F.lit(None).cast("bigint").alias("depth"))).select("id", F.col("depth").cast("int").alias("depth"))


def cyclic(nodes: DataFrame, edges: DataFrame, small: int | None = None) -> DataFrame:
    """Nodes on a cycle or behind one: what is left when no root is."""
    return depths(nodes, edges, small).where(F.col("depth").isNull()).select("id")


def closure(edges: DataFrame, seeds: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(src, dst) for every dst that src reaches, cycle-safe. With seeds (id), only their closure.

    A small graph is searched from each source by itself; a large one is joined semi-naively, each step the newest pairs alone.
    """
    base = cut_lineage(edges.select("src", "dst").distinct(), "edges")
    sources = base.select("src").distinct() if seeds is None else base.select("src").distinct().join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    if _is_small(base, small):
        return _searched(base, sources)
    new = base if seeds is None else cut_lineage(base.join(sources, "src", "left_semi"), "new")
    known = new
    while not new.isEmpty():
        step = new.join(base.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
        new = cut_lineage(step.join(known, ["src", "dst"], "left_anti"), "new")
        known = known.unionByName(new)  # each step is stored, so their union has no lineage to cut
    return known


def _searched(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The closure from sources (src) over a small graph that every task holds."""
    table = edges.toArrow()
    src, dst, ids = _coded(table) if table.num_rows else (np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], table.column("src").type))
    held = edges.sparkSession.sparkContext.broadcast((*_adjacent(src, dst, len(ids)), ids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, after, ids = held.value
        code = {x: i for i, x in enumerate(ids.to_pylist())}
        seen = np.full(len(ids), -1)
        for b in batches:
            out, size = [], 0
            for k, start in enumerate(b.column(0).to_pylist()):
                mark, now, reached = code[start], np.array([code[start]]), []
                while len(now):
                    now = np.unique(_follow(first, after, now))
                    now = now[seen[now] != mark]
                    seen[now] = mark
                    reached.append(now)
                own = np.concatenate(reached)
                out.append((np.full(len(own), mark), own))
                size += len(own)
                if size > 1 << 18 or k == b.num_rows - 1:
                    a, z = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(z))], ["src", "dst"])
                    out, size = [], 0

    return sources.mapInArrow(search, edges.schema)


def ancestry(edges: DataFrame) -> DataFrame:
    """(task_id, ancestor): transitive dependencies."""
    return closure(edges).select(F.col("dst").alias("task_id"), F.col("src").alias("ancestor")).where(F.col("task_id") != F.col("ancestor"))


def strong_components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """(id, component): strongly connected components of two or more nodes, named by their least member.

    A large piece is trimmed of what is acyclic at its ends; then every node takes the least node that reaches it, and
    those that reach this node in turn, among nodes of one label, are its component. What is left goes round again.
    """
    core = cut_lineage(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "core")
    kind = T.StructType([T.StructField("id", core.schema["src"].dataType), T.StructField("component", core.schema["src"].dataType)])
    if _is_small(core, small):
        return _in_one_task(core, _tarjan, kind)
    if small == 0:
        return _strong_by_joins(core, kind)
    some, large = _pieces(core, small)
    found = _in_pieces(some, ["component"], [], _tarjan, kind)
    return cut_lineage(found if large is None else found.unionByName(_strong_by_joins(large, kind)), "components")


def _strong_by_joins(core: DataFrame, kind: T.StructType) -> DataFrame:
    found, n = core.sparkSession.createDataFrame([], kind), core.count()
    while n:
        before = None
        while n and n != before:
            core = cut_lineage(core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "core")
            before, n = n, core.count()
        if not n:
            break
        label = core.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.col("id"))
        changed = 1
        while changed:
            sent = core.join(label.select(F.col("id").alias("src"), F.col("label").alias("l")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("l").alias("l"))
            label = cut_lineage(label.join(sent, "id", "left").select("id", F.least("label", "l").alias("label"), (F.col("l") < F.col("label")).alias("less")), "label")
            changed = label.where("less").count()
            label = label.select("id", "label")
        same = core.join(label.select(F.col("id").alias("src"), "label"), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("m")), "dst").where("label = m").select("src", "dst", "label")
        back = cut_lineage(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label"), "same")
        # From each label backwards; a node has one label, so this is a row a node.
        new = cut_lineage(label.where("id = label").select(F.col("id").alias("dst"), "label"), "new")
        members = new
        while not new.isEmpty():
            step = new.join(back.withColumnRenamed("dst", "next").withColumnRenamed("src", "dst"), ["dst", "label"]).select(F.col("next").alias("dst"), "label").distinct()
            new = cut_lineage(step.join(members, ["dst", "label"], "left_anti").select("dst", "label"), "new")
            members = members.unionByName(new)
        own = members.select(F.col("dst").alias("id"), F.col("label").alias("component"))
        found = found.unionByName(own)
        core = cut_lineage(core.join(own.select(F.col("id").alias("src")), "src", "left_anti").join(own.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "core")
        n = core.count()
    found = cut_lineage(found, "components")
    return found.join(found.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("id", "component")


def _tarjan(table: pa.Table) -> dict[str, pa.Array]:
    """Strongly connected components of two or more nodes."""
    src, dst, ids = _coded(table)
    found = _strong(src, dst, len(ids))
    own = np.flatnonzero(found >= 0)
    return {"id": ids.take(pa.array(own)), "component": ids.take(pa.array(found[own]))}


def _strong(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's strongly connected component, -1 if it is one of its own, by depth-first search with low links on a stack of its own."""
    first, after = (x.tolist() for x in _adjacent(src, dst, n))
    number, low, held, component = [-1] * n, [0] * n, [False] * n, [-1] * n
    place, count, open_ = list(first), 0, []  # place: where each node's search goes on
    for root in range(n):
        todo = [root] if number[root] < 0 else []
        while todo:
            v = todo[-1]
            if number[v] < 0:
                number[v] = low[v] = count
                count += 1
                open_.append(v)
                held[v] = True
            if place[v] < first[v + 1]:
                w = after[place[v]]
                place[v] += 1
                if number[w] < 0:
                    todo.append(w)
                elif held[w]:
                    low[v] = min(low[v], number[w])
                continue
            todo.pop()
            if todo:
                low[todo[-1]] = min(low[todo[-1]], low[v])
            if low[v] == number[v]:
                at = len(open_) - 1
                while open_[at] != v:
                    at -= 1
                own = open_[at:]
                del open_[at:]
                for w in own:
                    held[w], component[w] = False, min(own) if len(own) > 1 else -1
    return np.array(component, np.int64)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on no edge."""
    return nodes.select("id").join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


def proposals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, files, claims, confidence): a cycle's files are combined (0.6), each file on no edge is an orphan (0.8),
    the others are isolated by directory (0.9); a file is in the first of these that fits."""
    cycles = strong_components(edges)
    lone = orphans(nodes, edges).join(cycles.select("id"), "id", "left_anti")
    rest = nodes.select("id").distinct().join(cycles.select("id"), "id", "left_anti").join(lone, "id", "left_anti")
    directories = F.array_sort(F.collect_set(dirname(F.col("id"))))
    combined = cycles.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("files"), directories.alias("d")).select(F.concat(F.lit("combined-"), F.array_join("d", "-")).alias("id"), F.lit("combined").alias("type"), "files", F.transform("d", lambda d: F.concat(F.lit("fs:"), d)).alias("claims"), F.lit(0.6).alias("confidence"))
    bare = F.regexp_replace(F.regexp_extract("id", "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    orphan = lone.select(F.concat(F.lit("orphan-"), bare).alias("id"), F.lit("orphan").alias("type"), F.array("id").alias("files"), F.array(F.concat(F.lit("fs:"), "id")).alias("claims"), F.lit(0.8).alias("confidence"))
    isolated = rest.groupBy(dirname(F.col("id")).alias("d")).agg(F.array_sort(F.collect_list("id")).alias("files")).select(F.concat(F.lit("isolated-"), F.replace("d", F.lit("/"), F.lit("-"))).alias("id"), F.lit("isolated").alias("type"), "files", F.array(F.concat(F.lit("fs:"), "d")).alias("claims"), F.lit(0.9).alias("confidence"))
    return combined.unionByName(orphan).unionByName(isolated)


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes (id) that any of the seeds (id) leads to. Each is reached once, however many seeds there are.

    A small graph is walked in numpy by one task; a large one by a join a step, of the newest nodes alone.
    """
    base = cut_lineage(edges.select("src", "dst").distinct(), "edges")
    if _is_small(base, None):
        kind = T.StructType([T.StructField("id", base.schema["src"].dataType)])
        start = seeds.select(F.col("id").cast(base.schema["src"].dataType).alias("src")).distinct().withColumns({"dst": F.col("src"), "_seed": F.lit(True)})
        both = cut_lineage(base.withColumn("_seed", F.lit(False)).unionByName(start.join(base.select("src"), "src", "left_semi").select("src", "dst", "_seed")), "reached")

        def walk(table: pa.Table) -> dict[str, pa.Array]:
            src, dst, ids = _coded(table)
            seed = table.column("_seed").to_numpy()
            first, after = _adjacent(src[~seed], dst[~seed], len(ids))
            seen, now = np.zeros(len(ids), bool), np.unique(src[seed])
            while len(now):
                now = np.unique(_follow(first, after, now))
                now = now[~seen[now]]
                seen[now] = True
            return {"id": ids.take(pa.array(np.flatnonzero(seen)))}

        return _in_one_task(both, walk, kind)
    new = cut_lineage(base.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct(), "new")
    known = new
    while not new.isEmpty():
        step = new.select(F.col("id").alias("src")).join(base, "src").select(F.col("dst").alias("id")).distinct()
        new = cut_lineage(step.join(known, "id", "left_anti"), "new")
        known = known.unionByName(new)
    return known


def skipped(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Tasks (id) that wait for a failed one (id), directly or not; the failed themselves aren't listed."""
    return reached(edges, failed).join(failed.select("id"), "id", "left_anti")


def _hubs(order: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hub, id, wave) of the claims that feed a hub, and of those that take from it: a task that feeds one comes before those that take from it in a later wave.

    Hubs stand for the pairs that conflict: claims of equal paths, and those of a directory with what is below it, each way; in each case any with those that
    write, and those that write with any. So a task has a few rows a claim and level of its path, however many others it meets.
    """
    own = claims.select(F.col("task_id").alias("id"), "path", "is_dir", (F.col("mode") == "write").alias("w")).distinct().join(order.select("id", "wave"), "id")
    held = own.where("is_dir")
    below = own.select("id", "wave", "w", F.explode(F.slice(ancestors(F.col("path")), F.lit(1), F.size(F.split("path", "/")) - 1)).alias("path")).join(held.select("path").distinct(), "path", "left_semi")
    sides = {"=": (own, own), ">": (held, below), "<": (below, held)}

    def rows(side: int, writes: str) -> DataFrame:
        """writes: the kind of hub whose rows of this side must write."""
        found = None
        for sign, both in sides.items():
            for kind in "aw":
                part = (both[side].where("w") if kind == writes else both[side]).select(F.concat(F.lit(sign + kind), "path").alias("hub"), "id", "wave")
                found = part if found is None else found.unionByName(part)
        return cut_lineage(found.distinct(), "hubs")

    return rows(0, "w"), rows(1, "a")


def skipped_by_claims(edges: DataFrame, order: DataFrame, claims: DataFrame, failed: DataFrame) -> DataFrame:
    """skipped over the declared edges and over those that claims inject: from each task to those in a later wave that its claims conflict with (claims.overlaps, one side writing).

    order (id, wave), claims (task_id, path, is_dir, mode). The injected edges aren't made: of each hub (see `_hubs`) the least wave that has been reached is
    kept, and what takes from it later is reached at once. So k writers of one path cost k rows and one step.
    """
    feeds, takes = _hubs(order, claims)
    declared = cut_lineage(edges.select("src", "dst").distinct(), "edges")
    new = cut_lineage(failed.select("id").distinct(), "failed")
    done, least = new, None
    while not new.isEmpty():
        touched = feeds.join(new, "id").groupBy("hub").agg(F.min("wave").alias("least"))
        if least is not None:
            before = least.select("hub", F.col("least").alias("was"))
            touched = touched.join(before, "hub", "left").where(F.col("was").isNull() | (F.col("least") < F.col("was")))
        else:
            touched = touched.withColumn("was", F.lit(None).cast(feeds.schema["wave"].dataType))
        touched = cut_lineage(touched, "touched")
        later = takes.join(touched, "hub").where((F.col("wave") > F.col("least")) & (F.col("was").isNull() | (F.col("wave") <= F.col("was")))).select("id")
        step = later.unionByName(declared.join(new.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"))).distinct()
        new = cut_lineage(step.join(done, "id", "left_anti"), "new")
        done = done.unionByName(new)
        least = touched.select("hub", "least") if least is None else cut_lineage(least.unionByName(touched.select("hub", "least")).groupBy("hub").agg(F.min("least").alias("least")), "least")
    return done.join(failed.select("id"), "id", "left_anti")


#: Labellings of a graph's intervals; pairs that they don't decide are searched.
LABELLINGS = 3


def _labelled(first: np.ndarray, after: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, rank, begin) by a depth-first search of an acyclic graph from its roots in random order: what a node leads to has its rank within low..rank of that node, and
    all nodes whose rank is within begin..rank are led to."""
    n = len(first) - 1
    begin = [0] * n
    low, rank = np.full(n, n).tolist(), [-1] * n
    place, end, follow, count = first[:-1].tolist(), first[1:].tolist(), after.tolist(), 0
    open_ = [False] * n
    roots = np.flatnonzero(np.bincount(after, minlength=n) == 0)  # of an acyclic graph these lead to all
    for root in rng.permutation(roots).tolist():
        todo = [root]
        while todo:
            v = todo[-1]
            if not open_[v]:
                open_[v], begin[v] = True, count
            if place[v] < end[v]:
                w = follow[place[v]]
                place[v] += 1
                if rank[w] < 0:
                    todo.append(w)
                elif low[w] < low[v]:
                    low[v] = low[w]
                continue
            todo.pop()
            rank[v] = count
            low[v] = min(low[v], count)
            count += 1
            if todo and low[v] < low[todo[-1]]:
                low[todo[-1]] = low[v]
    return np.array(low), np.array(rank), np.array(begin)


def leads_to(edges: DataFrame, pairs: DataFrame, small: int | None = None) -> DataFrame:
    """pairs (a, b) whose a leads to b over edges, once each; a node leads to itself only on a cycle or a loop.

    Cycles are put together first, so that the graph is acyclic. A small one is given interval labels by one task, which all tasks hold: most pairs
    are decided by them either way, the others are searched among nodes whose labels hold the wanted one. So are the small pieces of a large one, with the pairs
    that start in them. In a large piece what each a leads to is followed by joins, of the a's of open pairs alone and no deeper than their b's. None makes the closure.
    """
    if small != 0 and not _is_small(edges, small):
        return _in_their_pieces(edges, pairs, small)
    return _among_all(edges, pairs, small)


def _in_their_pieces(edges: DataFrame, pairs: DataFrame, small: int | None) -> DataFrame:
    limit = SMALL if small is None else small
    base = cut_lineage(edges.select("src", "dst").distinct(), "edges")
    some, large = _pieces(base, small)
    home = some.select(F.explode(F.array("src", "dst")).alias("a"), "component").distinct()
    asked = cut_lineage(pairs.select("a", "b").repartition("a").distinct().join(home, "a").select("component", "a", "b"), "asked")
    # Pairs of a piece that has very many are dealt over blocks, each with the piece's edges.
    many = cut_lineage(asked.groupBy("component").count().where(F.col("count") > limit).select("component", F.ceil(F.col("count") / limit).cast("int").alias("n")), "many")
    n = F.coalesce("n", F.lit(1))
    rows = some.join(F.broadcast(many), "component", "left").select("component", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"), F.lit(False).alias("asked"), F.col("src").alias("a"), F.col("dst").alias("b"))
    rows = rows.unionByName(asked.join(F.broadcast(many), "component", "left").select("component", F.pmod(F.xxhash64("a", "b"), n).cast("int").alias("block"), F.lit(True).alias("asked"), "a", "b"))

    def answer(table: pa.Table) -> dict[str, pa.Array]:
        wanted = table.column("asked")
        own, open_ = table.filter(pc.invert(wanted)), table.filter(wanted)
        src, dst, ids = _coded(pa.table({"src": own.column("a"), "dst": own.column("b")}))
        strong = _strong(src, dst, len(ids))
        round_ = strong >= 0
        round_[src[src == dst]] = True
        strong = np.where(strong < 0, np.arange(len(ids)), strong)
        index = pd.Index(ids.to_pandas())
        a, b = (index.get_indexer(open_.column(c).to_pandas()) for c in ("a", "b"))
        there = (a >= 0) & (b >= 0)
        x, y = strong[a], strong[b]
        yes = there & np.where(a == b, round_[a], x == y)
        far = np.flatnonzero(there & (x != y))
        between = np.unique(np.stack((strong[src], strong[dst]), 1)[strong[src] != strong[dst]], axis=0)
        if len(far) and len(between):
            yes[far] = _lead((*_labelled_all(between[:, 0], between[:, 1], len(ids)), None), x[far], y[far])
        yes = pa.array(yes)
        return {"a": open_.column("a").filter(yes).combine_chunks(), "b": open_.column("b").filter(yes).combine_chunks()}

    found = _in_pieces(rows, ["component", "block"], [], answer, asked.select("a", "b").schema)
    if large is None:
        return found
    large = cut_lineage(large, "large")
    return found.unionByName(_among_all(large, pairs.join(large.select(F.explode(F.array("src", "dst")).alias("a")).distinct(), "a", "left_semi"), 0))


def _among_all(edges: DataFrame, pairs: DataFrame, small: int | None) -> DataFrame:
    asked = cut_lineage(pairs.select("a", "b").distinct(), "asked")
    comps = cut_lineage(strong_components(edges, small), "components")
    name = lambda df, c: df.join(comps.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    dag = cut_lineage(_acyclic(edges, comps), "dag")
    loops = comps.select("id").unionByName(edges.where("src = dst").select(F.col("src").alias("id"))).distinct()
    own = asked.where("a = b").join(loops.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b")
    coded = name(name(asked.where("a != b"), "a"), "b")
    same = coded.where("_a = _b").select("a", "b")
    open_ = cut_lineage(coded.where("_a != _b"), "open")
    found = _by_labels(dag, open_) if _is_small(dag, small) else _by_depth(dag, open_)
    return own.unionByName(same).unionByName(found)


def forest_intervals(edges: DataFrame, small: int | None = None) -> DataFrame | None:
    """(id, piece, begin, rank) of the nodes of edges if they make trees: u leads to v if their pieces are equal and u's begin <= v's rank < u's rank.

    None if two edges end in one node, on a cycle, or if a tree has too many edges to be walked in numpy; loops are passed over. Stored.
    """
    base = cut_lineage(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    if not base.groupBy("dst").count().where("count > 1").isEmpty():
        return None
    one = base.withColumn("component", F.lit(0)) if _is_small(base, small) else None
    rows, large = (one, None) if one is not None else _pieces(base, small)
    if large is not None:
        return None

    def walk(table: pa.Table) -> dict[str, pa.Array]:
        src, dst, ids = _coded(table)
        _, rank, begin = _labelled(*_adjacent(src, dst, len(ids)), np.random.default_rng(0))
        component = np.empty(len(ids), object)
        own = table.column("component").to_pandas().to_numpy(object)
        component[src], component[dst] = own, own
        return {"id": ids, "piece": pa.array(component, table.schema.field("component").type), "begin": pa.array(begin, pa.int64()), "rank": pa.array(rank, pa.int64())}

    kind = T.StructType([T.StructField("id", base.schema["src"].dataType), T.StructField("piece", rows.schema["component"].dataType), T.StructField("begin", T.LongType()), T.StructField("rank", T.LongType())])
    rows = rows.select("src", "dst", "component")
    found = cut_lineage(_in_one_task(rows, walk, kind) if one is not None else _in_pieces(rows, ["component"], [], walk, kind), "intervals")
    return found if found.where("rank < 0").isEmpty() else None  # on a cycle no root leads to a node


def ordered(edges: DataFrame, pairs: DataFrame, small: int | None = None) -> DataFrame:
    """pairs (a, b and other columns, a and b never equal) with whether a leads to b (a_first) and b to a (b_first) over edges, as leads_to says.

    In a small graph the pairs stream past the labels, neither stored nor shuffled.
    """
    if not _is_small(edges, small):
        known = cut_lineage(pairs, "pairs")
        up = cut_lineage(leads_to(edges, known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))), small), "ordered")
        known = known.join(up.withColumn("a_first", F.lit(True)), ["a", "b"], "left").join(up.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("b_first")), ["a", "b"], "left")
        return known.na.fill(False, ["a_first", "b_first"])
    comps = cut_lineage(strong_components(edges, small), "components")
    labels, cyclic_ = _labels(_acyclic(edges, comps)), comps.select("id", "component").toArrow()
    held = edges.sparkSession.sparkContext.broadcast((labels, cyclic_.column(0).to_pandas(), cyclic_.column(1).to_pandas()))
    columns = pairs.columns

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, ids, component = held.value
        own = pd.Index(ids)
        index = pd.Index(labels[-1].to_pandas()) if labels else None
        for b in batches:
            a_b = [b.column(columns.index(c)).to_pandas() for c in "ab"]
            if len(own):
                for k, v in enumerate(a_b):
                    at = own.get_indexer(v)
                    a_b[k] = v.where(at < 0, component.to_numpy()[at])
            same = (a_b[0] == a_b[1]).to_numpy()
            x, y = (index.get_indexer(v) if labels else np.full(len(v), -1) for v in a_b)
            yes = [pa.array(same | (_lead(labels, *p) if labels else False)) for p in ((x, y), (y, x))]
            yield pa.RecordBatch.from_arrays([*b.columns, *yes], [*columns, "a_first", "b_first"])

    return pairs.mapInArrow(answer, T.StructType([*pairs.schema.fields, *(T.StructField(c, T.BooleanType()) for c in ("a_first", "b_first"))]))


def _acyclic(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """The distinct edges between components, named as the components are."""
    name = lambda df, c: df.join(comps.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    return name(name(edges.select("src", "dst"), "src"), "dst").where("_src != _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()


def _labels(dag: DataFrame) -> tuple | None:
    """(first, after, lows, ranks, begins, ids) of a small acyclic graph; None if it has no edges."""
    table = dag.toArrow()
    if not table.num_rows:
        return None
    src, dst, ids = _coded(table)
    return (*_labelled_all(src, dst, len(ids)), ids)


def _labelled_all(src: np.ndarray, dst: np.ndarray, n: int) -> tuple:
    """(first, after, lows, ranks, begins) of an acyclic graph."""
    first, after = _adjacent(src, dst, n)
    shuffled_ = [(f := _shuffled(first, after, np.random.default_rng(i)), _labelled(first, f, np.random.default_rng(i)))[1] for i in range(LABELLINGS)]
    lows, ranks, begins = (np.stack(x, 1) for x in zip(*shuffled_))
    return first, after, lows, ranks, begins


def _lead(labels: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each node x leads to y, numbers of the labelled ids (-1: none of them)."""
    first, after, lows, ranks, begins, _ = labels
    maybe = (x >= 0) & (y >= 0)
    maybe[maybe] = ((lows[x[maybe]] <= ranks[y[maybe]]) & (ranks[y[maybe]] < ranks[x[maybe]])).all(1)
    yes = np.zeros(len(x), bool)
    yes[maybe] = ((begins[x[maybe]] <= ranks[y[maybe]]) & (ranks[y[maybe]] < ranks[x[maybe]])).any(1)
    for i in np.flatnonzero(maybe & ~yes):
        yes[i] = _found(first, after, lows, ranks, begins, x[i], y[i])
    return yes


def _by_labels(dag: DataFrame, pairs: DataFrame) -> DataFrame:
    labels = _labels(dag)
    if not labels:
        return pairs.select("a", "b").limit(0)
    held = dag.sparkSession.sparkContext.broadcast(labels)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pd.Index(held.value[-1].to_pandas())
        for b in batches:
            yes = pa.array(_lead(held.value, *(index.get_indexer(b.column(i).to_pandas()) for i in (2, 3))))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(yes), b.column(1).filter(yes)], ["a", "b"])

    return pairs.select("a", "b", "_a", "_b").mapInArrow(answer, pairs.select("a", "b").schema)


def _shuffled(first: np.ndarray, after: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """What follows each node, in random order."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return after[np.lexsort((rng.random(len(after)), owner))]


def _found(first: np.ndarray, after: np.ndarray, lows: np.ndarray, ranks: np.ndarray, begins: np.ndarray, a: int, b: int) -> bool:
    """Whether a leads to b, by levels of the nodes whose labels hold b's, until one is known to lead there."""
    now, seen = np.array([a]), {int(a)}
    while len(now):
        now = np.unique(_follow(first, after, now))
        if (now == b).any() or ((begins[now] <= ranks[b]) & (ranks[b] < ranks[now])).any():
            return True
        now = now[((lows[now] <= ranks[b]) & (ranks[b] < ranks[now])).all(1)]
        now = np.array([x for x in now.tolist() if x not in seen], np.int64)
        seen.update(now.tolist())
    return False


def _by_depth(dag: DataFrame, pairs: DataFrame) -> DataFrame:
    nodes = dag.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    level = cut_lineage(depths(nodes, dag), "depths")
    at = lambda df, c: df.join(level.select(F.col("id").alias(c), F.col("depth").alias(f"d{c}")), c)
    open_ = cut_lineage(at(at(pairs, "_a"), "_b").where("d_a < d_b"), "open")
    wanted = open_.groupBy("_a").agg(F.max("d_b").alias("deepest"))
    steps = cut_lineage(dag.join(level.select(F.col("id").alias("dst"), "depth"), "dst"), "steps")
    new = cut_lineage(wanted.select("_a", F.col("_a").alias("src")).join(steps, "src").join(wanted, "_a").where("depth <= deepest").select("_a", "dst").distinct(), "new")
    known = new
    while not new.isEmpty():
        step = new.select("_a", F.col("dst").alias("src")).join(steps, "src").join(wanted, "_a").where("depth <= deepest").select("_a", "dst").distinct()
        new = cut_lineage(step.join(known, ["_a", "dst"], "left_anti"), "new")
        known = known.unionByName(new)
    return open_.join(known.select("_a", F.col("dst").alias("_b")), ["_a", "_b"], "left_semi").select("a", "b")


def wave_colours(tasks: DataFrame, conflicts: DataFrame, small: int | None = None) -> DataFrame:
    """tasks (depth, id), conflicts (task_a, task_b). (depth, id, colour): first-fit in id order within each depth.

    A task without a conflict has colour 0. The others fall into components that no conflict joins, coloured side by side, each in id order. With more conflicts than are
    walked in numpy, rounds of joins colour every task whose conflicting ones of lesser id have their colours, which is the same colouring.
    """
    a = tasks.select("depth", F.col("id").alias("task_a"))
    pairs = conflicts.select("task_a", "task_b").join(a, "task_a").join(tasks.select(F.col("depth").alias("d"), F.col("id").alias("task_b")), "task_b").where(F.col("depth") == F.col("d"))
    both = pairs.select("depth", F.explode(F.array(F.struct(F.col("task_a").alias("id"), F.col("task_b").alias("other")), F.struct(F.col("task_b").alias("id"), F.col("task_a").alias("other")))).alias("x")).select("depth", "x.*").distinct()
    both = cut_lineage(both, "conflicts")
    coloured = _in_components(both) if _is_small(both, small) else _in_rounds(both)
    return tasks.select("depth", "id").join(coloured, ["depth", "id"], "left").withColumn("colour", F.coalesce("colour", F.lit(0)))


def _in_components(both: DataFrame) -> DataFrame:
    kind = dict(both.dtypes)

    def colour(part: pd.DataFrame) -> pd.DataFrame:
        found: dict = {}
        for i, others in part.groupby("id")["other"]:  # in id order
            taken = {found[o] for o in others if o in found}
            found[i] = next(c for c in range(len(taken) + 1) if c not in taken)
        return pd.DataFrame({"depth": part["depth"].iloc[0], "id": list(found), "colour": list(found.values())})

    comps = components(both.select("id", F.concat_ws("\0", F.least("id", "other").cast("string"), F.greatest("id", "other").cast("string")).alias("hub")))
    return both.join(comps, "id").groupBy("depth", "component").applyInPandas(colour, f"depth {kind['depth']}, id {kind['id']}, colour int")


def _in_rounds(both: DataFrame) -> DataFrame:
    """Rounds of local minima: a task is ready when all that conflict with it and have lesser ids are coloured. Its colour is the first gap in theirs."""
    before = cut_lineage(both.where(F.col("other") < F.col("id")), "before")
    left = cut_lineage(both.select("depth", "id").distinct(), "left")
    done = both.sparkSession.createDataFrame([], T.StructType([both.schema["depth"], both.schema["id"], T.StructField("colour", T.IntegerType())]))
    while not left.isEmpty():
        open_ = before.join(left.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
        ready = left.join(open_, "id", "left_anti")
        theirs = before.join(ready.select("id"), "id", "left_semi").join(done.select(F.col("id").alias("other"), "colour"), "other").select("id", "colour").distinct()
        ranked = theirs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("colour")) - 1)
        gap = ranked.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("r") != F.col("colour"), F.col("r"))), F.count(F.lit(1))).cast("int").alias("colour"))
        new = cut_lineage(ready.join(gap, "id", "left").select("depth", "id", F.coalesce("colour", F.lit(0)).alias("colour")), "coloured")
        done = done.unionByName(new)
        left = cut_lineage(left.join(new.select("id"), "id", "left_anti"), "left")
    return done


def components(links: DataFrame) -> DataFrame:
    """links (id, hub). (id, component): ids that a chain of hubs joins have the least of them in common. Hubs of any size are a minimum, never a list."""
    links = cut_lineage(links.distinct(), "links")
    kind = T.StructType([T.StructField("id", links.schema["id"].dataType), T.StructField("component", links.schema["id"].dataType)])
    if _is_small(links, None):

        def join(table: pa.Table) -> dict[str, pa.Array]:
            at, ids = pd.factorize(table.column("id").to_pandas(), sort=True)
            hub = pd.factorize(table.column("hub").to_pandas())[0]
            label, before = np.arange(len(ids)), None
            while before is None or (label != before).any():
                before, least = label, np.full(hub.max() + 1, len(ids))
                np.minimum.at(least, hub, label[at])
                label = label.copy()
                np.minimum.at(label, at, least[hub])
                label = label[label]
            names = pa.array(ids, table.column("id").type)
            return {"id": names, "component": names.take(pa.array(label))}

        return _in_one_task(links, join, kind)
    label = cut_lineage(links.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:
        least = links.join(label, "id").groupBy("hub").agg(F.min("component").alias("least"))
        near = links.join(least, "hub").groupBy("id").agg(F.min("least").alias("near"))
        far = label.select(F.col("id").alias("near"), F.col("component").alias("far"))
        step = cut_lineage(label.join(near, "id").join(far, "near").select("id", F.least("component", "near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("less")), "labels")
        label = step.select("id", "component")
        if step.where("less").isEmpty():
            return label


def claim_colours(tasks: DataFrame, claims: DataFrame) -> DataFrame:
    """tasks (depth, id), claims (task_id, path, is_dir, mode). (depth, id, colour) as wave_colours gives it for the pairs that
    conflict (claims.overlaps, one side writing), without the pairs: k writers of one path are k rows here.

    Tasks whose claims no other of their depth meets have colour 0. The others fall into components that share no path, which are coloured side by
    side. Where all tasks of a component write one path and claim nothing else, a task's colour is its rank, which sorted partitions count. In any
    other component tasks stream in id order past a tree of the paths, which keeps for each path what colours read and write it, claim it as a
    directory, and claim what is below it.
    """
    own = claims.join(tasks.select(F.col("id").alias("task_id"), "depth"), "task_id").select("depth", "task_id", "path", "is_dir", "mode").distinct()
    two = lambda c: [F.min(c).alias("a"), F.max(c).alias("b")]
    up = own.select("depth", "task_id", "is_dir", "path", F.explode(ancestors(F.col("path"))).alias("above"))
    other = lambda x: F.coalesce((F.col(f"{x}.a") != F.col("o.task_id")) | (F.col(f"{x}.b") != F.col("o.task_id")), F.lit(False))
    at = own.groupBy("depth", "path").agg(*two("task_id"))
    below = up.where("above != path").groupBy("depth", F.col("above").alias("path")).agg(*two("task_id"))
    met = own.alias("o").join(at.alias("x"), ["depth", "path"]).join(below.alias("y"), ["depth", "path"], "left").where(other("x") | F.col("o.is_dir") & other("y")).select("depth", F.col("o.task_id"))
    held = own.where("is_dir").groupBy("depth", F.col("path").alias("above")).agg(*two("task_id"))
    inside = up.alias("o").where("above != path").join(held.alias("x"), ["depth", "above"]).where(other("x")).select("depth", F.col("o.task_id"))
    contested = own.join(met.unionByName(inside).distinct(), ["depth", "task_id"], "left_semi")
    contested = cut_lineage(contested, "contested")
    if contested.isEmpty():
        return tasks.select("depth", "id", F.lit(0).alias("colour"))
    kind = dict(tasks.dtypes)
    hub = lambda p: F.concat_ws("\0", F.col("depth").cast("string"), p)
    dirs = contested.where("is_dir").select(hub(F.col("path")).alias("hub")).distinct()
    links = contested.select(F.col("task_id").alias("id"), hub(F.col("path")).alias("hub")).unionByName(contested.select(F.col("task_id").alias("id"), F.explode(F.transform(ancestors(F.col("path")), hub)).alias("hub")).join(dirs, "hub", "left_semi")).distinct()
    contested = contested.join(components(links).withColumnRenamed("id", "task_id"), "task_id")
    shape = contested.groupBy("depth", "component").agg((F.min("path") == F.max("path")).alias("one"), F.min("mode").alias("mode"))
    contested = cut_lineage(contested.join(shape.select("depth", "component", (F.col("one") & (F.col("mode") == "write")).alias("ranked")), ["depth", "component"]), "components")
    writers = _placed(contested.where("ranked").select("depth", "component", "task_id").distinct(), ["depth", "component", "task_id"], 0)
    begin = writers.groupBy("depth", "component").agg(F.min("_pos").alias("begin"))
    ranked = writers.join(begin, ["depth", "component"]).select("depth", F.col("task_id").alias("id"), (F.col("_pos") - F.col("begin")).cast("int").alias("colour"))

    def colour(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        depth, group, task, rows, tree = None, None, None, [], {}

        def placed() -> int:
            """The least colour that no met claim has; the tree then has it for this task's claims."""
            taken = 0
            for path, is_dir, mode in rows:
                steps = path.split("/")
                for k in range(1, len(steps) + 1):
                    reads, writes, dir_reads, dir_writes, low_reads, low_writes = tree.get("/".join(steps[:k]), (0,) * 6)
                    if k < len(steps):
                        taken |= dir_writes | (dir_reads if mode == "write" else 0)
                    else:
                        taken |= writes | (reads if mode == "write" else 0)
                        taken |= (low_writes | (low_reads if mode == "write" else 0)) if is_dir else 0
            bit = ~taken & (taken + 1)
            for path, is_dir, mode in rows:
                steps, w = path.split("/"), int(mode == "write")
                for k in range(1, len(steps) + 1):
                    node = tree.setdefault("/".join(steps[:k]), [0] * 6)
                    if k < len(steps):
                        node[4 + w] |= bit
                    else:
                        node[w] |= bit
                        node[2 + w] |= bit if is_dir else 0
            return bit.bit_length() - 1

        for part in parts:
            out = []
            for d, c, t, *claim in part[["depth", "component", "task_id", "path", "is_dir", "mode"]].itertuples(index=False):
                if (d, c, t) != (depth, group, task):
                    if rows:
                        out.append((depth, task, placed()))
                    if (d, c) != (depth, group):
                        tree = {}
                    depth, group, task, rows = d, c, t, []
                rows.append(claim)
            yield pd.DataFrame(out, columns=["depth", "id", "colour"])
        if rows:
            yield pd.DataFrame([(depth, task, placed())], columns=["depth", "id", "colour"])

    coloured = contested.where("NOT ranked").repartition("depth", "component").sortWithinPartitions("depth", "component", "task_id").mapInPandas(colour, f"depth {kind['depth']}, id {kind['id']}, colour int").unionByName(ranked)
    return tasks.select("depth", "id").join(coloured, ["depth", "id"], "left").withColumn("colour", F.coalesce("colour", F.lit(0)))


def waves(coloured: DataFrame) -> DataFrame:
    """(id, wave): the global number of each (depth, colour), both ascending.

    The numbers come from the distinct pairs, which are few, so the window isn't over the tasks.
    """
    pairs = coloured.select("depth", "colour").distinct()
    numbered = pairs.withColumn("wave", F.row_number().over(Window.orderBy("depth", "colour")) - 1)
    return coloured.join(numbered, ["depth", "colour"]).select("id", "wave")


def injected_edges(order: DataFrame, conflicts: DataFrame) -> DataFrame:
    """order (id, wave). From each conflicting pair (task_a, task_b) the edge from the earlier wave to the later, once."""
    w = lambda side: order.select(F.col("id").alias(side), F.col("wave").alias(f"w_{side}"))
    both = conflicts.select("task_a", "task_b").join(w("task_a"), "task_a").join(w("task_b"), "task_b").where(F.col("w_task_a") != F.col("w_task_b"))
    earlier = F.col("w_task_a") < F.col("w_task_b")
    return both.select(F.when(earlier, F.col("task_a")).otherwise(F.col("task_b")).alias("src"), F.when(earlier, F.col("task_b")).otherwise(F.col("task_a")).alias("dst")).distinct()


def edges_of_waves(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, a_wave, b_wave), each once (see claims.conflicts). The edge from the earlier wave to the later, of pairs in two."""
    earlier = F.col("a_wave") < F.col("b_wave")
    return pairs.where("a_wave <> b_wave").select(F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("dst"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, dependents): repeated edges count as often as they are."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").na.fill(0)


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose src is no node."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst")


class GrowingOrder:
    """A topological order of edges that come one by one (Pearce and Kelly's, with a search from both ends).

    An edge that agrees with the order costs nothing. One that doesn't concerns the places between its ends alone: what its end leads to there
    and what leads to its start there are searched in turns. If they meet it closes a cycle; else whichever is known whole first
    moves to the far side of these places.
    """

    def __init__(self):
        self.number: dict = {}
        self.after: list[list[int]] = []
        self.before: list[list[int]] = []
        self.place, self.at = np.empty(64, np.int64), np.empty(64, np.int64)  # of each node its place, at each place its node

    def _node(self, x) -> int:
        if (n := self.number.get(x)) is None:
            n = self.number[x] = len(self.number)
            self.after.append([])
            self.before.append([])
            if n == len(self.place):
                self.place, self.at = np.resize(self.place, 2 * n), np.resize(self.at, 2 * n)
            self.place[n] = self.at[n] = n
        return n

    def add(self, src, dst) -> bool:
        """False if the edge would close a cycle; it is then left out."""
        u, v = self._node(src), self._node(dst)
        if u == v:
            return False
        lo, hi = self.place[v], self.place[u]
        if lo < hi:
            ahead, behind = {v}, {u}
            if not self._searched(ahead, behind, lo, hi):
                return False
        self.after[u].append(v)
        self.before[v].append(u)
        return True

    def _searched(self, ahead: set[int], behind: set[int], lo: int, hi: int) -> bool:
        place, left, right = self.place, list(ahead), list(behind)
        while True:
            for y in self.after[left.pop()]:
                if y in behind:
                    return False
                if y not in ahead and place[y] < hi:
                    ahead.add(y)
                    left.append(y)
            if not left:
                self._moved(ahead, lo, hi, last=True)
                return True
            for y in self.before[right.pop()]:
                if y in ahead:
                    return False
                if y not in behind and place[y] > lo:
                    behind.add(y)
                    right.append(y)
            if not right:
                self._moved(behind, lo, hi, last=False)
                return True

    def _moved(self, own: set[int], lo: int, hi: int, last: bool) -> None:
        """The nodes of `own` go behind (or before) the others of the places lo to hi, both kinds in their order."""
        stays = np.ones(hi - lo + 1, bool)
        stays[self.place[np.fromiter(own, np.int64, len(own))] - lo] = False
        held = self.at[lo : hi + 1]
        self.at[lo : hi + 1] = now = np.concatenate((held[stays], held[~stays]) if last else (held[~stays], held[stays]))
        self.place[now] = np.arange(lo, hi + 1)


def _inside(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Edges (seq, src, dst) with both ends in one component, which they get."""
    both = edges.join(comps.select(F.col("id").alias("src"), "component"), "src").join(comps.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst")
    return both.where(F.col("component") == F.col("c")).select("seq", "src", "dst", "component")


def without_cycles(nodes: DataFrame, edges: DataFrame, small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) edges (seq, src, dst): dangling ones go, and in the order of seq those that close a cycle.

    Only edges inside a strongly connected component can close one; those are walked in order, a component at a time, past an
    order of its nodes that each edge kept extends (see `GrowingOrder`). The small pieces of a large graph are walked whole.
    """
    sound = cut_lineage(edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("seq", "src", "dst"), "sound")
    some, large = (None, sound) if _is_small(sound, small) else _pieces(sound, small)
    inner = None if large is None else _inside(large, strong_components(large, 0 if some is not None else None))
    if some is not None:
        inner = some.select("seq", "src", "dst", "component") if inner is None else some.select("seq", "src", "dst", "component").unionByName(inner)
    kind = dict(sound.dtypes)["src"]

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, order = None, GrowingOrder()
        for part in parts:
            lost = []
            for component, seq, src, dst in zip(*(part[c] for c in ("component", "seq", "src", "dst"))):
                if component != now:
                    now, order = component, GrowingOrder()
                if not order.add(src, dst):
                    lost.append((seq, src, dst))
            yield pd.DataFrame(lost, columns=["seq", "src", "dst"])

    walked = _dealt(inner.select("component", "seq", "src", "dst"), "component").sortWithinPartitions("component", "seq").mapInPandas(walk, f"seq bigint, src {kind}, dst {kind}")
    closing = cut_lineage(walked.select("seq").unionByName(sound.where(F.col("src") == F.col("dst")).select(F.col("seq").cast("bigint"))).distinct(), "closing")
    kept = sound.join(closing, "seq", "left_anti")
    return kept, edges.select("seq", "src", "dst").join(kept.select("seq"), "seq", "left_anti")


def push_down(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """nodes (pid, ppid), claims (pid, path, mode). (pid, path, mode) of the leaves with all their ancestors' claims."""
    edges = nodes.join(nodes.select(F.col("pid").alias("ppid")), "ppid", "left_semi").select(F.col("ppid").alias("src"), F.col("pid").alias("dst"))
    leaves = nodes.select("pid").join(edges.select(F.col("src").alias("pid")).distinct(), "pid", "left_anti")
    up = closure(edges).select(F.col("dst").alias("pid"), F.col("src").alias("from")).unionByName(leaves.select("pid", F.col("pid").alias("from")))
    return up.join(leaves, "pid", "left_semi").join(claims.select(F.col("pid").alias("from"), "path", "mode"), "from").select("pid", "path", "mode").distinct()


def import_graph(files: DataFrame, imports: DataFrame, suffixes: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, orphans) of files (id) and imports (source, target, kind)."""
    from braidwork.operators.expand import resolve_imports

    edges = resolve_imports(files, imports, suffixes).select(F.col("source").alias("src"), F.col("resolved").alias("dst"), "kind")
    nodes = files.select("id")
    return nodes, edges, orphans(nodes, edges)


def by_volatility(tasks: DataFrame, forecasts: DataFrame) -> DataFrame:
    """tasks (depth, id) with `place` in their depth: the most volatile first, ids break ties."""
    scored = tasks.join(forecasts.select(F.col("task_id").alias("id"), "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.5)))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("depth").orderBy(F.desc("score"), "id")) - 1).select("depth", "id", "score", "place")


def shuffled(tasks: DataFrame, seed: int) -> DataFrame:
    """Tasks (id) in an order that the seed makes, for tests of schedules; the same seed gives the same order."""
    return tasks.orderBy(F.xxhash64(F.lit(seed), "id"), "id")


def _placed(rows: DataFrame, by: list[str], begin: int) -> DataFrame:
    """rows with `_pos`: begin, begin + 1, ... in the order of the columns `by`, counted by sorted partitions."""
    part = F.spark_partition_id()
    cut = cut_lineage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": part, "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    sizes = cut.groupBy("_part").count()  # one row a partition
    start = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count") + begin).alias("_start"))
    return cut.join(F.broadcast(start), "_part").withColumn("_pos", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def schedule(nodes: DataFrame, edges: DataFrame, slots: int) -> DataFrame:
    """(id, step): when a ready queue with `slots` places starts each task, if every task takes one step.

    Tasks that nothing leads to queue in id order. A task queues when the last task that leads to it has ended, tasks that one
    ended task sets free in id order; each step starts the first `slots` of the queue. Tasks on or behind a cycle never start.

    The queue's order doesn't depend on the slots: it goes by depth, and in a depth by the place of the last task before. So
    the order is found level by level, and one pass over it, of two numbers a task, is the clock.
    """
    ids = nodes.select("id").distinct()
    sound = _sound(nodes, edges)
    lone = ids.join(sound.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("lone"))
    all_ = cut_lineage(sound.select("src", "dst", F.lit(False).alias("lone")).unionByName(lone), "tasks")
    if _is_small(all_, None):
        kind = T.StructType([T.StructField("id", ids.schema["id"].dataType), T.StructField("_pos", T.LongType()), T.StructField("_after", T.LongType())])
        order = _in_one_task(all_, _queued, kind)
    else:
        depth = cut_lineage(depths(nodes, edges).where(F.col("depth").isNotNull()), "depths")
        order, level, begin = None, 0, 0
        while True:
            now = depth.where(F.col("depth") == level).select("id")
            if level:
                last = sound.join(order.select(F.col("id").alias("src"), "_pos"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("_pos").alias("_after"))
                now = now.join(last, "id")
            else:
                now = now.withColumn("_after", F.lit(-1).cast("bigint"))
            now = cut_lineage(_placed(now, ["_after", "id"], begin), "queued")
            n = now.count()
            if not n:
                break
            order, level, begin = (now if order is None else order.unionByName(now)), level + 1, begin + n
        if order is None:
            return ids.select("id", F.lit(0).cast("bigint").alias("step")).limit(0)
    kind = dict(ids.dtypes)["id"]

    def clock(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begins: list[int] = []  # the place of each step's first task
        steps: list[int] = []
        now, used = -1, slots
        for part in parts:
            out = []
            for pos, after in zip(part["_pos"], part["_after"]):
                ready = 0 if after < 0 else steps[bisect_right(begins, after) - 1] + 1
                if ready > now or used == slots:
                    now, used = max(ready, now + 1), 0
                    begins.append(pos)
                    steps.append(now)
                used += 1
                out.append(now)
            yield pd.DataFrame({"id": part["id"], "step": out})

    return order.select("id", "_pos", "_after").repartition(1).sortWithinPartitions("_pos").mapInPandas(clock, f"id {kind}, step bigint")


def _queued(table: pa.Table) -> dict[str, pa.Array]:
    """The order in which a first-in first-out queue gives the tasks of a small graph, and the place of the last one each waits for
    (-1: none). Rows that are `lone` are tasks without an edge."""
    src, dst, ids = _coded(table)
    edge = ~table.column("lone").to_numpy()
    first, after = (x.tolist() for x in _adjacent(src[edge], dst[edge], len(ids)))
    waits = np.bincount(dst[edge], minlength=len(ids)).tolist()
    queue = deque((v, -1) for v in range(len(ids)) if not waits[v])
    order, behind = [], []
    while queue:
        v, last = queue.popleft()
        order.append(v)
        behind.append(last)
        for w in after[first[v] : first[v + 1]]:
            waits[w] -= 1
            if not waits[w]:
                queue.append((w, len(order) - 1))
    return {"id": ids.take(pa.array(order, pa.int64())), "_pos": pa.array(range(len(order)), pa.int64()), "_after": pa.array(behind, pa.int64())}
