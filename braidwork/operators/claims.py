"""Resource claims: predicates of overlap, the containment join, conflicts of a wave, shadowed outputs.

Two predicates exist and differ on purpose. `segments_overlap` (for planning): equal, or one a path prefix of the
other by whole segments, trailing slashes or not. `directory_contains` (for verification): equal, or the container
is written with a trailing slash. Joins by containment never compare all pairs: every path lists its ancestors and
meets them by equality, so the work is rows times depth plus the matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.text import folded_path, normalise_fs_path, protocol, resource, sorted_set
from braidwork.plans.session import cut_lineage


def write_covers(write: Column, item: Column) -> Column:
    """Whether a non-empty written path is the item or a directory above it, both in normal form (see normalise_fs_path)."""
    w, i = normalise_fs_path(write), normalise_fs_path(item)
    return (w != "") & ((w == i) | i.startswith(F.concat(w, F.lit("/"))))


def segments_overlap(a: Column, b: Column, fold_case: bool = False) -> Column:
    """Claims `proto:path` overlap: protocols equal, and for fs equal or segment-wise containment either way."""
    x, y = (F.lower(c) if fold_case else c for c in (a, b))
    bare = lambda c: F.regexp_replace(resource(c), "/+$", "")
    inside = (bare(x) == bare(y)) | bare(x).startswith(F.concat(bare(y), F.lit("/"))) | bare(y).startswith(F.concat(bare(x), F.lit("/")))
    return (protocol(a) == protocol(b)) & F.when(protocol(a) == "fs", inside).otherwise(resource(x) == resource(y))


def directory_contains(a: Column, b: Column) -> Column:
    """The contained one of two claims if they are equal or one is a directory (ends in /) above the other, else null."""
    return F.when(a == b, a).when(a.endswith("/") & b.startswith(a), b).when(b.endswith("/") & a.startswith(b), a)


def normalised_claim(claim: Column) -> Column:
    """struct(proto, path, is_dir): dots resolved for fs claims only; a trailing slash makes a directory."""
    fs, path = protocol(claim) == "fs", resource(claim)
    return F.struct(protocol(claim).alias("proto"), F.when(fs, folded_path(path)).otherwise(path).alias("path"), path.endswith("/").alias("is_dir"))


#: Claim arguments by prefix, the first that fits.
ARGUMENTS = (("fs:write:", "fs", "write"), ("fs:read:", "fs", "read"), ("fs:", "fs", "write"), ("env:write:", "env", "write"), ("env:read:", "env", "read"), ("env:", "env", "read"), ("port:", "port", "write"))


def parsed_argument(argument: Column) -> Column:
    """struct(proto, mode, path) of a claim argument; null for others. Ports are written as port:N."""
    out = F.lit(None).cast("struct<proto:string,mode:string,path:string>")
    for prefix, proto, mode in reversed(ARGUMENTS):
        path = argument if proto == "port" else F.substr(argument, F.lit(len(prefix) + 1))
        out = F.when(argument.startswith(prefix), F.struct(F.lit(proto).alias("proto"), F.lit(mode).alias("mode"), path.alias("path"))).otherwise(out)
    return out


def cache_inputs(tasks: DataFrame) -> DataFrame:
    """tasks (id, reads, claims, writes arrays). Gives (id, path): reads and claims that begin with fs:, in normal form,
    that aren't empty and that no own write covers."""
    none = F.expr("cast(array() as array<string>)")
    fs = F.filter(F.coalesce("claims", none), lambda c: c.startswith("fs:"))
    paths = sorted_set(F.transform(F.concat(F.coalesce("reads", none), fs), normalise_fs_path))
    # Writes are put in normal form once a task, not for each pair: below the explode they are columns.
    writes = F.transform(F.filter(F.transform(F.coalesce("writes", none), normalise_fs_path), lambda w: w != ""), lambda w: F.concat(w, F.lit("/")))
    each = tasks.select("id", writes.alias("_writes"), F.explode(F.filter(paths, lambda p: p != "")).alias("path"))
    return each.where(~F.exists("_writes", lambda w: F.concat("path", F.lit("/")).startswith(w))).select("id", "path")


def ancestors(path: Column) -> Column:
    """The path and every directory above it, by segments."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def containment_join(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer: (task_id, path). Gives (inner_id, inner_path, outer_id, outer_path) where the outer path is the inner or above it.

    An equi-join of each inner path's ancestors: no pair is looked at that doesn't match.
    """
    up = inner.select(F.col("task_id").alias("inner_id"), F.col("path").alias("inner_path"), F.explode(ancestors(F.col("path"))).alias("outer_path"))
    return up.join(outer.select(F.col("task_id").alias("outer_id"), F.col("path").alias("outer_path")), "outer_path").select("inner_id", "inner_path", "outer_id", "outer_path")


#: Rows of one key, of either side, that meet in one task; matches that a task makes; claims of a task up to which its pairs are told apart where they meet.
BLOCK, MATCHES, SLIM = 2048, 1 << 20, 2


def meet(left: DataFrame, right: DataFrame, on: list[str], block: int = BLOCK, matches: int = MATCHES) -> DataFrame:
    """The equi-join of two tables that share the columns `on` alone, in as many tasks as its matches need.

    Rows of a frequent key are dealt over blocks, and every block of the left meets every one of the right: a task never has
    more than block * block matches of a key at once, and no match is shuffled.
    """
    count = lambda df, c: df.groupBy(*on).agg(F.count(F.lit(1)).alias(c))
    keys = cut_lineage(count(left, "_l").join(count(right, "_r"), on), "keys")
    total = keys.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
    if total <= matches:
        return left.join(right, on)
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int").alias(c)
    heavy = F.broadcast(keys.where((F.col("_l") > block) | (F.col("_r") > block)).select(*on, blocks("_l"), blocks("_r")))

    def dealt(df: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        n = lambda c: F.coalesce(c, F.lit(1))
        at = F.pmod(F.xxhash64(*df.columns), n(own)).cast("int").alias(i)
        return df.join(heavy, on, "left").select(*df.columns, at, F.explode(F.sequence(F.lit(0), n(other) - 1)).alias(j))

    cell, tasks = [*on, "_i", "_j"], min(int(total // matches) + 32, 20_000)
    parts = (dealt(left, "_l", "_r", "_i", "_j"), dealt(right, "_r", "_l", "_j", "_i"))
    return parts[0].repartition(tasks, *cell).join(parts[1].repartition(tasks, *cell), cell).drop("_i", "_j")


def overlaps(claims: DataFrame) -> DataFrame:
    """claims (task_id, path, is_dir, mode). Pairs of two tasks where one's directory holds the other's path or the paths are equal."""
    out = claims.select(F.col("task_id").alias("o_id"), F.col("path").alias("o_path"), F.col("is_dir").alias("o_dir"), F.col("mode").alias("o_mode"))
    up = claims.select("task_id", "path", "is_dir", "mode", F.explode(ancestors(F.col("path"))).alias("o_path"))
    met = meet(up, out, ["o_path"]).where((F.col("task_id") != F.col("o_id")) & ((F.col("path") == F.col("o_path")) | F.col("o_dir")))
    # Equal paths meet from both sides; strict containment from one.
    return met.where((F.col("path") != F.col("o_path")) | (F.col("task_id") < F.col("o_id")))


def conflicts(claims: DataFrame, by: tuple[str, ...] = (), also: tuple[str, ...] = (), slim: int = SLIM, block: int = BLOCK, matches: int = MATCHES) -> DataFrame:
    """claims (by, also, task_id, proto, path, is_dir, mode), `also` the same for all of a task's. One row (by, a, b, and of each of `also` its a_ and b_) for each
    unordered pair, a < b, that conflicts among equal `by`; and the least contained path (resource), and the least where both write, b alone does, and a alone.

    fs and env claims conflict if one side writes; every other protocol is exclusive. A pair is given by the first of its matches, which its tasks' claims, carried
    along, tell where they meet: pairs are never shuffled. Only pairs with a task of more than `slim` claims are grouped. Where one task has one claim and the
    other two at most, at most one other match is possible, and plain columns tell it.
    """
    grouped = [*by, *also, "task_id"]
    tasks = claims.groupBy(*grouped).agg(F.array_sort(F.collect_set(F.struct("proto", "path", "is_dir", "mode"))).alias("_all"))
    tasks = cut_lineage(tasks, "tasks")
    most = tasks.agg(F.max(F.size("_all"))).first()[0] or 0
    own = tasks.select(*grouped, F.size("_all").alias("_n"), "_all", F.posexplode("_all").alias("_k", "c")).select(*grouped, "_n", "_all", "_k", "c.*")
    above = F.when(F.col("proto") == "fs", ancestors(F.col("path"))).otherwise(F.array("path"))
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    exclusive = lambda proto: ~proto.isin("fs", "env")
    clash = lambda proto, a, b: exclusive(proto) | (a == "write") | (b == "write")
    straight = x("task_id") < y("task_id")
    first, second = (lambda c: F.when(straight, x(c)).otherwise(y(c))), (lambda c: F.when(straight, y(c)).otherwise(x(c)))

    def met(rows: DataFrame, *named: str) -> DataFrame:
        """The matches of rows of `own`, with the columns named of either side."""
        named = [*also, "task_id", "path", "is_dir", "mode", *named]
        inner = rows.select(*by, "proto", *(F.col(c).alias(f"x_{c}") for c in named), F.explode(above).alias("_at"))
        outer = rows.select(*by, "proto", *(F.col(c).alias(f"y_{c}") for c in named), F.col("path").alias("_at"))
        both = meet(inner, outer, [*by, "proto", "_at"], block, matches).where((x("task_id") != y("task_id")) & clash(F.col("proto"), x("mode"), y("mode")))
        # Equal paths meet from both sides; strict containment from one.
        return both.where(F.when(x("path") == y("path"), x("task_id") < y("task_id")).otherwise(y("is_dir")))

    names = [*by, first("task_id").alias("a"), second("task_id").alias("b"), *(f(c).alias(f"{s}_{c}") for c in also for f, s in ((first, "a"), (second, "b")))]
    kinds = {"both_write": (True, True), "b_writes": (False, True), "a_writes": (True, False)}

    found = []
    if slim > 0:
        other = F.get("_all", F.lit(1) - F.col("_k")) if slim > 1 else F.lit(None)
        alone = own.where(F.col("_n") <= min(slim, 2)).withColumn("_o", F.when(F.col("_n") == 2, other).otherwise(F.struct("proto", "path", "is_dir", "mode")))
        alone = alone.select("*", F.col("_o.proto").alias("_oproto"), F.col("_o.path").alias("_opath"), F.when((F.col("_o.proto") == "fs") & F.col("_o.is_dir"), F.concat(F.col("_o.path"), F.lit("/"))).alias("_below"), (F.col("_o.mode") == "write").alias("_ow"))
        few = met(alone, "_n", "_k", "_oproto", "_opath", "_below", "_ow").where((x("_n") == 1) | (y("_n") == 1))
        within = lambda u, v: F.coalesce(u("_opath").startswith(v("_below")), F.lit(False))
        again = ((x("_n") == 2) | (y("_n") == 2)) & (x("_oproto") == y("_oproto")) & (exclusive(x("_oproto")) | x("_ow") | y("_ow")) & ((x("_opath") == y("_opath")) | within(x, y) | within(y, x))
        again = F.coalesce(again, F.lit(False))
        few = few.where(~again | (x("_k") + y("_k") == 0))
        few = few.withColumns({"_again": F.when(again, F.greatest(x("_opath"), y("_opath"))), "_aw": first("mode") == "write", "_bw": second("mode") == "write", "_aow": first("_ow"), "_bow": second("_ow")})
        said = lambda a, b, u, v, path: F.when((F.col(a) == F.lit(u)) & (F.col(b) == F.lit(v)), path)
        found.append(few.select(*names, F.least(x("path"), "_again").alias("resource"), *(F.least(said("_aw", "_bw", u, v, x("path")), said("_aow", "_bow", u, v, F.col("_again"))).alias(n) for n, (u, v) in kinds.items())))
    grouped_too = lambda: _with_many(found, met(own, "_n").where(F.greatest(x("_n"), y("_n")) > slim), names, kinds, first, second)
    if slim < 2 or most < 2:
        return grouped_too() if most > slim or not found else found[0]

    # Two tasks of two claims: all four meetings in plain columns. The contained of two paths, one the other or inside it, is the greater one.
    two = own.where("_n = 2")
    each = lambda i: F.get("_all", F.lit(i))
    for i in range(2):
        c = each(i)
        q = F.concat(c["proto"], F.lit("\0"), c["path"])
        two = two.withColumns({f"_p{i}": c["path"], f"_q{i}": q, f"_d{i}": F.when((c["proto"] == "fs") & c["is_dir"], F.concat(q, F.lit("/"))), f"_w{i}": c["mode"] == "write", f"_e{i}": exclusive(c["proto"]) | (c["mode"] == "write")})
    few = met(two, "_k", *(f"_{c}{i}" for c in "pqdwe" for i in range(2)))
    cells = [(i, j) for i in range(2) for j in range(2)]

    def hit(i: int, j: int) -> Column:
        u, v = (lambda c: x(f"_{c}{i}")), (lambda c: y(f"_{c}{j}"))
        return F.coalesce((u("e") | v("e")) & ((u("q") == v("q")) | u("q").startswith(v("d")) | v("q").startswith(u("d"))), F.lit(False))

    # The first of the pair's matches gives its row: first by the claims of a, then of b, whichever of them is x here. This match is one of the four.
    k = x("_k") + y("_k")
    few = few.where((k == 0) | ~hit(0, 0) & F.when(k == 2, ~hit(0, 1) & ~hit(1, 0)).otherwise((straight == (x("_k") == 0)) | ~(hit(0, 1) & hit(1, 0))))
    few = few.withColumns({f"_m{i}{j}": F.when(hit(i, j), F.greatest(x(f"_p{i}"), y(f"_p{j}"))) for i, j in cells})
    least = lambda of: F.least(*(F.when(of(x(f"_w{i}"), y(f"_w{j}")), F.col(f"_m{i}{j}")) for i, j in cells))
    few = few.withColumns({"_x": least(lambda a, b: a & ~b), "_y": least(lambda a, b: b & ~a)})
    found.append(few.select(*names, F.least(*(F.col(f"_m{i}{j}") for i, j in cells)).alias("resource"), least(lambda a, b: a & b).alias("both_write"), F.when(straight, F.col("_y")).otherwise(F.col("_x")).alias("b_writes"), F.when(straight, F.col("_x")).otherwise(F.col("_y")).alias("a_writes")))
    if slim > 2:
        found += _by_lists(met(own.where(F.col("_n") <= slim), "_n", "_k", "_all"), slim, names, kinds, clash, first, second)
    return grouped_too() if most > slim else reduce(DataFrame.unionByName, found)


def _by_lists(met: DataFrame, slim: int, names: list[Column], kinds: dict, clash: Callable, first: Callable[[str], Column], second: Callable[[str], Column]) -> list[DataFrame]:
    """The pairs of matches, one task's claims more than two, told by lists of both tasks' claims. Lambdas keep their code small: spelled out it is more than the JVM compiles."""
    few = met.where(F.greatest("x__n", "y__n") > 2).select(*names, first("_all").alias("_a"), second("_all").alias("_b"), (first("_k") * slim + second("_k")).alias("_at"))
    inside = lambda u, v: v.is_dir & u.path.startswith(F.concat(v.path, F.lit("/")))
    hit = lambda p, q: (p.proto == q.proto) & clash(p.proto, p["mode"], q["mode"]) & ((p.path == q.path) | (p.proto == "fs") & (inside(p, q) | inside(q, p)))
    one = lambda at, a, b, path: F.struct(at.alias("_first"), path.alias("resource"), *(F.when((a == F.lit(u)) & (b == F.lit(v)), path).alias(n) for n, (u, v) in kinds.items()))
    every = F.array_compact(F.flatten(F.transform("_a", lambda p, i: F.transform("_b", lambda q, j: F.when(hit(p, q), one(i * slim + j, p["mode"] == "write", q["mode"] == "write", F.greatest(p.path, q.path)))))))
    row = lambda m: F.struct(F.get(m, F.lit(0))["_first"].alias("_first"), *(F.array_min(m[c]).alias(c) for c in ("resource", *kinds)))
    # The first of the pair's matches gives its row.
    few = few.select("*", F.inline(F.transform(F.array(every), row))).where(F.col("_first") == F.col("_at"))
    return [few.select(*[c for c in few.columns if not c.startswith("_")])]


def _with_many(found: list[DataFrame], met: DataFrame, names: list[Column], kinds: dict, first: Callable[[str], Column], second: Callable[[str], Column]) -> DataFrame:
    """found, and the pairs of matches of tasks with more claims, grouped."""
    many = met.select(*names, F.col("x_path").alias("path"), (first("mode") == "write").alias("_a"), (second("mode") == "write").alias("_b"))
    keys = [c for c in many.columns if c not in ("path", "_a", "_b")]
    rows = many.groupBy(*keys).agg(F.min("path").alias("resource"), *(F.min(F.when((F.col("_a") == F.lit(a)) & (F.col("_b") == F.lit(b)), F.col("path"))).alias(n) for n, (a, b) in kinds.items()))
    return reduce(DataFrame.unionByName, [*found, rows])


def wave_conflicts(claims: DataFrame) -> DataFrame:
    """claims (wave, task_id, proto, path, is_dir, mode). One row for each unordered pair that conflicts in a wave (see conflicts).

    The resource reported is the least of the contained paths.
    """
    return conflicts(claims, by=("wave",)).select("wave", F.col("a").alias("task_a"), F.col("b").alias("task_b"), "resource")


def shadow_audit(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """claims (task_id, path, is_dir, mode), edges (src, dst) as declared, src first. One finding at most a pair of tasks.

    Two writers of one resource are a shadow, from the declared upstream to the downstream, or implicit in id order;
    else a read of another's write without a declared order is an implicit dependency from producer to consumer. The declared order
    is asked for the pairs in question alone, as they come.
    """
    from braidwork.operators.graph import forest_intervals, ordered

    claims, marks = claims.withColumn("proto", F.lit("fs")), ("piece", "begin", "rank")
    said = lambda c: c.withColumnsRenamed({"both_write": "shadow", "b_writes": "second_writes", "a_writes": "first_writes"})
    if (own := forest_intervals(edges)) is not None:  # the order is two comparisons of numbers that tasks carry
        leads = lambda u, v: F.coalesce((F.col(f"{u}_piece") == F.col(f"{v}_piece")) & (F.col(f"{u}_begin") <= F.col(f"{v}_rank")) & (F.col(f"{v}_rank") < F.col(f"{u}_rank")), F.lit(False)).alias(f"{u}_first")
        pairs = said(conflicts(claims.join(own.withColumnRenamed("id", "task_id"), "task_id", "left"), also=marks))
        known = pairs.select("a", "b", "shadow", "second_writes", "first_writes", leads("a", "b"), leads("b", "a"))
    else:
        known = ordered(edges, said(conflicts(claims)).select("a", "b", "shadow", "second_writes", "first_writes"))
    declared, backwards = F.col("a_first") | F.col("b_first"), F.col("b_first") & ~F.col("a_first")
    is_shadow = F.col("shadow").isNotNull()
    swap = F.when(is_shadow, backwards).otherwise(F.col("second_writes").isNotNull())
    rows = known.where(is_shadow | ~declared)
    return rows.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("task_a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("task_b"), F.coalesce("shadow", "second_writes", "first_writes").alias("resource"),
        F.when(is_shadow & declared, "declared").otherwise("implicit").alias("ordering"), F.when(is_shadow, "shadow").otherwise("implicit-dependency").alias("kind"),
    )


def findings(conflicts: DataFrame, shadows: DataFrame) -> DataFrame:
    """Conflicts as errors and shadows as warnings, one table (severity, kind, task_a, task_b, resource)."""
    rows = lambda df, severity, kind: df.select(F.lit(severity).alias("severity"), kind.alias("kind"), "task_a", "task_b", "resource")
    return rows(conflicts, "error", F.lit("collision")).unionByName(rows(shadows, "warning", F.col("kind")))


def missing_outputs(writes: DataFrame, files: DataFrame) -> DataFrame:
    """Declared outputs (task_id, path) without a file (path)."""
    return writes.join(files.select("path"), "path", "left_anti")


def collapsed(claims: DataFrame, most: int = 5) -> DataFrame:
    """claims (task_id, path): a directory with more than `most` of a task's claims stands for them."""
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*/)[^/]*$", 1))
    counted = claims.distinct().withColumn("_d", folder).withColumn("_n", F.count("_d").over(Window.partitionBy("task_id", "_d")))
    return counted.select("task_id", F.when(F.col("_d").isNotNull() & (F.col("_n") > most), F.col("_d")).otherwise(F.col("path")).alias("path")).distinct()
