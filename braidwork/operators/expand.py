"""Expansion of task definitions: matrices, workspaces, imports, identifiers, constraint checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import dirname, folded_path, slug, sorted_set

#: Fixed limits of a matrix, and the prefix of the variables that it sets.
AXES, ROWS, MATRIX = 4, 256, "MATRIX_"


def cartesian_size(matrix: Column) -> Column:
    """The number of rows a matrix (map of arrays) expands to."""
    return F.aggregate(F.map_values(matrix), F.lit(1), lambda a, v: a * F.size(v))


def matrix_rows(tasks: DataFrame) -> DataFrame:
    """tasks (id, matrix map<string, array<string>>, ...). One row a combination, axes and values in order.

    id gets a suffix `-axis=value-axis=value`, `env` (the task's own, if it has one) the variables of the axes. A task without
    a matrix stays as it is. More than four axes or 256 rows, an axis without values, and names or values of other
    characters than letters, digits, dots, dashes and underscores fail the query (`matrix_violations` lists them).
    """
    axes = F.array_sort(F.map_keys("matrix"))
    start = F.array(F.expr("cast(array() as array<struct<axis:string,value:string>>)"))
    grow = lambda acc, axis: F.flatten(F.transform(acc, lambda row: F.transform(F.array_sort(F.col("matrix")[axis]), lambda v: F.concat(row, F.array(F.struct(axis.alias("axis"), v.alias("value")))))))
    sized = tasks.withColumn("_rows", F.when(F.col("matrix").isNull() | (F.size("matrix") == 0), start).when(F.size(_faults(F.col("matrix"))) == 0, F.aggregate(axes, start, grow)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("matrix of"), F.col("id").cast("string"), F.lit("breaks"), F.array_join(_faults(F.col("matrix")), ", ")))))
    one = sized.withColumn("_row", F.explode("_rows")).drop("_rows")
    label = F.array_join(F.transform("_row", lambda x: F.concat_ws("=", x.axis, x.value)), "-")
    env = F.map_from_arrays(F.transform("_row", lambda x: F.concat(F.lit(MATRIX), F.upper(x.axis))), F.transform("_row", lambda x: x.value))
    if "env" in tasks.columns:
        own = F.coalesce("env", F.expr("cast(map() as map<string,string>)"))
        env = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(env), k)), env)
    return one.withColumn("id", F.when(F.size("_row") == 0, F.col("id")).otherwise(F.concat(F.col("id"), F.lit("-"), label))).withColumn("env", env).drop("_row", "matrix")


def _faults(matrix: Column) -> Column:
    """The rules that a matrix breaks."""
    bad = lambda s: ~s.rlike("^[a-zA-Z0-9_.-]+$")
    return F.array_compact(F.array(
        F.when(F.size(matrix) > AXES, F.lit("matrix-axes")), F.when(cartesian_size(matrix) > ROWS, F.lit("matrix-rows")), F.when(F.exists(F.map_values(matrix), lambda v: F.size(v) == 0), F.lit("matrix-empty")),
        F.when(F.exists(F.map_keys(matrix), bad), F.lit("matrix-axis")), F.when(F.exists(F.flatten(F.map_values(matrix)), bad), F.lit("matrix-value")),
    ))


def matrix_faults(tasks: DataFrame) -> DataFrame:
    """(id, rule) for every rule that a task's matrix breaks."""
    return tasks.where(F.col("matrix").isNotNull()).select("id", F.explode(_faults(F.col("matrix"))).alias("rule"))


def matrix_violations(tasks: DataFrame) -> DataFrame:
    """(id, axes, rows) of matrices beyond the limits."""
    return tasks.select("id", F.size("matrix").alias("axes"), cartesian_size(F.col("matrix")).alias("rows")).where((F.col("axes") > AXES) | (F.col("rows") > ROWS))


def workspace_tasks(packages: DataFrame, scripts: DataFrame, depends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """packages (package, internal array), scripts (script, package), depends (script, on). (tasks (id, package, script), edges (src, dst)).

    `^x` waits for script x of the packages depended upon, `x` for that of the same package; only scripts that a
    package has make tasks, and edges lead to tasks that exist. Equi-joins on package and script throughout.
    """
    own = scripts.join(depends.select("script").distinct(), "script", "left_semi").select("package", "script")
    tasks = own.select(F.concat_ws("#", "package", "script").alias("id"), "package", "script")
    wanted = tasks.join(depends, "script")
    up = wanted.where(F.col("on").startswith("^")).join(packages.select("package", F.explode("internal").alias("other")), "package").select("id", F.col("other").alias("package"), F.expr("substring(on, 2)").alias("script"))
    same = wanted.where(~F.col("on").startswith("^")).select("id", "package", F.col("on").alias("script"))
    edges = up.unionByName(same).join(own, ["package", "script"], "left_semi").select(F.concat_ws("#", "package", "script").alias("src"), F.col("id").alias("dst")).distinct()
    return tasks, edges


def internal_dependencies(depends: DataFrame, packages: DataFrame) -> DataFrame:
    """Dependencies (package, name) on packages of the workspace."""
    return depends.join(packages.select(F.col("package").alias("name")), "name", "left_semi").select("package", "name")


def with_scripts(packages: DataFrame, scripts: DataFrame, default: str) -> DataFrame:
    """(package, command), the default for packages without a script."""
    return packages.join(scripts, "package", "left").select("package", F.coalesce("command", F.lit(default)).alias("command"))


def resolve_imports(files: DataFrame, imports: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """files (id), imports (source, target, kind). (source, target, kind, resolved): the first candidate that is a file.

    Candidates in order: from the file's directory then from the root; as written, then for each suffix with it, as
    index and as __init__ of a package directory. A path that leaves the root is none. Every candidate meets files by equality.
    """
    bases = [F.when(dirname(F.col("source")) == ".", F.col("target")).otherwise(F.concat_ws("/", dirname(F.col("source")), "target")), F.col("target")]
    folded = imports.select("source", "target", "kind", *[folded_path(b).alias(f"_{n}") for n, b in enumerate(bases)])
    inside = lambda c: F.when(~F.col("target").startswith("/") & ~F.split(c, "/")[0].isin("..", ""), F.when(F.col(c) == ".", "").otherwise(F.concat(c, F.lit("/"))))
    tails = ["", *[t for s in suffixes for t in (s, f"/index{s}", f"/__init__{s}")]]
    made = lambda c, t: F.concat(inside(c), F.lit(t[1:])) if t[:1] == "/" else F.concat(F.regexp_replace(inside(c), "/$", ""), F.lit(t))
    candidates = F.array(*[F.struct(F.lit(n).alias("rank"), made(c, t).alias("id")) for n, (c, t) in enumerate((c, t) for c in ("_0", "_1") for t in tails)])
    tried = folded.select("source", "target", "kind", F.explode(candidates).alias("c")).select("source", "target", "kind", "c.rank", "c.id")
    found = tried.join(files.select("id"), "id")
    return found.groupBy("source", "target", "kind").agg(F.min_by("id", "rank").alias("resolved"))


def duplicate_ids(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unique_ids(names: DataFrame) -> DataFrame:
    """names (seq, name). (seq, id): slugs in the order of seq, one that is taken with the first of -2, -3, ... that isn't.

    An id can only meet one of the same root, its slug without numbers at the end. Rows stream by root through sorted partitions;
    what is kept of a root is its different slugs, each with the last number given out.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, last = None, {}  # slugs taken as they are; s-2 to s-n are taken for last[s] = n

        def taken(x: str) -> bool:
            base, _, n = x.rpartition("-")
            return x in last or n.isdigit() and n[0] != "0" and 2 <= int(n) <= last.get(base, 0)

        for part in parts:
            out = []
            for r, own in zip(part["_root"], part["slug"]):
                if r != root:
                    root, last = r, {}
                if not taken(own):
                    last[own] = 1
                    out.append(own)
                    continue
                n = last.get(own, 1) + 1
                while taken(f"{own}-{n}"):
                    n += 1
                last[own] = n
                out.append(f"{own}-{n}")
            yield pd.DataFrame({"seq": part["seq"], "id": out})

    kind = dict(names.dtypes)["seq"]
    made = names.select("seq", slug(F.col("name")).alias("slug")).withColumn("_root", F.regexp_replace("slug", "(-[0-9]+)+$", ""))
    return made.repartition("_root").sortWithinPartitions("_root", "seq").mapInPandas(run, f"seq {kind}, id string")


#: Lists of a task that hold paths or claims.
PATHS = ("inputs", "outputs", "claims")


def normal_tasks(tasks: DataFrame) -> DataFrame:
    """Every list distinct and in code-unit order (cmd stays as it is), forward slashes in paths and claims, env by key,
    a timeout of 300000 and a cache of true where unset."""
    lists = [c for c, t in tasks.dtypes if t == "array<string>" and c != "cmd"]
    slashed = lambda c: F.transform(F.col(c), lambda x: F.translate(x, "\\", "/"))
    out = tasks.withColumns({c: sorted_set(slashed(c) if c in PATHS else F.col(c)) for c in lists})
    if "cmd" in out.columns:
        out = out.withColumn("cmd", F.coalesce("cmd", F.expr("cast(array() as array<string>)")))
    if "timeout" in out.columns:
        out = out.withColumn("timeout", F.coalesce("timeout", F.lit(300_000)))
    if "cache" in out.columns:
        out = out.withColumn("cache", F.coalesce("cache", F.lit(True)))
    if "cwd" in out.columns:
        out = out.withColumn("cwd", F.nullif(F.translate("cwd", "\\", "/"), F.lit("")))
    if "env" in out.columns:
        out = out.withColumn("env", F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("env", F.expr("cast(map() as map<string,string>)"))))))
    return out


def constraint_violations(tasks: DataFrame) -> DataFrame:
    """tasks (id, cmd, deps, matrix). (id, rule) for every rule that a task breaks; cycles are `graph.cyclic`."""
    rules = F.array_compact(F.array(
        F.when(~F.col("id").rlike("^[a-zA-Z0-9_-]+$"), F.lit("id")), F.when(F.coalesce(F.size("cmd"), F.lit(0)) < 1, F.lit("cmd")), F.when(F.array_contains("deps", F.col("id")), F.lit("self-dependency")),
        F.when(F.size("matrix") > AXES, F.lit("matrix-axes")), F.when(cartesian_size(F.col("matrix")) > ROWS, F.lit("matrix-rows")),
    ))
    own = tasks.select("id", F.explode(rules).alias("rule"))
    wanted = tasks.select("id", F.explode("deps").alias("dep"))
    missing = wanted.join(tasks.select(F.col("id").alias("dep")), "dep", "left_anti").select("id", F.lit("unknown-dependency").alias("rule"))
    return own.unionByName(missing.distinct())


def gate(platforms: Column, platform: Column, branch_ok: Column) -> Column:
    """Whether a task's condition holds: its platforms (null or empty: all) have this one, and its branch pattern fits."""
    return (platforms.isNull() | (F.size(platforms) == 0) | F.array_contains(platforms, platform)) & F.coalesce(branch_ok, F.lit(True))


def allowed_env(env: Column, claimed: Column, always: tuple[str, ...] = ("PATH", "HOME", "USER", "TMPDIR", "TERM")) -> Column:
    """The present variables that are claimed or always passed."""
    return F.map_filter(env, lambda k, _: k.isin(*always) | F.array_contains(claimed, k))


def classified_settings(settings: DataFrame, dimension: DataFrame) -> DataFrame:
    """settings (kind flag|env, name), dimension (kind, name, class). (kind, name, class): noise is dropped, unknown flags
    are logic and unknown variables claims. The dimension is a fixed list, small enough for every task."""
    known = settings.join(dimension, ["kind", "name"], "left")
    return known.select("kind", "name", F.coalesce("class", F.when(F.col("kind") == "flag", "logic").otherwise("claim")).alias("class")).where(F.col("class") != "noise")
