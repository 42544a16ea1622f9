"""Content, logic, identity and Merkle hashes, cache keys, snapshots and their differences.

Canonical forms are our own: parts are joined by NUL, lists are in code-unit order, an absent value has a marker
that no value has. Bytes therefore need not agree with hashes made of another language's JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.code import stripped
from braidwork.functions.text import dirname, language
from braidwork.plans.session import cut_lineage

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of nothing
NUL, UNSET = "\0", "\1unset"


def sha(*parts: Column) -> Column:
    """sha256 of the parts joined by NUL; nulls as the unset marker."""
    return F.sha2(F.concat_ws(NUL, *[F.coalesce(p, F.lit(UNSET)) for p in parts]), 256)


def blob_hash(content: Column) -> Column:
    return F.sha2(F.concat(F.lit(b"blob\0"), content.cast("binary")), 256)


def tree_hash(children: Column) -> Column:
    """children: array of struct(name, hash). sha256 over "tree", NUL and each child's name and hash in name order."""
    listed = F.transform(F.array_sort(children), lambda c: F.concat(c["name"], F.lit(NUL), c["hash"], F.lit(NUL)))
    return F.sha2(F.concat(F.lit(f"tree{NUL}"), F.array_join(listed, "")), 256)


def merkle_level(files: DataFrame, group: list[str]) -> DataFrame:
    """files (group..., name, hash). One tree hash a group."""
    return files.groupBy(*group).agg(tree_hash(F.collect_list(F.struct("name", "hash"))).alias("hash"))


def merkle(files: DataFrame) -> DataFrame:
    """files (path, hash). (path, hash) of every directory, '.' the root, bottom-up, one job a level of depth."""
    now = files.select("path", "hash")
    deepest = files.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    out, waiting = None, cut_lineage(now.withColumn("d", F.size(F.split("path", "/"))), "merkle")
    for depth in range(deepest, 0, -1):
        level = waiting.where(F.col("d") == depth).select(dirname(F.col("path")).alias("path"), F.regexp_extract("path", "[^/]+$", 0).alias("name"), "hash")
        made = merkle_level(level, ["path"]).withColumn("d", F.lit(depth - 1))
        waiting = cut_lineage(waiting.where(F.col("d") < depth).unionByName(made), "merkle")
        out = made.select("path", "hash") if out is None else out.unionByName(made.select("path", "hash"))
    return files.limit(0).select("path", "hash") if out is None else out


def merkle_updated(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """tree (path, hash) of files and directories ('.' the root), changes (path, hash) of files, new and changed ones; a null hash takes a file away. The tree as it is
    then: hashes of the changed files' ancestors are made anew, from their children; the rest of the tree is only passed on. A directory that has no child left goes.
    """
    depth = F.when(F.col("path") == ".", 0).otherwise(F.size(F.split("path", "/")))
    above = dirname(F.col("path"))
    waiting = cut_lineage(changes.select("path", "hash").distinct().withColumn("d", depth), "changes")
    deepest = waiting.agg(F.max("d")).first()[0] or 0
    done = waiting
    for level in range(deepest, 0, -1):
        now = waiting.where(F.col("d") == level)
        parents = now.select(above.alias("parent")).distinct()
        beside = tree.where(depth == level).withColumn("parent", above).join(parents, "parent", "left_semi").join(now.select("path"), "path", "left_anti").select("path", "hash")
        children = beside.unionByName(now.where(F.col("hash").isNotNull()).select("path", "hash")).select(above.alias("path"), F.regexp_extract("path", "[^/]+$", 0).alias("name"), "hash")
        made = cut_lineage(parents.withColumnRenamed("parent", "path").join(merkle_level(children, ["path"]), "path", "left").withColumn("d", F.lit(level - 1)), "merkle")
        waiting, done = waiting.where(F.col("d") < level).unionByName(made), done.unionByName(made)
    return tree.select("path", "hash").join(done.select("path"), "path", "left_anti").unionByName(done.where(F.col("hash").isNotNull()).select("path", "hash"))


def logic_hash(source: Column, path: Column) -> Column:
    """sha256 of the source without comments and with white space collapsed; of the source itself in unknown languages."""
    return F.when(language(path).isNull(), F.sha2(source, 256)).otherwise(F.sha2(stripped(source, language(path)), 256))


def snapshot(files: DataFrame) -> DataFrame:
    """files (path, content). (path, content_hash, logic_hash)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), logic_hash(F.col("content").cast("string"), F.col("path")).alias("logic_hash"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): changed (new and deleted files too) or logically-unchanged; files that are as they were aren't listed."""
    side = lambda df, s: df.select("path", F.col("content_hash").alias(f"c{s}"), F.col("logic_hash").alias(f"l{s}"))
    both = side(before, 0).join(side(after, 1), "path", "full_outer").where(~F.col("c0").eqNullSafe(F.col("c1")))
    return both.select("path", F.when(F.col("l0") == F.col("l1"), "logically-unchanged").otherwise("changed").alias("change"))


def cache_keys(tasks: DataFrame, inputs: DataFrame, files: DataFrame, env: DataFrame, version: str = "1") -> DataFrame:
    """tasks (id, cmd array, writes array, env_reads array), inputs (id, path), files (path, content_hash, logic_hash),
    env (name, value). (id, key). Tasks with outputs are keyed by content, the others by logic; a missing file is EMPTY;
    a set variable is name=value, one that is unset its name alone."""
    by_content = tasks.select("id", (F.size(F.coalesce("writes", F.expr("cast(array() as array<string>)"))) > 0).alias("content"))
    hashed = inputs.join(by_content, "id").join(files, "path", "left").withColumn("h", F.coalesce(F.when(F.col("content"), F.col("content_hash")).otherwise(F.col("logic_hash")), F.lit(EMPTY)))
    listed = hashed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("path", "h"))), lambda x: F.concat_ws(NUL, x.path, x.h)), NUL).alias("files"))
    named = tasks.select("id", F.explode(F.array_distinct("env_reads")).alias("name")).join(env, "name", "left")
    variables = named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda x: F.when(x["value"].isNull(), x["name"]).otherwise(F.concat_ws("=", x["name"], x["value"]))), NUL).alias("vars"))
    return tasks.join(listed, "id", "left").join(variables, "id", "left").select("id", sha(F.lit(version), F.col("id"), F.to_json("cmd"), F.coalesce("files", F.lit("")), F.coalesce("vars", F.lit(""))).alias("key"))


def set_hash(rows: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group..., hash) of the distinct items in code-unit order."""
    return rows.groupBy(*group).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(item)), NUL), 256).alias("hash"))


def identity(logic: Column, claim: Column, platform: Column) -> Column:
    """struct(logic, claim, platform, combined)."""
    parts = [F.sha2(c, 256) for c in (logic, claim, platform)]
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("logic", "claim", "platform"))], sha(*parts).alias("combined"))


def comment_only(before: Column, after: Column) -> Column:
    """Whether two versions differ in // and block comments and white space alone."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", ""), r"\s+", "")
    return (before != after) & (bare(before) == bare(after))


def fresh(cached: DataFrame, now: DataFrame) -> DataFrame:
    """Paths whose length and times are those cached."""
    return cached.join(now, ["path", "length", "modificationTime"], "left_semi").select("path")


def stale(config_ms: Column, lock_ms: Column) -> Column:
    return lock_ms.isNull() | (config_ms > lock_ms)
