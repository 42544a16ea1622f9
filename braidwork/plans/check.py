"""Projects checked from their configuration files: what is wrong with them, how they would be run, and what their tasks do to one another.

All projects below a path are checked together; a task's name has its project before it, so that projects never meet.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.text import folded_path, protocol, resource, slug
from braidwork.operators import claims, expand, graph
from braidwork.plans.session import cut_lineage
from braidwork.sources import configs

FINDING = ("project", "severity", "kind", "task_a", "task_b", "resource")


class Checked(NamedTuple):
    #: (project, severity error|warning, kind, task_a, task_b, resource)
    findings: DataFrame
    #: (id, wave) of the tasks of projects without errors
    waves: DataFrame


def _named(project, id_):
    return F.concat(project, F.lit("__"), id_)


def _found(rows: DataFrame, severity: str, kind, task_a, task_b=None, resource_=None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return rows.select("project", F.lit(severity).alias("severity"), kind.alias("kind"), text(task_a).alias("task_a"), text(task_b).alias("task_b"), text(resource_).alias("resource"))


def _of(task) -> object:
    return F.split_part(task, F.lit("__"), F.lit(1))


def check(spark: SparkSession, path: str) -> Checked:
    """Configurations, broken rules, cycles, matrices, waves, what collides in a wave, what is shadowed or read without a declared order.

    A project whose configuration breaks a rule, has a cycle, or depends on a task that its matrices have replaced has only errors: nothing of it is planned.
    A file without tasks, or that isn't JSON, is an error by its path. Names of projects become slugs; one without a name has its file's.
    """
    broken = configs.config_violations(spark, path).select(F.col("path").alias("project"), "rule")
    read = configs.read_config(spark, path)
    name = slug(F.coalesce("project", F.regexp_extract("path", "([^/]*)$", 1)))
    rows = read.withColumn("project", F.replace(name, F.lit("__"), F.lit("_"))).withColumn("_base", F.col("id"))
    own = cut_lineage(expand.normal_tasks(rows.drop("path").withColumns({"id": _named(F.col("project"), F.col("id")), "dependencies": F.transform(F.coalesce("dependencies", F.expr("cast(array() as array<string>)")), lambda d: _named(F.col("project"), d))})), "configured")
    rules = expand.constraint_violations(own.select("id", "cmd", F.col("dependencies").alias("deps"), "matrix")).unionByName(expand.matrix_faults(own)).distinct()
    declared = own.select(F.explode("dependencies").alias("src"), F.col("id").alias("dst"))
    rules = cut_lineage(rules.unionByName(graph.cyclic(own.select("id"), declared).select("id", F.lit("cycle").alias("rule"))).withColumn("project", _of(F.col("id"))), "rules")
    sound = own.join(rules.select("project").distinct(), "project", "left_anti")
    tasks = cut_lineage(expand.matrix_rows(sound), "tasks")
    edges = tasks.select(F.explode("dependencies").alias("src"), F.col("id").alias("dst"))
    late = expand.duplicate_ids(tasks).select("id", F.lit("duplicate-id").alias("rule")).unionByName(graph.unresolved(edges, tasks).select(F.col("dst").alias("id"), F.lit("unresolved-dependency").alias("rule")).distinct())
    late = cut_lineage(late.withColumn("project", _of(F.col("id"))), "late")
    tasks = cut_lineage(tasks.join(late.select("project").distinct(), "project", "left_anti"), "planned")
    edges = cut_lineage(tasks.select(F.explode("dependencies").alias("src"), F.col("id").alias("dst")), "declared")

    # To plan, what a task touches is its alone: inputs, outputs and fs claims whichever way, by whole segments; other claims as they are.
    none = F.expr("cast(array() as array<string>)")
    touched = tasks.select("id", "project", F.explode(F.array_distinct(F.concat(F.transform(F.concat(F.coalesce("inputs", none), F.coalesce("outputs", none)), lambda p: F.concat(F.lit("fs:"), p)), F.coalesce("claims", none)))).alias("claim"))
    is_fs = protocol(F.col("claim")) == "fs"
    place = F.when(is_fs, folded_path(resource(F.col("claim")))).otherwise(F.col("claim"))
    planned = touched.select(F.col("id").alias("task_id"), F.concat("project", F.lit("/"), place).alias("path"), is_fs.alias("is_dir"), F.lit("write").alias("mode"))
    coloured = graph.claim_colours(graph.depths(tasks.select("id"), edges), planned)
    waves = cut_lineage(graph.waves(coloured), "waves")

    # To verify, inputs are read and outputs written, and a directory holds what is below it only with its slash.
    def side(column: str, mode: str, proto: str | None = None) -> DataFrame:
        each = tasks.select("id", "project", F.explode(F.coalesce(column, none)).alias("c"))
        if proto:
            return each.select(F.col("id").alias("task_id"), F.lit(proto).alias("proto"), F.concat("project", F.lit("/"), "c").alias("path"), F.lit(False).alias("is_dir"), F.lit(mode).alias("mode"))
        one = each.withColumn("n", claims.normalised_claim(F.col("c")))
        return one.select(F.col("id").alias("task_id"), F.col("n.proto").alias("proto"), F.concat("project", F.lit("/"), F.regexp_replace("n.path", "/$", "")).alias("path"), F.col("n.is_dir").alias("is_dir"), F.lit(mode).alias("mode"))

    paths = cut_lineage(side("inputs", "read").unionByName(side("outputs", "write")), "paths")
    rest = side("needsEnv", "read", "env").unionByName(side("providesEnv", "write", "env")).unionByName(side("claims", "write").where("proto != 'fs'"))
    conflicts = claims.wave_conflicts(paths.unionByName(rest).join(waves.select(F.col("id").alias("task_id"), "wave"), "task_id")).withColumn("project", _of(F.col("task_a")))
    shadows = claims.shadow_audit(paths.drop("proto"), edges).withColumn("project", _of(F.col("task_a")))
    bare = F.regexp_replace("resource", "^[^/]*/", "")
    found = _found(broken, "error", F.col("rule"), None)
    found = found.unionByName(_found(rules.unionByName(late), "error", F.col("rule"), F.col("id")))
    found = found.unionByName(_found(conflicts, "error", F.lit("collision"), F.col("task_a"), F.col("task_b"), bare))
    return Checked(found.unionByName(_found(shadows, "warning", F.col("kind"), F.col("task_a"), F.col("task_b"), bare)).select(*FINDING), waves)
