"""Cache-ledger telemetry: lookups, upserts, hit statistics, forecasts, the lookup waterfall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOGICAL, CONTENT, MISS = "LOGICAL_HIT", "CONTENT_HIT", "MISS"


def json_number(column: str, path: str) -> Column:
    return F.coalesce(F.get_json_object(column, path).cast("double"), F.lit(0.0))


def lookup(ledger: DataFrame, logic_hash: str) -> DataFrame:
    return ledger.where(F.col("logic_hash") == logic_hash)


def latest(ledger: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row by `order` of each key."""
    return ledger.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def latest_success(ledger: DataFrame, task_id: str, column: str, value: str) -> DataFrame:
    """The newest row of a task with exit code 0 whose hash column has the value."""
    return ledger.where((F.col("task_id") == task_id) & (F.col(column) == value) & (F.col("exit_code") == 0)).orderBy(F.desc("timestamp"), "logic_hash").limit(1)


def upsert(ledger: DataFrame, incoming: DataFrame, key: str = "logic_hash", order: str = "timestamp") -> DataFrame:
    """The ledger with incoming rows in place of those of their keys, whole rows, the last by `order` of each key."""
    new = latest(incoming, [key], [F.desc(order), *[F.desc(c) for c in incoming.columns if c not in (key, order)]])
    return ledger.join(new.select(key), key, "left_anti").select(*ledger.columns).unionByName(new.select(*ledger.columns))


def tax_saved(runs: DataFrame, hit: Column, tax: Column, duration: Column, jitter: Column) -> DataFrame:
    """One row: tax and duration sums and number of logical hits, their ratio (0 without duration), jitter of all runs."""
    own = lambda x: F.coalesce(F.sum(F.when(hit == LOGICAL, x)), F.lit(0.0))
    sums = runs.agg(own(tax).alias("tax_ms"), own(duration).alias("duration_ms"), F.count(F.when(hit == LOGICAL, 1)).alias("hits"), F.coalesce(F.sum(jitter), F.lit(0.0)).alias("jitter_ms"))
    return sums.withColumn("ratio", F.when(F.col("duration_ms") > 0, F.col("tax_ms") / F.col("duration_ms")).otherwise(0.0))


def bottleneck(runs: DataFrame, task: str, duration: str) -> DataFrame:
    """(task_id, duration_ms) of the longest run, ties by task; a (none) row without runs."""
    top = runs.select(F.col(task).cast("string").alias("task_id"), F.col(duration).cast("double").alias("duration_ms"), F.lit(0).alias("_o"))
    none = runs.sparkSession.range(1).select(F.lit("(none)").alias("task_id"), F.lit(0.0).alias("duration_ms"), F.lit(1).alias("_o"))
    return top.unionByName(none).orderBy("_o", F.desc("duration_ms"), "task_id").limit(1).drop("_o")


def hit_stats(runs: DataFrame, hit: Column, duration: Column) -> DataFrame:
    """Runs, hits by kind and total duration, one row."""
    n = lambda kind: F.count(F.when(hit == kind, 1))
    return runs.agg(F.count(F.lit(1)).alias("total"), n(LOGICAL).alias("logical_hits"), n(CONTENT).alias("content_hits"), n(MISS).alias("misses"), F.coalesce(F.sum(duration), F.lit(0.0)).alias("duration_ms"))


def forecast(runs: DataFrame, window: int = 100) -> DataFrame:
    """runs (task_id, seq, duration_ms, hit boolean). Mean and population deviation of the last `window` runs, the
    chance of a miss over all, and the score deviation / mean within 0..1 (0 for a mean of 0)."""
    ranked = runs.withColumn("_n", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("seq"))))
    recent = F.when(F.col("_n") <= window, F.col("duration_ms"))
    out = ranked.groupBy("task_id").agg(F.avg(recent).alias("mean_ms"), F.stddev_pop(recent).alias("sd_ms"), F.avg(F.when(F.col("hit"), 0.0).otherwise(1.0)).alias("miss_probability"))
    return out.withColumn("score", F.when(F.col("mean_ms") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("sd_ms") / F.col("mean_ms")))).otherwise(0.0))


def forecast_for(tasks: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Every task's forecast; 1000 ms, 0.5 and 0.5 without a history."""
    return tasks.select("task_id").join(forecasts, "task_id", "left").select("task_id", F.coalesce("mean_ms", F.lit(1000.0)).alias("mean_ms"), F.coalesce("sd_ms", F.lit(0.0)).alias("sd_ms"), F.coalesce("miss_probability", F.lit(0.5)).alias("miss_probability"), F.coalesce("score", F.lit(0.5)).alias("score"))


def waterfall(tasks: DataFrame, remote: DataFrame, local: DataFrame, artifacts: DataFrame) -> DataFrame:
    """tasks (id, key, gate, has_outputs) by where their result comes from: condition-skip, l2-hit, l1-hit or execute.

    The gate is before any lookup; a local hit of a task with outputs needs its artifact as well.
    """
    flag = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
    known = tasks.join(flag(remote, "l2"), "key", "left").join(flag(local, "l1"), "key", "left").join(flag(artifacts, "kept"), "key", "left")
    usable = F.col("l1") & (~F.col("has_outputs") | F.col("kept").isNotNull())
    return known.select("id", F.when(~F.col("gate"), "condition-skip").when(F.col("l2"), "l2-hit").when(usable, "l1-hit").otherwise("execute").alias("source"))


def order_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median (middles averaged), p99 (the one at floor(0.99 n), no interpolation), least and greatest of each group.

    Positions come from a window's ranks, sorted with spill, so that no group is gathered into an array.
    """
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_c", F.count(F.lit(1)).over(w))
    r, n, v = F.col("_r"), F.col("_c"), F.col(value)
    middle = (r == F.floor((n - 1) / 2)) | (r == F.floor(n / 2))
    return ranked.groupBy(*keys).agg(F.avg(F.when(middle, v)).alias("median"), F.max(F.when(r == F.floor(n * 0.99), v)).alias("p99"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def counters(events: DataFrame, hit: Column, size: Column) -> DataFrame:
    """hits, misses and bytes read on hits."""
    return events.agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(~hit, 1)).alias("misses"), F.coalesce(F.sum(F.when(hit, size)), F.lit(0)).cast("bigint").alias("bytes"))


def status(cached: Column, by_condition: Column, skipped: Column, exit_code: Column) -> Column:
    """cached, condition-skip, dep-skip, failed or ok, the first that fits."""
    return F.when(cached, "cached").when(by_condition, "condition-skip").when(skipped, "dep-skip").when(exit_code != 0, "failed").otherwise("ok")


def build_summary(results: DataFrame) -> DataFrame:
    """results (status). Counts by status; total is without condition-skips."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return results.agg(n("cached", "dep-skip", "failed", "ok").alias("total"), n("cached").alias("cached"), n("dep-skip").alias("skipped"), n("failed").alias("failed"), n("ok").alias("executed"))
