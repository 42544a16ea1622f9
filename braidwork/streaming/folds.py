"""Streaming operators: the trace fold as state by process, debounced triggers, event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from braidwork.operators.trace import NODES, Process, within_root


def stream_fold(events: DataFrame, root: str) -> DataFrame:
    """events as in trace.fold, streaming. After each batch the changed processes' rows, in update mode.

    State is a process; rows of a batch are folded in the order of seq, so only rows late across batches reorder.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = Process(root, state.get if state.exists else None)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        for kind, ppid, cmd, path, mode, cwd in rows[["type", "ppid", "cmd", "path", "mode", "cwd"]].itertuples(index=False):
            p.feed(kind, None if pd.isna(ppid) else ppid, cmd, path, mode, cwd)
        state.update(p.state())
        if p.cmd is not None:
            yield pd.DataFrame([(key[0], *p.state())], columns=["pid", "ppid", "cmd", "cwd", "reads", "writes"])

    folded = events.groupBy("pid").applyInPandasWithState(update, NODES, "ppid bigint, cmd array<string>, cwd string, reads array<string>, writes array<string>", "update", GroupStateTimeout.NoTimeout)
    return within_root(folded, root)


def debounced(changes: DataFrame, key: str, ts: str, gap: str = "300 milliseconds") -> DataFrame:
    """(key, first, last, n): bursts of changes with less than `gap` between neighbours; streams need a watermark first."""
    return changes.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("w")


def dropped_while_busy(triggers: DataFrame, key: str, ts: str, busy_ms: int) -> DataFrame:
    """triggers (key, ts). (key, ts, started): a trigger starts a run unless one of the key, `busy_ms` long, is going on; it is then dropped, not queued.

    The rule is a fold in time order, streamed by sorted partition with one number of state.
    """
    kinds = dict(triggers.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free = None, None
        for part in parts:
            out = []
            for k, ms in zip(part[key], part["_ms"]):
                if k != now:
                    now, free = k, None
                started = free is None or ms >= free
                free = ms + busy_ms if started else free
                out.append(started)
            yield pd.DataFrame({key: part[key], ts: part[ts], "started": out})

    rows = triggers.select(key, ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("_ms"))
    return rows.repartition(key).sortWithinPartitions(key, "_ms").mapInPandas(run, f"{key} {kinds[key]}, {ts} {kinds[ts]}, started boolean")


def watch(spark: SparkSession, path: str, schema: str, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """A stream of the Parquet files that appear under a path."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withWatermark(ts, watermark) if watermark else stream


def completion_events(results: DataFrame) -> DataFrame:
    """One event (type, task_id, payload) for each finished task."""
    return results.select(F.lit("task_complete").alias("type"), F.col("id").alias("task_id"), F.to_json(F.struct("status", "duration_ms")).alias("payload"))


def collision_events(conflicts: DataFrame) -> DataFrame:
    """One event for each conflict."""
    return conflicts.select(F.lit("collision").alias("type"), F.col("task_a").alias("task_id"), F.to_json(F.struct("task_b", "resource")).alias("payload"))
