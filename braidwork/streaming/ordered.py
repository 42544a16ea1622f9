"""Streams in the order of event time: state with timers, so that rows that come late across batches don't change the result.

Rows wait in a list by key until the watermark has passed them, then they go in the order of (time, sequence). What comes behind the
watermark is dropped by Spark. The state store must be RocksDB's (`use_rocksdb`), which keeps lists and timers on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from braidwork.operators.trace import NODES, Process, within_root


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Waiting(StatefulProcessor):
    """Rows by key that wait for the watermark; `released` takes those that it has passed, in order, and gives what goes out."""

    rows_ddl = ""  # the waiting rows' columns: at_ms first, the order's other columns next
    order: tuple[str, ...] = ("at_ms",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows_ddl)
        self.names = [x.split()[0] for x in self.rows_ddl.split(", ")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            if not len(part):
                continue
            held = [tuple(None if x is None or x is pd.NaT or isinstance(x, float) and x != x else x.tolist() if hasattr(x, "tolist") else x for x in r) for r in part[self.names].itertuples(index=False)]
            self.waiting.appendList(held)
            low = min(r[0] for r in held)
            first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        at = [self.names.index(c) for c in self.order]
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: tuple(r[i] for i in at))
        out, left = self.released(key, rows, now)
        if left:
            self.waiting.put(left)
            self._wake(self.due(left))
        else:
            self.waiting.clear()
        if out is not None and len(out):
            yield out

    def _wake(self, ms: int) -> None:
        if not any(t == ms for t in self.handle.listTimers()):
            self.handle.registerTimer(int(ms))

    def due(self, rows: list[tuple]) -> int:
        """When the first of rows that still wait can go."""
        return rows[0][0]

    def released(self, key: tuple, rows: list[tuple], now: int) -> tuple[pd.DataFrame | None, list[tuple]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class OrderedFold(Waiting):
    """Trace events of a process, fed in the order of (time, seq)."""

    rows_ddl = "at_ms bigint, seq bigint, type string, ppid bigint, cmd array<string>, path string, mode string, cwd string"
    order = ("at_ms", "seq")

    def __init__(self, root: str):
        self.root = root

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.process = handle.getValueState("process", "ppid bigint, cmd array<string>, cwd string, reads array<string>, writes array<string>")

    def released(self, key: tuple, rows: list[tuple], now: int) -> tuple[pd.DataFrame | None, list[tuple]]:
        ready = [r for r in rows if r[0] <= now]
        p = Process(self.root, self.process.get() if self.process.exists() else None)
        for _, _, kind, ppid, cmd, path, mode, cwd in ready:
            p.feed(kind, ppid, cmd, path, mode, cwd)
        if ready and p.cmd is not None:
            self.process.update(p.state())
        out = pd.DataFrame([(key[0], *p.state())], columns=["pid", "ppid", "cmd", "cwd", "reads", "writes"]) if ready and p.cmd is not None else None
        return out, rows[len(ready) :]


def ordered_fold(events: DataFrame, root: str, ts: str = "ts") -> DataFrame:
    """trace.fold over a stream of events (ts with a watermark, seq, type, pid, ppid, cmd, path, mode, cwd). Whenever the watermark passes events of a
    process its row is given, as it is then; the last one of each process is what the batch fold gives, in whatever order the events came.

    Events without a pid or a time are dropped, as events of a process that no exec has named are.
    """
    rows = events.where(F.col("pid").isNotNull() & F.col(ts).isNotNull()).withColumn("at_ms", F.unix_millis(F.col(ts)))
    folded = rows.groupBy("pid").transformWithStateInPandas(OrderedFold(root), NODES, "append", "eventTime")
    return within_root(folded, root)


class BusyRuns(Waiting):
    """Changes of a key: a burst ends `gap` after its last one, and starts a run of `busy` unless one is going on."""

    rows_ddl = "at_ms bigint"

    def __init__(self, key: str, gap_ms: int, busy_ms: int):
        self.key, self.gap, self.busy = key, gap_ms, busy_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.free = handle.getValueState("free", "ms bigint")

    def due(self, rows: list[tuple]) -> int:
        last = rows[0][0]
        for (ms,) in rows:
            if ms - last >= self.gap:
                break
            last = ms
        return last + self.gap

    def released(self, key: tuple, rows: list[tuple], now: int) -> tuple[pd.DataFrame | None, list[tuple]]:
        free = self.free.get()[0] if self.free.exists() else None
        out, burst = [], []
        for (ms,) in [*rows, (None,)]:
            if burst and (ms is None or ms - burst[-1] >= self.gap):
                ends = burst[-1] + self.gap
                if ends > now:
                    break
                started = free is None or ends >= free
                free = ends + self.busy if started else free
                out.append((key[0], ends, len(burst), started))
                burst = []
            if ms is not None:
                burst.append(ms)
        gone = sum(o[2] for o in out)
        if free is not None:
            self.free.update((free,))
        return (pd.DataFrame(out, columns=[self.key, "ms", "n", "started"]) if out else None), rows[gone:]


def debounced_runs(changes: DataFrame, key: str, ts: str, gap_ms: int = 300, busy_ms: int = 1000) -> DataFrame:
    """(key, ms, n, started) over a stream of changes (key, ts with a watermark): each burst of n changes with less than gap_ms between neighbours triggers when it
    has been quiet for gap_ms; a trigger starts a run of busy_ms, or is dropped if one of the key is going on.

    The same as folds.debounced and folds.dropped_while_busy over the whole; bursts and runs go on across batches. Nulls are dropped.
    """
    kind = dict(changes.dtypes)[key]
    rows = changes.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("at_ms", F.unix_millis(F.col(ts)))
    return rows.groupBy(key).transformWithStateInPandas(BusyRuns(key, gap_ms, busy_ms), f"{key} {kind}, ms bigint, n bigint, started boolean", "append", "eventTime")
