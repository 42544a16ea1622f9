"""Python data sources: a store of objects by hash, and a sink that delivers a stream's events once.

Both reach their storage through Arrow's file systems, so any that has a URI there will do. Tasks write to staging folders; what they wrote
takes its place when all have ended, and goes if one fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

#: Objects that a task opens, wanted names that are pushed down, rows of one delivered file.
OPENED, PUSHED = 64, 10_000
_NAME = re.compile(r"(?!.*\.\.)[a-zA-Z0-9_.-]+")


def storage(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


@dataclass
class Names(InputPartition):
    names: list[str]


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class ObjectStore(DataSource):
    """Objects (hash, content) of a folder; names that may not stand in a path aren't read, and fail a write."""

    @classmethod
    def name(cls) -> str:
        return "braidwork_objects"

    def schema(self) -> str:
        return "hash string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ObjectReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ObjectWriter(self.options["path"])


class ObjectReader(DataSourceReader):
    """Opens the objects that filters on the hash name, all of them without one."""

    def __init__(self, path: str):
        self.path, self.names = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("hash",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = named if self.names is None else self.names & named
            else:
                yield f

    def partitions(self) -> list[Names]:
        names = self.names
        if names is None:
            store, base = storage(self.path)
            names = [x.base_name for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.is_file]
        names = sorted(n for n in names if n is not None and _NAME.fullmatch(n))
        return [Names(names[i : i + OPENED]) for i in range(0, len(names), OPENED)] or [Names([])]

    def read(self, partition: Names) -> Iterator[tuple[str, bytes]]:
        store, base = storage(self.path)
        for x in store.get_file_info([f"{base}/{n}" for n in partition.names]):
            if x.is_file:
                with store.open_input_stream(x.path) as f:
                    yield x.base_name, f.read()


class ObjectWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Staged:
        store, base = storage(self.path)
        folder, names = f"{base}/.staged-{uuid.uuid4().hex}", []
        store.create_dir(folder)
        for row in iterator:
            if not row["hash"] or not _NAME.fullmatch(row["hash"]):
                raise ValueError(f"no name for an object: {row['hash']}")
            with store.open_output_stream(f"{folder}/{row['hash']}") as f:
                f.write(bytes(row["content"] or b""))
            names.append(row["hash"])
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = storage(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{m.folder}/{name}", f"{base}/{name}")
        self._cleared(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        self._cleared(messages)

    def _cleared(self, messages: list[Staged | None]) -> None:
        store, _ = storage(self.path)
        for m in messages:
            if m and store.get_file_info(m.folder).type == fs.FileType.Directory:
                store.delete_dir(m.folder)


class EventSink(DataSource):
    """Takes a stream's rows as JSON lines; a batch that is tried again is delivered once."""

    @classmethod
    def name(cls) -> str:
        return "braidwork_events"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return EventWriter(self.options["path"])


class EventWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Staged:
        """Lines go to a staging file as they come: no batch is held."""
        store, base = storage(self.path)
        folder = f"{base}/.staged-{uuid.uuid4().hex}"
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/rows") as f:
            for row in iterator:
                f.write(json.dumps(row.asDict(recursive=True), default=str).encode() + b"\n")
        return Staged(folder, ["rows"])

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        """What the batch's tasks staged becomes its files, unless the batch has been delivered before."""
        store, base = storage(self.path)
        mark = f"{base}/committed/{batchId}"
        if store.get_file_info(mark).type == fs.FileType.NotFound:
            store.create_dir(f"{base}/events")
            for x in store.get_file_info(fs.FileSelector(f"{base}/events")):  # of a try that ended before its mark
                if x.base_name.startswith(f"batch-{batchId}-"):
                    store.delete_file(x.path)
            for k, m in enumerate(m for m in messages if m):
                store.move(f"{m.folder}/rows", f"{base}/events/batch-{batchId}-{k}.json")
            store.create_dir(f"{base}/committed")
            with store.open_output_stream(mark) as f:
                f.write(b"1")
        self.abort(messages, batchId)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        store, _ = storage(self.path)
        for m in messages:
            if m and store.get_file_info(m.folder).type == fs.FileType.Directory:
                store.delete_dir(m.folder)


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectStore)
    spark.dataSource.register(EventSink)
    return spark


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The objects (hash, content) of a store's folder."""
    return registered(spark).read.format("braidwork_objects").option("path", root).load()


def push(objects: DataFrame, root: str) -> None:
    """Objects (hash, content) into a store's folder: all of them, or none that wasn't there before if a task fails. One of a name is replaced."""
    registered(objects.sparkSession)
    objects.select("hash", "content").write.format("braidwork_objects").option("path", root).mode("append").save()


def pulled(wanted: DataFrame, root: str, pushed: int = PUSHED) -> DataFrame:
    """wanted (hash). (hash, found, content) of the objects of these names in a store's folder; a missing one, or a name that may
    not stand in a path, is not found. Up to `pushed` different names are filters of the source, which then opens these objects alone; of more the store is read and joined."""
    names = [r[0] for r in wanted.select("hash").where(F.col("hash").isNotNull()).distinct().limit(pushed + 1).collect()]  # at most `pushed` and one
    held = stored(wanted.sparkSession, root)
    held = held.where(F.col("hash").isin(names)) if len(names) <= pushed else held
    return wanted.join(held, "hash", "left").select("hash", F.col("content").isNotNull().alias("found"), "content")


def deliver(stream: DataFrame, path: str, checkpoint: str):
    """All that a stream has, each batch once, as JSON lines in path/events."""
    registered(stream.sparkSession)
    return stream.writeStream.format("braidwork_events").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
