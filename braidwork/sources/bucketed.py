"""A ledger in buckets of its key: an upsert writes the buckets that it touches and leaves the others where they are.

A version is a manifest, a small file that says where each bucket's rows are. It appears whole, by a rename that fails if another writer
was first; readers keep the version they began with. What no kept manifest names can be removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.ledger import upsert as merged

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made the version that this one would have made."""


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    store, p = _files(spark, f"{path}/manifest")
    return sorted(int(s.getPath().getName()) for s in store.listStatus(p) if s.getPath().getName().isdigit()) if store.exists(p) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """version, key, order, schema, number of buckets, and the folder of each that has rows; the last version if none is named."""
    known = _versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no ledger at {path}")
    version = known[-1] if version is None else version
    return json.loads(spark.read.text(f"{path}/manifest/{version}", wholetext=True).first()[0]) | {"version": version}


def _commit(spark: SparkSession, path: str, found: dict) -> None:
    store, target = _files(spark, f"{path}/manifest/{found['version']}")
    _, staged = _files(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = store.create(staged)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    if store.exists(target) or not store.rename(staged, target):
        store.delete(staged, False)
        raise Conflict(f"version {found['version']} of {path} exists")


def _written(rows: DataFrame, path: str, key: str, n: int) -> dict[str, str]:
    """The folder of each bucket that rows have, after they are written, a file or a few each."""
    base, spark = f"{path}/data/{uuid.uuid4().hex}", rows.sparkSession
    rows.withColumn("_bucket", _bucket(key, n)).repartition("_bucket").write.partitionBy("_bucket").parquet(base)
    store, p = _files(spark, base)
    return {s.getPath().getName().removeprefix("_bucket="): f"{base}/{s.getPath().getName()}" for s in store.listStatus(p) if s.isDirectory()}


def create(ledger: DataFrame, path: str, key: str = "logic_hash", order: str = "timestamp", buckets: int = BUCKETS) -> None:
    """A ledger of the rows, of those of one key the last by `order`."""
    found = _written(merged(ledger.limit(0), ledger, key, order), path, key, buckets)
    _commit(ledger.sparkSession, path, {"version": 1, "key": key, "order": order, "schema": ledger.schema.json(), "buckets": buckets, "folders": found})


def read(spark: SparkSession, path: str, version: int | None = None, keys: list | None = None) -> DataFrame:
    """The ledger's rows; of `keys` alone, then only their buckets are read."""
    from pyspark.sql import types as T

    m = manifest(spark, path, version)
    schema = T.StructType.fromJson(json.loads(m["schema"]))
    folders = m["folders"]
    if keys is not None:
        asked = spark.createDataFrame([(k,) for k in keys], T.StructType([schema[m["key"]]]))
        wanted = {str(r[0]) for r in asked.select(_bucket(m["key"], m["buckets"])).distinct().collect()}  # as many as keys at most
        folders = {b: f for b, f in folders.items() if b in wanted}
    rows = spark.read.schema(schema).parquet(*folders.values()) if folders else spark.createDataFrame([], schema)
    return rows if keys is None else rows.where(F.col(m["key"]).isin(keys))


def upsert(incoming: DataFrame, path: str) -> dict:
    """Incoming rows in place of those of their keys, as ledger.upsert has it. Gives the new manifest; Conflict if another writer was first."""
    from pyspark.sql import types as T

    spark = incoming.sparkSession
    m = manifest(spark, path)
    schema = T.StructType.fromJson(json.loads(m["schema"]))
    own = incoming.select(*schema.names)
    touched = {str(r[0]) for r in own.select(_bucket(m["key"], m["buckets"])).distinct().collect()}  # the number of buckets at most
    old = [f for b, f in m["folders"].items() if b in touched]
    before = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
    found = m | {"version": m["version"] + 1, "folders": m["folders"] | _written(merged(before, own, m["key"], m["order"]), path, m["key"], m["buckets"])}
    _commit(spark, path, found)
    return found


def vacuum(spark: SparkSession, path: str, kept: int = 2) -> int:
    """Removes versions but the last `kept`, and the folders that none of these names. Gives the number of folders removed; no writer may be at work."""
    known = _versions(spark, path)
    held = {f for v in known[-kept:] for f in manifest(spark, path, v)["folders"].values()}
    store, data = _files(spark, f"{path}/data")
    gone = 0
    for run in store.listStatus(data):
        for s in store.listStatus(run.getPath()):
            if s.isDirectory() and f"{path}/data/{run.getPath().getName()}/{s.getPath().getName()}" not in held:
                gone += bool(store.delete(s.getPath(), True))
    for v in known[:-kept]:
        store.delete(_files(spark, f"{path}/manifest/{v}")[1], False)
    return gone
