"""What a session needs before plans with Python workers run on it."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once an application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="braidwork-")) / "braidwork.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


#: Temporary folders, by application, of local sessions that name no shared one (tests).
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a session that names none must be local and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="braidwork-")
    return _own[key]


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """df written to the shared folder and read again: what loops of joins need, and safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expire_steps(spark: SparkSession, hours: float, folder: str | None = None) -> int:
    """Removes stored steps of a folder, the shared one if none is named, that no one has written to for so many hours, and gives their number.

    A lazy result may read steps until it has been written itself, so hours must be more than any job takes. Folders that aren't steps of this package stay.
    """
    jvm, root = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder or shared_dir(spark))
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    before, gone = jvm.System.currentTimeMillis() - int(hours * 3_600_000), 0
    for s in store.listStatus(root) if store.exists(root) else ():
        name = s.getPath().getName()
        if s.isDirectory() and re.fullmatch(r"[A-Za-z0-9_.-]+-[0-9a-f]{32}", name) and s.getModificationTime() < before:
            gone += bool(store.delete(s.getPath(), True))
    return gone
