"""Helpers shared by the corpus operators: reading tables, shared storage, typed Arrow output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from braidwork.plans.session import cut_lineage, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: df written as Parquet to the shared folder and read back: lineage is cut without losing anything when executors go, and
#: the plan is computed once (DataFrame.checkpoint() runs its last stage twice).
materialise = cut_lineage


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its own columns of these names renamed, and how to name them back (`withColumnsRenamed`)."""
    taken, back = {c.lower() for c in (*df.columns, *names)}, {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"_own_{c}"
            while new.lower() in taken:
                new = f"_{new}"
            taken.add(new.lower())
            back[new] = c
    return df.withColumnsRenamed({c: new for new, c in back.items()}), back


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """schema (left as it is) with the fields of ddl added."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
