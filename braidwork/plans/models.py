"""The fixture tables read as build metadata, for the registered queries: each model as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.ledger import CONTENT, LOGICAL, MISS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as runs: a user is a task, purchases logical hits, clicks content hits, the rest misses."""
    kind = F.when(F.col("event_type") == "purchase", LOGICAL).when(F.col("event_type") == "click", CONTENT).otherwise(MISS)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("value").alias("duration_ms"), kind.alias("hit_type"), "props", "ts")


RUNS = f"""runs AS (SELECT user_id AS task_id, event_id AS seq, value AS duration_ms, CASE event_type WHEN 'purchase' THEN '{LOGICAL}' WHEN 'click' THEN '{CONTENT}' ELSE '{MISS}' END AS hit_type,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, ts FROM events)"""

URL = r"^[a-z]+://[^/?#]+/?([^?#]*)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as tasks that claim their url's path: even ones write, every third a directory, every 25th its language's directory."""
    path = F.regexp_replace(F.regexp_extract("url", URL, 1), "/+$", "")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where("path != ''")
    own = p.select(F.col("page_id").alias("task_id"), "path", (F.col("page_id") % 3 == 0).alias("is_dir"), F.when(F.col("page_id") % 2 == 0, "write").otherwise("read").alias("mode"))
    top = p.where(F.col("page_id") % 25 == 0).select(F.col("page_id").alias("task_id"), F.split("path", "/")[0].alias("path"), F.lit(True).alias("is_dir"), F.lit("write").alias("mode"))
    return own.unionByName(top).distinct()


CLAIMS = rf"""p AS (SELECT page_id, regexp_replace(regexp_extract(url, '{URL}', 1), '/+$', '') AS path FROM pages),
claims AS (SELECT DISTINCT * FROM (SELECT page_id AS task_id, path, page_id % 3 = 0 AS is_dir, CASE WHEN page_id % 2 = 0 THEN 'write' ELSE 'read' END AS mode FROM p WHERE path <> ''
  UNION ALL SELECT page_id, split_part(path, '/', 1), true, 'write' FROM p WHERE path <> '' AND page_id % 25 = 0)),
pairs AS (SELECT a.task_id AS ta, b.task_id AS tb, a.path AS pa, b.path AS pb, a.mode AS ma, b.mode AS mb FROM claims a JOIN claims b ON a.task_id <> b.task_id
  AND (a.path = b.path AND a.task_id < b.task_id OR b.is_dir AND starts_with(a.path, b.path || '/')))"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chains: each turn waits for the one before."""
    c = table(spark, sf_dir, "conversations").where("turn > 0").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("dst"))
    return c


def chain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))


CHAIN = """edges AS (SELECT conv_id * 1000 + turn - 1 AS src, conv_id * 1000 + turn AS dst FROM conversations WHERE turn > 0), nodes AS (SELECT conv_id * 1000 + turn AS id FROM conversations)"""


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as edges (seq, src, dst) between seven stations of their customer, by which some form cycles; an eighth isn't there."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("bigint") * 8
    return table(spark, sf_dir, "orders").select(k.cast("bigint").alias("seq"), (c + k % 7).alias("src"), (c + F.floor(k / 7) % 8).alias("dst"))


def ring_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("c_custkey").cast("bigint") * 8
    return table(spark, sf_dir, "customer").select(F.explode(F.sequence(first, first + 6)).alias("id"))


RING = """ring AS (SELECT CAST(o_orderkey AS BIGINT) AS seq, CAST(o_custkey AS BIGINT) AS c, CAST(o_orderkey % 7 AS BIGINT) AS s, CAST((o_orderkey // 7) % 8 AS BIGINT) AS t FROM orders),
edges AS (SELECT DISTINCT c * 8 + s AS src, c * 8 + t AS dst FROM ring), nodes AS (SELECT CAST(c_custkey AS BIGINT) * 8 + unnest(range(7)) AS id FROM customer)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents before and after an edit: by doc_id mod 5, 0 gets more white space, 1 another text, 2 goes, and those from 5 mod 10 are new."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shape = lambda t: [F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(t, 256).alias("content_hash"), F.sha2(F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " ")), 256).alias("logic_hash")]
    k = F.col("doc_id") % 5
    after = d.where(k != 2).select(*shape(F.when(k == 0, F.concat("text", F.lit("  "))).when(k == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
    return d.where(F.col("doc_id") % 10 != 4).select(*shape(F.col("text"))), after


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part names as source files."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".ts")).alias("id"))
