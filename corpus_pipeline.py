"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet to the shared folder
and reads again as the next stage's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import decontamination, line_dedup, packing, quality_fm, simhash
from braidwork.llm.common import materialise, set_aside, table
from braidwork.plans.session import ship_package

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this corpus' labels, rejects go.

    Null and empty texts are scored by their structure; repeated rows stay or go together; extra columns stay as they are.
    """
    ship_package(spark)
    return quality_fm.keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents hold stay in one; every document stays, and n_chars follows its text.

    A null text stays null; repeated rows are documents of their own; extra columns, also ones named as the operator's counts, stay.
    """
    ship_package(spark)
    aside, back = set_aside(docs, "n_lines", "n_dropped")
    cut = line_dedup.dedup_lines(aside)
    counted = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return counted.drop("n_lines", "n_dropped").withColumnsRenamed(back).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, the one of the least doc_id.

    Texts without words are one group; of repeated rows of a doc_id one stays, always the same; rows without a doc_id stay.
    """
    ship_package(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go.

    Null and empty texts are clean; repeated rows are judged alike; extra columns stay as they are.
    """
    ship_package(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, by piece: its length, ids' checksum, sequence and place.

    Null and empty texts are one end token; repeated rows are packed each for itself; other columns are left out.
    """
    import public_tokenizers

    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: Fitted models, fingerprints and tokens aren't expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
