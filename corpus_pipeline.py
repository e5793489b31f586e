"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; ``run`` writes
every result as Parquet to the shared folder and reads it again for the next stage.

    quality rules               rows that the word rules or the perplexity bands reject go
    near duplicates             of each group of near copies (5-word shingles, 0.8) one row stays
    benchmark decontamination   rows that hold a benchmark passage go
    secret scans                secrets are masked in the text; n_chars follows
    best-fit packing            the rest as sequences of 2048 tokens

Nulls, empty texts, repeated rows and empty tables are handled as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.llm import decontam, neardup, packing, quality, secrets
from mxposture.llm.common import documents, released, shared_folder
from mxposture.llm.queries import BYTE_BPE

#: Trained models, a component search and an integer program: not to be said in SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    released(spark)  # of the stage before
    return neardup.one_of_each(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    released(spark)  # of the stage before
    return decontam.clean(docs, documents(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    released(spark)  # of the stage before
    clean = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return clean.withColumn("n_chars", length)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    released(spark)  # of the stage before
    return packing.pack(docs, BYTE_BPE, end_id=0, size=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
