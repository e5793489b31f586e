"""Binary files: capture intake checks, extracted certificates, content-addressed storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.constants import CAPTURE_MAGIC

MAX_CAPTURE_BYTES = 64 * 1024 * 1024


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def check_captures(files: DataFrame, max_bytes: int = MAX_CAPTURE_BYTES) -> DataFrame:
    """Digest and intake state of capture files (columns path, length, content)."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    magic = F.hex(F.substring("content", 1, 4))
    known = F.lit(False)
    for name, values in CAPTURE_MAGIC.items():
        known = known | ((extension == name) & magic.isin(values))
    state = (
        F.when(F.col("length") == 0, "empty")
        .when(F.col("length") > max_bytes, "too_large")
        .when(~extension.isin(list(CAPTURE_MAGIC)), "bad_extension")
        .when(~known, "bad_magic")
        .otherwise("ready")
    )
    return files.select(
        *[c for c in files.columns if c != "content"],
        F.sha2("content", 256).alias("sha256"),
        state.alias("state"),
    )


def extracted_certificates(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Digests and file id (the file stem) of non-empty extracted certificates."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    small = files.where(F.col("length") > 0)
    if max_bytes is not None:
        small = small.where(F.col("length") <= max_bytes)
    return small.select(
        F.sha2("content", 256).alias("sha256"),
        F.sha1("content").alias("sha1"),
        stem.alias("fuid"),
        "content",
    )


def new_content(incoming: DataFrame, stored: DataFrame | None, key: str = "sha256") -> DataFrame:
    """Rows whose digest is not stored yet, each digest once; putting them again adds nothing."""
    fresh = incoming.dropDuplicates([key])
    return fresh if stored is None else fresh.join(stored.select(key), key, "left_anti")


def put_content(incoming: DataFrame, path: str) -> int:
    """Append the new rows to the content table at ``path``; returns how many were new."""
    spark = incoming.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as exc:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        stored = None
    fresh = new_content(incoming, stored)
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(path)
    return count


def damaged_content(stored: DataFrame, key: str = "sha256", content: str = "content") -> DataFrame:
    """Stored rows whose bytes no longer match their digest."""
    return stored.where(F.sha2(content, 256) != F.col(key))


def usage(files: DataFrame, quota_bytes: int) -> DataFrame:
    """Total size and whether it exceeds the quota; file contents are never read."""
    return files.agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files")
    ).withColumn("over_quota", F.col("bytes") > quota_bytes)
