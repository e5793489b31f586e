"""Stored tables and documents: evidence sink, score requests, catalog, history, jobs, cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECTIONS = ["flows", "sessions", "handshakes", "certificates", "findings", "policy_checks"]
# A document is one row; this many records, about, are in one.
PART_RECORDS = 10_000


# --- evidence sink ---------------------------------------------------------------------------


def evidence_rows(sections: dict[str, DataFrame], key: str = "capture_id") -> DataFrame:
    """All evidence as (capture, section, record JSON, order) rows: the form for any size."""
    out = None
    for name, frame in sections.items():
        cols = sorted(c for c in frame.columns if c != key)
        part = frame.select(
            F.col(key), F.lit(name).alias("section"), F.to_json(F.struct(*cols)).alias("record")
        )
        out = part if out is None else out.unionByName(part)
    return out


def nested_documents(
    rows: DataFrame, key: str = "capture_id", part_records: int = PART_RECORDS
) -> DataFrame:
    """Sorted documents (capture, section, part) of every capture, large or small.

    A section is dealt into as many parts as it takes for about ``part_records`` records each, by a
    hash of the record, so no list grows with its capture.
    """
    sizes = rows.groupBy(key, "section").agg(F.ceil(F.count(F.lit(1)) / part_records).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("record"), F.col("parts")).cast("int")
    dealt = rows.join(sizes, [key, "section"]).withColumn("part", part)
    return dealt.groupBy(key, "section", "part", "parts").agg(
        F.sort_array(F.collect_list("record")).alias("records")
    )


def write_evidence(
    rows: DataFrame, path: str, key: str = "capture_id", part_records: int = PART_RECORDS
) -> None:
    """The documents of every capture as JSON."""
    nested_documents(rows, key, part_records).write.mode("overwrite").json(f"{path}/documents")


# --- score requests ------------------------------------------------------------------------------

FINDING_SCHEMA = (
    "finding_id string, code string, outcome string, title string, rationale string, standards array<string>, "
    "remediation_id string, severity string, evaluation_state string, basis_state string, policy_profile string, "
    "policy_pack_version string, rule_effective_from string, rule_effective_until string, "
    "policy_evaluation_time string, affected_endpoint string, evidence_references array<struct<record_type:string,"
    "record_key:string,field_path:string,evidence_state:string,frame_number:int>>"
)
CHECK_SCHEMA = (
    "check_id string, code string, category string, protocol string, affected_endpoint string, record_type string, "
    "record_key string, outcome string, evidence_state string, title string"
)
ASSET_SCHEMA = "endpoint string, exposure string, asset_criticality string, blast_radius string"


def _inner(ddl: str) -> str:
    """DDL columns as the inside of a struct type."""
    parts = (column.partition(" ") for column in ddl.split(", "))
    return ",".join(f"{name}:{dtype}" for name, _, dtype in parts)


def read_score_requests(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Findings, checks and assets of request documents, each row with its ``request`` file."""
    schema = (
        f"findings array<struct<{_inner(FINDING_SCHEMA)}>>, policy_checks array<struct<{_inner(CHECK_SCHEMA)}>>, "
        f"asset_context array<struct<{_inner(ASSET_SCHEMA)}>>"
    )
    docs = spark.read.schema(schema).json(path, multiLine=True)
    docs = docs.withColumn("request", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1))

    def rows(column: str) -> DataFrame:
        return docs.select("request", F.explode(column).alias("_r")).select("request", "_r.*")

    return {
        "findings": rows("findings"),
        "checks": rows("policy_checks"),
        "assets": rows("asset_context"),
    }


# --- catalog and history ---------------------------------------------------------------------------


def upsert(stored: DataFrame | None, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows replaced by new rows of the same key, new keys added."""
    if stored is None:
        return rows
    kept = stored.join(rows.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def replace_table(rows: DataFrame, path: str, version: int) -> str:
    """Write the next version of a table beside the old one; readers switch by name."""
    target = f"{path}/v{version:08d}"
    rows.write.mode("errorifexists").parquet(target)
    return target


def check_capacity(rows: DataFrame, limit: int) -> None:
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"catalog exceeds {limit} entries")


def retain_last(
    history: DataFrame, rows: DataFrame | None = None, limit: int | None = None, by: list[str] | None = None
) -> DataFrame:
    """The windows after appending ``rows``; the last ``limit`` by day and endpoint if given.

    ``by`` keeps the last ``limit`` of each of its groups instead. Both ways every task first cuts what it
    holds to ``limit`` rows (a group), so a group of any size meets as a few rows per task.
    """
    both = history if rows is None else history.unionByName(rows, allowMissingColumns=True)
    order = [F.col("day_index").desc(), F.col("endpoint_id").desc()]
    if limit is None:
        return both
    if by is None:
        return both.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return both.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


# --- jobs ----------------------------------------------------------------------------------------------


def reusable_jobs(jobs: DataFrame) -> DataFrame:
    """Latest job of each (digest, profile, hostname) that has not failed or been cancelled.

    The hostname may be null; null equals null here because it is part of a grouping key.
    """
    live = jobs.where(~F.col("status").isin("failed", "cancelled"))
    latest = F.max(F.struct("created_at", "run_id"))
    return live.groupBy("digest", "profile", "hostname").agg(latest.alias("_j")).select(
        "digest", "profile", "hostname", "_j.created_at", "_j.run_id"
    )


def job_queue(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Queued jobs, oldest first."""
    queued = jobs.where(F.col("status") == "queued").orderBy("created_at", "run_id")
    return queued if limit is None else queued.limit(limit)


def job_status(jobs: DataFrame, run_id: str) -> DataFrame:
    """State of one run and which of its artifacts can be read."""
    done = F.col("status") == "succeeded"
    return jobs.where(F.col("run_id") == run_id).select(
        "run_id", "status", done.alias("report_ready"), done.alias("evidence_ready")
    )


# --- cohorts --------------------------------------------------------------------------------------------


def read_cohort(spark: SparkSession, directory: str, schema_version: str) -> dict[str, DataFrame]:
    """Windows and labels of an evaluation cohort; the manifest must name our feature schema."""
    manifest = spark.read.schema("cohort_id string, feature_schema_version string, n_days int").json(
        f"{directory}/manifest.json", multiLine=True
    )
    head = manifest.first()
    if head is None or head["feature_schema_version"] != schema_version:
        raise ValueError("cohort was written for another feature schema")
    labels = spark.read.schema(
        "events array<struct<event_id:string,family:string,kind:string,endpoint_id:string,start_day:int,end_day:int>>, "
        "maintenance array<struct<endpoint_id:string,start_day:int,end_day:int>>, "
        "jitter_endpoints array<string>, new_endpoints array<string>"
    ).json(f"{directory}/labels.json", multiLine=True)
    windows = spark.read.json(f"{directory}/windows", multiLine=False)
    return {
        "windows": windows,
        "events": labels.select(F.explode("events").alias("e")).select("e.*"),
        "maintenance": labels.select(F.explode("maintenance").alias("m")).select("m.*"),
        "jitter": labels.select(F.explode("jitter_endpoints").alias("endpoint_id")),
        "new_endpoints": labels.select(F.explode("new_endpoints").alias("endpoint_id")),
    }


def read_report_catalog(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Catalog entries with legal, unique ids and files; anything else is an error."""
    doc = spark.read.schema("reports array<struct<case_id:string,report:string>>").json(path, multiLine=True)
    rows = doc.select(F.explode("reports").alias("r")).select("r.*")
    legal = F.col("case_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,159}$")
    bad = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(legal, F.lit(False))).alias("illegal"),
        F.count_distinct("case_id").alias("cases"),
        F.count_distinct("report").alias("files"),
    ).first()
    if limit is not None and bad["n"] > limit:
        raise ValueError("catalog holds too many reports")
    if bad["illegal"] or bad["cases"] != bad["n"] or bad["files"] != bad["n"]:
        raise ValueError("catalog ids or files are not unique or not legal")
    return rows
