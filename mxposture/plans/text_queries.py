"""Text, label and digest queries over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.constants import BIDI_CODE_POINTS, CAPTURE_MAGIC, CONTROL_NAMES, SECRET_COMMANDS
from mxposture.functions import text as ops
from mxposture.operators.sessions import clean_events
from mxposture.plans.adapters import table, view
from mxposture.plans.registry import query

_EDGE = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


@query(
    "f05_bounded_text",
    f"""SELECT doc_id, stripped AS bounded FROM (SELECT doc_id, regexp_replace(text, '{_EDGE}', '', 'g') AS stripped FROM documents)
        WHERE length(stripped) > 0""",
)
def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", ops.bound_text(F.col("text")).alias("bounded"))
    return out.where(F.col("bounded").isNotNull())


_SECRETS = ", ".join(f"'{c}'" for c in SECRET_COMMANDS)


@query(
    "f06_redaction",
    f"""SELECT doc_id, CASE WHEN command IN ({_SECRETS}) THEN '<redacted>' ELSE stripped END AS shown FROM (
        SELECT doc_id, regexp_replace(text, '{_EDGE}', '', 'g') AS stripped,
          CASE doc_id % 5 WHEN 0 THEN 'AUTH' WHEN 1 THEN 'NOOP' WHEN 2 THEN 'MAIL' WHEN 3 THEN '**' ELSE 'EHLO' END AS command FROM documents)
        WHERE length(stripped) > 0""",
)
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 5
    command = F.when(n == 0, "auth").when(n == 1, "noop").when(n == 2, "Mail").when(n == 3, "**").otherwise("ehlo")
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", ops.redact(command, F.col("text")).alias("shown"))
    return out.where(F.col("shown").isNotNull())


@query(
    "f06_clean_events",
    """SELECT uid, ord, coalesce(upper(command), '') AS command, CASE WHEN upper(command) IN ('AUTH', 'LOGIN', 'PASS') AND text IS NOT NULL THEN '<redacted>'
       ELSE coalesce(text, '') END AS text FROM x_dialogue""",
)
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "x_dialogue").withColumn("argument", F.lit(None).cast("string"))
    return clean_events(rows).select(
        "uid", "ord", F.coalesce("command", F.lit("")).alias("command"), F.coalesce("text", F.lit("")).alias("text")
    )


def _nested_replace(expr: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {old}, '{new}')"
    return expr


_CONTROL = [*range(0x01, 0x20), *range(0x7F, 0xA0), *BIDI_CODE_POINTS]
_REPORT = [(f"chr({cp})", f"\\u{cp:04X}") for cp in _CONTROL]
_SCREEN = [(f"chr({cp})", f"⟦U+{cp:04X} {CONTROL_NAMES.get(cp, 'CONTROL')}⟧") for cp in _CONTROL]


@query(
    "f40_forensic_report_text",
    f"SELECT doc_id, {_nested_replace('text', _REPORT)} AS shown FROM documents",
)
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ops.report_text(F.col("text")).alias("shown"))


@query(
    "f40_forensic_screen_text",
    f"SELECT conv_id, turn, {_nested_replace('text', _SCREEN)} AS shown FROM conversations",
)
def screen_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", ops.screen_text(F.col("text")).alias("shown"))


@query(
    "f43_byte_labels",
    """SELECT o_orderkey AS id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b * 10.0 / 1024 + 0.5) / 10)
       ELSE printf('%.1f MB', floor(b * 10.0 / 1048576 + 0.5) / 10) END AS label FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT)
       * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 0 END AS b FROM orders)""",
)
def byte_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 3
    size = F.floor("o_totalprice") * F.when(n == 0, 1).when(n == 1, 100).otherwise(0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), ops.byte_label(size).alias("label")
    )


@query(
    "f44_case_ids",
    r"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'case-' || page_id ELSE concat(CASE WHEN regexp_matches(c, '^[A-Za-z0-9]') THEN c ELSE 'cap' END,
         '-', substr(sha256(url), 1, 8)) END AS case_id FROM (SELECT page_id, url, regexp_replace(regexp_replace(
         regexp_replace(url, '\.[^.]*$', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS c FROM pages)""",
)
def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    asked = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit(" case-"), F.col("page_id").cast("string")))
    return pages.select(
        "page_id", ops.case_id(asked, F.col("url"), F.sha2("url", 256)).alias("case_id")
    )


@query(
    "f49_timestamps",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS written,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS reread FROM events""",
)
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = events.withColumn("written", ops.utc_text(F.col("ts")))
    raw = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("written", "Z", "")).otherwise(F.col("written"))
    again = ops.utc_text(ops.utc_timestamp(raw))
    return out.select("event_id", "written", F.coalesce(again, F.lit("")).alias("reread"))


@query(
    "f50_row_digests",
    "SELECT doc_id, sha256(concat_ws('|', doc_id, lang, source, n_chars)) AS digest FROM documents",
)
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cols = [F.col(c) for c in ("doc_id", "lang", "source", "n_chars")]
    return docs.select("doc_id", ops.joined_digest(*cols).alias("digest"))


_MAGIC = ", ".join(f"'{m}'" for magics in CAPTURE_MAGIC.values() for m in magics)


@query(
    "s15_intake_checks",
    f"""SELECT page_id, sha256(html) AS digest, octet_length(encode(html)) AS size, CASE WHEN page_id % 4 = 0 THEN 'ready' ELSE 'bad_magic' END AS state FROM pages""",
)
def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.files import check_captures

    pages = table(spark, sf_dir, "pages")
    body = F.encode("html", "UTF-8")
    magic = F.when(F.col("page_id") % 4 == 0, F.unhex(F.lit("0A0D0D0A"))).otherwise(F.unhex(F.lit("00000000")))
    files = pages.select(
        "page_id",
        F.concat(F.lit("capture-"), F.col("page_id").cast("string"), F.lit(".pcapng")).alias("path"),
        F.concat(magic, body).alias("content"),
        body.alias("_body"),
    )
    out = check_captures(files.withColumn("length", F.length("content")))
    return out.select(
        "page_id", F.sha2("_body", 256).alias("digest"), F.octet_length("_body").cast("bigint").alias("size"), "state"
    )


# --- stores -------------------------------------------------------------------------------------


@query(
    "s05_new_content",
    """SELECT min(doc_id) >= 0 AS stored, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN
       (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY sha256(text)""",
)
def new_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.files import new_content as fresh

    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    stored = docs.where("doc_id % 3 = 0").select("sha256").distinct()
    return fresh(docs, stored).select(F.lit(True).alias("stored"), "sha256")


@query(
    "a30_storage_usage",
    """SELECT CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, count(*) AS files, sum(octet_length(encode(html))) > 1000000 AS over_quota FROM pages""",
)
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.files import usage as total

    pages = table(spark, sf_dir, "pages")
    files = pages.select(F.octet_length(F.encode("html", "UTF-8")).cast("bigint").alias("length"))
    return total(files, 1_000_000)


@query(
    "s13_catalog_upsert",
    """SELECT c_custkey AS case_id, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM customer WHERE c_custkey % 2 = 0
       UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0""",
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.stores import upsert

    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(key.alias("case_id"))
    stored = customers.where("case_id % 2 = 0").withColumn("state", F.lit("old"))
    rows = customers.where("case_id % 4 = 0 OR (case_id % 2 = 1 AND case_id % 3 = 0)")
    return upsert(stored, rows.withColumn("state", F.lit("new")), ["case_id"])


@query(
    "s14_history_retention",
    "SELECT endpoint_id, day_index FROM x_daily",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.stores import retain_last

    rows = view(spark, sf_dir, "x_daily").select("endpoint_id", "day_index")
    return retain_last(rows.where("day_index < 20"), rows.where("day_index >= 20"))


@query(
    "s14_last_windows",
    """SELECT endpoint_id, day_index, session_count FROM (SELECT *, row_number() OVER (PARTITION BY endpoint_id ORDER BY day_index DESC) AS n FROM x_daily) WHERE n <= 5""",
)
def last_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five windows of each endpoint after the later days are appended."""
    from mxposture.sources.stores import retain_last

    rows = view(spark, sf_dir, "x_daily").select("endpoint_id", "day_index", "session_count")
    return retain_last(rows.where("day_index < 20"), rows.where("day_index >= 20"), limit=5, by=["endpoint_id"])


@query(
    "s14_last_of_a_hot_site",
    """SELECT site_id, endpoint_id, day_index FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY day_index DESC, endpoint_id DESC) AS n FROM x_daily) WHERE n <= 50""",
)
def last_of_a_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sites share all windows: each holds a third of the rows."""
    from mxposture.sources.stores import retain_last

    rows = view(spark, sf_dir, "x_daily").select("site_id", "endpoint_id", "day_index")
    return retain_last(rows, limit=50, by=["site_id"])


_JOBS = """
SELECT o_orderkey, o_custkey % 50 AS digest, CASE o_orderkey % 2 WHEN 0 THEN 'p' ELSE 'q' END AS profile,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'host' END AS hostname, o_orderdate AS created_at, 'r' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS run_id,
  CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'O' THEN 'queued' ELSE 'succeeded' END AS status FROM orders
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("digest"),
        F.when(key % 2 == 0, "p").otherwise("q").alias("profile"),
        F.when(F.col("o_custkey") % 3 != 0, "host").alias("hostname"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("r"), F.lpad(key.cast("string"), 9, "0")).alias("run_id"),
        F.when(F.col("o_orderstatus") == "P", "failed")
        .when(F.col("o_orderstatus") == "O", "queued")
        .otherwise("succeeded")
        .alias("status"),
    )


@query(
    "s16_reusable_jobs",
    f"""SELECT digest, profile, coalesce(hostname, '') AS hostname, max(struct_pack(c := created_at, r := run_id)).r AS run_id
        FROM ({_JOBS}) WHERE status <> 'failed' GROUP BY 1, 2, 3""",
)
def reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.stores import reusable_jobs

    out = reusable_jobs(jobs(spark, sf_dir))
    return out.select("digest", "profile", F.coalesce("hostname", F.lit("")).alias("hostname"), "run_id")


@query(
    "s17_job_queue",
    f"SELECT run_id FROM ({_JOBS}) WHERE status = 'queued'",
)
def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.stores import job_queue

    return job_queue(jobs(spark, sf_dir)).select("run_id")


@query(
    "q04_run_status",
    f"""SELECT run_id, status, status = 'succeeded' AS report_ready, status = 'succeeded' AS evidence_ready FROM ({_JOBS}) WHERE run_id = 'r000000042'""",
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.stores import job_status

    return job_status(jobs(spark, sf_dir), "r000000042")


@query(
    "s10_evidence_documents",
    """SELECT capture_id, count(*) AS records, CAST(sum(CAST(uid AS BIGINT)) AS BIGINT) AS uid_sum FROM (
       SELECT 'cap-' || (CAST(uid AS BIGINT) % 997) AS capture_id, uid FROM x_conn UNION ALL
       SELECT 'cap-' || (CAST(uid AS BIGINT) % 997), uid FROM x_ssl) GROUP BY 1""",
)
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.stores import evidence_rows, nested_documents

    capture = F.concat(F.lit("cap-"), (F.col("uid").cast("bigint") % 997).cast("string"))
    sections = {
        "flows": view(spark, sf_dir, "x_conn").withColumn("capture_id", capture),
        "handshakes": view(spark, sf_dir, "x_ssl").withColumn("capture_id", capture),
    }
    docs = nested_documents(evidence_rows(sections), part_records=50)
    uids = F.transform("records", lambda r: F.get_json_object(r, "$.uid").cast("bigint"))
    in_part = F.aggregate(uids, F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = docs.select("capture_id", F.size("records").cast("bigint").alias("n"), in_part.alias("uids"))
    return parts.groupBy("capture_id").agg(F.sum("n").alias("records"), F.sum("uids").alias("uid_sum"))


@query(
    "p14_frame_filter",
    "SELECT count(*) AS kept FROM x_session_events WHERE kind = 'request' OR (kind = 'reply' AND (reply_code IS NOT NULL OR text IS NOT NULL))",
)
def frame_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.logs import interesting_frames

    rows = view(spark, sf_dir, "x_session_events")
    request = F.when(F.col("kind") == "request", F.coalesce("command", F.lit("NOOP")))
    reply = F.when(F.col("kind") == "reply", F.coalesce(F.col("reply_code").cast("string"), F.col("text")))
    frames = rows.select(request.alias("smtp.req.command"), reply.alias("smtp.response.code"))
    return interesting_frames(frames).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "s03_capture_facts",
    """SELECT o_orderkey AS id, o_custkey AS packets, CASE o_orderkey % 3 WHEN 0 THEN 'nanosecond' WHEN 1 THEN 'microsecond' ELSE 'unknown' END AS precision,
       CASE o_orderkey % 4 WHEN 0 THEN 96 WHEN 1 THEN 65535 ELSE -1 END AS size_limit, o_orderkey % 4 = 0 OR o_orderkey % 4 = 2 AS truncated,
       strftime(to_timestamp(1700000000 + o_orderkey) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS started FROM orders""",
)
def capture_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.sources.logs import capture_facts as parse

    key = F.col("o_orderkey")
    precision = F.when(key % 3 == 0, "File timestamp precision:  nanoseconds (9)").when(
        key % 3 == 1, "File time precision: microseconds (6)"
    )
    limit = (
        F.when(key % 4 == 0, "Packet size limit:   file hdr: 96 bytes inferred: 54 bytes - 96 bytes (range)")
        .when(key % 4 == 1, "Packet size limit: file hdr: 65535 bytes")
        .when(key % 4 == 2, "Packet size limit: file hdr: (not set) inferred: 60 bytes")
        .otherwise("Packet size limit: file hdr: (not set)")
    )
    epoch = (F.lit(1700000000) + key).cast("string")
    sheet = F.concat_ws(
        "\n",
        F.concat(F.lit("Number of packets:   "), F.col("o_custkey").cast("string")),
        precision,
        limit,
        F.concat(F.lit("First packet time:   "), epoch, F.lit(".000000")),
    )
    sheets = table(spark, sf_dir, "orders").select(key.cast("string").alias("path"), sheet.alias("text"))
    return parse(sheets).select(
        F.col("path").cast("bigint").alias("id"),
        F.col("packet_count").alias("packets"),
        F.col("file_time_precision").alias("precision"),
        F.coalesce("packet_size_limit", F.lit(-1)).alias("size_limit"),
        F.col("truncated_packets_present").alias("truncated"),
        ops.utc_text(F.col("capture_start_time")).alias("started"),
    )
