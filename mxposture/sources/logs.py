"""Analyzer logs: JSON-lines tables, frame tables and capture fact sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# One schema per log; identifiers come flat or nested.
LOG_SCHEMAS = {
    "conn": "uid string, `id.orig_h` string, `id.orig_p` bigint, `id.resp_h` string, `id.resp_p` bigint, "
    "id struct<orig_h:string,orig_p:bigint,resp_h:string,resp_p:bigint>, proto string, history string, "
    "conn_state string, missed_bytes bigint, orig_bytes bigint, resp_bytes bigint, ts double",
    "weird": "uid string, name string, ts double",
    "capture_loss": "gaps bigint, ts double",
    "tcp_recon": "ts double, uid string, is_orig boolean, event_type string, seq bigint, len bigint, "
    "range_start bigint, range_end bigint",
    "email_events": "ts double, uid string, protocol string, is_orig boolean, event_type string, "
    "command string, argument string, reply_code int, text string",
    "ssl": "ts double, uid string, ssl_history string, established boolean, resumed boolean, last_alert string, "
    "version string, server_version int, server_supported_version int, client_supported_versions array<bigint>, "
    "cipher string, curve string, server_key_share_group int, client_key_share_groups array<bigint>, "
    "dh_param_size int, psk_key_exchange_modes array<bigint>, next_protocol string, server_name string, "
    "cert_chain_fps array<string>, client_cert_chain_fps array<string>",
    "cert_files": "uid string, conn_uids array<string>, fuid string, sha256 string, sha1 string, source string, "
    "truncated boolean, mime_type string",
}
# Allow-listed frame columns (fixed values).
FRAME_FIELDS = [
    "frame.number",
    "frame.time_epoch",
    "ip.src",
    "ipv6.src",
    "ip.dst",
    "ipv6.dst",
    "tcp.srcport",
    "tcp.dstport",
    "smtp.req.command",
    "smtp.response.code",
    "imap.request.command",
    "imap.response.status",
    "imap.tag",
    "pop.request.command",
    "pop.response.indicator",
    "tls.handshake.type",
    "tls.handshake.extensions_key_share_selected_group",
    "tls.handshake.sig_hash_alg",
]


# A line without this field is not a record of its log.
_REQUIRED = {"capture_loss": "gaps", "cert_files": "fuid"}


def read_log(spark: SparkSession, path: str | list[str], name: str) -> DataFrame:
    """One analyzer log as a table; blank lines, broken lines and non-objects are left out.

    A field of the wrong type is null, the rest of its line is kept. The rows keep their source
    file, so logs of many captures are read in one job, and ``source_ord``, their place in it.
    """
    required = _REQUIRED.get(name, "uid")
    rows = spark.read.schema(LOG_SCHEMAS[name]).json(path)
    return numbered_in_file(rows, required).where(F.col(required).isNotNull())


def numbered_in_file(rows: DataFrame, required: str) -> DataFrame:
    """``source_file`` and ``source_ord``: 0, 1, 2, ... in the order of the file's lines.

    The number depends on the file alone, not on how it is split or which files share a task. A split
    numbers its lines by the order it reads them; one small row per split says how many lines lie in the
    splits before it. ``required`` is a column of the file that both readings parse, so that both see the
    same lines.
    """
    block = ["source_file", "_block"]
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_read"),
    )
    blocks = placed.groupBy(*block).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_read").alias("_first"), F.max(F.col(required).isNotNull()).alias("_any")
    )
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_any")
    number = (F.col("_before") + F.col("_read") - F.col("_first")).cast("bigint")
    return placed.join(starts, block).withColumn("source_ord", number).drop("_block", "_read", "_first", "_before", "_any")


def read_log_dir(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """All known logs below a directory of capture folders: ``<capture>/<log>.log``."""
    return {name: read_log(spark, f"{directory}/*/{name}.log", name) for name in LOG_SCHEMAS}


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame table with a header; every field is text, empty is null."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")
    missing = [c for c in FRAME_FIELDS if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in missing})
    return rows.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in FRAME_FIELDS])


def interesting_frames(frames: DataFrame) -> DataFrame:
    """Frames that carry a mail command, a reply or a TLS handshake message."""
    fields = [
        "smtp.req.command",
        "smtp.response.code",
        "imap.request.command",
        "imap.response.status",
        "pop.request.command",
        "pop.response.indicator",
        "tls.handshake.type",
    ]
    keep = F.lit(False)
    for name in fields:
        if name in frames.columns:
            keep = keep | F.col(f"`{name}`").isNotNull()
    return frames.where(keep)


def frame_endpoints(frames: DataFrame) -> DataFrame:
    """Frames with one source and one destination; frames with both address families match nothing."""
    v4 = F.col("`ip.src`").isNotNull() | F.col("`ip.dst`").isNotNull()
    v6 = F.col("`ipv6.src`").isNotNull() | F.col("`ipv6.dst`").isNotNull()
    return frames.where(v4 != v6).select(
        "*",
        F.coalesce("`ip.src`", "`ipv6.src`").alias("src"),
        F.coalesce("`ip.dst`", "`ipv6.dst`").alias("dst"),
        F.col("`tcp.srcport`").try_cast("bigint").alias("src_port"),
        F.col("`tcp.dstport`").try_cast("bigint").alias("dst_port"),
    )


def _number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), "([0-9]+)", 1), F.lit("")).cast(
        "bigint"
    )


def _decimal(text: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(text, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.nullif(found, F.lit("")).cast("double")


def capture_facts(sheets: DataFrame) -> DataFrame:
    """``label: value`` sheets (columns path, text) to one typed row per capture."""

    def field(*labels: str) -> Column:
        parts = []
        for label in labels:
            pattern = rf"(?im)^[ \t]*{label}[ \t]*:[ \t]*(.*)$"
            parts.append(F.nullif(F.trim(F.regexp_extract("text", pattern, 1)), F.lit("")))
        return F.coalesce(*parts)

    out = sheets.withColumns(
        {
            "_precision": F.lower(field("file timestamp precision", "file time precision")),
            "_limit": F.lower(field("packet size limit")),
            "_start": field("first packet time", "earliest packet time"),
            "packet_count": _number(field("number of packets")),
            "original_packet_bytes": _number(field("data size")),
            "capture_duration_seconds": _decimal(field("capture duration")),
        }
    )
    limit = F.col("_limit")
    low = F.nullif(F.regexp_extract(limit, r"inferred:\s*(\d+)", 1), F.lit("")).cast("bigint")
    high = F.nullif(
        F.regexp_extract(limit, r"inferred:\s*\d+\s*(?:bytes)?\s*-\s*(\d+)", 1), F.lit("")
    ).cast("bigint")
    header = F.nullif(F.regexp_extract(limit, r"file hdr:\s*(\d+)", 1), F.lit("")).cast("bigint")
    unset = limit.contains("not set") | limit.contains("n/a")
    fixed = F.when(unset, None).otherwise(
        F.coalesce(header, F.when(~limit.contains("inferred"), _number(limit)))
    )
    start = F.col("_start")
    epoch = F.element_at(F.split(start, r"\s+"), 1).try_cast("double")
    stamp = F.regexp_extract(start, r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)", 1)
    by_epoch = F.when(epoch > 1_000_000_000, F.timestamp_micros((epoch * 1_000_000).cast("bigint")))
    precision = F.col("_precision")
    unit = F.coalesce(
        *[
            F.when(precision.contains(u), u)
            for u in ("nanosecond", "microsecond", "millisecond", "second")
        ],
        F.element_at(F.split(precision, r"\s+"), 1),
        F.lit("unknown"),
    )
    return out.select(
        "path",
        "packet_count",
        unit.alias("file_time_precision"),
        fixed.alias("packet_size_limit"),
        low.alias("packet_size_limit_min_inferred"),
        F.coalesce(high, low).alias("packet_size_limit_max_inferred"),
        low.isNotNull().alias("truncated_packets_present"),
        "original_packet_bytes",
        "capture_duration_seconds",
        F.coalesce(by_epoch, F.try_to_timestamp(F.regexp_replace(stamp, "T", " "))).alias(
            "capture_start_time"
        ),
    )


def read_capture_facts(spark: SparkSession, path: str) -> DataFrame:
    sheets = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
    return capture_facts(sheets)
