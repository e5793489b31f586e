"""Streaming queries: batch twins with checking SQL, and streams run over the table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.operators.scale import CHUNK_ROWS, numbered
from mxposture.plans.adapters import VIEWS, table, view
from mxposture.plans.registry import query
from mxposture.session import settled
from mxposture.streaming import online, protocols, reconstruction, run, versions

RATES = {
    "handshake_failure_rate": "error",
    "alert_rate": "signup",
    "tls13_share": "view",
    "tls12_share": "click",
    "starttls_fallback_rate": "purchase",
}

_START = "2024-01-01 00:00:00"

VIEWS["x_packets"] = """
SELECT CAST(l_orderkey AS STRING) AS uid, l_suppkey % 2 = 0 AS is_orig,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ord,
       CASE WHEN l_partkey % 37 = 0 THEN 'S' ELSE 'A' END AS flags,
       CAST(1 + 10 * (l_linenumber % 5) AS BIGINT) AS seq, CAST(CASE l_partkey % 5 WHEN 0 THEN 20 WHEN 1 THEN 0 ELSE 10 END AS BIGINT) AS len,
       CASE l_partkey % 11 WHEN 0 THEN 'gap' WHEN 1 THEN 'rexmit' WHEN 2 THEN 'inconsistent' END AS mark
FROM lineitem
"""

# DuckDB walks the packets of a direction as a fold over a list.
_WALK = """
WITH p AS (SELECT uid, is_orig, list(struct_pack(o := ord, f := flags, q := seq, l := len) ORDER BY ord) AS ps FROM x_packets GROUP BY uid, is_orig),
 w AS (SELECT uid, is_orig, list_reduce(ps, lambda a, x: struct_pack(
   e := CASE WHEN x.f = 'S' THEN 1 WHEN x.l = 0 THEN a.e WHEN a.e IS NULL THEN x.q + x.l
             WHEN x.q = a.e THEN greatest(x.q + x.l, coalesce(a.h, 0)) ELSE a.e END,
   h := CASE WHEN x.f <> 'S' AND x.l > 0 AND a.e IS NOT NULL AND x.q > a.e THEN greatest(x.q + x.l, coalesce(a.h, 0)) ELSE a.h END,
   u := a.u OR (x.f <> 'S' AND x.l > 0 AND a.e IS NOT NULL AND x.q > a.e),
   n := CASE WHEN x.f = 'S' OR x.l = 0 OR a.e IS NULL OR x.q > a.e OR (x.q = a.e AND NOT a.u) THEN a.n ELSE list_append(a.n, struct_pack(o := x.o,
        k := CASE WHEN x.q = a.e THEN 'out_of_order' WHEN x.q + x.l <= a.e THEN 'duplicate' ELSE 'overlap' END,
        l := CASE WHEN x.q < a.e AND x.q + x.l > a.e THEN a.e - x.q ELSE x.l END)) END),
   struct_pack(e := NULL::BIGINT, h := NULL::BIGINT, u := false, n := []::STRUCT(o BIGINT, k VARCHAR, l BIGINT)[])).n AS n FROM p)
SELECT uid, is_orig, r.o AS ord, r.k AS event_type, r.l AS len FROM (SELECT uid, is_orig, unnest(n) AS r FROM w)
"""


@query("st02_tcp_reconstruction", _WALK)
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reconstruction.reconstruct(view(spark, sf_dir, "x_packets"))
    return out.select("uid", "is_orig", "ord", "event_type", "len")


VIEWS["x_packets_hot"] = """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE CAST(l_orderkey AS STRING) END AS uid, l_orderkey % 3 = 0 OR l_suppkey % 2 = 0 AS is_orig,
       CAST(row_number() OVER (PARTITION BY CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ord,
       CASE WHEN l_partkey % 97 = 0 THEN 'S' ELSE 'A' END AS flags,
       CAST(1 + 10 * (CAST(FLOOR(l_orderkey / 3) AS BIGINT) % 50) + 10 * (l_linenumber % 5) AS BIGINT) AS seq, CAST(CASE l_partkey % 5 WHEN 0 THEN 20 WHEN 1 THEN 0 ELSE 10 END AS BIGINT) AS len
FROM lineitem
"""


def hot_packets(spark: SparkSession, sf_dir: str, most: int = CHUNK_ROWS) -> DataFrame:
    """Rows of ``x_packets_hot``; its plain window would number a third of the table in one task.

    The walk reads the packets several times, so they are numbered once.
    """
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "of", F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_orderkey"))
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    hot = F.col("l_orderkey") % 3 == 0
    step = 10 * (F.floor(F.col("l_orderkey") / 3) % 50) + 10 * (F.col("l_linenumber") % 5)
    size = F.when(F.col("l_partkey") % 5 == 0, 20).when(F.col("l_partkey") % 5 == 1, 0).otherwise(10)
    rows = numbered(lines.select("of", *order), ["of"], order, "ord", most).select(
        F.when(hot, "hot").otherwise(F.col("l_orderkey").cast("string")).alias("uid"),
        (hot | (F.col("l_suppkey") % 2 == 0)).alias("is_orig"),
        F.col("ord").cast("bigint").alias("ord"),
        F.when(F.col("l_partkey") % 97 == 0, "S").otherwise("A").alias("flags"),
        (1 + step).cast("bigint").alias("seq"),
        size.cast("bigint").alias("len"),
    )
    return settled(rows)


@query("st02_hot_direction", _WALK.replace("x_packets", "x_packets_hot"))
def hot_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all packets in one direction, walked in chunks of a thousand."""
    out = reconstruction.reconstruct(hot_packets(spark, sf_dir), width=1000)
    return out.select("uid", "is_orig", "ord", "event_type", "len")


@query(
    "st03_flagged_events",
    """SELECT uid, ord, CASE mark WHEN 'gap' THEN 'seq_gap' WHEN 'rexmit' THEN 'rexmit' ELSE 'rexmit_inconsistency' END AS event_type,
       CASE WHEN mark <> 'inconsistent' AND len > 0 THEN seq + len ELSE -1 END AS range_end FROM x_packets WHERE mark IS NOT NULL""",
)
def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reconstruction.flagged_events(view(spark, sf_dir, "x_packets"))
    return out.select("uid", "ord", "event_type", F.coalesce("range_end", F.lit(-1)).alias("range_end"))


VIEWS["x_raw_events"] = """
SELECT uid, ord, protocol, CASE WHEN kind = 'capability' THEN 'data' WHEN CAST(uid AS BIGINT) % 9 = 0 THEN 'greeting' ELSE kind END AS kind,
       CASE WHEN ord % 3 = 0 THEN 'CAPA' ELSE command END AS command, CASE WHEN ord % 7 = 0 THEN '.' ELSE text END AS text FROM x_dialogue
UNION ALL SELECT uid, CAST(1000000 AS BIGINT) AS ord, 'pop3' AS protocol, 'end' AS kind, CAST(NULL AS STRING) AS command, CAST(NULL AS STRING) AS text FROM x_conn
"""


@query(
    "st04_protocol_events",
    """WITH m AS (SELECT *, CASE WHEN protocol = 'pop3' THEN CASE WHEN kind = 'request' THEN coalesce(upper(command) = 'CAPA', false) WHEN kind = 'data' AND text = '.' THEN false END END AS mode FROM x_raw_events),
       l AS (SELECT *, last_value(mode IGNORE NULLS) OVER (PARTITION BY uid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS listing FROM m),
       e AS (SELECT uid, ord, protocol, CASE WHEN kind = 'data' THEN 'capability' ELSE kind END AS kind FROM l
             WHERE kind NOT IN ('data', 'greeting', 'end') OR (kind = 'data' AND text <> '.' AND length(text) > 0 AND coalesce(listing, false)))
       SELECT * FROM e UNION ALL SELECT uid, 1000000, 'unknown', 'ambiguous_banner' FROM (SELECT DISTINCT uid FROM x_raw_events WHERE kind = 'greeting')
       WHERE uid NOT IN (SELECT uid FROM e)""",
)
def protocol_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = protocols.protocol_events(view(spark, sf_dir, "x_raw_events"), width=5)
    return out.select("uid", "ord", "protocol", "kind")


VIEWS["x_payloads"] = """
SELECT CAST(conv_id AS STRING) AS uid, turn % 2 = 1 AS is_orig,
       CASE WHEN turn % 2 = 1 THEN CASE conv_id % 4 WHEN 0 THEN 'ehlo me' WHEN 1 THEN 'a1 capability' WHEN 2 THEN 'capa' ELSE text END
            ELSE CASE conv_id % 4 WHEN 0 THEN '220 mail' WHEN 1 THEN '* OK ready' WHEN 2 THEN '-ERR' ELSE text END END AS payload FROM conversations
"""


@query(
    "st05_payload_signatures",
    """SELECT uid, CASE WHEN c AND s THEN CASE CAST(uid AS BIGINT) % 4 WHEN 0 THEN 'smtp' WHEN 1 THEN 'imap' ELSE '' END ELSE '' END AS protocols FROM (
       SELECT uid, bool_or(is_orig) AS c, bool_or(NOT is_orig) AS s FROM x_payloads GROUP BY uid)""",
)
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = protocols.identify_payload(view(spark, sf_dir, "x_payloads"))
    return out.select("uid", F.array_join("protocols", ",").alias("protocols"))


_DAILY = "SELECT CAST(user_id AS VARCHAR) AS endpoint_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS session_count, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS handshake_failure_rate FROM events GROUP BY 1, 2"


def _events(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("user_id").cast("string").alias("endpoint_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )


def _daily_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "endpoint_id",
        F.col("day").cast("string").alias("day"),
        "session_count",
        F.round("handshake_failure_rate", 6).alias("handshake_failure_rate"),
    )


@query("st06_daily_windows_batch", _DAILY)
def daily_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_rows(online.daily_windows(_events(table(spark, sf_dir, "events")), RATES))


@query("st06_st09_daily_windows_stream", _DAILY)
def daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the table files, written by idempotent upserts, read back by key."""
    windows = online.daily_windows(_events(run.table_stream(spark, sf_dir, "events")), RATES, "40 days")
    path = run.work_dir(spark, "daily")
    run.run_upserts(windows, path)
    return _daily_rows(run.latest_rows(spark, path, ["endpoint_id", "day"]))


@query(
    "st09_case_summaries",
    """SELECT concat('case-', CAST(CAST(record_key AS BIGINT) % 211 AS VARCHAR)) AS case_id, count(*) AS finding_count,
       count(*) FILTER (severity = 'high') AS high_count, max(evaluated_at) AS last_evaluated FROM x_findings GROUP BY 1""",
)
def case_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case summaries of a growing stream of findings in a versioned table, in two runs, a batch repeated."""
    path = run.work_dir(spark, "cases")
    case = F.concat(F.lit("case-"), (F.col("record_key").cast("bigint") % 211).cast("string"))
    rows = view(spark, sf_dir, "x_findings").select(case.alias("case_id"), "severity", "evaluated_at")
    schema = "case_id string, finding_count bigint, high_count bigint, last_evaluated " + rows.schema["evaluated_at"].dataType.simpleString()
    cases = versions.VersionedTable(spark, f"{path}/table", ["case_id"], schema, every=2)
    for lot in (0, 1):
        part = rows.where(F.pmod(F.xxhash64("case_id", "evaluated_at"), F.lit(2)) == lot)
        part.repartition(4).write.mode("append").parquet(f"{path}/in")
        found = run.files_stream(spark, f"{path}/in", rows.schema, files_per_batch=2)
        summary = found.groupBy("case_id").agg(
            F.count(F.lit(1)).alias("finding_count"),
            F.count_if(F.col("severity") == "high").alias("high_count"),
            F.max("evaluated_at").alias("last_evaluated"),
        )
        versions.run_into(summary, cases, f"{path}/checkpoint")
    return cases.read()


@query(
    "s01_log_scan",
    """SELECT 'u' || o_orderkey AS uid, CASE WHEN o_orderkey % 4 = 0 THEN -1.0 ELSE o_custkey / 2 END AS ts, o_orderkey % 20 AS capture, n AS source_ord FROM (
       SELECT *, row_number() OVER (PARTITION BY o_orderkey % 20 ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE o_orderkey % 11 <> 0""",
)
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as analyzer log lines, a file per capture, some broken or with a field of another type."""
    from mxposture.sources.logs import read_log

    path = run.work_dir(spark, "logs")
    key = F.col("o_orderkey")
    time = F.when(key % 4 == 0, F.lit('"late"')).otherwise((F.col("o_custkey") / 2).cast("string"))
    line = F.concat(F.lit('{"uid": "u'), key.cast("string"), F.lit('", "ts": '), time, F.lit("}"))
    rows = table(spark, sf_dir, "orders").select(
        key, (key % 20).alias("capture"), F.when(key % 11 == 0, F.lit("{broken")).otherwise(line).alias("value")
    )
    # A blank line follows every seventh; it is no record.
    rows = rows.withColumn("value", F.when(key % 7 == 0, F.concat("value", F.lit("\n"))).otherwise(F.col("value")))
    rows.repartition("capture").sortWithinPartitions("capture", "o_orderkey").select("value", "capture").write.partitionBy(
        "capture"
    ).text(path)
    found = read_log(spark, f"{path}/*/*.txt", "weird")
    capture = F.regexp_extract("source_file", r"capture=(\d+)", 1).cast("bigint")
    return found.select("uid", F.coalesce("ts", F.lit(-1.0)).alias("ts"), capture.alias("capture"), "source_ord")


VIEWS["x_packets_keyed"] = """
SELECT CAST(l_orderkey AS STRING) AS uid, l_suppkey % 2 = 0 AS is_orig,
       CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS ord,
       CASE WHEN l_partkey % 37 = 0 THEN 'S' ELSE 'A' END AS flags,
       CAST(1 + 10 * (l_linenumber % 5) AS BIGINT) AS seq, CAST(CASE l_partkey % 5 WHEN 0 THEN 20 WHEN 1 THEN 0 ELSE 10 END AS BIGINT) AS len
FROM lineitem
"""


@query("st02_reconstruction_stream", _WALK.replace("x_packets", "x_packets_keyed"))
def reconstruction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(ticks: DataFrame) -> DataFrame:
        rows = run.table_stream(spark, sf_dir, "lineitem")
        packets = rows.select(
            F.col("l_orderkey").cast("string").alias("uid"),
            (F.lit(_START).cast("timestamp") + F.make_dt_interval(secs=F.col("l_linenumber"))).alias("ts"),
            (F.col("l_suppkey") % 2 == 0).alias("is_orig"),
            (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("ord"),
            F.when(F.col("l_partkey") % 37 == 0, "S").otherwise("A").alias("flags"),
            (1 + 10 * (F.col("l_linenumber") % 5)).cast("bigint").alias("seq"),
            F.when(F.col("l_partkey") % 5 == 0, 20).when(F.col("l_partkey") % 5 == 1, 0).otherwise(10).cast("bigint").alias("len"),
        )
        return reconstruction.reconstruct_stream(packets, ticks=ticks)

    out, _ = run.run_ordered(spark, build, "tcp")
    return out.select("uid", "is_orig", "ord", "event_type", "len")


@query(
    "st07_drift_stream",
    """SELECT endpoint_id, day_index, round(drift_n, 5) AS drift FROM (SELECT endpoint_id, day_index,
       list_reduce(list_transform(list(CAST(session_count AS DOUBLE)) OVER (PARTITION BY endpoint_id ORDER BY day_index), lambda x: struct_pack(n := 0.0, m := 0.0, s := 0.0, v := x)),
        lambda a, x: struct_pack(n := a.n + 1, m := a.m + (x.v - a.m) / (a.n + 1), s := greatest(0.0, a.s + x.v - (a.m + (x.v - a.m) / (a.n + 1)) - 0.02), v := 0.0),
        struct_pack(n := 0.0, m := 0.0, s := 0.0, v := 0.0)).s / 0.5 AS drift_n FROM x_daily)""",
)
def drift_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts written as files, then streamed through the stateful drift statistic."""
    path = run.work_dir(spark, "daily-values")
    values = view(spark, sf_dir, "x_daily").select(
        "endpoint_id", "day_index", F.col("session_count").cast("double").alias("value")
    )
    values.write.parquet(path)

    def build(ticks: DataFrame) -> DataFrame:
        stream = run.files_stream(spark, path, values.schema, files_per_batch=2)
        return online.drift_stream(stream, delay="400 days", lifetime="800 days", ticks=ticks)

    out, _ = run.run_ordered(spark, build, "drift")
    return out.select("endpoint_id", "day_index", F.round("drift", 5).alias("drift"))


def _in_lots(rows: DataFrame, path: str) -> None:
    """Rows with event times, dealt into lots without regard to their order."""
    seconds = F.pmod(F.xxhash64("uid"), F.lit(36_000)) + F.least("ord", F.lit(1000))
    timed = rows.withColumn("ts", F.lit(_START).cast("timestamp") + F.make_dt_interval(secs=seconds))
    timed.repartition(6, F.xxhash64("uid", "ord")).write.parquet(path)


@query("st08_upgrade_stream", "SELECT uid, protocol, state FROM y_dialogue_upgrades")
def upgrade_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues streamed through the upgrade machine in lots of any order; sessions end by silence."""
    path = run.work_dir(spark, "dialogues")
    _in_lots(view(spark, sf_dir, "x_dialogue").drop("frame_number", "is_orig"), path)
    schema = spark.read.parquet(path).schema

    def build(ticks: DataFrame) -> DataFrame:
        stream = run.files_stream(spark, path, schema, files_per_batch=3)
        return online.upgrade_stream(stream, delay="1 day", ticks=ticks)

    out, _ = run.run_ordered(spark, build, "upgrade")
    return out.select("uid", "protocol", F.coalesce("state", F.lit("")).alias("state"))


@query(
    "st04_protocol_stream",
    """WITH m AS (SELECT *, CASE WHEN protocol = 'pop3' THEN CASE WHEN kind = 'request' THEN coalesce(upper(command) = 'CAPA', false) WHEN kind = 'data' AND text = '.' THEN false END END AS mode FROM x_raw_events),
       l AS (SELECT *, last_value(mode IGNORE NULLS) OVER (PARTITION BY uid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS listing FROM m),
       e AS (SELECT uid, ord, protocol, CASE WHEN kind = 'data' THEN 'capability' ELSE kind END AS kind, text FROM l
             WHERE kind NOT IN ('data', 'greeting', 'end') OR (kind = 'data' AND text <> '.' AND length(text) > 0 AND coalesce(listing, false)))
       SELECT uid, ord, protocol, kind, coalesce(text, '') AS text FROM e UNION ALL
       SELECT uid, 1000000, 'unknown', 'ambiguous_banner', '' FROM (SELECT DISTINCT uid FROM x_raw_events WHERE kind = 'greeting')
       WHERE uid NOT IN (SELECT uid FROM e)""",
)
def protocol_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run.work_dir(spark, "raw-events")
    _in_lots(view(spark, sf_dir, "x_raw_events"), path)
    schema = spark.read.parquet(path).schema

    def build(ticks: DataFrame) -> DataFrame:
        stream = run.files_stream(spark, path, schema, files_per_batch=3)
        return protocols.protocol_stream(stream, delay="1 day", ticks=ticks)

    out, _ = run.run_ordered(spark, build, "protocol")
    return out.select("uid", "ord", "protocol", "kind", F.coalesce("text", F.lit("")).alias("text"))
