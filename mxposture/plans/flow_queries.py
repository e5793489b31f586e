"""Flow queries over the adapter views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.functions import coerce
from mxposture.operators import flows as ops
from mxposture.operators.scale import global_position
from mxposture.plans.adapters import VIEWS, table, view
from mxposture.plans.registry import query



def recon_order() -> Column:
    """Position of an event in its connection as one number: line, then sequence, then length."""
    return (F.col("line") * 100_000_000 + F.col("seq")) * 1000 + F.col("len")


# Capture-wide facts: every fifth capture was cut by its snap length, capture 7 lost packets.
VIEWS["x_capture"] = """
SELECT o_custkey % 11 AS capture_no, o_custkey % 11 = 5 AS truncated,
       sum(CASE WHEN o_custkey % 11 = 7 AND o_orderkey % 997 = 0 THEN 1 ELSE 0 END) AS loss_gaps
FROM orders GROUP BY o_custkey % 11
"""

# Frames: the same endpoints as the flows, written from either side.
VIEWS["x_frames"] = """
SELECT uid AS true_uid, CAST(uid AS BIGINT) AS frame_number,
       CASE WHEN CAST(uid AS BIGINT) % 2 = 0 THEN orig_h ELSE resp_h END AS src,
       CASE WHEN CAST(uid AS BIGINT) % 2 = 0 THEN orig_p ELSE resp_p END AS src_port,
       CASE WHEN CAST(uid AS BIGINT) % 2 = 0 THEN resp_h ELSE orig_h END AS dst,
       CASE WHEN CAST(uid AS BIGINT) % 2 = 0 THEN resp_p ELSE orig_p END AS dst_port
FROM x_conn
"""

_FOLD = """
SELECT uid,
 count(*) FILTER (event_type = 'seq_gap') AS gap_count,
 coalesce(sum(len) FILTER (event_type = 'seq_gap'), 0) AS gap_total,
 min(seq) FILTER (event_type = 'seq_gap') AS gap_first,
 count(*) FILTER (event_type = 'overlap') AS overlap_count,
 coalesce(sum(len) FILTER (event_type = 'overlap'), 0) AS overlap_total,
 count(*) FILTER (event_type = 'rexmit') AS rexmit_count,
 coalesce(sum(len) FILTER (event_type = 'rexmit'), 0) AS rexmit_total,
 bool_or(event_type = 'out_of_order') AS out_of_order,
 bool_or(event_type = 'duplicate') AS duplicate,
 bool_or(event_type = 'rexmit_inconsistency') AS inconsistent,
 max(struct_pack(line := line, seq := seq, len := len))
   FILTER (event_type = 'rexmit_inconsistency').len AS last_conflict_len
FROM x_recon GROUP BY uid
"""

# Classified flows as a checking view; the Spark side builds the same rows with operators.
VIEWS["y_flows"] = f"""
SELECT *,
 CASE WHEN reason = '' THEN 'complete'
      WHEN reason = 'overlapping_retransmission_conflict' THEN 'conflicting'
      ELSE 'incomplete' END AS quality,
 CASE WHEN (proto = 'tcp' AND reason = 'snaplen_truncation') OR reason IN ('midstream_start', 'segment_gap')
      THEN CASE WHEN missed_bytes > 0 THEN missed_bytes ELSE gap_total END ELSE 0 END AS gap_bytes
FROM (SELECT c.*, truncated, r.* EXCLUDE (uid, gap_total), coalesce(gap_total, 0) AS gap_total,
  CASE WHEN proto <> 'tcp' THEN CASE WHEN truncated THEN 'snaplen_truncation' ELSE '' END
       WHEN coalesce(inconsistent, false) THEN 'overlapping_retransmission_conflict'
       WHEN truncated THEN 'snaplen_truncation'
       WHEN missed_bytes > 0 OR coalesce(gap_count, 0) > 0 THEN
         CASE WHEN NOT contains(history, 'S') OR coalesce(gap_first, 2) <= 1 THEN 'midstream_start'
              ELSE 'segment_gap' END
       WHEN loss_gaps > 0 THEN 'capture_loss'
       WHEN NOT contains(history, 'S') THEN 'missing_syn'
       WHEN regexp_matches(history, '[hDdA]') AND NOT regexp_matches(history, '[FfRr]') THEN 'missing_fin'
       ELSE '' END AS reason
  FROM x_conn c JOIN x_capture USING (capture_no) LEFT JOIN ({_FOLD}) r ON c.uid = r.uid)
"""


def built_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified flows of the adapter views, shared by the other query modules."""
    return ops.build_flows(
        view(spark, sf_dir, "x_conn"),
        view(spark, sf_dir, "x_recon"),
        recon_order(),
        view(spark, sf_dir, "x_capture"),
    )


@query(
    "a01_flow_event_fold",
    f"""SELECT uid, gap_count, CAST(gap_total AS BIGINT) AS gap_total, coalesce(gap_first, -1) AS gap_first,
      overlap_count, rexmit_count, CAST(overlap_total + rexmit_total AS BIGINT) AS repeated_bytes,
      out_of_order, duplicate, inconsistent,
      coalesce(last_conflict_len, -1) AS last_conflict_len FROM ({_FOLD})""",
)
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = ops.fold_reconstruction(view(spark, sf_dir, "x_recon"), recon_order())
    return folded.select(
        "uid",
        "gap_count",
        "gap_total",
        F.coalesce("gap_first", F.lit(-1)).alias("gap_first"),
        "overlap_count",
        "rexmit_count",
        (F.col("overlap_total") + F.col("rexmit_total")).alias("repeated_bytes"),
        "out_of_order",
        "duplicate",
        "inconsistent",
        F.coalesce("last_conflict_len", F.lit(-1)).alias("last_conflict_len"),
    )


@query(
    "a02_range_totals",
    """SELECT event_type, CASE WHEN is_orig THEN 'orig' ELSE 'resp' END AS direction,
       count(*) AS ranges, CAST(sum(len) AS BIGINT) AS range_bytes
       FROM x_recon WHERE event_type IN ('seq_gap', 'overlap', 'rexmit') GROUP BY 1, 2""",
)
def range_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = ops.byte_ranges(view(spark, sf_dir, "x_recon"))
    return ranges.groupBy("event_type", "direction").agg(
        F.count(F.lit(1)).alias("ranges"), F.sum(F.col("end") - F.col("start")).alias("range_bytes")
    )


@query(
    "f01_flow_quality",
    """SELECT uid, capture_no, quality AS reconstruction_quality, reason AS reason_code,
       CAST(gap_bytes AS BIGINT) AS gap_bytes,
       CASE WHEN quality = 'complete' THEN 'observed' ELSE quality END AS evidence_state,
       concat_ws(',', CASE WHEN out_of_order THEN 'out_of_order_segments' END,
         CASE WHEN (duplicate OR rexmit_count > 0) AND quality <> 'conflicting'
              THEN 'duplicate_segments' END) AS conditions
       FROM y_flows""",
)
def flow_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_flows(spark, sf_dir).select(
        "uid",
        "capture_no",
        "reconstruction_quality",
        F.coalesce("reason_code", F.lit("")).alias("reason_code"),
        "gap_bytes",
        "evidence_state",
        F.array_join("observed_conditions", ",").alias("conditions"),
    )


@query(
    "f02_conflicting_ranges",
    """WITH bad AS (SELECT uid, CASE WHEN overlap_count > 0 THEN 'overlap' WHEN rexmit_count > 0 THEN 'rexmit'
         END AS use, last_conflict_len FROM y_flows WHERE quality = 'conflicting')
       SELECT b.uid, r.seq AS range_start, r.seq + r.len AS range_end,
              CASE WHEN is_orig THEN 'orig' ELSE 'resp' END AS direction, true AS exact
       FROM bad b JOIN x_recon r ON b.uid = r.uid AND r.event_type = b.use
       UNION ALL SELECT uid, 0, last_conflict_len, 'orig', false FROM bad WHERE use IS NULL""",
)
def conflict_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.conflicting_ranges(view(spark, sf_dir, "x_recon"), built_flows(spark, sf_dir))
    return rows.withColumnsRenamed({"start": "range_start", "end": "range_end"})


@query(
    "j01_flow_event_join",
    """SELECT capture_no, quality, count(*) AS flows, CAST(sum(orig_bytes + resp_bytes) AS BIGINT) AS bytes,
       CAST(sum(missed_bytes) AS BIGINT) AS missed,
       CAST(coalesce(sum(coalesce(rexmit_count, 0)), 0) AS BIGINT) AS rexmits
       FROM y_flows GROUP BY 1, 2""",
)
def flow_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        built_flows(spark, sf_dir)
        .groupBy("capture_no", F.col("reconstruction_quality").alias("quality"))
        .agg(
            F.count(F.lit(1)).alias("flows"),
            F.sum(F.col("orig_bytes") + F.col("resp_bytes")).alias("bytes"),
            F.sum("missed_bytes").cast("bigint").alias("missed"),
            F.sum("rexmit_count").alias("rexmits"),
        )
    )


@query(
    "j02_weird_names_join",
    """SELECT c.uid, coalesce(w.name, '') AS name, coalesce(w.times, 0) AS times FROM x_conn c
       LEFT JOIN (SELECT uid, event_type AS name, count(*) AS times FROM x_recon
                  WHERE event_type <> 'none' GROUP BY 1, 2) w ON c.uid = w.uid""",
)
def weird_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    recon = view(spark, sf_dir, "x_recon")
    weird = recon.where("event_type <> 'none'").select("uid", F.col("event_type").alias("name"))
    conn = view(spark, sf_dir, "x_conn").select("uid")
    return conn.join(ops.weird_names(weird), "uid", "left").fillna({"name": "", "times": 0})


@query(
    "j03_capture_facts_join",
    """SELECT capture_no, truncated, CAST(loss_gaps AS BIGINT) AS loss_gaps, count(*) AS flows
       FROM x_conn JOIN x_capture USING (capture_no) GROUP BY ALL""",
)
def capture_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row per capture on the right: the flow side is reduced before the join.
    per_capture = view(spark, sf_dir, "x_conn").groupBy("capture_no").agg(
        F.count(F.lit(1)).alias("flows")
    )
    facts = view(spark, sf_dir, "x_capture")
    return per_capture.join(facts, "capture_no").select(
        "capture_no", "truncated", F.col("loss_gaps").cast("bigint").alias("loss_gaps"), "flows"
    )


@query(
    "j05_frame_to_flow",
    """WITH keyed AS (SELECT uid, least(orig_h || ':' || orig_p, resp_h || ':' || resp_p) || '|' ||
          greatest(orig_h || ':' || orig_p, resp_h || ':' || resp_p) AS pair FROM x_conn),
       single AS (SELECT pair, min(uid) AS uid FROM keyed GROUP BY pair HAVING count(*) = 1)
       SELECT frame_number, uid FROM x_frames JOIN single ON pair =
          least(src || ':' || src_port, dst || ':' || dst_port) || '|' ||
          greatest(src || ':' || src_port, dst || ':' || dst_port)""",
)
def frame_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "x_frames")
    return ops.match_frames(frames, view(spark, sf_dir, "x_conn")).select("frame_number", "uid")


@query(
    "a18_host_graph",
    """SELECT host, count(*) AS degree FROM (SELECT orig_h AS host FROM x_conn
       UNION ALL SELECT resp_h FROM x_conn) GROUP BY host""",
)
def host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.host_degrees(view(spark, sf_dir, "x_conn"))


@query(
    "a18_edge_multiplicity",
    """SELECT orig_h || ':' || orig_p AS source, resp_h || ':' || resp_p AS target, count(*) AS flows
       FROM x_conn GROUP BY 1, 2""",
)
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.endpoint_edges(view(spark, sf_dir, "x_conn"))


@query(
    "f04_port_hint",
    """SELECT hint, count(*) AS flows FROM (SELECT CASE WHEN resp_p IN (25, 465, 587) THEN 'smtp'
       WHEN resp_p IN (143, 993) THEN 'imap' WHEN resp_p IN (110, 995) THEN 'pop3' ELSE 'none' END AS hint
       FROM x_conn) GROUP BY hint""",
)
def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = ops.port_hint(F.col("resp_p"), F.col("orig_p")).alias("hint")
    return view(spark, sf_dir, "x_conn").groupBy(hint).agg(F.count(F.lit(1)).alias("flows"))


@query(
    "f03_event_directions",
    """SELECT direction, event_type, count(*) AS events FROM (SELECT event_type,
       CASE WHEN line % 5 <> 0 AND NOT is_orig THEN 'resp' ELSE 'orig' END AS direction FROM x_recon)
       GROUP BY 1, 2""",
)
def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("line") % 5 != 0, F.col("is_orig"))
    return (
        view(spark, sf_dir, "x_recon")
        .groupBy(ops.direction(flag).alias("direction"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query(
    "p01_defensive_casts",
    """SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 3 THEN -1 ELSE 1 END IS NULL AS was_null,
       coalesce(CASE o_orderkey % 4 WHEN 1 THEN o_orderkey WHEN 2 THEN NULL END, -1) AS number,
       CASE WHEN length(o_orderpriority) <= 6 THEN o_orderpriority ELSE '' END AS short_text,
       CASE WHEN floor(o_totalprice) = o_totalprice THEN CAST(o_totalprice AS BIGINT) ELSE -1 END AS whole_price
       FROM orders""",
)
def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    raw = (
        F.when(key % 4 == 0, None)
        .when(key % 4 == 1, key.cast("string"))
        .when(key % 4 == 2, F.concat(key.cast("string"), F.lit("x")))
        .otherwise(F.concat(F.lit("-"), key.cast("string")))
    )
    return orders.withColumn("_raw", raw).select(
        key.alias("id"),
        F.col("_raw").isNull().alias("was_null"),
        F.coalesce(coerce.whole_number(F.col("_raw")), F.lit(-1)).alias("number"),
        F.coalesce(coerce.bounded_string(F.col("o_orderpriority"), 6), F.lit("")).alias("short_text"),
        F.coalesce(coerce.whole_number(F.col("o_totalprice"), "double"), F.lit(-1)).alias(
            "whole_price"
        ),
    )


@query(
    "p02_list_casts",
    """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part,
       concat_ws(',', l_partkey, l_suppkey) AS numbers
       FROM lineitem""",
)
def list_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(
        F.lit(" "), F.col("l_partkey").cast("string"), F.lit(", x7,,"), F.col("l_suppkey").cast("string")
    )
    numbers = coerce.int_list(raw, limit=8).cast("array<string>")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.array_join(numbers, ",").alias("numbers"),
    )


@query(
    "p03_flat_or_nested",
    "SELECT uid, orig_h, resp_h, orig_p, resp_p FROM x_conn",
)
def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = view(spark, sf_dir, "x_conn")
    boxed = conn.select(
        "uid",
        F.struct("orig_h", "orig_p", "resp_p").alias("id"),
        F.col("resp_h").alias("id.resp_h"),
    )
    out = coerce.well_formed_connection(boxed)
    return out.select("uid", "orig_h", "resp_h", "orig_p", "resp_p")


@query(
    "p04_malformed_rows",
    """SELECT uid, resp_p FROM (SELECT uid, CASE WHEN CAST(uid AS BIGINT) % 6 = 0 THEN 70000 ELSE resp_p END AS resp_p,
       CASE WHEN CAST(uid AS BIGINT) % 10 = 0 THEN NULL ELSE orig_h END AS orig_h FROM x_conn)
       WHERE resp_p <= 65535 AND orig_h IS NOT NULL""",
)
def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("uid").cast("bigint")
    broken = (
        view(spark, sf_dir, "x_conn")
        .withColumn("resp_p", F.when(number % 6 == 0, F.lit(70000)).otherwise(F.col("resp_p")))
        .withColumn("orig_h", F.when(number % 10 != 0, F.col("orig_h")))
    )
    return broken.where(coerce.valid_connection()).select("uid", "resp_p")


@query(
    "p13_second_pass_gate",
    """SELECT capture_no, bool_or(resp_p IN (465, 993, 995)) OR bool_or(s.uid IS NOT NULL) AS needs_pass
       FROM x_conn c LEFT JOIN (SELECT DISTINCT uid FROM x_ssl WHERE NOT established) s ON c.uid = s.uid
       GROUP BY capture_no""",
)
def pass_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tls = view(spark, sf_dir, "x_ssl").where("NOT established").select("uid").distinct()
    conn = view(spark, sf_dir, "x_conn").join(tls.withColumn("_tls", F.lit(True)), "uid", "left")
    ports = F.col("resp_p").isin(465, 993, 995)
    return conn.groupBy("capture_no").agg(
        F.max(ports | F.coalesce("_tls", F.lit(False))).alias("needs_pass")
    )


@query(
    "t01_flow_order",
    """SELECT row_number() OVER (ORDER BY proto, orig_h, orig_p, resp_h, resp_p, uid) AS position,
       uid FROM x_conn""",
)
def flow_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["proto", "orig_h", "orig_p", "resp_h", "resp_p", "uid"]
    rows = view(spark, sf_dir, "x_conn").select(*keys)
    return global_position(rows, keys).select("position", "uid")
