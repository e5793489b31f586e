"""Flows: reconstruction events folded per connection, quality classification, host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mxposture.constants import IMAP_PORTS, POP3_PORTS, SMTP_PORTS


def direction(is_orig: Column) -> Column:
    """Originator unless the flag is explicitly false."""
    return F.when(is_orig == F.lit(False), "resp").otherwise("orig")


def port_hint(resp_port: Column, orig_port: Column) -> Column:
    def hint(port: Column) -> Column:
        return (
            F.when(port.isin(SMTP_PORTS), "smtp")
            .when(port.isin(IMAP_PORTS), "imap")
            .when(port.isin(POP3_PORTS), "pop3")
        )

    return F.coalesce(hint(resp_port), hint(orig_port), F.lit("none"))


def byte_ranges(recon: DataFrame) -> DataFrame:
    """Half-open byte ranges of gap, overlap and retransmission events, one row per range.

    Ranges stay rows: a connection may have any number of them.
    """
    explicit = F.col("range_start") if "range_start" in recon.columns else F.lit(None).cast("bigint")
    end = F.col("range_end") if "range_end" in recon.columns else F.lit(None).cast("bigint")
    start = F.coalesce(explicit, F.col("seq"))
    begin = F.coalesce(start, F.lit(0)).cast("bigint")
    stop = F.coalesce(end, begin + F.col("len")).cast("bigint")
    exact = F.when(F.col("event_type") == "rexmit", F.col("seq").isNotNull()).otherwise(
        start.isNotNull()
    )
    return (
        recon.where(F.col("event_type").isin("seq_gap", "overlap", "rexmit"))
        .select(
            "*",
            begin.alias("start"),
            stop.alias("end"),
            direction(F.col("is_orig")).alias("direction"),
            (exact & start.isNotNull()).alias("exact"),
        )
        .where(F.col("end") >= F.col("start"))
    )


def fold_reconstruction(recon: DataFrame, order: Column) -> DataFrame:
    """One row per connection: counts, flags, range totals and the last inconsistency length.

    Every aggregate merges map-side, so a connection with very many events moves one partial row
    per input partition. ``order`` is a single BIGINT position: with fixed-width buffers only, the
    aggregation stays hash-based.
    """
    explicit = F.col("range_start") if "range_start" in recon.columns else F.lit(None).cast("bigint")
    end = F.col("range_end") if "range_end" in recon.columns else F.lit(None).cast("bigint")
    kind = F.col("event_type")
    start = F.coalesce(explicit, F.col("seq"))
    begin = F.coalesce(start, F.lit(0)).cast("bigint")
    stop = F.coalesce(end, begin + F.col("len")).cast("bigint")
    legal = F.coalesce(stop >= begin, F.lit(False))
    size = stop - begin

    def ranged(name: str) -> Column:
        return (kind == name) & legal

    return recon.groupBy("uid").agg(
        F.count_if(ranged("seq_gap")).alias("gap_count"),
        F.coalesce(F.sum(F.when(ranged("seq_gap"), size)), F.lit(0)).alias("gap_total"),
        F.min(F.when(ranged("seq_gap"), begin)).alias("gap_first"),
        F.coalesce(F.min(F.when(ranged("seq_gap"), start.isNotNull())), F.lit(True)).alias(
            "gaps_exact"
        ),
        F.count_if(ranged("overlap")).alias("overlap_count"),
        F.coalesce(F.sum(F.when(ranged("overlap"), size)), F.lit(0)).alias("overlap_total"),
        F.count_if(kind == "rexmit").alias("rexmit_count"),
        F.count_if(ranged("rexmit")).alias("rexmit_ranges"),
        F.coalesce(F.sum(F.when(ranged("rexmit"), size)), F.lit(0)).alias("rexmit_total"),
        F.coalesce(F.max(kind == "out_of_order"), F.lit(False)).alias("out_of_order"),
        F.coalesce(F.max(kind == "duplicate"), F.lit(False)).alias("duplicate"),
        F.coalesce(F.max(kind == "rexmit_inconsistency"), F.lit(False)).alias("inconsistent"),
        F.max_by(
            F.col("len").cast("bigint"), F.when(kind == "rexmit_inconsistency", order.cast("bigint"))
        ).alias("last_conflict_len"),
    )


def capture_facts(loss: DataFrame, key: str = "capture_no") -> DataFrame:
    """Capture-wide gap total, one row per capture."""
    return loss.groupBy(key).agg(F.coalesce(F.sum("gaps"), F.lit(0)).alias("loss_gaps"))


_FOLD_DEFAULTS = {
    "gap_count": 0,
    "gap_total": 0,
    "gaps_exact": True,
    "overlap_count": 0,
    "overlap_total": 0,
    "rexmit_count": 0,
    "rexmit_ranges": 0,
    "rexmit_total": 0,
    "out_of_order": False,
    "duplicate": False,
    "inconsistent": False,
}


def attach_reconstruction(conn: DataFrame, folded: DataFrame) -> DataFrame:
    """Connections with their folded events; connections without events get neutral facts."""
    joined = conn.join(folded, "uid", "left")
    return joined.fillna(_FOLD_DEFAULTS)


def classify(
    flows: DataFrame, truncated: Column | None = None, loss_gaps: Column | None = None
) -> DataFrame:
    """Quality, reason, gap size, conditions and evidence state; first rule that holds wins."""
    truncated = F.lit(False) if truncated is None else F.coalesce(truncated, F.lit(False))
    loss_gaps = F.lit(0) if loss_gaps is None else F.coalesce(loss_gaps, F.lit(0))
    history = F.coalesce(F.col("history"), F.lit(""))
    missed = F.coalesce(F.col("missed_bytes"), F.lit(0))
    gap = F.when(missed > 0, missed).otherwise(F.col("gap_total"))
    conflict_ranges = F.when(
        F.col("inconsistent"),
        F.when(F.col("overlap_count") > 0, F.col("overlap_count"))
        .when(F.col("rexmit_ranges") > 0, F.col("rexmit_ranges"))
        .when(F.col("last_conflict_len").isNotNull(), F.lit(1))
        .otherwise(F.lit(0)),
    ).otherwise(F.lit(0))
    conflict_bytes = F.when(
        F.col("inconsistent"),
        F.when(F.col("overlap_count") > 0, F.col("overlap_total"))
        .when(F.col("rexmit_ranges") > 0, F.col("rexmit_total"))
        .otherwise(F.coalesce(F.col("last_conflict_len"), F.lit(0))),
    ).otherwise(F.lit(0))
    no_syn = ~history.contains("S")
    established = history.rlike("[hDdA]")
    closed = history.rlike("[FfRr]")
    reason = (
        F.when((F.col("proto") != "tcp") & truncated, "snaplen_truncation")
        .when(F.col("proto") != "tcp", "")
        .when(conflict_ranges > 0, "overlapping_retransmission_conflict")
        .when(truncated, "snaplen_truncation")
        .when(
            (missed > 0) | (F.col("gap_count") > 0),
            F.when(no_syn | (F.coalesce(F.col("gap_first"), F.lit(2)) <= 1), "midstream_start").otherwise(
                "segment_gap"
            ),
        )
        .when(loss_gaps > 0, "capture_loss")
        .when(no_syn, "missing_syn")
        .when(established & ~closed, "missing_fin")
        .otherwise("")
    )
    out = flows.withColumn("_reason", reason).withColumn("conflict_ranges", conflict_ranges.cast("bigint"))
    why = F.col("_reason")
    tcp_cut = (F.col("proto") == "tcp") & (why == "snaplen_truncation")
    gapped = why.isin("midstream_start", "segment_gap")
    quality = (
        F.when(why == "", "complete")
        .when(why == "overlapping_retransmission_conflict", "conflicting")
        .otherwise("incomplete")
    )
    duplicate = F.col("duplicate") | (F.col("rexmit_count") > 0)
    return (
        out.withColumn("reconstruction_quality", quality)
        .withColumn("reason_code", F.when(why != "", why))
        .withColumn(
            "gap_bytes", F.when(tcp_cut | gapped, gap).otherwise(F.lit(0)).cast("bigint")
        )
        .withColumn(
            "gap_bytes_exact",
            F.when(tcp_cut, gap > 0)
            .when(gapped, (missed > 0) | F.col("gaps_exact"))
            .otherwise(~why.isin("snaplen_truncation", "capture_loss")),
        )
        .withColumn(
            "conflict_bytes",
            F.when(F.col("reconstruction_quality") == "conflicting", conflict_bytes)
            .otherwise(F.lit(0))
            .cast("bigint"),
        )
        .withColumn(
            "observed_conditions",
            F.array_compact(
                F.array(
                    F.when(F.col("out_of_order"), "out_of_order_segments"),
                    F.when(
                        duplicate & (F.col("reconstruction_quality") != "conflicting"),
                        "duplicate_segments",
                    ),
                )
            ),
        )
        .withColumn(
            "evidence_state",
            F.when(F.col("reconstruction_quality") == "complete", "observed").otherwise(
                F.col("reconstruction_quality")
            ),
        )
        .drop("_reason")
    )


def conflicting_ranges(recon: DataFrame, flows: DataFrame) -> DataFrame:
    """Ranges behind a conflicting verdict as rows: overlaps, else retransmissions, else the
    last inconsistency length from the stream start."""
    bad = flows.where(F.col("reconstruction_quality") == "conflicting").select(
        "uid",
        F.when(F.col("overlap_count") > 0, "overlap")
        .when(F.col("rexmit_ranges") > 0, "rexmit")
        .alias("_use"),
        "last_conflict_len",
    )
    real = (
        byte_ranges(recon)
        .join(bad.where(F.col("_use").isNotNull()), "uid")
        .where(F.col("event_type") == F.col("_use"))
        .select("uid", "start", "end", "direction", "exact")
    )
    assumed = bad.where(F.col("_use").isNull()).select(
        "uid",
        F.lit(0).cast("bigint").alias("start"),
        F.col("last_conflict_len").cast("bigint").alias("end"),
        F.lit("orig").alias("direction"),
        F.lit(False).alias("exact"),
    )
    return real.unionByName(assumed)


def build_flows(
    conn: DataFrame,
    recon: DataFrame,
    order: Column,
    captures: DataFrame | None = None,
    key: str = "capture_no",
) -> DataFrame:
    """Flow evidence from connection and reconstruction logs.

    ``captures`` (one row per capture: truncated, loss_gaps) joins on the capture key.
    """
    flows = attach_reconstruction(conn, fold_reconstruction(recon, order))
    if captures is None:
        return classify(flows)
    flows = flows.join(captures, key, "left")
    return classify(flows, F.col("truncated"), F.col("loss_gaps"))


def weird_names(weird: DataFrame) -> DataFrame:
    """Distinct anomaly names per connection as rows with their counts."""
    named = weird.where(F.length("name") > 0)
    return named.groupBy("uid", "name").agg(F.count(F.lit(1)).alias("times"))


def endpoint_key(h1: Column, p1: Column, h2: Column, p2: Column) -> Column:
    """Direction-free key of a host:port pair; null when both ends are the same."""
    a = F.concat_ws(":", h1, p1.cast("string"))
    b = F.concat_ws(":", h2, p2.cast("string"))
    return F.when(a != b, F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def unique_endpoint_flows(flows: DataFrame) -> DataFrame:
    """Endpoint pairs that belong to exactly one flow."""
    keyed = flows.select(
        "uid",
        endpoint_key(F.col("orig_h"), F.col("orig_p"), F.col("resp_h"), F.col("resp_p")).alias("pair"),
    ).where(F.col("pair").isNotNull())
    return (
        keyed.groupBy("pair")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("uid").alias("uid"))
        .where(F.col("_n") == 1)
        .select("pair", "uid")
    )


def match_frames(frames: DataFrame, flows: DataFrame) -> DataFrame:
    """Frames with the uid of the only flow between the same two endpoints.

    The flow side has one row per pair, so a busy pair never multiplies; AQE splits its frames.
    """
    legal = F.col("src_port").between(0, 65535) & F.col("dst_port").between(0, 65535)
    pair = endpoint_key(F.col("src"), F.col("src_port"), F.col("dst"), F.col("dst_port"))
    keyed = frames.where(legal).withColumn("pair", pair).where(F.col("pair").isNotNull())
    return keyed.join(unique_endpoint_flows(flows), "pair").drop("pair")


def host_degrees(flows: DataFrame) -> DataFrame:
    """Number of flow ends at each host."""
    ends = flows.select(F.explode(F.array("orig_h", "resp_h")).alias("host"))
    return ends.groupBy("host").agg(F.count(F.lit(1)).alias("degree"))


def endpoint_edges(flows: DataFrame) -> DataFrame:
    """How many flows run between two host:port ends, in direction."""
    return flows.groupBy(
        F.concat_ws(":", "orig_h", F.col("orig_p").cast("string")).alias("source"),
        F.concat_ws(":", "resp_h", F.col("resp_p").cast("string")).alias("target"),
    ).agg(F.count(F.lit(1)).alias("flows"))
