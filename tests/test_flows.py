"""Flow classification against a table of cases, and folding on a small log."""

import itertools

from pyspark.sql import functions as F

from mxposture.operators import flows as ops

CONN = (
    "uid string, capture_no int, orig_h string, orig_p bigint, resp_h string, resp_p bigint, proto string, "
    "history string, missed_bytes bigint, orig_bytes bigint, resp_bytes bigint"
)
RECON = (
    "uid string, ord bigint, is_orig boolean, event_type string, seq bigint, len bigint, range_start bigint, "
    "range_end bigint"
)


def conn(uid, history="ShADadFf", proto="tcp", missed=0, capture=1):
    return (uid, capture, "192.0.2.1", 40000, "198.51.100.1", 25, proto, history, missed, 100, 50)


# uid, connection overrides, events, expected (quality, reason, gap bytes, exact, conditions)
CASES = [
    ("complete", {}, [], ("complete", None, 0, True, [])),
    ("reset", {"history": "ShADadR"}, [], ("complete", None, 0, True, [])),
    ("no_fin", {"history": "ShADad"}, [], ("incomplete", "missing_fin", 0, True, [])),
    ("no_syn", {"history": "ADadFf"}, [], ("incomplete", "missing_syn", 0, True, [])),
    ("syn_only", {"history": "S"}, [], ("complete", None, 0, True, [])),
    ("missed", {"missed": 7}, [], ("incomplete", "segment_gap", 7, True, [])),
    ("midstream", {"missed": 7, "history": "ADadFf"}, [], ("incomplete", "midstream_start", 7, True, [])),
    ("gap", {}, [("seq_gap", 100, 30)], ("incomplete", "segment_gap", 30, True, [])),
    ("gap_first", {}, [("seq_gap", 1, 30)], ("incomplete", "midstream_start", 30, True, [])),
    ("gap_open", {}, [("seq_gap", None, 30)], ("incomplete", "midstream_start", 30, False, [])),
    ("order", {}, [("out_of_order", 5, 1)], ("complete", None, 0, True, ["out_of_order_segments"])),
    ("again", {}, [("rexmit", 5, 1)], ("complete", None, 0, True, ["duplicate_segments"])),
    ("conflict", {}, [("rexmit_inconsistency", None, 150), ("rexmit", 51, 200)],
     ("conflicting", "overlapping_retransmission_conflict", 0, True, [])),
    ("conflict_len", {}, [("rexmit_inconsistency", None, 9)],
     ("conflicting", "overlapping_retransmission_conflict", 0, True, [])),
    ("udp", {"proto": "udp", "history": "D"}, [], ("complete", None, 0, True, [])),
    ("cut", {"capture": 2}, [], ("incomplete", "snaplen_truncation", 0, False, [])),
    ("cut_udp", {"capture": 2, "proto": "udp"}, [], ("incomplete", "snaplen_truncation", 0, False, [])),
    ("lost", {"capture": 3}, [], ("incomplete", "capture_loss", 0, False, [])),
]


def build(spark):
    rows = [conn(uid, **over) for uid, over, _, _ in CASES]
    number = itertools.count()
    events = [
        (uid, next(number), True, kind, seq, size, None, None)
        for uid, _, listed, _ in CASES
        for kind, seq, size in listed
    ]
    captures = spark.createDataFrame(
        [(1, False, 0), (2, True, 0), (3, False, 4)], "capture_no int, truncated boolean, loss_gaps bigint"
    )
    recon = spark.createDataFrame(events, RECON)
    flows = ops.build_flows(spark.createDataFrame(rows, CONN), recon, F.col("ord"), captures)
    return flows, recon


def test_quality_table(spark):
    flows, _ = build(spark)
    got = {
        r.uid: (r.reconstruction_quality, r.reason_code, r.gap_bytes, r.gap_bytes_exact, r.observed_conditions)
        for r in flows.collect()
    }
    assert got == {uid: expected for uid, _, _, expected in CASES}


def test_conflicting_ranges(spark):
    flows, recon = build(spark)
    got = {
        (r.uid, r.start, r.end, r.direction, r.exact) for r in ops.conflicting_ranges(recon, flows).collect()
    }
    assert got == {("conflict", 51, 251, "orig", True), ("conflict_len", 0, 9, "orig", False)}


def test_frames_need_exactly_one_flow(spark):
    schema = "uid string, orig_h string, orig_p bigint, resp_h string, resp_p bigint"
    flows = spark.createDataFrame(
        [("a", "h1", 1, "h2", 2), ("b", "h3", 1, "h4", 2), ("c", "h4", 2, "h3", 1)], schema
    )
    frames = spark.createDataFrame(
        [(1, "h2", 2, "h1", 1), (2, "h3", 1, "h4", 2), (3, "h1", 1, "h1", 1), (4, "h1", 1, "h2", 70000)],
        "frame_number bigint, src string, src_port bigint, dst string, dst_port bigint",
    )
    assert [(r.frame_number, r.uid) for r in ops.match_frames(frames, flows).collect()] == [(1, "a")]
