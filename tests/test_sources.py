"""Readers, stores, streams and the jobs on small files."""

import json

import pytest
from pyspark.sql import functions as F

from mxposture.functions import coerce
from mxposture.plans import jobs
from mxposture.plans.cohort import cohort_labels, cohort_windows
from mxposture.sources import files, logs, lookups, stores
from mxposture.sources.rulepacks import built_in_pack
from mxposture.streaming import online, pickup, run


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def capture(folder, uid="C1", port=587):
    lines(
        folder / "conn.log",
        [
            {"uid": uid, "id.orig_h": "192.0.2.1", "id.orig_p": 4000, "id.resp_h": "198.51.100.1", "id.resp_p": port,
             "proto": "tcp", "history": "ShADadFf", "missed_bytes": 0, "orig_bytes": 10, "resp_bytes": 20},
            "", "not json", "[1]",
            {"uid": "C2", "id": {"orig_h": "192.0.2.2", "orig_p": 1, "resp_h": "198.51.100.2", "resp_p": 70000}, "proto": "tcp"},
        ],
    )
    lines(folder / "weird.log", [{"uid": uid, "name": "odd"}])
    lines(folder / "capture_loss.log", [{"gaps": 0}])
    lines(folder / "tcp_recon.log", [{"uid": uid, "event_type": "out_of_order", "seq": 5, "len": 1, "is_orig": True}])
    lines(
        folder / "email_events.log",
        [
            {"ts": 1.0, "uid": uid, "protocol": "smtp", "is_orig": False, "event_type": "reply", "reply_code": 250, "text": "STARTTLS", "command": "EHLO"},
            {"ts": 2.0, "uid": uid, "protocol": "smtp", "is_orig": True, "event_type": "request", "command": "starttls"},
            {"ts": 3.0, "uid": uid, "protocol": "smtp", "is_orig": False, "event_type": "reply", "reply_code": 220, "text": "go"},
            {"ts": 4.0, "uid": uid, "protocol": "smtp", "is_orig": True, "event_type": "request", "command": "AUTH", "argument": "secret"},
        ],
    )
    lines(
        folder / "ssl.log",
        [{"ts": 3.5, "uid": uid, "ssl_history": "CsxknGIif", "established": True, "resumed": False, "server_version": 769,
          "cipher": "TLS_RSA_WITH_AES_128_CBC_SHA", "server_name": "mail.example.com",
          "cert_chain_fps": ["aa" * 32], "client_cert_chain_fps": []}],
    )
    lines(folder / "cert_files.log", [{"uid": uid, "fuid": "F1", "sha256": "AA" * 32, "source": "SSL", "truncated": False}])


def test_log_lines(spark, tmp_path):
    capture(tmp_path / "cap1")
    conn = logs.read_log(spark, str(tmp_path / "*" / "conn.log"), "conn")
    assert conn.count() == 2
    good = coerce.well_formed_connection(conn)
    assert [(r.uid, r.resp_p) for r in good.collect()] == [("C1", 587)]
    order = logs.read_log(spark, str(tmp_path / "cap1" / "email_events.log"), "email_events")
    assert [r.ts for r in order.orderBy("source_ord").collect()] == [1.0, 2.0, 3.0, 4.0]


@pytest.mark.parametrize("split", [None, 97, 1000])
def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    want = {}
    for f in range(5):
        text, place = [], 0
        for i in range([0, 1, 40, 90, 7][f]):
            uid = f"{f}-{i}"
            if i % 7 == 3:
                text.append("")  # a blank line is no record
            text.append("broken" if i % 11 == 5 else '{"uid": "%s", "name": "%s"}' % (uid, "n" * (i % 13)))
            if i % 11 != 5:
                want[uid] = place
            place += 1
        (tmp_path / f"c{f}").mkdir()
        (tmp_path / f"c{f}" / "weird.log").write_text("\n".join(text))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
        rows = logs.read_log(spark, f"{tmp_path}/*/weird.log", "weird")
        got = {r.uid: r.source_ord for r in rows.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_analyze_many_captures(spark, tmp_path):
    for name in ("cap1", "cap2"):
        capture(tmp_path / name)
    facts = spark.createDataFrame(
        [("aa" * 32, "CN=mail", "CN=ca", "1", None, None, "RSA", 1024, None, "sha1WithRSA", True, [("dns", "mail.example.com")])],
        jobs._FACT_SCHEMA,
    )
    out = jobs.analyze_logs(
        logs.read_log_dir(spark, str(tmp_path)), built_in_pack("ietf_current"),
        F.lit("2026-09-04 12:00:00").cast("timestamp"), facts, spark.createDataFrame([("CN=ca",)], "subject string"),
    )
    sessions = {r.uid: (r.protocol, r.upgrade_state) for r in out["sessions"].collect()}
    assert sessions == {f"{c}|C1": ("smtp", "tls_established") for c in ("cap1", "cap2")}
    codes = {(r.capture_id, r.code) for r in out["findings"].where("outcome = 'negative'").collect()}
    wanted = {"TLS_NEGOTIATED_TLS10", "TLS_CIPHER_CBC", "TLS_FORWARD_SECRECY_ABSENT", "CERT_RSA_KEY_LT2048", "CERT_SIGNATURE_SHA1",
              "CERT_PUBLIC_KEY_STRENGTH_LT112"}
    assert wanted <= {code for _, code in codes} and {c for c, _ in codes} == {"cap1", "cap2"}
    posture = {r.capture_id: (r.finding_count, r.risk_score) for r in out["posture"].collect()}
    assert posture["cap1"] == posture["cap2"] and posture["cap1"][1] > 60
    window = out["windows"].first()
    assert (window.endpoint_id, window.session_count, window.protocol_role) == ("198.51.100.1:587", 2, "smtp_submission")
    assert window.dominant_tls_version == "TLSv10" and window.starttls_success_rate == 1.0
    events = out["sessions"].select("event_count").collect()
    assert {r.event_count for r in events} == {4}


def test_captures_are_picked_up_when_they_are_finished(spark, tmp_path):
    source, pack = tmp_path / "captures", built_in_pack("ietf_current")
    at = F.lit("2026-09-04 12:00:00").cast("timestamp")
    analysed = []

    def analysis(found):
        analysed.append(1)
        out = jobs.analyze_logs(found, pack, at)
        return {name: out[name] for name in ("flows", "findings", "sessions")}

    work = pickup.Pickup(spark, str(source), str(tmp_path / "out"), analysis)
    capture(source / "cap1")
    capture(source / "cap2")
    (source / "cap1" / "ready").write_text("1")
    assert work.run_all() == ["cap1"] and work.run_all() == []  # cap2 is still being written
    capture(source / "cap3")
    for name in ("cap2", "cap3"):
        (source / name / "ready").write_text("1")
    assert work.run_all() == ["cap2", "cap3"]
    lines(source / "cap1" / "email_events.log", [])  # cap1 comes again, without its events
    assert work.run_all() == ["cap1"] and len(analysed) == 3

    whole = jobs.analyze_logs(logs.read_log_dir(spark, str(source)), pack, at)
    for name in ("flows", "findings", "sessions"):
        want = whole[name]
        got = work.read(name).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    # A run that broke off before it was noted is not seen and is replaced by the next.
    work.read("flows").limit(1).write.parquet(str(tmp_path / "out" / "flows" / "run=3"))
    assert work.read("flows").count() == whole["flows"].count()


def test_frames(spark, tmp_path):
    head = ",".join(f'"{c}"' for c in logs.FRAME_FIELDS[:10])
    (tmp_path / "frames.csv").write_text(
        head + '\n"4","1.5","10.0.0.1","","10.0.0.2","","4000","25","EHLO",""\n"5","1.6","10.0.0.2","","10.0.0.1","","25","4000","",""\n'
    )
    frames = logs.read_frames(spark, str(tmp_path / "frames.csv"))
    kept = logs.frame_endpoints(logs.interesting_frames(frames)).collect()
    assert [(r["frame.number"], r.src, r.dst_port) for r in kept] == [("4", "10.0.0.1", 25)]


def test_capture_fact_sheet(spark, tmp_path):
    (tmp_path / "a.txt").write_text(
        "File name: x\nNumber of packets:   1,234\nFile timestamp precision:  microseconds (6)\n"
        "Packet size limit:   file hdr: 262144 bytes\nData size:  5,000 bytes\nCapture duration:    1.5 seconds\n"
        "First packet time:   2026-01-02 03:04:05.250000\n"
    )
    row = logs.read_capture_facts(spark, str(tmp_path / "*.txt")).first()
    assert (row.packet_count, row.packet_size_limit, row.truncated_packets_present) == (1234, 262144, False)
    assert (row.file_time_precision, row.original_packet_bytes, row.capture_duration_seconds) == ("microsecond", 5000, 1.5)
    assert str(row.capture_start_time) == "2026-01-02 03:04:05.250000"


def test_binary_files_and_content(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "ok.pcapng").write_bytes(b"\x0a\x0d\x0d\x0arest")
    (folder / "old.pcap").write_bytes(b"\xd4\xc3\xb2\xa1rest")
    (folder / "bad.pcap").write_bytes(b"nope")
    (folder / "F9.der").write_bytes(b"der")
    rows = files.read_binary(spark, str(folder))
    states = {r.path.rsplit("/", 1)[1]: r.state for r in files.check_captures(rows).collect()}
    assert states == {"ok.pcapng": "ready", "old.pcap": "ready", "bad.pcap": "bad_magic", "F9.der": "bad_extension"}
    certs = files.extracted_certificates(files.read_binary(spark, str(folder), "*.der"))
    assert certs.first().fuid == "F9"
    store = str(tmp_path / "store")
    assert files.put_content(certs, store) == 1 and files.put_content(certs, store) == 0
    assert files.damaged_content(spark.read.parquet(store)).isEmpty()
    assert files.usage(rows, 10).first().over_quota


def test_code_tables(spark, tmp_path):
    doc = {
        "cipher_suites": [{"code": "0xc02f", "name": "A"}, {"code": "0xC02F", "name": "B"}, {"code": "zz", "name": "C"}],
        "groups": [{"code": 29, "name": "x25519"}, {"code": 70000, "name": "far"}],
    }
    (tmp_path / "codes.json").write_text(json.dumps(doc))
    suites, groups = lookups.read_code_tables(spark, str(tmp_path / "codes.json"))
    assert [tuple(r) for r in suites.collect()] == [("0xC02F", "A")]
    assert [tuple(r) for r in groups.collect()] == [(29, "x25519")]


def test_catalog_and_documents(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps({"reports": [{"case_id": "a", "report": "a.json"}, {"case_id": "a", "report": "b.json"}]}))
    with pytest.raises(ValueError):
        stores.read_report_catalog(spark, str(tmp_path / "catalog.json"))
    rows = spark.createDataFrame([("c1", i) for i in range(3)] + [("c2", i) for i in range(9)], "capture_id string, uid int")
    evidence = stores.evidence_rows({"flows": rows})
    stores.write_evidence(evidence, str(tmp_path / "out"), part_records=5)
    docs = spark.read.json(str(tmp_path / "out" / "documents"))
    held = docs.select("capture_id", F.explode("records").alias("r")).groupBy("capture_id").count()
    assert {r.capture_id: r["count"] for r in held.collect()} == {"c1": 3, "c2": 9}


def test_a_capture_of_any_size_keeps_its_records(spark):
    rows = spark.range(25_000).select(F.lit("c1").alias("capture_id"), F.col("id").alias("uid"))
    docs = stores.nested_documents(stores.evidence_rows({"flows": rows})).persist()
    assert docs.count() == 3 and docs.agg(F.sum(F.size("records"))).first()[0] == 25_000
    assert docs.agg(F.max(F.size("records"))).first()[0] < 12_000


def test_cohort_job(spark, tmp_path):
    windows = cohort_windows(spark, days=45)
    windows.write.json(str(tmp_path / "windows"))
    events = [r.asDict() for r in cohort_labels(spark)["events"].where("start_day < 42").collect()]
    (tmp_path / "labels.json").write_text(
        json.dumps({"events": events, "maintenance": [], "jitter_endpoints": ["mx-noise-1"], "new_endpoints": []})
    )
    head = {"cohort_id": "c", "feature_schema_version": "other"}
    (tmp_path / "manifest.json").write_text(json.dumps(head))
    with pytest.raises(ValueError):
        stores.read_cohort(spark, str(tmp_path), jobs.FEATURE_SCHEMA)
    (tmp_path / "manifest.json").write_text(json.dumps({**head, "feature_schema_version": jobs.FEATURE_SCHEMA}))
    jobs.evaluate_ml(spark, str(tmp_path), str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out" / "evaluation")).first()
    assert row.gate_detection_delay and row.base_detected == len(events)


# --- streams ----------------------------------------------------------------------------------------


def test_upserts_are_idempotent(spark, tmp_path):
    schema = "endpoint_id string, ts timestamp, event_type string"
    for i, rows in enumerate([["view", "error"], ["view"]]):
        frame = spark.createDataFrame([("e", r) for r in rows], "endpoint_id string, event_type string")
        frame = frame.withColumn("ts", F.lit("2024-01-05 01:00:00").cast("timestamp")).select("endpoint_id", "ts", "event_type")
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))

    def stream():
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        return online.daily_windows(reader.parquet(str(tmp_path / "in")), {"handshake_failure_rate": "error"})

    path = str(tmp_path / "out")
    run.run_upserts(stream(), path)
    run.run_upserts(stream(), path)  # nothing new: nothing changes
    got = run.latest_rows(spark, path, ["endpoint_id", "day"]).collect()
    assert [(r.session_count, round(r.handshake_failure_rate, 6)) for r in got] == [(3, round(1 / 3, 6))]


def test_new_log_files_are_picked_up_once(spark, tmp_path):
    folder = tmp_path / "logs"
    lines(folder / "weird.1.log", [{"uid": "a", "name": "x"}])
    path = str(tmp_path / "out")
    run.run_upserts(run.log_stream(spark, str(folder), "weird", 1), path, "append")
    lines(folder / "weird.2.log", [{"uid": "b", "name": "y"}, {"uid": "c", "name": "z"}])
    run.run_upserts(run.log_stream(spark, str(folder), "weird", 1), path, "append")
    run.run_upserts(run.log_stream(spark, str(folder), "weird", 1), path, "append")
    assert sorted(r.uid for r in spark.read.parquet(f"{path}/rows").collect()) == ["a", "b", "c"]


def test_same_rows(spark):
    from mxposture.operators.validate import same_rows

    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert same_rows(a, a.repartition(3)) and not same_rows(a, a.distinct())


def test_names_outside_ascii_and_long_addresses(spark):
    from mxposture.functions import identity

    rows = spark.createDataFrame([("bücher.example",), ("*.exämple.com",), ("a..b",), ("x" * 64 + ".de",)], "n string")
    got = [r[0] for r in rows.select(identity.dns_name(F.col("n"))).collect()]
    assert got == ["xn--bcher-kva.example", "*.xn--exmple-cua.com", None, None]
    ips = spark.createDataFrame([("2001:DB8:0:0::1",), (" 10.0.0.1",), ("10.0.0.256",), ("::ffff:zz",)], "n string")
    assert [r[0] for r in ips.select(identity.ip_literal(F.col("n"))).collect()] == ["2001:db8::1", "10.0.0.1", None, None]
