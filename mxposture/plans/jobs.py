"""The four jobs a user runs: analyze, score, report, evaluate-ml.

usage: spark-submit mxposture/plans/jobs.py analyze LOG_DIR OUT_DIR [profile]
       spark-submit mxposture/plans/jobs.py score REQUEST_PATH OUT_DIR
       spark-submit mxposture/plans/jobs.py report ANALYSIS_DIR OUT_DIR
       spark-submit mxposture/plans/jobs.py evaluate-ml COHORT_DIR OUT_DIR
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.functions import coerce
from mxposture.operators import certificates as cert_ops
from mxposture.operators import detect, evaluate
from mxposture.operators import findings as finding_ops
from mxposture.operators import flows as flow_ops
from mxposture.operators import handshakes as hs_ops
from mxposture.operators import reports as report_ops
from mxposture.operators import rules as rule_ops
from mxposture.operators import sessions as session_ops
from mxposture.operators import windows as window_ops
from mxposture.session import checkpointed, get_session
from mxposture.sources import logs as log_source
from mxposture.sources import stores
from mxposture.sources.rulepacks import RulePack, built_in_pack

FEATURE_SCHEMA = "mxposture.windows/v1"


def _scoped(rows: DataFrame) -> DataFrame:
    """``capture_id`` from the capture folder, and uids that cannot meet across captures."""
    capture = F.element_at(F.split("source_file", "/"), -2)
    rows = rows.withColumn("capture_id", capture).drop("source_file")
    if "uid" in rows.columns:
        rows = rows.withColumn("uid", F.concat_ws("|", "capture_id", "uid"))
    return rows


def analyze_logs(
    logs: dict[str, DataFrame],
    pack: RulePack,
    analysis_time: Column,
    cert_facts: DataFrame | None = None,
    anchors: DataFrame | None = None,
    preflight: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Evidence tables, findings, checks and endpoint windows of any number of captures.

    ``preflight``: capture_id, truncated_packets_present, capture_start_time; ``cert_facts``: one
    row of parsed facts per der_sha256; ``anchors``: trusted subjects. The four evidence tables are
    materialised once in the checkpoint folder: every later step reads them from there.
    """
    logs = {name: _scoped(rows) for name, rows in logs.items()}
    conn = coerce.well_formed_connection(logs["conn"])
    facts = logs["capture_loss"].groupBy("capture_id").agg(F.sum("gaps").alias("loss_gaps"))
    captures = conn.select("capture_id").distinct().join(facts, "capture_id", "left")
    if preflight is not None:
        captures = captures.join(
            preflight.select(
                "capture_id",
                F.col("truncated_packets_present").alias("truncated"),
                "capture_start_time",
            ),
            "capture_id",
            "left",
        )
    else:
        captures = captures.withColumns(
            {"truncated": F.lit(False), "capture_start_time": F.lit(None).cast("timestamp")}
        )
    recon = logs["tcp_recon"]
    flows = checkpointed(
        flow_ops.build_flows(conn, recon, F.col("source_ord"), captures, "capture_id")
    )
    ssl = logs["ssl"]
    handshakes = checkpointed(hs_ops.build_handshakes(ssl, flows))
    last_tls = hs_ops.last_per_uid(
        ssl.withColumn(
            "client_hello", F.coalesce(F.col("ssl_history").contains("C"), F.lit(False))
        ),
        ["source_ord"],
        ["client_hello", "next_protocol", "server_name"],
    )
    events = (
        logs["email_events"]
        .withColumnsRenamed({"event_type": "kind", "source_ord": "ord"})
        .withColumns({"tag": F.lit(None).cast("string"), "client_hello": F.lit(False)})
    )
    events = session_ops.drop_repeated_capabilities(
        session_ops.clean_events(events, flows), ["ord"]
    )
    sessions = checkpointed(session_ops.build_sessions(flows, events, tls_facts=last_tls))
    certificates = checkpointed(
        _certificates(logs, ssl, last_tls, cert_facts, anchors, analysis_time)
    )
    words = rule_ops.observed_commands(events, rule_ops.pack_words(pack))
    flow_facts = flows.select("uid", F.col("capture_id").alias("_capture"), "capture_start_time")
    structs = (
        rule_ops.flow_struct(flows),
        rule_ops.session_struct(sessions, words),
        rule_ops.handshake_struct(handshakes.withColumnRenamed("source_ord", "ord")),
        rule_ops.certificate_struct(certificates),
    )
    found, seen = None, None
    for target in dict.fromkeys(r.target for r in pack.rules):
        context = rule_ops.contexts(target, pack, *structs).join(flow_facts, "uid", "left")
        clock = rule_ops.evaluation_clock(pack, analysis_time, F.col("capture_start_time"))
        context = context.withColumn("_clock", clock)
        judged = rule_ops.evaluate(context, pack, target, F.col("_clock"))
        capture = F.coalesce(F.col("_capture"), F.element_at(F.split("uid", r"\|"), 1))
        f = rule_ops.findings(judged, pack, target, capture, F.col("_clock"))
        c = rule_ops.checks(judged, pack, target, capture)
        found = f if found is None else found.unionByName(f)
        seen = c if seen is None else seen.unionByName(c)
    by_capture = F.element_at(F.split("record_key", r"\|"), 1)
    found = checkpointed(found.withColumn("capture_id", by_capture))
    seen = checkpointed(seen.withColumn("capture_id", by_capture))
    scored = finding_ops.prioritised_findings(found, None, ["title"], ["capture_id"])
    windows = window_ops.endpoint_rollup(
        sessions.select("uid", "protocol", "upgrade_state", F.col("first_ord").alias("ord")),
        flows,
        hs_ops.last_per_uid(
            handshakes,
            ["source_ord"],
            ["established", "last_alert", "server_certificate_state", "version", "fs_outcome"],
        ),
        cert_ops.leaf_per_uid(certificates).select("uid", "issuer"),
    )
    return {
        "flows": flows,
        "sessions": sessions,
        "handshakes": handshakes,
        "certificates": certificates,
        "findings": found,
        "policy_checks": seen,
        "scored": scored,
        "posture": finding_ops.posture(scored, seen, ["capture_id"]),
        "windows": windows,
    }


_FACT_SCHEMA = (
    "der_sha256 string, subject string, issuer string, serial_number string, not_before timestamp, "
    "not_after timestamp, public_key_algorithm string, public_key_size bigint, public_key_curve string, "
    "signature_algorithm string, syntax_valid boolean, san array<struct<kind:string,value:string>>"
)


def _certificates(logs, ssl, last_tls, cert_facts, anchors, analysis_time) -> DataFrame:
    """Certificate records of the server and client chains, with validation where facts allow."""
    spark = ssl.sparkSession
    facts = cert_facts if cert_facts is not None else spark.createDataFrame([], _FACT_SCHEMA)
    rows = cert_ops.fingerprint_rows(ssl)
    known = logs["cert_files"].where(F.col("sha256").isNotNull()).select(
        F.lower("sha256").alias("sha256"), F.lower("sha1").alias("sha1"), "fuid"
    )
    places = cert_ops.match_fingerprints(rows, known)
    bare = ssl.where(
        (F.coalesce(F.size("cert_chain_fps"), F.lit(0)) <= 0) & F.col("ssl_history").rlike("[xX]")
    )
    files = logs["cert_files"].withColumnRenamed("source_ord", "ord")
    extra = cert_ops.match_files(bare, files, known)
    places = places.withColumn("truncated", F.lit(False)).unionByName(extra, allowMissingColumns=True)
    seen = ssl.groupBy("uid").agg(F.max("ts").alias("_ts"))
    places = places.join(seen, "uid", "left").withColumn(
        "capture_time", F.timestamp_micros((F.col("_ts") * 1_000_000).cast("bigint"))
    )
    certs = checkpointed(cert_ops.assemble(places.drop("_ts"), facts, analysis_time))
    if anchors is None:
        return certs
    leaf = certs.where("chain_index = 0 AND role = 'server' AND syntax_valid")
    sans = leaf.select("uid", F.explode("san").alias("s")).select("uid", "s.*")
    names = cert_ops.match_identity(
        last_tls.select("uid", F.col("server_name").alias("reference")), sans
    )
    return cert_ops.attach_validation(
        certs,
        cert_ops.validate_paths(certs, anchors, F.col("capture_time")),
        cert_ops.validate_paths(certs, anchors, analysis_time),
        names,
    )


def analyze(spark: SparkSession, log_dir: str, out: str, profile: str = "ietf_current") -> None:
    tables = analyze_logs(
        log_source.read_log_dir(spark, log_dir), built_in_pack(profile), F.current_timestamp()
    )
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{out}/{name}")


def score_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prioritised findings, coverage and posture of every request document."""
    request = stores.read_score_requests(spark, path)
    rows = finding_ops.with_first_reference(request["findings"])
    scored = finding_ops.prioritised_findings(rows, request["assets"], ["title"], ["request"])
    return (
        scored,
        finding_ops.coverage(request["checks"], ["request"]),
        finding_ops.posture(scored, request["checks"], ["request"]),
    )


def score(spark: SparkSession, path: str, out: str) -> None:
    scored, coverage, posture = score_requests(spark, path)
    for name, rows in (("scored", scored), ("coverage", coverage), ("posture", posture)):
        rows.write.mode("overwrite").json(f"{out}/{name}")


def report(spark: SparkSession, analysis: str, out: str) -> None:
    scored = spark.read.parquet(f"{analysis}/scored").withColumnRenamed("capture_id", "case_id")
    checks = spark.read.parquet(f"{analysis}/policy_checks").withColumnRenamed("capture_id", "case_id")
    cases = report_ops.case_summaries(scored, checks)
    cases.write.mode("overwrite").json(f"{out}/cases")
    report_ops.portfolio(cases).write.mode("overwrite").json(f"{out}/portfolio")


def evaluate_ml(spark: SparkSession, cohort: str, out: str) -> bool:
    """Compare both detectors on a labelled cohort; true when every gate holds."""
    parts = stores.read_cohort(spark, cohort, FEATURE_SCHEMA)
    windows = parts.pop("windows")
    row = evaluate.compare(
        windows, parts, detect.Baseline().score(windows), detect.Forest().score(windows)
    )
    row.write.mode("overwrite").json(f"{out}/evaluation")
    result = spark.read.json(f"{out}/evaluation").first().asDict()
    return all(value for name, value in result.items() if name.startswith("gate_"))


def main(argv: list[str]) -> int:
    if len(argv) < 3 or argv[0] not in ("analyze", "score", "report", "evaluate-ml"):
        print(__doc__)
        return 2
    spark = get_session(f"mxposture-{argv[0]}")
    if argv[0] == "analyze":
        analyze(spark, *argv[1:4])
    elif argv[0] == "score":
        score(spark, argv[1], argv[2])
    elif argv[0] == "report":
        report(spark, argv[1], argv[2])
    elif not evaluate_ml(spark, argv[1], argv[2]):
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
