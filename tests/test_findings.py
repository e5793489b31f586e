"""Clusters, scores, coverage and posture on small inputs with known results."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from mxposture.operators import findings as ops
from mxposture.plans.jobs import score_requests

SCHEMA = (
    "finding_id string, code string, affected_endpoint string, policy_profile string, policy_pack_version string, "
    "outcome string, severity string, basis_state string, title string, record_type string, record_key string"
)


def row(n, code="C", endpoint="h:25", outcome="negative", severity="high", basis="observed", key=None):
    return (f"{n:064x}", code, endpoint, "p", "v", outcome, severity, basis, f"t{n}", "session", key or f"u{n}")


ROWS = [
    row(3, severity="low", basis="verified"),
    row(1, severity="medium", basis="inferred"),
    row(2, outcome="indeterminate", severity="high", basis="conflicting"),
    row(4, severity="low", basis="verified", key="u3"),
    row(5, code="D", outcome="indeterminate", severity="informational", basis="incomplete"),
]


def member_id(cluster, members):
    hashes = [hashlib.sha256(m.encode()).hexdigest() for m in members]
    sums = [str(sum(int(h[12 * i : 12 * i + 12], 16) for h in hashes)) for i in range(4)]
    key = [cluster.code, cluster.affected_endpoint, cluster.policy_profile, cluster.policy_pack_version]
    return hashlib.sha256("|".join(["endpoint", *key, str(len(members)), *sums]).encode()).hexdigest()


def test_cluster_fields_and_id(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.code: r for r in ops.cluster_findings(rows, ["title"]).collect()}
    c = got["C"]
    # Negative members decide severity and basis; the text is that of the smallest negative id.
    assert (c.outcome, c.severity, c.basis_state, c.title) == ("negative", "medium", "inferred", "t1")
    assert (c.recurrence_count, c.unique_occurrences) == (4, 3)
    assert c.finding_id == member_id(c, [r[0] for r in ROWS if r[1] == "C"])
    assert (got["D"].outcome, got["D"].basis_state) == ("indeterminate", "incomplete")


def test_order_does_not_matter(spark):
    shuffled = ROWS[:]
    random.Random(1).shuffle(shuffled)
    a = ops.cluster_findings(spark.createDataFrame(ROWS, SCHEMA), ["title"])
    b = ops.cluster_findings(spark.createDataFrame(shuffled, SCHEMA).repartition(5), ["title"])
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())


def test_ids_do_not_change_kind_with_size(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    ids = {r.code: r.finding_id for r in ops.cluster_findings(rows.repartition(4)).collect()}
    fewer = ops.cluster_findings(rows.where(F.col("title") != "t4"))
    assert {r.code: r.finding_id for r in fewer.collect()}["C"] != ids["C"]
    base = rows.where("code = 'C'").limit(1).drop("finding_id")
    many = spark.range(5000).select(F.concat(F.lit("m"), "id").alias("finding_id")).crossJoin(base).select(rows.columns)
    got = ops.cluster_findings(many).collect()
    assert len(got) == 1 and got[0].recurrence_count == 5000 and got[0].finding_id == member_id(many.collect()[0], [f"m{i}" for i in range(5000)])


def test_score_parts_and_cap(spark):
    cluster = spark.createDataFrame(
        [("high", "verified", "public", "critical", "organization", 9), ("low", "not_observable", "unknown", "unknown", "unknown", 1)],
        "severity string, basis_state string, exposure string, asset_criticality string, blast_radius string, unique_occurrences bigint",
    )
    assert [r.score for r in ops.score(cluster).collect()] == [100, 15 + 0 + 4 + 0 + 2 + 1]


def test_merged_references_keep_the_first_in_order(spark):
    refs = spark.createDataFrame(
        [("c", "session", f"u{n % 40:03d}", "p", "observed", None) for n in range(400)],
        "code string, record_type string, record_key string, field_path string, evidence_state string, frame_number int",
    )
    kept = ops.merged_references(refs, ["code"], limit=25).orderBy("position").collect()
    assert [r.record_key for r in kept] == [f"u{n:03d}" for n in range(25)]


def test_coverage_cells_add_up(spark):
    checks = spark.createDataFrame(
        [("smtp", "transport", "pass"), ("smtp", "certificate", "fail"), ("imap", "transport", "unknown")],
        "protocol string, category string, outcome string",
    )
    got = {(r.protocol, r.category): r.applicable_count for r in ops.coverage(checks).collect()}
    assert got[("*", "*")] == 3 and got[("smtp", "*")] == 2 and got[("*", "transport")] == 2
    assert len(got) == 1 + 2 + 2 + 3


def request(findings, checks):
    return {
        "findings": [
            {
                "finding_id": f"{i:064x}", "code": code, "outcome": "negative", "title": code, "severity": severity,
                "basis_state": "observed", "policy_profile": "p", "policy_pack_version": "v",
                "affected_endpoint": endpoint,
                "evidence_references": [
                    {"record_type": "session", "record_key": key, "field_path": "session.protocol", "evidence_state": "observed"}
                ],
            }
            for i, (code, severity, endpoint, key) in enumerate(findings)
        ],
        "policy_checks": [
            {"check_id": str(i), "code": "C", "category": "transport", "protocol": "smtp", "affected_endpoint": "h:25",
             "record_type": "flow", "record_key": "u", "outcome": outcome, "evidence_state": "observed"}
            for i, outcome in enumerate(checks)
        ],
        "asset_context": [
            {"endpoint": "h:25", "exposure": "public", "asset_criticality": "high", "blast_radius": "organization"}
        ],
    }


def test_score_requests_stay_apart(spark, tmp_path):
    docs = {
        "recurring": request([("A", "low", "x:1", f"u{i}") for i in range(3)], []),
        "clean": request([], ["pass", "pass"]),
        "gaps": request([], ["pass"] * 3 + ["fail"] + ["unknown"] * 3 + ["not_observable"] * 2),
        "mixed": request([("A", "high", "h:25", "u1"), ("B", "low", "x:1", "u2")], ["pass", "fail"]),
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    scored, coverage, posture = score_requests(spark, str(tmp_path))
    got = {r.request: (r.assessment_state, r.risk_score, r.finding_count, r.applicable_count) for r in posture.collect()}
    assert got == {
        "recurring": ("none", 15 + 16 + 4 + 4 + 2 + 1, 1, 0),
        "clean": ("complete", 0, 0, 2),
        "gaps": ("limited", None, 0, 9),
        "mixed": ("complete", 50 + 16 + 10 + 0 + 4 + 5, 2, 2),
    }
    assert coverage.where("request = 'gaps' AND protocol = '*' AND category = '*'").first().not_observable_count == 2
    assert scored.where("request = 'mixed'").orderBy(*ops.priority_order()).first().code == "A"
