"""Report, dashboard and validation queries over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.operators import findings as finding_ops
from mxposture.operators import reports as ops
from mxposture.operators import validate
from mxposture.operators.scale import global_position
from mxposture.plans.adapters import VIEWS, table, view
from mxposture.plans.certificate_queries import _CERTS, _PATHS, validated
from mxposture.plans.finding_queries import findings, scored
from mxposture.plans.flow_queries import built_flows
from mxposture.plans.handshake_queries import built_handshakes
from mxposture.plans.registry import query
from mxposture.plans.rule_queries import built_sessions

VIEWS["x_case_checks"] = """
SELECT *, concat('case-', CAST(CAST(record_key AS BIGINT) % 11 AS STRING)) AS case_id,
       CAST(record_key AS BIGINT) * 10 + line AS ord FROM x_checks
"""

VIEWS["y_first_protocol"] = """
SELECT f.finding_id, coalesce(least(k.m, e.m).p, 'unclassified') AS protocol, f.severity, f.basis_state, f.code, f.affected_endpoint
FROM x_findings f
LEFT JOIN (SELECT record_key, min(struct_pack(o := ord, p := protocol)) AS m FROM x_case_checks GROUP BY 1) k ON k.record_key = f.record_key
LEFT JOIN (SELECT affected_endpoint, min(struct_pack(o := ord, p := protocol)) AS m FROM x_case_checks GROUP BY 1) e
  ON e.affected_endpoint = f.affected_endpoint
"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "x_case_checks")


def with_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return ops.finding_protocols(rows, rows.select("finding_id", "record_key"), checks(spark, sf_dir))


@query("j15_finding_protocol", "SELECT finding_id, protocol FROM y_first_protocol")
def finding_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_protocol(spark, sf_dir).select("finding_id", "protocol")


@query(
    "p11_faceted_filter",
    """SELECT finding_id, code, protocol FROM y_first_protocol WHERE severity IN ('high', 'medium') AND basis_state IN ('observed', 'verified', 'inferred')
       AND contains(lower(concat_ws(' ', code, affected_endpoint, protocol)), 'rule_3 198.51.100.1')""",
)
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.filter_findings(
        with_protocol(spark, sf_dir),
        severities=["high", "medium"],
        states=["observed", "verified", "inferred"],
        search=" RULE_3 198.51.100.1 ",
        fields=["code", "affected_endpoint", "protocol"],
    )
    return out.select("finding_id", "code", "protocol")


@query("q05_protocol_list", "SELECT DISTINCT protocol FROM y_first_protocol")
def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_protocol(spark, sf_dir).select("protocol").distinct()


@query(
    "t04_dashboard_order",
    """SELECT row_number() OVER (ORDER BY score DESC, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC,
         code, finding_id) AS position, finding_id FROM y_scored""",
)
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("title", F.col("code"))
    return global_position(rows, ops.dashboard_order()).select("position", "finding_id")


# Each policy profile's run is a case of its own; checks belong to the runs by their record.
_CHECK_CASE = "CASE WHEN CAST(record_key AS BIGINT) % 2 = 0 THEN 'profile_a' ELSE 'profile_b' END"
_BY_PRIORITY = "score DESC, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, code, finding_id"


@query(
    "t07_attention_queue",
    f"""SELECT policy_profile, finding_id, score, CASE WHEN severity = 'high' OR score >= 80 THEN 1 WHEN severity = 'medium' OR score >= 50 THEN 2 ELSE 3 END AS priority
       FROM y_scored QUALIFY row_number() OVER (PARTITION BY policy_profile ORDER BY {_BY_PRIORITY}) <= 4""",
)
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("title", F.col("code"))
    return ops.attention_queue(rows, ["policy_profile"]).select("policy_profile", "finding_id", "score", "priority")


@query(
    "f48_briefing",
    f"""SELECT policy_profile, 'Review first: ' || code AS title, affected_endpoint || ' scores ' || score || ' of 100; ' ||
         failed || ' checks failed, ' || gaps || ' are open.' AS detail
       FROM y_scored JOIN (SELECT {_CHECK_CASE} AS policy_profile, count(*) FILTER (outcome = 'fail') AS failed,
         count(*) FILTER (outcome IN ('unknown', 'not_observable')) AS gaps FROM x_checks GROUP BY 1) USING (policy_profile)
       QUALIFY row_number() OVER (PARTITION BY policy_profile ORDER BY {_BY_PRIORITY}) = 1""",
)
def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("title", F.col("code"))
    checks = view(spark, sf_dir, "x_checks").withColumn("policy_profile", F.expr(_CHECK_CASE))
    counts = checks.groupBy("policy_profile").agg(*finding_ops.outcome_counts())
    return ops.briefing(rows, counts, ["policy_profile"])


VIEWS["x_references"] = """
SELECT finding_id, record_type, record_key, CASE CAST(record_key AS BIGINT) % 3 WHEN 0 THEN 'evidence_state' WHEN 1 THEN 'uid' ELSE 'no.such.field' END AS field_path
FROM x_findings
"""


@query(
    "j16_resolve_references",
    """SELECT r.finding_id, CASE WHEN t.uid IS NULL THEN 'dangling_record' WHEN field_path = 'no.such.field' THEN 'dangling_field' ELSE 'resolved' END AS status,
       CASE WHEN t.uid IS NULL THEN '' WHEN field_path = 'uid' THEN t.uid WHEN field_path = 'evidence_state' THEN t.state ELSE '' END AS field_value
       FROM x_references r LEFT JOIN (
         SELECT 'flow' AS record_type, uid, CASE WHEN quality = 'complete' THEN 'observed' ELSE quality END AS state FROM y_flows
         UNION ALL SELECT 'handshake', uid, evidence_state FROM y_handshakes
         UNION ALL SELECT 'session', uid, evidence_state FROM y_sessions) t ON t.record_type = r.record_type AND t.uid = r.record_key""",
)
def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    def record(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("uid").alias("record_key"), F.struct("uid", "evidence_state").alias("record"))

    records = {
        "flow": record(built_flows(spark, sf_dir)),
        "handshake": record(built_handshakes(spark, sf_dir)),
        "session": record(built_sessions(spark, sf_dir)),
    }
    out = ops.resolve_references(view(spark, sf_dir, "x_references"), records)
    return out.select("finding_id", "status", F.coalesce("field_value", F.lit("")).alias("field_value"))


@query(
    "j17_lineage",
    """SELECT x.finding_id, coalesce(f.uid, '') AS flow, coalesce(f.quality, '') AS flow_quality, coalesce(s.protocol, '') AS session_protocol,
       coalesce(h.version, '') AS tls_version, coalesce(h.server_certificate_state, '') AS cert_state, coalesce(c.n, 0) AS cert_count
       FROM x_findings x LEFT JOIN y_flows f ON f.uid = x.record_key LEFT JOIN y_sessions s ON s.uid = x.record_key
       LEFT JOIN y_handshakes h ON h.uid = x.record_key LEFT JOIN (SELECT uid, count(*) AS n FROM x_cert GROUP BY uid) c ON c.uid = x.record_key""",
)
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir).select("finding_id", "record_key")
    out = ops.lineage(
        rows,
        built_flows(spark, sf_dir),
        built_sessions(spark, sf_dir),
        built_handshakes(spark, sf_dir),
        view(spark, sf_dir, "x_cert"),
    )
    text = ["flow", "flow_quality", "session_protocol", "tls_version", "cert_state"]
    return out.select("finding_id", *[F.coalesce(c, F.lit("")).alias(c) for c in text], "cert_count")


@query(
    "j18_flow_views",
    """SELECT f.uid, f.resp_h || ':' || f.resp_p AS destination, CASE WHEN s.uid IS NULL THEN 'TCP' ELSE coalesce(s.protocol, 'indeterminate') END AS protocol,
       CASE WHEN h.uid IS NULL THEN 'TLS not observed' ELSE coalesce(h.version, 'TLS version unavailable') END AS tls,
       f.orig_bytes + f.resp_bytes AS bytes FROM y_flows f LEFT JOIN y_sessions s ON s.uid = f.uid LEFT JOIN y_handshakes h ON h.uid = f.uid""",
)
def flow_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.flow_views(
        built_flows(spark, sf_dir), built_sessions(spark, sf_dir), built_handshakes(spark, sf_dir)
    )
    return out.select("uid", "destination", "protocol", "tls", "bytes")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    case = F.concat(F.lit("case-"), (F.col("record_key").cast("bigint") % 13).cast("string"))
    # Findings are clustered inside their case: the profile key carries the case.
    clustered = finding_ops.prioritised_findings(
        rows.withColumn("policy_pack_version", case), view(spark, sf_dir, "x_assets")
    )
    clustered = clustered.withColumn("case_id", F.col("policy_pack_version"))
    return ops.case_summaries(clustered, checks(spark, sf_dir))


_CASES = """
WITH f AS (SELECT *, 'case-' || (CAST(record_key AS BIGINT) % 13) AS case_id,
    CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sev,
    CASE basis_state WHEN 'conflicting' THEN 0 WHEN 'incomplete' THEN 1 WHEN 'indeterminate' THEN 2 WHEN 'not_observable' THEN 3
      WHEN 'inferred' THEN 4 WHEN 'observed' THEN 5 ELSE 6 END AS bas FROM x_findings),
 c AS (SELECT case_id, affected_endpoint, coalesce(max(sev) FILTER (outcome = 'negative'), max(sev)) AS sev,
    coalesce(min(bas) FILTER (outcome = 'negative'), min(bas)) AS bas, count(DISTINCT record_type || ':' || record_key) AS occ
    FROM f GROUP BY case_id, code, affected_endpoint, policy_profile),
 s AS (SELECT c.*, least(100, [0, 15, 30, 50][sev + 1] + [3, 6, 2, 0, 12, 16, 20][bas + 1] + least(10, 2 * (occ - 1))
    + CASE exposure WHEN 'public' THEN 10 WHEN 'partner' THEN 8 WHEN 'internal' THEN 5 WHEN 'isolated' THEN 2 ELSE 4 END
    + CASE asset_criticality WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 1 ELSE 2 END
    + CASE blast_radius WHEN 'organization' THEN 5 WHEN 'multi_asset' THEN 3 ELSE 1 END) AS score
    FROM c LEFT JOIN x_assets a ON a.endpoint = c.affected_endpoint),
 g AS (SELECT case_id, count(*) AS finding_count, max(score) AS m, count(*) FILTER (sev = 3) AS high, count(*) FILTER (sev = 2) AS medium,
    count(*) FILTER (sev = 1) AS low, count(*) FILTER (sev = 0) AS informational FROM s GROUP BY 1),
 k AS (SELECT case_id, count(*) AS applicable_count, count(*) FILTER (outcome = 'unknown') AS unknown_count,
    count(*) FILTER (outcome = 'not_observable') AS not_observable_count FROM x_case_checks GROUP BY 1),
 r AS (SELECT case_id, coalesce(finding_count, 0) AS finding_count, CAST(m AS INTEGER) AS risk_score, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
    coalesce(low, 0) AS low, coalesce(informational, 0) AS informational, coalesce(unknown_count, 0) AS unknown_count,
    coalesce(not_observable_count, 0) AS not_observable_count, CASE WHEN coalesce(applicable_count, 0) = 0 THEN 'none'
      WHEN unknown_count + not_observable_count > 0 THEN 'limited' ELSE 'complete' END AS assessment_state
    FROM g FULL JOIN k USING (case_id))
"""


@query("a09_case_summaries", _CASES + "SELECT * FROM r")
def case_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).drop("applicable_count", "passed_count", "failed_count")


@query("q01_list_cases", _CASES + "SELECT case_id, risk_score FROM r WHERE assessment_state = 'none' AND contains(case_id, '1')")
def list_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.filter_cases(cases(spark, sf_dir), "none", " CASE-1")
    return out.orderBy(*ops.catalog_order()).select("case_id", "risk_score")


@query(
    "t05_catalog_order",
    _CASES
    + "SELECT row_number() OVER (ORDER BY coalesce(risk_score, -1) DESC, unknown_count + not_observable_count DESC, case_id) AS position, case_id FROM r",
)
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_position(cases(spark, sf_dir), ops.catalog_order()).select("position", "case_id")


@query(
    "a17_portfolio",
    _CASES
    + """SELECT CAST(floor(avg(risk_score) + 0.5) AS INTEGER) AS average_risk, count(*) FILTER (risk_score >= 80) AS urgent_cases,
         CAST(sum(unknown_count + not_observable_count) AS BIGINT) AS unresolved FROM r""",
)
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.portfolio(cases(spark, sf_dir))


@query("q02_one_case", _CASES + "SELECT case_id, finding_count, assessment_state FROM r WHERE case_id = 'case-5'")
def one_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The id is pushed into both inputs, so only one case is aggregated.
    rows = findings(spark, sf_dir)
    case = F.concat(F.lit("case-"), (F.col("record_key").cast("bigint") % 13).cast("string"))
    mine = rows.withColumn("policy_pack_version", case).where(F.col("policy_pack_version") == "case-5")
    clustered = finding_ops.score(finding_ops.with_assets(finding_ops.cluster_facts(mine), None))
    clustered = clustered.withColumn("case_id", F.col("policy_pack_version"))
    mine_checks = checks(spark, sf_dir).where("case_id = 'case-5'")
    return ops.case_summaries(clustered, mine_checks).select("case_id", "finding_count", "assessment_state")


_LIMITS = """
SELECT capture_no, count(*) FILTER (quality = 'incomplete') AS incomplete_flow_count, count(*) FILTER (quality = 'conflicting') AS conflicting_flow_count,
  count(*) FILTER (h.server_certificate_state = 'not_observable') AS not_observable_certificate_count, bool_or(truncated) AS truncated
FROM (SELECT uid, capture_no, quality, truncated FROM y_flows) f LEFT JOIN (SELECT uid, server_certificate_state FROM y_handshakes) h ON h.uid = f.uid GROUP BY 1
"""


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = built_flows(spark, sf_dir)
    tls = built_handshakes(spark, sf_dir).join(flows.select("uid", "capture_no"), "uid")
    return ops.limitations(flows, tls, ["capture_no"])


@query(
    "a10_limitations",
    f"""SELECT capture_no, incomplete_flow_count, conflicting_flow_count, not_observable_certificate_count, truncated AS truncated_packets_present,
        concat_ws('|', CASE WHEN truncated THEN 'Packets were cut short in this capture, so streams may have holes.' END,
          CASE WHEN incomplete_flow_count > 0 THEN 'Flows with missing bytes: ' || incomplete_flow_count || '.' END,
          CASE WHEN conflicting_flow_count > 0 THEN 'Flows whose copies disagree: ' || conflicting_flow_count || '.' END,
          CASE WHEN not_observable_certificate_count > 0 THEN 'Handshakes whose certificate could not be seen: ' || not_observable_certificate_count || '.' END) AS notes
        FROM ({_LIMITS})""",
)
def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limits(spark, sf_dir).withColumn("notes", F.array_join("notes", "|"))


@query(
    "a15_evidence_tiles",
    """SELECT count(*) AS flows, count(*) FILTER (quality = 'complete') AS complete, CAST(sum(orig_bytes + resp_bytes) AS BIGINT) AS observed_bytes,
       CAST(sum(gap_bytes + missed_bytes) AS BIGINT) AS missing_bytes,
       (SELECT count(*) FROM y_sessions) AS sessions, (SELECT count(protocol) FROM y_sessions) AS identified,
       (SELECT count(DISTINCT protocol) FROM y_sessions) AS protocols, (SELECT count(*) FILTER (upgrade_state = 'tls_established') FROM y_sessions) AS upgraded,
       (SELECT count(*) FROM y_handshakes) AS handshakes, (SELECT count(*) FILTER (established) FROM y_handshakes) AS established,
       (SELECT count(*) FILTER (visibility = 'full') FROM y_handshakes) AS full_visibility, (SELECT count(DISTINCT version) FROM y_handshakes) AS versions
       FROM y_flows""",
)
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.operators.evaluate import one_row

    row = one_row(
        ops.flow_tiles(built_flows(spark, sf_dir)),
        ops.session_tiles(built_sessions(spark, sf_dir)).drop("upgrade_issues"),
        ops.handshake_tiles(built_handshakes(spark, sf_dir)),
    )
    return row


@query(
    "a13_certificate_posture",
    """SELECT count(*) AS observed, count(*) FILTER (then_ok) AS valid_at_capture, count(*) FILTER (NOT then_ok) AS expired_at_capture FROM (
       SELECT CASE WHEN syntax_valid AND NOT truncated THEN not_after >= capture_time END AS then_ok FROM x_cert_dated)""",
)
def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.certificate_posture(validated(spark, sf_dir)).select(
        "observed", "valid_at_capture", "expired_at_capture"
    )


@query(
    "a16_readiness",
    """SELECT (SELECT CAST(floor((count(*) - count(*) FILTER (severity = 'high')) / count(*) * 100 + 0.5) AS INTEGER) FROM y_scored) AS finding_clearance,
       (SELECT CAST(floor(count(*) FILTER (outcome = 'pass') / count(*) * 100 + 0.5) AS INTEGER) FROM x_checks) AS verified_controls,
       (SELECT CAST(floor((count(*) - count(*) FILTER (coalesce(upgrade_state, '') IN ('violation', 'plaintext_fallback'))) / count(*) * 100 + 0.5) AS INTEGER) FROM y_sessions) AS secure_upgrades""",
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.operators.evaluate import one_row

    rows = finding_ops.cluster_facts(findings(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "high").alias("high")
    )
    counts = view(spark, sf_dir, "x_checks").agg(*finding_ops.outcome_counts())
    sessions = ops.session_tiles(built_sessions(spark, sf_dir))
    return one_row(
        rows.select(ops.ratio(F.col("n") - F.col("high"), F.col("n")).alias("finding_clearance")),
        finding_ops.coverage_percent(counts).select(F.col("coverage_percent").alias("verified_controls")),
        sessions.select(
            ops.ratio(F.col("sessions") - F.col("upgrade_issues"), F.col("sessions")).alias("secure_upgrades")
        ),
    )


@query(
    "a19_row_states",
    """SELECT 'flow' AS kind, CASE WHEN quality = 'conflicting' THEN 'attention' WHEN quality <> 'complete' OR gap_bytes > 0 OR missed_bytes > 0 THEN 'limited' ELSE 'clear' END AS state,
         count(*) AS n FROM y_flows GROUP BY 2
       UNION ALL SELECT 'handshake', CASE WHEN NOT established OR coalesce(version, '') IN ('TLSv10', 'TLSv11') THEN 'attention'
         WHEN visibility <> 'full' OR evidence_state IN ('incomplete', 'conflicting') THEN 'limited' WHEN version IS NULL THEN 'unknown' ELSE 'clear' END, count(*) FROM y_handshakes GROUP BY 2
       UNION ALL SELECT 'session', CASE WHEN coalesce(upgrade_state, '') IN ('violation', 'plaintext_fallback') THEN 'attention' WHEN evidence_state = 'indeterminate' OR coalesce(upgrade_state, '') <> 'tls_established' THEN 'limited' ELSE 'clear' END,
         count(*) FROM y_sessions GROUP BY 2""",
)
def row_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ops.row_states("flow", built_flows(spark, sf_dir))
        .unionByName(ops.row_states("handshake", built_handshakes(spark, sf_dir)))
        .unionByName(ops.row_states("session", built_sessions(spark, sf_dir)))
    )


@query(
    "a19_certificate_states",
    f"""WITH paths AS ({_PATHS.strip()}), ref AS (SELECT uid, min(host) AS host FROM x_host GROUP BY uid),
       hit AS (SELECT r.uid, coalesce(bool_or(c.san = r.host OR (starts_with(c.san, '*.') AND contains(r.host, '.')
                 AND substr(c.san, 3) = regexp_replace(r.host, '^[^.]*\\.', ''))), false) AS hit
               FROM ref r LEFT JOIN x_cert_dated c ON c.uid = r.uid AND c.chain_index = 0 AND c.syntax_valid AND NOT c.truncated GROUP BY r.uid)
       SELECT 'certificate' AS kind, CASE WHEN NOT good OR NOT then_ok OR (c.chain_index = 0 AND (NOT p.path_valid OR (h.uid IS NOT NULL AND NOT h.hit)))
         THEN 'attention' ELSE 'clear' END AS state, count(*) AS n
       FROM ({_CERTS}) c LEFT JOIN paths p ON c.cert_no = p.cert_no LEFT JOIN hit h ON c.uid = h.uid GROUP BY 2""",
)
def certificate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.row_states("certificate", validated(spark, sf_dir))


@query(
    "a11_protocol_inventory",
    "SELECT coalesce(protocol, 'unclassified') AS protocol, count(*) AS sessions FROM y_sessions GROUP BY 1",
)
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce("protocol", F.lit("unclassified")).alias("protocol")
    return built_sessions(spark, sf_dir).groupBy(label).agg(F.count(F.lit(1)).alias("sessions"))


@query(
    "t08_text_observations",
    """SELECT case_no, uid, ord, text FROM (SELECT CAST(uid AS BIGINT) % 97 AS case_no, uid, ord, text FROM x_dialogue WHERE length(text) > 0)
       QUALIFY row_number() OVER (PARTITION BY case_no ORDER BY uid, ord) <= 8""",
)
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "x_dialogue").withColumn("case_no", F.col("uid").cast("bigint") % 97)
    return ops.observations(events, ["case_no"]).select("case_no", "uid", "ord", "text")


# --- validation ---------------------------------------------------------------------------------------


@query(
    "v01_unreconciled_coverage",
    """SELECT protocol, category FROM y_coverage WHERE passed_count + CASE WHEN protocol = 'imap' THEN 1 ELSE 0 END + failed_count
       + unknown_count + not_observable_count <> applicable_count""",
)
def unreconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = finding_ops.coverage(view(spark, sf_dir, "x_checks"))
    damaged = counts.withColumn(
        "passed_count", F.col("passed_count") + F.when(F.col("protocol") == "imap", 1).otherwise(0)
    )
    return validate.unreconciled_coverage(damaged).select("protocol", "category")


@query(
    "v02_header_mismatches",
    f"""WITH l AS ({_LIMITS}) SELECT capture_no, 'incomplete_flow_count' AS field FROM l WHERE capture_no % 2 = 0
        UNION ALL SELECT capture_no, 'conflicting_flow_count' FROM l WHERE capture_no = 3""",
)
def header_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _limits(spark, sf_dir)
    stated = found.withColumn(
        "incomplete_flow_count",
        F.col("incomplete_flow_count") + F.when(F.col("capture_no") % 2 == 0, 1).otherwise(0),
    ).withColumn(
        "conflicting_flow_count",
        F.when(F.col("capture_no") != 3, F.col("conflicting_flow_count")),
    )
    fields = ["incomplete_flow_count", "conflicting_flow_count", "not_observable_certificate_count"]
    return validate.mismatches(stated, found, "capture_no", fields).select("capture_no", "field")


CASES = 40
_FIELDS = [name for name, _, _ in validate.REPORT_EQUALITIES]


def _reports(counted: DataFrame) -> DataFrame:
    """A report per case whose header follows its records, but for one field in the first 17 cases."""
    case = F.col("case_no")

    def damaged(name: str, value):
        kind = "boolean" if name == "truncated_packets_present" else "number" if name.endswith(("count", "score")) else "text"
        other = {"boolean": lambda: ~value, "number": lambda: value + 1, "text": lambda: F.concat(value, F.lit("-other"))}[kind]()
        return F.when(case == _FIELDS.index(name), other).otherwise(value).alias(name)

    def text(name: str):
        return F.concat(F.lit(name + "-"), case.cast("string"))

    run_names = ["configuration_digest", "analyzer_bundle_digest", "policy_profile", "policy_pack_version", "trust_store_digest"]
    run = [F.sha2(case.cast("string"), 256).alias("capture_sha256"), *[text(n).alias(n) for n in run_names]]
    state, risk, cut = text("state"), case * 7 % 101, case % 3 == 0
    number = {
        "finding_count": "findings", "unknown_count": "unknown_checks", "not_observable_count": "unseen_checks",
        "incomplete_flow_count": "incomplete_flows", "conflicting_flow_count": "conflicting_flows",
        "not_observable_certificate_count": "unseen_certificates", "unknown_check_count": "unknown_checks",
        "not_observable_check_count": "unseen_checks",
    }
    stated = {n: F.col(f"counted.{c}") for n, c in number.items()}
    stated |= {"source_capture_sha256": F.sha2(case.cast("string"), 256), **{n: text(n) for n in run_names}}
    stated |= {"assessment_state": state, "risk_score": risk, "truncated_packets_present": cut}
    parts = {"manifest": _FIELDS[:6], "summary": _FIELDS[6:11], "limitations": _FIELDS[11:]}
    return counted.select(
        "case_no",
        F.struct(*run).alias("run"),
        F.struct(state.alias("assessment_state"), risk.alias("risk_score")).alias("posture"),
        F.struct(cut.alias("truncated_packets_present")).alias("preflight"),
        *[F.struct(*[damaged(n, stated[n]) for n in names]).alias(part) for part, names in parts.items()],
    )


_COUNT_SQL = {
    8: "findings", 9: "unknown_checks", 10: "unseen_checks", 12: "incomplete_flows", 13: "conflicting_flows",
    14: "unseen_certificates", 15: "unknown_checks", 16: "unseen_checks",
}
_TEXT_SQL = "CASE case_no WHEN 0 THEN sha256('0') " + " ".join(
    f"WHEN {i} THEN '{'state' if _FIELDS[i] == 'assessment_state' else _FIELDS[i]}-{i}'" for i in range(1, 7)
) + " END"
_NUMBER_SQL = "CASE case_no WHEN 7 THEN 49 " + " ".join(f"WHEN {i} THEN {c}" for i, c in _COUNT_SQL.items()) + " END"
_RECORDS_SQL = f"""SELECT CAST(uid AS BIGINT) % {CASES} AS case_no, 'flow' AS k, quality AS s FROM y_flows
  UNION ALL SELECT CAST(uid AS BIGINT) % {CASES}, 'handshake', server_certificate_state FROM y_handshakes
  UNION ALL SELECT CAST(record_key AS BIGINT) % {CASES}, 'finding', NULL FROM x_findings
  UNION ALL SELECT CAST(record_key AS BIGINT) % {CASES}, 'check', outcome FROM x_checks"""


@query(
    "v02_report_equalities",
    f"""WITH c AS (SELECT case_no, count(*) FILTER (k = 'finding') AS findings, count(*) FILTER (k = 'check' AND s = 'unknown') AS unknown_checks,
          count(*) FILTER (k = 'check' AND s = 'not_observable') AS unseen_checks, count(*) FILTER (k = 'flow' AND s = 'incomplete') AS incomplete_flows,
          count(*) FILTER (k = 'flow' AND s = 'conflicting') AS conflicting_flows, count(*) FILTER (k = 'handshake' AND s = 'not_observable') AS unseen_certificates
        FROM ({_RECORDS_SQL}) GROUP BY 1)
        SELECT case_no, CASE case_no {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FIELDS))} END AS field,
          CASE WHEN case_no < 7 THEN {_TEXT_SQL} || '-other' WHEN case_no = 11 THEN 'true' ELSE CAST({_NUMBER_SQL} + 1 AS VARCHAR) END AS stated,
          CASE WHEN case_no < 7 THEN {_TEXT_SQL} WHEN case_no = 11 THEN 'false' ELSE CAST({_NUMBER_SQL} AS VARCHAR) END AS found
        FROM c WHERE case_no < {len(_FIELDS)}""",
)
def report_equalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def cased(rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("case_no", F.col(key).cast("bigint") % CASES)

    counted = validate.evidence_counts(
        "case_no",
        cased(built_flows(spark, sf_dir), "uid"),
        cased(built_handshakes(spark, sf_dir), "uid"),
        cased(view(spark, sf_dir, "x_findings"), "record_key"),
        cased(view(spark, sf_dir, "x_checks"), "record_key"),
    )
    return validate.report_violations(_reports(counted), counted, "case_no")


@query(
    "v03_presence_rules",
    """SELECT uid, 'flagged' AS rule FROM (SELECT uid, CAST(uid AS BIGINT) % 5 <> 0 AS flagged, reason <> '' AS has FROM y_flows) WHERE flagged <> has""",
)
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = built_flows(spark, sf_dir).withColumn("flagged", F.col("uid").cast("bigint") % 5 != 0)
    out = validate.presence_violations(rows, {"flagged": F.col("reason_code").isNotNull()})
    return out.select("uid", "rule")


@query(
    "v05_document_diff",
    """SELECT o_orderkey AS id, 'head.price' AS path, 'changed' AS kind FROM orders WHERE o_orderkey % 10 = 0
       UNION ALL SELECT o_orderkey, 'tags[1]', 'missing' FROM orders WHERE o_orderkey % 15 = 0
       UNION ALL SELECT o_orderkey, 'tags#', 'length' FROM orders WHERE o_orderkey % 15 = 0""",
)
def document_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def documents(price, tags) -> DataFrame:
        head = F.struct(price.alias("price"), F.col("o_orderstatus").alias("status"))
        return orders.select(key.alias("id"), head.alias("head"), tags.alias("tags"))

    price = F.floor("o_totalprice")
    pair = F.array(F.col("o_orderpriority"), F.lit("x"))
    left = documents(price, pair)
    right = documents(
        price + F.when(key % 10 == 0, 1).otherwise(0),
        F.when(key % 15 == 0, F.array(F.col("o_orderpriority"))).otherwise(pair),
    )
    return validate.document_diff(left, right, ["id"]).select("id", "path", "kind")


@query(
    "s12_duplicate_cases",
    "SELECT record_key, count(*) AS times FROM x_findings GROUP BY 1 HAVING count(*) > 1",
)
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_keys(view(spark, sf_dir, "x_findings"), ["record_key"])
