"""Rule-engine queries over the adapter views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.functions.states import conjunction, predicate, state_from_rank
from mxposture.operators import findings as finding_ops
from mxposture.operators import rules as ops
from mxposture.operators import sessions as session_ops
from mxposture.plans.adapters import VIEWS, view
from mxposture.plans.certificate_queries import certificates, validated
from mxposture.plans.flow_queries import built_flows
from mxposture.plans.handshake_queries import built_handshakes
from mxposture.plans.registry import query
from mxposture.sources.rulepacks import PROFILES, Predicate, Rule, RulePack, built_in_pack

CLOCK = "2026-09-01 00:00:00"


def clock():
    return F.lit(CLOCK).cast("timestamp")


def built_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the longer dialogues, with the TLS facts of the same connection."""
    facts = view(spark, sf_dir, "x_ssl").select(
        "uid",
        (F.col("uid").cast("bigint") % 4 == 0).alias("client_hello"),
        F.lit(None).cast("string").alias("next_protocol"),
    )
    sessions = session_ops.build_sessions(
        view(spark, sf_dir, "x_conn"), view(spark, sf_dir, "x_dialogue"), tls_facts=facts
    )
    return sessions


VIEWS["y_sessions"] = """
SELECT c.uid, CASE WHEN e.uid IS NULL THEN NULL ELSE e.protocol END AS protocol,
  CASE WHEN e.uid IS NULL THEN 'indeterminate' ELSE 'observed' END AS evidence_state,
  CASE WHEN u.state = '' THEN NULL ELSE u.state END AS upgrade_state,
  CASE WHEN coalesce(u.state, '') = '' THEN 'not_observable' ELSE 'observed' END AS upgrade_evidence_state,
  e.commands, c.resp_p, c.resp_h
FROM x_conn c LEFT JOIN (SELECT uid, min(protocol) AS protocol,
   list_filter(list(DISTINCT upper(command)), lambda x: x IN ('LOGIN', 'PASS')) AS commands FROM x_dialogue GROUP BY uid) e ON c.uid = e.uid
LEFT JOIN y_dialogue_upgrades u ON u.uid = c.uid
WHERE e.uid IS NOT NULL OR c.resp_p IN (465, 993, 995)
"""

_R = {
    "conflicting": 0,
    "incomplete": 1,
    "indeterminate": 2,
    "not_observable": 3,
    "inferred": 4,
    "observed": 5,
    "verified": 6,
}


def _rank(state: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _R.items())
    return f"(CASE {state} {whens} END)"


def _least(parts: list[str]) -> str:
    return f"least({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _sql_rule(code: str, where: list[tuple], check: list[tuple], fail: str = "fail", guard: str = "true") -> str:
    """Checking SQL for one rule: parts are (value, condition, state) expressions."""

    def cond(part: tuple) -> str:
        return f"(CASE WHEN ({part[0]}) IS NULL THEN NULL ELSE ({part[1]}) END)"

    def rank(part: tuple) -> str:
        r = _rank(part[2])
        return f"(CASE WHEN ({part[0]}) IS NULL AND {r} >= 4 THEN 2 ELSE {r} END)"

    def unusable(parts: list[tuple]) -> str:
        return _least([f"(CASE WHEN {cond(p)} IS NULL THEN {rank(p)} ELSE 99 END)" for p in parts])

    w = " AND ".join(cond(p) for p in where) or "true"
    a = " AND ".join(cond(p) for p in check)
    wr = unusable(where) if where else "99"
    cr = unusable(check)
    states = _least([rank(p) for p in check])
    return f"""SELECT uid, '{code}' AS code,
      CASE WHEN ({w}) IS NULL THEN CASE WHEN {wr} = 3 THEN 'not_observable' ELSE 'unknown' END
           WHEN ({a}) IS NULL THEN CASE WHEN {cr} = 3 THEN 'not_observable' ELSE 'unknown' END
           WHEN ({a}) THEN 'pass' ELSE '{fail}' END AS outcome,
      CASE WHEN ({w}) IS NULL THEN {wr} WHEN ({a}) IS NULL THEN {cr} ELSE {states} END AS rank
      FROM src WHERE coalesce(({w}), true) AND {guard}"""


_V = ("version_state", "version_state IN ('observed', 'verified')", "version_state")
_S = ("cipher_state", "cipher_state IN ('observed', 'inferred')", "cipher_state")
_KX = ("kx_state", "kx_state IN ('observed', 'inferred', 'verified')", "kx_state")
_12 = ("version", "version = 'TLSv12'", "version_state")


def _version(bad: str) -> list[tuple]:
    return [("version", f"version <> '{bad}'", "version_state")]


def _suite(words: list[str]) -> list[tuple]:
    cond = " AND ".join(f"NOT contains(lower(cipher_name), '{w.lower()}')" for w in words)
    return [("cipher_name", cond, "cipher_state")]


def _mech(bad: str) -> list[tuple]:
    return [("kx_mechanism", f"kx_mechanism <> '{bad}'", "kx_state")]


_FS = ("fs_outcome", "fs_outcome = 'present'", "fs_state")
_SIG = ("signature_state", "signature_state = 'observed'", "signature_state")
_HANDSHAKE_RULES = [
    _sql_rule("TLS_NEGOTIATED_SSL3", [_V], _version("SSLv3")),
    _sql_rule("TLS_NEGOTIATED_TLS10", [_V], _version("TLSv10")),
    _sql_rule("TLS_NEGOTIATED_TLS11", [_V], _version("TLSv11")),
    _sql_rule("TLS_CIPHER_NULL", [_S], _suite(["_NULL_"])),
    _sql_rule("TLS_CIPHER_EXPORT", [_S], _suite(["_EXPORT_"])),
    _sql_rule("TLS_CIPHER_RC4", [_S], _suite(["_RC4_"])),
    _sql_rule("TLS_CIPHER_3DES", [_S], _suite(["_3DES_", "_DES_EDE_"])),
    _sql_rule(
        "TLS_CIPHER_CBC",
        [_S, ("version", "version IN ('TLSv10', 'TLSv11', 'TLSv12')", "version_state")],
        _suite(["_CBC_"]),
    ),
    *[
        _sql_rule(f"TLS12_{name}_NEGOTIATED", [_12, _V, _KX], _mech(bad))
        for name, bad in [("STATIC_RSA", "RSA"), ("STATIC_DH", "DH"), ("DHE", "DHE"), ("STATIC_ECDH", "ECDH")]
    ],
    _sql_rule(
        "TLS12_DHE_PARAMETERS_LT2048",
        [("kx_mechanism", "kx_mechanism = 'DHE'", "kx_state"), ("dh_param_size", "dh_param_size > 0", "kx_state")],
        [("dh_param_size", "dh_param_size >= 2048", "kx_state")],
    ),
    _sql_rule("TLS_HANDSHAKE_SIGNATURE_MD5", [_SIG], [("NULL", "true", "signature_state")]),
    _sql_rule("TLS_HANDSHAKE_SIGNATURE_SHA1", [_SIG], [("NULL", "true", "signature_state")]),
    _sql_rule("TLS_FORWARD_SECRECY_ABSENT", [("fs_outcome", "fs_outcome = 'absent'", "fs_state")], [_FS]),
    _sql_rule(
        "TLS_FORWARD_SECRECY_INDETERMINATE",
        [("fs_outcome", "fs_outcome = 'indeterminate'", "fs_state")],
        [_FS],
        fail="unknown",
    ),
]
_HANDSHAKE_SOURCE = """SELECT *, CASE WHEN hello THEN cipher END AS cipher_name, 'not_observable' AS signature_state,
  CASE fs_outcome WHEN 'indeterminate' THEN 'indeterminate' ELSE kx_state END AS fs_state FROM y_handshakes"""

_ROLE = """CASE WHEN flow_state IN ('incomplete', 'conflicting') OR evidence_state = 'indeterminate' THEN 'unclassified'
   WHEN protocol = 'smtp' AND resp_p = 25 THEN 'smtp_relay' WHEN protocol = 'smtp' AND resp_p IN (465, 587) THEN 'smtp_submission'
   WHEN protocol = 'imap' AND resp_p IN (143, 993) THEN 'imap_access' WHEN protocol = 'pop3' AND resp_p IN (110, 995) THEN 'pop3_access'
   ELSE 'unclassified' END"""
VIEWS["y_session_contexts"] = f"""
SELECT s.*, f.flow_state, {_ROLE} AS role, coalesce(h.established, false) OR coalesce(s.upgrade_state = 'tls_established', false) AS tls_on
FROM y_sessions s JOIN (SELECT uid, CASE WHEN quality = 'complete' THEN 'observed' ELSE quality END AS flow_state FROM y_flows) f ON s.uid = f.uid
LEFT JOIN x_ssl h ON h.uid = s.uid
"""
_TLS = ("tls_on", "tls_on", "'inferred'")
_SESSION_RULES = [
    _sql_rule("MAIL_SUBMISSION_CLEARTEXT", [], [_TLS], guard="role = 'smtp_submission'"),
    _sql_rule("MAIL_ACCESS_CLEARTEXT", [], [_TLS], guard="role IN ('imap_access', 'pop3_access')"),
    _sql_rule(
        "IMAP_LOGIN_WITHOUT_TLS",
        [("protocol", "protocol = 'imap'", "evidence_state"), ("true", "list_contains(coalesce(commands, []), 'LOGIN')", "'inferred'")],
        [_TLS],
    ),
    _sql_rule(
        "POP3_PASS_WITHOUT_TLS",
        [("protocol", "protocol = 'pop3'", "evidence_state"), ("true", "list_contains(coalesce(commands, []), 'PASS')", "'inferred'")],
        [_TLS],
    ),
    _sql_rule(
        "UPGRADE_ACCEPTED_WITHOUT_TLS_TRANSITION",
        [("upgrade_state", "upgrade_state = 'violation'", "upgrade_evidence_state")],
        [("upgrade_state", "upgrade_state = 'tls_established'", "upgrade_evidence_state")],
    ),
    _sql_rule(
        "UPGRADE_PLAINTEXT_FALLBACK",
        [("upgrade_state", "upgrade_state = 'plaintext_fallback'", "upgrade_evidence_state")],
        [("upgrade_state", "upgrade_state = 'tls_established'", "upgrade_evidence_state")],
        guard="role IN ('smtp_submission', 'imap_access', 'pop3_access')",
    ),
]

_LEAF = [("role", "role = 'server'", "evidence_state"), ("chain_index", "chain_index = 0", "evidence_state")]


def _cert(code: str, where: list[tuple], check: list[tuple]) -> str:
    return _sql_rule(code, [*_LEAF, *where], check)


_CERT_RULES = [
    _cert(
        "CERT_RSA_KEY_LT2048",
        [("public_key_algorithm", "public_key_algorithm = 'RSA'", "evidence_state")],
        [("public_key_size", "public_key_size >= 2048", "evidence_state")],
    ),
    _cert("CERT_PUBLIC_KEY_STRENGTH_LT112", [("bits", "bits > 0", "evidence_state")], [("bits", "bits >= 112", "evidence_state")]),
    _cert("CERT_SIGNATURE_MD5", [], [("signature_algorithm", "NOT contains(lower(signature_algorithm), 'md5')", "evidence_state")]),
    _cert("CERT_SIGNATURE_SHA1", [], [("signature_algorithm", "NOT contains(lower(signature_algorithm), 'sha1')", "evidence_state")]),
    _cert("CERT_EXPIRED_AT_CAPTURE", [], [("then_ok", "then_ok", "evidence_state")]),
    _cert(
        "CERT_BECAME_INVALID_AFTER_CAPTURE",
        [("then_ok", "then_ok", "evidence_state"), ("now_ok", "NOT now_ok", "evidence_state")],
        [("now_ok", "now_ok", "evidence_state")],
    ),
]
_CERT_SOURCE = """SELECT cert_no AS uid, role, chain_index, CASE WHEN NOT good AND truncated THEN 'incomplete' ELSE 'observed' END AS evidence_state,
  CASE WHEN good THEN public_key_algorithm END AS public_key_algorithm, CASE WHEN good THEN public_key_size END AS public_key_size,
  CASE WHEN good THEN signature_algorithm END AS signature_algorithm,
  CASE WHEN good THEN CASE public_key_algorithm WHEN 'Ed25519' THEN 128
         WHEN 'RSA' THEN CASE WHEN public_key_size >= 4096 THEN 152 WHEN public_key_size >= 2048 THEN 112 ELSE 80 END
         ELSE CASE WHEN public_key_size >= 384 THEN 192 ELSE 128 END END END AS bits,
  CASE WHEN good THEN not_after >= TIMESTAMP '2024-07-01 00:00:00' END AS now_ok, CASE WHEN good THEN not_after >= capture_time END AS then_ok
  FROM (SELECT *, syntax_valid AND NOT truncated AS good FROM x_cert_dated)"""


def _tally(source: str, rules: list[str], number: str = "CAST(uid AS BIGINT)") -> str:
    union = " UNION ALL ".join(rules)
    names = "['conflicting','incomplete','indeterminate','not_observable','inferred','observed','verified']"
    return f"""WITH src AS ({source}) SELECT code, outcome, {names}[1 + rank] AS evidence_state, count(*) AS checks,
       CAST(sum({number}) AS BIGINT) AS uid_sum FROM ({union}) GROUP BY 1, 2, 3"""


def _structs(spark: SparkSession, sf_dir: str, certs: DataFrame | None = None):
    flows = ops.flow_struct(built_flows(spark, sf_dir))
    words = ops.observed_commands(view(spark, sf_dir, "x_dialogue"), ["LOGIN", "PASS"])
    sessions = ops.session_struct(built_sessions(spark, sf_dir), words)
    handshakes = ops.handshake_struct(built_handshakes(spark, sf_dir))
    certs = certificates(spark, sf_dir) if certs is None else certs
    return flows, sessions, handshakes, ops.certificate_struct(certs)


def judged(
    spark: SparkSession, sf_dir: str, target: str, profile: str = "ietf_current", references: bool = True
) -> DataFrame:
    pack = built_in_pack(profile)
    context = ops.contexts(target, pack, *_structs(spark, sf_dir))
    return ops.evaluate(context, pack, target, clock(), references)


def _tallied(rows: DataFrame, number) -> DataFrame:
    return rows.groupBy(
        "code",
        F.col("check_outcome").alias("outcome"),
        state_from_rank(F.col("coverage_rank")).alias("evidence_state"),
    ).agg(F.count(F.lit(1)).alias("checks"), F.sum(number).alias("uid_sum"))


@query("f29_handshake_rules", _tally(_HANDSHAKE_SOURCE, _HANDSHAKE_RULES))
def handshake_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tallied(judged(spark, sf_dir, "handshake", references=False), F.col("uid").cast("bigint"))


@query("f29_session_rules", _tally("SELECT * FROM y_session_contexts", _SESSION_RULES))
def session_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tallied(judged(spark, sf_dir, "session", references=False), F.col("uid").cast("bigint"))


@query("f29_certificate_rules", _tally(_CERT_SOURCE, _CERT_RULES))
def certificate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = built_in_pack("ietf_current")
    kept = [
        r
        for r in pack.rules
        if r.target == "certificate" and not any("validation" in p.path for p in (*r.where, *r.check))
    ]
    pack = RulePack(pack.profile, pack.version, pack.clock, tuple(kept))
    context = ops.contexts("certificate", pack, *_structs(spark, sf_dir))
    number = F.col("certificate.der_sha256").cast("bigint")
    return _tallied(ops.evaluate(context, pack, "certificate", clock(), references=False), number)


@query(
    "j12_context_star",
    """SELECT s.uid, role AS service_role, h.fs_outcome, tls_on, coalesce(list_aggregate(list_sort(commands), 'string_agg', ','), '') AS commands,
       coalesce(c.leaf, '') AS leaf FROM y_session_contexts s JOIN y_handshakes h ON h.uid = s.uid
       LEFT JOIN (SELECT uid, min(der_sha256) AS leaf FROM x_cert_dated WHERE chain_index = 0 GROUP BY uid) c ON c.uid = s.uid""",
)
def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = built_in_pack("ietf_current")
    context = ops.contexts("session", pack, *_structs(spark, sf_dir))
    return context.select(
        "uid",
        F.col("derived.service_role").alias("service_role"),
        F.col("derived.forward_secrecy.outcome").alias("fs_outcome"),
        F.col("derived.transport_tls_established").alias("tls_on"),
        F.array_join("derived.observed_commands", ",").alias("commands"),
        F.coalesce("certificate.der_sha256", F.lit("")).alias("leaf"),
    )


@query(
    "f27_service_roles",
    "SELECT role AS service_role, count(*) AS sessions FROM y_session_contexts GROUP BY 1",
)
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = built_in_pack("ietf_current")
    flows, sessions, handshakes, _ = _structs(spark, sf_dir)
    context = sessions.join(flows, "uid", "left").join(handshakes, "uid", "left")
    out = ops.with_derived(context, pack)
    return out.groupBy(F.col("derived.service_role").alias("service_role")).agg(
        F.count(F.lit(1)).alias("sessions")
    )


@query(
    "f28_observed_commands",
    """SELECT uid, string_agg(c, ',' ORDER BY c) AS commands FROM (SELECT DISTINCT uid, upper(command) AS c FROM x_dialogue
       WHERE upper(command) IN ('LOGIN', 'PASS', 'NOOP')) GROUP BY uid""",
)
def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.observed_commands(view(spark, sf_dir, "x_dialogue"), ["LOGIN", "PASS", "NOOP"])
    return out.select("uid", F.array_join("commands", ",").alias("commands"))


_RULE_VALUES = ", ".join(
    f"('{profile}', '{code}', DATE '{span[0]}', {'NULL' if span[1] is None else repr(span[1])})"
    for profile, (_, spans) in PROFILES.items()
    for code, span in spans.items()
)


@query(
    "j11_active_rules",
    f"""SELECT strftime(day, '%Y-%m-%d') AS day, profile, count(*) AS active FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) + 7000 AS day FROM orders) d
        JOIN (VALUES {_RULE_VALUES}) r(profile, code, f, u) ON d.day >= r.f AND (r.u IS NULL OR d.day < CAST(r.u AS DATE)) GROUP BY 1, 2""",
)
def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.plans.adapters import table
    from mxposture.sources.rulepacks import rule_table

    days = table(spark, sf_dir, "orders").select(
        F.date_add(F.to_date("o_orderdate"), 7000).alias("day")
    ).distinct()
    rules = rule_table(spark, [built_in_pack(p) for p in PROFILES]).select(
        "profile", "code", "effective_from", "effective_until"
    )
    out = ops.active_rules(rules, days)
    return out.groupBy(F.col("day").cast("string").alias("day"), "profile").agg(
        F.count(F.lit(1)).alias("active")
    )


@query(
    "j13_rule_fanout",
    f"""WITH src AS ({_HANDSHAKE_SOURCE}) SELECT uid, count(*) AS rules FROM ({' UNION ALL '.join(_HANDSHAKE_RULES)}) GROUP BY uid""",
)
def fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir, "handshake")
    return rows.groupBy("uid").agg(F.count(F.lit(1)).alias("rules"))


_CLAUSES = [
    ("eq", "cipher", "TLS_AES_256_GCM_SHA384", "string", "cipher = 'TLS_AES_256_GCM_SHA384'"),
    ("not_eq", "last_alert", "handshake_failure", "string", "last_alert <> 'handshake_failure'"),
    ("in", "server_version", [769, 770], "int", "server_version IN (769, 770)"),
    ("not_in", "server_supported_version", [772], "int", "server_supported_version NOT IN (772)"),
    ("lt", "dh_param_size", 2048, "int", "dh_param_size < 2048"),
    ("lte", "dh_param_size", 1024, "int", "dh_param_size <= 1024"),
    ("gt", "server_key_share_group", 256, "int", "server_key_share_group > 256"),
    ("gte", "server_version", 771, "int", "server_version >= 771"),
    ("contains_any", "cipher", ["_cbc_", "_RC4_"], "string", "contains(lower(cipher), '_cbc_') OR contains(lower(cipher), '_rc4_')"),
    ("contains_none", "cipher", ["gcm"], "string", "NOT contains(lower(cipher), 'gcm')"),
    ("lt", "cipher", 5, "string", "NULL"),
]


def _tri(expr: str) -> str:
    return f"CASE WHEN ({expr}) IS NULL THEN 'unusable' WHEN ({expr}) THEN 'pass' ELSE 'fail' END"


@query(
    "p08_predicate_operators",
    " UNION ALL ".join(
        f"SELECT '{i:02d}_{op}' AS op, {_tri(sql)} AS state, count(*) AS records FROM x_ssl GROUP BY 2"
        for i, (op, _, _, _, sql) in enumerate(_CLAUSES)
    ),
)
def operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    ssl = view(spark, sf_dir, "x_ssl")
    parts = []
    for i, (op, column, literal, dtype, _) in enumerate(_CLAUSES):
        p = predicate(op, F.col(column), literal, dtype)
        state = F.when(p.isNull(), "unusable").when(p, "pass").otherwise("fail")
        parts.append(F.struct(F.lit(f"{i:02d}_{op}").alias("op"), state.alias("state")))
    rows = ssl.select(F.explode(F.array(*parts)).alias("_p")).select("_p.*")
    return rows.groupBy("op", "state").agg(F.count(F.lit(1)).alias("records"))


@query(
    "p09_state_guard",
    """SELECT uid, CASE WHEN quality IN ('incomplete', 'conflicting') OR resp_p IS NULL THEN 'unusable'
       WHEN resp_p IN (465, 587) THEN 'pass' ELSE 'fail' END AS state FROM y_flows""",
)
def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = built_flows(spark, sf_dir)
    p = predicate("in", F.col("resp_p"), [465, 587], "bigint", F.col("evidence_state"))
    state = F.when(p.isNull(), "unusable").when(p, "pass").otherwise("fail")
    return flows.select("uid", state.alias("state"))


@query(
    "p10_conjunction",
    f"""SELECT {_tri("(dh_param_size >= 2048) AND (last_alert <> 'x') AND established")} AS state, count(*) AS records FROM x_ssl GROUP BY 1""",
)
def conjunctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        predicate("gte", F.col("dh_param_size"), 2048, "int"),
        predicate("not_eq", F.col("last_alert"), "x", "string"),
        predicate("eq", F.col("established"), True, "boolean"),
    ]
    both = conjunction(parts)
    state = F.when(both.isNull(), "unusable").when(both, "pass").otherwise("fail")
    ssl = view(spark, sf_dir, "x_ssl")
    return ssl.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("records"))


@query(
    "u06_rule_references",
    """SELECT field_path, evidence_state, count(*) AS refs FROM (
         SELECT unnest(['handshake.version.evidence_state', 'handshake.version.selected']) AS field_path, version_state AS evidence_state
         FROM y_handshakes WHERE version_state IN ('observed', 'verified') AND version = 'TLSv10') GROUP BY 1, 2""",
)
def rule_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = built_in_pack("ietf_current")
    rows = judged(spark, sf_dir, "handshake")
    found = ops.findings(rows, pack, "handshake", F.lit("capture-1"), clock())
    refs = found.where("code = 'TLS_NEGOTIATED_TLS10'").select(F.explode("evidence_references").alias("r"))
    return refs.groupBy(
        F.col("r.field_path").alias("field_path"), F.col("r.evidence_state").alias("evidence_state")
    ).agg(F.count(F.lit(1)).alias("refs"))


_PACK = built_in_pack("ietf_current")


@query(
    "f31_policy_findings",
    f"""WITH src AS ({_HANDSHAKE_SOURCE}) SELECT sha256(concat_ws('|', 'capture-1', '{_PACK.profile}', '{_PACK.digest}', code,
          CASE outcome WHEN 'fail' THEN 'negative' ELSE 'indeterminate' END, 'handshake', src.uid)) AS finding_id,
        resp_h || ':' || resp_p AS affected_endpoint
        FROM ({' UNION ALL '.join(r for r in _HANDSHAKE_RULES if 'SIGNATURE' not in r)}) r JOIN src ON r.uid = src.uid JOIN x_conn c ON c.uid = src.uid
        WHERE outcome = 'fail' OR code = 'TLS_FORWARD_SECRECY_INDETERMINATE' AND outcome = 'unknown' AND fs_outcome = 'indeterminate'""",
)
def policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir, "handshake")
    found = ops.findings(rows, _PACK, "handshake", F.lit("capture-1"), clock())
    return found.where((F.col("outcome") == "negative") | (F.col("code") == "TLS_FORWARD_SECRECY_INDETERMINATE")).select(
        "finding_id", "affected_endpoint"
    )


@query(
    "f32_evaluation_clock",
    """SELECT capture_no, CASE WHEN capture_no = 3 THEN 'missing' ELSE 'ready' END AS state,
       CASE WHEN capture_no = 3 THEN '' ELSE strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') END AS clock
       FROM (SELECT o_custkey % 11 AS capture_no, o_orderdate FROM orders) GROUP BY capture_no""",
)
def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.plans.adapters import table

    orders = table(spark, sf_dir, "orders")
    starts = orders.groupBy((F.col("o_custkey") % 11).alias("capture_no")).agg(
        F.min("o_orderdate").cast("timestamp").alias("start")
    )
    starts = starts.withColumn("start", F.when(F.col("capture_no") != 3, F.col("start")))
    at = ops.evaluation_clock(built_in_pack("historical_at_capture"), clock(), F.col("start"))
    return starts.select(
        "capture_no",
        F.when(at.isNull(), "missing").otherwise("ready").alias("state"),
        F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("clock"),
    )


@query(
    "x2_custom_rule",
    """SELECT CASE WHEN version IS NULL THEN 'unknown' WHEN visibility = 'full' THEN 'pass' ELSE 'fail' END AS outcome, count(*) AS checks
       FROM y_handshakes WHERE coalesce(version = 'TLSv12', true) GROUP BY 1""",
)
def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule(
        code="LOCAL_TLS12_FULL_VIEW",
        target="handshake",
        where=(Predicate("handshake.version.selected", "eq", "TLSv12"),),
        check=(Predicate("handshake.visibility", "eq", "full"),),
        effective_from=date(2020, 1, 1),
        severity="low",
        title="TLS 1.2 handshake not fully visible",
        remediation_id="local.capture_more",
    )
    pack = RulePack("local", "1", "analysis_time", (rule,))
    context = ops.contexts("handshake", pack, *_structs(spark, sf_dir))
    rows = ops.evaluate(context, pack, "handshake", clock())
    return rows.groupBy(F.col("check_outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("checks"))


@query("e3_analyze_findings")
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence to prioritised findings of the current profile, all targets."""
    structs = _structs(spark, sf_dir, validated(spark, sf_dir))
    found, _ = ops.evaluate_pack(_PACK, *structs, clock(), F.lit("capture-1"))
    out = finding_ops.prioritised_findings(
        found.drop("evidence_references", "standards"), view(spark, sf_dir, "x_assets"), ["title"]
    )
    return out.select(
        "finding_id", "code", "affected_endpoint", "outcome", "severity", "basis_state",
        "recurrence_count", "score", "title",
    )


@query("e3_analyze_coverage")
def analyze_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    structs = _structs(spark, sf_dir, validated(spark, sf_dir))
    _, checks = ops.evaluate_pack(_PACK, *structs, clock(), F.lit("capture-1"))
    return finding_ops.coverage(checks)


@query("f29_historical_rules")
def historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture-clock pack: each capture is judged at its own start time."""
    from mxposture.plans.adapters import table

    pack = built_in_pack("historical_at_capture")
    orders = table(spark, sf_dir, "orders")
    start = F.to_timestamp(F.date_add(F.to_date("o_orderdate"), 7000)).alias("capture_start")
    starts = orders.select(F.col("o_orderkey").cast("string").alias("uid"), start)
    context = ops.contexts("handshake", pack, *_structs(spark, sf_dir)).join(starts, "uid")
    rows = ops.evaluate(context, pack, "handshake", F.col("capture_start"), references=False)
    return _tallied(rows, F.col("uid").cast("bigint"))
