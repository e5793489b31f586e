"""Rule packs as data: the catalogue of rules, its profiles, and reading packs from JSON rows."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

TARGETS = ("flow", "session", "handshake", "certificate")

# Paths a rule may read (fixed values).
RULE_PATHS = [
    "flow.uid",
    "flow.resp.host",
    "flow.resp.port",
    "flow.orig.host",
    "flow.orig.port",
    "flow.evidence_state",
    "session.uid",
    "session.protocol",
    "session.evidence_state",
    "session.explicit_upgrade.state",
    "session.explicit_upgrade.evidence_state",
    "session.implicit_tls.correlated_protocol",
    "session.implicit_tls.evidence_state",
    "handshake.uid",
    "handshake.established",
    "handshake.resumed",
    "handshake.evidence_state",
    "handshake.visibility",
    "handshake.version.selected",
    "handshake.version.evidence_state",
    "handshake.cipher_suite.name",
    "handshake.cipher_suite.code",
    "handshake.cipher_suite.evidence_state",
    "handshake.key_exchange.mechanism",
    "handshake.key_exchange.evidence_state",
    "handshake.key_exchange.dh_param_size",
    "handshake.certificate_verify_signature.algorithm",
    "handshake.certificate_verify_signature.evidence_state",
    "certificate.uid",
    "certificate.chain_index",
    "certificate.role",
    "certificate.der_sha256",
    "certificate.evidence_state",
    "certificate.public_key_algorithm",
    "certificate.public_key_size",
    "certificate.public_key_curve",
    "certificate.effective_strength_bits",
    "certificate.signature_algorithm",
    "certificate.valid_at_capture_time",
    "certificate.valid_at_analysis_time",
    "certificate.validation.path_valid_at_capture_time",
    "certificate.validation.path_valid_at_analysis_time",
    "certificate.validation.identity_match",
    "derived.service_role",
    "derived.forward_secrecy.outcome",
    "derived.forward_secrecy.evidence_state",
    "derived.observed_commands",
    "derived.transport_tls_established",
]
OPERATORS = [
    "eq",
    "not_eq",
    "in",
    "not_in",
    "lt",
    "lte",
    "gt",
    "gte",
    "contains_any",
    "contains_none",
]

# Service roles: protocol and responder ports (fixed values).
ROLES = {
    "smtp_relay": ("smtp", [25]),
    "smtp_submission": ("smtp", [465, 587]),
    "imap_access": ("imap", [143, 993]),
    "pop3_access": ("pop3", [110, 995]),
}

# Suites the federal profile approves (fixed values).
APPROVED_SUITES = [
    "TLS_AES_128_GCM_SHA256",
    "TLS_AES_256_GCM_SHA384",
    "TLS_AES_128_CCM_SHA256",
    "TLS_AES_128_CCM_8_SHA256",
    "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256",
    "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
    "TLS_ECDHE_ECDSA_WITH_AES_128_CCM",
    "TLS_ECDHE_ECDSA_WITH_AES_256_CCM",
    "TLS_ECDHE_ECDSA_WITH_AES_128_CCM_8",
    "TLS_ECDHE_ECDSA_WITH_AES_256_CCM_8",
    "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256",
    "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA384",
    "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA",
    "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA",
    "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256",
    "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256",
    "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA384",
    "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA",
    "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA",
    "TLS_RSA_WITH_AES_128_GCM_SHA256",
    "TLS_RSA_WITH_AES_256_GCM_SHA384",
    "TLS_RSA_WITH_AES_128_CCM",
    "TLS_RSA_WITH_AES_256_CCM",
    "TLS_RSA_WITH_AES_128_CCM_8",
    "TLS_RSA_WITH_AES_256_CCM_8",
    "TLS_RSA_WITH_AES_128_CBC_SHA",
    "TLS_RSA_WITH_AES_256_CBC_SHA",
    "TLS_RSA_WITH_AES_128_CBC_SHA256",
    "TLS_RSA_WITH_AES_256_CBC_SHA256",
    "TLS_DHE_RSA_WITH_AES_128_GCM_SHA256",
    "TLS_DHE_RSA_WITH_AES_256_GCM_SHA384",
    "TLS_DHE_RSA_WITH_AES_128_CBC_SHA256",
    "TLS_DHE_RSA_WITH_AES_256_CBC_SHA256",
    "TLS_DHE_RSA_WITH_AES_128_CBC_SHA",
    "TLS_DHE_RSA_WITH_AES_256_CBC_SHA",
]


@dataclass(frozen=True)
class Predicate:
    path: str
    op: str
    value: object
    state_path: str | None = None


@dataclass(frozen=True)
class Rule:
    code: str
    target: str
    where: tuple[Predicate, ...]
    check: tuple[Predicate, ...]
    effective_from: date
    severity: str
    title: str
    remediation_id: str
    standards: tuple[str, ...] = ()
    effective_until: date | None = None
    roles: tuple[str, ...] = ()
    fail_outcome: str = "negative"
    indeterminate_severity: str = "informational"


@dataclass(frozen=True)
class RulePack:
    profile: str
    version: str
    clock: str  # analysis_time or capture_start_time
    rules: tuple[Rule, ...]
    roles: dict = field(default_factory=lambda: dict(ROLES))

    @property
    def digest(self) -> str:
        """SHA-256 over the pack as sorted-key JSON."""
        doc = asdict(self)
        text = json.dumps(doc, sort_keys=True, separators=(",", ":"), default=str, ensure_ascii=False)
        return hashlib.sha256(text.encode()).hexdigest()


_SEEN = ("handshake.version.evidence_state", "in", ["observed", "verified"])
_SUITE_SEEN = ("handshake.cipher_suite.evidence_state", "in", ["observed", "inferred"])
_TLS12_KEYS = [
    ("handshake.version.selected", "eq", "TLSv12"),
    _SEEN,
    ("handshake.key_exchange.evidence_state", "in", ["observed", "inferred", "verified"]),
]
_SIGNED = ("handshake.certificate_verify_signature.evidence_state", "eq", "observed")
_LEAF = [("certificate.role", "eq", "server"), ("certificate.chain_index", "eq", 0)]
_SUITE = "handshake.cipher_suite.name"
_MECHANISM = "handshake.key_exchange.mechanism"
_SECRECY = "derived.forward_secrecy.outcome"
_UPGRADE = "session.explicit_upgrade.state"
_TLS_ON = ("derived.transport_tls_established", "eq", True)


# code: (target, roles, where, check, title, remediation, standards) (fixed values)
CATALOGUE = {
    "TLS_NEGOTIATED_SSL3": (
        "handshake", [], [_SEEN], [("handshake.version.selected", "not_eq", "SSLv3")],
        "SSLv3 negotiated", "tls.minimum_version", ["RFC 7568 §3"],
    ),
    "TLS_NEGOTIATED_TLS10": (
        "handshake", [], [_SEEN], [("handshake.version.selected", "not_eq", "TLSv10")],
        "TLS 1.0 negotiated", "tls.minimum_version", ["RFC 8996 §4", "RFC 9325 §3.1.1"],
    ),
    "TLS_NEGOTIATED_TLS11": (
        "handshake", [], [_SEEN], [("handshake.version.selected", "not_eq", "TLSv11")],
        "TLS 1.1 negotiated", "tls.minimum_version", ["RFC 8996 §4", "RFC 9325 §3.1.1"],
    ),
    "TLS_CIPHER_NULL": (
        "handshake", [], [_SUITE_SEEN], [(_SUITE, "contains_none", ["_NULL_"])],
        "NULL cipher suite negotiated", "tls.disable_null_ciphers", ["RFC 9325 §4.1"],
    ),
    "TLS_CIPHER_EXPORT": (
        "handshake", [], [_SUITE_SEEN], [(_SUITE, "contains_none", ["_EXPORT_"])],
        "Export-grade cipher suite negotiated", "tls.disable_export_ciphers", ["RFC 9325 §4.1"],
    ),
    "TLS_CIPHER_RC4": (
        "handshake", [], [_SUITE_SEEN], [(_SUITE, "contains_none", ["_RC4_"])],
        "RC4 cipher suite negotiated", "tls.disable_rc4", ["RFC 7465 §2", "RFC 9325 §4.1"],
    ),
    "TLS_CIPHER_3DES": (
        "handshake", [], [_SUITE_SEEN], [(_SUITE, "contains_none", ["_3DES_", "_DES_EDE_"])],
        "3DES cipher suite negotiated", "tls.disable_3des", ["RFC 9325 §4.1"],
    ),
    "TLS_CIPHER_CBC": (
        "handshake", [],
        [_SUITE_SEEN, ("handshake.version.selected", "in", ["TLSv10", "TLSv11", "TLSv12"])],
        [(_SUITE, "contains_none", ["_CBC_"])],
        "TLS CBC cipher suite negotiated", "tls.prefer_aead", ["RFC 9325 §4.2"],
    ),
    "TLS12_STATIC_RSA_NEGOTIATED": (
        "handshake", [], _TLS12_KEYS, [(_MECHANISM, "not_eq", "RSA")],
        "TLS 1.2 static RSA key exchange", "tls.disable_static_rsa", ["RFC 10015 §4"],
    ),
    "TLS12_STATIC_DH_NEGOTIATED": (
        "handshake", [], _TLS12_KEYS, [(_MECHANISM, "not_eq", "DH")],
        "TLS 1.2 static finite-field DH", "tls.disable_static_dh", ["RFC 10015 §2"],
    ),
    "TLS12_DHE_NEGOTIATED": (
        "handshake", [], _TLS12_KEYS, [(_MECHANISM, "not_eq", "DHE")],
        "TLS 1.2 finite-field DHE", "tls.disable_ffdhe_tls12", ["RFC 10015 §3"],
    ),
    "TLS12_STATIC_ECDH_NEGOTIATED": (
        "handshake", [], _TLS12_KEYS, [(_MECHANISM, "not_eq", "ECDH")],
        "TLS 1.2 static ECDH", "tls.disable_static_ecdh", ["RFC 9325 §4.2", "RFC 10015 §2"],
    ),
    "TLS12_DHE_PARAMETERS_LT2048": (
        "handshake", [],
        [(_MECHANISM, "eq", "DHE"), ("handshake.key_exchange.dh_param_size", "gt", 0)],
        [("handshake.key_exchange.dh_param_size", "gte", 2048)],
        "TLS DHE parameters shorter than 2048 bits", "tls.dhe_2048", ["RFC 9325 §4.5"],
    ),
    "TLS_HANDSHAKE_SIGNATURE_MD5": (
        "handshake", [], [_SIGNED],
        [("handshake.certificate_verify_signature.algorithm", "contains_none", ["md5"])],
        "MD5 handshake CertificateVerify", "tls.disable_md5_signatures", ["RFC 9155 §3"],
    ),
    "TLS_HANDSHAKE_SIGNATURE_SHA1": (
        "handshake", [], [_SIGNED],
        [("handshake.certificate_verify_signature.algorithm", "contains_none", ["sha1"])],
        "SHA-1 handshake CertificateVerify", "tls.disable_sha1_handshake_signatures", ["RFC 9155 §3"],
    ),
    "TLS_FORWARD_SECRECY_ABSENT": (
        "handshake", [], [(_SECRECY, "eq", "absent")], [(_SECRECY, "eq", "present")],
        "Forward secrecy absent", "tls.require_ephemeral_kx", ["RFC 9325 §4.2"],
    ),
    "TLS_FORWARD_SECRECY_INDETERMINATE": (
        "handshake", [], [(_SECRECY, "eq", "indeterminate")], [(_SECRECY, "eq", "present")],
        "Forward secrecy indeterminate", "tls.observe_full_handshake", ["RFC 8446 §2.2"],
    ),
    "CERT_RSA_KEY_LT2048": (
        "certificate", [], [*_LEAF, ("certificate.public_key_algorithm", "eq", "RSA")],
        [("certificate.public_key_size", "gte", 2048)],
        "RSA authentication key shorter than 2048 bits", "pki.rsa_2048", ["RFC 9325 §4.5"],
    ),
    "CERT_PUBLIC_KEY_STRENGTH_LT112": (
        "certificate", [], [*_LEAF, ("certificate.effective_strength_bits", "gt", 0)],
        [("certificate.effective_strength_bits", "gte", 112)],
        "Public key comparable strength below 112 bits", "pki.minimum_strength_112",
        ["RFC 9325 §4.1", "NIST SP 800-57 Part 1 Rev. 5"],
    ),
    "CERT_SIGNATURE_MD5": (
        "certificate", [], _LEAF, [("certificate.signature_algorithm", "contains_none", ["md5"])],
        "MD5 certificate signature", "pki.disable_md5_cert_signatures", ["RFC 9325 §4.5"],
    ),
    "CERT_SIGNATURE_SHA1": (
        "certificate", [], _LEAF, [("certificate.signature_algorithm", "contains_none", ["sha1"])],
        "SHA-1 certificate signature", "pki.disable_sha1_cert_signatures", ["RFC 9325 §4.5"],
    ),
    "CERT_EXPIRED_AT_CAPTURE": (
        "certificate", [], _LEAF, [("certificate.valid_at_capture_time", "eq", True)],
        "Certificate not valid at capture time", "pki.replace_expired_cert", ["RFC 5280 §6.1.3"],
    ),
    "CERT_PATH_INVALID_AT_CAPTURE": (
        "certificate", [], _LEAF,
        [("certificate.validation.path_valid_at_capture_time", "eq", True)],
        "Certificate path invalid at capture time", "pki.repair_chain", ["RFC 5280 §6"],
    ),
    "CERT_IDENTITY_MISMATCH": (
        "certificate", [], [*_LEAF, ("certificate.validation.identity_match", "eq", False)],
        [("certificate.validation.identity_match", "eq", True)],
        "Certificate identity mismatch", "pki.fix_san", ["RFC 9525 §6.6"],
    ),
    "CERT_BECAME_INVALID_AFTER_CAPTURE": (
        "certificate", [],
        [
            *_LEAF,
            ("certificate.valid_at_capture_time", "eq", True),
            ("certificate.valid_at_analysis_time", "eq", False),
        ],
        [("certificate.valid_at_analysis_time", "eq", True)],
        "Certificate became invalid after capture", "pki.replace_now_expired_cert",
        ["RFC 5280 §6.1.3"],
    ),
    "MAIL_SUBMISSION_CLEARTEXT": (
        "session", ["smtp_submission"], [], [_TLS_ON],
        "Message submission without TLS", "mail.require_submission_tls", ["RFC 8314 §3", "RFC 8997"],
    ),
    "MAIL_ACCESS_CLEARTEXT": (
        "session", ["imap_access", "pop3_access"], [], [_TLS_ON],
        "Mail access without TLS", "mail.require_access_tls", ["RFC 8314 §3", "RFC 8997"],
    ),
    "IMAP_LOGIN_WITHOUT_TLS": (
        "session", [],
        [("session.protocol", "eq", "imap"), ("derived.observed_commands", "contains_any", ["LOGIN"])],
        [_TLS_ON],
        "IMAP LOGIN without TLS", "imap.disable_cleartext_login", ["RFC 9051 §6.2.3"],
    ),
    "POP3_PASS_WITHOUT_TLS": (
        "session", [],
        [("session.protocol", "eq", "pop3"), ("derived.observed_commands", "contains_any", ["PASS"])],
        [_TLS_ON],
        "POP3 PASS without TLS", "pop3.disable_cleartext_pass", ["RFC 2595 §2"],
    ),
    "UPGRADE_ACCEPTED_WITHOUT_TLS_TRANSITION": (
        "session", [], [(_UPGRADE, "eq", "violation")], [(_UPGRADE, "eq", "tls_established")],
        "STARTTLS/STLS accepted without TLS transition", "mail.fix_starttls_transition",
        ["RFC 3207 §4", "RFC 9051 §6.2.1", "RFC 2595"],
    ),
    "UPGRADE_PLAINTEXT_FALLBACK": (
        "session", ["smtp_submission", "imap_access", "pop3_access"],
        [(_UPGRADE, "eq", "plaintext_fallback")], [(_UPGRADE, "eq", "tls_established")],
        "Cleartext fallback after failed upgrade", "mail.abort_on_failed_upgrade", ["RFC 8314 §3"],
    ),
    "NIST_TLS_SUITE_NOT_APPROVED": (
        "handshake", [], [_SUITE_SEEN], [(_SUITE, "in", APPROVED_SUITES)],
        "TLS cipher suite not NIST-approved", "tls.use_nist_approved_suite",
        ["NIST SP 800-52 Rev. 2 §3.3"],
    ),
    "TLS_NEGOTIATED_TLS10_DISCOURAGED": (
        "handshake", [], [_SEEN], [("handshake.version.selected", "not_eq", "TLSv10")],
        "TLS 1.0 negotiated (historical SHOULD NOT)", "tls.minimum_version", ["RFC 7525 §3.1.1"],
    ),
    "TLS_NEGOTIATED_TLS11_DISCOURAGED": (
        "handshake", [], [_SEEN], [("handshake.version.selected", "not_eq", "TLSv11")],
        "TLS 1.1 negotiated (historical SHOULD NOT)", "tls.minimum_version", ["RFC 7525 §3.1.1"],
    ),
    "TLS12_STATIC_RSA_DISCOURAGED": (
        "handshake", [], _TLS12_KEYS, [(_MECHANISM, "not_eq", "RSA")],
        "TLS 1.2 static RSA (historical SHOULD NOT)", "tls.disable_static_rsa",
        ["RFC 7525 §4.2", "RFC 9325 §4.2"],
    ),
}

# profile -> code -> (from, until, severity) (fixed values)
_COMMON = {
    "TLS_NEGOTIATED_SSL3": ("2015-06-01", None, "high"),
    "TLS_CIPHER_NULL": ("2015-05-01", None, "high"),
    "TLS_CIPHER_EXPORT": ("2015-05-01", None, "high"),
    "TLS_CIPHER_RC4": ("2015-02-01", None, "high"),
    "TLS12_STATIC_ECDH_NEGOTIATED": ("2022-11-01", None, "medium"),
    "TLS12_DHE_PARAMETERS_LT2048": ("2022-11-01", None, "high"),
    "TLS_HANDSHAKE_SIGNATURE_MD5": ("2021-12-01", None, "high"),
    "TLS_HANDSHAKE_SIGNATURE_SHA1": ("2021-12-01", None, "high"),
    "TLS_FORWARD_SECRECY_ABSENT": ("2015-05-01", None, "medium"),
    "TLS_FORWARD_SECRECY_INDETERMINATE": ("2018-08-01", None, "informational"),
    "CERT_RSA_KEY_LT2048": ("2022-11-01", None, "high"),
    "CERT_SIGNATURE_MD5": ("2015-05-01", None, "high"),
    "CERT_EXPIRED_AT_CAPTURE": ("2008-05-01", None, "high"),
    "CERT_PATH_INVALID_AT_CAPTURE": ("2008-05-01", None, "high"),
    "CERT_IDENTITY_MISMATCH": ("2024-01-01", None, "high"),
    "CERT_BECAME_INVALID_AFTER_CAPTURE": ("2008-05-01", None, "informational"),
    "MAIL_SUBMISSION_CLEARTEXT": ("2018-01-01", None, "medium"),
    "MAIL_ACCESS_CLEARTEXT": ("2018-01-01", None, "medium"),
    "IMAP_LOGIN_WITHOUT_TLS": ("2021-08-01", None, "high"),
    "POP3_PASS_WITHOUT_TLS": ("1999-06-01", None, "high"),
    "UPGRADE_ACCEPTED_WITHOUT_TLS_TRANSITION": ("2002-02-01", None, "high"),
    "UPGRADE_PLAINTEXT_FALLBACK": ("2018-01-01", None, "medium"),
}
_CURRENT = {
    "TLS_NEGOTIATED_TLS10": ("2021-03-01", None, "high"),
    "TLS_NEGOTIATED_TLS11": ("2021-03-01", None, "high"),
    "TLS_CIPHER_3DES": ("2022-11-01", None, "medium"),
    "TLS_CIPHER_CBC": ("2022-11-01", None, "medium"),
    "TLS12_STATIC_RSA_NEGOTIATED": ("2026-07-01", None, "high"),
    "TLS12_STATIC_DH_NEGOTIATED": ("2026-07-01", None, "high"),
    "TLS12_DHE_NEGOTIATED": ("2026-07-01", None, "high"),
    "CERT_PUBLIC_KEY_STRENGTH_LT112": ("2019-03-01", None, "medium"),
    "CERT_SIGNATURE_SHA1": ("2022-11-01", None, "medium"),
}
PROFILES = {
    "ietf_current": ("analysis_time", {**_COMMON, **_CURRENT}),
    "nist_federal": (
        "analysis_time",
        {
            **_COMMON,
            "TLS_NEGOTIATED_TLS10": ("2019-08-01", None, "high"),
            "TLS_NEGOTIATED_TLS11": ("2019-08-01", None, "high"),
            "TLS_CIPHER_3DES": ("2019-08-01", None, "high"),
            "CERT_PUBLIC_KEY_STRENGTH_LT112": ("2019-03-01", None, "high"),
            "CERT_SIGNATURE_SHA1": ("2022-11-01", None, "high"),
            "NIST_TLS_SUITE_NOT_APPROVED": ("2019-08-01", None, "medium"),
        },
    ),
    "historical_at_capture": (
        "capture_start_time",
        {
            **_COMMON,
            **_CURRENT,
            "TLS_NEGOTIATED_TLS10_DISCOURAGED": ("2015-05-01", "2021-03-01", "medium"),
            "TLS_NEGOTIATED_TLS11_DISCOURAGED": ("2015-05-01", "2021-03-01", "medium"),
            "TLS12_STATIC_RSA_DISCOURAGED": ("2015-05-01", "2026-07-01", "medium"),
        },
    ),
}
# Standards that differ in the federal profile (fixed values).
FEDERAL_STANDARDS = {
    "TLS_NEGOTIATED_TLS10": ["NIST SP 800-52 Rev. 2 §3.1"],
    "TLS_NEGOTIATED_TLS11": ["NIST SP 800-52 Rev. 2 §3.1"],
    "TLS_CIPHER_3DES": ["NIST SP 800-52 Rev. 2 §3.3"],
    "CERT_PUBLIC_KEY_STRENGTH_LT112": ["NIST SP 800-131A Rev. 2", "NIST SP 800-57 Part 1 Rev. 5"],
    "CERT_SIGNATURE_SHA1": ["NIST SP 800-52 Rev. 2 §3.2.1"],
}
PACK_VERSION = "2026.09.0"


def _rule(profile: str, code: str, span: tuple) -> Rule:
    target, roles, where, check, title, remediation, standards = CATALOGUE[code]
    start, end, severity = span
    if profile == "nist_federal":
        standards = FEDERAL_STANDARDS.get(code, standards)
    return Rule(
        code=code,
        target=target,
        where=tuple(Predicate(*p) for p in where),
        check=tuple(Predicate(*p) for p in check),
        effective_from=date.fromisoformat(start),
        effective_until=date.fromisoformat(end) if end else None,
        severity=severity,
        title=title,
        remediation_id=remediation,
        standards=tuple(standards),
        roles=tuple(roles),
        fail_outcome="indeterminate" if code == "TLS_FORWARD_SECRECY_INDETERMINATE" else "negative",
    )


def built_in_pack(profile: str) -> RulePack:
    clock, spans = PROFILES[profile]
    rules = tuple(_rule(profile, code, spans[code]) for code in CATALOGUE if code in spans)
    return check_pack(RulePack(profile, PACK_VERSION, clock, rules))


def check_pack(pack: RulePack) -> RulePack:
    """Bounds, unique codes, known roles, legal paths and operators."""
    if not pack.rules:
        raise ValueError("a pack holds at least one rule")
    codes = [r.code for r in pack.rules]
    if len(set(codes)) != len(codes):
        raise ValueError("rule codes must be unique")
    for rule in pack.rules:
        if rule.target not in TARGETS:
            raise ValueError(f"{rule.code}: unknown target")
        if set(rule.roles) - set(pack.roles):
            raise ValueError(f"{rule.code}: unknown role")
        if not rule.check:
            raise ValueError(f"{rule.code}: no assertion")
        for p in (*rule.where, *rule.check):
            if p.path not in RULE_PATHS or (p.state_path and p.state_path not in RULE_PATHS):
                raise ValueError(f"{rule.code}: path {p.path} is not readable")
            if p.op not in OPERATORS:
                raise ValueError(f"{rule.code}: operator {p.op}")
            if isinstance(p.value, list) != (p.op in ("in", "not_in", "contains_any", "contains_none")):
                raise ValueError(f"{rule.code}: value of {p.op}")
    return pack


RULE_SCHEMA = (
    "profile string, version string, clock string, code string, target string, roles array<string>, "
    "predicates string, effective_from string, effective_until string, severity string, title string, "
    "remediation_id string, standards array<string>, fail_outcome string"
)


def rule_table(spark: SparkSession, packs: list[RulePack]) -> DataFrame:
    """Packs as rows, the form in which they are stored and edited."""
    rows = []
    for pack in packs:
        for r in pack.rules:
            body = json.dumps(
                {
                    "where": [[p.path, p.op, p.value, p.state_path] for p in r.where],
                    "check": [[p.path, p.op, p.value, p.state_path] for p in r.check],
                }
            )
            until = r.effective_until.isoformat() if r.effective_until else None
            rows.append(
                (
                    pack.profile, pack.version, pack.clock, r.code, r.target, list(r.roles), body,
                    r.effective_from.isoformat(), until, r.severity, r.title, r.remediation_id,
                    list(r.standards), r.fail_outcome,
                )
            )
    return spark.createDataFrame(rows, RULE_SCHEMA)


def read_pack(spark: SparkSession, path: str, profile: str) -> RulePack:
    """Pack of one profile from stored rule rows, which become expressions on the driver."""
    table = spark.read.schema(RULE_SCHEMA).json(path)
    rows = table.where(table.profile == profile).orderBy("code").collect()
    if not rows:
        raise ValueError(f"no rules for profile {profile}")
    rules = []
    for row in rows:
        body = json.loads(row.predicates)
        rules.append(
            Rule(
                code=row.code,
                target=row.target,
                where=tuple(Predicate(*p) for p in body["where"]),
                check=tuple(Predicate(*p) for p in body["check"]),
                effective_from=date.fromisoformat(row.effective_from),
                effective_until=date.fromisoformat(row.effective_until) if row.effective_until else None,
                severity=row.severity,
                title=row.title,
                remediation_id=row.remediation_id,
                standards=tuple(row.standards or ()),
                roles=tuple(row.roles or ()),
                fail_outcome=row.fail_outcome or "negative",
            )
        )
    return check_pack(RulePack(profile, rows[0].version, rows[0].clock, tuple(rules)))
