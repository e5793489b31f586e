"""Fixed values of the evidence model: ranks, point tables, ports, thresholds and code lists."""

from __future__ import annotations

# --- evidence states, weakest first (fixed values) ---------------------------------------
STATE_RANK = {
    "conflicting": 0,
    "incomplete": 1,
    "indeterminate": 2,
    "not_observable": 3,
    "inferred": 4,
    "observed": 5,
    "verified": 6,
}
UNUSABLE_STATES = ["incomplete", "conflicting", "not_observable", "indeterminate"]
USABLE_STATES = ["observed", "verified", "inferred"]
LIMITED_STATES = ["incomplete", "conflicting", "indeterminate"]

SEVERITY_RANK = {"informational": 0, "low": 1, "medium": 2, "high": 3}
OUTCOME_RANK = {"negative": 0, "indeterminate": 1}
TARGET_RANK = {"flow": 0, "session": 1, "handshake": 2, "certificate": 3}
CHECK_CATEGORY = {
    "flow": "transport",
    "session": "mail_protocol",
    "handshake": "tls_handshake",
    "certificate": "certificate",
}

# --- priority score points (fixed values) -------------------------------------------------
SEVERITY_POINTS = {"high": 50, "medium": 30, "low": 15, "informational": 0}
CONFIDENCE_POINTS = {
    "verified": 20,
    "observed": 16,
    "inferred": 12,
    "incomplete": 6,
    "conflicting": 3,
    "indeterminate": 2,
    "not_observable": 0,
}
EXPOSURE_POINTS = {"public": 10, "partner": 8, "internal": 5, "isolated": 2, "unknown": 4}
CRITICALITY_POINTS = {"critical": 5, "high": 4, "medium": 3, "low": 1, "unknown": 2}
BLAST_POINTS = {"organization": 5, "multi_asset": 3, "single_endpoint": 1, "unknown": 1}
RECURRENCE_CAP = 10
SCORE_CAP = 100
SCORE_PART_CAPS = {
    "severity": 50,
    "confidence": 20,
    "exposure": 10,
    "recurrence": 10,
    "asset_criticality": 5,
    "blast_radius": 5,
}

# --- protocols and ports (fixed values) ----------------------------------------------------
SMTP_PORTS = [25, 465, 587]
IMAP_PORTS = [143, 993]
POP3_PORTS = [110, 995]
IMPLICIT_TLS_PORTS = [465, 993, 995]
MAIL_PROTOCOLS = ["smtp", "imap", "pop3"]
EVENT_KINDS = [
    "request",
    "reply",
    "capability",
    "starttls",
    "confirmation",
    "ambiguous_banner",
    "unexpected",
]
SECRET_COMMANDS = [
    "AUTH",
    "LOGIN",
    "USER",
    "PASS",
    "APOP",
    "AUTHENTICATE",
    "AUTH_ANSWER",
    "**",
    "MAIL",
    "RCPT",
]
REDACTED = "<redacted>"
UPGRADE_ORDER = [
    "advertised",
    "requested",
    "accepted",
    "tls_established",
    "plaintext_fallback",
    "violation",
]
UPGRADE_TERMINAL = ["tls_established", "plaintext_fallback", "violation"]

# --- TLS code lists (fixed values) ----------------------------------------------------------
TLS_VERSION_CODES = {
    768: "SSLv3",
    769: "TLSv10",
    770: "TLSv11",
    771: "TLSv12",
    772: "TLSv13",
}
HISTORY_KINDS = {
    "h": "hello_request",
    "c": "client_hello",
    "s": "server_hello",
    "j": "hello_retry_request",
    "v": "hello_verify_request",
    "t": "new_session_ticket",
    "e": "end_of_early_data",
    "o": "encrypted_extensions",
    "x": "certificate",
    "k": "server_key_exchange",
    "r": "certificate_request",
    "n": "server_hello_done",
    "y": "certificate_verify",
    "g": "client_key_exchange",
    "f": "finished",
    "w": "certificate_url",
    "u": "certificate_status",
    "a": "supplemental_data",
    "p": "key_update",
    "m": "message_hash",
    "i": "change_cipher_spec",
    "l": "alert",
    "b": "heartbeat",
    "z": "unknown",
}
HANDSHAKE_TYPE_KINDS = {
    1: "client_hello",
    2: "server_hello",
    4: "new_session_ticket",
    5: "end_of_early_data",
    8: "encrypted_extensions",
    11: "certificate",
    12: "server_key_exchange",
    13: "certificate_request",
    14: "server_hello_done",
    15: "certificate_verify",
    16: "client_key_exchange",
    20: "finished",
    24: "key_update",
}
SIGNATURE_SCHEMES = {
    0x0101: "rsa_pkcs1_md5",
    0x0201: "rsa_pkcs1_sha1",
    0x0202: "dsa_sha1",
    0x0203: "ecdsa_sha1",
    0x0401: "rsa_pkcs1_sha256",
    0x0403: "ecdsa_secp256r1_sha256",
    0x0501: "rsa_pkcs1_sha384",
    0x0503: "ecdsa_secp384r1_sha384",
    0x0601: "rsa_pkcs1_sha512",
    0x0603: "ecdsa_secp521r1_sha512",
    0x0804: "rsa_pss_rsae_sha256",
    0x0805: "rsa_pss_rsae_sha384",
    0x0806: "rsa_pss_rsae_sha512",
    0x0807: "ed25519",
    0x0808: "ed448",
}
# Key-exchange part of a TLS <= 1.2 suite name, and the mechanism it names.
KEY_EXCHANGE_NAMES = {
    "ECDHE_PSK": "ECDHE-PSK",
    "DHE_PSK": "DHE-PSK",
    "RSA_PSK": "RSA-PSK",
    "ECDHE": "ECDHE",
    "DHE": "DHE",
    "ECDH": "ECDH",
    "DH": "DH",
    "PSK": "PSK",
    "RSA": "RSA",
    "SRP_SHA": "SRP",
    "ECCPWD": "ECCPWD",
    "KRB5": "KRB5",
    "GOSTR341112_256": "GOST",
    "GOSTR341094": "GOST",
    "GOSTR341001": "GOST",
}
EPHEMERAL_TLS12 = ["ECDHE", "DHE"]
STATIC_TLS12 = ["RSA", "DH", "ECDH"]
EPHEMERAL_TLS13 = ["ECDHE", "DHE", "(EC)DHE", "PSK-(EC)DHE"]

# --- comparable key strengths, NIST SP 800-57 part 1 (fixed values) -------------------------
MODULUS_STRENGTH = [(1024, 80), (2048, 112), (3072, 128), (4096, 152), (7680, 192), (15360, 256)]
ECC_STRENGTH = [(160, 80), (224, 112), (256, 128), (384, 192), (521, 256)]
NAMED_STRENGTH = {"ED25519": 128, "ED448": 224, "X25519": 128, "X448": 224}
CURVE_STRENGTH = {
    "secp192r1": 80,
    "prime192v1": 80,
    "secp224r1": 112,
    "secp256r1": 128,
    "prime256v1": 128,
    "p-256": 128,
    "secp384r1": 192,
    "p-384": 192,
    "secp521r1": 256,
    "p-521": 256,
    "secp256k1": 128,
    "sect163k1": 80,
    "sect233k1": 112,
    "sect283k1": 128,
    "brainpoolp256r1": 128,
    "brainpoolp384r1": 192,
    "brainpoolp512r1": 256,
    "x25519": 128,
    "ed25519": 128,
    "x448": 224,
    "ed448": 224,
}
MAX_CHAIN_DEPTH = 16
EXPIRY_WARNING_SECONDS = 30 * 24 * 60 * 60

# --- advisory features and thresholds (fixed values) -----------------------------------------
RATE_FEATURES = [
    "tls13_share",
    "tls12_share",
    "tls10_share",
    "handshake_failure_rate",
    "alert_rate",
    "starttls_success_rate",
    "starttls_fallback_rate",
    "forward_secrecy_present_rate",
    "certificate_churn_rate",
    "incomplete_reconstruction_rate",
    "not_observable_rate",
]
ROBUST_FEATURES = RATE_FEATURES[:8]
RARITY_FEATURES = ["issuer_id", "dominant_tls_version"]
EVIDENCE_FIELD = {
    "tls13_share": "handshake.version.selected",
    "tls12_share": "handshake.version.selected",
    "tls10_share": "handshake.version.selected",
    "dominant_tls_version": "handshake.version.selected",
    "handshake_failure_rate": "handshake.established",
    "alert_rate": "handshake.last_alert",
    "starttls_success_rate": "session.explicit_upgrade.state",
    "starttls_fallback_rate": "session.explicit_upgrade.state",
    "forward_secrecy_present_rate": "handshake.key_exchange.mechanism",
    "certificate_churn_rate": "certificate.issuer",
    "issuer_id": "certificate.issuer",
    "incomplete_reconstruction_rate": "flow.reconstruction_quality",
    "not_observable_rate": "handshake.server_certificate_state",
}
ADVISORY_CODE = {
    "tls10_share": "ADVISORY_TLS_VERSION_SHIFT",
    "tls12_share": "ADVISORY_TLS_VERSION_SHIFT",
    "tls13_share": "ADVISORY_TLS_VERSION_SHIFT",
    "dominant_tls_version": "ADVISORY_TLS_VERSION_SHIFT",
    "handshake_failure_rate": "ADVISORY_HANDSHAKE_FAILURE_RATE",
    "alert_rate": "ADVISORY_ALERT_RATE",
    "starttls_fallback_rate": "ADVISORY_STARTTLS_FALLBACK_RATE",
    "starttls_success_rate": "ADVISORY_STARTTLS_FALLBACK_RATE",
    "forward_secrecy_present_rate": "ADVISORY_FORWARD_SECRECY_RATE",
    "issuer_id": "ADVISORY_CERTIFICATE_ISSUER",
    "certificate_churn_rate": "ADVISORY_CERTIFICATE_ISSUER",
}
ADVISORY_DEFAULT = "ADVISORY_MULTIVARIATE_DEVIATION"
MAD_SCALE = 1.4826
MAD_FLOOR = 0.01
Z_CAP = 30.0
Z_THRESHOLD = 3.5
DRIFT_DELTA = 0.02
DRIFT_LAMBDA = 0.5
MIN_SUPPORT = 10
MIN_HISTORY = 14
INCOMPLETE_GATE = 0.40
WARMUP_DAYS = 28
TOP_K = 5
DELAY_WINDOWS = 2
PRECISION_FLOOR = 0.60
PRECISION_LIFT = 0.10
P90_SLACK = 1
ALERT_RATE_FACTOR = 1.10
BOOTSTRAP_REPLICATES = 1000
LOCKED_SEED = 20260904
FOREST_TREES = 80
FOREST_SAMPLE = 256
FOREST_QUANTILE = 0.992
FOREST_MIN_TRAIN = 40
FOREST_REFIT_DAYS = 7

# --- text escaping (fixed values) -------------------------------------------------------------
BIDI_CODE_POINTS = [
    0x061C,
    0x200E,
    0x200F,
    0x202A,
    0x202B,
    0x202C,
    0x202D,
    0x202E,
    0x2066,
    0x2067,
    0x2068,
    0x2069,
]
CONTROL_NAMES = {
    0x00: "NULL",
    0x07: "BELL",
    0x08: "BACKSPACE",
    0x09: "TAB",
    0x0A: "LINE FEED",
    0x0D: "CARRIAGE RETURN",
    0x1B: "ESCAPE",
    0x7F: "DELETE",
    0x061C: "ARABIC LETTER MARK",
    0x200E: "LEFT-TO-RIGHT MARK",
    0x200F: "RIGHT-TO-LEFT MARK",
    0x202A: "LEFT-TO-RIGHT EMBEDDING",
    0x202B: "RIGHT-TO-LEFT EMBEDDING",
    0x202C: "POP DIRECTIONAL FORMATTING",
    0x202D: "LEFT-TO-RIGHT OVERRIDE",
    0x202E: "RIGHT-TO-LEFT OVERRIDE",
    0x2066: "LEFT-TO-RIGHT ISOLATE",
    0x2067: "RIGHT-TO-LEFT ISOLATE",
    0x2068: "FIRST STRONG ISOLATE",
    0x2069: "POP DIRECTIONAL ISOLATE",
}

# --- capture intake (fixed values) ---------------------------------------------------------------
CAPTURE_MAGIC = {
    "pcapng": ["0A0D0D0A"],
    "pcap": ["D4C3B2A1", "A1B2C3D4", "4D3CB2A1", "A1B23C4D"],
}
