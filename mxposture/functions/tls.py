"""TLS facts as Columns: versions, history letters, key exchange, forward secrecy, strength."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mxposture.constants import (
    CURVE_STRENGTH,
    ECC_STRENGTH,
    EPHEMERAL_TLS12,
    EPHEMERAL_TLS13,
    HISTORY_KINDS,
    KEY_EXCHANGE_NAMES,
    MODULUS_STRENGTH,
    NAMED_STRENGTH,
    SIGNATURE_SCHEMES,
    STATIC_TLS12,
    TLS_VERSION_CODES,
    USABLE_STATES,
)
from mxposture.functions.states import lookup

# Text spellings of a version once case, blanks and dots are removed (fixed values).
VERSION_ALIASES = {
    "tlsv10": "TLSv10",
    "tls10": "TLSv10",
    "tlsv1": "TLSv10",
    "tlsv11": "TLSv11",
    "tls11": "TLSv11",
    "tlsv12": "TLSv12",
    "tls12": "TLSv12",
    "tlsv13": "TLSv13",
    "tls13": "TLSv13",
    "sslv3": "SSLv3",
    "ssl3": "SSLv3",
}


def decode_version(value: Column) -> Column:
    """Version name from a wire code (number or digits) or an alias, else null."""
    text = F.trim(value.cast("string"))
    compact = F.regexp_replace(F.lower(text), "[ .]", "")
    by_code = lookup(F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int")), TLS_VERSION_CODES)
    return F.when(F.length(text) <= 16, F.coalesce(lookup(compact, VERSION_ALIASES), by_code))


def has_server_hello(history: Column) -> Column:
    return history.contains("s") | history.contains("j")


def history_messages(history: Column, max_len: int | None = None) -> Column:
    """History letters as ordered messages; upper case is the originator."""
    letters = F.split(F.substring(history, 1, max_len) if max_len else history, "", -1)
    letters = F.filter(letters, lambda c: c != "")

    def message(letter: Column, index: Column) -> Column:
        flip = letter == "^"
        known = F.coalesce(lookup(F.lower(letter), HISTORY_KINDS), F.lit("unknown"))
        upper = letter.rlike("^[A-Z]$")
        return F.struct(
            index.cast("int").alias("position"),
            F.when(flip, "direction_flip").otherwise(known).alias("kind"),
            F.when(flip | upper, "orig").otherwise("resp").alias("direction"),
            letter.alias("history_letter"),
            F.when(flip, "observed").otherwise("inferred").alias("evidence_state"),
        )

    return F.transform(letters, message)


def selected_version(
    history: Column, supported: Column, legacy: Column, general: Column
) -> dict[str, Column]:
    """Negotiated version with its source; the extension wins over the legacy record."""
    ext, old, any_ = decode_version(supported), decode_version(legacy), decode_version(general)
    hello = F.coalesce(has_server_hello(history), F.lit(False))
    record = F.coalesce(old, any_)
    by_ext = hello & ext.isNotNull()
    by_record = hello & record.isNotNull()
    return {
        "version": F.when(by_ext, ext).when(by_record, record),
        "version_source": F.when(by_ext, "supported_versions").when(by_record, "legacy_record"),
        "version_state": F.when(by_ext | by_record, "observed")
        .when(F.coalesce(history.contains("C"), F.lit(False)), "incomplete")
        .otherwise("not_observable"),
    }


def certificate_state(history: Column) -> Column:
    return F.when(history.contains("x"), "observed").otherwise("not_observable")


def verify_state(history: Column) -> Column:
    return F.when(history.contains("y"), "observed").otherwise("not_observable")


def visibility(history: Column, version: Column, established: Column) -> Column:
    """How much of the handshake could be seen."""
    seen = F.coalesce(F.length(history) > 0, F.lit(False))
    modern = F.coalesce(version == "TLSv13", F.lit(False))
    full_13 = history.contains("x") & history.contains("y")
    flight = history.contains("x") | history.contains("n")
    full_12 = F.coalesce(established, F.lit(False)) & has_server_hello(history) & flight
    return (
        F.when(~seen, "not_observable")
        .when(F.when(modern, full_13).otherwise(full_12), "full")
        .otherwise("partial")
    )


def handshake_state(
    quality: Column, reason: Column, established: Column, version: Column, version_state: Column
) -> Column:
    """Evidence state of a handshake given the flow it was cut from."""
    lossy = ["snaplen_truncation", "segment_gap", "capture_loss", "midstream_start"]
    cut = (quality == "incomplete") & reason.isin(lossy) & ~F.coalesce(established, F.lit(False))
    return (
        F.when(quality == "conflicting", "conflicting")
        .when(F.coalesce(cut, F.lit(False)) | (version_state == "incomplete"), "incomplete")
        .when(version.isNotNull(), "observed")
        .otherwise(version_state)
    )


def decode_signature(value: Column) -> Column:
    """Signature scheme name from hex, decimal or text; the last of a comma list counts."""
    last = F.trim(F.element_at(F.split(value, ","), -1))
    low = F.regexp_replace(F.lower(last), "-", "_")
    code = F.when(low.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(low, 3, 20), 16, 10)).when(
        low.rlike("^[0-9]{1,9}$"), low
    )
    named = lookup(code.cast("bigint"), SIGNATURE_SCHEMES)
    return F.when(F.length(last) > 0, F.coalesce(named, low))


def cipher_state(name: Column, code: Column, history: Column) -> Column:
    return (
        F.when(~F.coalesce(has_server_hello(history), F.lit(False)), "incomplete")
        .when(name.isNull(), "not_observable")
        .when(code.isNull(), "inferred")
        .otherwise("observed")
    )


def suite_mechanism(cipher: Column) -> Column:
    """Mechanism named by a TLS <= 1.2 suite; the longest prefix wins."""
    names = sorted(KEY_EXCHANGE_NAMES, key=len, reverse=True)
    found = F.regexp_extract(cipher, "^TLS_(" + "|".join(names) + ")(_|$)", 1)
    return lookup(found, KEY_EXCHANGE_NAMES)


def group_family(name: Column, code: Column, curve: Column) -> Column:
    label = F.lower(F.coalesce(F.nullif(name, F.lit("")), F.nullif(curve, F.lit(""))))
    return (
        F.when(label.contains("mlkem") | label.contains("ml-kem"), "(EC)DHE")
        .when(label.contains("ffdhe"), "DHE")
        .when(label.isNotNull(), "ECDHE")
        .when(code.between(256, 260), "DHE")
        .when(code >= 4585, "(EC)DHE")
        .when(code.isNotNull(), "ECDHE")
    )


def key_exchange(
    version: Column,
    cipher: Column,
    server_group: Column,
    client_groups: Column,
    psk_modes: Column,
    curve: Column,
    resumed: Column,
    group_name: Column,
) -> dict[str, Column]:
    """Mechanism and evidence state; TLS 1.3 never looks at the suite name."""
    modern = F.lower(F.regexp_replace(version, "[ .]", "")).isin("tlsv13", "tls13")
    share = server_group.isNotNull() | F.coalesce(F.length(curve) > 0, F.lit(False))
    res = F.coalesce(resumed, F.lit(False))
    offers_dhe = F.coalesce(F.array_contains(psk_modes, F.lit(1).cast("bigint")), F.lit(False))
    offered = F.coalesce(F.size(client_groups) > 0, F.lit(False))
    family = F.coalesce(group_family(group_name, server_group, curve), F.lit("(EC)DHE"))
    mech13 = F.when(res & share, "PSK-(EC)DHE").when(res, "PSK").when(share, family)
    state13 = (
        F.when(share, "observed")
        .when(res & ~offers_dhe, "inferred")
        .when(res, "indeterminate")
        .when(offered, "incomplete")
        .otherwise("indeterminate")
    )
    suite13 = cipher.rlike("^TLS_(AES|CHACHA20|AEGIS)_") & ~cipher.contains("_WITH_")
    mech12 = F.when(suite13, F.lit(None).cast("string")).otherwise(suite_mechanism(cipher))
    state12 = (
        F.when(cipher.isNull(), "incomplete")
        .when(mech12.isNull(), "indeterminate")
        .otherwise("inferred")
    )
    return {
        "kx_mechanism": F.when(version.isNull(), None).when(modern, mech13).otherwise(mech12),
        "kx_state": F.when(version.isNull(), "incomplete").when(modern, state13).otherwise(state12),
    }


def forward_secrecy(
    version: Column, version_state: Column, mechanism: Column, kx_state: Column, state: Column
) -> dict[str, Column]:
    """present / absent / indeterminate with the reason for the judgement."""
    usable = kx_state.isin(USABLE_STATES)
    is13 = version == "TLSv13"
    is12 = version.isin("TLSv12", "TLSv11", "TLSv10", "SSLv3")
    reason = (
        F.when(state.isin("incomplete", "conflicting"), "handshake_incomplete")
        .when(version.isNull() | ~version_state.isin(USABLE_STATES), "version_unusable")
        .when(kx_state.isin("incomplete", "conflicting", "not_observable"), "key_exchange_unusable")
        .when(mechanism.isNull(), "key_exchange_missing")
        .when(is13 & mechanism.isin(EPHEMERAL_TLS13) & usable, "tls13_ephemeral")
        .when(is13 & (mechanism == "PSK"), "tls13_psk_only")
        .when(is13, "tls13_unknown_mechanism")
        .when(is12 & mechanism.isin(EPHEMERAL_TLS12) & usable, "tls12_ephemeral")
        .when(is12 & mechanism.isin(STATIC_TLS12) & usable, "static_key_exchange")
        .when(is12 & (kx_state == "indeterminate"), "key_exchange_indeterminate")
        .when(is12, "tls12_unknown_mechanism")
        .otherwise("unsupported_version")
    )
    outcome = (
        F.when(reason.isin("tls13_ephemeral", "tls12_ephemeral"), "present")
        .when(reason == "static_key_exchange", "absent")
        .otherwise("indeterminate")
    )
    return {
        "fs_outcome": outcome,
        "fs_state": F.when(outcome == "indeterminate", "indeterminate").otherwise(kx_state),
        "fs_reason": reason,
    }


def _floor_step(size: Column, table: list[tuple[int, int]]) -> Column:
    out = None
    for floor, bits in reversed(table):
        out = F.when(size >= floor, bits) if out is None else out.when(size >= floor, bits)
    return out


def strength_bits(algorithm: Column, size: Column, curve: Column) -> Column:
    """Comparable security strength; key sizes of different families are never compared."""
    token = F.regexp_replace(F.upper(F.trim(algorithm)), "-", "")
    sized = F.when(
        token.isin("RSA", "RSASSA", "RSAPSS", "DSA"), _floor_step(size, MODULUS_STRENGTH)
    ).when(token.isin("ECDSA", "ECDH", "EC"), _floor_step(size, ECC_STRENGTH))
    return F.when(
        algorithm.isNotNull(),
        F.coalesce(
            lookup(token, NAMED_STRENGTH),
            lookup(F.lower(F.trim(curve)), CURVE_STRENGTH),
            F.when(size > 0, sized),
        ),
    ).cast("int")


def valid_at(instant: Column, not_before: Column, not_after: Column) -> Column:
    return (instant >= not_before) & (instant <= not_after)


def expires_within(instant: Column, not_after: Column, seconds: int) -> Column:
    left = not_after.cast("long") - instant.cast("long")
    return F.when(left < 0, F.lit(False)).otherwise(left <= seconds)


def protocol_from_alpn(alpn: Column) -> Column:
    name = F.lower(F.trim(alpn))
    return F.when(name.isin("smtp", "imap", "pop3"), name)
