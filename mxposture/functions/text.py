"""Text helpers: bounding, redaction, visible control characters, labels and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mxposture.constants import BIDI_CODE_POINTS, CONTROL_NAMES, REDACTED, SECRET_COMMANDS

# White space that strip() removes at both ends.
_EDGE = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def bound_text(value: Column, max_len: int | None = None) -> Column:
    """Strip, empty to null; for display also cut to ``max_len`` characters."""
    stripped = F.regexp_replace(value, _EDGE, "")
    return F.when(F.length(stripped) > 0, F.substring(stripped, 1, max_len) if max_len else stripped)


def redact(command: Column, value: Column, max_len: int | None = None) -> Column:
    """Stripped text, replaced as a whole when the command carries secrets or addresses."""
    secret = F.coalesce(F.upper(command).isin(SECRET_COMMANDS), F.lit(False))
    bounded = bound_text(value, max_len)
    return F.when(bounded.isNull(), None).when(secret, F.lit(REDACTED)).otherwise(bounded)


def _escapable() -> list[int]:
    return [*range(0x00, 0x20), *range(0x7F, 0xA0), *BIDI_CODE_POINTS]


# Line breaks and tabs are in most texts; the other code points are rare.
_FREQUENT = [0x09, 0x0A, 0x0D]


def _escape_with(value: Column, render) -> Column:
    """Replace each code point by its rendering: one native byte search per code point. The long
    chain runs only for rows that hold one of the rare code points."""
    rare = [cp for cp in _escapable() if cp not in _FREQUENT]
    pattern = "[" + "".join(f"\\x{{{cp:04X}}}" for cp in rare) + "]"

    def replaced(text: Column, code_points: list[int]) -> Column:
        for cp in code_points:
            text = F.replace(text, F.lit(chr(cp)), F.lit(render(cp)))
        return text

    usual = replaced(value, _FREQUENT)
    return F.when(value.rlike(pattern), replaced(usual, rare)).otherwise(usual)


def report_text(value: Column) -> Column:
    """Controls and bidi marks as ``\\uXXXX``; null becomes the empty string."""
    return F.coalesce(_escape_with(value, lambda cp: f"\\u{cp:04X}"), F.lit(""))


def screen_text(value: Column) -> Column:
    """Controls and bidi marks as a bracketed code point with its name."""
    return _escape_with(
        value, lambda cp: f"⟦U+{cp:04X} {CONTROL_NAMES.get(cp, 'CONTROL')}⟧"
    )


def byte_label(value: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``2.0 MB``."""
    return (
        F.when(value < 1024, F.concat(value.cast("string"), F.lit(" B")))
        .when(value < 1024 * 1024, F.format_string("%.1f KB", value / F.lit(1024.0)))
        .otherwise(F.format_string("%.1f MB", value / F.lit(1048576.0)))
    )


def case_id(requested: Column, filename: Column, digest: Column, max_stem: int | None = None) -> Column:
    """Given id if legal, else the cleaned file stem plus a digest prefix."""
    stem = F.when(filename.contains("."), F.regexp_replace(filename, r"\.[^.]*$", "")).otherwise(
        filename
    )
    cleaned = F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "-")
    cleaned = F.regexp_replace(cleaned, r"^[-._]+|[-._]+$", "")
    cleaned = F.when(cleaned.rlike("^[A-Za-z0-9]"), cleaned).otherwise(F.lit("cap"))
    derived = F.concat(cleaned if max_stem is None else F.substring(cleaned, 1, max_stem), F.lit("-"), F.substring(digest, 1, 8))
    return F.coalesce(F.trim(requested), derived)


def utc_timestamp(value: Column) -> Column:
    """Strict ISO instant with a zone; null otherwise."""
    ok = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(value, " ", "T")))


def utc_text(ts: Column) -> Column:
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def joined_digest(*parts: Column) -> Column:
    """SHA-256 over the parts joined by a bar; nulls count as empty strings."""
    return F.sha2(
        F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256
    )


def opaque_issuer(issuer: Column) -> Column:
    return F.when(
        F.length(issuer) > 0, F.concat(F.lit("iss_"), F.substring(F.sha2(issuer, 256), 1, 12))
    ).otherwise(F.lit("iss_unknown"))
