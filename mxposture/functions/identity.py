"""Service names: DNS normal form, IP literals and wildcard join keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASCII = r"^[\x00-\x7F]*$"


@F.pandas_udf(T.StringType())
def _idna(names: pd.Series) -> pd.Series:
    """ASCII form of names with other letters; a label that cannot be encoded gives null."""

    def encode(name):
        if name is None:
            return None
        try:
            return ".".join(
                part if part == "*" else part.encode("idna").decode("ascii")
                for part in name.split(".")
            )
        except UnicodeError:
            return None

    return names.map(encode)


@F.pandas_udf(T.StringType())
def _ip6(values: pd.Series) -> pd.Series:
    from ipaddress import ip_address

    def canonical(value):
        if value is None:
            return None
        try:
            return str(ip_address(value))
        except ValueError:
            return None

    return values.map(canonical)


def dns_name(value: Column, *, ascii_only: bool = False) -> Column:
    """Lower case, no trailing dots, labels of 1..63 characters, 253 in all; else null.

    ``ascii_only`` leaves out the Python step for inputs known to be plain ASCII, so the whole
    expression stays in generated code.
    """
    text = F.lower(F.regexp_replace(F.trim(value), r"\.+$", ""))
    shape = (
        (F.length(text) > 0)
        & (F.length(text) <= 253)
        & ~text.contains(" ")
        & text.rlike(r"^[^.]{1,63}(\.[^.]{1,63})*$")
    )
    text = F.when(shape, text)
    if ascii_only:
        return F.when(text.rlike(_ASCII), text)
    return F.when(text.rlike(_ASCII), text).otherwise(_idna(F.when(~text.rlike(_ASCII), text)))


def ip_literal(value: Column, *, v4_only: bool = False) -> Column:
    """Canonical text of an IP literal, null for anything else."""
    text = F.trim(value)
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = text.rlike(rf"^{octet}(\.{octet}){{3}}$")
    if v4_only:
        return F.when(v4, text)
    return F.when(v4, text).otherwise(_ip6(F.when(text.contains(":"), text)))


def wildcard_tail(host: Column) -> Column:
    """Everything after the first label; null when there is a single label."""
    return F.when(host.contains("."), F.regexp_replace(host, r"^[^.]*\.", ""))


def pattern_tail(pattern: Column) -> Column:
    """Join key of a legal wildcard pattern (one star, whole left-most label)."""
    return F.when(pattern.rlike(r"^\*\.[^*]+$"), F.substring(pattern, 3, 253))
