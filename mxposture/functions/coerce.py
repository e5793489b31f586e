"""Defensive casts for loosely typed analyzer fields; anything unusable becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_string(value: Column, max_len: int | None = None) -> Column:
    """Non-empty string, of at most ``max_len`` characters if given, otherwise null."""
    fits = F.length(value) > 0
    return F.when(fits if max_len is None else fits & (F.length(value) <= max_len), value)


def whole_number(value: Column, dtype: str = "string") -> Column:
    """Non-negative integer from an integer, an integral float or a digit string."""
    if dtype == "boolean":
        return F.lit(None).cast("bigint")
    if dtype in ("int", "bigint", "smallint", "tinyint"):
        return F.when(value >= 0, value.cast("bigint"))
    if dtype in ("double", "float"):
        return F.when((value >= 0) & (F.floor(value) == value), value.cast("bigint"))
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("bigint"))


def strict_bool(value: Column, dtype: str = "boolean") -> Column:
    return value if dtype == "boolean" else F.lit(None).cast("boolean")


def real_number(value: Column, dtype: str = "string") -> Column:
    if dtype == "boolean":
        return F.lit(None).cast("double")
    return value.try_cast("double")


def int_list(value: Column, dtype: str = "string", limit: int | None = None) -> Column:
    """``"1, 2,x"`` or an array to an array of integers; bad items vanish (after the limit, if any)."""
    if dtype.startswith("array"):
        parts = value.cast("array<string>")
    else:
        parts = F.filter(
            F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: F.length(p) > 0
        )
    numbers = F.transform(
        parts if limit is None else F.slice(parts, 1, limit), lambda p: F.when(p.rlike("^[0-9]+$"), p.try_cast("bigint"))
    )
    return F.filter(numbers, lambda n: n.isNotNull())


def string_list(
    value: Column, dtype: str = "string", max_len: int | None = None, limit: int | None = None
) -> Column:
    """Array or comma list to lower-cased non-empty strings, bounded where a bound is given."""
    parts = value if dtype.startswith("array") else F.split(value, ",")
    cleaned = F.transform(parts, lambda p: F.lower(F.trim(p)))
    cleaned = F.filter(cleaned, lambda p: bounded_string(p, max_len).isNotNull())
    return cleaned if limit is None else F.slice(cleaned, 1, limit)


def flat_or_nested(df: DataFrame, path: str) -> Column:
    """``id.orig_h`` given either as one dotted column or as a field of a struct column."""
    head, _, tail = path.partition(".")
    options = []
    if path in df.columns:
        options.append(F.col(f"`{path}`"))
    if head in df.columns and tail:
        fields = getattr(df.schema[head].dataType, "names", None)
        if fields and tail in fields:
            options.append(F.col(head).getField(tail))
    if not options:
        return F.lit(None).cast("string")
    return F.coalesce(*options)


def well_formed_connection(df: DataFrame) -> DataFrame:
    """Connection rows with the five required fields and legal ports, flat column names."""
    out = df.select(
        "*",
        bounded_string(flat_or_nested(df, "id.orig_h")).alias("_oh"),
        flat_or_nested(df, "id.orig_p").alias("_op"),
        bounded_string(flat_or_nested(df, "id.resp_h")).alias("_rh"),
        flat_or_nested(df, "id.resp_p").alias("_rp"),
    )
    drop = [c for c in ("id", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p") if c in df.columns]
    keep = [f"`{c}`" for c in df.columns if c not in drop and c != "uid"]
    return out.select(
        bounded_string(F.col("uid")).alias("uid"),
        *keep,
        F.col("_oh").alias("orig_h"),
        F.col("_op").try_cast("bigint").alias("orig_p"),
        F.col("_rh").alias("resp_h"),
        F.col("_rp").try_cast("bigint").alias("resp_p"),
    ).where(valid_connection())


def valid_connection() -> Column:
    ports = F.col("orig_p").between(0, 65535) & F.col("resp_p").between(0, 65535)
    names = F.col("uid").isNotNull() & F.col("orig_h").isNotNull() & F.col("resp_h").isNotNull()
    return F.coalesce(names & ports, F.lit(False))
