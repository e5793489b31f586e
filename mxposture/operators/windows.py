"""Endpoint windows: rollup of evidence per endpoint, past-only statistics, rarity, reasons.

What a window is compared with in its own past comes from ``history.with_past``. Peer groups are counted on
per-day aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mxposture.constants import (
    EVIDENCE_FIELD,
    INCOMPLETE_GATE,
    MAD_FLOOR,
    MAD_SCALE,
    MIN_HISTORY,
    MIN_SUPPORT,
    RARITY_FEATURES,
    Z_CAP,
)
from mxposture.functions.states import lookup
from mxposture.functions.text import opaque_issuer

ROLE_CODES = {0: "smtp_mx", 1: "smtp_submission", 2: "imap_access", 3: "pop3_access"}


def role_code(port: Column, protocol: Column) -> Column:
    """Cohort role from the responder port, then the protocol; relay when neither tells."""
    return (
        F.when(port == 25, 0)
        .when(port.isin(465, 587), 1)
        .when(port.isin(143, 993), 2)
        .when(port.isin(110, 995), 3)
        .when(protocol == "smtp", 0)
        .when(protocol == "imap", 2)
        .when(protocol == "pop3", 3)
        .otherwise(0)
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def endpoint_rollup(
    sessions: DataFrame,
    flows: DataFrame,
    handshakes: DataFrame,
    leaves: DataFrame | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """One window per responder endpoint (and ``by`` columns of the sessions).

    Right sides have one row per uid. ``sessions`` needs uid, protocol, upgrade_state and a BIGINT
    ``ord``; ``handshakes`` the columns of the handshake step; ``leaves`` uid and issuer.
    """
    by = by or []
    rows = sessions.join(
        flows.select("uid", "resp_h", "resp_p", "reconstruction_quality"), "uid", "left"
    )
    facts = handshakes.select(
        "uid",
        F.lit(True).alias("_hs"),
        "established",
        "last_alert",
        "server_certificate_state",
        "version",
        "fs_outcome",
    )
    rows = rows.join(facts, "uid", "left")
    if leaves is not None:
        rows = rows.join(leaves.select("uid", opaque_issuer(F.col("issuer")).alias("_iss")), "uid", "left")
    else:
        rows = rows.withColumn("_iss", F.lit(None).cast("string"))
    endpoint = F.when(
        F.col("resp_h").isNotNull(), F.concat_ws(":", "resp_h", F.col("resp_p").cast("string"))
    ).otherwise(F.concat(F.lit("session:"), F.col("uid")))
    hs = F.col("_hs").isNotNull()
    issuer = F.when(hs, F.col("_iss"))
    last_role = F.max(F.col("ord") * 4 + role_code(F.col("resp_p"), F.col("protocol"))) % 4

    def version(*names: str) -> Column:
        return F.count_if(hs & F.col("version").isin(*names))

    out = rows.groupBy(endpoint.alias("endpoint_id"), *by).agg(
        F.count(F.lit(1)).alias("session_count"),
        last_role.alias("_role"),
        F.count_if(F.col("resp_h").isNotNull()).alias("_flows"),
        F.count_if(F.col("reconstruction_quality") == "incomplete").alias("_incomplete"),
        F.count_if(F.col("upgrade_state").isNotNull()).alias("_upgrades"),
        F.count_if(F.col("upgrade_state") == "plaintext_fallback").alias("_fallback"),
        F.count_if(F.col("upgrade_state").isin("tls_established", "accepted")).alias("_ok"),
        F.count_if(hs).alias("_handshakes"),
        F.count_if(hs & ~F.col("established")).alias("_failed"),
        F.count_if(hs & (F.length("last_alert") > 0)).alias("_alerts"),
        F.count_if(hs & (F.col("server_certificate_state") == "not_observable")).alias("_unseen"),
        F.count_if(hs & F.col("version").isNotNull()).alias("_versioned"),
        version("TLSv13").alias("_v13"),
        version("TLSv12").alias("_v12"),
        version("TLSv10", "TLSv11", "SSLv3").alias("_v10"),
        F.count_if(hs & (F.col("fs_outcome") == "present")).alias("_fs"),
        F.min_by(issuer, F.when(issuer.isNotNull(), F.col("ord"))).alias("issuer_id"),
        (F.min(issuer) != F.max(issuer)).alias("_churn"),
    )
    c = F.col
    old = (c("_versioned") > 0) & (c("_v10") >= c("_v13")) & (c("_v10") >= c("_v12"))
    out = out.withColumns(
        {
            "protocol_role": lookup(c("_role").cast("int"), ROLE_CODES),
            "tls13_share": _rate(c("_v13"), c("_versioned")),
            "tls12_share": _rate(c("_v12"), c("_versioned")),
            "tls10_share": _rate(c("_v10"), c("_versioned")),
            "handshake_failure_rate": _rate(c("_failed"), c("_handshakes")),
            "alert_rate": _rate(c("_alerts"), c("_handshakes")),
            "starttls_success_rate": _rate(c("_ok"), c("_upgrades")),
            "starttls_fallback_rate": _rate(c("_fallback"), c("_upgrades")),
            "forward_secrecy_present_rate": _rate(c("_fs"), c("_handshakes")),
            "certificate_churn_rate": F.when(c("_churn"), 1.0).otherwise(0.0),
            "incomplete_reconstruction_rate": _rate(c("_incomplete"), c("_flows")),
            "not_observable_rate": _rate(c("_unseen"), c("_handshakes")),
            "dominant_tls_version": F.when(old, "TLSv10")
            .when((c("_versioned") > 0) & (c("_v12") > c("_v13")), "TLSv12")
            .otherwise("TLSv13"),
            "issuer_id": F.coalesce("issuer_id", F.lit("iss_unknown")),
        }
    )
    out = out.withColumn("capture_quality_ok", c("incomplete_reconstruction_rate") <= INCOMPLETE_GATE)
    return out.drop(*[n for n in out.columns if n.startswith("_")])


def assign_day(windows: DataFrame, history: DataFrame | None, site: str = "local") -> DataFrame:
    """Current windows at the day after the last one in ``history`` (day 0 without any)."""
    if history is None:
        day = windows.withColumn("day_index", F.lit(0).cast("bigint"))
    else:
        # One number is read back: the last day of a max aggregate.
        last = history.agg(F.max("day_index").alias("d")).first()["d"]
        day = windows.withColumn("day_index", F.lit(0 if last is None else last + 1).cast("bigint"))
    return day.withColumns(
        {"site_id": F.lit(site), "is_new_endpoint": F.col("day_index") == 0, "in_maintenance": F.lit(False)}
    )


# --- past-only statistics -----------------------------------------------------------------------


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    scale = F.greatest(mad * MAD_SCALE, F.lit(MAD_FLOOR))
    return F.greatest(F.lit(-Z_CAP), F.least(F.lit(Z_CAP), (value - median) / scale))


def with_robust_scores(windows: DataFrame, features: list[str]) -> DataFrame:
    """z-score and feature score (larger of |z| and drift) of windows that went through ``with_past``."""
    out = windows.withColumns(
        {f"z_{n}": robust_z(F.col(n), F.col(f"med_{n}"), F.col(f"mad_{n}")) for n in features}
    )
    return out.withColumns(
        {f"score_{n}": F.greatest(F.abs(F.col(f"z_{n}")), F.col(f"drift_{n}")) for n in features}
    )


def with_rarity(windows: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Rarity of each categorical value among earlier peer windows of the same site and role.

    Peers are counted per (site, role, day) and per (site, role, value, day) first; the running
    counts work on those few rows and join back by key and day. An endpoint without peers falls
    back to its own history.
    """
    features = features or RARITY_FEATURES
    group = ["site_id", "protocol_role"]

    def before(*keys: str) -> Window:
        return (
            Window.partitionBy(*keys)
            .orderBy("day_index")
            .rangeBetween(Window.unboundedPreceding, -1)
        )

    days = windows.groupBy(*group, "day_index").agg(F.count(F.lit(1)).alias("_n"))
    days = days.withColumn("peer_n", F.coalesce(F.sum("_n").over(before(*group)), F.lit(0))).drop("_n")
    out = windows.join(days, [*group, "day_index"], "left")
    for name in features:
        seen = windows.groupBy(*group, name, "day_index").agg(F.count(F.lit(1)).alias("_n"))
        seen = seen.withColumn(
            f"_c_{name}", F.coalesce(F.sum("_n").over(before(*group, name)), F.lit(0))
        ).drop("_n")
        out = out.join(seen, [*group, name, "day_index"], "left")
        out = out.withColumn(
            f"count_{name}",
            F.when(F.col("peer_n") > 0, F.col(f"_c_{name}")).otherwise(F.col(f"seen_{name}")),
        )
        total = F.when(F.col("peer_n") > 0, F.col("peer_n")).otherwise(F.col("history_count"))
        out = out.withColumn(
            f"rarity_{name}", -F.log((F.col(f"count_{name}") + 0.5) / (total + 0.5))
        )
        out = out.withColumn(f"first_{name}", (total > 0) & (F.col(f"count_{name}") == 0))
    return out.drop(*[f"_c_{n}" for n in features])


def skip_reason(min_support: int = MIN_SUPPORT, min_history: int = MIN_HISTORY) -> Column:
    """Why a window is not scored; support before history before quality."""
    quality = ~F.col("capture_quality_ok") | (
        F.col("incomplete_reconstruction_rate") > INCOMPLETE_GATE
    )
    return (
        F.when(F.col("session_count") < min_support, "insufficient_support")
        .when(F.col("history_count") < min_history, "insufficient_history")
        .when(quality, "capture_quality")
    )


# --- contributions and reasons --------------------------------------------------------------------


def _evidence(name: str) -> Column:
    return F.lit(EVIDENCE_FIELD.get(name, "session.uid"))


def numeric_part(name: str, score: Column, reference: Column) -> Column:
    return F.struct(
        (-score).alias("rank"),
        F.lit(name).alias("feature"),
        _evidence(name).alias("evidence_field"),
        F.col(name).cast("double").alias("value_num"),
        F.lit(None).cast("string").alias("value_str"),
        reference.cast("double").alias("reference_num"),
        F.lit(None).cast("string").alias("reference_str"),
    )


def rarity_part(name: str) -> Column:
    return F.struct(
        (-F.col(f"rarity_{name}")).alias("rank"),
        F.lit(name).alias("feature"),
        _evidence(name).alias("evidence_field"),
        F.lit(None).cast("double").alias("value_num"),
        F.col(name).alias("value_str"),
        F.lit(None).cast("double").alias("reference_num"),
        F.concat(F.lit("peer_count="), F.col(f"count_{name}").cast("string")).alias("reference_str"),
    )


def top_parts(parts: list[Column], limit: int = 3) -> Column:
    """Largest contributions first, ties by feature name."""
    return F.slice(F.array_sort(F.array(*parts)), 1, limit)


def reason_text(contributions: Column, prefix: str | None = None) -> Column:
    """Sentence with the leading contributions and the evidence fields they come from."""

    def part(c: Column) -> Column:
        number = F.concat(
            c["feature"],
            F.lit("="),
            F.format_string("%.4f", c["value_num"]),
            F.lit(", usually "),
            F.format_string("%.4f", c["reference_num"]),
        )
        word = F.concat(
            c["feature"], F.lit("="), c["value_str"], F.lit(", "), c["reference_str"]
        )
        return F.when(c["value_num"].isNotNull(), number).otherwise(word)

    body = F.concat(
        F.array_join(F.transform(contributions, part), "; "),
        F.lit(" [evidence: "),
        F.array_join(F.array_distinct(F.transform(contributions, lambda c: c["evidence_field"])), ", "),
        F.lit("]"),
    )
    if prefix:
        body = F.concat(F.lit(prefix + " "), body)
    empty = F.lit("too little history [evidence: session.uid]")
    return F.when(F.size(contributions) == 0, empty).otherwise(body)
