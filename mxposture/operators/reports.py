"""Report and dashboard reads: finding views, evidence resolution, case summaries, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mxposture.constants import LIMITED_STATES, SEVERITY_RANK
from mxposture.functions.states import lookup
from mxposture.operators.findings import assessment, outcome_counts

SEVERITIES = ["high", "medium", "low", "informational"]


# --- findings ---------------------------------------------------------------------------------


def finding_protocols(findings: DataFrame, references: DataFrame, checks: DataFrame) -> DataFrame:
    """Protocol of the first check that shares a record key or the endpoint with a finding.

    The OR of both conditions becomes two equality joins against one row per key, so no pair of
    finding and check is ever formed. ``checks`` needs a BIGINT ``ord``.
    """
    first = F.min(F.struct("ord", "protocol"))
    by_key = checks.groupBy("record_key").agg(first.alias("_k"))
    by_end = checks.groupBy("affected_endpoint").agg(first.alias("_e"))
    keyed = (
        references.select("finding_id", "record_key")
        .distinct()
        .join(by_key, "record_key")
        .groupBy("finding_id")
        .agg(F.min("_k").alias("_k"))
    )
    joined = findings.join(keyed, "finding_id", "left").join(by_end, "affected_endpoint", "left")
    earliest = F.least("_k", "_e")
    return joined.withColumn("protocol", F.coalesce(earliest["protocol"], F.lit("unclassified"))).drop(
        "_k", "_e"
    )


def filter_findings(
    rows: DataFrame,
    severities: list[str] | None = None,
    protocols: list[str] | None = None,
    states: list[str] | None = None,
    search: str = "",
    fields: list[str] | None = None,
) -> DataFrame:
    """Facets narrow the rows; the search text must occur in the joined text fields."""
    for column, wanted in (("severity", severities), ("protocol", protocols), ("basis_state", states)):
        if wanted:
            rows = rows.where(F.col(column).isin(wanted))
    text = search.strip().lower()
    if text:
        fields = fields or ["title", "code", "affected_endpoint", "rationale", "protocol"]
        rows = rows.where(F.lower(F.concat_ws(" ", *fields)).contains(text))
    return rows


def dashboard_order() -> list[Column]:
    return [
        F.col("score").desc(),
        lookup(F.col("severity"), SEVERITY_RANK).desc(),
        F.col("title"),
        F.col("finding_id"),
    ]


def priority_band() -> Column:
    sev, points = F.col("severity"), F.col("score")
    return (
        F.when((sev == "high") | (points >= 80), 1)
        .when((sev == "medium") | (points >= 50), 2)
        .otherwise(3)
    )


def leading(rows: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of every case; the rank limit is applied before the exchange too."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def attention_queue(rows: DataFrame, by: list[str], limit: int = 4) -> DataFrame:
    """The findings of each case (``by``) to look at first, with their priority band."""
    return leading(rows, by, dashboard_order(), limit).withColumn("priority", priority_band())


def briefing(top: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """Title and detail of each case's briefing: its leading finding and its coverage counts."""
    first = leading(top, by, dashboard_order(), 1).select(*by, "title", "affected_endpoint", "score")
    gaps = (F.col("unknown_count") + F.col("not_observable_count")).alias("gaps")
    row = counts.select(*by, gaps, "failed_count").join(first, by, "full")
    row = row.fillna(0, ["gaps", "failed_count"])
    found = F.col("title").isNotNull()
    title = (
        F.when(found, F.concat(F.lit("Review first: "), F.col("title")))
        .when(F.col("gaps") > 0, "Nothing failed, but part of the evidence is missing.")
        .otherwise("Nothing failed in what was observed.")
    )
    lead = F.format_string(
        "%s scores %d of 100; %d checks failed, %d are open.", "affected_endpoint", "score", "failed_count", "gaps"
    )
    detail = (
        F.when(found, lead)
        .when(F.col("gaps") > 0, F.format_string("Open checks: %d.", "gaps"))
        .otherwise("Every check that applies has passed.")
    )
    return row.select(*by, title.alias("title"), detail.alias("detail"))


# --- evidence resolution -------------------------------------------------------------------------


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Every path of a record, inner structs included."""
    out = []
    for field in schema.fields:
        path = prefix + field.name
        out.append(path)
        if isinstance(field.dataType, T.StructType):
            out += schema_paths(field.dataType, path + ".")
    return out


def resolve_references(references: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """Reference -> record and field: resolved, dangling_record or dangling_field, with the value.

    ``records``: one frame per record type with ``record_key`` (one row per key) and a struct
    ``record``. Each type is one equality join.
    """
    out = None
    for kind, frame in records.items():
        refs = references.where(F.col("record_type") == kind)
        joined = refs.join(frame.select("record_key", "record"), "record_key", "left")
        schema = frame.schema["record"].dataType
        paths = schema_paths(schema)
        value = F.coalesce(
            *[
                F.when(F.col("field_path") == p, _text(F.col(f"record.{p}"), schema, p))
                for p in paths
            ]
        )
        part = joined.select(
            *references.columns,
            F.when(F.col("record").isNull(), "dangling_record")
            .when(~F.col("field_path").isin(paths), "dangling_field")
            .otherwise("resolved")
            .alias("status"),
            value.alias("field_value"),
        )
        out = part if out is None else out.unionByName(part)
    other = references.where(~F.col("record_type").isin(list(records)))
    return out.unionByName(
        other.withColumns({"status": F.lit("dangling_record"), "field_value": F.lit(None).cast("string")})
    )


def _text(value: Column, schema: T.StructType, path: str) -> Column:
    node: T.DataType = schema
    for part in path.split("."):
        node = node[part].dataType
    if isinstance(node, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def lineage(
    findings: DataFrame, flows: DataFrame, sessions: DataFrame, handshakes: DataFrame, certificates: DataFrame
) -> DataFrame:
    """Finding -> flow, session, handshake and chain size by the key of its first reference.

    ``findings`` needs ``record_key``; the evidence sides have one row per uid.
    """
    chains = certificates.groupBy("uid").agg(F.count(F.lit(1)).alias("cert_count"))
    out = (
        findings.withColumn("uid", F.col("record_key"))
        .join(flows.select("uid", F.lit(True).alias("_f"), F.col("reconstruction_quality").alias("flow_quality")), "uid", "left")
        .join(sessions.select("uid", F.col("protocol").alias("session_protocol"), F.col("evidence_state").alias("session_state")), "uid", "left")
        .join(handshakes.select("uid", F.col("version").alias("tls_version"), F.col("server_certificate_state").alias("cert_state")), "uid", "left")
        .join(chains, "uid", "left")
    )
    return out.withColumns(
        {"flow": F.when(F.col("_f"), F.col("uid")), "cert_count": F.coalesce("cert_count", F.lit(0))}
    ).drop("_f")


def flow_views(flows: DataFrame, sessions: DataFrame, handshakes: DataFrame) -> DataFrame:
    """Flows with protocol and TLS labels for the topology view."""
    s = sessions.select("uid", F.coalesce("protocol", "payload_evidence").alias("_p"))
    h = handshakes.select("uid", F.lit(True).alias("_h"), F.col("version").alias("_v"))
    out = flows.join(s, "uid", "left").join(h, "uid", "left")
    return out.select(
        "uid",
        F.concat_ws(":", "orig_h", F.col("orig_p").cast("string")).alias("source"),
        F.concat_ws(":", "resp_h", F.col("resp_p").cast("string")).alias("destination"),
        F.coalesce("_p", F.lit("TCP")).alias("protocol"),
        F.coalesce(
            "_v",
            F.when(F.col("_h"), "TLS version unavailable").otherwise("TLS not observed"),
        ).alias("tls"),
        (F.col("orig_bytes") + F.col("resp_bytes")).alias("bytes"),
        F.col("reconstruction_quality").alias("quality"),
    )


# --- case level -----------------------------------------------------------------------------------


def case_summaries(scored: DataFrame, checks: DataFrame, key: str = "case_id") -> DataFrame:
    """One row per case: severity counts, coverage gaps, assessment state and risk."""
    by_case = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.max("score").alias("_risk"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
    )
    gaps = checks.groupBy(key).agg(*outcome_counts())
    out = by_case.join(gaps, key, "full")
    out = out.fillna(0, [c for c in out.columns if c not in (key, "_risk")])
    state = assessment(F.col("applicable_count"), F.col("unknown_count"), F.col("not_observable_count"))
    return (
        out.withColumn("assessment_state", state)
        .withColumn(
            "risk_score", F.coalesce("_risk", F.when(F.col("assessment_state") == "complete", F.lit(0)))
        )
        .drop("_risk")
    )


def filter_cases(cases: DataFrame, assessment_state: str | None = None, search: str = "") -> DataFrame:
    if assessment_state:
        cases = cases.where(F.col("assessment_state") == assessment_state)
    text = search.strip().lower()
    return cases.where(F.lower("case_id").contains(text)) if text else cases


def catalog_order() -> list[Column]:
    """Highest risk first (no score counts as -1), then most unresolved checks."""
    return [
        F.coalesce("risk_score", F.lit(-1)).desc(),
        (F.col("unknown_count") + F.col("not_observable_count")).desc(),
        F.col("case_id"),
    ]


def portfolio(cases: DataFrame) -> DataFrame:
    """Average risk of scored cases, urgent cases, unresolved checks."""
    return cases.agg(
        F.floor(F.avg("risk_score") + 0.5).cast("int").alias("average_risk"),
        F.count_if(F.coalesce("risk_score", F.lit(0)) >= 80).alias("urgent_cases"),
        F.sum(F.col("unknown_count") + F.col("not_observable_count")).alias("unresolved"),
    )


def limitations(flows: DataFrame, handshakes: DataFrame, by: list[str]) -> DataFrame:
    """Incomplete and conflicting flows, certificates out of sight, and the notes they cause."""
    f = flows.groupBy(*by).agg(
        F.count_if(F.col("reconstruction_quality") == "incomplete").alias("incomplete_flow_count"),
        F.count_if(F.col("reconstruction_quality") == "conflicting").alias("conflicting_flow_count"),
        F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated_packets_present"),
    )
    h = handshakes.groupBy(*by).agg(
        F.count_if(F.col("server_certificate_state") == "not_observable").alias(
            "not_observable_certificate_count"
        )
    )
    out = f.join(h, by, "full").fillna(0).fillna(False)

    def note(condition: Column, text: Column) -> Column:
        return F.when(condition, text)

    inc, con, cert = (
        F.col("incomplete_flow_count"),
        F.col("conflicting_flow_count"),
        F.col("not_observable_certificate_count"),
    )
    notes = F.array_compact(
        F.array(
            note(
                F.col("truncated_packets_present"),
                F.lit("Packets were cut short in this capture, so streams may have holes."),
            ),
            note(inc > 0, F.format_string("Flows with missing bytes: %d.", inc)),
            note(con > 0, F.format_string("Flows whose copies disagree: %d.", con)),
            note(
                cert > 0,
                F.format_string("Handshakes whose certificate could not be seen: %d.", cert),
            ),
        )
    )
    return out.withColumn("notes", notes)


# --- tiles ----------------------------------------------------------------------------------------


def certificate_failure() -> Column:
    flags = ["valid_at_capture_time", "identity_match", "path_valid_at_capture_time"]
    out = F.lit(False)
    for name in flags:
        out = out | F.coalesce(~F.col(name), F.lit(False))
    return out


def certificate_posture(certificates: DataFrame) -> DataFrame:
    def yes(name: str) -> Column:
        return F.count_if(F.col(name))

    def no(name: str) -> Column:
        return F.count_if(~F.col(name))

    return certificates.agg(
        F.count(F.lit(1)).alias("observed"),
        yes("valid_at_capture_time").alias("valid_at_capture"),
        no("valid_at_capture_time").alias("expired_at_capture"),
        yes("identity_match").alias("identity_match"),
        no("identity_match").alias("identity_mismatch"),
        F.count_if(F.col("syntax_valid") & ~certificate_failure()).alias("healthy"),
    )


def flow_tiles(flows: DataFrame) -> DataFrame:
    return flows.agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(F.col("reconstruction_quality") == "complete").alias("complete"),
        F.sum(F.col("orig_bytes") + F.col("resp_bytes")).alias("observed_bytes"),
        F.sum(F.col("gap_bytes") + F.col("missed_bytes")).alias("missing_bytes"),
    )


def session_tiles(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count("protocol").alias("identified"),
        F.count_distinct("protocol").alias("protocols"),
        F.count_if(F.col("upgrade_state") == "tls_established").alias("upgraded"),
        F.count_if(F.col("upgrade_state").isin("violation", "plaintext_fallback")).alias("upgrade_issues"),
    )


def handshake_tiles(handshakes: DataFrame) -> DataFrame:
    return handshakes.agg(
        F.count(F.lit(1)).alias("handshakes"),
        F.count_if("established").alias("established"),
        F.count_if(F.col("visibility") == "full").alias("full_visibility"),
        F.count_distinct("version").alias("versions"),
    )


def ratio(clear: Column, total: Column) -> Column:
    """Whole percent, never below zero, zero for nothing."""
    share = F.greatest(F.lit(0), clear) / total * 100
    return F.when(total <= 0, 0).otherwise(F.floor(share + 0.5)).cast("int")


def row_states(kind: str, rows: DataFrame) -> DataFrame:
    """clear / attention / limited / unknown per evidence row, counted."""
    state = {"flow": _flow_state, "session": _session_state, "handshake": _handshake_state, "certificate": _certificate_state}[kind]()
    return rows.groupBy(F.lit(kind).alias("kind"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def _flow_state() -> Column:
    return (
        F.when((F.col("reconstruction_quality") == "conflicting") | (F.col("evidence_state") == "conflicting"), "attention")
        .when(
            (F.col("reconstruction_quality") != "complete") | (F.col("gap_bytes") > 0) | (F.col("missed_bytes") > 0),
            "limited",
        )
        .otherwise("clear")
    )


def _session_state() -> Column:
    upgrade = F.col("upgrade_state")
    return (
        F.when(upgrade.isin("violation", "plaintext_fallback"), "attention")
        .when(F.col("evidence_state") == "not_observable", "unknown")
        .when(
            F.col("evidence_state").isin(LIMITED_STATES)
            | (F.col("payload_evidence") == "indeterminate")
            | upgrade.isNull()
            | (upgrade != "tls_established"),
            "limited",
        )
        .when(F.col("protocol").isNull(), "unknown")
        .otherwise("clear")
    )


def _handshake_state() -> Column:
    legacy = F.coalesce(F.col("version").rlike("(?i)SSL|TLSv10|TLSv11|TLS 1\\.0|TLS 1\\.1"), F.lit(False))
    return (
        F.when(~F.col("established") | legacy, "attention")
        .when((F.col("visibility") != "full") | F.col("evidence_state").isin(LIMITED_STATES), "limited")
        .when(F.col("version").isNull(), "unknown")
        .otherwise("clear")
    )


def _certificate_state() -> Column:
    return (
        F.when(~F.col("syntax_valid") | certificate_failure(), "attention")
        .when(F.col("evidence_state").isin(LIMITED_STATES), "limited")
        .when(F.col("evidence_state") == "not_observable", "unknown")
        .otherwise("clear")
    )


def observations(events: DataFrame, by: list[str], limit: int = 8) -> DataFrame:
    """First protocol events of each case that carry text."""
    return leading(events.where(F.length("text") > 0), by, [F.col("uid"), F.col("ord")], limit)
