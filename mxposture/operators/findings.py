"""Findings: endpoint clusters, priority scores, coverage and posture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mxposture.constants import (
    BLAST_POINTS,
    CONFIDENCE_POINTS,
    CRITICALITY_POINTS,
    EXPOSURE_POINTS,
    OUTCOME_RANK,
    RECURRENCE_CAP,
    SCORE_CAP,
    SCORE_PART_CAPS,
    SEVERITY_POINTS,
    SEVERITY_RANK,
)
from mxposture.functions.states import lookup, state_from_rank, state_rank
from mxposture.operators.scale import numbered

CLUSTER_KEYS = ["code", "affected_endpoint", "policy_profile", "policy_pack_version"]
REFERENCE_FIELDS = ["record_type", "record_key", "field_path", "evidence_state", "frame_number"]


def severity_name(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in SEVERITY_RANK.items()})


def occurrence_key(record_type: Column, record_key: Column, finding_id: Column) -> Column:
    """First reference of a finding, or the finding itself when it has none."""
    return F.when(record_key.isNotNull(), F.concat_ws(":", record_type, record_key)).otherwise(
        F.concat(F.lit("finding:"), finding_id)
    )


def with_first_reference(findings: DataFrame) -> DataFrame:
    """Flat record type and key of the first evidence reference (arrays hold at most 32)."""
    first = F.get(F.col("evidence_references"), 0)
    return findings.withColumn("record_type", first["record_type"]).withColumn(
        "record_key", first["record_key"]
    )


def session_uid(references: Column) -> Column:
    """Uid of the session behind a finding: its session reference, else the first other one."""
    sessions = F.filter(references, lambda r: r["record_type"] == "session")
    others = F.filter(
        references, lambda r: r["record_type"].isin("handshake", "flow", "certificate")
    )
    first = F.get(others, 0)
    return F.coalesce(
        F.get(sessions, 0)["record_key"],
        F.when(
            first["record_type"] == "certificate",
            F.element_at(F.split(first["record_key"], ":"), 1),
        ).otherwise(first["record_key"]),
    )


def cluster_facts(
    findings: DataFrame, carry: list[str] | None = None, by: list[str] | None = None
) -> DataFrame:
    """One row per code, endpoint, profile and pack (and ``by`` columns), without the cluster id.

    Two map-side-combined steps: first by (cluster, occurrence), which spreads a hot cluster over
    its occurrences, then by cluster.
    """
    carry = carry or []
    keys = [*(by or []), *CLUSTER_KEYS]
    neg = F.col("outcome") == "negative"
    sev, basis = lookup(F.col("severity"), SEVERITY_RANK), state_rank(F.col("basis_state"))
    parts = findings.withColumn(
        "_occ", occurrence_key(F.col("record_type"), F.col("record_key"), F.col("finding_id"))
    )
    text = F.struct("finding_id", *carry)
    has = set(findings.columns)
    first = [
        F.count(F.lit(1)).alias("_n"),
        F.max(neg).alias("_neg"),
        F.max(F.when(neg, sev)).alias("_sev_neg"),
        F.max(sev).alias("_sev_all"),
        F.min(F.when(neg, basis)).alias("_basis_neg"),
        F.min(basis).alias("_basis_all"),
        F.min(F.when(neg, text)).alias("_text_neg"),
        F.min(text).alias("_text_all"),
    ]
    second = [
        F.sum("_n").alias("recurrence_count"),
        F.count(F.lit(1)).alias("unique_occurrences"),
        F.max("_neg").alias("_neg"),
        F.max("_sev_neg").alias("_sev_neg"),
        F.max("_sev_all").alias("_sev_all"),
        F.min("_basis_neg").alias("_basis_neg"),
        F.min("_basis_all").alias("_basis_all"),
        F.min("_text_neg").alias("_text_neg"),
        F.min("_text_all").alias("_text_all"),
    ]
    if "rule_effective_from" in has:
        first.append(F.min("rule_effective_from").alias("_from"))
        second.append(F.min("_from").alias("rule_effective_from"))
    if "policy_evaluation_time" in has:
        first.append(F.max("policy_evaluation_time").alias("_time"))
        second.append(F.max("_time").alias("policy_evaluation_time"))
    grouped = parts.groupBy(*keys, "_occ").agg(*first).groupBy(*keys).agg(*second)
    chosen = F.when(F.col("_neg"), F.col("_text_neg")).otherwise(F.col("_text_all"))
    return (
        grouped.withColumn("outcome", F.when(F.col("_neg"), "negative").otherwise("indeterminate"))
        .withColumn(
            "evaluation_state", F.when(F.col("_neg"), "verified").otherwise("indeterminate")
        )
        .withColumn(
            "severity",
            severity_name(F.when(F.col("_neg"), F.col("_sev_neg")).otherwise(F.col("_sev_all"))),
        )
        .withColumn(
            "basis_state",
            state_from_rank(
                F.when(F.col("_neg"), F.col("_basis_neg")).otherwise(F.col("_basis_all"))
            ),
        )
        .withColumn("representative_id", chosen["finding_id"])
        .withColumns({c: chosen[c] for c in carry})
        .drop(*[c for c in grouped.columns if c.startswith("_")])
    )


def member_digest() -> Column:
    """Order-free digest of a group's ``finding_id``: their number and four sums over their hashes.

    It is an aggregate of sums, so a cluster of any size merges map-side and gets one kind of id.
    """
    word = [
        F.conv(F.substring(F.sha2("finding_id", 256), 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")
        for i in range(4)
    ]
    return F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[F.sum(w).cast("string") for w in word])


def cluster_ids(findings: DataFrame, clusters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``clusters`` with ``finding_id``: SHA-256 over the cluster key and its members' digest."""
    keys = [*(by or []), *CLUSTER_KEYS]
    members = findings.groupBy(*keys).agg(member_digest().alias("_members"))
    digest = F.sha2(F.concat_ws("|", F.lit("endpoint"), *CLUSTER_KEYS, F.col("_members")), 256)
    return clusters.join(members, keys).withColumn("finding_id", digest).drop("_members")


def cluster_findings(
    findings: DataFrame, carry: list[str] | None = None, by: list[str] | None = None
) -> DataFrame:
    return cluster_ids(findings, cluster_facts(findings, carry, by), by)


def cluster_members(findings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Contributing findings as rows (cluster id, member id, first reference)."""
    named = clusters.select(*CLUSTER_KEYS, F.col("finding_id").alias("cluster_id"))
    cols = ["finding_id", "record_type", "record_key"]
    return findings.select(*CLUSTER_KEYS, *cols).join(named, CLUSTER_KEYS).select("cluster_id", *cols)


def merged_references(references: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Distinct references per cluster with their place in sorted order; the first ``limit`` if given."""
    distinct = references.select(*keys, *REFERENCE_FIELDS).distinct()
    distinct = distinct.withColumn("_frame", F.coalesce(F.col("frame_number"), F.lit(0)))
    order = ["record_type", "record_key", "field_path", "evidence_state", "_frame"]
    placed = numbered(distinct, keys, order, "position").drop("_frame")
    return placed if limit is None else placed.where(F.col("position") <= limit)


def with_assets(
    clusters: DataFrame, assets: DataFrame | None, by: list[str] | None = None
) -> DataFrame:
    """Exposure, criticality and blast radius by endpoint; unknown where the inventory is silent."""
    cols = ["exposure", "asset_criticality", "blast_radius"]
    if assets is None:
        return clusters.withColumns({c: F.lit("unknown") for c in cols})
    keys = [*(by or []), "affected_endpoint"]
    inventory = assets.select(*(by or []), F.col("endpoint").alias("affected_endpoint"), *cols)
    joined = clusters.join(inventory, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in cols})


def score(clusters: DataFrame) -> DataFrame:
    """Six additive parts, capped in total."""
    repeats = F.col("unique_occurrences") - 1
    parts = {
        "score_severity": lookup(F.col("severity"), SEVERITY_POINTS, 0),
        "score_confidence": lookup(F.col("basis_state"), CONFIDENCE_POINTS, 0),
        "score_exposure": lookup(F.col("exposure"), EXPOSURE_POINTS, 0),
        "score_recurrence": F.least(
            F.lit(RECURRENCE_CAP), F.greatest(F.lit(0), repeats * 2).cast("int")
        ),
        "score_asset_criticality": lookup(F.col("asset_criticality"), CRITICALITY_POINTS, 0),
        "score_blast_radius": lookup(F.col("blast_radius"), BLAST_POINTS, 0),
    }
    out = clusters.withColumns(parts)
    total = sum((F.col(c) for c in list(parts)[1:]), F.col("score_severity"))
    return out.withColumn("score", F.least(F.lit(SCORE_CAP), total).cast("int"))


def prioritised_findings(
    findings: DataFrame,
    assets: DataFrame | None = None,
    carry: list[str] | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Clusters with their score, unordered; see :func:`priority_order`."""
    return score(with_assets(cluster_findings(findings, carry, by=by), assets, by))


def priority_order() -> list[Column]:
    return [
        F.col("score").desc(),
        lookup(F.col("outcome"), OUTCOME_RANK).asc(),
        lookup(F.col("severity"), SEVERITY_RANK).desc(),
        F.col("code"),
        F.col("affected_endpoint"),
        F.col("finding_id"),
    ]


def outcome_counts() -> list[Column]:
    outcome = F.col("outcome")
    return [
        F.count(F.lit(1)).alias("applicable_count"),
        F.count_if(outcome == "pass").alias("passed_count"),
        F.count_if(outcome == "fail").alias("failed_count"),
        F.count_if(outcome == "unknown").alias("unknown_count"),
        F.count_if(outcome == "not_observable").alias("not_observable_count"),
    ]


def coverage(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Outcome counts for overall, protocol, category and both.

    The rows are first counted once per (protocol, category); the cube runs over that handful of
    cells, so the expansion by four never touches the check table.
    """
    by = by or []
    cells = checks.groupBy(*by, "protocol", "category").agg(*outcome_counts())
    names = [
        "applicable_count",
        "passed_count",
        "failed_count",
        "unknown_count",
        "not_observable_count",
    ]
    grid = F.explode(
        F.array(
            *[
                F.struct(
                    (F.col("protocol") if p else F.lit("*")).alias("protocol"),
                    (F.col("category") if c else F.lit("*")).alias("category"),
                )
                for p in (False, True)
                for c in (False, True)
            ]
        )
    )
    spread = cells.select(*by, grid.alias("_g"), *names).select(*by, "_g.*", *names)
    return spread.groupBy(*by, "protocol", "category").agg(*[F.sum(n).alias(n) for n in names])


def assessment(applicable: Column, unknown: Column, not_observable: Column) -> Column:
    return (
        F.when(F.coalesce(applicable, F.lit(0)) == 0, "none")
        .when((unknown > 0) | (not_observable > 0), "limited")
        .otherwise("complete")
    )


def posture(scored: DataFrame, checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Assessment state, risk, finding count and coverage; one row, or one per ``by`` key."""
    by = by or []
    risk = scored.groupBy(*by).agg(
        F.max("score").alias("_max"), F.count(F.lit(1)).alias("finding_count")
    )
    counts = checks.groupBy(*by).agg(*outcome_counts())
    both = risk.unionByName(counts, allowMissingColumns=True)
    names = [c for c in both.columns if c not in by]
    joined = both.groupBy(*by).agg(*[F.max(c).alias(c) for c in names])
    joined = joined.fillna(0, [c for c in names if c != "_max"])
    state = assessment(
        F.col("applicable_count"), F.col("unknown_count"), F.col("not_observable_count")
    )
    return (
        joined.withColumn("assessment_state", state)
        .withColumn(
            "risk_score",
            F.coalesce(F.col("_max"), F.when(F.col("assessment_state") == "complete", F.lit(0))),
        )
        .drop("_max")
    )


def coverage_percent(counts: DataFrame) -> DataFrame:
    """Whole percent of applicable checks that passed; null when nothing applied."""
    share = F.col("passed_count") * 100.0 / F.nullif(F.col("applicable_count"), F.lit(0))
    return counts.withColumn("coverage_percent", F.floor(share + 0.5).cast("int"))


def coverage_segments(counts: DataFrame, by: list[str]) -> DataFrame:
    """Long form of a coverage bar: share of each outcome to one decimal, empty parts left out."""
    names = ["passed", "failed", "unknown", "not_observable"]
    labels = {"passed": "pass", "failed": "fail"}
    parts = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(labels.get(n, n)).alias("segment"), F.col(f"{n}_count").alias("part")
                )
                for n in names
            ]
        )
    )
    rows = counts.select(*by, "applicable_count", parts.alias("_p")).select(
        *by, "applicable_count", "_p.*"
    )
    return rows.where((F.col("applicable_count") > 0) & (F.col("part") > 0)).withColumn(
        "percent", F.round(100.0 * F.col("part") / F.col("applicable_count"), 1)
    )


def score_bars(scored: DataFrame) -> DataFrame:
    """Long form of the six score parts as a share of their caps."""
    parts = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("part"),
                    F.col(f"score_{name}").cast("int").alias("value"),
                    F.lit(cap).alias("cap"),
                )
                for name, cap in SCORE_PART_CAPS.items()
            ]
        )
    )
    return (
        scored.select("finding_id", parts.alias("_p"))
        .select("finding_id", "_p.*")
        .withColumn("percent", F.round(100.0 * F.col("value") / F.col("cap"), 1))
    )
