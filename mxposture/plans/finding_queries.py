"""Finding, score, coverage and posture queries over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.constants import SEVERITY_RANK
from mxposture.functions.states import lookup, weakest, weakest_agg, weakest_in_array
from mxposture.functions.text import joined_digest
from mxposture.operators import findings as ops
from mxposture.operators.scale import global_position
from mxposture.plans.adapters import VIEWS, view
from mxposture.plans.registry import query

_RANK = """CASE basis_state WHEN 'conflicting' THEN 0 WHEN 'incomplete' THEN 1 WHEN 'indeterminate' THEN 2
  WHEN 'not_observable' THEN 3 WHEN 'inferred' THEN 4 WHEN 'observed' THEN 5 ELSE 6 END"""
_SEV = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_STATES = "['conflicting','incomplete','indeterminate','not_observable','inferred','observed','verified']"

# Four sums over 48-bit words of the member ids' hashes: the same for any order of the members.
_WORDS = ", ".join(f"sum(CAST('0x' || substr(sha256(finding_id), {1 + 12 * i}, 12) AS BIGINT))" for i in range(4))

VIEWS["y_clusters"] = f"""
SELECT code, affected_endpoint, policy_profile,
  CASE WHEN bool_or(outcome = 'negative') THEN 'negative' ELSE 'indeterminate' END AS outcome,
  ['informational','low','medium','high'][1 + coalesce(max({_SEV}) FILTER (outcome = 'negative'), max({_SEV}))] AS severity,
  {_STATES}[1 + coalesce(min({_RANK}) FILTER (outcome = 'negative'), min({_RANK}))] AS basis_state,
  count(*) AS recurrence_count,
  count(DISTINCT record_type || ':' || record_key) AS unique_occurrences,
  coalesce(min(finding_id) FILTER (outcome = 'negative'), min(finding_id)) AS representative_id,
  max(evaluated_at) AS evaluated_at, min(evaluated_at) AS first_at,
  sha256(concat_ws('|', 'endpoint', code, affected_endpoint, policy_profile, 'pack-1',
         count(*), {_WORDS})) AS finding_id
FROM x_findings GROUP BY code, affected_endpoint, policy_profile
"""

VIEWS["y_scored"] = """
SELECT c.*, coalesce(exposure, 'unknown') AS exposure, coalesce(asset_criticality, 'unknown') AS asset_criticality,
  coalesce(blast_radius, 'unknown') AS blast_radius,
  CASE severity WHEN 'high' THEN 50 WHEN 'medium' THEN 30 WHEN 'low' THEN 15 ELSE 0 END AS score_severity,
  CASE basis_state WHEN 'verified' THEN 20 WHEN 'observed' THEN 16 WHEN 'inferred' THEN 12 WHEN 'incomplete' THEN 6
    WHEN 'conflicting' THEN 3 WHEN 'indeterminate' THEN 2 ELSE 0 END AS score_confidence,
  CASE exposure WHEN 'public' THEN 10 WHEN 'partner' THEN 8 WHEN 'internal' THEN 5 WHEN 'isolated' THEN 2 ELSE 4 END AS score_exposure,
  least(10, 2 * (unique_occurrences - 1)) AS score_recurrence,
  CASE asset_criticality WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 1 ELSE 2 END AS score_asset_criticality,
  CASE blast_radius WHEN 'organization' THEN 5 WHEN 'multi_asset' THEN 3 ELSE 1 END AS score_blast_radius,
  CAST(least(100, score_severity + score_confidence + score_exposure + score_recurrence
       + score_asset_criticality + score_blast_radius) AS INTEGER) AS score
FROM y_clusters c LEFT JOIN x_assets a ON c.affected_endpoint = a.endpoint
"""

_COUNTS = """count(*) AS applicable_count, count(*) FILTER (outcome = 'pass') AS passed_count,
  count(*) FILTER (outcome = 'fail') AS failed_count, count(*) FILTER (outcome = 'unknown') AS unknown_count,
  count(*) FILTER (outcome = 'not_observable') AS not_observable_count"""

VIEWS["y_coverage"] = f"""
SELECT CASE WHEN grouping(protocol) = 1 THEN '*' ELSE protocol END AS protocol,
       CASE WHEN grouping(category) = 1 THEN '*' ELSE category END AS category, {_COUNTS}
FROM x_checks GROUP BY CUBE (protocol, category)
"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        view(spark, sf_dir, "x_findings")
        .withColumn("policy_pack_version", F.lit("pack-1"))
        .withColumn("policy_evaluation_time", F.col("evaluated_at"))
        .withColumn("rule_effective_from", F.col("evaluated_at"))
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.prioritised_findings(findings(spark, sf_dir), view(spark, sf_dir, "x_assets"))


@query(
    "e1_score_findings",
    """SELECT finding_id, code, affected_endpoint, policy_profile, outcome, severity, basis_state,
       recurrence_count, unique_occurrences, exposure, asset_criticality, blast_radius, score FROM y_scored""",
)
def score_verb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(
        "finding_id",
        "code",
        "affected_endpoint",
        "policy_profile",
        "outcome",
        "severity",
        "basis_state",
        "recurrence_count",
        "unique_occurrences",
        "exposure",
        "asset_criticality",
        "blast_radius",
        "score",
    )


@query(
    "a05_cluster_findings",
    """SELECT code, affected_endpoint, policy_profile, outcome, severity, basis_state, recurrence_count,
       unique_occurrences, representative_id, CAST(evaluated_at AS VARCHAR) AS evaluated_at,
       CAST(first_at AS VARCHAR) AS first_at FROM y_clusters""",
)
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = ops.cluster_facts(findings(spark, sf_dir))
    return facts.select(
        "code",
        "affected_endpoint",
        "policy_profile",
        "outcome",
        "severity",
        "basis_state",
        "recurrence_count",
        "unique_occurrences",
        "representative_id",
        F.date_format("policy_evaluation_time", "yyyy-MM-dd HH:mm:ss").alias("evaluated_at"),
        F.date_format("rule_effective_from", "yyyy-MM-dd HH:mm:ss").alias("first_at"),
    )


@query(
    "a06_cluster_ids",
    "SELECT code, affected_endpoint, policy_profile, finding_id FROM y_clusters",
)
def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return ops.cluster_findings(rows).select(
        "code", "affected_endpoint", "policy_profile", "finding_id"
    )


@query(
    "a05_cluster_members",
    """SELECT c.finding_id AS cluster_id, f.finding_id, f.record_type, f.record_key FROM x_findings f
       JOIN y_clusters c USING (code, affected_endpoint, policy_profile)""",
)
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return ops.cluster_members(rows, ops.cluster_findings(rows))


@query(
    "u05_merged_references",
    """SELECT code, affected_endpoint, record_type, record_key, field_path, evidence_state FROM (
         SELECT *, row_number() OVER (PARTITION BY code, affected_endpoint
                  ORDER BY record_type, record_key, field_path, evidence_state) AS n
         FROM (SELECT DISTINCT code, affected_endpoint, record_type, record_key,
                 record_type || '.evidence_state' AS field_path, basis_state AS evidence_state FROM x_findings))""",
)
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = findings(spark, sf_dir).select(
        "code",
        "affected_endpoint",
        "record_type",
        "record_key",
        F.concat("record_type", F.lit(".evidence_state")).alias("field_path"),
        F.col("basis_state").alias("evidence_state"),
        F.lit(None).cast("int").alias("frame_number"),
    )
    keys = ["code", "affected_endpoint"]
    out = ops.merged_references(refs, keys)
    return out.select(*keys, "record_type", "record_key", "field_path", "evidence_state")


@query(
    "j14_asset_join",
    """SELECT affected_endpoint, exposure, asset_criticality, blast_radius, count(*) AS clusters
       FROM y_scored GROUP BY ALL""",
)
def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ops.with_assets(
        ops.cluster_facts(findings(spark, sf_dir)), view(spark, sf_dir, "x_assets")
    )
    keys = ["affected_endpoint", "exposure", "asset_criticality", "blast_radius"]
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"))


@query(
    "f33_score_parts",
    """SELECT finding_id, part, CAST(value AS INTEGER) AS value, round(100.0 * value / cap, 1) AS percent FROM (
       SELECT finding_id, unnest([
         {'part': 'severity', 'value': score_severity, 'cap': 50},
         {'part': 'confidence', 'value': score_confidence, 'cap': 20},
         {'part': 'exposure', 'value': score_exposure, 'cap': 10},
         {'part': 'recurrence', 'value': score_recurrence, 'cap': 10},
         {'part': 'asset_criticality', 'value': score_asset_criticality, 'cap': 5},
         {'part': 'blast_radius', 'value': score_blast_radius, 'cap': 5}], recursive := true)
       FROM y_scored)""",
)
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.score_bars(scored(spark, sf_dir)).drop("cap")


@query("a07_coverage_cube", "SELECT * FROM y_coverage")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coverage(view(spark, sf_dir, "x_checks"))


@query(
    "a08_posture",
    f"""SELECT CASE WHEN applicable_count = 0 THEN 'none' WHEN unknown_count + not_observable_count > 0
         THEN 'limited' ELSE 'complete' END AS assessment_state,
       (SELECT max(score) FROM y_scored) AS risk_score, (SELECT count(*) FROM y_scored) AS finding_count, c.*
       FROM (SELECT {_COUNTS} FROM x_checks) c""",
)
def posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.posture(scored(spark, sf_dir), view(spark, sf_dir, "x_checks"))


@query(
    "a08_endpoint_posture",
    f"""WITH r AS (SELECT affected_endpoint, max(score) AS m, count(*) AS finding_count FROM y_scored GROUP BY 1),
       c AS (SELECT affected_endpoint, {_COUNTS} FROM x_checks GROUP BY 1)
       SELECT affected_endpoint, coalesce(applicable_count, 0) AS applicable_count,
         coalesce(finding_count, 0) AS finding_count, coalesce(m, -1) AS risk_score,
         CASE WHEN coalesce(applicable_count, 0) = 0 THEN 'none'
              WHEN unknown_count + not_observable_count > 0 THEN 'limited' ELSE 'complete' END AS assessment_state
       FROM r FULL JOIN c USING (affected_endpoint)""",
)
def endpoint_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.posture(scored(spark, sf_dir), view(spark, sf_dir, "x_checks"), ["affected_endpoint"])
    return out.select(
        "affected_endpoint",
        "applicable_count",
        "finding_count",
        F.coalesce("risk_score", F.lit(-1)).alias("risk_score"),
        "assessment_state",
    )


@query(
    "a14_coverage_percent",
    """SELECT protocol, category, CAST(floor(100.0 * passed_count / applicable_count + 0.5) AS INTEGER) AS coverage_percent
       FROM y_coverage""",
)
def percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.coverage(view(spark, sf_dir, "x_checks"))
    return ops.coverage_percent(counts).select("protocol", "category", "coverage_percent")


@query(
    "a14_coverage_segments",
    """SELECT protocol, category, segment, part, round(100.0 * part / applicable_count, 1) AS percent FROM (
       SELECT protocol, category, applicable_count, unnest([{'segment': 'pass', 'part': passed_count},
         {'segment': 'fail', 'part': failed_count}, {'segment': 'unknown', 'part': unknown_count},
         {'segment': 'not_observable', 'part': not_observable_count}], recursive := true) FROM y_coverage)
       WHERE part > 0""",
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.coverage(view(spark, sf_dir, "x_checks"))
    return ops.coverage_segments(counts, ["protocol", "category"]).drop("applicable_count")


@query(
    "a31_weakest_state",
    f"""SELECT affected_endpoint, {_STATES}[1 + min({_RANK})] AS weakest,
        {_STATES}[1 + min(least({_RANK}, 4))] AS weakest_pair FROM x_findings GROUP BY 1""",
)
def weakest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    pair = weakest([F.col("basis_state"), F.lit("inferred")])
    listed = weakest_in_array(F.array(F.col("basis_state"), F.lit("verified")))
    return (
        rows.withColumn("_p", pair)
        .withColumn("_l", listed)
        .groupBy("affected_endpoint")
        .agg(weakest_agg(F.col("_l")).alias("weakest"), weakest_agg(F.col("_p")).alias("weakest_pair"))
    )


@query(
    "f31_finding_ids",
    """SELECT finding_id, sha256(concat_ws('|', policy_profile, 'pack-1', code, outcome, record_type, record_key)) AS digest
       FROM x_findings""",
)
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["policy_profile", "policy_pack_version", "code", "outcome", "record_type", "record_key"]
    return findings(spark, sf_dir).select(
        "finding_id", joined_digest(*[F.col(c) for c in cols]).alias("digest")
    )


@query(
    "f34_occurrence_keys",
    """SELECT finding_id, record_type || ':' || record_key AS occurrence,
       CASE WHEN record_type = 'session' THEN record_key ELSE 's' || record_key END AS session_uid
       FROM x_findings""",
)
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    ref = F.struct("record_type", "record_key")
    extra = F.struct(
        F.lit("session").alias("record_type"),
        F.concat(F.lit("s"), F.col("record_key")).alias("record_key"),
    )
    refs = rows.select(
        "finding_id",
        F.when(F.col("record_type") == "session", F.array(ref))
        .otherwise(F.array(ref, extra))
        .alias("evidence_references"),
    )
    flat = ops.with_first_reference(refs)
    return flat.select(
        "finding_id",
        ops.occurrence_key(F.col("record_type"), F.col("record_key"), F.col("finding_id")).alias(
            "occurrence"
        ),
        ops.session_uid(F.col("evidence_references")).alias("session_uid"),
    )


@query(
    "t03_priority_order",
    """SELECT row_number() OVER (ORDER BY score DESC, CASE outcome WHEN 'negative' THEN 0 ELSE 1 END,
         CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC,
         code, affected_endpoint, finding_id) AS position, finding_id, score
       FROM y_scored""",
)
def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return global_position(rows, ops.priority_order()).select("position", "finding_id", "score")


@query(
    "t02_finding_order",
    """SELECT row_number() OVER (ORDER BY affected_endpoint,
         CASE record_type WHEN 'flow' THEN 0 WHEN 'session' THEN 1 WHEN 'handshake' THEN 2 ELSE 3 END,
         record_key, code, outcome, finding_id) AS position, finding_id FROM x_findings""",
)
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.constants import TARGET_RANK

    keys = [
        F.col("affected_endpoint"),
        lookup(F.col("record_type"), TARGET_RANK, 9),
        F.col("record_key"),
        F.col("code"),
        F.col("outcome"),
        F.col("finding_id"),
    ]
    return global_position(findings(spark, sf_dir), keys).select("position", "finding_id")


@query(
    "a12_severity_histogram",
    """SELECT s.severity, count(y.finding_id) AS findings FROM (VALUES ('high'), ('medium'), ('low'), ('informational'))
       s(severity) LEFT JOIN y_scored y USING (severity) GROUP BY 1""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All four buckets always appear: a conditional count per bucket, then one row each.
    rows = ops.cluster_facts(findings(spark, sf_dir))
    wide = rows.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])
    return wide.unpivot([], list(SEVERITY_RANK), "severity", "findings")


@query("a28_distinct_codes", "SELECT DISTINCT code FROM x_findings")
def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        findings(spark, sf_dir)
        .groupBy("code")
        .agg(F.min("finding_id").alias("_first"))
        .orderBy("_first")
        .select("code")
    )
