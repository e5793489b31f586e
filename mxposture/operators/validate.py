"""Constraints on tables: each function returns the rows (or fields) that break a rule."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mxposture.operators import rules as rule_ops
from mxposture.sources.rulepacks import RulePack


def unreconciled_coverage(counts: DataFrame) -> DataFrame:
    """Coverage rows whose outcome counts do not add up to the applicable count."""
    total = (
        F.col("passed_count")
        + F.col("failed_count")
        + F.col("unknown_count")
        + F.col("not_observable_count")
    )
    return counts.where(total != F.col("applicable_count"))


def mismatches(header: DataFrame, recomputed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, stated, found) for every header field that differs from the evidence."""
    right = recomputed.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields])
    joined = header.join(right, key, "full")
    parts = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f).cast("string").alias("stated"),
                    F.col(f"_r_{f}").cast("string").alias("found"),
                )
                for f in fields
            ]
        ),
        lambda p: ~p["stated"].eqNullSafe(p["found"]),
    )
    return joined.select(key, F.explode(parts).alias("_p")).select(key, "_p.*")


#: What a report's header states, and what of its evidence it must equal: name, stated, found.
REPORT_EQUALITIES = [
    ("source_capture_sha256", "manifest.source_capture_sha256", "run.capture_sha256"),
    ("configuration_digest", "manifest.configuration_digest", "run.configuration_digest"),
    ("analyzer_bundle_digest", "manifest.analyzer_bundle_digest", "run.analyzer_bundle_digest"),
    ("policy_profile", "manifest.policy_profile", "run.policy_profile"),
    ("policy_pack_version", "manifest.policy_pack_version", "run.policy_pack_version"),
    ("trust_store_digest", "manifest.trust_store_digest", "run.trust_store_digest"),
    ("assessment_state", "summary.assessment_state", "posture.assessment_state"),
    ("risk_score", "summary.risk_score", "posture.risk_score"),
    ("finding_count", "summary.finding_count", "counted.findings"),
    ("unknown_count", "summary.unknown_count", "counted.unknown_checks"),
    ("not_observable_count", "summary.not_observable_count", "counted.unseen_checks"),
    ("truncated_packets_present", "limitations.truncated_packets_present", "preflight.truncated_packets_present"),
    ("incomplete_flow_count", "limitations.incomplete_flow_count", "counted.incomplete_flows"),
    ("conflicting_flow_count", "limitations.conflicting_flow_count", "counted.conflicting_flows"),
    ("not_observable_certificate_count", "limitations.not_observable_certificate_count", "counted.unseen_certificates"),
    ("unknown_check_count", "limitations.unknown_check_count", "counted.unknown_checks"),
    ("not_observable_check_count", "limitations.not_observable_check_count", "counted.unseen_checks"),
]


def evidence_counts(
    key: str, flows: DataFrame, handshakes: DataFrame, findings: DataFrame, checks: DataFrame
) -> DataFrame:
    """(key, counted): all that reports state about their records, in one aggregate over them."""
    none = F.lit(None).cast("string")

    def part(rows: DataFrame, kind: str, state: Column) -> DataFrame:
        return rows.select(key, F.lit(kind).alias("_kind"), state.alias("_state"))

    records = (
        part(flows, "flow", F.col("reconstruction_quality"))
        .unionAll(part(handshakes, "handshake", F.col("server_certificate_state")))
        .unionAll(part(findings, "finding", none))
        .unionAll(part(checks, "check", F.col("outcome")))
    )

    def number(kind: str, state: str | None = None) -> Column:
        hit = F.col("_kind") == kind
        return F.count_if(hit if state is None else hit & (F.col("_state") == state))

    counted = F.struct(
        number("finding").alias("findings"),
        number("check", "unknown").alias("unknown_checks"),
        number("check", "not_observable").alias("unseen_checks"),
        number("flow", "incomplete").alias("incomplete_flows"),
        number("flow", "conflicting").alias("conflicting_flows"),
        number("handshake", "not_observable").alias("unseen_certificates"),
    )
    return records.groupBy(key).agg(counted.alias("counted"))


def report_violations(reports: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """(key, field, stated, found) for each of the equalities that a report breaks.

    ``reports`` has the structs manifest, run, summary, posture, limitations and preflight; null equals
    null. A report without records counts none; records without a report belong to none.
    """
    joined = reports.join(counted, key, "left")

    def found(path: str) -> Column:
        return F.coalesce(F.col(path), F.lit(0)) if path.startswith("counted.") else F.col(path)

    parts = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.col(stated).cast("string").alias("stated"),
                found(path).cast("string").alias("found"),
            )
            for name, stated, path in REPORT_EQUALITIES
        ]
    )
    broken = F.filter(parts, lambda p: ~p["stated"].eqNullSafe(p["found"]))
    return joined.select(key, F.explode(broken).alias("_p")).select(key, "_p.*")


def presence_violations(rows: DataFrame, pairs: dict[str, Column]) -> DataFrame:
    """Rows where a flag disagrees with the condition it must state: ``flag <=> condition``."""
    parts = F.filter(
        F.array(
            *[
                F.struct(F.lit(flag).alias("rule"), F.col(flag).eqNullSafe(cond).alias("ok"))
                for flag, cond in pairs.items()
            ]
        ),
        lambda p: ~p["ok"],
    )
    return rows.withColumn("_p", F.explode(parts)).withColumn("rule", F.col("_p.rule")).drop("_p")


def flatten(rows: DataFrame, key: list[str], prefix: str = "") -> DataFrame:
    """Documents to (key, path, value) rows; structs by dotted names, arrays by index."""
    schema = T.StructType([f for f in rows.schema.fields if f.name not in key])
    entries = _entries(schema, None, "")
    pairs = F.flatten(F.array(*entries))
    out = rows.select(*key, F.explode(pairs).alias("_e"))
    return out.select(*key, "_e.path", "_e.value")


def _entries(schema: T.StructType, root: Column | None, prefix: str) -> list[Column]:
    out: list[Column] = []
    for field in schema.fields:
        value = F.col(field.name) if root is None else root[field.name]
        out += _value_entries(field.dataType, value, prefix + field.name)
    return out


def _value_entries(dtype: T.DataType, value: Column, path: str) -> list[Column]:
    if isinstance(dtype, T.StructType):
        return _entries(dtype, value, path + ".")
    if isinstance(dtype, T.ArrayType):
        item = dtype.elementType

        def element(x: Column, i: Column) -> Column:
            text = F.to_json(x) if isinstance(item, (T.StructType, T.ArrayType)) else x.cast("string")
            return F.struct(
                F.concat(F.lit(path + "["), i.cast("string"), F.lit("]")).alias("path"),
                text.alias("value"),
            )

        length = F.array(
            F.struct(F.lit(path + "#").alias("path"), F.size(value).cast("string").alias("value"))
        )
        return [length, F.coalesce(F.transform(value, element), F.array().cast("array<struct<path:string,value:string>>"))]
    return [F.array(F.struct(F.lit(path).alias("path"), value.cast("string").alias("value")))]


def document_diff(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Paths that are missing, unexpected or changed between two sets of documents."""
    a = flatten(left, key).withColumnRenamed("value", "expected").withColumn("_a", F.lit(True))
    b = flatten(right, key).withColumnRenamed("value", "actual").withColumn("_b", F.lit(True))
    joined = a.join(b, [*key, "path"], "full")
    kind = (
        F.when(F.col("_b").isNull(), "missing")
        .when(F.col("_a").isNull(), "unexpected")
        .when(~F.col("expected").eqNullSafe(F.col("actual")), F.when(F.col("path").endswith("#"), "length").otherwise("changed"))
    )
    return joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).drop("_a", "_b")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """True when both frames hold the same rows the same number of times."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)


# --- inline rule tests ----------------------------------------------------------------------------


def _nested(values: dict) -> dict:
    root: dict = {
        "derived": {
            "service_role": "unclassified",
            "observed_commands": [],
            "transport_tls_established": False,
        }
    }
    for path, value in values.items():
        node = root
        *head, last = path.split(".")
        for part in head:
            node = node.setdefault(part, {})
        node[last] = value
    return root


def run_rule_tests(spark: SparkSession, pack: RulePack, tests: list[tuple]) -> DataFrame:
    """Failing tests of a pack. A test is (rule code, day, {path: value}, expected result).

    Tests are rows of the evaluation context and pass through the same compiled columns as real
    evidence. An expected pass also accepts a rule that does not apply.
    """
    import json

    schema = T.StructType(
        [
            T.StructField("test", T.IntegerType()),
            T.StructField("rule", T.StringType()),
            T.StructField("day", T.StringType()),
            T.StructField("expected", T.StringType()),
            *spark.createDataFrame([], rule_ops.CONTEXT_DDL).schema.fields,
        ]
    )
    docs = [
        (json.dumps({"test": i, "rule": c, "day": str(d if isinstance(d, (date, str)) else ""), "expected": e, **_nested(v)}),)
        for i, (c, d, v, e) in enumerate(tests)
    ]
    raw = spark.createDataFrame(docs, "doc string")
    context = raw.select(F.from_json("doc", schema).alias("d")).select("d.*")
    judged = None
    for target in dict.fromkeys(r.target for r in pack.rules):
        part = rule_ops.evaluate(context, pack, target, F.to_timestamp("day"))
        part = part.where(F.col("code") == F.col("rule")).select("test", "result", "check_outcome")
        judged = part if judged is None else judged.unionByName(part)
    out = context.select("test", "rule", "expected").join(judged, "test", "left")
    got = F.coalesce("result", F.lit("not_applicable"))
    fine = (got == F.col("expected")) | ((F.col("expected") == "pass") & (got == "not_applicable"))
    return out.where(~fine).select("test", "rule", "expected", got.alias("got"))
