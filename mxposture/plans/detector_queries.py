"""Endpoint-window, detector and evaluation queries over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.constants import (
    ADVISORY_CODE,
    ADVISORY_DEFAULT,
    EVIDENCE_FIELD,
    FOREST_MIN_TRAIN,
    RATE_FEATURES,
    Z_THRESHOLD,
)
from mxposture.constants import MIN_HISTORY as DEFAULT_HISTORY
from mxposture.operators import detect, evaluate
from mxposture.operators import windows as ops
from mxposture.operators.history import with_past
from mxposture.operators.scale import cumulative_share, exact_quantiles
from mxposture.plans.adapters import VIEWS, table, view
from mxposture.plans.flow_queries import built_flows
from mxposture.plans.handshake_queries import built_handshakes
from mxposture.plans.registry import query
from mxposture.plans.rule_queries import built_sessions
from mxposture.operators.certificates import leaf_per_uid
from mxposture.plans.certificate_queries import certificates

# The daily view carries these five rates; the other rates of a window are zero there.
FEATURES = [
    "tls13_share",
    "tls12_share",
    "handshake_failure_rate",
    "alert_rate",
    "starttls_fallback_rate",
]
MIN_SUPPORT, MIN_HISTORY, WARMUP = 1, 5, 10

VIEWS["x_maintenance"] = """
SELECT DISTINCT CAST(user_id AS STRING) AS endpoint_id, 17 AS start_day, 19 AS end_day FROM events WHERE user_id % 25 = 3
"""
VIEWS["x_new"] = "SELECT DISTINCT CAST(user_id AS STRING) AS endpoint_id FROM events WHERE user_id % 29 = 0"
VIEWS["x_jitter"] = "SELECT DISTINCT CAST(user_id AS STRING) AS endpoint_id FROM events WHERE user_id % 10 = 5"
VIEWS["x_scores"] = """
SELECT endpoint_id, day_index, 'simple' AS detector,
       handshake_failure_rate * 8 + alert_rate * 4 + (day_index % 3) * 0.25E0 AS score, 6.0E0 AS threshold,
       handshake_failure_rate * 8 + alert_rate * 4 + (day_index % 3) * 0.25E0 >= 6.0E0 AS above_threshold,
       in_maintenance AS suppressed,
       CASE WHEN day_index < 3 THEN 'insufficient_history' END AS skip_reason
FROM x_daily
"""
VIEWS["x_scores_b"] = """
SELECT endpoint_id, day_index, 'other' AS detector,
       tls12_share * 5 + starttls_fallback_rate * 6 + (day_index % 2) * 0.5E0 AS score, 5.0E0 AS threshold,
       tls12_share * 5 + starttls_fallback_rate * 6 + (day_index % 2) * 0.5E0 >= 5.0E0 AS above_threshold,
       in_maintenance AS suppressed,
       CASE WHEN day_index < 4 THEN 'insufficient_history' END AS skip_reason
FROM x_daily
"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "x_daily")
    missing = [n for n in RATE_FEATURES if n not in rows.columns]
    return rows.withColumns(
        {
            **{n: F.lit(0.0) for n in missing},
            "is_new_endpoint": F.lit(False),
            "capture_quality_ok": F.lit(True),
        }
    )


def labels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "events": view(spark, sf_dir, "x_labels"),
        "maintenance": view(spark, sf_dir, "x_maintenance"),
        "new_endpoints": view(spark, sf_dir, "x_new"),
        "jitter": view(spark, sf_dir, "x_jitter"),
    }


# --- checking SQL: past-only statistics -------------------------------------------------------------

_W = "w AS (PARTITION BY endpoint_id ORDER BY day_index RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _feature_sql(name: str) -> str:
    return f"""coalesce(quantile_cont(CAST({name} AS DOUBLE), 0.5) OVER w, 0) AS med_{name},
       coalesce(list(CAST({name} AS DOUBLE)) OVER w, []) AS past_{name}"""


VIEWS["y_history"] = f"""
SELECT *, count(*) OVER w AS history_count, {', '.join(_feature_sql(n) for n in FEATURES)} FROM x_daily WINDOW {_W}
"""


def _score_sql(n: str) -> str:
    mad = f"coalesce(list_aggregate(list_transform(past_{n}, lambda x: abs(x - med_{n})), 'median'), 0)"
    return f"""greatest(-30.0, least(30.0, ({n} - med_{n}) / greatest({mad} * 1.4826, 0.01))) AS z_{n},
      list_reduce(list_append(past_{n}, CAST({n} AS DOUBLE)), lambda a, x: struct_pack(n := a.n + 1, m := a.m + (x.v - a.m) / (a.n + 1),
        s := greatest(0.0, a.s + x.v - (a.m + (x.v - a.m) / (a.n + 1)) - 0.02), v := 0.0),
        struct_pack(n := 0.0, m := 0.0, s := 0.0, v := 0.0)).s / 0.5 AS drift_{n}"""


def _score_sql_rows(n: str) -> str:
    # list_reduce folds structs: the series is wrapped first.
    return _score_sql(n).replace(
        f"list_append(past_{n}, CAST({n} AS DOUBLE))",
        f"list_transform(list_append(past_{n}, CAST({n} AS DOUBLE)), lambda x: struct_pack(n := 0.0, m := 0.0, s := 0.0, v := x))",
    )


VIEWS["y_robust"] = f"SELECT *, {', '.join(_score_sql_rows(n) for n in FEATURES)} FROM y_history"

_PEERS = "PARTITION BY site_id, protocol_role{} ORDER BY day_index RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
VIEWS["y_rarity"] = f"""
SELECT *, count(*) OVER ({_PEERS.format('')}) AS peer_n,
  count(*) OVER ({_PEERS.format(', issuer_id')}) AS count_issuer_id,
  count(*) OVER ({_PEERS.format(', dominant_tls_version')}) AS count_dominant_tls_version,
  -ln((count_issuer_id + 0.5) / (peer_n + 0.5)) AS rarity_issuer_id,
  -ln((count_dominant_tls_version + 0.5) / (peer_n + 0.5)) AS rarity_dominant_tls_version
FROM y_robust
"""
VIEWS["y_baseline"] = f"""
SELECT *, CASE WHEN in_maintenance THEN NULL WHEN session_count < {MIN_SUPPORT} THEN 'insufficient_support'
    WHEN history_count < {MIN_HISTORY} THEN 'insufficient_history' END AS skip,
  CASE WHEN in_maintenance OR history_count < {MIN_HISTORY} THEN 0.0 ELSE
    greatest({', '.join(f'abs(z_{n}), drift_{n}' for n in FEATURES)}, rarity_issuer_id, rarity_dominant_tls_version) END AS score
FROM y_rarity
"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_past(daily(spark, sf_dir), FEATURES, ["issuer_id", "dominant_tls_version"])


@query("w01_past_history", "SELECT endpoint_id, day_index, history_count, round(med_tls13_share, 6) AS med FROM y_history")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_past(daily(spark, sf_dir), ["tls13_share"])
    return out.select("endpoint_id", "day_index", "history_count", F.round("med_tls13_share", 6).alias("med"))


@query(
    "w02_robust_z",
    "SELECT endpoint_id, day_index, " + ", ".join(f"round(z_{n}, 5) + 0 AS z_{n}" for n in FEATURES) + " FROM y_robust",
)
def robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.with_robust_scores(_history(spark, sf_dir), FEATURES)
    return out.select(
        "endpoint_id", "day_index", *[(F.round(f"z_{n}", 5) + 0.0).alias(f"z_{n}") for n in FEATURES]
    )


@query(
    "w03_drift",
    "SELECT endpoint_id, day_index, " + ", ".join(f"round(drift_{n}, 5) AS drift_{n}" for n in FEATURES) + " FROM y_robust",
)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _history(spark, sf_dir)
    return out.select(
        "endpoint_id",
        "day_index",
        *[
            F.round(f"drift_{n}", 5).alias(f"drift_{n}")
            for n in FEATURES
        ],
    )


@query(
    "w04_categorical_rarity",
    """SELECT endpoint_id, day_index, peer_n, count_issuer_id, count_dominant_tls_version, round(rarity_issuer_id, 6) + 0 AS rarity_issuer_id,
       round(rarity_dominant_tls_version, 6) + 0 AS rarity_dominant_tls_version, peer_n > 0 AND count_issuer_id = 0 AS first_issuer_id FROM y_rarity""",
)
def rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.with_rarity(_history(spark, sf_dir))
    return out.select(
        "endpoint_id",
        "day_index",
        "peer_n",
        F.col("count_issuer_id").cast("bigint").alias("count_issuer_id"),
        F.col("count_dominant_tls_version").cast("bigint").alias("count_dominant_tls_version"),
        (F.round("rarity_issuer_id", 6) + 0.0).alias("rarity_issuer_id"),
        (F.round("rarity_dominant_tls_version", 6) + 0.0).alias("rarity_dominant_tls_version"),
        "first_issuer_id",
    )


@query(
    "w05_first_seen_value",
    f"""SELECT endpoint_id, day_index, history_count > 0 AND count(*) OVER (PARTITION BY endpoint_id, issuer_id ORDER BY day_index
        RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS first_seen FROM y_history""",
)
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _history(spark, sf_dir)
    seen = (F.col("history_count") > 0) & (F.col("seen_issuer_id") == 0)
    return out.select("endpoint_id", "day_index", seen.alias("first_seen"))


@query(
    "w06_day_percentile",
    """SELECT endpoint_id, day_index, round(100 * cume_dist() OVER (PARTITION BY day_index ORDER BY round(score, 9)), 6) AS percentile
       FROM x_scores WHERE skip_reason IS NULL AND NOT suppressed""",
)
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = view(spark, sf_dir, "x_scores").where("skip_reason IS NULL AND NOT suppressed")
    live = live.withColumn("score", F.round("score", 9))
    share = cumulative_share(
        live, ["day_index"], "score", F.floor(F.col("score") * 8).cast("bigint"), "percentile"
    )
    return live.join(share, ["day_index", "score"]).select(
        "endpoint_id", "day_index", F.round("percentile", 6).alias("percentile")
    )


@query(
    "w07_endpoint_peaks",
    f"""SELECT endpoint_id, round(max(score), 6) AS score FROM x_scores WHERE day_index >= {WARMUP} AND skip_reason IS NULL
        AND NOT suppressed AND endpoint_id NOT IN (SELECT endpoint_id FROM x_new) GROUP BY 1""",
)
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.peaks(view(spark, sf_dir, "x_scores"), WARMUP, view(spark, sf_dir, "x_new"))
    return out.select("endpoint_id", F.round("score", 6).alias("score"))


@query(
    "w08_first_alerts",
    """SELECT endpoint_id, detector, day_index FROM (SELECT *, row_number() OVER (PARTITION BY endpoint_id, detector ORDER BY score DESC, day_index) AS n
       FROM (SELECT * REPLACE (round(score, 9) AS score) FROM x_scores UNION ALL SELECT * REPLACE (round(score, 9) AS score) FROM x_scores_b)
       WHERE above_threshold AND NOT suppressed AND skip_reason IS NULL) WHERE n = 1""",
)
def first_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = view(spark, sf_dir, "x_scores").unionByName(view(spark, sf_dir, "x_scores_b"))
    none = F.array().cast(detect._EMPTY_PARTS)
    both = both.withColumns(
        {
            "score": F.round("score", 9),
            "percentile": F.lit(None).cast("double"),
            "contributions": none,
            "reason": F.lit(""),
            "model_digest": F.lit(""),
        }
    )
    return detect.anomalies(both).select("endpoint_id", "detector", "day_index")


@query(
    "a20_median_mad",
    """SELECT event_type, round(median(value), 6) AS med, round(mad(value), 6) AS mad FROM events GROUP BY 1""",
)
def median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "value")
    med = exact_quantiles(events, ["event_type"], "value", {"med": 0.5})
    away = events.join(med, "event_type").withColumn("away", F.abs(F.col("value") - F.col("med")))
    mad = exact_quantiles(away, ["event_type"], "away", {"mad": 0.5})
    return med.join(mad, "event_type").select(
        "event_type", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad")
    )


@query(
    "a21_feature_scaling",
    """SELECT dim, round(median(v), 6) AS med, round(greatest(mad(v), 1e-6), 6) AS mad FROM (
       SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY dim""",
)
def scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit(0).cast("bigint").alias("fit_day"), F.col("embedding").cast("array<double>").alias("vector")
    )
    scales = detect.Forest()._scales(rows)
    dims = scales.select(F.posexplode(F.arrays_zip("med", "mad")).alias("dim", "x"))
    return dims.select(
        "dim", F.round("x.med", 6).alias("med"), F.round("x.mad", 6).alias("mad")
    )


@query(
    "a22_interpolated_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
       round(quantile_cont(value, 0.992), 6) AS p992 FROM events GROUP BY 1""",
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_quantiles(
        table(spark, sf_dir, "events"),
        ["event_type"],
        "value",
        {"p50": 0.5, "p90": 0.9, "p992": 0.992},
    )
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p992")])


_TOP = f"""SELECT endpoint_id, score FROM (SELECT endpoint_id, round(max(score), 9) AS score FROM {{s}} WHERE day_index >= {WARMUP}
   AND skip_reason IS NULL AND NOT suppressed AND endpoint_id NOT IN (SELECT endpoint_id FROM x_new) GROUP BY 1)
   ORDER BY score DESC, endpoint_id LIMIT {{k}}"""


@query(
    "a23_precision_at_k",
    "SELECT count(*) FILTER (endpoint_id IN (SELECT endpoint_id FROM x_labels)) / 40.0::DOUBLE AS precision_at_k FROM ("
    + _TOP.format(s="x_scores", k=40)
    + ")",
)
def precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = evaluate.peaks(view(spark, sf_dir, "x_scores"), WARMUP, view(spark, sf_dir, "x_new"))
    top = top.withColumn("score", F.round("score", 9))
    return evaluate.precision_at_k(top, view(spark, sf_dir, "x_labels"), 40)


@query(
    "a23_document_precision",
    """SELECT sum(quality) / 25.0::DOUBLE AS precision_at_k FROM (SELECT quality FROM labels JOIN documents USING (doc_id)
       ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR) LIMIT 25)""",
)
def document_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same review measure with labelled documents: longest texts first, quality as truth."""
    truth = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    ranked = truth.join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("endpoint_id"), F.col("n_chars").alias("score"), "quality"
    )
    good = ranked.where("quality = 1").select("endpoint_id")
    return evaluate.precision_at_k(ranked.drop("quality"), good, 25)


VIEWS["y_alerts"] = (
    "SELECT DISTINCT endpoint_id, day_index FROM x_scores WHERE above_threshold AND NOT suppressed AND skip_reason IS NULL"
)
VIEWS["y_alerts_b"] = VIEWS["y_alerts"].replace("x_scores", "x_scores_b")
VIEWS["y_labelled_days"] = (
    "SELECT DISTINCT endpoint_id, unnest(range(start_day, end_day + 1)) AS day_index FROM x_labels"
)
VIEWS["y_maintenance_days"] = (
    "SELECT DISTINCT endpoint_id, unnest(range(start_day, end_day + 1)) AS day_index FROM x_maintenance"
)
VIEWS["y_population"] = f"""
SELECT p.endpoint_id, p.day_index, a.day_index IS NOT NULL AS fired, l.day_index IS NOT NULL AS labelled, m.day_index IS NOT NULL AS kept
FROM (SELECT endpoint_id, day_index FROM x_daily WHERE day_index >= {WARMUP}) p LEFT JOIN y_alerts a USING (endpoint_id, day_index)
LEFT JOIN y_labelled_days l USING (endpoint_id, day_index) LEFT JOIN y_maintenance_days m USING (endpoint_id, day_index)
"""


def _delays(alerts: str) -> str:
    return f"""SELECT e.event_id, any_value(e.kind) AS kind, min(a.day_index - e.start_day) AS delay FROM x_labels e
     LEFT JOIN {alerts} a ON a.endpoint_id = e.endpoint_id AND a.day_index BETWEEN e.start_day AND e.start_day + 2 GROUP BY e.event_id"""


VIEWS["y_delays"] = _delays("y_alerts")
VIEWS["y_delays_b"] = _delays("y_alerts_b")


@query("j20_interval_membership", "SELECT endpoint_id, day_index, fired, labelled, kept FROM y_population")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["endpoint_id", "day_index"]
    base = view(spark, sf_dir, "x_daily").where(F.col("day_index") >= WARMUP).select(*key)
    marks = {
        "fired": evaluate.alert_days(view(spark, sf_dir, "x_scores")),
        "labelled": evaluate.interval_days(view(spark, sf_dir, "x_labels")),
        "kept": evaluate.interval_days(view(spark, sf_dir, "x_maintenance")),
    }
    for name, days in marks.items():
        base = base.join(days.withColumn(name, F.lit(True)), key, "left")
    return base.fillna(False, list(marks))


@query("j21_detection_delays", "SELECT event_id, kind, coalesce(delay, -1) AS delay FROM y_delays")
def delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.detection_delays(view(spark, sf_dir, "x_scores"), view(spark, sf_dir, "x_labels"))
    return out.fillna({"delay": -1})


@query(
    "j22_merged_delays",
    """SELECT event_id, coalesce(a.kind, b.kind) AS kind, coalesce(least(a.delay, b.delay), -1) AS delay FROM y_delays a
       FULL JOIN y_delays_b b USING (event_id)""",
)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "x_labels")
    left = evaluate.detection_delays(view(spark, sf_dir, "x_scores"), events)
    right = evaluate.detection_delays(view(spark, sf_dir, "x_scores_b"), events)
    return evaluate.merge_delays(left, right).fillna({"delay": -1})


@query(
    "a24_alert_rates",
    """SELECT round(1000.0 * count(*) FILTER (fired) / count(*), 6) AS alerts_per_1000,
       round(count(*) FILTER (fired AND NOT kept AND NOT labelled) / count(*) FILTER (NOT kept AND NOT labelled), 6) AS clean_alert_rate,
       round(coalesce(count(*) FILTER (fired AND kept) / nullif(count(*) FILTER (kept), 0), 0), 6) AS maintenance_alert_rate,
       count(*) FILTER (fired AND endpoint_id IN (SELECT endpoint_id FROM x_new)) AS new_endpoint_alerts FROM y_population""",
)
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = labels(spark, sf_dir)
    out = evaluate.alert_rates(
        view(spark, sf_dir, "x_scores"),
        daily(spark, sf_dir),
        named["events"],
        named["maintenance"],
        named["new_endpoints"],
        WARMUP,
    )
    cols = ["alerts_per_1000", "clean_alert_rate", "maintenance_alert_rate"]
    return out.select(*[F.round(c, 6).alias(c) for c in cols], "new_endpoint_alerts")


@query(
    "a25_detector_summary",
    "SELECT (SELECT count(*) FILTER (endpoint_id IN (SELECT endpoint_id FROM x_labels)) / 5.0::DOUBLE FROM ("
    + _TOP.format(s="x_scores", k=5)
    + ")) AS precision_at_k, (SELECT quantile_cont(delay, 0.5) FROM y_delays) AS median_delay,"
    " (SELECT round(quantile_cont(delay, 0.9), 6) FROM y_delays) AS p90_delay, (SELECT count(delay) FROM y_delays) AS detected",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = view(spark, sf_dir, "x_scores").withColumn("score", F.round("score", 9))
    out = evaluate.summarize(scores, daily(spark, sf_dir), labels(spark, sf_dir), "simple", 5, WARMUP)
    return out.select(
        "precision_at_k", "median_delay", F.round("p90_delay", 6).alias("p90_delay"), "detected"
    )


def _lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = labels(spark, sf_dir)
    a = evaluate.peaks(view(spark, sf_dir, "x_scores"), WARMUP, named["new_endpoints"])
    b = evaluate.peaks(view(spark, sf_dir, "x_scores_b"), WARMUP, named["new_endpoints"])
    return evaluate.bootstrap_lifts(a, b, named["events"], named["jitter"])


@query("a26_bootstrap_lift")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.lift_interval(_lifts(spark, sf_dir))


@query("m5_compare_detectors")
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare(
        daily(spark, sf_dir),
        labels(spark, sf_dir),
        view(spark, sf_dir, "x_scores"),
        view(spark, sf_dir, "x_scores_b"),
        warmup=WARMUP,
    )


@query(
    "a27_delay_gate",
    """SELECT count(*) > 0 AND count(*) FILTER (delay IS NULL OR delay > 2) = 0 AS detection_delay FROM y_delays WHERE kind = 'univariate'""",
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.detection_delays(view(spark, sf_dir, "x_scores"), view(spark, sf_dir, "x_labels"))
    return evaluate.delay_gate(out)


@query(
    "p16_eligible_scores",
    f"SELECT endpoint_id, day_index FROM x_scores WHERE day_index >= {WARMUP} AND skip_reason IS NULL AND NOT suppressed",
)
def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.eligible(view(spark, sf_dir, "x_scores"), WARMUP).select("endpoint_id", "day_index")


@query(
    "u02_anchor_sets",
    f"""SELECT endpoint_id, endpoint_id IN (SELECT endpoint_id FROM x_labels UNION SELECT endpoint_id FROM x_jitter) AS anchor
        FROM (SELECT DISTINCT endpoint_id FROM x_scores WHERE day_index >= {WARMUP} AND NOT suppressed AND skip_reason IS NULL)""",
)
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = labels(spark, sf_dir)
    present = evaluate.eligible(view(spark, sf_dir, "x_scores"), WARMUP).select("endpoint_id").distinct()
    marked = named["events"].select("endpoint_id").union(named["jitter"])
    both = present.intersect(marked).withColumn("anchor", F.lit(True))
    rest = present.join(marked, "endpoint_id", "left_anti").withColumn("anchor", F.lit(False))
    return both.unionByName(rest)


@query("f45_null_scores")
def null_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.null_scores(daily(spark, sf_dir)).select("endpoint_id", "day_index", "score", "suppressed")


@query(
    "f36_skip_reasons",
    """SELECT endpoint_id, day_index, CASE WHEN session_count < 3 THEN 'insufficient_support' WHEN history_count < 14 THEN 'insufficient_history'
       WHEN handshake_failure_rate > 0.4 THEN 'capture_quality' ELSE '' END AS skip_reason FROM y_history""",
)
def skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir).withColumn("incomplete_reconstruction_rate", F.col("handshake_failure_rate"))
    return rows.select(
        "endpoint_id", "day_index", F.coalesce(ops.skip_reason(3, 14), F.lit("")).alias("skip_reason")
    )


def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.Baseline(FEATURES, MIN_SUPPORT, MIN_HISTORY).score(daily(spark, sf_dir))


@query(
    "m1_baseline_scores",
    """SELECT endpoint_id, day_index, round(score, 5) AS score, coalesce(skip, '') AS skip_reason, in_maintenance AS suppressed,
       skip IS NULL AND NOT in_maintenance AND score >= 3.5 AS above_threshold FROM y_baseline""",
)
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_scores(spark, sf_dir).select(
        "endpoint_id",
        "day_index",
        F.round("score", 5).alias("score"),
        F.coalesce("skip_reason", F.lit("")).alias("skip_reason"),
        "suppressed",
        "above_threshold",
    )


_PARTS = ", ".join(
    [f"{{'feature': '{n}', 'score': greatest(abs(z_{n}), drift_{n})}}" for n in FEATURES]
    + [f"{{'feature': '{n}', 'score': rarity_{n}}}" for n in ("issuer_id", "dominant_tls_version")]
)


@query(
    "t06_top_contributions",
    f"""SELECT endpoint_id, day_index, string_agg(feature, ',' ORDER BY n) AS features FROM (
        SELECT endpoint_id, day_index, feature, row_number() OVER (PARTITION BY endpoint_id, day_index ORDER BY round(score, 9) DESC, feature) AS n
        FROM (SELECT endpoint_id, day_index, unnest([{_PARTS}], recursive := true) FROM y_baseline WHERE skip IS NULL AND NOT in_maintenance))
        WHERE n <= 3 GROUP BY 1, 2""",
)
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.prepare(daily(spark, sf_dir), FEATURES, MIN_SUPPORT, MIN_HISTORY)
    parts = [ops.numeric_part(n, F.round(f"score_{n}", 9), F.col(f"med_{n}")) for n in FEATURES]
    rows = rows.withColumns({f"rarity_{n}": F.round(f"rarity_{n}", 9) for n in ("issuer_id", "dominant_tls_version")})
    parts += [ops.rarity_part(n) for n in ("issuer_id", "dominant_tls_version")]
    live = rows.where("skip_reason IS NULL AND NOT in_maintenance")
    top = ops.top_parts(parts)
    return live.select(
        "endpoint_id",
        "day_index",
        F.array_join(F.transform(top, lambda c: c["feature"]), ",").alias("features"),
    )


def _four_digits(value: str) -> str:
    # Rounded half up from the shortest decimal form, as the report's formatter does.
    return f"CAST(CAST(round(CAST(CAST(CAST({value} AS DOUBLE) AS VARCHAR) AS DECIMAL(30, 18)), 4) AS DECIMAL(18, 4)) AS VARCHAR)"


_REASON_PARTS = ", ".join(
    [
        f"""{{'feature': '{n}', 'score': greatest(abs(z_{n}), drift_{n}), 'evidence': '{EVIDENCE_FIELD.get(n, 'session.uid')}',
            'text': '{n}=' || {_four_digits(n)} || ', usually ' || {_four_digits('med_' + n)}}}"""
        for n in FEATURES
    ]
    + [
        f"""{{'feature': '{n}', 'score': rarity_{n}, 'evidence': '{EVIDENCE_FIELD[n]}', 'text': '{n}=' || {n} || ', peer_count=' || count_{n}}}"""
        for n in ("issuer_id", "dominant_tls_version")
    ]
)
VIEWS["y_reasons"] = f"""
WITH p AS (SELECT endpoint_id, day_index, unnest([{_REASON_PARTS}], recursive := true) FROM y_baseline WHERE skip IS NULL AND NOT in_maintenance),
 t AS (SELECT *, row_number() OVER (PARTITION BY endpoint_id, day_index ORDER BY score DESC, feature) AS n FROM p QUALIFY n <= 3),
 e AS (SELECT endpoint_id, day_index, string_agg(evidence, ', ' ORDER BY n) AS evidence FROM (
   SELECT endpoint_id, day_index, evidence, min(n) AS n FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2),
 r AS (SELECT endpoint_id, day_index, string_agg(text, '; ' ORDER BY n) AS body, min_by(feature, n) AS top_feature FROM t GROUP BY 1, 2)
SELECT b.endpoint_id, b.day_index, b.score, b.skip, b.in_maintenance, top_feature,
  CASE WHEN b.in_maintenance THEN '{detect._MAINTENANCE}' WHEN b.skip IS NOT NULL THEN b.skip || ' [evidence: session.uid]'
       ELSE body || ' [evidence: ' || evidence || ']' END AS reason
FROM y_baseline b LEFT JOIN r USING (endpoint_id, day_index) LEFT JOIN e USING (endpoint_id, day_index)
"""
_DIGEST = detect.Baseline(FEATURES, MIN_SUPPORT, MIN_HISTORY).digest
_ADVISORIES = f"""SELECT sha256(endpoint_id || '|' || day_index || '|baseline|{_DIGEST}|' || reason) AS anomaly_id,
    CASE top_feature {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ADVISORY_CODE.items())} ELSE '{ADVISORY_DEFAULT}' END AS code,
    endpoint_id, 'baseline' AS detector, day_index, reason, score
  FROM y_reasons WHERE skip IS NULL AND NOT in_maintenance AND score >= {Z_THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY endpoint_id ORDER BY score DESC, day_index) = 1"""


@query("f37_reason_text", "SELECT endpoint_id, day_index, reason FROM y_reasons")
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_scores(spark, sf_dir).select("endpoint_id", "day_index", "reason")


@query("f38_advisories", f"SELECT anomaly_id, code, endpoint_id, detector, day_index, reason FROM ({_ADVISORIES})")
def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.anomalies(baseline_scores(spark, sf_dir))
    return found.select("anomaly_id", "code", "endpoint_id", "detector", "day_index", "reason")


_SECTION = f"""WITH n AS (SELECT count(*) AS n FROM x_daily), a AS ({_ADVISORIES}),
  i AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, endpoint_id, day_index) AS INTEGER) AS position, code, reason FROM a)
SELECT 0 AS position, 'ADVISORY_INSUFFICIENT_HISTORY' AS code, 'History holds ' || n || ' endpoint windows; the baseline needs {DEFAULT_HISTORY} and the forest {FOREST_MIN_TRAIN}.' AS reason
  FROM n WHERE n < {DEFAULT_HISTORY}
UNION ALL SELECT 0, 'ADVISORY_INSUFFICIENT_HISTORY', 'The forest needs {FOREST_MIN_TRAIN} training windows; ' || n || ' are stored. The baseline ran.'
  FROM n WHERE n >= {DEFAULT_HISTORY} AND n < {FOREST_MIN_TRAIN}
UNION ALL SELECT 0, 'ADVISORY_NONE', 'Scoring ran; no endpoint window met the review threshold.' FROM n WHERE n >= {FOREST_MIN_TRAIN} AND NOT EXISTS (SELECT 1 FROM i)
UNION ALL SELECT i.* FROM i, n WHERE n >= {DEFAULT_HISTORY}"""


@query("f39_advisory_section", _SECTION)
def advisory_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.anomalies(baseline_scores(spark, sf_dir))
    return detect.advisory_items(found, daily(spark, sf_dir).count())


def forest(**kw) -> detect.Forest:
    return detect.Forest(features=FEATURES, min_support=MIN_SUPPORT, min_history=MIN_HISTORY, **kw)


@query("m2_isolation_forest")
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forest().score(daily(spark, sf_dir))
    return out.select(
        "endpoint_id", "day_index", "score", "threshold", "above_threshold", "skip_reason", "percentile", "reason"
    )


@query(
    "f46_feature_vector",
    f"""SELECT endpoint_id, day_index, {len(RATE_FEATURES) + len(FEATURES) + 9} AS dims,
        round(tls13_share + tls12_share + handshake_failure_rate + alert_rate + starttls_fallback_rate
          + {' + '.join(f'abs(z_{n})' for n in FEATURES)} + rarity_issuer_id + rarity_dominant_tls_version
          + CAST(peer_n > 0 AND count_issuer_id = 0 AS INTEGER) + CAST(peer_n > 0 AND count_dominant_tls_version = 0 AS INTEGER)
          + CAST(history_count > 0 AND count(*) OVER (PARTITION BY endpoint_id, issuer_id ORDER BY day_index
              RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS INTEGER) + 1, 4) AS total FROM y_rarity""",
)
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forest().vectors(daily(spark, sf_dir))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "endpoint_id", "day_index", F.size("vector").alias("dims"), F.round(total, 4).alias("total")
    )


@query(
    "w11_refit_schedule",
    f"""WITH RECURSIVE days AS (SELECT day_index, row_number() OVER (ORDER BY day_index) AS n FROM (SELECT DISTINCT day_index FROM x_daily)),
        ready AS (SELECT d.day_index, d.n, (SELECT count(*) FROM y_baseline b WHERE b.day_index < d.day_index AND b.skip IS NULL AND NOT b.in_maintenance) >= 40 AS ok FROM days d),
        walk AS (SELECT day_index, n, CASE WHEN ok THEN day_index ELSE -1 END AS fit FROM ready WHERE n = 1
          UNION ALL SELECT r.day_index, r.n, CASE WHEN w.fit >= 0 AND r.day_index - w.fit < 7 THEN w.fit WHEN r.ok THEN r.day_index ELSE w.fit END
          FROM walk w JOIN ready r ON r.n = w.n + 1)
        SELECT day_index, fit AS fit_day FROM walk WHERE fit >= 0""",
)
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = forest()
    rows = model.vectors(daily(spark, sf_dir))
    used = model.schedule(rows)
    days = rows.select("day_index").distinct()
    from mxposture.functions.states import lookup

    return days.withColumn("fit_day", lookup(F.col("day_index").cast("int"), used).cast("bigint")).where(
        F.col("fit_day").isNotNull()
    )


@query(
    "j23_current_and_history",
    """SELECT count(*) AS windows, count(DISTINCT endpoint_id) AS endpoints, max(day_index) AS day_index FROM
       (SELECT endpoint_id, day_index FROM x_daily UNION ALL SELECT endpoint_id, (SELECT max(day_index) + 1 FROM x_daily) FROM x_daily WHERE day_index = 4)""",
)
def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = daily(spark, sf_dir)
    now = ops.assign_day(past.where("day_index = 4"), past)
    both = past.unionByName(now, allowMissingColumns=True)
    return both.agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_distinct("endpoint_id").alias("endpoints"),
        F.max("day_index").alias("day_index"),
    )


@query(
    "j19_peer_history",
    """SELECT site_id, protocol_role, day_index, CAST(sum(n) OVER (PARTITION BY site_id, protocol_role ORDER BY day_index) - n AS BIGINT) AS peers
       FROM (SELECT site_id, protocol_role, day_index, count(*) AS n FROM x_daily GROUP BY 1, 2, 3)""",
)
def peer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.with_rarity(_history(spark, sf_dir), [])
    return out.groupBy("site_id", "protocol_role", "day_index").agg(F.max("peer_n").alias("peers"))


@query(
    "a04_endpoint_rollup",
    """SELECT c.resp_h || ':' || c.resp_p AS endpoint_id, count(*) AS session_count,
       round(coalesce(count(*) FILTER (h.version = 'TLSv13') / nullif(count(h.version), 0), 0), 6) AS tls13_share,
       round(coalesce(count(*) FILTER (h.version IN ('TLSv10', 'TLSv11')) / nullif(count(h.version), 0), 0), 6) AS tls10_share,
       round(count(*) FILTER (NOT h.established) / count(*), 6) AS handshake_failure_rate,
       round(count(*) FILTER (h.last_alert IS NOT NULL) / count(*), 6) AS alert_rate,
       round(coalesce(count(*) FILTER (s.upgrade_state = 'plaintext_fallback') / nullif(count(s.upgrade_state), 0), 0), 6) AS starttls_fallback_rate,
       round(count(*) FILTER (h.fs_outcome = 'present') / count(*), 6) AS forward_secrecy_present_rate,
       round(count(*) FILTER (f.quality = 'incomplete') / count(*), 6) AS incomplete_reconstruction_rate,
       CASE WHEN count(h.version) > 0 AND count(*) FILTER (h.version IN ('TLSv10', 'TLSv11')) >= greatest(count(*) FILTER (h.version = 'TLSv13'), count(*) FILTER (h.version = 'TLSv12')) THEN 'TLSv10'
            WHEN count(*) FILTER (h.version = 'TLSv12') > count(*) FILTER (h.version = 'TLSv13') THEN 'TLSv12' ELSE 'TLSv13' END AS dominant_tls_version,
       count(*) FILTER (h.quality IS NOT NULL) AS flows
       FROM y_sessions s JOIN x_conn c ON c.uid = s.uid JOIN y_flows f ON f.uid = s.uid JOIN y_handshakes h ON h.uid = s.uid GROUP BY 1""",
)
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = built_sessions(spark, sf_dir).withColumn("ord", F.col("uid").cast("bigint"))
    leaves = leaf_per_uid(certificates(spark, sf_dir)).select("uid", "issuer")
    out = ops.endpoint_rollup(
        sessions.select("uid", "protocol", "upgrade_state", "ord"),
        built_flows(spark, sf_dir),
        built_handshakes(spark, sf_dir),
        leaves,
    )
    rates = [
        "tls13_share",
        "tls10_share",
        "handshake_failure_rate",
        "alert_rate",
        "starttls_fallback_rate",
        "forward_secrecy_present_rate",
        "incomplete_reconstruction_rate",
    ]
    return out.select(
        "endpoint_id",
        "session_count",
        *[F.round(c, 6).alias(c) for c in rates],
        "dominant_tls_version",
        F.col("session_count").alias("flows"),
    )


@query(
    "f35_roles_and_issuers",
    """SELECT c.uid, CASE WHEN c.resp_p = 25 THEN 'smtp_mx' WHEN c.resp_p IN (465, 587) THEN 'smtp_submission' WHEN c.resp_p IN (143, 993) THEN 'imap_access'
         WHEN c.resp_p IN (110, 995) THEN 'pop3_access' WHEN s.protocol = 'imap' THEN 'imap_access' WHEN s.protocol = 'pop3' THEN 'pop3_access' ELSE 'smtp_mx' END AS protocol_role,
       CASE WHEN CAST(c.uid AS BIGINT) % 3 = 0 THEN 'iss_unknown' ELSE 'iss_' || substr(sha256(c.orig_h), 1, 12) END AS issuer_id
       FROM x_conn c JOIN y_sessions s ON s.uid = c.uid""",
)
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mxposture.functions.states import lookup
    from mxposture.functions.text import opaque_issuer

    rows = built_sessions(spark, sf_dir)
    issuer = F.when(F.col("uid").cast("bigint") % 3 != 0, F.col("orig_h")).otherwise("")
    role = lookup(ops.role_code(F.col("resp_p"), F.col("protocol")), ops.ROLE_CODES)
    return rows.select("uid", role.alias("protocol_role"), opaque_issuer(issuer).alias("issuer_id"))
