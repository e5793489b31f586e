"""Detector evaluation against labelled episodes: precision, delays, alert rates, bootstrap, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mxposture.constants import (
    ALERT_RATE_FACTOR,
    BOOTSTRAP_REPLICATES,
    DELAY_WINDOWS,
    LOCKED_SEED,
    P90_SLACK,
    PRECISION_FLOOR,
    PRECISION_LIFT,
    TOP_K,
    WARMUP_DAYS,
)

EPS = 1e-12


def eligible(scores: DataFrame, warmup: int = WARMUP_DAYS) -> DataFrame:
    """Scored windows after the warm-up, neither skipped nor suppressed."""
    return scores.where(
        (F.col("day_index") >= warmup) & F.col("skip_reason").isNull() & ~F.col("suppressed")
    )


def peaks(scores: DataFrame, warmup: int = WARMUP_DAYS, exclude: DataFrame | None = None) -> DataFrame:
    """Highest score of each endpoint."""
    out = eligible(scores, warmup).groupBy("endpoint_id").agg(F.max("score").alias("score"))
    if exclude is not None:
        out = out.join(exclude.select("endpoint_id").distinct(), "endpoint_id", "left_anti")
    return out


def ranked(peaks_: DataFrame, k: int) -> DataFrame:
    """Top-k endpoints, best first, ties by id."""
    return peaks_.orderBy(F.col("score").desc(), "endpoint_id").limit(k)


def precision_at_k(peaks_: DataFrame, events: DataFrame, k: int = TOP_K) -> DataFrame:
    """Share of the k review places taken by labelled endpoints; always divided by k."""
    truth = events.select("endpoint_id").distinct().withColumn("_t", F.lit(1))
    top = ranked(peaks_, k).join(truth, "endpoint_id", "left")
    return top.agg((F.coalesce(F.sum("_t"), F.lit(0)) / F.lit(float(k))).alias("precision_at_k"))


def alert_days(scores: DataFrame) -> DataFrame:
    """Distinct (endpoint, day) with an alert."""
    fired = F.col("above_threshold") & ~F.col("suppressed") & F.col("skip_reason").isNull()
    return scores.where(fired).select("endpoint_id", "day_index").distinct()


def interval_days(intervals: DataFrame) -> DataFrame:
    """Distinct (endpoint, day) covered by intervals."""
    days = F.explode(F.sequence(F.col("start_day").cast("bigint"), F.col("end_day").cast("bigint")))
    return intervals.select("endpoint_id", days.alias("day_index")).distinct()


def detection_delays(scores: DataFrame, events: DataFrame, max_delay: int = DELAY_WINDOWS) -> DataFrame:
    """Days from the start of an episode to its first alert within ``max_delay``; null if none.

    The look-ahead is at most three days, so an episode becomes three keys and meets the alerts
    by equality.
    """
    ahead = F.explode(F.sequence(F.lit(0), F.lit(max_delay))).alias("delay")
    probes = events.select("event_id", "endpoint_id", "start_day", ahead).withColumn(
        "day_index", (F.col("start_day") + F.col("delay")).cast("bigint")
    )
    hits = probes.join(alert_days(scores), ["endpoint_id", "day_index"], "left_semi")
    first = hits.groupBy("event_id").agg(F.min("delay").alias("delay"))
    return events.select("event_id", "kind").join(first, "event_id", "left")


def merge_delays(left: DataFrame, right: DataFrame) -> DataFrame:
    """Smaller delay of two detectors; a miss on one side does not count."""
    a = left.select("event_id", F.col("kind").alias("_ka"), F.col("delay").alias("_a"))
    b = right.select("event_id", F.col("kind").alias("_kb"), F.col("delay").alias("_b"))
    return a.join(b, "event_id", "full").select(
        "event_id", F.coalesce("_ka", "_kb").alias("kind"), F.least("_a", "_b").alias("delay")
    )


def delay_stats(delays: DataFrame) -> list[Column]:
    """Median and 90th percentile; a delay takes at most three values."""
    return [
        F.percentile("delay", F.lit(0.5)).alias("median_delay"),
        F.percentile("delay", F.lit(0.9)).alias("p90_delay"),
    ]


def alert_rates(
    scores: DataFrame,
    windows: DataFrame,
    events: DataFrame,
    maintenance: DataFrame,
    new_endpoints: DataFrame | None = None,
    warmup: int = WARMUP_DAYS,
) -> DataFrame:
    """Alerts per 1000 endpoint days, clean and maintenance alert rates, alerts on new endpoints."""
    population = windows.where((F.col("day_index") >= warmup) & ~F.col("is_new_endpoint")).select(
        "endpoint_id", "day_index"
    )
    key = ["endpoint_id", "day_index"]

    def marked(days: DataFrame, name: str) -> DataFrame:
        return days.withColumn(name, F.lit(True))

    rows = (
        population.join(marked(alert_days(scores), "_fired"), key, "left")
        .join(marked(interval_days(events), "_labelled"), key, "left")
        .join(marked(interval_days(maintenance), "_kept"), key, "left")
    )
    if new_endpoints is not None:
        fresh = new_endpoints.select("endpoint_id").distinct()
        rows = rows.join(marked(fresh, "_new"), "endpoint_id", "left")
    else:
        rows = rows.withColumn("_new", F.lit(None).cast("boolean"))
    fired, kept = F.col("_fired").isNotNull(), F.col("_kept").isNotNull()
    clean = ~kept & F.col("_labelled").isNull()
    counted = rows.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(fired).alias("_alerts"),
        F.count_if(clean).alias("_clean"),
        F.count_if(clean & fired).alias("_clean_alerts"),
        F.count_if(kept).alias("_kept"),
        F.count_if(kept & fired).alias("_kept_alerts"),
        F.count_if(F.col("_new").isNotNull() & fired).alias("new_endpoint_alerts"),
    )

    def rate(part: str, whole: str, factor: float = 1.0) -> Column:
        return F.when(F.col(whole) > 0, factor * F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return counted.select(
        rate("_alerts", "_n", 1000.0).alias("alerts_per_1000"),
        rate("_clean_alerts", "_clean").alias("clean_alert_rate"),
        rate("_kept_alerts", "_kept").alias("maintenance_alert_rate"),
        "new_endpoint_alerts",
    )


def one_row(*rows: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side."""
    both = rows[0]
    for row in rows[1:]:
        both = both.unionByName(row, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def summarize(
    scores: DataFrame,
    windows: DataFrame,
    labels: dict[str, DataFrame],
    detector: str,
    k: int = TOP_K,
    warmup: int = WARMUP_DAYS,
    delays: DataFrame | None = None,
) -> DataFrame:
    """One summary row per detector. ``labels``: events, maintenance, new_endpoints, jitter."""
    delays = detection_delays(scores, labels["events"]) if delays is None else delays
    top = peaks(scores, warmup, labels.get("new_endpoints"))
    return one_row(
        precision_at_k(top, labels["events"], k),
        delays.agg(*delay_stats(delays), F.count("delay").alias("detected")),
        alert_rates(
            scores, windows, labels["events"], labels["maintenance"], labels.get("new_endpoints"), warmup
        ),
    ).withColumn("detector", F.lit(detector))


def null_scores(windows: DataFrame, seed: int = LOCKED_SEED) -> DataFrame:
    """Uninformative ranking: a score hashed from endpoint, day and seed that never alerts."""
    h = F.shiftrightunsigned(F.xxhash64("endpoint_id", "day_index", F.lit(seed)), 11)
    return windows.select(
        "endpoint_id",
        "day_index",
        F.lit("null").alias("detector"),
        (h.cast("double") / F.lit(float(1 << 53))).alias("score"),
        F.lit(1.1).alias("threshold"),
        F.lit(False).alias("above_threshold"),
        F.coalesce("in_maintenance", F.lit(False)).alias("suppressed"),
        F.lit(None).cast("string").alias("skip_reason"),
    )


# --- paired bootstrap ------------------------------------------------------------------------------


def _lift_function(places: list[tuple], pool: int, k: int, seed: int):
    """Lift of one replicate.

    ``places``: (endpoint, anchor, labelled, score a, score b) of every endpoint that can reach a
    top-k list. Drawing with replacement from ``pool`` fillers is a multinomial; the counts of
    the listed fillers follow one after the other as conditional binomials, which is the same
    distribution as drawing one by one.
    """
    fillers = [i for i, p in enumerate(places) if not p[1]]
    order_a = sorted(range(len(places)), key=lambda i: (-places[i][3], places[i][0]))
    order_b = sorted(range(len(places)), key=lambda i: (-places[i][4], places[i][0]))

    def precision(order: list[int], present: np.ndarray) -> float:
        taken = [i for i in order if present[i]][:k]
        return sum(places[i][2] for i in taken) / k

    def short(present: np.ndarray) -> bool:
        return int(present.sum()) < k and pool > len(fillers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rep in pdf["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                present = np.array([p[1] for p in places], dtype=bool)
                left = pool
                for n, i in enumerate(fillers):
                    drawn = int(rng.binomial(left, 1.0 / (pool - n))) if left > 0 else 0
                    present[i] = drawn > 0
                    left -= drawn
                lift = precision(order_b, present) - precision(order_a, present)
                rows.append((int(rep), lift, short(present)))
            yield pd.DataFrame(rows, columns=["replicate", "lift", "short"])

    return run


def bootstrap_lifts(
    peaks_a: DataFrame,
    peaks_b: DataFrame,
    events: DataFrame,
    jitter: DataFrame | None,
    k: int = TOP_K,
    replicates: int = BOOTSTRAP_REPLICATES,
    seed: int = LOCKED_SEED,
    depth: int | None = None,
) -> DataFrame:
    """Precision lift of b over a per replicate.

    Labelled and jitter endpoints are in every replicate, the others are resampled. Only
    endpoints near the top can enter a top-k list, so each replicate looks at the best
    ``depth`` fillers of either detector (a number set by k, not by the data). A replicate that
    draws too few of them is found and repeated with twice the depth.
    """
    spark = peaks_a.sparkSession
    depth = depth or 64 + 8 * k
    both = peaks_a.select("endpoint_id", F.col("score").alias("a")).join(
        peaks_b.select("endpoint_id", F.col("score").alias("b")), "endpoint_id", "full"
    ).fillna(0.0, ["a", "b"])
    truth = events.select("endpoint_id").distinct().withColumn("_t", F.lit(True))
    both = both.join(truth, "endpoint_id", "left")
    if jitter is not None:
        noise = jitter.select("endpoint_id").distinct().withColumn("_j", F.lit(True))
        both = both.join(noise, "endpoint_id", "left")
    else:
        both = both.withColumn("_j", F.lit(None).cast("boolean"))
    both = both.select(
        "endpoint_id",
        (F.col("_t").isNotNull() | F.col("_j").isNotNull()).alias("anchor"),
        F.col("_t").isNotNull().alias("labelled"),
        "a",
        "b",
    )
    pool = both.where(~F.col("anchor")).count()
    while True:
        parts = [
            both.where(F.col("anchor") == anchor)
            .orderBy(F.col(score).desc(), "endpoint_id")
            .limit(k if anchor else depth)
            for anchor in (True, False)
            for score in ("a", "b")
        ]
        near = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()
        places = [tuple(r) for r in near.collect()]  # at most 2 x (k + depth) rows
        run = _lift_function(places, pool, k, seed)
        out = spark.range(replicates).mapInPandas(run, "replicate bigint, lift double, short boolean")
        if depth >= pool or out.where("short").isEmpty():
            return out.drop("short")
        depth *= 2


def lift_interval(lifts: DataFrame) -> DataFrame:
    """Mean, 5th and 95th percentile; a lift takes at most 2k + 1 values."""
    return lifts.agg(
        F.avg("lift").alias("lift_mean"),
        F.percentile("lift", F.lit(0.05)).alias("lift_low"),
        F.percentile("lift", F.lit(0.95)).alias("lift_high"),
    )


# --- gates -------------------------------------------------------------------------------------------


def delay_gate(delays: DataFrame, max_delay: int = DELAY_WINDOWS) -> DataFrame:
    """True when there are univariate episodes and all of them are found in time."""
    single = delays.where(F.col("kind") == "univariate")
    late = F.count_if(F.col("delay").isNull() | (F.col("delay") > max_delay))
    return single.agg(((F.count(F.lit(1)) > 0) & (late == 0)).alias("detection_delay"))


def _no_worse(candidate: Column, base: Column, slack: float) -> Column:
    return F.when(base.isNull(), candidate.isNull()).otherwise(
        F.coalesce(candidate <= base + slack, F.lit(False))
    )


def compare(
    windows: DataFrame,
    labels: dict[str, DataFrame],
    baseline: DataFrame,
    challenger: DataFrame,
    k: int = TOP_K,
    warmup: int = WARMUP_DAYS,
    replicates: int = BOOTSTRAP_REPLICATES,
) -> DataFrame:
    """One row: both precisions and delays, the bootstrap interval and the eight gates."""
    events = labels["events"]
    null = precision_at_k(peaks(null_scores(windows), warmup, labels.get("new_endpoints")), events, k)
    base_delays = detection_delays(baseline, events)
    fused = merge_delays(base_delays, detection_delays(challenger, events))

    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(prefix + c) for c in df.columns if c != "detector"])

    def single(delays: DataFrame, prefix: str) -> DataFrame:
        rows = delays.where(F.col("kind") == "univariate")
        return prefixed(rows.agg(*delay_stats(rows)), prefix)

    lifts = bootstrap_lifts(
        peaks(baseline, warmup, labels.get("new_endpoints")),
        peaks(challenger, warmup, labels.get("new_endpoints")),
        events,
        labels.get("jitter"),
        k,
        replicates,
    )
    row = one_row(
        prefixed(null, "null_"),
        prefixed(summarize(baseline, windows, labels, "baseline", k, warmup, base_delays), "base_"),
        prefixed(summarize(challenger, windows, labels, "challenger", k, warmup, fused), "cand_"),
        single(base_delays, "base_single_"),
        single(fused, "cand_single_"),
        lift_interval(lifts),
        delay_gate(base_delays),
    )
    return gates(row)


def gates(row: DataFrame) -> DataFrame:
    c = F.col
    lift = c("cand_precision_at_k") - c("base_precision_at_k")
    rate = F.lit(ALERT_RATE_FACTOR)
    return row.withColumns(
        {
            "precision_lift": lift,
            "gate_precision_floor": c("base_precision_at_k") >= PRECISION_FLOOR,
            "gate_beats_null": c("base_precision_at_k") > c("null_precision_at_k") + EPS,
            "gate_detection_delay": c("detection_delay"),
            "gate_precision_lift": lift >= PRECISION_LIFT - EPS,
            "gate_lift_interval": c("lift_low") > 0,
            "gate_median_delay": _no_worse(
                c("cand_single_median_delay"), c("base_single_median_delay"), EPS
            ),
            "gate_p90_delay": _no_worse(
                c("cand_single_p90_delay"), c("base_single_p90_delay"), float(P90_SLACK)
            ),
            "gate_alert_rate": (
                c("cand_clean_alert_rate") <= c("base_clean_alert_rate") * rate + EPS
            )
            & (
                c("cand_maintenance_alert_rate") <= c("base_maintenance_alert_rate") * rate + EPS
            ),
        }
    ).drop("detection_delay")
