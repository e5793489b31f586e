"""Detectors on the seeded cohort: gates, no look-ahead, brute-force statistics, bootstrap."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from mxposture.constants import RATE_FEATURES, ROBUST_FEATURES
from mxposture.operators import detect, evaluate
from mxposture.operators import windows as W
from mxposture.plans.cohort import cohort_labels, cohort_windows


@pytest.fixture(scope="module")
def windows(spark):
    return cohort_windows(spark).repartition(8).persist()


@pytest.fixture(scope="module")
def baseline(windows):
    return detect.Baseline().score(windows).persist()


@pytest.fixture(scope="module")
def forest(windows):
    return detect.Forest().score(windows).persist()


def test_cohort_shape(windows):
    assert windows.count() == 22 * 70 + 18
    total = windows.select(F.max(F.abs(F.col("tls13_share") + F.col("tls12_share") + F.col("tls10_share") - 1)))
    assert total.first()[0] < 1e-9


def brute(rows, target):
    """Score of one window from plain lists."""
    past = sorted((r for r in rows if r.endpoint_id == target.endpoint_id and r.day_index < target.day_index), key=lambda r: r.day_index)
    peers = [r for r in rows if (r.site_id, r.protocol_role) == (target.site_id, target.protocol_role) and r.day_index < target.day_index]
    best = 0.0
    for name in ROBUST_FEATURES:
        series = [r[name] for r in past]
        med = statistics.median(series)
        mad = statistics.median([abs(v - med) for v in series])
        z = max(-30.0, min(30.0, (target[name] - med) / max(1.4826 * mad, 0.01)))
        mean = total = 0.0
        for n, value in enumerate([*series, target[name]], 1):
            mean += (value - mean) / n
            total = max(0.0, total + value - mean - 0.02)
        best = max(best, abs(z), total / 0.5)
    for name in ("issuer_id", "dominant_tls_version"):
        same = sum(r[name] == target[name] for r in peers)
        best = max(best, -math.log((same + 0.5) / (len(peers) + 0.5)))
    return best


def test_baseline_equals_brute_force(windows, baseline):
    rows = windows.collect()
    scores = {(r.endpoint_id, r.day_index): r for r in baseline.collect()}
    for target in rows[::23]:
        got = scores[(target.endpoint_id, target.day_index)]
        if got.skip_reason is None and not got.suppressed:
            assert abs(got.score - brute(rows, target)) < 1e-9


def test_percentile_is_the_share_of_the_day(baseline):
    rows = [r for r in baseline.collect() if r.skip_reason is None and not r.suppressed]
    for r in rows[::17]:
        day = [x.score for x in rows if x.day_index == r.day_index]
        assert abs(r.percentile - 100 * sum(s <= r.score for s in day) / len(day)) < 1e-9


@pytest.mark.parametrize("name", ["baseline", "forest"])
def test_the_future_changes_nothing(windows, baseline, forest, name):
    full = baseline if name == "baseline" else forest
    scorer = detect.Baseline() if name == "baseline" else detect.Forest()
    cut = scorer.score(windows.where("day_index <= 45"))
    cols = ["endpoint_id", "day_index", F.round("score", 9).alias("score"), "skip_reason"]
    early = full.where("day_index <= 45")
    assert cut.select(cols).exceptAll(early.select(cols)).isEmpty()


def test_partitioning_changes_nothing(windows, forest):
    again = detect.Forest().score(windows.repartition(3, "day_index"))
    cols = ["endpoint_id", "day_index", F.round("score", 9).alias("s")]
    assert again.select(cols).exceptAll(forest.select(cols)).isEmpty()


def test_all_gates_hold(spark, windows, baseline, forest):
    row = evaluate.compare(windows, cohort_labels(spark), baseline, forest).first().asDict()
    gates = {k: v for k, v in row.items() if k.startswith("gate_")}
    assert len(gates) == 8 and all(gates.values()), row


def test_advisories(spark, windows, baseline):
    found = detect.anomalies(baseline)
    top = found.where("endpoint_id = 'edge-south-4'").first()
    assert top.code == "ADVISORY_HANDSHAKE_FAILURE_RATE"
    assert "handshake_failure_rate=0.2400, usually 0.00" in top.reason
    assert found.count() == found.select("endpoint_id").distinct().count()
    assert detect.advisory_items(found, 3).first().code == "ADVISORY_INSUFFICIENT_HISTORY"
    assert detect.advisory_items(found, 30).count() == 1 + found.count()
    assert detect.advisory_items(found.limit(0), 100).first().code == "ADVISORY_NONE"


def test_refit_schedule():
    counts = [(d, 10) for d in range(20)]
    used = detect.fit_days(counts, list(range(20)), min_train=40, every=7)
    assert used == {**{d: 4 for d in range(4, 11)}, **{d: 11 for d in range(11, 18)}, 18: 18, 19: 18}


def test_feature_vector_has_28_entries(windows):
    rows = detect.Forest().vectors(windows.where("endpoint_id = 'edge-north-1'"))
    assert {r.n for r in rows.select(F.size("vector").alias("n")).collect()} == {len(RATE_FEATURES) + 8 + 4 + 1 + 4}


def test_bootstrap_has_the_distribution_of_single_draws(spark):
    """Lift frequencies against drawing one endpoint after the other."""
    n, k, labelled = 12, 3, {"e01", "e05"}
    a = {f"e{i:02d}": float(i) for i in range(n)}
    b = {f"e{i:02d}": float((i * 5) % n) for i in range(n)}

    def frame(d):
        return spark.createDataFrame(list(d.items()), "endpoint_id string, score double")

    events = spark.createDataFrame([(e,) for e in labelled], "endpoint_id string")
    got = evaluate.bootstrap_lifts(frame(a), frame(b), events, None, k, replicates=4000, seed=9)
    rng = np.random.default_rng(1)
    fillers = sorted(set(a) - labelled)

    def precision(peaks, present):
        return sum(e in labelled for e in sorted(present, key=lambda e: (-peaks[e], e))[:k]) / k

    plain = []
    for _ in range(4000):
        present = labelled | set(rng.choice(fillers, size=len(fillers)))
        plain.append(precision(b, present) - precision(a, present))
    lifts = [r.lift for r in got.collect()]
    assert abs(np.mean(lifts) - np.mean(plain)) < 0.02
    for value in set(np.round(plain, 6)):
        share = np.mean(np.isclose(plain, value))
        assert abs(np.mean(np.isclose(lifts, value)) - share) < 0.04
    shallow = evaluate.bootstrap_lifts(frame(a), frame(b), events, None, k, replicates=300, seed=9, depth=1)
    assert shallow.count() == 300


def test_current_windows_follow_the_history(windows):
    past = windows.where("day_index < 30")
    now = W.assign_day(windows.where("day_index = 30"), past)
    assert {r.day_index for r in now.select("day_index").distinct().collect()} == {30}
    scores = detect.score_current(past, windows.where("day_index = 30"), [detect.Baseline()])
    assert scores.count() == now.count()
