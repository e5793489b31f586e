"""Past statistics against plain lists."""

import math
import random
import statistics

from mxposture.constants import DRIFT_DELTA, DRIFT_LAMBDA
from mxposture.operators import history


def test_ranks_of_a_growing_collection(monkeypatch):
    monkeypatch.setattr(history, "BUCKET", 8)
    rng = random.Random(1)
    for spread in (3, 1000):
        ranked, plain = history.Ranked(), []
        for _ in range(400):
            value = float(rng.randrange(spread))
            ranked.add(value)
            plain.append(value)
            plain.sort()
            assert ranked.at(rng.randrange(ranked.size)) in plain
            assert ranked.median() == statistics.median(plain)
            for center in (ranked.median(), value, value + 0.5, -5.0, spread + 5.0):
                assert ranked.below(center) == sum(x < center for x in plain)
                assert ranked.spread(center) == statistics.median(abs(x - center) for x in plain)


def test_past_of_every_window(spark):
    rng = random.Random(2)
    rows = []
    for k in range(12):
        days = rng.sample(range(60), rng.choice([1, 5, 40]))
        for day in days:
            for _ in range(rng.choice([1, 1, 1, 3])):
                value = None if rng.random() < 0.1 else rng.choice([0.0, 0.5, rng.random() * 1e6])
                rows.append((f"e{k}", day, value, rng.randrange(9), rng.choice(["x", "y", None])))
    hot = [("hot", day, rng.random(), 1, "x") for day in range(1500)]
    rows += hot
    windows = spark.createDataFrame(rows, "endpoint_id string, day_index bigint, a double, b int, c string").repartition(5)
    before = windows.schema.json()
    out = history.with_past(windows, ["a", "b", "a"], ["c"]).collect()
    assert windows.schema.json() == before and len(out) == len(rows)
    for r in rng.sample(out, 250):
        past = sorted((x for x in rows if x[0] == r.endpoint_id and x[1] < r.day_index), key=lambda x: x[1])
        assert r.history_count == len(past)
        assert r.seen_c == sum(x[4] == r.c for x in past)
        for name, place in (("a", 2), ("b", 3)):
            values = [float(x[place]) for x in past if x[place] is not None]
            med = statistics.median(values) if values else 0.0
            assert math.isclose(r[f"med_{name}"], med, abs_tol=1e-12)
            mad = statistics.median(abs(v - med) for v in values) if values else 0.0
            assert math.isclose(r[f"mad_{name}"], mad, rel_tol=1e-12, abs_tol=1e-9)
        if len({x[1] for x in past}) == len(past):
            mean = total = n = 0
            for v in [float(x[2]) for x in past if x[2] is not None] + ([] if r.a is None else [r.a]):
                n += 1
                mean += (v - mean) / n
                total = max(0.0, total + v - mean - DRIFT_DELTA)
            assert r.drift_a is None if r.a is None else math.isclose(r.drift_a, total / DRIFT_LAMBDA, rel_tol=1e-9, abs_tol=1e-9)


def test_no_windows(spark):
    none = spark.createDataFrame([], "endpoint_id string, day_index bigint, a double")
    assert history.with_past(none, ["a"]).collect() == []
