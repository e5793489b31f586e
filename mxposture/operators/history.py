"""Statistics of every window over the earlier windows of its endpoint, without listing them in rows.

The windows of an endpoint stream in order of day through one task. What is carried along per endpoint is
its earlier values as counted ranks (``Ranked``: sorted buckets with their sizes, so a value goes in and a
rank is found without moving the rest), two running numbers for the drift, and a count per category.
Nothing grows with the square of the history, and a row carries a few numbers instead of all it follows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from mxposture.constants import DRIFT_DELTA, DRIFT_LAMBDA

BUCKET = 512


class Ranked:
    """A growing collection of numbers that knows its order statistics."""

    def __init__(self) -> None:
        self.buckets: list[list[float]] = []
        self.tops: list[float] = []
        self.size = 0

    def add(self, value: float) -> None:
        self.size += 1
        if not self.buckets:
            self.buckets, self.tops = [[value]], [value]
            return
        k = min(bisect_left(self.tops, value), len(self.tops) - 1)
        bucket = self.buckets[k]
        insort(bucket, value)
        if len(bucket) > BUCKET:
            half = len(bucket) // 2
            self.buckets[k : k + 1] = [bucket[:half], bucket[half:]]
            self.tops[k : k + 1] = [bucket[half - 1], bucket[-1]]
        else:
            self.tops[k] = bucket[-1]

    def at(self, rank: int) -> float:
        for bucket in self.buckets:
            if rank < len(bucket):
                return bucket[rank]
            rank -= len(bucket)
        raise IndexError(rank)

    def below(self, value: float) -> int:
        """How many are less than ``value``."""
        k = bisect_left(self.tops, value)
        inside = bisect_left(self.buckets[k], value) if k < len(self.buckets) else 0
        return sum(map(len, self.buckets[:k])) + inside

    def median(self) -> float:
        """The middle, or the mean of the two; 0 when empty."""
        if not self.size:
            return 0.0
        return (self.at((self.size - 1) // 2) + self.at(self.size // 2)) / 2

    def spread(self, center: float) -> float:
        """Median distance from ``center``; 0 when empty."""
        if not self.size:
            return 0.0
        if len(self.buckets) == 1:
            away = sorted(abs(x - center) for x in self.buckets[0])
            return (away[(self.size - 1) // 2] + away[self.size // 2]) / 2
        return (self._nearest((self.size - 1) // 2, center) + self._nearest(self.size // 2, center)) / 2

    def _nearest(self, k: int, center: float) -> float:
        """The distance of rank ``k``: the values on either side are in order of distance already."""
        split = self.below(center)
        right = self.size - split
        low, high = max(0, k + 1 - right), min(split, k + 1)
        while low < high:
            i = (low + high) // 2  # from the left side; the others from the right
            j = k + 1 - i
            if center - self.at(split - 1 - i) < self.at(split + j - 1) - center:
                low = i + 1
            else:
                high = i
        i, j = low, k + 1 - low
        sides = []
        if i:
            sides.append(center - self.at(split - i))
        if j:
            sides.append(self.at(split + j - 1) - center)
        return max(sides)


class Past:
    """What one endpoint's earlier windows come to."""

    def __init__(self, numbers: int, categories: int):
        self.count = 0
        self.ranked = [Ranked() for _ in range(numbers)]
        self.drift = [(0.0, 0.0, 0) for _ in range(numbers)]
        self.seen = [Counter() for _ in range(categories)]

    @staticmethod
    def drifted(state: tuple, value: float) -> tuple:
        """Page-Hinkley state after one more value: mean, sum above it, number."""
        mean, total, n = state
        n += 1
        mean += (value - mean) / n
        return mean, max(0.0, total + value - mean - DRIFT_DELTA), n

    def take(self, values: list, kinds: list) -> None:
        self.count += 1
        for k, value in enumerate(values):
            if value is not None:
                self.ranked[k].add(value)
                self.drift[k] = self.drifted(self.drift[k], value)
        for counter, kind in zip(self.seen, kinds, strict=True):
            counter[kind] += 1


def with_past(windows: DataFrame, features: list[str], categories: list[str] | None = None) -> DataFrame:
    """``history_count``, and per feature ``med_``, ``mad_`` and ``drift_``, per category ``seen_``.

    All but the drift are of the windows of the same endpoint on earlier days; the drift (Page-Hinkley)
    takes in the window's own value. Windows of one day do not see each other. A null value has no part in
    later statistics and no drift; without earlier values median and deviation are 0.
    """
    categories = categories or []
    numbers = list(dict.fromkeys(features))
    place = {f.name: i for i, f in enumerate(windows.schema.fields)}
    schema = StructType([*windows.schema.fields]).add("history_count", "long")
    for name in numbers:
        for stem in ("med", "mad", "drift"):
            schema = schema.add(f"{stem}_{name}", "double")
    for name in categories:
        schema = schema.add(f"seen_{name}", "long")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, day, past, waiting = None, None, None, []
        for batch in batches:
            endpoints = batch.column(place["endpoint_id"]).to_pylist()
            days = batch.column(place["day_index"]).to_pylist()
            values = [batch.column(place[n]).cast(pa.float64()).to_pylist() for n in numbers]
            kinds = [batch.column(place[c]).to_pylist() for c in categories]
            out: list[list] = [[] for _ in range(1 + 3 * len(numbers) + len(categories))]
            for i, endpoint in enumerate(endpoints):
                if past is None or endpoint != now:
                    now, day, past, waiting = endpoint, days[i], Past(len(numbers), len(categories)), []
                elif days[i] != day:
                    for row in waiting:
                        past.take(*row)
                    day, waiting = days[i], []
                mine, kind = [v[i] for v in values], [k[i] for k in kinds]
                out[0].append(past.count)
                for k, value in enumerate(mine):
                    center = past.ranked[k].median()
                    out[1 + 3 * k].append(center)
                    out[2 + 3 * k].append(past.ranked[k].spread(center))
                    drift = None if value is None else past.drifted(past.drift[k], value)[1] / DRIFT_LAMBDA
                    out[3 + 3 * k].append(drift)
                for k, name in enumerate(kind):
                    out[1 + 3 * len(numbers) + k].append(past.seen[k][name])
                waiting.append((mine, kind))
            types = [pa.int64(), *[pa.float64()] * (3 * len(numbers)), *[pa.int64()] * len(categories)]
            added = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    ordered = windows.repartition("endpoint_id").sortWithinPartitions("endpoint_id", "day_index")
    return ordered.mapInArrow(walk, schema)
