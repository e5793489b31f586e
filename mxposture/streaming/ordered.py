"""Ordered folds over streams whose rows of a key may arrive in any order.

The stream state of a key holds the fold's own state, the rows that are not yet due, and the place of the
last row that was folded. Event time moves on with the watermark: a row is due once the stream has seen
``delay`` beyond its time, and due rows are folded by (ts, ord), whatever batch they came in. Timers on
event time wake a key up when its next row is due, and a session ends where its key is silent for ``idle``,
so it needs no end row. The place of an ended session is kept until ``lifetime`` has passed, then all state
of the key goes; Spark itself leaves out rows that are later than that.

A row that comes after a later one of its key was folded cannot be folded any more; it is returned as
``late_row`` (JSON) beside the results, for a table of its own.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

STATE = "kept binary"
#: Keys share a state row in so many buckets; a bucket's state is read and written whole when one of its keys is touched.
BUCKETS = 4096
LATE = "late_row"
NEVER = -(1 << 62)


class Fold:
    """What a stream does with the rows of one key, in order.

    ``FIELDS`` are the columns it reads, ``OUTPUT`` the schema of its results behind the key columns.
    """

    FIELDS: list[str] = []
    OUTPUT = ""

    def blank(self):
        raise NotImplementedError

    def step(self, state, row: dict) -> Iterator[tuple]:
        """Fold one row into ``state`` (in place); yields results."""
        raise NotImplementedError

    def finish(self, state) -> Iterator[tuple]:
        """Results of a session that ends."""
        return iter(())

    def ends(self, row: dict) -> bool:
        return False


def milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


class Walk:
    """The state function of one key: hold, release in order, wake up again."""

    def __init__(self, fold: Fold, keys: int, columns: list[str], delay: int, lifetime: int, idle: int):
        if lifetime < delay:
            raise ValueError("lifetime must not be shorter than delay")
        self.fold, self.keys, self.columns = fold, keys, columns
        self.delay, self.lifetime, self.idle = delay, lifetime, idle

    def advance(self, key: tuple, arrived: list, kept: tuple | None, watermark: int, results: list) -> tuple | None:
        """What is kept of ``key`` from now on, with the time to wake it up; None once all of it goes."""
        folded, seen, state, held, live = (None, 0, self.fold.blank(), [], False) if kept is None else kept
        blanks = (None,) * (len(self.columns) - self.keys - 1)
        for ts, place, row in arrived:
            if folded is not None and (ts, place) <= folded:
                results.append((*key, *blanks, row))
            else:
                held.append((int(ts), int(place), row))
                seen = max(seen, int(ts))
        # Spark's watermark lies ``lifetime`` behind the latest time seen, rows are due ``delay`` behind.
        due = watermark + self.lifetime - self.delay if watermark > 0 else NEVER
        held.sort(key=lambda r: r[:2])
        at = 0
        while at < len(held) and held[at][0] <= due:
            ts, place, text = held[at]
            if live and ts - folded[0] >= self.idle:
                results += [(*key, *out, None) for out in self.fold.finish(state)]
                state = self.fold.blank()
            row = json.loads(text)
            folded, live = (ts, place), True
            results += [(*key, *out, None) for out in self.fold.step(state, row)]
            if self.fold.ends(row):
                results += [(*key, *out, None) for out in self.fold.finish(state)]
                state, live = self.fold.blank(), False
            at += 1
        held = held[at:]
        if live and not held and due >= seen + self.idle:
            results += [(*key, *out, None) for out in self.fold.finish(state)]
            state, live = self.fold.blank(), False
        if not (held or live or watermark < seen):
            return None
        wake = held[0][0] if held else seen + self.idle
        at = wake - self.lifetime + self.delay if held or live else seen
        return (folded, seen, state, held, live), max(at, watermark + 1)

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        arrived = [(ts, place, row) for f in frames for ts, place, row in zip(f["_ms"], f["ord"], f["_row"], strict=True)]
        if any(part is None or part != part for part in key):
            return  # rows without a key only move the watermark
        results: list[tuple] = []
        kept = pickle.loads(group.get[0]) if group.exists else None
        following = self.advance(key, arrived, kept, group.getCurrentWatermarkMs(), results)
        if following:
            kept, at = following
            group.update((pickle.dumps(kept),))
            group.setTimeoutTimestamp(at)
        elif group.exists:
            group.remove()
        if results:
            yield pd.DataFrame(results, columns=self.columns, dtype=object)


class Buckets(Walk):
    """The same for all keys of a bucket at once: a call and a state row for each of millions of keys costs far
    more than the folds. The state is what is kept of every key, by key, with the time it is to be woken up."""

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        watermark = group.getCurrentWatermarkMs()
        keys: dict[str, tuple] = pickle.loads(group.get[0]) if group.exists else {}
        arrived: dict[str, list] = {name: [] for name, (_, at) in keys.items() if at <= watermark}
        for f in frames:
            for name, *row in zip(f["_key"], f["_ms"], f["ord"], f["_row"], strict=True):
                if name is not None:  # rows without a key only move the watermark
                    arrived.setdefault(name, []).append(row)
        results: list[tuple] = []
        for name, rows in arrived.items():
            kept = keys.pop(name)[0] if name in keys else None
            following = self.advance((name,), rows, kept, watermark, results)
            if following:
                keys[name] = following
        if keys:
            group.update((pickle.dumps(keys),))
            group.setTimeoutTimestamp(max(min(at for _, at in keys.values()), watermark + 1))
        elif group.exists:
            group.remove()
        if results:
            yield pd.DataFrame(results, columns=self.columns, dtype=object)


def in_order(
    events: DataFrame,
    keys: list[str],
    fold: Fold,
    delay: str = "1 hour",
    lifetime: str = "2 days",
    idle: str = "1 hour",
    ticks: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``keys``, the fold's results and ``late_row``, as an append stream.

    ``events`` needs ``ts`` (event time), ``ord`` (bigint; decides between equal times) and the fold's
    fields. ``ticks`` is another stream with ``ts`` only: its rows move the watermark and nothing else.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    rows = events.select(
        F.when(known, F.to_json(F.struct(*keys))).alias("_key"),
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"),
        F.col("ts").cast("timestamp").alias("ts"),
        "ord",
        F.to_json(F.struct("ord", *fold.FIELDS)).alias("_row"),
    )
    if ticks is not None:
        tick = ticks.select(F.col("ts").cast("timestamp").alias("ts"), *[F.lit(0).cast("bigint").alias(c) for c in ("ord", "_bucket")])
        rows = rows.unionByName(tick, allowMissingColumns=True)
    rows = rows.withWatermark("ts", lifetime).withColumn("_ms", F.unix_millis("ts"))
    schema = f"_key string, {fold.OUTPUT}, {LATE} string"
    names = [c.split()[0] for c in schema.split(", ")]
    walk = Buckets(fold, 1, names, milliseconds(delay), milliseconds(lifetime), milliseconds(idle))

    def walked(key, frames, group):
        yield from walk(key, frames, group)

    out = rows.groupBy("_bucket").applyInPandasWithState(
        walked, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    of_keys = StructType([events.schema[k] for k in keys])
    return out.withColumn("_key", F.from_json("_key", of_keys)).select("_key.*", *names[1:])
