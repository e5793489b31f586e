"""Ordered folds over streams: any batch order, silence instead of end rows, late rows, lifetimes."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from mxposture.operators import sessions
from mxposture.streaming import online, ordered, protocols, reconstruction, run

START = 1_700_000_000
# The workers cannot import this module; its fold travels as code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Listing(ordered.Fold):
    """Lists the positions of a session in the order they were folded."""

    FIELDS = ["kind"]
    OUTPUT = "places string"

    def blank(self):
        return []

    def step(self, state, row):
        state.append(str(row["ord"]))
        return iter(())

    def ends(self, row):
        return row.get("kind") == "end"

    def finish(self, state):
        yield (",".join(state),)


SCHEMA = "uid string, seconds bigint, ord bigint, kind string"


def write_batches(spark, path, batches, schema=SCHEMA):
    """One file a batch, each to be a micro-batch of its own."""
    for rows in batches:
        frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(START + F.col("seconds")))
        frame.coalesce(1).write.mode("append").parquet(path)


def listed(spark, path, **spans):
    """Run over the files so far with one checkpoint; (results, late rows)."""

    def build(ticks):
        stream = run.files_stream(spark, path, spark.read.parquet(path).schema, 1)
        return ordered.in_order(stream, ["uid"], Listing(), ticks=ticks, **spans)

    return run.run_ordered(spark, build, "listing")


def test_rows_are_folded_in_order_whatever_batch_they_came_in(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"u{k}", 10 * k + 7 * i, i, None) for k in range(6) for i in range(12)]
    rng.shuffle(rows)
    write_batches(spark, str(tmp_path / "in"), [rows[i::4] for i in range(4)])
    results, late = listed(spark, str(tmp_path / "in"), delay="1 hour", lifetime="1 day", idle="10 minutes")
    assert late.count() == 0
    assert {r.uid: r.places for r in results.collect()} == {f"u{k}": ",".join(map(str, range(12))) for k in range(6)}


def test_silence_ends_a_session_and_late_rows_go_aside(spark, tmp_path):
    hour = 3600
    batches = [
        [("a", 0, 1, None), ("a", 20, 3, None), ("b", 0, 1, None), ("b", 5, 2, "end")],
        [("a", 10, 2, None), ("c", 2 * hour, 1, None)],  # before its hour is over: in time
        [("c", 4 * hour, 2, None)],  # a and b are over now
        [("a", 15, 9, None), ("b", 3, 9, None), ("b", 5 * hour, 3, None), ("a", 5 * hour, 4, None)],
        [("c", 9 * hour, 3, None), (None, 9 * hour, 1, None)],
    ]
    write_batches(spark, str(tmp_path / "in"), batches)
    results, late = listed(spark, str(tmp_path / "in"), delay="1 hour", lifetime="2 days", idle="1 hour")
    got = sorted((r.uid, r.places) for r in results.collect())
    # Every session stands alone; files are read in the order of their times, which a test may rely on.
    assert got == [("a", "1,2,3"), ("a", "4"), ("b", "1,2"), ("b", "3"), ("c", "1"), ("c", "2"), ("c", "3")]
    assert sorted('"ord":9' in r.late_row for r in late.collect()) == [True, True]


def test_a_lifetime_shorter_than_the_delay_is_refused():
    with pytest.raises(ValueError):
        ordered.Walk(Listing(), 1, ["uid", "places", "late_row"], 10, 5, 1)


class Group:
    """A state handle that remembers, for calls without a stream."""

    def __init__(self, watermark):
        self.value, self.timer, self.watermark = None, None, watermark

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.timer = None

    def setTimeoutTimestamp(self, at):  # noqa: N802
        assert at > self.watermark
        self.timer = at

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark


def test_any_interleaving_of_rows_and_timers_gives_one_result():
    import json

    import pandas as pd

    rng = random.Random(2)
    for _ in range(300):
        delay, lifetime, idle = 1000, 5000, rng.choice([500, 1500])
        times = sorted(rng.sample(range(10_000, 20_000, 50), 15))
        arrival = sorted(range(15), key=lambda i: times[i] + rng.randrange(delay))
        walk, group, out = ordered.Walk(Listing(), 1, ["uid", "places", "late_row"], delay, lifetime, idle), Group(0), []

        def call(rows, walk=walk, group=group, out=out):
            frame = pd.DataFrame([(times[i], i, json.dumps({"ord": i})) for i in rows], columns=["_ms", "ord", "_row"])
            for f in walk(("u",), iter([frame] if len(frame) else []), group):
                out.extend(f.itertuples(index=False, name=None))

        seen = 0
        while arrival:
            n = rng.randrange(1, 4)
            call(arrival[:n])
            seen = max([seen, *(times[i] for i in arrival[:n])])
            arrival = arrival[n:]
            group.watermark = max(group.watermark, seen - lifetime)
            if group.timer is not None and group.timer < group.watermark:
                call([])
        group.watermark = 10**9
        while group.timer is not None:
            call([])
        assert not group.exists
        assert all(late is None for *_, late in out)
        # Sessions are the stretches without a gap of idle.
        want, last = [[]], None
        for i, ts in enumerate(times):
            if last is not None and ts - last >= idle:
                want.append([])
            want[-1].append(str(i))
            last = ts
        assert [places.split(",") for _, places, _ in out] == want


EVENTS = (
    "uid string, seconds bigint, ord bigint, protocol string, kind string, command string, reply_code int, "
    "text string, tag string, client_hello boolean"
)


def dialogues(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        protocol = rng.choice(["smtp", "imap", "pop3"])
        verb = "STLS" if protocol == "pop3" else "STARTTLS"
        hello, start = rng.random() < 0.4, rng.randrange(3000)
        for i in range(rng.randrange(1, 14)):
            kind = rng.choice(["request", "reply", "capability", "starttls", "unexpected", "data", "greeting"])
            command = rng.choice([verb, verb, "AUTH", "LOGIN", "PASS", "NOOP", "CAPA", None])
            text = rng.choice(["OK", "NO", "+OK", "-ERR", f"CAPS {verb}", ".", None])
            code = rng.choice([220, 250, 454, None])
            rows.append((f"u{k}", start + 2 * i, i, protocol, kind, command, code, text, rng.choice(["a", None]), hello))
    rng.shuffle(rows)
    return rows


def test_upgrades_and_protocol_events_equal_their_batch_twins(spark, tmp_path):
    rows, path = dialogues(3, 60), str(tmp_path / "in")
    write_batches(spark, path, [rows[i::5] for i in range(5)], EVENTS)
    events = spark.read.parquet(path)

    def build(fold):
        return lambda ticks: fold(run.files_stream(spark, path, events.schema, 1), ticks=ticks)

    out, late = run.run_ordered(spark, build(online.upgrade_stream), "upgrade")
    frames = events.withColumn("frame_number", F.col("ord"))
    want = {r.uid: r.state for r in sessions.upgrade_outcomes(frames).collect()}
    got = {r.uid: r.state for r in out.collect()}
    assert late.count() == 0 and len(got) == 60
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}

    out, _ = run.run_ordered(spark, build(protocols.protocol_stream), "protocol")
    ends = events.groupBy("uid").agg(F.max("ord").alias("ord")).withColumn("kind", F.lit("end"))
    twin = protocols.protocol_events(events.unionByName(ends, allowMissingColumns=True))
    key = ["uid", "ord", "protocol", "kind", "text"]
    assert sorted(map(str, out.select(key).collect())) == sorted(map(str, twin.select(key).collect()))


def test_packets_in_any_order_equal_the_batch(spark, tmp_path):
    packets = spark.range(400).select(
        F.concat(F.lit("u"), (F.col("id") % 5).cast("string")).alias("uid"),
        (F.col("id") % 2 == 0).alias("is_orig"),
        F.col("id").alias("ord"),
        F.timestamp_seconds(START + F.floor(F.col("id") / 3)).alias("ts"),
        F.when(F.col("id") < 10, "S").otherwise("A").alias("flags"),
        (1 + 10 * F.floor((F.col("id") * 7) % 100 / 10)).alias("seq"),
        F.lit(10).cast("bigint").alias("len"),
    )
    path = str(tmp_path / "packets")
    packets.repartition(4, F.xxhash64("ord")).write.parquet(path)

    def build(ticks):
        return reconstruction.reconstruct_stream(run.files_stream(spark, path, packets.schema, 1), ticks=ticks)

    batch = reconstruction.reconstruct(packets)
    out, late = run.run_ordered(spark, build, "test")
    assert batch.count() > 0 and late.count() == 0
    assert sorted(map(str, out.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_many_keys_share_a_few_state_rows(spark, tmp_path):
    """5000 keys in four buckets: each trigger calls the fold's function a few times and keeps four states."""
    rng = random.Random(4)
    rows = [(f"u{k}", rng.randrange(3000) + i, i, None) for k in range(5000) for i in range(2)]
    rng.shuffle(rows)
    path = str(tmp_path / "in")
    write_batches(spark, path, [rows[i::2] for i in range(2)])
    made = []

    def build(ticks):
        stream = run.files_stream(spark, path, spark.read.parquet(path).schema, 1)
        made.append(ordered.in_order(stream, ["uid"], Listing(), "1 hour", "1 day", "2 hours", ticks, buckets=4))
        return made[-1]

    out, late = run.run_ordered(spark, build, "shared")
    assert late.count() == 0
    first = {}
    for uid, seconds, place, _ in rows:
        first.setdefault(uid, []).append((seconds, place))
    want = {uid: ",".join(str(p) for _, p in sorted(two)) for uid, two in first.items()}
    assert {r.uid: r.places for r in out.collect()} == want
    assert made[0].schema.names == ["uid", "places", "late_row"]


def test_keys_of_a_bucket_do_not_see_each_other():
    import json

    import pandas as pd

    rng = random.Random(6)
    columns = ["_key", "places", "late_row"]
    for _ in range(60):
        rows = [(f"u{rng.randrange(9)}", t, i) for i, t in enumerate(rng.sample(range(10_000, 30_000), 60))]
        walk, group, out = ordered.Buckets(Listing(), 1, columns, 1000, 5000, 700), Group(0), []
        frames = {}

        def call(part, walk=walk, group=group, out=out):
            frame = pd.DataFrame([(k, t, i, json.dumps({"ord": i})) for k, t, i in part], columns=["_key", "_ms", "ord", "_row"])
            for f in walk((0,), iter([frame]), group):
                out.extend(f.itertuples(index=False, name=None))

        alone = []
        for key in sorted({k for k, *_ in rows}):
            frames[key] = [r for r in rows if r[0] == key]
        seen, at = 0, 0
        singles = {k: (ordered.Walk(Listing(), 1, columns, 1000, 5000, 700), Group(0)) for k in frames}
        while at < len(rows) or group.timer is not None:
            part, at = rows[at : at + 7], at + 7
            call([*part, (None, 0, 0)])
            for key, (single, own) in singles.items():
                mine = pd.DataFrame([(t, i, json.dumps({"ord": i})) for k, t, i in part if k == key], columns=["_ms", "ord", "_row"])
                if len(mine) or own.timer is not None:
                    for f in single((key,), iter([mine]), own):
                        alone.extend(f.itertuples(index=False, name=None))
            seen = max([seen, *(t for _, t, _ in part)])
            mark = 10**9 if at >= len(rows) else max(group.watermark, seen - 5000)
            for each in (group, *(g for _, g in singles.values())):
                each.watermark = mark
        assert sorted(map(str, out)) == sorted(map(str, alone)) and not group.exists
