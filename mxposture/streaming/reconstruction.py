"""TCP reconstruction events from packet metadata, as a batch job and as a keyed stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mxposture.operators.scale import CHUNK_ROWS, join_few
from mxposture.session import settled
from mxposture.streaming.ordered import Fold, in_order

EVENT_SCHEMA = (
    "uid string, is_orig boolean, ord bigint, event_type string, seq bigint, len bigint, "
    "range_start bigint, range_end bigint"
)
COLUMNS = [
    "uid",
    "is_orig",
    "ord",
    "event_type",
    "seq",
    "len",
    "range_start",
    "range_end",
]


def step(state: tuple, flags: str, seq: int, size: int) -> tuple[tuple, tuple | None]:
    """State after one packet, and the (event, length) it causes.

    State is (next expected byte or None, highest byte seen ahead or None, anything ahead yet).
    """
    expected, high, future = state
    if "S" in flags:
        return (1, high, future), None
    if size == 0:
        return state, None
    end = seq + size
    if expected is None:
        return (end, high, future), None
    if seq == expected:
        event = ("out_of_order", size) if future else None
        return (max(end, high) if high is not None else end, high, future), event
    if seq > expected:
        return (expected, end if high is None else max(high, end), True), None
    if end <= expected:
        return state, ("duplicate", size)
    return state, ("overlap", expected - seq)


def _row(uid, is_orig, position, seq, event) -> tuple:
    kind, size = event
    placed = seq > 0 and size > 0
    return (
        uid, is_orig, position, kind, seq if seq > 0 else None, size if size > 0 else None,
        seq if placed else None, seq + size if placed else None,
    )


def walk(state: tuple, syn: list, seq: list, size: list) -> tuple[tuple, list[tuple]]:
    """State after a stretch of packets and its events as (index, (event, length))."""
    out = []
    expected, high, future = state
    i, n = 0, len(seq)
    while i < n:
        if not syn[i] and size[i] and seq[i] == expected and not future and high is None:
            # Packets in order: nothing to note until one is not the next.
            while i < n and seq[i] == expected and not syn[i]:
                expected += size[i]
                i += 1
            continue
        (expected, high, future), event = step((expected, high, future), "S" if syn[i] else "", seq[i], size[i])
        if event:
            out.append((i, event))
        i += 1
    return (expected, high, future), out


KEY = ["uid", "is_orig"]
START = "start_expected bigint, start_high bigint, start_future boolean"
_START_COLUMNS = ["start_expected", "start_high", "start_future"]
_INITIAL = (None, None, False)
_WALKED = (
    "uid string, is_orig boolean, chunk bigint, first_seq bigint, min_seq bigint, max_seq bigint, max_end bigint, has_syn boolean, "
    "guess_expected bigint, guess_high bigint, guess_future boolean, expected bigint, high bigint, future boolean"
)
_STARTS = f"uid string, is_orig boolean, chunk bigint, {START}, blocked boolean"


def _optional(value):
    return None if value is None or value != value else int(value)


class Stretch:
    """The packets of one chunk as lists, and the state it starts from if a row brought one."""

    def __init__(self, name: tuple):
        self.name, self.start = name, None
        self.place: list[int] = []
        self.syn: list[bool] = []
        self.seq: list[int] = []
        self.size: list[int] = []


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[Stretch]:
    now: Stretch | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        names = list(zip(pdf["uid"], pdf["is_orig"], pdf["chunk"], strict=True))
        flags = pdf["flags"].fillna("")
        syn, state = flags.str.contains("S", regex=False).tolist(), flags.eq(_STATE_ROW).to_numpy().nonzero()[0].tolist()
        place, seq, size = (pdf[c].fillna(0).astype("int64").tolist() for c in ("ord", "seq", "len"))
        starts = {i: tuple(pdf[c].iat[i] for c in _START_COLUMNS) for i in state}
        at, n = 0, len(names)
        while at < n:
            end = at + 1
            while end < n and names[end] == names[at]:
                end += 1
            if now is None or now.name != names[at]:
                if now is not None:
                    yield now
                now = Stretch(names[at])
            if at in starts:
                expected, high, future = starts[at]
                now.start = (_optional(expected), _optional(high), bool(future))
                at += 1
            now.place += place[at:end]
            now.syn += syn[at:end]
            now.seq += seq[at:end]
            now.size += size[at:end]
            at = end
    if now is not None:
        yield now


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk walked from the state it came with, or from the guess that it starts in order."""
    out = []
    for c in _stretches(batches):
        data = [(q, n) for s, q, n in zip(c.syn, c.seq, c.size, strict=True) if n and not s]
        first = data[0][0] if data else None
        guess = c.start if c.start is not None else (first, None, False)
        after, _ = walk(guess, c.syn, c.seq, c.size)
        low = min((q for q, _ in data), default=None)
        top = max((q for q, _ in data), default=None)
        end = max((q + n for q, n in data), default=None)
        out.append((*c.name, first, low, top, end, any(c.syn), *guess, *after))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in _WALKED.split(", ")], dtype=object)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def after_chunk(state: tuple, c: dict) -> tuple[tuple, bool]:
    """(state after a chunk, whether it is certain) from what one walk of the chunk showed.

    The chunk's walk holds if it began at the expected byte and what lies ahead cannot matter; a chunk
    that only holds bytes beyond, or only bytes before the expected one, leaves that byte as it is.
    """
    expected, high, future = state
    guess = (c["guess_expected"], c["guess_high"], c["guess_future"])
    # The first packet with data sets the expected byte; the guess says the same of it.
    opened = state[:2] == (None, None) and guess[:2] == (c["first_seq"], None)
    apart = expected is not None and high is not None and high <= expected and not c["has_syn"]
    if state[:2] == guess[:2] or opened or (apart and guess[:2] == (expected, None)):
        return (c["expected"], _most(high, c["high"]), future or c["future"]), True
    if c["min_seq"] is None and not c["has_syn"]:
        return state, True
    if expected is not None and not c["has_syn"]:
        if c["min_seq"] > expected:
            return (expected, _most(high, c["max_end"]), True), True
        if c["max_seq"] < expected:
            return state, True
    return (c["expected"], _most(high, c["high"]), future or c["future"]), False


def _fold(chunks: pd.DataFrame) -> pd.DataFrame:
    """State before each chunk of one direction; ``blocked`` where it was not what the walk assumed.

    From the first blocked chunk on, states are the best guess for the next walk.
    """
    state, out = _INITIAL, []
    for c in chunks.sort_values("chunk").to_dict("records"):
        c = {k: _optional(v) if k.endswith(("seq", "end", "expected", "high")) else v for k, v in c.items()}
        following, certain = after_chunk(state, c)
        out.append((c["uid"], c["is_orig"], c["chunk"], *state, not certain))
        state = following
    return pd.DataFrame(out, columns=[*KEY, "chunk", *_START_COLUMNS, "blocked"], dtype=object)


def _events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=COLUMNS).astype(
            {c: "Int64" for c in ("ord", "seq", "len", "range_start", "range_end")}
        )

    for c in _stretches(batches):
        _, events = walk(_INITIAL if c.start is None else c.start, c.syn, c.seq, c.size)
        out += [_row(*c.name[:2], c.place[i], c.seq[i], e) for i, e in events]
        if len(out) > 10_000:
            yield frame()
            out = []
    yield frame()


_STATE_ROW = "#"


def _with_states(rows: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Chunks in one place each, in order, a row with the starting state before the packets."""
    if starts is not None:
        state = starts.select(
            *KEY, "chunk", F.lit(-(1 << 62)).alias("ord"), F.lit(_STATE_ROW).alias("flags"), *_START_COLUMNS
        )
        rows = rows.unionByName(state, allowMissingColumns=True)
    return rows.repartition(*KEY, "chunk").sortWithinPartitions(*KEY, "chunk", "ord")


def reconstruct(packets: DataFrame, width: int = CHUNK_ROWS, chunk: Column | None = None) -> DataFrame:
    """Out-of-order, duplicate and overlap events of packets (uid, is_orig, ord, flags, seq, len).

    A direction is cut into chunks of ``ord`` (``chunk`` gives another non-decreasing function of it),
    each walked by itself. All but the first are walked from a guess: that the chunk begins with the
    byte expected next. What a walk showed about its chunk (one row) is folded along the direction; a
    chunk whose guess proved wrong, in a way that matters, is walked again from the state it really
    starts with, as often as that changes something. Every round settles one more chunk at least, and
    usually all: a walk falls into step with the first packet that is the expected one. Then all chunks
    are walked once more for their events.
    """
    cut = F.floor(F.col("ord") / width).cast("bigint") if chunk is None else chunk.cast("bigint")
    rows = packets.select(*KEY, "ord", "flags", "seq", "len", cut.alias("chunk"))
    rows = rows.where(F.col("seq").isNotNull() & F.col("len").isNotNull())
    ends = rows.agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).first()
    if ends["a"] == ends["b"]:
        return _with_states(rows, None).mapInPandas(_events, EVENT_SCHEMA)
    # Directions of one chunk start from nothing and need no summary.
    several = rows.groupBy(*KEY).agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").select(*KEY)
    several = settled(several)
    short = join_few(rows, several, KEY, "left_anti")
    rows = settled(join_few(rows, several, KEY, "left_semi"))
    walked = settled(_with_states(rows, None).mapInPandas(_summaries, _WALKED))
    while True:
        starts = settled(walked.groupBy(*KEY).applyInPandas(_fold, _STARTS))
        again = starts.where("blocked")
        # One number a round is read back.
        if not again.count():
            break
        some = rows.join(again.select(*KEY, "chunk"), [*KEY, "chunk"], "left_semi")
        fresh = _with_states(some, again).mapInPandas(_summaries, _WALKED)
        walked = settled(walked.join(again.select(*KEY, "chunk"), [*KEY, "chunk"], "left_anti").unionByName(fresh))
    return _with_states(rows.unionByName(short), starts).mapInPandas(_events, EVENT_SCHEMA)


def flagged_events(packets: DataFrame) -> DataFrame:
    """Gap, retransmission and inconsistency events the analyzer already marked (column mark)."""
    names = {"gap": "seq_gap", "rexmit": "rexmit", "inconsistent": "rexmit_inconsistency"}
    kind = None
    for mark, name in names.items():
        kind = F.when(F.col("mark") == mark, name) if kind is None else kind.when(F.col("mark") == mark, name)
    placed = (F.col("event_type") != "rexmit_inconsistency") & (F.col("seq") > 0) & (F.col("len") > 0)
    return (
        packets.withColumn("event_type", kind)
        .where(F.col("event_type").isNotNull())
        .select(
            "uid",
            "is_orig",
            "ord",
            "event_type",
            F.when(F.col("event_type") != "rexmit_inconsistency", F.col("seq")).alias("seq"),
            "len",
            F.when(placed, F.col("seq")).alias("range_start"),
            F.when(placed, F.col("seq") + F.col("len")).alias("range_end"),
        )
    )


class ReconstructionFold(Fold):
    """The same walk with the state kept between micro-batches."""

    FIELDS = ["flags", "seq", "len"]
    OUTPUT = EVENT_SCHEMA.split(", ", 2)[2]

    def blank(self) -> dict:
        return {"tcp": (None, None, False)}

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        state["tcp"], event = step(state["tcp"], row.get("flags") or "", row["seq"], row["len"])
        if event:
            yield _row(None, None, row["ord"], row["seq"], event)[2:]


def reconstruct_stream(packets: DataFrame, **more) -> DataFrame:
    """``packets``: uid, is_orig, ts, ord, flags, seq, len."""
    return in_order(packets, ["uid", "is_orig"], ReconstructionFold(), **more)
