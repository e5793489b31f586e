"""Benchmark passages in documents, by the q-gram lemma over diagonal bands.

Both sides are lower-cased and everything but letters and digits becomes one space. A benchmark item
is cut into windows of ``WINDOW`` characters, every ``STRIDE`` one, the last one flush with its end;
a shorter item is one window. A window of m characters within e edits (one in ``PER_EDIT``) of a
region shares at least m - q + 1 - q * e of its q-grams with it, on diagonals at most 2e apart.
So the shared q-grams are counted in bands of diagonals that overlap by the largest 2e; bands below
their window's bound cannot hold a match and are left. The others are verified by alignment inside
the band, which gives the edits and the place.

The benchmark is read in parts of at most ``PART_CHARS`` characters, so what is broadcast is bounded;
documents are only streamed by. A text is matched whole, however long.

Cases: null or empty texts and windows of fewer than q + 1 characters match nothing. An item without
an id keeps a null item_id. Repeated items and rows give repeated matches. Empty tables: no match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from mxposture.llm.common import byte_offsets, code_points, empty_text, per_text, prefixed, slices

Q = 12
WINDOW = 120
STRIDE = 60
PER_EDIT = 15
BAND = 32
PART_CHARS = 8_000_000
SIEVE_BITS = 22

_FOLD = np.full(1 << 16, 0x20, np.uint32)
for _i in range(1 << 16):
    if not 0xD800 <= _i < 0xE000 and chr(_i).isalnum():
        _low = chr(_i).lower()
        _FOLD[_i] = ord(_low) if len(_low) == 1 else _i
SPACE = np.uint32(0x20)
_BASE = 0x9E3779B97F4A7C15
_ROOT = [np.uint64(pow(_BASE, k, 2**64)) for k in (1, 2, 4)]
OUTSIDE = np.uint32(0xFFFFFFFF)
ALIGNED_TOGETHER = 1024


def normalised(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, place of each in ``points``, bounds of the texts among them)."""
    symbols = np.where(points < 1 << 16, _FOLD[points & 0xFFFF], points)
    blank = symbols == SPACE
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[first] = ~blank[first]
    place = np.flatnonzero(keep)
    return symbols[place], place, np.searchsorted(place, bounds)


def gram_keys(symbols: np.ndarray) -> np.ndarray:
    """A 64-bit key of the q-gram that begins at each place, up to the last whole one."""
    n = len(symbols) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Polynomial hashes of 2, 4 and 8 symbols make up the one of 12.
    two = symbols[:-1].astype(np.uint64) * _ROOT[0] + symbols[1:]
    four = two[:-2] * _ROOT[1] + two[2:]
    eight = four[:-4] * _ROOT[2] + four[4:]
    return (eight[:n] * _ROOT[2] + four[8 : 8 + n]) * _ROOT[0]


class Index:
    """The windows of some benchmark items and where each q-gram stands in them."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.windows: list[np.ndarray] = []
        self.item: list[int | None] = []
        for item, text in items:
            points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
            symbols = normalised(points, np.array([0, len(points)]))[0]
            if len(symbols) and symbols[-1] == SPACE:
                symbols = symbols[:-1]
            last = len(symbols) - WINDOW
            starts = [0] if last <= 0 else sorted({*range(0, last, STRIDE), last})
            for s in starts:
                if len(symbols[s : s + WINDOW]) > Q:
                    self.windows.append(symbols[s : s + WINDOW])
                    self.item.append(item)
        size = np.array([len(w) for w in self.windows], np.int64)
        self.edits = np.minimum(size // PER_EDIT, (size - Q) // Q)
        self.bound = size - Q + 1 - Q * self.edits
        self.overlap = int(2 * self.edits.max()) if len(size) else 0
        keys = [gram_keys(w) for w in self.windows]
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        window = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.window, self.place = window[order], place[order]
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.keys >> np.uint64(64 - SIEVE_BITS)] = True

    def bands(self, symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, window, least diagonal) of the bands that reach their window's bound."""
        keys = gram_keys(symbols)
        at = np.flatnonzero(self.sieve[keys >> np.uint64(64 - SIEVE_BITS)])
        row = np.searchsorted(self.keys, keys[at])
        row[row == len(self.keys)] = 0
        real = self.keys[row] == keys[at] if len(self.keys) else np.zeros(0, bool)
        at, row = at[real], row[real]
        text = np.searchsorted(bounds, at, "right") - 1
        inside = at + Q <= bounds[text + 1]
        at, row, text = at[inside], row[inside], text[inside]
        if not len(at):
            return
        times = self.count[row]
        hit = np.repeat(self.first[row], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        window, text = self.window[hit], np.repeat(text, times)
        diagonal = np.repeat(at, times) - self.place[hit] + WINDOW
        band = diagonal // BAND
        # The overlap is at most 2 * WINDOW / PER_EDIT, less than a band: two bands at most.
        twice = diagonal % BAND < self.overlap
        window, text = np.concatenate([window, window[twice]]), np.concatenate([text, text[twice]])
        band = np.concatenate([band, band[twice] - 1])
        order = np.lexsort((band, window, text))
        text, window, band = text[order], window[order], band[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (window[1:] != window[:-1]) | (band[1:] != band[:-1])
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(text)))
        for k in start[n >= self.bound[window[start]]]:
            yield int(text[k]), int(window[k]), int(band[k]) * BAND - WINDOW

    def aligned(self, symbols: np.ndarray, bounds: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, edits) of the best place of each row (text, window, diagonal) of ``bands``.

        All rows go through the pattern together. A column is a diagonal, from the band's first less
        the edits to its last plus the edits; outside the text stands a symbol that equals none.
        """
        text, window, diagonal = bands.T
        allowed = int(self.edits.max())
        width = BAND + self.overlap + 2 * allowed + 1
        first = diagonal - allowed
        longest = max(len(self.windows[w]) for w in np.unique(window))
        place = first[:, None] + np.arange(longest + width)
        inside = (place >= bounds[text][:, None]) & (place < bounds[text + 1][:, None])
        region = np.where(inside, symbols[np.clip(place, 0, len(symbols) - 1)], OUTSIDE)
        size = np.array([len(self.windows[w]) for w in window])
        patterns = np.zeros((len(bands), longest), np.uint32)
        for k, w in enumerate(window):
            patterns[k, : size[k]] = self.windows[w]
        ramp = np.arange(width)
        cost = np.zeros((len(bands), width), np.int64)
        began = np.broadcast_to(ramp, cost.shape).copy()
        for i in range(longest):
            # The next symbol of the pattern meets one of the text, or has no partner.
            best = cost + (region[:, i : i + width] != patterns[:, i, None])
            source = began.copy()
            alone = cost[:, 1:] + 1 < best[:, :-1]
            best[:, :-1][alone] = (cost[:, 1:] + 1)[alone]
            source[:, :-1][alone] = began[:, 1:][alone]
            # Symbols of the text without a partner: each costs one more than its left neighbour.
            level = best - ramp
            lowest = np.minimum.accumulate(level, axis=1)
            leader = np.maximum.accumulate(np.where(level == lowest, ramp, 0), axis=1)
            going = (i < size)[:, None]
            cost = np.where(going, lowest + ramp, cost)
            began = np.where(going, np.take_along_axis(source, leader, 1), began)
        end = cost.argmin(axis=1)
        rows = np.arange(len(bands))
        edits = cost[rows, end]
        start = np.maximum(first + began[rows, end], bounds[text])
        stop = np.minimum(first + size + end, bounds[text + 1])
        return start, stop, np.where(edits <= self.edits[window], edits, -1)


def matches(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int | None, int, int, int, int]]:
    """(text, item, start, end, windows, edits) per text and item; places in code points."""
    points = code_points(data)
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(per_text((data & 0xC0) != 0x80, offsets), out=bounds[1:])
    symbols, place, limits = normalised(points, bounds)
    found: dict[tuple, list[int]] = {}
    seen: set[tuple[int, int, int]] = set()
    bands = np.array(list(index.bands(symbols, limits)), np.int64).reshape(-1, 3)
    for k in range(0, len(bands), ALIGNED_TOGETHER):
        part = bands[k : k + ALIGNED_TOGETHER]
        for (text, window, _), first, last, edits in zip(part.tolist(), *index.aligned(symbols, limits, part)):
            if edits < 0 or first >= last or (text, window, first) in seen:
                continue
            seen.add((text, window, first))
            start, end = int(place[first] - bounds[text]), int(place[last - 1] - bounds[text]) + 1
            span = found.setdefault((text, index.item[window]), [start, end, 0, 0])
            span[:] = [min(span[0], start), max(span[1], end), span[2] + 1, span[3] + int(edits)]
    return [(t, item, *span) for (t, item), span in found.items()]


def indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text", part_chars: int = PART_CHARS):
    """Broadcast indexes over parts of the benchmark, each of bounded size."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), empty_text(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // part_chars))
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in part.collect()]))


FOUND = ["item_id", "start", "end", "windows", "edits"]


def found(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", **more) -> DataFrame:
    """``keep`` of a document, the item, where its windows match, how many, and their edits."""
    rows = docs.select(*keep, empty_text(text).alias("_text"))
    schema = StructType(rows.drop("_text").schema.fields + [StructField("item_id", LongType())])
    schema = StructType(schema.fields + [StructField(n, IntegerType()) for n in FOUND[1:]])

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text"):
                hits = matches(shared.value, *byte_offsets(batch.column(batch.num_columns - 1)))
                at = pa.array([h[0] for h in hits], pa.int64())
                columns = [batch.column(k).take(at) for k in range(len(keep))]
                columns.append(pa.array([h[1] for h in hits], pa.int64()))
                columns += [pa.array([h[k] for h in hits], pa.int32()) for k in range(2, 6)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, [scan(shared) for shared in indexes(benchmark, **more)])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, columns unchanged."""
    copy = prefixed(docs.columns, "_text")

    def without(df: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, copy):
                hits = matches(shared.value, *byte_offsets(batch.column(batch.num_columns - 1)))
                stays = np.ones(batch.num_rows, bool)
                stays[[h[0] for h in hits]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(stays))

        return df.withColumn(copy, empty_text(text)).mapInArrow(run, df.schema)

    return reduce(without, indexes(benchmark, **more), docs)
