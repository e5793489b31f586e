"""Periodic runs of words, by string synchronising sets.

A run is a maximal stretch of words with smallest period q (words q apart are equal) that repeats at
least ``TURNS`` times. Periods below 2 * ``FIRST_SCALE`` are read off directly. For every dyadic scale
t from there, the periods from 2t to 4t are found in four steps over all texts of a slice at once:

    1. Each window of t words gets a hash. Windows that lie in a run of period t/3 or less, known from
       smaller scales, are set apart: they would make too many places alike.
    2. A place is chosen if the least hash of the t + 1 windows from it stands at its first or its last
       one. Whether it is chosen depends on 2t words only, so equal stretches choose equal places, and
       any t places in a row hold a chosen one unless the text there is highly periodic.
    3. Chosen places followed by equal contexts of 3t (for periods up to 5t/2) or 4t words propose their
       distance to the next one as a period. In a run of period q no shorter distance can occur, as the
       context is at least q long.
    4. A proposal is extended to both sides with prefix hashes and kept if it spans ``TURNS`` periods;
       the words themselves confirm it. A run whose period is a multiple of another's of the same
       stretch is dropped.

Highly periodic regions that step 1 sets apart are runs of smaller periods and were found before.

Cases: a null or empty text, or one without words, has no runs and collapses to an empty text. Repeated
rows get equal results. No documents: an empty result. One text is worked on in one piece, as its runs
may span all of it; kept columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mxposture.llm.common import byte_offsets, empty_text, slices
from mxposture.llm.words import SPACE, mixed, prefix_sums, span_hashes, spans, spans_of

TURNS = 3
LEAST_WORDS = 24
FIRST_SCALE = 4
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64(2**64 - 1)
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _short_period(words: np.ndarray, owner: np.ndarray, period: int) -> Runs:
    same = (words[:-period] == words[period:]) & (owner[:-period] == owner[period:])
    start, end = _stretches(same)
    end = end + period
    long = end - start >= TURNS * period
    return start[long], end[long], np.full(int(long.sum()), period, np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each place on; ``width`` is a power of two plus one."""
    out, reach = values, 1
    while 2 * reach <= width - 1:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[:-1], out[1:])


def _common(sums: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from ``a`` and from ``b`` on (or before them) agree, at most ``limit``."""
    low, high = np.zeros(len(a), np.int64), limit.copy()
    while (low < high).any():
        half = (low + high + 1) // 2
        if forward:
            same = spans_of(sums, a, a + half) == spans_of(sums, b, b + half)
        else:
            same = spans_of(sums, a - half, a) == spans_of(sums, b - half, b)
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def _confirmed(words: np.ndarray, start: int, end: int, period: int, first: int, last: int) -> bool:
    """Whether the words between ``first`` and ``last`` have exactly this maximal stretch."""
    if not np.array_equal(words[start : end - period], words[start + period : end]):
        return False
    left = start == first or words[start - 1] != words[start - 1 + period]
    return left and (end == last or words[end] != words[end - period])


def _extended(words: np.ndarray, sums: np.ndarray, at: np.ndarray, period: np.ndarray, first: np.ndarray, last: np.ndarray) -> Runs:
    """Maximal stretches of the proposals that span ``TURNS`` periods, each once."""
    ahead = _common(sums, at, at + period, last - at - period, True)
    behind = _common(sums, at, at + period, at - first, False)
    start, end = at - behind, at + period + ahead
    long = np.flatnonzero(end - start >= TURNS * period)
    key = np.unique(np.stack([start[long], end[long], period[long], first[long], last[long]], 1), axis=0)
    sound = []
    for s, e, p, f, l in key.tolist():
        if _confirmed(words, s, e, p, f, l):
            sound.append((s, e, p))
            continue
        # Two different stretches under one hash: look at the words of the text themselves.
        starts, ends = _stretches(words[f : l - p] == words[f + p : l])
        sound += [(f + a, f + b + p, p) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= (TURNS - 1) * p]
    rows = np.array(sound, np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _chosen(windows: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising set: places whose least window of scale + 1 is the first or the last."""
    values = np.where(periodic, _NEVER, windows)
    if len(values) <= scale:
        return np.zeros(0, np.int64)
    least = _least(values, scale + 1)
    n = len(least)
    return np.flatnonzero((least != _NEVER) & ((least == values[:n]) | (least == values[scale : scale + n])))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * _ROOT + right)


def _proposals(place: np.ndarray, context: np.ndarray, owner: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance to the next place of the same text with an equal context) within bounds."""
    key = mixed(context ^ mixed(owner.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    distance = place[b] - place[a]
    fits = (key[a] == key[b]) & (owner[a] == owner[b]) & (distance >= low) & (distance <= high)
    return place[a[fits]], distance[fits]


def word_runs(words: np.ndarray, owner: np.ndarray) -> Runs:
    """(start, end, period) of all runs of at least ``TURNS`` periods, places over the whole slice.

    ``words``: a 64-bit name per word; ``owner``: number of its text, ascending.
    """
    n = len(words)
    found = [_short_period(words, owner, q) for q in range(1, 2 * FIRST_SCALE) if q < n]
    # Texts too short for a scale leave; ``base`` leads back to the places of the slice.
    base, scale = np.arange(n), FIRST_SCALE
    while True:
        number, size = np.unique(owner, return_counts=True)
        stay = np.repeat(size >= 2 * TURNS * scale, size)
        if not stay.any():
            break
        if not stay.all():
            words, owner, base = words[stay], owner[stay], base[stay]
            number, size = np.unique(owner, return_counts=True)
        bounds = np.concatenate([[0], np.cumsum(size)])
        first, last = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
        sums = prefix_sums(words)

        def window(width: int) -> np.ndarray:
            at = np.arange(max(0, len(words) - width + 1))
            return spans_of(sums, at, at + width)

        windows = window(scale)
        outside = last[: len(windows)] < np.arange(len(windows)) + scale
        periodic = np.zeros(len(windows) + 1, np.int64)
        for start, end, period in found:
            hit = (3 * period <= scale) & (end - start >= scale)
            start, end = np.searchsorted(base, start[hit]), np.searchsorted(base, end[hit] - 1) + 1
            whole = end - start >= scale  # texts that have left
            np.add.at(periodic, start[whole], 1)
            np.add.at(periodic, end[whole] - scale + 1, -1)
        place = _chosen(windows, (np.cumsum(periodic[:-1]) > 0) | outside, scale)
        proposed = []
        for width, low, high in ((3 * scale, 2 * scale, 5 * scale // 2), (4 * scale, 5 * scale // 2, 4 * scale)):
            fits = place[place + width <= last[place]]
            proposed.append(_proposals(fits, spans_of(sums, fits, fits + width), owner[fits], low, high))
        at, period = (np.concatenate(x) for x in zip(*proposed))
        if len(at):
            start, end, period = _extended(words, sums, at, period, first[at], last[at])
            found.append((base[start], base[end - 1] + 1, period))
        scale *= 2
    start, end, period = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def _collapsed(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, dropped: np.ndarray) -> list[str]:
    out = []
    for k in range(len(offsets) - 1):
        words = data[offsets[k] : offsets[k + 1]].tobytes().split()
        gone = dropped[bounds[k] : bounds[k + 1]]
        if gone.any():
            words = [words[i] for i in np.flatnonzero(~gone).tolist()]
        out.append(b" ".join(words).decode("utf-8", "replace"))
    return out


def with_runs(docs: DataFrame, keep: list[str], text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``keep``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` holds the words joined by one space, of every run only its first period; runs of
    fewer than ``least_words`` words do not count.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("_")])
    rows = docs.select(kept.alias("row"), empty_text(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = byte_offsets(batch.column(1))
            begin, stop, owner = spans(~SPACE[data], offsets)
            start, end, period = word_runs(span_hashes(data, begin, stop), owner)
            long = end - start >= least_words
            start, end, period = start[long], end[long], period[long]
            order = np.lexsort((period, start))
            start, end, period = start[order], end[order], period[order]
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            change = np.zeros(len(owner) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            dropped = np.cumsum(change[:-1]) > 0
            of = owner[start] if len(start) else np.zeros(0, np.int64)
            lists = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            fields = [pa.array(start - bounds[of]), pa.array(end - start), pa.array(period)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(
                        pa.array(lists), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                    ),
                    pa.array(_collapsed(data, offsets, bounds, dropped), pa.string()),
                ],
                names=["row", "runs", "collapsed"],
            )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, runs {RUN_TYPE}, collapsed string"
    out = rows.mapInArrow(scan, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "runs", "collapsed")
