"""Documents packed into sequences of a fixed length by a configuration program.

The corpus enters the program only as its length histogram (at most ``size`` numbers, whatever its
size). A configuration is a multiset of lengths that fits a sequence. The program "as few
configurations as cover the histogram" is solved by multiplicative weights: every length has a
price, prices fall exponentially with how well a length is covered already, and one dynamic program
over the knapsack of ``size`` tokens finds, for each length at once, the configuration of most
worth that holds it. The fractional solution is rounded down, what is left over goes through the
same steps again, and the rest of the last round, whose size depends on the number of configurations
alone, is put by best fit. The result is a list of (configuration, how often); a piece finds its
sequence from its length and its rank among the pieces of that length.

Ranks are made of a number inside the task, given where the text is encoded, and the counts of the
tasks before; no length, however frequent, meets in one task.

Cases: a null or empty text is the end id alone. A document longer than ``size`` is cut: its first
piece takes the remainder, all others are full. Rows with equal ids stay separate documents. No
documents: an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mxposture.llm.common import byte_offsets, empty_text, settled, slices
from mxposture.llm.units import units

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"
ROUNDS = (24, 12, 6)
SHARPNESS = 2.0


def cut(total: int, size: int) -> list[int]:
    """Where the pieces of a document of ``total`` ids begin."""
    return [0] if total <= size else [0, *range(total % size or size, total, size)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, spaced: bool = True) -> DataFrame:
    """The pieces of all documents, each numbered among the pieces of its length in its task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = units(tokenizer, spaced)
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in slices(batches):
            found, bounds = own.encode(*byte_offsets(batch.column(1)))
            ids = np.insert(found, bounds[1:], np.uint32(end_id)).astype("<u4")
            raw = memoryview(ids).cast("B")
            at = (bounds + np.arange(len(bounds))).tolist()
            out: list[list] = [[], [], [], [], []]
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:]):
                starts = cut(b - a, size)
                for k, (s, e) in enumerate(zip(starts, [*starts[1:], b - a])):
                    values = (doc, k, s, e - s, zlib.crc32(raw[4 * (a + s) : 4 * (a + e)]))
                    for column, value in zip(out, values):
                        column.append(value)
            length = np.array(out[3])
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            run = np.arange(len(ranked)) - np.repeat(first, np.diff(np.r_[first, len(ranked)]))
            local = np.empty(len(length), np.int64)
            local[order] = seen[ranked] + run
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int64()),
                    pa.array(out[1], pa.int32()),
                    pa.array(out[2], pa.int64()),
                    pa.array(length),
                    pa.array(out[4], pa.int64()),
                    pa.array(np.full(len(length), task, np.int32)),
                    pa.array(local),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"],
            )

    return docs.select(F.col("doc_id").cast("long"), empty_text().alias("text")).mapInArrow(encode, PIECE)


def knapsack(worth: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(most worth within w, the last item taken or -1) for every w up to ``size``."""
    best = np.zeros(size + 1)
    taken = np.full(size + 1, -1)
    for w in range(1, size + 1):
        best[w] = best[w - 1]
        upto = np.searchsorted(lengths, w, "right")
        if upto:
            value = best[w - lengths[:upto]] + worth[:upto]
            k = int(value.argmax())
            if value[k] > best[w] + 1e-12:
                best[w], taken[w] = value[k], k
    return best, taken


def filled(first: int, taken: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, ...]:
    """The configuration of most worth that holds item ``first``, as sorted items."""
    items, room = [first], size - int(lengths[first])
    while room > 0:
        k = int(taken[room])
        if k < 0:
            room -= 1
            continue
        items.append(k)
        room -= int(lengths[k])
    return tuple(sorted(items))


def fractional(lengths: np.ndarray, need: np.ndarray, size: int, rounds: int) -> dict[tuple[int, ...], float]:
    """Configurations and how often each is used, after ``rounds`` of multiplicative weights."""
    covered = np.zeros(len(lengths))
    used: dict[tuple[int, ...], float] = {}
    for t in range(1, rounds + 1):
        worth = lengths / size * np.exp(SHARPNESS * (t / rounds - covered / need))
        _, taken = knapsack(worth, lengths, size)
        short = np.maximum(t / rounds * need - covered, 0.0)
        for k in np.argsort(-lengths * (short > 0)):
            lack = t / rounds * need[k] - covered[k]
            if lack <= 0:
                continue
            items = filled(int(k), taken, lengths, size)
            times = lack / items.count(int(k))
            used[items] = used.get(items, 0.0) + times
            np.add.at(covered, list(items), times)
    return used


@dataclass
class Plan:
    """Rows sorted by (length, first rank): which ranks of a length go where."""

    length: np.ndarray
    rank: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = self.length * (1 << 45) + self.rank
        row = np.searchsorted(order, length * (1 << 45) + rank, "right") - 1
        at = rank - self.rank[row]
        return (
            self.sequence[row] + at // self.copies[row],
            self.offset[row] + at % self.copies[row] * length,
        )


def solve(histogram: dict[int, int], size: int, rounds: tuple[int, ...] = ROUNDS) -> Plan:
    """A plan that places every piece of ``histogram`` (length to count)."""
    left = {l: n for l, n in histogram.items() if n and l < size}
    chosen: list[tuple[tuple[int, ...], int]] = []
    if histogram.get(size):
        chosen.append(((size,), histogram[size]))
    for n_rounds in rounds:
        if not left:
            break
        lengths = np.array(sorted(left))
        rest = np.array([left[int(l)] for l in lengths])
        used = fractional(lengths, rest.astype(float), size, n_rounds)
        # The fullest configurations first: what overflows the histogram is dropped from the worst.
        for items, times in sorted(used.items(), key=lambda x: (-int(lengths[list(x[0])].sum()), x[0])):
            distinct, copies = np.unique(items, return_counts=True)
            n = int(min(np.floor(times), (rest[distinct] // copies).min()))
            if n > 0:
                rest[distinct] -= n * copies
                chosen.append((tuple(int(lengths[k]) for k in items), n))
        left = {int(l): int(n) for l, n in zip(lengths, rest) if n}
    chosen += best_fit(left, size)
    return plan(chosen)


def best_fit(left: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest open sequence that has room."""
    open_by_room: list[list[list[int]]] = [[] for _ in range(size + 1)]
    for length in sorted(left, reverse=True):
        room = length
        for _ in range(left[length]):
            while room <= size and not open_by_room[room]:
                room += 1
            if room > size:
                open_by_room[size - length].append([length])
            else:
                sequence = open_by_room[room].pop()
                sequence.append(length)
                open_by_room[room - length].append(sequence)
                room = min(room, max(length, room - length))
            if room > size:
                room = size - length if size - length >= length else size + 1
    counts: dict[tuple[int, ...], int] = {}
    for group in open_by_room:
        for sequence in group:
            items = tuple(sorted(sequence))
            counts[items] = counts.get(items, 0) + 1
    return sorted(counts.items())


def plan(chosen: list[tuple[tuple[int, ...], int]]) -> Plan:
    given: dict[int, int] = {}
    rows = []
    sequence = 0
    for items, times in chosen:
        offset = 0
        for length in sorted(set(items), reverse=True):
            copies = items.count(length)
            rank = given.get(length, 0)
            rows.append((length, rank, copies, sequence, offset))
            given[length] = rank + copies * times
            offset += copies * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequence)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int, spaced: bool = True) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut_up = settled(pieces(docs, tokenizer, end_id, size, spaced))
    per_task = settled(cut_up.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(solve(histogram, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut_up.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("local"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            sequence, offset = shared.value.place(
                columns["length"].to_numpy(), columns.pop("rank").to_numpy()
            )
            yield pa.RecordBatch.from_pydict(
                columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(put, schema)
