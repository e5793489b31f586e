"""Token ids on disk: one id array a segment, document borders as an Elias-Fano sequence.

Documents are put in key order by a range exchange, so a task holds one stretch of the order and
writes it as segments of about ``ids_per_segment`` ids; a document is never cut. A segment is one
row of a Parquet table:

    segment   long    order of the segments: (range piece << 32) + place in the piece
    n_docs    long    documents in it
    n_ids     long    ids in it
    keys      array   the documents' keys, in order
    borders   binary  n_docs + 1 borders (0, ..., n_ids), Elias-Fano coded
    width     int     bytes of an id, 2 or 4
    ids       binary  all ids, little-endian

Elias-Fano: of n borders up to u the lowest l = floor(log2(u / n)) bits are stored as they are, the
rest as a bit array with a one at place (border >> l) + i, which takes at most 2 + l bits a border.
Select samples hold the place of every 64th one, so ``Borders.at(i)`` reads a few bytes.

Cases: a null or empty text is a document of the end id only. A null key sorts first. Rows with
equal keys follow in the order of their texts; equal rows stay separate documents. No documents: no
segments and an empty table. Other columns are ignored. A text longer than a segment is a segment of
its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mxposture.llm.common import byte_offsets, empty_text, slices
from mxposture.llm.units import units

IDS_PER_SEGMENT = 2 << 20
SAMPLED = 64
SEGMENT = "segment long, n_docs long, n_ids long, keys array<long>, borders binary, width int, ids binary"


class Borders:
    """A non-decreasing sequence in Elias-Fano form with select samples."""

    def __init__(self, raw: bytes):
        head = np.frombuffer(raw, "<i8", 3)
        self.n, self.bound, self.low_bits = map(int, head)
        n_samples = -(-self.n // SAMPLED)
        low_size = -(-self.n * self.low_bits // 8)
        at = 24
        self.samples = np.frombuffer(raw, "<u4", n_samples, at)
        at += 4 * n_samples
        self.low = np.frombuffer(raw, np.uint8, low_size, at)
        self.high = np.frombuffer(raw, np.uint8, -1, at + low_size)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        n, bound = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        places = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        low = (values[:, None] >> np.arange(low_bits)) & 1
        return b"".join(
            [
                np.array([n, bound, low_bits], "<i8").tobytes(),
                places[::SAMPLED].astype("<u4").tobytes(),
                np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
                np.packbits(high, bitorder="little").tobytes(),
            ]
        )

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << k
        return out

    def at(self, i: int) -> int:
        """The i-th border: from its sample, only the bytes up to its one are read."""
        place, left = int(self.samples[i // SAMPLED]), i % SAMPLED
        byte, first = place >> 3, place & 7
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[first:])
            if left < len(ones):
                place = byte * 8 + first + int(ones[left])
                return ((place - i) << self.low_bits) | int(self._low(np.array([i]))[0])
            left -= len(ones)
            byte, first = byte + 1, 0

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        i = np.arange(self.n)
        return ((places - i) << self.low_bits) | self._low(i)


def segment_row(piece: int, number: int, keys: list, lengths: np.ndarray, ids: np.ndarray, width: int) -> dict:
    borders = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=borders[1:])
    return {
        "segment": [(piece << 32) + number],
        "n_docs": [len(keys)],
        "n_ids": [len(ids)],
        "keys": [keys],
        "borders": [Borders.encode(borders)],
        "width": [width],
        "ids": [ids.astype(f"<u{width}").tobytes()],
    }


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    spaced: bool = False,
    ids_per_segment: int = IDS_PER_SEGMENT,
) -> DataFrame:
    """The segments of ``docs`` (see the module), in ascending ``key`` order."""
    schema = pa.schema(
        [
            ("segment", pa.int64()),
            ("n_docs", pa.int64()),
            ("n_ids", pa.int64()),
            ("keys", pa.list_(pa.int64())),
            ("borders", pa.binary()),
            ("width", pa.int32()),
            ("ids", pa.binary()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = units(tokenizer, spaced)
        width = 2 if max(own.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        piece, number = TaskContext.get().partitionId(), 0
        keys: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            made = segment_row(piece, number, keys, np.concatenate(lengths), np.concatenate(ids), width)
            return pa.RecordBatch.from_pydict(made, schema)

        for batch in slices(batches):
            found, bounds = own.encode(*byte_offsets(batch.column(1)))
            ended = np.insert(found, bounds[1:], np.uint32(end_id))
            names = batch.column(0).to_pylist()
            borders = bounds + np.arange(len(bounds))
            at = 0
            while at < len(names):
                # Up to the document that fills the segment.
                full = np.searchsorted(borders, borders[at] + ids_per_segment - size)
                stop = min(len(names), max(at + 1, int(full)))
                keys += names[at:stop]
                lengths.append(np.diff(borders[at : stop + 1]))
                ids.append(ended[borders[at] : borders[stop]])
                size += int(borders[stop] - borders[at])
                at = stop
                if size >= ids_per_segment:
                    yield row()
                    keys, lengths, ids, size, number = [], [], [], 0, number + 1
        if keys:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias("key"), empty_text(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    return ordered.mapInArrow(pack, SEGMENT)


def documents_of(segments: DataFrame) -> DataFrame:
    """Per document: segment, place in it, key, border in it, n_tokens and the ids' checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                borders = Borders(row["borders"]).all()
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["segment"])),
                        pa.array(np.arange(n)),
                        pa.array(row["keys"], pa.int64()),
                        pa.array(borders[:-1]),
                        pa.array(np.diff(borders)),
                        pa.array(np.array(crc, np.int64)),
                    ],
                    names=["segment", "place", "key", "border", "n_tokens", "ids_crc32"],
                )

    return segments.select("segment", "keys", "borders", "width", "ids").mapInArrow(
        read, "segment long, place long, key long, border long, n_tokens long, ids_crc32 long"
    )


def segment_starts(segments: DataFrame) -> DataFrame:
    """(segment, base): the ids of all earlier segments.

    Two levels, so that no task sees more than one range piece's segments or one row a piece.
    """
    sizes = segments.select("segment", "n_ids", F.shiftright("segment", 32).alias("piece"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = sizes.groupBy("piece").agg(F.sum("n_ids").alias("n"))
    bases = pieces.select("piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("piece").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return local.join(bases, "piece").select("segment", (F.col("before") + F.col("inside")).alias("base"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, **more) -> DataFrame:
    """Writes the segments of ``docs`` at ``path`` and returns them as read back."""
    packed(docs, tokenizer, end_id, **more).write.parquet(path)
    return docs.sparkSession.read.schema(SEGMENT).parquet(path)
