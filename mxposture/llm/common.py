"""Helpers shared by the text operators: checkpoints, bounded Arrow slices, safe columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
"""Texts are worked on in slices of about this many bytes; one longer text is a slice of its own."""


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder of ``spark.checkpoint.dir``.

    A later reader finds the rows there even if the executor that made them is gone. Only a local
    session may go without the setting; it then gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def prefixed(columns: list[str], stem: str) -> str:
    """A column name that starts with ``stem`` and clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about SLICE_BYTES of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = byte_offsets(batch.column(batch.schema.get_field_index(text)))[1][1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else ends[0] * 0
            stop = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    # The worker stays for other tasks; what Arrow keeps for reuse would add up beside the JVM.
    pa.default_memory_pool().release_unused()


def byte_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, int64 offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, raw_offsets, raw_data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw_data, np.uint8) if raw_data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(data: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes, broken bytes replaced."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per byte) inside each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def empty_text(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new path under the shared folder of the cluster (see ``settled``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def released(spark: SparkSession) -> None:
    """Let go of what finished work left behind: call when its result is written.

    Spark removes the files of shuffles and the compiled code of plans that the driver's JVM has found
    unreachable, which it may otherwise do only much later.
    """
    spark.sparkContext._jvm.System.gc()


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


PREFIX_CHUNK = 256


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is mentioned in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefixes(values: Column, op) -> Column:
    """Per value, ``op`` (a sum or a maximum) over 0 and all values before it.

    Folds over chunks, then over the chunks' totals, so the cost grows with the array, not its square.
    """

    def fold(part: Column, base: Column) -> Column:
        return F.aggregate(part, F.array(base), lambda out, x: F.concat(out, F.array(op(F.element_at(out, -1), x))))

    def by_chunk(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), op))
        bases = F.slice(fold(totals, F.lit(0)), 1, F.size(chunks))
        return F.flatten(F.zip_with(chunks, bases, lambda c, base: F.slice(fold(c, base), 1, F.size(c))))

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(PREFIX_CHUNK))
        return F.transform(starts, lambda at: F.slice(v, at, PREFIX_CHUNK))

    return bound(values, lambda v: bound(cut(v), by_chunk))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; ``spans`` by start.

    A span that begins inside an earlier one only lengthens what is left out.
    """

    def lot(items: Column) -> Column:
        # The stretch of text that a chunk of spans lies in is cut out once, its pieces from that.
        base = items[0]["at"]
        stretch = F.substring(text, base + 1, F.array_max(F.transform(items, lambda s: s["start"])) - base)

        def piece(part: Column, s: Column) -> Column:
            kept = F.substring(part, s["at"] - base + 1, s["start"] - s["at"])
            return F.when(s["start"] >= s["at"], F.concat(kept, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))

        return bound(stretch, lambda part: F.array_join(F.transform(items, lambda s: piece(part, s)), ""))

    def pieces(found: Column) -> Column:
        reached = prefixes(F.transform(found, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        items = F.zip_with(
            found, reached, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))
        )
        starts = F.sequence(F.lit(1), F.size(found), F.lit(PREFIX_CHUNK))
        lots = bound(items, lambda held: F.transform(starts, lambda k: lot_of(held, k)))
        rest = F.substring(text, F.array_max(F.transform(found, lambda s: s["end"])) + 1, F.length(text))
        return F.concat(F.array_join(lots, ""), rest)

    def lot_of(items: Column, at: Column) -> Column:
        return bound(F.slice(items, at, PREFIX_CHUNK), lot)

    return F.when(F.size(spans) > 0, bound(spans, pieces)).otherwise(text)
