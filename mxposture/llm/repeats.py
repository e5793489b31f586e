"""Long repeated passages, by recompression.

Every text becomes a sequence of word names (64-bit hashes) that is compressed in rounds. A round first
replaces each run of one symbol by a new symbol, then each pair of a left and a right symbol; a hash of
the symbol and the round says which side it is on. A new symbol's name is a hash of what it stands for,
so equal runs and pairs get one name in all tasks without a table of names being exchanged. Whether two
neighbours join depends on these two alone: equal substrings have the same symbols inside, up to one
symbol a round at either end.

So each window of ``width`` words has symbols that it alone decides. One of them is its mark: of the
highest round, up to ``ROUNDS``, that leaves any, the one with the least hash. Equal windows have equal
marks at equal places, and neighbouring windows mostly share theirs. Then, over all texts,

    1. windows with one mark form a unit; its key is the mark's name with the words around it that all
       its windows hold (``STEP`` says how far the windows of a unit may lie from the mark). Keys that
       occur once in the corpus hold no repeated window and leave.
    2. the units left are hashed whole; those that occur twice or more repeat with all their windows.
    3. of the others, and of one of each kind of the repeated ones, every window is hashed under its
       key; windows that occur twice or more repeat.

Every hash decides only together with another 64 bits (key and unit, key and window). Counts are
aggregated before the shuffle; a key that holds more than 1 / ``HEAVY`` of the rows is looked up in a
broadcast of at most ``HEAVY`` keys, so no task gets all rows of a frequent one. Windows inside a long run
of one word are equal and form one unit that counts as often as it occurs.

Cases: a null or empty text, or one of fewer than ``width`` words, loses nothing. Repeated rows are texts
of their own, so their windows repeat. Rows without key columns, or several rows with one key, are told
apart by their texts. No documents: an empty result. One text is worked on in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.llm.common import byte_offsets, empty_text, released, shared_folder, slices
from mxposture.llm.words import SPACE, mixed, prefix_sums, span_hashes, spans, spans_of

WIDTH = 35
ROUNDS = 3
STEP = 18
HEAVY = 4096
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)

#: Per unit: first window, how many in a row, key, and how often its window occurs (1 but in runs).
Units = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _round_salt(number: int) -> np.uint64:
    return np.uint64(number * 0x9E3779B97F4A7C15 % 2**64)


def compressed(symbols: np.ndarray, owner: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, first old symbol) of the symbols after one round of runs and pairs."""
    right = (mixed(symbols + _round_salt(number)) >> np.uint64(63)).astype(bool)
    one_text = owner[1:] == owner[:-1]
    same = (symbols[1:] == symbols[:-1]) & one_text
    begins = np.ones(len(symbols), bool)
    begins[1:] = ~(same | (~right[:-1] & right[1:] & one_text))
    run_begins = np.ones(len(symbols), bool)
    run_begins[1:] = ~same
    run = np.flatnonzero(run_begins)
    times = np.diff(np.append(run, len(symbols)))
    name = np.where(times > 1, mixed(symbols[run] ^ mixed(times.astype(np.uint64))), symbols[run])
    # A symbol is one run, or a run of a left symbol and one of a right symbol.
    first = np.flatnonzero(begins[run])
    out = name[first]
    pair = np.diff(np.append(first, len(run))) == 2
    out[pair] = mixed(out[pair] * _ROOT + mixed(name[first[pair] + 1]))
    return out, np.flatnonzero(begins)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each span [low, high), from tables of the least of 1, 2, 4, ... values."""
    power = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(power.max(initial=0)) + 1):
        if k:
            reach = 1 << (k - 1)
            table = np.minimum(table[:-reach], table[reach:])
        at = np.flatnonzero(power == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
    return out


def marks(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(window, place of its mark, name of the mark) of every window of ``width`` words of one text."""
    window = np.flatnonzero(owner[: len(words) - width + 1] == owner[width - 1 :]) if len(words) >= width else np.zeros(0, np.int64)
    place, name = np.zeros(len(window), np.int64), np.zeros(len(window), np.uint64)
    symbols, at, of = words, np.arange(len(words)), owner
    # The symbols from ``low`` to before ``high`` are decided by the window alone.
    live, low, high = np.arange(len(window)), window, window + width
    for number in range(ROUNDS + 1):
        if not len(live):
            break
        if number == ROUNDS:
            stop = np.ones(len(live), bool)
        else:
            shorter, begins = compressed(symbols, of, number)
            begun = np.zeros(len(symbols) + 1, np.int64)
            begun[begins] = 1
            begun = np.cumsum(begun)
            next_low, next_high = begun[low], begun[high - 1] - 1
            stop = next_low >= next_high
        if stop.any():
            ended, a, b = live[stop], low[stop], high[stop]
            order = mixed(symbols ^ _round_salt(number + 101)) & ~_LOW | np.arange(len(symbols), dtype=np.uint64)
            chosen = (_least(order, a, b) & _LOW).astype(np.int64)
            place[ended] = at[chosen]
            name[ended] = mixed(symbols[chosen] + _round_salt(number + 201))
        if number < ROUNDS:
            live, low, high = live[~stop], next_low[~stop], next_high[~stop]
            symbols, at, of = shorter, at[begins], of[begins]
    return window, place, name


def units(words: np.ndarray, owner: np.ndarray, sums: np.ndarray, width: int) -> Units:
    window, place, name = marks(words, owner, width)
    if not len(window):
        return window, window, name, window
    step = min(STEP, width)
    lot = (place - window) // step
    begin = place - lot * step
    key = mixed(spans_of(sums, begin, begin + width - step + 1) ^ mixed(name + lot.astype(np.uint64)))
    # Windows of one word repeated are equal: those of one run belong together.
    change = np.ones(len(words), bool)
    change[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    run = np.cumsum(change)
    uniform = run[window] == run[window + width - 1]
    place = np.where(uniform, -run[window], place)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (key[1:] != key[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(window)))
    return window[first], windows, key[first], np.where(uniform[first], windows, 1)


def _uniform(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether all words from ``first`` to before ``last`` are equal."""
    change = np.zeros(len(words), np.int64)
    change[1:] = words[1:] != words[:-1]
    change = np.cumsum(change)
    return change[first] == change[last - 1]


ID = ["_key", "_tag"]


def identified(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``row`` (a struct of ``keep``), ``text`` and an identity: hashes of the kept columns and of the text.

    Equal identities mean equal kept columns and texts (two texts under one key would have to share a
    64-bit hash). Rows that are equal in both share one identity, and each counts.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("_")])
    simple = len(keep) == 1 and docs.schema[keep[0]].dataType.typeName() in ("long", "integer", "short", "byte")
    key = F.coalesce(F.col(f"`{keep[0]}`").cast("long"), F.lit(-1)) if simple else F.xxhash64(F.to_json(kept))
    value = empty_text(text)
    return docs.select(kept.alias("row"), key.alias("_key"), F.xxhash64(value).alias("_tag"), value.alias("text"))


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, word names, text of each word)."""
    data, offsets = byte_offsets(column)
    begin, stop, owner = spans(~SPACE[data], offsets)
    return data, offsets, span_hashes(data, begin, stop), owner


def unit_table(rows: DataFrame, width: int) -> DataFrame:
    """One row per unit: identity, first window (word number), number of windows, key, times."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, words, owner = _words_of(batch.column(2))
            first, windows, key, times = units(words, owner, prefix_sums(words), width)
            of = owner[first]
            begin = np.searchsorted(owner, np.arange(batch.num_rows))
            columns = [batch.column(k).take(pa.array(of)) for k in range(2)]
            columns += [pa.array(x.astype(np.int32)) for x in (first - begin[of], windows, times)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(key.view(np.int64))], names=[*ID, "first", "windows", "times", "key"]
            )

    schema = "_key long, _tag long, first int, windows int, times int, key long"
    return rows.select(*ID, "text").mapInArrow(scan, schema)


class Scratch:
    """Parquet tables of one run in the shared folder, each removed when it has served."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = shared_folder(self.spark, name)
        df.write.parquet(path)
        released(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, *names: str) -> None:
        """Nothing may read these tables any more: what came from them is written itself."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def among(rows: DataFrame, frequent: DataFrame, by: list[str]) -> DataFrame:
    """The ``rows`` whose ``by`` columns are in ``frequent`` (one row per key, ``rows`` counts them).

    Keys with more than 1 / HEAVY of the counted rows, at most HEAVY of them, are broadcast.
    """
    total = frequent.agg(F.sum("rows").alias("n")).first()["n"] or 0
    heavy = frequent.where(F.col("rows") * HEAVY > total).select(*by)
    light = frequent.where(F.col("rows") * HEAVY <= total).select(*by)
    often = rows.join(F.broadcast(heavy), by, "left_semi")
    rest = rows.join(F.broadcast(heavy), by, "left_anti")
    return often.unionByName(rest.join(light, by, "left_semi"))


def _packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The texts compressed before they travel."""
    place = len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            texts = [press.compress(t.encode("utf-8")) for t in batch.column(place).to_pylist()]
            kept = [batch.column(k) for k in range(place)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary())], names=[*columns, "packed"])

    kept = rows.select(*columns)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return rows.select(*columns, "text").mapInArrow(pack, f"{fields}, packed binary")


def _unpacked(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(b).decode("utf-8") for b in column.to_pylist()], pa.string())


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values of all lists, list number of each)."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


PIECE_ROWS = 256


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)
    pa.default_memory_pool().release_unused()


def hashed_units(rows: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """The chosen units with a hash of all their words and one of each window, and how often they count."""
    # Rows of one identity have listed their units once each.
    lists = chosen.select(*ID, "first", "windows", "key").distinct()
    lists = lists.groupBy(*ID).agg(F.collect_list(F.struct("first", "windows", "key")).alias("units"))
    both = _packed(rows, ID).join(lists, ID)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            texts = _unpacked(batch.column(2))
            _, _, words, owner = _words_of(texts)
            sums = prefix_sums(words)
            begin = np.searchsorted(owner, np.arange(batch.num_rows))
            fields, of = _flat(batch.column(3))
            first, windows, key = (f.to_numpy() for f in fields.flatten())
            at = begin[of] + first
            uniform = (windows > 1) & _uniform(words, at, at + windows + width - 1)
            times = np.where(uniform, windows, 1)
            span = np.where(uniform, 1, windows).astype(np.int64)
            whole = mixed(spans_of(sums, at, at + span + width - 1) ^ mixed(span.astype(np.uint64)))
            ends = np.cumsum(span)
            each = np.repeat(at, span) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - span, span)
            window = spans_of(sums, each, each + width).view(np.int64)
            bounds = np.concatenate([[0], ends]).astype(np.int32)
            columns = [batch.column(k).take(pa.array(of)) for k in range(2)]
            columns += [pa.array(x) for x in (first, windows, key, whole.view(np.int64), times.astype(np.int32))]
            columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(window)))
            yield pa.RecordBatch.from_arrays(
                columns, names=[*ID, "first", "windows", "key", "whole", "times", "hashes"]
            )

    schema = "_key long, _tag long, first int, windows int, key long, whole long, times int, hashes array<long>"
    return both.select(*ID, "packed", "units").mapInArrow(scan, schema)


def repeated_spans(docs: DataFrame, keep: list[str], width: int = WIDTH, text: str = "text") -> DataFrame:
    """Identity and word spans (``start``, ``end``) of windows that start twice or more, each span once."""
    return _repeated_spans(identified(docs, keep, text), width)


def _repeated_spans(rows: DataFrame, width: int) -> DataFrame:
    scratch = Scratch(rows.sparkSession)
    found = scratch.write(unit_table(rows, width), "units")
    often = found.groupBy("key").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
    often = scratch.write(often.where("times > 1").select("key", "rows"), "keys")
    shared = among(found, often, ["key"])
    chosen = scratch.write(hashed_units(rows, shared, width), "hashed-units")
    scratch.remove("units", "keys")

    kinds = chosen.groupBy("key", "whole").agg(
        F.sum("times").alias("times"),
        F.count(F.lit(1)).alias("rows"),
        F.any_value("hashes").alias("hashes"),
        # Of use only for a unit that occurs once.
        *[F.min(c).alias(c) for c in (*ID, "first")],
    )
    kinds = scratch.write(kinds, "kinds")
    whole = among(chosen, kinds.where("times > 1").select("key", "whole", "rows"), ["key", "whole"])
    spans_whole = whole.select(*ID, F.col("first").alias("start"), (F.col("first") + F.col("windows") + width - 1).alias("end"))

    each = kinds.select("key", "times", *ID, "first", F.posexplode("hashes").alias("at", "window"))
    again = each.groupBy("key", "window").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = scratch.write(again, "windows")
    single = among(each.where("times = 1"), again, ["key", "window"])
    spans_single = single.select(*ID, (F.col("first") + F.col("at")).alias("start"), (F.col("first") + F.col("at") + width).alias("end"))
    spans_all = scratch.write(spans_whole.unionByName(spans_single).distinct(), "spans")
    scratch.remove("hashed-units", "kinds", "windows")
    return spans_all


def without_repeats(docs: DataFrame, keep: list[str], width: int = WIDTH, text: str = "text") -> DataFrame:
    """``keep``, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space)."""
    rows = identified(docs, keep, text)
    covered = _repeated_spans(rows, width)
    lists = covered.groupBy(*ID).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = _packed(rows, ["row", *ID]).join(lists, ID, "left").select("row", "packed", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            texts = [t.encode("utf-8").split() for t in _unpacked(batch.column(1)).to_pylist()]
            removed, kept = [], []
            for words, spans_here in zip(texts, batch.column(2).to_pylist()):
                if spans_here:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [s["start"] for s in spans_here], 1)
                    np.add.at(change, [s["end"] for s in spans_here], -1)
                    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    removed.append(len(words) - len(stay))
                    words = [words[i] for i in stay]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode("utf-8"))
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["row", "n_words", "n_removed", "kept"],
            )

    row = rows.schema["row"].dataType.simpleString()
    out = both.mapInArrow(cut, f"row {row}, n_words long, n_removed long, kept string")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "n_words", "n_removed", "kept")
