"""Token counts of documents under edits, re-encoding only what an edit touches.

A document is held as segments of about ``SEGMENT`` bytes, cut where white space follows another
character: no token reaches across such a border. Over the segments stands a tree with the sums of
characters and of tokens. An edit finds its segment by walking down the character sums, changes the
texts of the segments it touches, and makes sure that the borders beside them still are such
borders; where one is not any more (a space was removed, say), the neighbour is taken in too. All
segments changed in a slice of documents are re-encoded together, once, and their sums are carried
up the trees. What was not touched keeps its count.

An edit is (start, remove, insert), in code points, applied in order to the text as it then is;
start and remove are cut to the text's length. Edits of one document follow each other in one row.

Cases: a null or empty text counts 0 and can be inserted into. Null edits are none; null fields are
0 and the empty text. Rows with equal ids stay separate. No documents: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mxposture.llm.common import byte_offsets, empty_text, slices
from mxposture.llm.units import Units, units, white_bytes

SEGMENT = 512
EDITS = "array<struct<start:bigint,remove:bigint,insert:string>>"
RESULT = ["tokens_before", "tokens_after", "chars_after", "segments", "segments_encoded"]
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))


class Sums:
    """A segment tree of sums over a fixed number of leaves."""

    def __init__(self, leaves: list[int]):
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.node = [0] * self.size + leaves + [0] * (self.size - len(leaves))
        for k in range(self.size - 1, 0, -1):
            self.node[k] = self.node[2 * k] + self.node[2 * k + 1]

    @property
    def total(self) -> int:
        return self.node[1]

    def put(self, leaf: int, value: int) -> None:
        k = leaf + self.size
        self.node[k] = value
        while k > 1:
            k >>= 1
            self.node[k] = self.node[2 * k] + self.node[2 * k + 1]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, place in it) of ``place``; the end of all is after the last filled leaf."""
        k = 1
        while k < self.size:
            k *= 2
            if place >= self.node[k] and self.node[k + 1] > 0:
                place -= self.node[k]
                k += 1
        return k - self.size, place


class Document:
    def __init__(self, texts: list[str], tokens: list[int]):
        self.texts = texts
        self.chars, self.tokens = Sums([len(t) for t in texts]), Sums(tokens)
        self.changed: set[int] = set()

    def put(self, k: int, text: str) -> None:
        self.texts[k] = text
        self.chars.put(k, len(text))
        self.changed.add(k)

    def edit(self, start: int, remove: int, insert: str) -> None:
        start = min(max(start, 0), self.chars.total)
        k, at = self.chars.find(start)
        text = self.texts[k]
        gone = min(max(remove, 0), len(text) - at)
        self.put(k, text[:at] + insert + text[at + gone :])
        left, j = max(remove, 0) - gone, k + 1
        while left > 0 and j < len(self.texts):
            gone = min(left, len(self.texts[j]))
            if gone:
                self.put(j, self.texts[j][gone:])
            left, j = left - gone, j + 1
        self.mend(k)

    def mend(self, k: int) -> None:
        """Takes neighbours into segment ``k`` until its borders are borders again."""
        while True:
            before = next((p for p in range(k - 1, -1, -1) if self.texts[p]), None)
            if before is None:
                break
            if self.texts[k] and self.texts[before][-1] not in WHITE and self.texts[k][0] in WHITE:
                break
            joined = self.texts[before] + self.texts[k]
            self.put(k, "")
            self.put(before, joined)
            k = before
        while True:
            after = next((n for n in range(k + 1, len(self.texts)) if self.texts[n]), None)
            if after is None or not self.texts[k]:
                break
            if self.texts[k][-1] not in WHITE and self.texts[after][0] in WHITE:
                break
            joined = self.texts[k] + self.texts[after]
            self.put(after, "")
            self.put(k, joined)


def segmented(own: Units, data: np.ndarray, offsets: np.ndarray) -> list[Document]:
    """The documents of a slice, each segment with its count."""
    white = white_bytes(data)
    border = np.zeros(len(data), bool)
    border[1:] = white[1:] & ~white[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    border[starts] = False
    place = np.flatnonzero(border)
    of = np.searchsorted(offsets, place, "right") - 1
    block = (place - offsets[of]) // SEGMENT
    new = np.ones(len(place), bool)
    new[1:] = (block[1:] != block[:-1]) | (of[1:] != of[:-1])
    cuts = place[new & (block > 0)]
    bounds = np.unique(np.concatenate([offsets, cuts]))
    if len(bounds) == 1:
        bounds = np.append(bounds, bounds)
    counts = np.diff(own.encode(data, bounds)[1]).tolist()
    raw = data.tobytes()
    texts = [raw[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    first = np.searchsorted(bounds, offsets[:-1])
    last = np.searchsorted(bounds, offsets[1:])
    return [
        Document(texts[a:b], counts[a:b]) if a < b else Document([""], [0])
        for a, b in zip(first.tolist(), last.tolist())
    ]


def edited_counts(
    docs: DataFrame, keep: list[str], tokenizer: str, edits: str = "edits", text: str = "text", spaced: bool = True
) -> DataFrame:
    """``keep`` and RESULT for every row; ``edits`` is an array of (start, remove, insert)."""
    rows = docs.select(*keep, F.col(edits).cast(EDITS).alias("_edits"), empty_text(text).alias("_text"))
    schema = StructType(rows.drop("_edits", "_text").schema.fields + [StructField(n, LongType()) for n in RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = units(tokenizer, spaced)
        for batch in slices(batches, "_text"):
            documents = segmented(own, *byte_offsets(batch.column(batch.num_columns - 1)))
            before = [d.tokens.total for d in documents]
            for document, script in zip(documents, batch.column(batch.num_columns - 2).to_pylist()):
                for e in script or []:
                    if e is not None:
                        document.edit(e["start"] or 0, e["remove"] or 0, e["insert"] or "")
            todo = [(d, k) for d in documents for k in sorted(d.changed)]
            again = pa.array([d.texts[k] for d, k in todo], pa.large_string())
            for (document, k), n in zip(todo, np.diff(own.encode(*byte_offsets(again))[1]).tolist()):
                document.tokens.put(k, n)
            columns = [batch.column(k) for k in range(len(keep))]
            values = [
                before,
                [d.tokens.total for d in documents],
                [d.chars.total for d in documents],
                [len(d.texts) for d in documents],
                [len(d.changed) for d in documents],
            ]
            columns += [pa.array(v, pa.int64()) for v in values]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
