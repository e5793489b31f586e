"""Token ids of whole texts, with a bounded memory of the units already encoded.

Both vocabularies used here split a text into pieces before any merge, and never across the border
between a character and the white space beside it. A text is therefore cut there into units, each
distinct unit is encoded once by the library, and the ids are put together again. The file's added
tokens are taken out of a text first, as the library does: each is a unit of its own, and what stands
before and after it is cut like a text of its own.
"""

from __future__ import annotations

import os
import re

import numpy as np

from mxposture.llm.words import span_hashes, spans

#: Unicode white space in UTF-8: the ASCII ones and the longer ones by their bytes.
ASCII_WHITE = np.zeros(256, bool)
ASCII_WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
WHITE_2 = (0xC285, 0xC2A0)
WHITE_3 = (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)

KEPT_UNITS = 1_200_000
LEARNED_TOGETHER = 1000


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a white-space character."""
    white = ASCII_WHITE[data]
    for lead, size, codes in ((0xC2, 2, WHITE_2), (0xE1, 3, WHITE_3), (0xE2, 3, WHITE_3), (0xE3, 3, WHITE_3)):
        at = np.flatnonzero(data == lead)
        at = at[at + size <= len(data)]
        code = np.zeros(len(at), np.int64)
        for k in range(size):
            code = code * 256 + data[at + k]
        at = at[np.isin(code, codes)]
        for k in range(size):
            white[at + k] = True
    return white


def cut_units(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, ...]:
    """(starts, ends, text number) of the units in order.

    Not ``spaced``: runs of other than white space. ``spaced``: a single space goes with the word
    after it; of longer white space before a word the last character stands alone unless it is a
    space; white space at the end of a text is one unit.
    """
    white = white_bytes(data)
    starts, ends, owner = spans(~white, offsets)
    if not spaced:
        return starts, ends, owner
    w_starts, w_ends, w_owner = spans(white, offsets)
    final = w_ends == offsets[w_owner + 1]
    wide = data[w_ends - 1] >= 0x80
    size = np.where(wide, np.where(data[np.maximum(w_ends - 2, 0)] == 0xC2, 2, 3), 1)
    last = w_ends - size
    joined = ~final & (data[w_ends - 1] == 0x20)
    attached = np.zeros(len(data) + 1, bool)
    attached[w_ends[joined]] = True
    starts = starts - attached[starts]
    rest = ~final & (last > w_starts)
    alone = ~final & ~joined
    starts = np.concatenate([starts, w_starts[final], w_starts[rest], last[alone]])
    ends = np.concatenate([ends, w_ends[final], last[rest], w_ends[alone]])
    owner = np.concatenate([owner, w_owner[final], w_owner[rest], w_owner[alone]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], owner[order]


def added_pattern(tokenizer) -> re.Pattern | None:
    """The spellings of the file's added tokens, the longest first."""
    tokens = tokenizer.get_added_tokens_decoder().values()
    for t in tokens:
        if t.lstrip or t.rstrip or t.single_word or t.normalized or re.search(r"\s", t.content):
            raise ValueError(f"added token {t.content!r} reaches beyond its own characters or holds white space")
    spellings = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, spellings))) if spellings else None


def cut_added(pattern: re.Pattern | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``offsets`` with the borders of the added tokens in each text; a text that is empty may drop out."""
    raw = data.tobytes()
    if pattern is None or not pattern.search(raw):
        return offsets
    bounds = offsets.tolist()
    hits = [x for a, b in zip(bounds[:-1], bounds[1:]) for m in pattern.finditer(raw, a, b) for x in m.span()]
    return np.union1d(offsets, np.array(hits, np.int64))


class Units:
    """A tokenizer file and the ids of the units met so far, as sorted arrays of unit hashes."""

    def __init__(self, path: str, spaced: bool, kept: int = KEPT_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = added_pattern(self.tokenizer)
        self.spaced, self.kept = spaced, kept
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, units: list[str]) -> None:
        lengths, ids = [], []
        for k in range(0, len(units), LEARNED_TOGETHER):
            part = units[k : k + LEARNED_TOGETHER]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            words = np.array(found.word_ids, np.int64)
            lengths.append(np.bincount(words, minlength=len(part)))
        length = np.concatenate(lengths)
        place = (len(self.pool) + np.cumsum(length) - length).astype(np.int32)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.place = np.insert(self.place, at, place[order])
        self.length = np.insert(self.length, at, length[order])
        self.pool = np.concatenate([self.pool, *ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, place where each text begins, with the end)."""
        if len(self.hashes) > self.kept or len(self.pool) > 64 * self.kept:
            self.forget()
        parts = cut_added(self.added, data, offsets)
        starts, ends, owner = cut_units(data, parts, self.spaced)
        if parts is not offsets:
            owner = np.searchsorted(offsets, parts[owner], "right") - 1
        bounds = np.zeros(len(offsets), np.int64)
        if not len(starts):
            return np.zeros(0, np.uint32), bounds
        distinct, first, which = np.unique(
            span_hashes(data, starts, ends), return_index=True, return_inverse=True
        )
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if not known.all():
            new = first[~known]
            raw = data.tobytes()
            spellings = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            self.learn(distinct[~known], spellings)
            at = np.searchsorted(self.hashes, distinct)
        place, length = self.place[at][which].astype(np.int64), self.length[at][which].astype(np.int64)
        upto = np.cumsum(length)
        index = np.repeat(place - (upto - length), length)
        index += np.arange(len(index))
        bounds[1:] = np.cumsum(np.bincount(owner, weights=length, minlength=len(offsets) - 1))
        return self.pool[index], bounds


_loaded: dict[tuple[str, bool], Units] = {}


def units(path: str, spaced: bool) -> Units:
    """One instance per Python worker, so that what one task learned serves the next."""
    key = (path, spaced)
    if key not in _loaded:
        _loaded[key] = Units(path, spaced)
    return _loaded[key]
