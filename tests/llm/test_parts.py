"""The pieces that run inside tasks, against plain versions of themselves."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from mxposture.llm import counts, decontam, elias, neardup, packing, pii, quality
from mxposture.llm.common import byte_offsets
from mxposture.llm.units import Units

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\nx", "x  \n", "don't 'S it''ś x ́", "\x1cfoo\x1d bar",
    "İstanbul ΣΑΣ  É é", "a 　b  c\n", "  y", "  y", "'s can't've", "\U0001f600 a", " ", "<|endoftext|> x", "12 345\t6",
]


def texts(seed, n=60):
    rng = random.Random(seed)
    out = list(ODD)
    for _ in range(n):
        alphabet = rng.choice(["ab \n", "abcdef .,\n\t ", "é   x\n", "0123456789 -.+()@a", "aB1+/=_-: '\""])
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))))
    return out


def sliced(values):
    return byte_offsets(pa.array(values, pa.string()))


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_library_ids(name, spaced):
    own = Units(public_tokenizers.path(name), spaced, kept=50)
    values = texts(1) + [None, "word " * 3000, "x" * 20000]
    for _ in range(2):
        ids, bounds = own.encode(*sliced(values))
        for k, v in enumerate(values):
            want = own.tokenizer.encode(v or "", add_special_tokens=False).ids
            assert ids[bounds[k] : bounds[k + 1]].tolist() == want, repr(v)


def test_measures_match_plain_counting():
    values = texts(2) + ["a b c d e a b c d e f", "x y\nx y\n\n \nx y", "q " * 500]
    found = quality.measures(*sliced(values))
    for k, v in enumerate(values):
        w = WORD.findall(v)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = collections.Counter(windows)
        covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(5)}
        lines = [x for x in v.split("\n") if WORD.search(x)]
        want = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in v), len(lines) - len(set(lines)), len(covered)]
        assert [int(found[m][k]) for m in quality.MEASURES] == want, repr(v)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_shingle_sets_match_plain_sets(width):
    values = texts(3) + ["A b a B", "one", "one two three four", "a b " * 50]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    hashes, bounds = neardup.shingle_sets(*sliced(values), width)
    sets, names = [], {}
    for k, v in enumerate(values):
        w = WORD.findall(v.translate(lower))
        own = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        got = hashes[bounds[k] : bounds[k + 1]].tolist()
        assert len(got) == len(own)
        sets.append((own, set(got)))
    for own, got in sets:
        for other, theirs in sets:
            assert len(own & other) == len(got & theirs)


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(pii.KINDS[n], s, e) for s, n, e in sorted(out)]


def test_base_spans_match_plain_patterns():
    rng = random.Random(4)
    bits = ["a@b.co", "x.y+z@ex-am.org.uk", "@", "a@b", "1.2.3.4", "256.1.1.1", "10.0.0.1.7", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "+1 (980) 555-6268", "+4", "++49 30 1234567", ".", " ", "-", "5", "é", "word", "\n"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))
        base = [(k, s, e) for k, s, e, _ in pii.find(text) if k in pii.BASE]
        assert base == plain_spans(text), text
    for text in texts(5, 200):
        assert [(k, s, e) for k, s, e, _ in pii.find(text) if k in pii.BASE] == plain_spans(text)


def test_added_spans_need_their_checks():
    kinds = lambda t: [k for k, *_ in pii.find(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 thanks") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33 thanks") == []
    assert kinds("call me on 555-123-4567") == ["local"]
    assert kinds("number 555-123-4567") == []
    assert kinds("born 1980-02-03") == ["birth"]
    assert kinds("issued 1980-02-03") == []
    assert len(pii.find("1" * 200_000 + "@" + "a" * 200_000)) == 0


def test_borders_round_trip():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(0, 300)
        values = np.cumsum([0] + [rng.choice([0, 1, 5, 1000, 10**6]) for _ in range(n)])
        coded = elias.Borders(elias.Borders.encode(values))
        assert coded.all().tolist() == values.tolist()
        for i in rng.sample(range(n + 1), min(n + 1, 9)):
            assert coded.at(i) == values[i]
    many = np.arange(100_000) * 500
    assert len(elias.Borders.encode(many)) < 100_000 * 12 / 8 + 10_000


@pytest.mark.parametrize("seed,n", [(0, 0), (1, 1), (2, 50), (3, 3000)])
def test_plan_places_every_piece(seed, n):
    rng = np.random.default_rng(seed)
    lengths = np.sort(np.minimum(64, 1 + rng.geometric(0.05, n)))
    histogram = collections.Counter(lengths.tolist())
    made = packing.solve(histogram, 64)
    seen, rank = collections.Counter(), []
    for l in lengths.tolist():
        rank.append(seen[l])
        seen[l] += 1
    sequence, offset = made.place(lengths, np.array(rank, np.int64)) if n else (lengths, lengths)
    held = collections.defaultdict(list)
    for s, o, l in zip(sequence.tolist(), offset.tolist(), lengths.tolist()):
        held[s].append((o, l))
    for rows in held.values():
        at = 0
        for o, l in sorted(rows):
            assert o == at
            at += l
        assert at <= 64
    assert len(held) == made.sequences
    if n == 3000:
        assert made.sequences <= 1.02 * -(-int(lengths.sum()) // 64) + 1


def test_knapsack_against_all_patterns():
    lengths = np.array([3, 5, 7])
    worth = np.array([0.4, 0.9, 1.1])
    best, _ = packing.knapsack(worth, lengths, 17)
    for w in range(18):
        every = [
            a * 0.4 + b * 0.9 + c * 1.1
            for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= w
        ]
        assert abs(best[w] - max(every)) < 1e-9


def test_cut_leaves_the_remainder_first():
    assert packing.cut(5, 10) == [0] and packing.cut(10, 10) == [0]
    assert packing.cut(25, 10) == [0, 5, 15] and packing.cut(20, 10) == [0, 10]


def test_edits_count_like_a_whole_encoding():
    rng = random.Random(8)
    own = Units(public_tokenizers.path("byte_bpe_50k.json"), True)
    values = texts(9, 40) + ["lorem ipsum dolor  sit amet,\n\nconsectetur " * 200]
    for _ in range(3):
        held = counts.segmented(own, *sliced(values))
        for document, value in zip(held, values):
            for _ in range(rng.randrange(0, 6)):
                start, remove = rng.randrange(0, len(value) + 3), rng.choice([0, 1, 3, 40, 3000])
                insert = rng.choice(["", " ", "x", "  new words\n", "é" * 5])
                document.edit(start, remove, insert)
                value = value[:start] + insert + value[start + remove :] if start <= len(value) else value + insert
            assert "".join(document.texts) == value
            for k in document.changed:
                n = len(own.encode(*sliced([document.texts[k]]))[0])
                document.tokens.put(k, n)
            assert document.tokens.total == len(own.encode(*sliced([value]))[0])
            assert document.chars.total == len(value)


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_regions_against_whole_alignment():
    rng = random.Random(10)
    letters = "etaoinshr "
    speak = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(k, speak(rng.choice([60, 118, 200, 330]))) for k in range(6)]
    index = decontam.Index(items)
    values = []
    for _ in range(40):
        item = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 16)):
            at = rng.randrange(len(item))
            item[at : at + rng.randrange(0, 2)] = rng.choice([[], ["x"], ["y", "z"]])
        values.append(speak(rng.randrange(0, 150)) + " " + "".join(item) + " " + speak(rng.randrange(0, 150)))
    values += ["", "short"]
    got = collections.defaultdict(set)
    for text, item, start, end, windows, edits in decontam.matches(index, *sliced(values)):
        got[text].add(item)
        assert 0 <= start < end <= len(values[text])
    for t, value in enumerate(values):
        points = np.frombuffer(value.encode("utf-32-le"), np.uint32)
        plain = decontam.normalised(points, np.array([0, len(points)]))[0].tolist()
        want = {
            index.item[w]
            for w, pattern in enumerate(index.windows)
            if distance_in(pattern.tolist(), plain) <= index.edits[w]
        }
        assert got[t] == want, t
