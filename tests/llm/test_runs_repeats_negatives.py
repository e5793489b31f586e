"""Periodic runs, long repeats and hard negatives against plain versions, odd rows included."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mxposture.llm import negatives, periodic, queries, repeats
from mxposture.llm.words import mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["row", "runs", "collapsed", "_key", "_tag", "key", "first", "kept", "packed", "spans", "n_words", "id", "v", "round"]


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 3 + 1):
        k = 0
        while k < len(words) - q:
            j = k
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - k >= 2 * q:
                out.setdefault((k, j + q), q)
            k = max(j, k + 1)
    return sorted((s, e, q) for (s, e), q in out.items())


def periodic_words(rng):
    letters = rng.choice([2, 3, 5, 50])
    words = [rng.randrange(letters) for _ in range(rng.randrange(200))]
    for _ in range(rng.randrange(4)):
        block = [rng.randrange(letters) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.5:
            inner = [rng.randrange(letters) for _ in range(rng.randrange(1, 6))]
            block = (inner * 60)[: rng.randrange(1, 60)] + block[: rng.randrange(10)]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (block * 6)[: rng.randrange(1, 5 * len(block) + 2)]
    return words


def test_runs_equal_the_plain_search():
    rng = random.Random(3)
    found = 0
    for _ in range(25):
        texts = [periodic_words(rng) for _ in range(8)]
        names = mixed(np.array([x + 1 for t in texts for x in t], np.uint64))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        start, end, period = periodic.word_runs(names, owner)
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for k, text in enumerate(texts):
            mine = (start >= base[k]) & (start < base[k + 1])
            got = zip((start[mine] - base[k]).tolist(), (end[mine] - base[k]).tolist(), period[mine].tolist())
            want = plain_runs(text)
            assert sorted(got) == want
            found += len(want)
    assert found > 500


def test_a_long_period_and_a_hash_that_lies(monkeypatch):
    rng = random.Random(5)
    block = [rng.randrange(1, 10**6) for _ in range(3000)]
    words = np.array([0] * 50 + block * 3 + block[:1700] + [0], np.uint64)
    owner = np.zeros(len(words), np.int64)
    want = [(0, 50, 1), (50, 50 + 3 * 3000 + 1700, 3000)]
    assert list(zip(*(x.tolist() for x in periodic.word_runs(mixed(words), owner)))) == want
    # A confirmation that fails once sends the proposal to the plain comparison: same result.
    monkeypatch.setattr(periodic, "_confirmed", lambda *a: False)
    assert list(zip(*(x.tolist() for x in periodic.word_runs(mixed(words), owner)))) == want


def odd_texts(seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice("aeioukls") for _ in range(rng.randrange(1, 4))) for _ in range(60)]

    def prose(n):
        return " ".join(rng.choice(made) for _ in range(n))

    passage = [prose(rng.randrange(36, 60)) for _ in range(3)]
    texts = [None, "", " \n\t ", "one", prose(34), prose(35), "x" * 20_000, "same " * 34, "same " * 35, "other " * 35, "other " * 500]
    for _ in range(40):
        parts = [prose(rng.randrange(5, 80))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(passage).split(" ")
            cut = rng.randrange(len(words) - 20) if rng.random() < 0.3 else 0
            parts += [rng.choice([" ", "\n", "  "]).join(words[cut:]), prose(rng.randrange(40))]
        if rng.random() < 0.3:
            parts.append(((prose(rng.randrange(1, 50)) + "\n") * rng.randrange(2, 6)).strip())
        if rng.random() < 0.2:
            parts.append("ünïcode " * rng.randrange(1, 60))
        texts.append(" ".join(parts))
    near = texts[15].split()
    for k in range(12):
        copy = list(near)
        copy[k * 3 % len(copy)] = f"edit{k}"
        texts.append(" ".join(copy))
    texts.append(prose(20_000))
    texts.append(texts[-1][4000:90_000])
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, texts[21]), (20, "another text of this id " + texts[22])]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(odd_texts(4), "doc_id long, text string")
    return rows.withColumns({c: F.lit(k) for k, c in enumerate(CLASH)}).repartition(7).persist()


def test_runs_of_odd_rows(odd):
    got = collections.Counter()
    for r in periodic.with_runs(odd, ["doc_id", "runs", "row"]).collect():
        got[r.doc_id, tuple((x.start, x.length, x.period) for x in r[3]), r.collapsed] += 1
    want = collections.Counter()
    for r in odd.select("doc_id", "text").collect():
        words = WORD.findall(r.text or "")
        runs = [(s, e - s, q) for s, e, q in (plain_runs(words) if len(words) < 4000 else []) if e - s >= 24]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want[r.doc_id, tuple(sorted(runs, key=lambda x: (x[0], x[2]))), kept] += 1
    assert got == want


def plain_repeats(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("width", "heavy"), [(35, 4096), (35, 3), (3, 4096)])
def test_repeats_of_odd_rows(odd, monkeypatch, width, heavy):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    rows = odd.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, plain_repeats([r.text for r in rows], width)))
    got = repeats.without_repeats(odd, ["doc_id"], width)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert sum(k[2] > 0 for k in want) > 25


def test_kept_columns_and_empty_tables(spark, odd):
    names = ["kept", "_key", "row"]
    out = repeats.without_repeats(odd.limit(5), names)
    assert out.columns == [*names, "n_words", "n_removed", "kept"]
    assert len(out.collect()) == 5
    none = odd.limit(0)
    assert repeats.without_repeats(none, ["doc_id"]).collect() == []
    assert periodic.with_runs(none, ["doc_id"]).collect() == []


def plain_negatives(rows):
    whole = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = collections.Counter()
    for a, av, al in {(i, tuple(v), n) for i, v, n in whole if i % 50 == 0}:
        ranked = sorted((-score(av, v), i, n) for i, v, n in whole if i != a)
        for s, p, _ in [x for x in ranked if x[2] == al][:5]:
            fit = [(t, i) for t, i, n in ranked if n != al and 50 * -s <= 100 * -t <= 95 * -s][:3]
            for rank, (t, i) in enumerate(fit, 1):
                out[a, p, rank, i, -s, -t] += 1
    return out


def vectors(seed, n, dims, hot=0.0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(10)]
    same = [rng.gauss(0, 0.3) for _ in range(dims)]
    rows = []
    for k in range(n):
        label = rng.randrange(10)
        v = list(same) if rng.random() < hot else [c + rng.gauss(0, 0.15) for c in centre[label]]
        rows.append((k, v, label))
    for k in rng.sample(range(n), 12):
        i, v, label = rows[k]
        rows[k] = rng.choice([(i, None, label), (i, v, None), (i, [*v[:-1], None], label), (i, [float("nan"), *v[1:]], label), (i, [float("inf"), *v[1:]], label), (None, v, label)])
    return rows + [rows[50], rows[50], rows[51], (3, rows[60][1], 4)]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("dims", "hot", "task_rows", "round_bytes"), [(8, 0.0, 100, 16 << 20), (16, 0.35, 150, 700), (1, 0.5, 90, 16 << 20)])
def test_negatives_equal_the_plain_search(spark, monkeypatch, tmp_path, dims, hot, task_rows, round_bytes):
    monkeypatch.setattr(negatives, "TASK_ROWS", task_rows)
    monkeypatch.setattr(negatives, "ROUND_BYTES", round_bytes)
    rows = vectors(dims, 900, dims, hot)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASH if c not in ("id", "v")})
    table.repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = collections.Counter(map(tuple, queries.op13(spark, str(tmp_path)).collect()))
    want = plain_negatives(rows)
    assert got == want
    assert sum(want.values()) > 100


def test_negatives_of_odd_tables(spark):
    def mined(rows, **more):
        table = spark.createDataFrame(rows, SCHEMA)
        return negatives.mined(table, F.col("id") % 50 == 0, **more).collect()

    assert mined([]) == []
    assert mined([(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined([(50, [1.0], 0)]) == []
    # Lengths differ: what is missing counts as zero; an empty vector scores 0 with all.
    got = mined([(50, [1.0, 1.0], 0), (1, [1.0], 0), (2, [0.7], 1), (3, [0.6, 0.0, 9.0], 1), (4, [], 1)], scale=10)
    assert [tuple(r) for r in got] == [(50, 1, 1, 2, 100, 70), (50, 1, 2, 3, 100, 60)]
    # Sums beyond 2^53 are added as integers, beyond 2^63 refused.
    big = [(50, [3e6, 1.0], 0), (1, [3e6, 0.0], 0), (2, [2e6, 1.0], 1), (3, [2e6, 2.0], 1)]
    at = 256 * 3_000_000
    want = [(50, 1, 1, 3, at * at, at * 2 * at // 3 + 2 * 256 * 256), (50, 1, 2, 2, at * at, at * 2 * at // 3 + 256 * 256)]
    assert sorted(tuple(r) for r in mined(big)) == sorted(want)
    with pytest.raises(ValueError, match="64 bits"):
        mined([(50, [1e30], 0), (1, [1.0], 0)])


def test_boxes_hold_every_inner_product():
    rng = np.random.default_rng(1)
    low = rng.integers(-50, 20, (30, 6))
    high = low + rng.integers(0, 40, (30, 6))
    anchors = rng.integers(-30, 30, (20, 6))
    empty = np.zeros((20, 1), np.int64)
    asked = negatives.Queries(np.arange(20), np.zeros(20), anchors, empty, empty, empty, 1, True)
    least, most = asked.bounds(low, high)
    for _ in range(50):
        point = rng.integers(low, high + 1)
        score = anchors @ point.T
        assert (score >= least).all() and (score <= most).all()
