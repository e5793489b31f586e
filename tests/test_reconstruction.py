"""The chunked walk of packets against the plain one, for any chunk width."""

import random

import pytest
from pyspark.sql import functions as F

from mxposture.streaming import reconstruction
from mxposture.streaming.reconstruction import after_chunk, reconstruct, step, walk

SCHEMA = "uid string, is_orig boolean, ord bigint, flags string, seq bigint, len bigint"


def plain(rows):
    out, states = [], {}
    for uid, is_orig, place, flags, seq, size in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        state, event = step(states.get((uid, is_orig), (None, None, False)), flags or "", seq, size)
        states[uid, is_orig] = state
        if event:
            out.append((uid, is_orig, place, *event))
    return sorted(out)


def direction(rng, uid, is_orig, n):
    """Mostly in order, with losses that come later, repeats, overlaps, new starts and long holes."""
    rows, at, lost, place = [], 1, [], 0
    hole = rng.randrange(n)
    for _ in range(n):
        place += 1
        size = rng.choice([10, 10, 10, 20, 0])
        kind = rng.random()
        if kind < 0.01:
            rows.append((uid, is_orig, place, "S", 0, 0))
            at = 1
        elif kind < 0.08 and lost:
            rows.append((uid, is_orig, place, "A", *lost.pop(rng.randrange(len(lost)))))
        elif kind < 0.14:
            rows.append((uid, is_orig, place, None, max(1, at - rng.choice([5, 10, 20])), size))
        else:
            if kind < 0.22 or place == hole:
                lost.append((at, size))
            else:
                rows.append((uid, is_orig, place, "A", at, size))
            at += size
    return rows


@pytest.mark.parametrize("width", [3, 17, 100])
def test_any_chunk_width_gives_the_plain_walk(spark, width):
    rng = random.Random(width)
    rows = [r for k in range(8) for side in (True, False) for r in direction(rng, f"u{k}", side, rng.choice([1, 5, 60, 200]))]
    rows += direction(rng, "hot", True, 1500)
    packets = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((r.uid, r.is_orig, r.ord, r.event_type, r.len) for r in reconstruct(packets, width=width).collect())
    assert got == plain(rows)
    assert len(got) > 200


def test_a_byte_that_never_comes_needs_no_round_for_each_chunk(spark, monkeypatch):
    rows = [("u", True, 1, "A", 1, 10)] + [("u", True, 2 + k, "A", 100 + 10 * k, 10) for k in range(600)]
    rows += [("u", True, 700, "A", 11, 10), ("u", True, 701, "A", 6100, 10)]
    rounds = []
    real = reconstruction._with_states
    monkeypatch.setattr(reconstruction, "_with_states", lambda *a: rounds.append(1) or real(*a))
    out = reconstruct(spark.createDataFrame(rows, SCHEMA), width=10)
    assert sorted((r.ord, r.event_type) for r in out.collect()) == [(o, e) for _, _, o, e, _ in plain(rows)]
    # The summaries, at most two corrections and the events.
    assert len(rounds) <= 4


def test_the_summary_of_a_chunk_never_claims_too_much():
    rng = random.Random(9)
    certain = 0
    for _ in range(4000):
        rows = [(rng.random() < 0.05, rng.randrange(1, 60, 5), rng.choice([0, 5, 10])) for _ in range(rng.randrange(1, 8))]
        syn, seq, size = map(list, zip(*rows))
        data = [(q, n) for s, q, n in rows if n and not s]
        first = data[0][0] if data else None
        guess = (first, None, False)
        after, _ = walk(guess, syn, seq, size)
        c = dict(
            first_seq=first, min_seq=min((q for q, _ in data), default=None), max_seq=max((q for q, _ in data), default=None),
            max_end=max((q + n for q, n in data), default=None), has_syn=any(syn), guess_expected=guess[0], guess_high=None,
            guess_future=False, expected=after[0], high=after[1], future=after[2],
        )
        expected = rng.choice([None, *range(1, 60, 5)])
        high = None if expected is None or rng.random() < 0.4 else rng.randrange(1, 70, 5)
        state = (expected, high, high is not None)
        following, sure = after_chunk(state, c)
        if sure:
            certain += 1
            real, _ = walk(state, syn, seq, size)
            # A high mark at or below the expected byte only matters after a new start, where it is kept.
            assert following == real, (state, rows)
    assert certain > 1000


def test_rows_without_numbers_are_left_out(spark):
    rows = [("u", True, 1, "A", 1, 10), ("u", True, 2, "A", None, 10), ("u", True, 3, "A", 1, None), ("u", True, 4, None, 1, 10)]
    out = reconstruct(spark.createDataFrame(rows, SCHEMA), width=2).select("ord", "event_type").collect()
    assert [tuple(r) for r in out] == [(4, "duplicate")]
    assert reconstruct(spark.createDataFrame([], SCHEMA)).count() == 0
    assert reconstruct(spark.createDataFrame(rows[:1], SCHEMA), chunk=F.lit(5)).count() == 0


def test_the_hot_direction_is_numbered_in_pieces(spark, sf_dir):
    from mxposture.plans.adapters import view
    from mxposture.plans.stream_queries import hot_packets

    want = view(spark, sf_dir, "x_packets_hot")
    for most in (300, 100_000):
        rows = hot_packets(spark, sf_dir, most)
        assert rows.dtypes == want.dtypes
        assert sorted(rows.collect()) == sorted(want.collect())
