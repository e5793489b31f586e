"""Upgrade outcomes and the second-source merge against brute force."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mxposture.operators import sessions as ops
from mxposture.streaming.online import UpgradeFold

SCHEMA = (
    "uid string, ord bigint, protocol string, kind string, command string, reply_code int, text string, "
    "tag string, client_hello boolean, frame_number bigint"
)
KINDS = ["capability", "request", "reply", "starttls", "unexpected", "confirmation"]
COMMANDS = {
    "smtp": ["STARTTLS", "EHLO", "AUTH", "MAIL", None],
    "imap": ["STARTTLS", "LOGIN", "NOOP", "SELECT", None],
    "pop3": ["STLS", "CAPA", "PASS", "STAT", None],
}
TEXTS = {
    "smtp": [None, "STARTTLS", "250 ok", "SIZE STARTTLS"],
    "imap": ["OK", "OK done", "NO", "BAD x", "BYE", "A,STARTTLS", None],
    "pop3": ["+OK", "-ERR", "STLS", "OK", None],
}


EVENT = ["uid", "ord", "protocol", "kind", "command", "reply_code", "text", "tag", "client_hello", "frame_number"]


def walk(rows):
    """Outcome of one dialogue, event by event."""
    state = UpgradeFold().blank() | {"protocol": rows[0][2], "hello": rows[0][8]}
    for row in sorted(rows, key=lambda r: r[1]):
        UpgradeFold.advance(state, dict(zip(EVENT, row, strict=True)))
    return UpgradeFold.outcome(state)


def dialogue(rng, uid):
    protocol = rng.choice(["smtp", "imap", "pop3"])
    hello = rng.random() < 0.5
    return [
        (
            uid, i, protocol, rng.choice(KINDS), rng.choice(COMMANDS[protocol]),
            rng.choice([220, 250, 354, 454, None]), rng.choice(TEXTS[protocol]), rng.choice(["a", "b", None]),
            hello, i + 1,
        )
        for i in range(rng.randint(1, 14))
    ]


def test_outcome_equals_the_walk_for_any_chunk_width(spark):
    rng = random.Random(7)
    sessions = {f"s{n}": dialogue(rng, f"s{n}") for n in range(600)}
    rows = [r for listed in sessions.values() for r in listed]
    expected = {uid: walk(listed) for uid, listed in sessions.items()}
    for width in (1, 3, 1000):
        out = ops.upgrade_outcomes(spark.createDataFrame(rows, SCHEMA), width)
        assert {r.uid: r.state for r in out.collect()} == expected


def test_no_tls_without_hello(spark):
    rng = random.Random(11)
    rows = [r for n in range(200) for r in dialogue(rng, f"s{n}")]
    out = ops.upgrade_outcomes(spark.createDataFrame(rows, SCHEMA))
    assert out.where("state = 'tls_established' AND NOT client_hello").isEmpty()


def test_hot_session(spark):
    """One session holds most of the rows; the answer comes at the very end."""
    n = 20000
    rows = [("hot", 0, "smtp", "request", "STARTTLS", None, None, None, True, 1)]
    rows += [("hot", i, "smtp", "capability", None, None, "SIZE", None, True, i) for i in range(1, n)]
    rows += [("hot", n, "smtp", "reply", None, 220, None, None, True, n)]
    rows += [("cold", 0, "smtp", "request", "AUTH", None, None, None, False, 1)]
    out = ops.upgrade_outcomes(spark.createDataFrame(rows, SCHEMA), width=500)
    got = {r.uid: (r.state, r.downgrade_consistent, r.accepted_at) for r in out.collect()}
    assert got == {"hot": ("tls_established", True, n), "cold": ("plaintext_fallback", False, None)}


def test_upgrade_frames(spark):
    rows = [
        ("u", 0, "smtp", "capability", None, None, "STARTTLS", None, False, 4),
        ("u", 1, "smtp", "request", "STARTTLS", None, None, None, False, 5),
        ("u", 2, "smtp", "reply", None, 220, None, None, False, 6),
        ("u", 3, "smtp", "reply", None, 250, None, None, False, 7),
        ("u", 4, "smtp", "request", "NOOP", None, None, None, False, 8),
        ("u", 5, "smtp", "request", "MAIL", None, None, None, False, 9),
    ]
    events = spark.createDataFrame(rows, SCHEMA)
    out = ops.upgrade_outcomes(events)
    assert out.first().state == "violation"
    assert sorted(r.frame_number for r in ops.upgrade_frames(events, out).collect()) == [4, 5, 6, 9]


def test_built_sessions_take_the_walk_and_fixed_width_aggregates(spark):
    rng = random.Random(13)
    listed = {f"s{n}": dialogue(rng, f"s{n}") for n in range(150)}
    # Two answers in one place: the negative one decides.
    listed["tie"] = [
        ("tie", 0, "smtp", "request", "STARTTLS", None, None, None, True, 1),
        ("tie", 1, "smtp", "reply", None, 250, None, None, True, 2),
        ("tie", 1, "smtp", "reply", None, 454, None, None, True, 3),
    ]
    expected = {uid: walk(rows) for uid, rows in listed.items() if uid != "tie"} | {"tie": "requested", "silent": None}
    flows = [(uid, "a", 40000, "b", 465 if uid == "silent" else 25) for uid in expected]
    facts = [(uid, uid == "silent" or listed[uid][0][8], None) for uid in expected]
    out = ops.build_sessions(
        spark.createDataFrame(flows, "uid string, orig_h string, orig_p int, resp_h string, resp_p int"),
        spark.createDataFrame([r for rows in listed.values() for r in rows], SCHEMA),
        tls_facts=spark.createDataFrame(facts, "uid string, client_hello boolean, next_protocol string"),
    )
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.uid: r for r in out.collect()}
    assert {uid: r.upgrade_state for uid, r in got.items()} == expected
    assert got["silent"].downgrade_consistent is None and got["silent"].upgrade_evidence_state == "not_observable"
    assert out.columns.count("client_hello") == 1


# --- merge ------------------------------------------------------------------------------------

MERGE = (
    "uid string, ord bigint, ts double, direction string, kind string, command string, reply_code int, "
    "text string, tag string, frame_number bigint"
)


def compatible(a, b):
    if a["direction"] != b["direction"] or a["kind"] != b["kind"] or a["kind"] not in ("request", "reply"):
        return False
    if a["tag"] and b["tag"] and a["tag"] != b["tag"]:
        return False
    if a["kind"] == "request":
        return (a["command"] or "").upper() == (b["command"] or "").upper()
    if a["reply_code"] is not None and b["reply_code"] is not None:
        return a["reply_code"] == b["reply_code"]
    x, y = (a["text"] or "").upper(), (b["text"] or "").upper()
    if x and y and (y in x or y.startswith(x.split()[0])):
        return True
    return bool(a["command"]) and a["command"] == b["command"]


def greedy(first, second):
    """Every second event in time order takes the nearest free partner, later one on a tie."""
    taken, pairs = set(), set()
    for extra in sorted(second, key=lambda e: (e["ts"], e["ord"])):
        if extra["kind"] == "request" and extra["command"] is None:
            continue
        best, gap = None, 2.0
        for event in sorted(first, key=lambda e: (e["ts"], e["ord"])):
            if (event["uid"], event["ord"]) in taken or event["uid"] != extra["uid"]:
                continue
            delta = abs(event["ts"] - extra["ts"])
            if compatible(event, extra) and delta <= gap:
                best, gap = event, delta
        if best is not None:
            taken.add((best["uid"], best["ord"]))
            pairs.add((best["uid"], best["ord"], extra["ord"]))
    return pairs


def test_merge_equals_the_greedy_walk(spark):
    rng = random.Random(3)
    names = [c.split()[0] for c in MERGE.split(", ")]

    def event(uid, i, frame):
        kind = rng.choice(["request", "reply", "capability"])
        return dict(
            zip(
                names,
                (
                    uid, i, round(rng.random() * 30, 2), rng.choice(["orig", "resp"]), kind,
                    rng.choice(["NOOP", "AUTH", None]), rng.choice([220, 250, None]),
                    rng.choice(["ok", "ok ready", None]), rng.choice(["t1", None]), frame,
                ),
                strict=True,
            )
        )

    first = [event(f"u{n % 12}", n, None) for n in range(500)]
    second = [event(f"u{n % 12}", 1000 + n, n + 1) for n in range(400)]
    frames = [spark.createDataFrame([tuple(e.values()) for e in rows], MERGE) for rows in (first, second)]
    got = {(r.uid, r.ord, r.second_ord) for r in ops.match_second_source(*frames).collect()}
    assert got == greedy(first, second)
    merged = ops.merge_sources(*frames)
    named = [e for e in second if e["kind"] != "request" or e["command"] is not None]
    assert merged.count() == len(first) + len(named) - len(got)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 7), st.integers(0, 7), st.sampled_from([0, 1, 2, 4]), st.booleans())
def test_identity_rules(spark, first, second, alpn, vague):
    row = spark.range(1).select(
        *[
            c.alias(n)
            for n, c in ops.resolve_identity(
                F.lit(first), F.lit(second), F.lit(alpn), F.lit(vague)
            ).items()
        ]
    ).first()
    both = first | second | alpn
    disagree = bool(first and second and first != second)
    if disagree or bin(both).count("1") > 1:
        assert (row.protocol, row.evidence_state) == (None, "conflicting")
        assert (row.confidence == 0.5) == disagree
    elif both:
        assert row.evidence_state == "observed" and row.payload_evidence == row.protocol
    else:
        assert row.payload_evidence == ("indeterminate" if vague else "none")
