"""Mail sessions: event clean-up, second-source merge, identity and upgrade outcome.

A session may hold any number of events. The upgrade machine is therefore not a fold over a
collected list: its state is recovered from a running count of upgrade requests (chunked) and
two levels of map-side-combined aggregates.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mxposture.constants import (
    EVENT_KINDS,
    IMPLICIT_TLS_PORTS,
    MAIL_PROTOCOLS,
    UPGRADE_ORDER,
    UPGRADE_TERMINAL,
)
from mxposture.functions.coerce import bounded_string, whole_number
from mxposture.functions.text import bound_text, redact
from mxposture.functions.tls import protocol_from_alpn
from mxposture.operators.flows import direction, port_hint
from mxposture.operators.scale import CHUNK_ROWS, previous_value, running

MERGE_SECONDS = 2.0

# Command words of the three upgrade dialogues (fixed values).
UPGRADE_VERB = {"smtp": "STARTTLS", "imap": "STARTTLS", "pop3": "STLS"}
CAPABILITY_COMMANDS = {"smtp": ["EHLO", "HELO", "LHLO"], "imap": ["CAPABILITY"], "pop3": ["CAPA"]}
CREDENTIAL_COMMANDS = {
    "smtp": ["AUTH"],
    "imap": ["LOGIN", "AUTHENTICATE"],
    "pop3": ["USER", "PASS", "APOP", "AUTH"],
}
HARMLESS_COMMANDS = {
    "smtp": ["EHLO", "HELO", "LHLO", "STARTTLS", "QUIT", "NOOP", "RSET", "HELP"],
    "imap": ["CAPABILITY", "STARTTLS", "LOGOUT", "NOOP", "ID"],
    "pop3": ["CAPA", "STLS", "QUIT", "NOOP"],
}


def clean_events(events: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """Legal event rows of known flows, commands upper-cased, secrets replaced."""
    if flows is not None:
        events = events.join(flows.select("uid"), "uid", "left_semi")
    command = F.upper(bounded_string(F.col("command")))
    kind = F.lower(F.col("kind"))
    return (
        events.withColumn("kind", kind)
        .where(F.col("kind").isin(EVENT_KINDS))
        .withColumn("command", command)
        .withColumn("argument", redact(F.col("command"), F.col("argument")))
        .withColumn("text", redact(F.col("command"), F.col("text")))
        .withColumn("direction", direction(F.col("is_orig")))
    )


def drop_repeated_capabilities(
    events: DataFrame, order: list[str], width: int = CHUNK_ROWS
) -> DataFrame:
    """Without capability rows that repeat the row before (same text and direction)."""
    row = F.struct("kind", "text", "direction")
    marked = previous_value(events, ["uid"], order, row, "_before", width)
    same = (
        (F.col("kind") == "capability")
        & (F.col("_before.kind") == "capability")
        & F.col("text").eqNullSafe(F.col("_before.text"))
        & (F.col("direction") == F.col("_before.direction"))
    )
    return marked.where(~F.coalesce(same, F.lit(False))).drop("_before")


def frame_events(frames: DataFrame) -> DataFrame:
    """Decoded frames to protocol events; the first protocol whose fields are set wins."""
    imap_cmd, imap_status = F.col("`imap.request.command`"), F.col("`imap.response.status`")
    pop_cmd, pop_status = F.col("`pop.request.command`"), F.col("`pop.response.indicator`")
    smtp_cmd, smtp_code = F.col("`smtp.req.command`"), F.col("`smtp.response.code`")

    def filled(c: Column) -> Column:
        return bounded_string(c, 32).isNotNull()

    protocol = (
        F.when(filled(imap_cmd) | filled(imap_status), "imap")
        .when(filled(pop_cmd) | filled(pop_status), "pop3")
        .when(filled(smtp_cmd) | filled(smtp_code), "smtp")
    )
    request = (
        F.when(F.col("protocol") == "imap", bounded_string(imap_cmd, 32))
        .when(F.col("protocol") == "pop3", bounded_string(pop_cmd, 32))
        .otherwise(bounded_string(smtp_cmd, 32))
    )
    command = F.upper(request)
    command = F.when(
        (F.col("protocol") == "smtp") & (command == "STAR"), F.lit("STARTTLS")
    ).otherwise(command)
    status = F.when(F.col("protocol") == "imap", bounded_string(imap_status, 32)).when(
        F.col("protocol") == "pop3", bounded_string(pop_status, 32)
    )
    code = F.when(F.col("protocol") == "smtp", whole_number(smtp_code))
    number = whole_number(F.col("`frame.number`"))
    return (
        frames.withColumn("protocol", protocol)
        .where(F.col("protocol").isNotNull())
        .select(
            "uid",
            F.col("`frame.time_epoch`").try_cast("double").alias("ts"),
            "protocol",
            F.when(number >= 1, number).alias("frame_number"),
            F.when(request.isNotNull(), "orig").otherwise("resp").alias("direction"),
            F.when(request.isNotNull(), "request").otherwise("reply").alias("kind"),
            command.alias("command"),
            F.when(request.isNull(), code).cast("int").alias("reply_code"),
            F.when(request.isNull(), bound_text(F.upper(status))).alias("text"),
            F.when(F.col("protocol") == "imap", bounded_string(F.col("`imap.tag`"), 32)).alias("tag"),
        )
        .where(
            (F.col("kind") == "request")
            | F.col("text").isNotNull()
            | F.col("reply_code").isNotNull()
        )
    )


def is_client_hello(types: Column) -> Column:
    """First handshake type of a number or comma list is 1."""
    return F.coalesce(
        F.trim(F.element_at(F.split(types.cast("string"), ","), 1)).isin("1", "1.0"), F.lit(False)
    )


# --- second-source merge -----------------------------------------------------------------


def _compatible(a, b) -> bool:
    if a.tag and b.tag and a.tag != b.tag:
        return False
    if a.kind == "request":
        return True  # same command by the grouping key
    if a.reply_code >= 0 and b.reply_code >= 0:
        return a.reply_code == b.reply_code
    first, second = a.text.upper(), b.text.upper()
    if first and second:
        head = first.split()[0] if first.split() else ""
        if second in first or second.startswith(head):
            return True
    return bool(a.command) and a.command == b.command


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nearest unmatched partner within the time limit, second events in time order.

    Rows arrive sorted by island and time, so only the events of the last few seconds are held.
    A tie goes to the later candidate.
    """
    firsts: deque = deque()
    waiting: deque = deque()
    current = None
    out: list[tuple] = []

    def settle(now: float | None) -> None:
        while waiting and (now is None or waiting[0].ts + MERGE_SECONDS < now):
            event = waiting.popleft()
            while firsts and firsts[0].ts < event.ts - MERGE_SECONDS:
                firsts.popleft()
            best, best_delta = None, MERGE_SECONDS
            for index, candidate in enumerate(firsts):
                delta = abs(candidate.ts - event.ts)
                if delta <= best_delta and _compatible(candidate, event):
                    best, best_delta = index, delta
            if best is not None:
                taken = firsts[best]
                del firsts[best]
                out.append((taken.uid, taken.ord, event.ord, event.frame_number, event.tag or None))

    for batch in batches:
        for row in batch.itertuples(index=False):
            group = (row.uid, row.direction, row.kind, row.match_command, row.island)
            if group != current:
                settle(None)
                firsts.clear()
                current = group
            settle(row.ts)
            (firsts if row.source == 0 else waiting).append(row)
        if out:
            yield pd.DataFrame(out, columns=["uid", "ord", "second_ord", "new_frame", "new_tag"])
            out = []
    settle(None)
    if out:
        yield pd.DataFrame(out, columns=["uid", "ord", "second_ord", "new_frame", "new_tag"])


def match_second_source(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs (uid, ord, second_ord, new_frame, new_tag) of the greedy one-to-one match.

    Only requests with the same command and replies in the same direction can match, and only
    within two seconds. So the work is cut by direction, kind and command, and then at every time
    gap: two-second cells that hold events are chained while they touch. A long session falls
    into many islands; an island streams through its task sorted by time and is never collected.
    """
    cols = ["uid", "ord", "ts", "direction", "kind", "command", "reply_code", "text", "tag"]

    def shaped(df: DataFrame, source: int) -> DataFrame:
        return df.where(F.col("kind").isin("request", "reply")).select(
            "uid",
            "ord",
            F.coalesce(F.col("ts"), F.col("ord").cast("double")).alias("ts"),
            "direction",
            "kind",
            F.coalesce(F.upper("command"), F.lit("")).alias("command"),
            F.coalesce(F.col("reply_code"), F.lit(-1)).cast("int").alias("reply_code"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce("tag", F.lit("")).alias("tag"),
            (F.col("frame_number") if source else F.lit(None)).cast("bigint").alias("frame_number"),
            F.lit(source).alias("source"),
        )

    extra = shaped(second, 1).where((F.col("kind") != "request") | (F.col("command") != ""))
    events = shaped(first, 0).unionByName(extra)
    key = ["uid", "direction", "kind", "match_command"]
    events = events.withColumn(
        "match_command", F.when(F.col("kind") == "request", F.col("command")).otherwise(F.lit(""))
    ).withColumn("_cell", F.floor(F.col("ts") / F.lit(MERGE_SECONDS)).cast("bigint"))
    cells = events.groupBy(*key, "_cell").agg(F.max("source").alias("_s"), F.min("source").alias("_f"))
    by_time = Window.partitionBy(*key).orderBy("_cell")
    cells = cells.withColumn("island", F.col("_cell") - F.row_number().over(by_time))
    # Islands without both sources have nothing to match.
    both = (
        cells.groupBy(*key, "island")
        .agg(F.max("_s").alias("_s"), F.min("_f").alias("_f"))
        .where((F.col("_s") == 1) & (F.col("_f") == 0))
        .select(*key, "island")
    )
    cells = cells.select(*key, "_cell", "island").join(both, [*key, "island"], "left_semi")
    placed = events.join(cells, [*key, "_cell"]).select(
        *cols, "frame_number", "source", "match_command", "island"
    )
    ordered = placed.repartition(*key, "island").sortWithinPartitions(
        *key, "island", "ts", "source", "ord"
    )
    return ordered.mapInPandas(
        _greedy, "uid string, ord bigint, second_ord bigint, new_frame bigint, new_tag string"
    )


def merge_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """First-source events with frame and tag of their partners, plus unmatched second events."""
    pairs = match_second_source(first, second)
    keyed = first.join(
        pairs.select("uid", "ord", "new_frame", "new_tag"), ["uid", "ord"], "left"
    )
    cols = [c for c in first.columns if c not in ("frame_number", "tag")]
    base = keyed.select(
        *cols,
        F.coalesce("new_frame", F.col("frame_number").cast("bigint")).alias("frame_number"),
        F.coalesce("new_tag", "tag").alias("tag"),
        F.lit("first").alias("source"),
    )
    used = pairs.select("uid", F.col("second_ord").alias("ord"))
    named = second.where((F.col("kind") != "request") | F.col("command").isNotNull())
    rest = named.join(used, ["uid", "ord"], "left_anti").withColumn("source", F.lit("second"))
    return base.unionByName(rest, allowMissingColumns=True)


# --- identity -----------------------------------------------------------------------------


def protocol_bit(protocol: Column) -> Column:
    """Protocol sets as bit masks: they union map-side as one int."""
    out = F.lit(0)
    for index, name in enumerate(MAIL_PROTOCOLS):
        out = F.when(F.lower(protocol) == name, F.lit(1 << index)).otherwise(out)
    return out


def protocol_of(mask: Column) -> Column:
    out = F.when(mask == 1, MAIL_PROTOCOLS[0])
    for index, name in enumerate(MAIL_PROTOCOLS[1:], 1):
        out = out.when(mask == (1 << index), name)
    return out


def protocol_sets(events: DataFrame) -> DataFrame:
    """Per session: protocols its events confirm, ambiguous greeting, first position."""
    vague = F.col("kind") == "ambiguous_banner"
    return events.groupBy("uid").agg(
        F.bit_or(F.when(vague, F.lit(0)).otherwise(protocol_bit(F.col("protocol")))).alias("first_mask"),
        F.max(vague).alias("ambiguous"),
        F.min("ord").alias("first_ord"),
        F.count(F.lit(1)).alias("event_count"),
    )


def resolve_identity(first: Column, second: Column, alpn: Column, ambiguous: Column) -> dict[str, Column]:
    """Protocol, payload, state and confidence from the protocol sets of both sources."""
    both = first.bitwiseOR(second).bitwiseOR(alpn)
    disagree = (first != 0) & (second != 0) & (first != second)
    clash = disagree | (F.bit_count(both) > 1)
    name = protocol_of(both)
    return {
        "protocol": F.when(~clash, name),
        "payload_evidence": F.when(clash, "indeterminate")
        .when(name.isNotNull(), name)
        .when(ambiguous, "indeterminate")
        .otherwise("none"),
        "evidence_state": F.when(clash, "conflicting")
        .when(name.isNotNull(), "observed")
        .otherwise("indeterminate"),
        "confidence": F.when(disagree, F.lit(0.5)),
    }


# --- upgrade outcome -------------------------------------------------------------------------


def _by_protocol(table: dict[str, list[str]], command: Column) -> Column:
    out = F.lit(False)
    for name, words in table.items():
        out = F.when(F.col("protocol") == name, command.isin(words)).otherwise(out)
    return out


def _event_facts(events: DataFrame) -> DataFrame:
    """Row-level facts the dialogue depends on."""
    command = F.coalesce(F.upper("command"), F.lit(""))
    text = F.coalesce(F.upper("text"), F.lit(""))
    kind = F.col("kind")
    smtp, imap, pop3 = (F.col("protocol") == p for p in ("smtp", "imap", "pop3"))
    verb = F.when(pop3, "STLS").otherwise("STARTTLS")
    words = F.split(F.when(smtp, text).otherwise(F.regexp_replace(text, ",", " ")), r"\s+")
    # Splitting compiles its pattern on every row; a text that does not contain the verb has no such word.
    offered = F.when(text.contains(verb), F.array_contains(words, verb)).otherwise(F.lit(False))
    capability, reply, request = kind == "capability", kind == "reply", kind == "request"
    upgrade = request & (command == verb)
    return _filled(
        events,
        {
            "_upgrade": upgrade,
            "_advert": (capability & (offered | (pop3 & (command == "STLS"))))
            | (reply & offered)
            | (smtp & reply & (command == "STARTTLS") & (F.col("reply_code") == 250)),
            "_asked": capability
            | (smtp & reply & command.isin(CAPABILITY_COMMANDS["smtp"]))
            | (imap & request & (command == "CAPABILITY"))
            | (pop3 & request & (command == "CAPA"))
            | (~smtp & reply & offered),
            "_positive": F.when(smtp, F.col("reply_code").between(200, 299))
            .when(imap, (text == "OK") | text.startswith("OK "))
            .otherwise(text.startswith("+OK") | text.startswith("OK")),
            "_negative": F.when(smtp, F.col("reply_code") >= 400)
            .when(imap, text.startswith("NO") | text.startswith("BAD"))
            .otherwise(text.startswith("-ERR") | text.startswith("ERR")),
            "_credential": request & ~upgrade & _by_protocol(CREDENTIAL_COMMANDS, command),
            "_risky": (kind == "unexpected")
            | (request & ~upgrade & ~_by_protocol(HARMLESS_COMMANDS, command)),
        },
    )


def _filled(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})


def _awaited(events: DataFrame, width: int, counted: DataFrame | None = None) -> DataFrame:
    """Events with the number of upgrade requests so far and whether a reply can answer one.

    A reply answers the latest request. IMAP replies must carry its tag (when both have one) and
    a final status; any reply counts in the other two dialogues.
    """
    tagged = F.when(F.col("_upgrade"), F.struct(F.col("tag").alias("tag")))
    events = running(
        events,
        ["uid"],
        ["ord"],
        {"_epoch": F.when(F.col("_upgrade"), 1).otherwise(0)},
        {"_request": tagged},
        width,
        counted=counted,
    )
    wanted, tag = F.col("_request.tag"), F.col("tag")
    final = (wanted.isNull() | tag.isNull() | (tag == wanted)) & (
        F.col("_positive") | F.col("_negative")
    )
    answer = (F.col("kind") == "reply") & (F.col("_epoch") > 0)
    answer = answer & F.when(F.col("protocol") == "imap", final).otherwise(F.lit(True))
    return events.withColumn("_answer", F.coalesce(answer, F.lit(False)))


def upgrade_outcomes(events: DataFrame, width: int = CHUNK_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Upgrade state per session from events (uid, ord, protocol, kind, command, reply_code,
    text, tag, client_hello).

    Acceptance is the first positive answer or explicit start event. Credentials before it are a
    fallback; risky commands after it without a client hello are a violation. Every step is a
    min/max aggregate, first per (session, request), then per session. ``counted``: see ``scale.running``.
    """
    own = {"protocol": F.max("protocol"), "client_hello": F.max(F.coalesce("client_hello", F.lit(False)))}
    whole = _upgrade_marks(events, width, events if counted is None else counted, own)
    return whole.withColumns(_upgrade_state()).drop("_asked", "_cred_first", "_risk_last")


def _upgrade_marks(events: DataFrame, width: int, counted: DataFrame, own: dict[str, Column]) -> DataFrame:
    """Per session what its state follows from, and the maxima ``own``.

    But for ``own`` all values are of fixed width, so the aggregates stay hash-based.
    """
    rows = _awaited(_event_facts(events), width, counted)
    ord_ = F.col("ord")
    positive = F.col("_positive")
    per_request = rows.groupBy("uid", "_epoch").agg(
        *[c.alias(n) for n, c in own.items()],
        F.max("_upgrade").alias("_requested"),
        F.max("_advert").alias("_advertised"),
        F.max("_asked").alias("_asked"),
        F.min(F.when(F.col("_answer") & positive, ord_)).alias("_yes"),
        F.min(F.when(F.col("_answer") & ~positive, ord_)).alias("_no"),
        F.min(F.when(F.col("kind") == "starttls", ord_)).alias("_explicit"),
        F.min(F.when(F.col("_credential"), ord_)).alias("_cred_first"),
        F.max(F.when(F.col("_credential") | F.col("_risky"), ord_)).alias("_risk_last"),
    )
    # The first answer decides; of two in one place the negative.
    answered = F.when(F.col("_no").isNull() | (F.col("_yes") < F.col("_no")), F.col("_yes"))
    return per_request.groupBy("uid").agg(
        *[F.max(n).alias(n) for n in own],
        F.max("_requested").alias("requested"),
        F.max("_advertised").alias("advertised"),
        F.max("_asked").alias("_asked"),
        F.min(F.least(answered, F.col("_explicit"))).alias("accepted_at"),
        F.min("_cred_first").alias("_cred_first"),
        F.max("_risk_last").alias("_risk_last"),
    )


def _upgrade_state() -> dict[str, Column]:
    """State columns from ``_upgrade_marks``, protocol and client_hello; null without marks."""
    accepted = F.col("accepted_at").isNotNull()
    hello = F.col("client_hello")
    mail = F.col("protocol").isin(MAIL_PROTOCOLS)
    violation = accepted & ~hello & (F.col("_risk_last") > F.col("accepted_at"))
    fallback = F.col("_cred_first").isNotNull() & (
        ~accepted | (F.col("_cred_first") < F.col("accepted_at"))
    )
    state = (
        F.when(F.coalesce(violation, F.lit(False)), "violation")
        .when(F.coalesce(fallback, F.lit(False)), "plaintext_fallback")
        .when(accepted & hello, "tls_established")
        .when(accepted, "accepted")
        .when(F.col("requested"), "requested")
        .when(F.col("advertised"), "advertised")
    )
    state = F.when(mail, state)
    downgrade = (
        F.col("_asked") & ~F.col("advertised") & F.col("requested") & accepted & F.coalesce(mail, F.lit(False))
    )
    return {
        "state": state,
        "evidence_state": F.when(state.isNotNull(), "observed").otherwise("not_observable"),
        "downgrade_consistent": F.when(F.col("_asked").isNotNull(), downgrade),
    }


def upgrade_frames(
    events: DataFrame, outcomes: DataFrame, hello_frames: DataFrame | None = None, width: int = CHUNK_ROWS
) -> DataFrame:
    """Distinct frame numbers behind an upgrade outcome, as rows."""
    rows = _awaited(_event_facts(events), width, events)
    numbered = Window.partitionBy("uid", "_epoch").orderBy("ord")
    answers = (
        rows.where(F.col("_answer"))
        .withColumn("_n", F.row_number().over(numbered))
        .where((F.col("_n") == 1) & (F.col("_positive") | F.col("_negative")))
        .select("uid", "frame_number")
    )
    facts = outcomes.select("uid", "accepted_at", F.col("client_hello").alias("_hello"))
    joined = rows.drop("client_hello").join(facts, "uid")
    after = (F.col("ord") > F.col("accepted_at")) & ~F.col("_hello")
    cited = (
        F.col("_advert")
        | F.col("_upgrade")
        | (F.col("kind") == "starttls")
        | F.col("_credential")
        | (F.col("_risky") & F.coalesce(after, F.lit(False)))
    )
    frames = joined.where(cited & ~F.col("_answer")).select("uid", "frame_number").unionByName(answers)
    adverts = joined.where(F.col("_advert")).select("uid", "frame_number")
    frames = frames.unionByName(adverts)
    if hello_frames is not None:
        reached = outcomes.where(F.col("accepted_at").isNotNull() & F.col("client_hello"))
        frames = frames.unionByName(
            hello_frames.join(reached, "uid", "left_semi").select("uid", "frame_number")
        )
    return frames.where(F.col("frame_number").isNotNull()).distinct()


def implicit_tls(resp_port: Column, tls_seen: Column, alpn: Column) -> dict[str, Column]:
    """Protocol agreed inside TLS; a port alone proves nothing."""
    chosen = protocol_from_alpn(alpn)
    known = chosen.isNotNull() & tls_seen
    port = resp_port.isin(IMPLICIT_TLS_PORTS)
    return {
        "implicit_protocol": F.when(known, chosen),
        "implicit_state": F.when(known, "observed")
        .when(port, "indeterminate")
        .otherwise("not_observable"),
        "implicit_source": F.when(known, "alpn").when(port, "none"),
    }


def build_sessions(
    flows: DataFrame,
    events: DataFrame,
    frame_protocols: DataFrame | None = None,
    tls_facts: DataFrame | None = None,
    hello_frames: DataFrame | None = None,
    width: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per kept session: identity, port hint, upgrade outcome and implicit TLS.

    ``frame_protocols`` (uid, second_mask), ``tls_facts`` (uid, client_hello, next_protocol, one
    row per uid) and ``hello_frames`` (uid, frame_number) are optional second-source facts.
    """
    sets = protocol_sets(events)
    base = flows.select("uid", "orig_h", "orig_p", "resp_h", "resp_p").join(sets, "uid", "left")
    if frame_protocols is not None:
        base = base.join(frame_protocols, "uid", "left")
    else:
        base = base.withColumn("second_mask", F.lit(0))
    if tls_facts is not None:
        facts = tls_facts.select(
            "uid", F.col("client_hello").alias("_hello"), F.col("next_protocol").alias("_alpn")
        )
        base = base.join(facts.withColumn("_tls", F.lit(True)), "uid", "left")
    else:
        base = base.withColumns(
            {"_hello": F.lit(False), "_alpn": F.lit(None).cast("string"), "_tls": F.lit(False)}
        )
    if hello_frames is not None:
        seen = hello_frames.groupBy("uid").agg(F.count(F.lit(1)).alias("_hf"))
        base = base.join(seen, "uid", "left")
    else:
        base = base.withColumn("_hf", F.lit(None).cast("bigint"))
    base = base.fillna(
        {"first_mask": 0, "second_mask": 0, "ambiguous": False, "_hello": False, "_tls": False, "_hf": 0}
    )
    alpn = protocol_from_alpn(F.col("_alpn"))
    base = base.withColumns(
        resolve_identity(
            F.col("first_mask"), F.col("second_mask"), protocol_bit(alpn), F.col("ambiguous")
        )
    )
    candidate = F.col("resp_p").isin(IMPLICIT_TLS_PORTS) & F.col("_tls")
    touched = (
        F.col("event_count").isNotNull() | (F.col("second_mask") != 0) | F.col("_tls")
    )
    unnamed = F.col("payload_evidence") == "none"
    base = base.where(touched & (~unnamed | F.col("ambiguous") | candidate))
    base = base.withColumn(
        "payload_evidence", F.when(unnamed & candidate, "indeterminate").otherwise(F.col("payload_evidence"))
    )
    base = base.withColumn("port_hint", port_hint(F.col("resp_p"), F.col("orig_p")))
    base = base.withColumn("client_hello", F.col("_hello") | (F.col("_hf") > 0))
    base = base.withColumn(
        "corroboration",
        F.when((F.col("second_mask") != 0) | (F.col("_hf") > 0), "both").otherwise("first"),
    )
    named = base.select("uid", "protocol", "client_hello")
    dialogue = events.drop("protocol", "client_hello").join(named, "uid")
    # Protocol and client hello are one per session, so the outcome takes them from there.
    state = _upgrade_state()
    joined = base.join(_upgrade_marks(dialogue, width, events, {}), "uid", "left")
    columns = [*base.columns, state["state"].alias("upgrade_state")]
    columns += [state["downgrade_consistent"].alias("downgrade_consistent"), "accepted_at"]
    return (
        joined.select(*columns)
        .withColumn(
            "upgrade_evidence_state",
            F.when(F.col("upgrade_state").isNotNull(), "observed").otherwise("not_observable"),
        )
        .withColumns(
            implicit_tls(F.col("resp_p"), F.col("_tls") | (F.col("_hf") > 0), F.col("_alpn"))
        )
        .drop("_hello", "_alpn", "_tls", "_hf")
    )


def upgrade_steps(state: Column) -> Column:
    """Six fixed steps of an upgrade with reached / current / skipped / pending."""
    place = F.array_position(F.array(*[F.lit(s) for s in UPGRADE_ORDER]), state)
    ended = F.coalesce(state.isin(UPGRADE_TERMINAL), F.lit(False))
    steps = []
    for index, name in enumerate(UPGRADE_ORDER, 1):
        here = F.coalesce(state == name, F.lit(False))
        skipped = ended & ~here if name in UPGRADE_TERMINAL else F.lit(False)
        before = state.isNull() | (place == 0) | (place > index)
        status = (
            F.when(skipped, "skipped")
            .when(here, "current")
            .when(before, "reached")
            .otherwise("pending")
        )
        steps.append(F.struct(F.lit(index).alias("step"), F.lit(name).alias("name"), status.alias("status")))
    return F.array(*steps)


def union_uids(sources: list[DataFrame]) -> DataFrame:
    """Distinct uids of several sources with the source and position of first appearance."""
    parts = [
        df.select("uid", F.lit(i).alias("source"), F.col("ord").cast("bigint").alias("ord"))
        for i, df in enumerate(sources)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    first = F.min(F.struct("source", "ord"))
    return out.groupBy("uid").agg(first["source"].alias("source"), first["ord"].alias("ord"))
