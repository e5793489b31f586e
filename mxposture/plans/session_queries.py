"""Session queries over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.operators import sessions as ops
from mxposture.operators.handshakes import last_per_uid
from mxposture.plans.adapters import VIEWS, view
from mxposture.plans.registry import query

# Longer, irregular dialogues: several upgrade requests, late and negative answers, tags.
VIEWS["x_dialogue"] = """
SELECT CAST(l_orderkey AS STRING) AS uid,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ord,
       CASE l_orderkey % 3 WHEN 0 THEN 'smtp' WHEN 1 THEN 'imap' ELSE 'pop3' END AS protocol,
       CASE WHEN l_partkey % 9 = 0 THEN 'capability' WHEN l_partkey % 9 <= 3 THEN 'request' WHEN l_partkey % 9 <= 6 THEN 'reply'
            WHEN l_suppkey % 7 = 0 THEN 'starttls' WHEN l_suppkey % 7 = 1 THEN 'unexpected'
            WHEN l_partkey % 9 = 7 THEN 'reply' ELSE 'request' END AS kind,
       CASE l_suppkey % 8 WHEN 0 THEN CASE l_orderkey % 3 WHEN 2 THEN 'STLS' ELSE 'STARTTLS' END
            WHEN 1 THEN CASE l_orderkey % 3 WHEN 2 THEN 'STLS' ELSE 'STARTTLS' END
            WHEN 2 THEN CASE l_orderkey % 3 WHEN 0 THEN 'AUTH' WHEN 1 THEN 'LOGIN' ELSE 'PASS' END
            WHEN 3 THEN 'NOOP' WHEN 4 THEN 'noop' WHEN 5 THEN 'FETCH' END AS command,
       CASE WHEN l_orderkey % 3 = 0 THEN CASE l_suppkey % 4 WHEN 0 THEN 220 WHEN 1 THEN 454 WHEN 2 THEN 354 ELSE 250 END END AS reply_code,
       CASE WHEN l_partkey % 9 = 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'CAPS STARTTLS STLS' ELSE 'CAPS' END
            WHEN l_orderkey % 3 = 1 THEN CASE l_suppkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'NO' WHEN 2 THEN 'BYE' ELSE 'OK done' END
            WHEN l_orderkey % 3 = 2 THEN CASE l_suppkey % 3 WHEN 0 THEN '-ERR' ELSE '+OK' END END AS text,
       CASE WHEN l_orderkey % 3 = 1 AND l_suppkey % 5 <> 0 THEN concat('a', CAST(l_linenumber % 2 AS STRING)) END AS tag,
       l_linenumber * 100 + l_partkey % 100 AS frame_number,
       l_suppkey % 2 = 1 AS is_orig,
       l_orderkey % 4 = 0 AS client_hello
FROM lineitem
"""

# Second source: two thirds of the session events again, a quarter of a second later.
VIEWS["x_second_events"] = """
SELECT uid, ord, ord + 0.25E0 AS ts, CASE WHEN is_orig THEN 'orig' ELSE 'resp' END AS direction, kind, command, reply_code,
       CASE WHEN kind = 'reply' THEN text END AS text, CAST(NULL AS STRING) AS tag,
       CAST(uid AS BIGINT) * 100 + ord + 1 AS frame_number
FROM x_session_events
WHERE kind <> 'capability' AND (CAST(uid AS BIGINT) + ord) % 3 <> 0
"""

_FOLD_EVENTS = """
SELECT uid, protocol, client_hello, list(struct_pack(
    up := kind = 'request' AND coalesce(command, '') = verb,
    rep := kind = 'reply',
    pos := coalesce(CASE protocol WHEN 'smtp' THEN reply_code BETWEEN 200 AND 299
             WHEN 'imap' THEN text = 'OK' OR starts_with(text, 'OK ')
             ELSE starts_with(text, '+OK') OR starts_with(text, 'OK') END, false),
    neg := coalesce(CASE protocol WHEN 'smtp' THEN reply_code >= 400
             WHEN 'imap' THEN starts_with(text, 'NO') OR starts_with(text, 'BAD')
             ELSE starts_with(text, '-ERR') END, false),
    tag := coalesce(tag, ''), expl := kind = 'starttls', unexp := kind = 'unexpected',
    cred := kind = 'request' AND upper(coalesce(command, '')) IN ('AUTH', 'LOGIN', 'PASS'),
    other := kind = 'request' AND upper(coalesce(command, '')) NOT IN ('NOOP', 'STARTTLS', 'STLS', 'EHLO', 'QUIT', 'CAPA'),
    adv := coalesce(kind IN ('capability', 'reply') AND list_contains(string_split(text, ' '), verb), false)
      OR (protocol = 'pop3' AND kind = 'capability' AND upper(coalesce(command, '')) = 'STLS')
      OR coalesce(protocol = 'smtp' AND kind = 'reply' AND upper(command) = 'STARTTLS' AND reply_code = 250, false),
    cap := kind = 'capability' OR coalesce(protocol <> 'smtp' AND kind = 'reply'
           AND list_contains(string_split(text, ' '), verb), false)) ORDER BY ord) AS ev
FROM (SELECT *, CASE protocol WHEN 'pop3' THEN 'STLS' ELSE 'STARTTLS' END AS verb FROM {events})
GROUP BY uid, protocol, client_hello
"""

_FOLD = """
SELECT uid, protocol, client_hello, list_reduce(ev, lambda a, x: struct_pack(
   req := a.req OR x.up, adv := a.adv OR x.adv, cap := a.cap OR x.cap,
   acc := CASE WHEN x.up THEN a.acc
               WHEN a.wait AND x.rep THEN a.acc OR (x.pos AND (protocol <> 'imap' OR a.tag = '' OR x.tag = '' OR a.tag = x.tag))
               WHEN x.expl THEN true ELSE a.acc END,
   wait := CASE WHEN x.up THEN true
                WHEN a.wait AND x.rep THEN protocol = 'imap' AND NOT ((a.tag = '' OR x.tag = '' OR a.tag = x.tag) AND (x.pos OR x.neg))
                ELSE a.wait END,
   tag := CASE WHEN x.up THEN x.tag ELSE a.tag END,
   viol := a.viol OR (NOT x.up AND a.acc AND NOT client_hello AND (x.unexp OR x.cred OR x.other)),
   fall := a.fall OR (x.cred AND NOT a.acc)),
   struct_pack(req := false, adv := false, cap := false, acc := false, wait := false, tag := '', viol := false, fall := false)) AS s
FROM ({events})
"""

_STATE = """CASE WHEN s.viol THEN 'violation' WHEN s.fall THEN 'plaintext_fallback'
   WHEN s.acc AND client_hello THEN 'tls_established' WHEN s.acc THEN 'accepted' WHEN s.req THEN 'requested'
   WHEN s.adv THEN 'advertised' ELSE '' END"""


def _folded(events: str) -> str:
    return f"""SELECT uid, protocol, {_STATE} AS state, s.cap AND NOT s.adv AND s.req AND s.acc AS downgrade_consistent
      FROM ({_FOLD.format(events=_FOLD_EVENTS.format(events=events))})"""


VIEWS["x_session_events_tagged"] = "SELECT *, CAST(NULL AS STRING) AS tag FROM x_session_events"
VIEWS["y_upgrades"] = _folded("x_session_events_tagged")
VIEWS["y_dialogue_upgrades"] = _folded("x_dialogue")
VIEWS["x_dialogue_h"] = "SELECT * EXCLUDE (client_hello), true AS client_hello FROM x_dialogue"
VIEWS["y_dialogue_upgrades_h"] = _folded("x_dialogue_h")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "x_session_events").withColumns(
        {
            "tag": F.lit(None).cast("string"),
            "frame_number": F.lit(None).cast("bigint"),
            "argument": F.lit(None).cast("string"),
            "ts": F.col("ord").cast("double"),
        }
    )


def tls_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last TLS row of each connection, as the session step needs it."""
    ssl = view(spark, sf_dir, "x_ssl").select(
        "uid",
        F.col("ssl_history").contains("C").alias("client_hello"),
        F.when(F.col("uid").cast("bigint") % 6 == 0, "imap").alias("next_protocol"),
    )
    return last_per_uid(ssl, ["client_hello"], ["client_hello", "next_protocol"])


@query(
    "j04_known_flow_events",
    "SELECT uid, ord, kind FROM x_session_events WHERE uid IN (SELECT uid FROM x_conn WHERE proto = 'tcp')",
)
def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = view(spark, sf_dir, "x_conn").where("proto = 'tcp'")
    return ops.clean_events(events(spark, sf_dir), flows).select("uid", "ord", "kind")


@query(
    "j06_second_source_merge",
    """SELECT e.uid, e.ord, coalesce(s.frame_number, -1) AS frame_number FROM x_session_events e
       LEFT JOIN x_second_events s ON e.uid = s.uid AND e.ord = s.ord""",
)
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = events(spark, sf_dir).withColumn(
        "direction", F.when(F.col("is_orig"), "orig").otherwise("resp")
    )
    merged = ops.merge_sources(first, view(spark, sf_dir, "x_second_events"))
    return merged.select("uid", "ord", F.coalesce("frame_number", F.lit(-1)).alias("frame_number"))


@query(
    "a03_session_protocol_sets",
    """SELECT uid, bit_or(CASE WHEN kind = 'unexpected' THEN 0 WHEN protocol = 'smtp' THEN 1
         WHEN protocol = 'imap' THEN 2 ELSE 4 END) AS mask, bool_or(kind = 'unexpected') AS ambiguous, count(*) AS events FROM x_dialogue GROUP BY uid""",
)
def protocol_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "x_dialogue").select(
        "uid",
        "ord",
        "protocol",
        F.when(F.col("kind") == "unexpected", "ambiguous_banner").otherwise(F.col("kind")).alias("kind"),
    )
    sets = ops.protocol_sets(rows)
    return sets.select(
        "uid", F.col("first_mask").alias("mask"), "ambiguous", F.col("event_count").alias("events")
    )


@query(
    "f07_frame_events",
    """SELECT uid, frame_number, protocol, kind, coalesce(command, '') AS command, coalesce(reply_code, -1) AS reply_code,
       coalesce(text, '') AS text FROM (SELECT uid, CAST(uid AS BIGINT) * 100 + ord + 1 AS frame_number, protocol, kind,
         CASE WHEN kind = 'request' THEN command END AS command, CASE WHEN kind = 'reply' THEN reply_code END AS reply_code,
         CASE WHEN kind = 'reply' AND protocol <> 'smtp' THEN text END AS text
         FROM x_session_events WHERE kind <> 'capability')""",
)
def frame_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("kind <> 'capability'")

    def when(protocol: str, kind: str, value) -> F.Column:
        return F.when((F.col("protocol") == protocol) & (F.col("kind") == kind), value)

    short = F.when(F.col("command") == "STARTTLS", "STAR").otherwise(F.lower("command"))
    frames = rows.select(
        "uid",
        (F.col("uid").cast("bigint") * 100 + F.col("ord") + 1).cast("string").alias("frame.number"),
        F.col("ord").cast("string").alias("frame.time_epoch"),
        F.lit(None).cast("string").alias("imap.tag"),
        when("imap", "request", F.col("command")).alias("imap.request.command"),
        when("imap", "reply", F.col("text")).alias("imap.response.status"),
        when("pop3", "request", F.col("command")).alias("pop.request.command"),
        when("pop3", "reply", F.col("text")).alias("pop.response.indicator"),
        when("smtp", "request", short).alias("smtp.req.command"),
        when("smtp", "reply", F.col("reply_code").cast("string")).alias("smtp.response.code"),
    )
    return ops.frame_events(frames).select(
        "uid",
        "frame_number",
        "protocol",
        "kind",
        F.coalesce("command", F.lit("")).alias("command"),
        F.coalesce("reply_code", F.lit(-1)).alias("reply_code"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


@query(
    "f08_client_hello_frames",
    "SELECT uid, frame_number, tie FROM x_hs_frames WHERE handshake_types = '1'",
)
def hello_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "x_hs_frames")
    return frames.where(ops.is_client_hello(F.col("handshake_types"))).select(
        "uid", "frame_number", "tie"
    )


VIEWS["x_identity"] = """
SELECT o_orderkey AS id, o_orderkey % 3 AS a, o_custkey % 4 AS b, o_orderkey % 5 AS c, o_custkey % 2 = 0 AS vague FROM orders
"""
_MASK = "CASE {0} WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END"


@query(
    "f09_identity_resolution",
    """SELECT id, coalesce(protocol, '') AS protocol, payload_evidence, evidence_state, coalesce(confidence, 0) AS confidence
       FROM (SELECT id, CASE WHEN clash THEN NULL ELSE name END AS protocol,
         CASE WHEN clash THEN 'indeterminate' WHEN name IS NOT NULL THEN name WHEN vague THEN 'indeterminate' ELSE 'none' END AS payload_evidence,
         CASE WHEN clash THEN 'conflicting' WHEN name IS NOT NULL THEN 'observed' ELSE 'indeterminate' END AS evidence_state,
         CASE WHEN a <> 0 AND b <> 0 AND a <> b THEN 0.5E0 END AS confidence
       FROM (SELECT *, (a <> 0 AND b <> 0 AND a <> b) OR bit_count(m) > 1 AS clash,
               CASE m WHEN 1 THEN 'smtp' WHEN 2 THEN 'imap' WHEN 4 THEN 'pop3' END AS name
             FROM (SELECT id, vague, a, b, a | b | l AS m FROM (SELECT id, vague, a, b, CASE c WHEN 4 THEN 4 ELSE 0 END AS l FROM x_identity))))""",
)
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "x_identity")
    alpn = F.when(F.col("c") == 4, F.lit(4)).otherwise(F.lit(0)).cast("bigint")
    out = rows.withColumns(ops.resolve_identity(F.col("a"), F.col("b"), alpn, F.col("vague")))
    return out.select(
        "id",
        F.coalesce("protocol", F.lit("")).alias("protocol"),
        "payload_evidence",
        "evidence_state",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


@query(
    "f11_implicit_tls",
    """SELECT c.uid, CASE WHEN p IS NOT NULL THEN p ELSE '' END AS implicit_protocol,
       CASE WHEN p IS NOT NULL THEN 'observed' WHEN resp_p IN (465, 993, 995) THEN 'indeterminate' ELSE 'not_observable' END AS implicit_state,
       CASE WHEN p IS NOT NULL THEN 'alpn' WHEN resp_p IN (465, 993, 995) THEN 'none' ELSE '' END AS implicit_source
       FROM x_conn c JOIN (SELECT uid, CASE WHEN CAST(uid AS BIGINT) % 6 = 0 THEN 'imap' END AS p FROM x_ssl) s ON c.uid = s.uid""",
)
def implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = view(spark, sf_dir, "x_conn").join(tls_facts(spark, sf_dir), "uid")
    out = joined.withColumns(
        ops.implicit_tls(F.col("resp_p"), F.lit(True), F.upper("next_protocol"))
    )
    cols = ["implicit_protocol", "implicit_state", "implicit_source"]
    return out.select("uid", *[F.coalesce(c, F.lit("")).alias(c) for c in cols])


@query("f12_upgrade_outcome", "SELECT uid, protocol, state, downgrade_consistent FROM y_upgrades")
def upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.upgrade_outcomes(events(spark, sf_dir))
    return out.select(
        "uid", "protocol", F.coalesce("state", F.lit("")).alias("state"), "downgrade_consistent"
    )


@query(
    "f12_dialogue_outcome",
    "SELECT uid, protocol, state, downgrade_consistent FROM y_dialogue_upgrades",
)
def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A chunk of three events makes nearly every session span several chunks.
    out = ops.upgrade_outcomes(view(spark, sf_dir, "x_dialogue"), width=3)
    return out.select(
        "uid", "protocol", F.coalesce("state", F.lit("")).alias("state"), "downgrade_consistent"
    )


@query("f12_upgrade_frames")
def upgrade_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "x_dialogue")
    return ops.upgrade_frames(rows, ops.upgrade_outcomes(rows))


@query(
    "w09_repeated_capabilities",
    """SELECT uid, count(*) AS kept FROM (SELECT *, lag(kind) OVER w AS pk, lag(text) OVER w AS pt, lag(is_orig) OVER w AS po
         FROM (SELECT uid, ord, CASE WHEN kind = 'reply' THEN 'capability' ELSE kind END AS kind, text, is_orig FROM x_dialogue)
         WINDOW w AS (PARTITION BY uid ORDER BY ord))
       WHERE NOT coalesce(kind = 'capability' AND pk = 'capability' AND text IS NOT DISTINCT FROM pt AND is_orig = po, false)
       GROUP BY uid""",
)
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "x_dialogue").select(
        "uid",
        "ord",
        F.when(F.col("kind") == "reply", "capability").otherwise(F.col("kind")).alias("kind"),
        "text",
        F.when(F.col("is_orig"), "orig").otherwise("resp").alias("direction"),
    )
    kept = ops.drop_repeated_capabilities(rows, ["ord"], width=4)
    return kept.groupBy("uid").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "u01_union_distinct_uids",
    """SELECT uid, min(struct_pack(s := source, o := ord)).s AS source, min(struct_pack(s := source, o := ord)).o AS ord
       FROM (SELECT uid, 0 AS source, ord FROM x_session_events UNION ALL SELECT uid, 1, ord FROM x_dialogue
             UNION ALL SELECT uid, 2, 0 FROM x_ssl) GROUP BY uid""",
)
def uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ssl = view(spark, sf_dir, "x_ssl").withColumn("ord", F.lit(0))
    return ops.union_uids(
        [view(spark, sf_dir, "x_session_events"), view(spark, sf_dir, "x_dialogue"), ssl]
    )


@query(
    "u03_union_after_merge",
    """SELECT kind, count(*) AS events FROM (SELECT kind FROM x_session_events UNION ALL
       SELECT kind FROM x_second_events WHERE CAST(uid AS BIGINT) % 4 = 0) GROUP BY kind""",
)
def union_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = events(spark, sf_dir).withColumn(
        "direction", F.when(F.col("is_orig"), "orig").otherwise("resp")
    )
    # A quarter of the sessions has a clock that is off by a minute: nothing there can match.
    second = view(spark, sf_dir, "x_second_events").withColumn(
        "ts", F.when(F.col("uid").cast("bigint") % 4 == 0, F.col("ts") + 60).otherwise(F.col("ts"))
    )
    second = second.withColumn("ord", F.col("ord") + 1000)
    merged = ops.merge_sources(first, second)
    return merged.groupBy("kind").agg(F.count(F.lit(1)).alias("events"))


@query(
    "u07_source_disagreement",
    """SELECT e.uid, e.m <> f.m AS disagree FROM
       (SELECT uid, bit_or(CASE protocol WHEN 'smtp' THEN 1 WHEN 'imap' THEN 2 ELSE 4 END) AS m FROM x_session_events GROUP BY uid) e
       JOIN (SELECT uid, bit_or(CASE protocol WHEN 'smtp' THEN 1 WHEN 'imap' THEN 2 ELSE 4 END) AS m FROM x_dialogue GROUP BY uid) f
       ON e.uid = f.uid""",
)
def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    def masks(name: str, alias: str) -> DataFrame:
        rows = view(spark, sf_dir, name)
        return rows.groupBy("uid").agg(F.bit_or(ops.protocol_bit(F.col("protocol"))).alias(alias))

    both = masks("x_session_events", "a").join(masks("x_dialogue", "b"), "uid")
    zero = F.lit(0)
    out = both.withColumns(ops.resolve_identity(F.col("a"), F.col("b"), zero, F.lit(False)))
    return out.select("uid", F.col("confidence").isNotNull().alias("disagree"))


@query(
    "a11_upgrade_states",
    """SELECT CASE state WHEN '' THEN 'none' ELSE state END AS state, count(*) AS sessions FROM y_dialogue_upgrades GROUP BY 1""",
)
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.upgrade_outcomes(view(spark, sf_dir, "x_dialogue"))
    label = F.coalesce("state", F.lit("none")).alias("state")
    return out.groupBy(label).agg(F.count(F.lit(1)).alias("sessions"))


@query(
    "f41_upgrade_timeline",
    """WITH o AS (SELECT * FROM (VALUES (1, 'advertised'), (2, 'requested'), (3, 'accepted'), (4, 'tls_established'),
         (5, 'plaintext_fallback'), (6, 'violation')) t(step, name))
       SELECT uid, o.name, CASE WHEN o.step >= 4 AND cur.step >= 4 AND o.name <> state THEN 'skipped'
         WHEN o.name = state THEN 'current' WHEN cur.step IS NULL OR o.step < cur.step THEN 'reached' ELSE 'pending' END AS status
       FROM y_upgrades LEFT JOIN o cur ON cur.name = state JOIN o ON true""",
)
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.upgrade_outcomes(events(spark, sf_dir))
    return out.select("uid", F.explode(ops.upgrade_steps(F.col("state"))).alias("_s")).select(
        "uid", "_s.name", "_s.status"
    )


@query(
    "e2_build_sessions",
    """SELECT c.uid, e.protocol, CASE WHEN resp_p IN (25, 465, 587) THEN 'smtp' WHEN resp_p IN (143, 993) THEN 'imap'
         WHEN resp_p IN (110, 995) THEN 'pop3' ELSE 'none' END AS port_hint, u.state AS upgrade_state
       FROM x_conn c JOIN (SELECT uid, min(protocol) AS protocol, true AS h FROM x_dialogue GROUP BY uid) e ON c.uid = e.uid
       JOIN y_dialogue_upgrades_h u ON u.uid = c.uid""",
)
def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = view(spark, sf_dir, "x_ssl").select(
        "uid", F.lit(True).alias("client_hello"), F.lit(None).cast("string").alias("next_protocol")
    )
    out = ops.build_sessions(
        view(spark, sf_dir, "x_conn"), view(spark, sf_dir, "x_dialogue"), tls_facts=facts
    )
    # Sessions without any event exist too (implicit TLS); the check covers those with events.
    return out.where(F.col("event_count").isNotNull()).select(
        "uid", "protocol", "port_hint", F.coalesce("upgrade_state", F.lit("")).alias("upgrade_state")
    )

