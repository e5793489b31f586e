"""TLS handshakes from analyzer rows: version, messages, key exchange, frames, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mxposture.constants import HANDSHAKE_TYPE_KINDS
from mxposture.functions import tls
from mxposture.functions.coerce import int_list
from mxposture.functions.states import lookup
from mxposture.operators.scale import large_keys, numbered
from mxposture.sources.lookups import CIPHER_SUITES, GROUPS



def cipher_code(name: Column, table: dict[str, str] | None = None) -> Column:
    """Suite code by exact name, then by upper-cased name."""
    table = CIPHER_SUITES if table is None else table
    return F.coalesce(lookup(name, table), lookup(F.upper(name), table))


def with_cipher_codes(ssl: DataFrame, suites: DataFrame) -> DataFrame:
    """The same by join for a snapshot table; AQE broadcasts it from its real size."""
    exact = suites.select(F.col("name").alias("cipher"), F.col("code").alias("_exact"))
    upper = suites.select(F.col("name").alias("_up"), F.col("code").alias("_upper"))
    return (
        ssl.withColumn("_up", F.upper("cipher"))
        .join(exact, "cipher", "left")
        .join(upper, "_up", "left")
        .withColumn("cipher_code", F.coalesce("_exact", "_upper"))
        .drop("_up", "_exact", "_upper")
    )


def _optional(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def build_handshakes(ssl: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """One row per TLS row with version, cipher, key exchange, visibility, states and secrecy.

    ``flows`` (uid, reconstruction_quality, reason_code) lowers the evidence state of handshakes
    cut from damaged flows.
    """
    if flows is not None:
        facts = flows.select(
            "uid",
            F.col("reconstruction_quality").alias("_quality"),
            F.col("reason_code").alias("_reason"),
        )
        ssl = ssl.join(facts, "uid", "left")
    else:
        none = F.lit(None).cast("string")
        ssl = ssl.withColumn("_quality", none).withColumn("_reason", none)
    out = (
        ssl.withColumn("ssl_history", F.coalesce("ssl_history", F.lit("")))
        .withColumn("established", F.coalesce("established", F.lit(False)))
        .withColumn("resumed", F.coalesce("resumed", F.lit(False)))
    )
    history = F.col("ssl_history")
    resolved = tls.selected_version(
        history,
        _optional(out, "server_supported_version", "int"),
        _optional(out, "server_version", "int"),
        _optional(out, "version", "string"),
    )
    out = out.withColumns({f"_{name}": value for name, value in resolved.items()})
    out = out.drop(*resolved).withColumnsRenamed({f"_{name}": name for name in resolved})
    curve = _optional(out, "curve", "string")
    wire_group = _optional(out, "server_key_share_group", "int")
    by_code = lookup(wire_group, GROUPS)
    name_codes = {v.lower(): k for k, v in GROUPS.items()}
    out = out.withColumns(
        {
            "group_name": F.coalesce(by_code, curve),
            "group_code": F.coalesce(
                wire_group, F.when(by_code.isNull(), lookup(F.lower(curve), name_codes))
            ),
            "cipher_code": cipher_code(F.col("cipher")),
        }
    )
    hello = tls.has_server_hello(history)
    out = out.withColumns(
        {
            **tls.key_exchange(
                F.col("version"),
                F.col("cipher"),
                F.col("group_code"),
                _optional(out, "client_key_share_groups", "array<bigint>"),
                _optional(out, "psk_key_exchange_modes", "array<bigint>"),
                curve,
                F.col("resumed"),
                F.col("group_name"),
            ),
            "cipher_state": tls.cipher_state(F.col("cipher"), F.col("cipher_code"), history),
            "cipher_name": F.when(hello, F.col("cipher")),
            "server_certificate_state": tls.certificate_state(history),
            "certificate_verify_state": tls.verify_state(history),
            "hello_retry_request": history.rlike("[jJ]"),
            "evidence_state": tls.handshake_state(
                F.col("_quality"),
                F.col("_reason"),
                F.col("established"),
                F.col("version"),
                F.col("version_state"),
            ),
            "visibility": tls.visibility(history, F.col("version"), F.col("established")),
        }
    )
    out = out.withColumns(
        tls.forward_secrecy(
            F.col("version"),
            F.col("version_state"),
            F.col("kx_mechanism"),
            F.col("kx_state"),
            F.col("evidence_state"),
        )
    )
    return out.drop("_quality", "_reason")


def message_rows(handshakes: DataFrame, keys: list[str]) -> DataFrame:
    """Messages as rows."""
    messages = tls.history_messages(F.col("ssl_history"))
    return handshakes.select(*keys, F.explode(messages).alias("_m")).select(*keys, "_m.*")


def frame_message_rows(frames: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Frames with a list of handshake types to one row per message, in frame order."""
    types = int_list(F.col("handshake_types"))
    rows = frames.select(
        "uid", "frame_number", *(tie or []), "selected_group", F.posexplode(types).alias("slot", "type")
    )
    retry = (F.col("type") == 2) & F.col("selected_group").isNotNull()
    kind = F.when(retry, "hello_retry_request").otherwise(lookup(F.col("type"), HANDSHAKE_TYPE_KINDS))
    return rows.withColumn("kind", kind).where(
        F.col("kind").isNotNull() & (F.col("frame_number") >= 1)
    )


def attach_frames(
    messages: DataFrame, frames: DataFrame, tie: list[str] | None = None, long: DataFrame | None = None
) -> DataFrame:
    """Give the n-th message of a kind the n-th frame of that kind.

    Retry requests beyond the retry messages take the next server hello and rewrite its kind. ``long`` names
    the uids with very many messages where they are known (see ``scale.large_keys``).
    """
    tie = tie or []
    order = ["frame_number", *tie, "slot"]
    real = messages.where(F.col("kind") != "direction_flip")
    # A connection's rows bound those of each kind, and a list of types is longer than the messages it names.
    busy = large_keys(frames, ["uid"], weight=F.length(F.col("handshake_types").cast("string")))
    long = large_keys(real, ["uid"]) if long is None else long
    # Dealt by uid, all steps but the match itself stay in place.
    rows = frame_message_rows(frames.repartition("uid") if busy.isEmpty() else frames, tie)
    rows = numbered(rows, ["uid", "kind"], order, "_n", large=busy)
    real = numbered(real, ["uid", "kind"], ["position"], "_n", large=long)
    retries = (
        real.where(F.col("kind") == "hello_retry_request")
        .groupBy("uid")
        .agg(F.count(F.lit(1)).alias("_retries"))
    )
    rows = rows.join(retries, "uid", "left").withColumn("_retries", F.coalesce("_retries", F.lit(0)))
    overflow = (F.col("kind") == "hello_retry_request") & (F.col("_n") > F.col("_retries"))
    queue = F.when(overflow, "server_hello").otherwise(F.col("kind"))
    rows = numbered(rows.withColumn("_queue", queue).drop("_n"), ["uid", "_queue"], order, "_n", large=busy)
    taken = rows.select(
        "uid",
        F.col("_queue").alias("kind"),
        "_n",
        F.col("kind").alias("_kind"),
        F.col("frame_number").alias("_frame"),
    )
    matched = real.join(taken, ["uid", "kind", "_n"], "left")
    out = matched.select(
        "uid",
        "position",
        F.coalesce("_kind", "kind").alias("kind"),
        "direction",
        "history_letter",
        F.col("_frame").alias("frame_number"),
        F.when(F.col("_frame").isNotNull(), "observed")
        .otherwise(F.col("evidence_state"))
        .alias("evidence_state"),
    )
    flips = messages.where(F.col("kind") == "direction_flip").select(
        "uid",
        "position",
        "kind",
        "direction",
        "history_letter",
        F.lit(None).cast(out.schema["frame_number"].dataType).alias("frame_number"),
        "evidence_state",
    )
    return out.unionByName(flips)


def verify_signatures(handshakes: DataFrame, frames: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Signature scheme of the first frame that carries a readable CertificateVerify."""
    order = ["frame_number", *(tie or [])]
    named = frames.where(F.array_contains(int_list(F.col("handshake_types")), F.lit(15).cast("bigint")))
    named = named.withColumn("_alg", tls.decode_signature(F.col("sig_hash_alg")))
    first = (
        named.where(F.col("_alg").isNotNull())
        .groupBy("uid")
        .agg(F.min(F.struct(*order, "_alg"))["_alg"].alias("_alg"))
    )
    seen = F.col("ssl_history").rlike("[yY]")
    return (
        handshakes.join(first, "uid", "left")
        .withColumn("signature_algorithm", F.when(seen, F.col("_alg")))
        .withColumn(
            "signature_state",
            F.when(~seen, "not_observable")
            .when(F.col("_alg").isNull(), "incomplete")
            .otherwise("observed"),
        )
        .drop("_alg")
    )


def certificate_frames(messages: DataFrame) -> DataFrame:
    """Distinct frame numbers of certificate messages per handshake, in order."""
    return (
        messages.where((F.col("kind") == "certificate") & F.col("frame_number").isNotNull())
        .groupBy("uid", "frame_number")
        .agg(F.min("position").alias("position"))
    )


def timeline(handshakes: DataFrame, keys: list[str]) -> DataFrame:
    """Horizontal place of each message and the width of its row; no shuffle, because a history
    and its messages sit in one row."""
    messages = tls.history_messages(F.col("ssl_history"))
    width = F.greatest(F.lit(160), F.lit(28) + F.size(messages) * 92)
    rows = handshakes.select(*keys, width.alias("width"), F.explode(messages).alias("_m"))
    return rows.select(*keys, "_m.*", "width", (F.lit(16) + F.col("_m.position") * 92).alias("x"))


def first_per_uid(rows: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """First row of each uid by ``order``; one partial row per uid and input partition moves."""
    return _edge(rows, order, keep, F.min)


def last_per_uid(rows: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """Last row of each uid by ``order``."""
    return _edge(rows, order, keep, F.max)


def _edge(rows: DataFrame, order: list[str], keep: list[str] | None, pick) -> DataFrame:
    keep = keep or [c for c in rows.columns if c != "uid"]
    position = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    packed = F.struct(position.alias("_o"), F.struct(*keep).alias("_r"))
    return rows.groupBy("uid").agg(pick(packed)["_r"].alias("_r")).select("uid", "_r.*")
