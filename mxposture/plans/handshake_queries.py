"""Handshake queries over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.functions import tls
from mxposture.operators import handshakes as ops
from mxposture.operators.scale import large_keys
from mxposture.plans.adapters import VIEWS, view
from mxposture.plans.flow_queries import built_flows
from mxposture.plans.registry import query
from mxposture.sources.lookups import CIPHER_SUITES

# Frames that carry handshake messages, one per reconstruction row.
VIEWS["x_hs_frames"] = """
SELECT CAST(l_orderkey AS STRING) AS uid, l_linenumber * 1000 + l_suppkey % 1000 AS frame_number,
       l_partkey AS tie,
       CASE l_partkey % 8 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '2' WHEN 3 THEN '11,12,14'
            WHEN 4 THEN '11' WHEN 5 THEN '20' WHEN 6 THEN '15' ELSE '16' END AS handshake_types,
       CASE WHEN l_partkey % 8 = 2 THEN 29 END AS selected_group,
       CASE l_suppkey % 4 WHEN 0 THEN '0x0804' WHEN 1 THEN '1027' WHEN 2 THEN 'ed25519,0x0201' END AS sig_hash_alg
FROM lineitem
"""

_VALUES = ", ".join(f"('{n}', '{c}')" for n, c in CIPHER_SUITES.items())

VIEWS["y_handshakes"] = f"""
SELECT h.*,
 CASE WHEN h.evidence_state IN ('incomplete', 'conflicting') THEN 'handshake_incomplete'
      WHEN version IS NULL OR version_state <> 'observed' THEN 'version_unusable'
      WHEN kx_state IN ('incomplete', 'conflicting', 'not_observable') THEN 'key_exchange_unusable'
      WHEN kx_mechanism IS NULL THEN 'key_exchange_missing'
      WHEN version = 'TLSv13' AND kx_mechanism IN ('ECDHE', 'DHE', '(EC)DHE', 'PSK-(EC)DHE')
           AND kx_state <> 'indeterminate' THEN 'tls13_ephemeral'
      WHEN version = 'TLSv13' AND kx_mechanism = 'PSK' THEN 'tls13_psk_only'
      WHEN version = 'TLSv13' THEN 'tls13_unknown_mechanism'
      WHEN kx_mechanism IN ('ECDHE', 'DHE') AND kx_state <> 'indeterminate' THEN 'tls12_ephemeral'
      WHEN kx_mechanism IN ('RSA', 'DH', 'ECDH') AND kx_state <> 'indeterminate' THEN 'static_key_exchange'
      ELSE 'tls12_unknown_mechanism' END AS fs_reason,
 CASE fs_reason WHEN 'tls13_ephemeral' THEN 'present' WHEN 'tls12_ephemeral' THEN 'present'
      WHEN 'static_key_exchange' THEN 'absent' ELSE 'indeterminate' END AS fs_outcome
FROM (SELECT k.*,
  CASE WHEN quality = 'conflicting' THEN 'conflicting'
       WHEN quality = 'incomplete' AND reason IN ('snaplen_truncation', 'segment_gap', 'capture_loss', 'midstream_start')
            AND NOT established THEN 'incomplete'
       WHEN version_state = 'incomplete' THEN 'incomplete'
       WHEN version IS NOT NULL THEN 'observed' ELSE version_state END AS evidence_state
 FROM (SELECT v.*, f.quality, f.reason, c.code AS cipher_code,
   CASE WHEN NOT hello THEN 'incomplete' WHEN cipher IS NULL THEN 'not_observable'
        WHEN c.code IS NULL THEN 'inferred' ELSE 'observed' END AS cipher_state,
   CASE WHEN version IS NULL THEN NULL
        WHEN version = 'TLSv13' THEN
          CASE WHEN resumed AND server_key_share_group IS NOT NULL THEN 'PSK-(EC)DHE' WHEN resumed THEN 'PSK'
               WHEN server_key_share_group = 29 THEN 'ECDHE' WHEN server_key_share_group = 4588 THEN '(EC)DHE'
               WHEN server_key_share_group = 256 THEN 'DHE' END
        WHEN starts_with(cipher, 'TLS_AES') OR starts_with(cipher, 'TLS_CHACHA20') THEN NULL
        ELSE regexp_extract(cipher, '^TLS_([A-Z]+)_', 1) END AS kx_mechanism,
   CASE WHEN version IS NULL THEN 'incomplete'
        WHEN version = 'TLSv13' THEN CASE WHEN server_key_share_group IS NOT NULL THEN 'observed'
             WHEN resumed THEN 'inferred' ELSE 'indeterminate' END
        WHEN starts_with(cipher, 'TLS_AES') OR starts_with(cipher, 'TLS_CHACHA20') THEN 'indeterminate'
        ELSE 'inferred' END AS kx_state,
   CASE WHEN contains(ssl_history, 'x') THEN 'observed' ELSE 'not_observable' END AS server_certificate_state,
   CASE WHEN version = 'TLSv13' THEN 'partial'
        WHEN established AND hello AND regexp_matches(ssl_history, '[xn]') THEN 'full' ELSE 'partial' END AS visibility
  FROM (SELECT *, contains(ssl_history, 's') AS hello,
    CASE WHEN contains(ssl_history, 's') THEN
      CASE coalesce(server_supported_version, server_version) WHEN 769 THEN 'TLSv10' WHEN 770 THEN 'TLSv11'
           WHEN 771 THEN 'TLSv12' WHEN 772 THEN 'TLSv13' END END AS version,
    CASE WHEN contains(ssl_history, 's') THEN
      CASE WHEN server_supported_version IS NOT NULL THEN 'supported_versions' ELSE 'legacy_record' END END AS version_source,
    CASE WHEN contains(ssl_history, 's') THEN 'observed' ELSE 'incomplete' END AS version_state
   FROM x_ssl) v
  LEFT JOIN y_flows f ON v.uid = f.uid
  LEFT JOIN (VALUES {_VALUES}) c(name, code) ON v.cipher = c.name) k) h
"""


def built_handshakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.build_handshakes(view(spark, sf_dir, "x_ssl"), built_flows(spark, sf_dir))


@query(
    "f13_tls_version_decode",
    """SELECT uid, CASE server_version WHEN 769 THEN 'TLSv10' WHEN 770 THEN 'TLSv11' ELSE 'TLSv12' END AS by_code,
       CASE CAST(uid AS BIGINT) % 4 WHEN 0 THEN 'TLSv12' WHEN 1 THEN 'SSLv3' WHEN 2 THEN 'TLSv13' ELSE '' END AS by_text
       FROM x_ssl""",
)
def version_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("uid").cast("bigint") % 4
    raw = F.when(n == 0, "TLS 1.2").when(n == 1, "768").when(n == 2, " tlsv13 ").otherwise("dtls")
    return view(spark, sf_dir, "x_ssl").select(
        "uid",
        tls.decode_version(F.col("server_version")).alias("by_code"),
        F.coalesce(tls.decode_version(raw), F.lit("")).alias("by_text"),
    )


@query(
    "f14_history_messages",
    """SELECT kind, direction, count(*) AS messages, CAST(sum(position) AS BIGINT) AS positions FROM (
       SELECT generate_subscripts(string_split(ssl_history, ''), 1) - 1 AS position,
              unnest(string_split(ssl_history, '')) AS letter,
              CASE lower(letter) WHEN 'c' THEN 'client_hello' WHEN 's' THEN 'server_hello' WHEN 'x' THEN 'certificate'
                WHEN 'k' THEN 'server_key_exchange' WHEN 'n' THEN 'server_hello_done' WHEN 'g' THEN 'client_key_exchange'
                WHEN 'i' THEN 'change_cipher_spec' WHEN 'f' THEN 'finished' END AS kind,
              CASE WHEN letter = upper(letter) THEN 'orig' ELSE 'resp' END AS direction FROM x_ssl)
       GROUP BY 1, 2""",
)
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.message_rows(view(spark, sf_dir, "x_ssl"), ["uid"])
    return rows.groupBy("kind", "direction").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("position").alias("positions")
    )


@query(
    "f15_selected_version",
    """SELECT uid, coalesce(version, '') AS version, coalesce(version_source, '') AS version_source, version_state
       FROM y_handshakes""",
)
def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_handshakes(spark, sf_dir).select(
        "uid",
        F.coalesce("version", F.lit("")).alias("version"),
        F.coalesce("version_source", F.lit("")).alias("version_source"),
        "version_state",
    )


@query(
    "f16_visibility_state",
    "SELECT uid, visibility, evidence_state, server_certificate_state FROM y_handshakes",
)
def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_handshakes(spark, sf_dir).select(
        "uid", "visibility", "evidence_state", "server_certificate_state"
    )


@query(
    "f17_verify_signature",
    """WITH alg AS (SELECT uid, min(struct_pack(f := frame_number, t := tie,
           a := CASE sig_hash_alg WHEN '0x0804' THEN 'rsa_pss_rsae_sha256' WHEN '1027' THEN 'ecdsa_secp256r1_sha256'
                     ELSE 'rsa_pkcs1_sha1' END)).a AS a
         FROM x_hs_frames WHERE handshake_types = '15' AND sig_hash_alg IS NOT NULL GROUP BY uid)
       SELECT s.uid, CASE WHEN seen THEN coalesce(a, '') ELSE '' END AS signature_algorithm,
         CASE WHEN NOT seen THEN 'not_observable' WHEN a IS NULL THEN 'incomplete' ELSE 'observed' END AS signature_state
       FROM (SELECT uid, CAST(uid AS BIGINT) % 3 = 0 AS seen FROM x_ssl) s LEFT JOIN alg ON s.uid = alg.uid""",
)
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    ssl = view(spark, sf_dir, "x_ssl").withColumn(
        "ssl_history",
        F.when(F.col("uid").cast("bigint") % 3 == 0, F.concat("ssl_history", F.lit("y"))).otherwise(
            F.col("ssl_history")
        ),
    )
    out = ops.verify_signatures(ssl, view(spark, sf_dir, "x_hs_frames"), ["tie"])
    return out.select(
        "uid", F.coalesce("signature_algorithm", F.lit("")).alias("signature_algorithm"), "signature_state"
    )


@query(
    "f18_cipher_codes",
    "SELECT uid, coalesce(cipher_code, '') AS cipher_code, cipher_state FROM y_handshakes",
)
def ciphers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_handshakes(spark, sf_dir).select(
        "uid", F.coalesce("cipher_code", F.lit("")).alias("cipher_code"), "cipher_state"
    )


@query(
    "f19_key_exchange",
    "SELECT uid, coalesce(kx_mechanism, '') AS kx_mechanism, kx_state FROM y_handshakes",
)
def exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_handshakes(spark, sf_dir).select(
        "uid", F.coalesce("kx_mechanism", F.lit("")).alias("kx_mechanism"), "kx_state"
    )


@query("f20_forward_secrecy", "SELECT uid, fs_outcome, fs_reason FROM y_handshakes")
def secrecy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_handshakes(spark, sf_dir).select("uid", "fs_outcome", "fs_reason")


_ATTACH = """
WITH m AS (SELECT uid, generate_subscripts(string_split(ssl_history, ''), 1) - 1 AS position,
    CASE lower(unnest(string_split(ssl_history, ''))) WHEN 'c' THEN 'client_hello' WHEN 's' THEN 'server_hello'
      WHEN 'x' THEN 'certificate' WHEN 'k' THEN 'server_key_exchange' WHEN 'n' THEN 'server_hello_done'
      WHEN 'g' THEN 'client_key_exchange' WHEN 'i' THEN 'change_cipher_spec' WHEN 'f' THEN 'finished' END AS kind
    FROM x_ssl),
  mn AS (SELECT *, row_number() OVER (PARTITION BY uid, kind ORDER BY position) AS n FROM m),
  f AS (SELECT uid, frame_number, tie, generate_subscripts(string_split(handshake_types, ','), 1) AS slot, selected_group,
      CASE unnest(string_split(handshake_types, ',')) WHEN '1' THEN 'client_hello'
        WHEN '2' THEN CASE WHEN selected_group IS NOT NULL THEN 'hello_retry_request' ELSE 'server_hello' END
        WHEN '11' THEN 'certificate' WHEN '12' THEN 'server_key_exchange' WHEN '14' THEN 'server_hello_done'
        WHEN '15' THEN 'certificate_verify' WHEN '16' THEN 'client_key_exchange' WHEN '20' THEN 'finished' END AS kind
      FROM x_hs_frames),
  fn AS (SELECT *, row_number() OVER (PARTITION BY uid, CASE WHEN kind = 'hello_retry_request' THEN 'server_hello' ELSE kind END
           ORDER BY frame_number, tie, slot) AS n,
         CASE WHEN kind = 'hello_retry_request' THEN 'server_hello' ELSE kind END AS queue FROM f),
  y AS (SELECT mn.uid, mn.position, coalesce(fn.kind, mn.kind) AS kind, coalesce(fn.frame_number, -1) AS frame_number,
        CASE WHEN fn.frame_number IS NULL THEN 'inferred' ELSE 'observed' END AS evidence_state
        FROM mn LEFT JOIN fn ON mn.uid = fn.uid AND mn.kind = fn.queue AND mn.n = fn.n)
"""


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    ssl = view(spark, sf_dir, "x_ssl").select("uid", "ssl_history")
    # Dealt before the histories become some seven rows each.
    messages = ops.message_rows(ssl.repartition("uid"), ["uid"])
    long = large_keys(ssl, ["uid"], weight=F.length("ssl_history"))
    return ops.attach_frames(messages, view(spark, sf_dir, "x_hs_frames"), ["tie"], long)


@query("j07_nth_frame_attach", _ATTACH + "SELECT * FROM y")
def nth_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir).select(
        "uid", "position", "kind", F.coalesce("frame_number", F.lit(-1)).alias("frame_number"), "evidence_state"
    )


@query(
    "a32_certificate_frames",
    _ATTACH + "SELECT DISTINCT uid, frame_number FROM y WHERE kind = 'certificate' AND frame_number >= 0",
)
def cert_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.certificate_frames(attached(spark, sf_dir)).select("uid", "frame_number")


@query(
    "f42_handshake_timeline",
    """SELECT uid, generate_subscripts(string_split(ssl_history, ''), 1) - 1 AS position,
       16 + (generate_subscripts(string_split(ssl_history, ''), 1) - 1) * 92 AS x,
       greatest(160, 28 + length(ssl_history) * 92) AS width FROM x_ssl""",
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.timeline(view(spark, sf_dir, "x_ssl"), ["uid"])
    return out.select("uid", "position", "x", "width")


@query(
    "a11_tls_versions",
    """SELECT coalesce(version, 'not_observable') AS version, count(*) AS handshakes FROM y_handshakes GROUP BY 1""",
)
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce("version", F.lit("not_observable")).alias("version")
    return built_handshakes(spark, sf_dir).groupBy(label).agg(F.count(F.lit(1)).alias("handshakes"))


@query(
    "w10_first_and_last_rows",
    """SELECT uid, min(struct_pack(f := frame_number, t := tie, h := handshake_types)).h AS first_types,
       max(struct_pack(f := frame_number, t := tie, h := handshake_types)).h AS last_types
       FROM x_hs_frames GROUP BY uid""",
)
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view(spark, sf_dir, "x_hs_frames")
    order, keep = ["frame_number", "tie"], ["handshake_types"]
    first = ops.first_per_uid(frames, order, keep).withColumnRenamed("handshake_types", "first_types")
    last = ops.last_per_uid(frames, order, keep).withColumnRenamed("handshake_types", "last_types")
    return first.join(last, "uid")
