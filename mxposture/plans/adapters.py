"""Views that give the benchmark tables the shape of analyzer logs and evidence tables.

The text of each view is portable SQL; Spark and the checking database run the same words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}
VIEWS["x_conn"] = """
SELECT CAST(o_orderkey AS STRING) AS uid,
       o_custkey % 11 AS capture_no,
       concat('192.0.2.', CAST(o_custkey % 200 AS STRING)) AS orig_h,
       40000 + o_orderkey % 20000 AS orig_p,
       concat('198.51.100.', CAST(o_custkey % 50 AS STRING)) AS resp_h,
       CASE o_orderkey % 8 WHEN 0 THEN 25 WHEN 1 THEN 587 WHEN 2 THEN 465 WHEN 3 THEN 143
            WHEN 4 THEN 993 WHEN 5 THEN 110 WHEN 6 THEN 995 ELSE 2525 END AS resp_p,
       CASE WHEN o_orderkey % 23 = 0 THEN 'udp' ELSE 'tcp' END AS proto,
       CASE o_orderkey % 7 WHEN 0 THEN 'ShADadFf' WHEN 1 THEN 'ShADad' WHEN 2 THEN 'ADadFf' WHEN 3 THEN 'ShADadR'
            WHEN 4 THEN 'S' WHEN 5 THEN 'Sr' ELSE 'ShADadFf' END AS history,
       CASE WHEN o_orderkey % 29 = 0 THEN 120 ELSE 0 END AS missed_bytes,
       CAST(floor(o_totalprice) AS BIGINT) AS orig_bytes,
       CAST(floor(o_totalprice / 3) AS BIGINT) AS resp_bytes
FROM orders
"""

VIEWS["x_recon"] = """
SELECT CAST(l_orderkey AS STRING) AS uid, l_linenumber AS line, l_suppkey % 2 = 0 AS is_orig,
       CASE (l_partkey + l_linenumber) % 24 WHEN 0 THEN 'seq_gap' WHEN 1 THEN 'out_of_order' WHEN 2 THEN 'duplicate'
            WHEN 3 THEN 'overlap' WHEN 4 THEN 'rexmit' WHEN 5 THEN 'rexmit_inconsistency' ELSE 'none' END AS event_type,
       l_partkey AS seq, CAST(floor(l_quantity) AS BIGINT) AS len
FROM lineitem
"""

VIEWS["x_session_events"] = """
SELECT CAST(conv_id AS STRING) AS uid, turn AS ord, turn % 2 = 1 AS is_orig,
       CASE conv_id % 3 WHEN 0 THEN 'smtp' WHEN 1 THEN 'imap' ELSE 'pop3' END AS protocol,
       CASE WHEN turn = 0 THEN 'capability' WHEN turn % 2 = 1 THEN 'request' ELSE 'reply' END AS kind,
       CASE WHEN turn = 1 AND floor(conv_id / 3) % 5 <> 4 THEN CASE conv_id % 3 WHEN 2 THEN 'STLS' ELSE 'STARTTLS' END
            WHEN turn % 2 = 1 THEN CASE conv_id % 3 WHEN 0 THEN 'AUTH' WHEN 1 THEN 'LOGIN' ELSE 'PASS' END END AS command,
       CASE WHEN turn > 0 AND turn % 2 = 0 AND conv_id % 3 = 0
            THEN CASE WHEN floor(conv_id / 3) % 5 = 2 THEN 454 ELSE 220 END END AS reply_code,
       CASE WHEN turn = 0 AND floor(conv_id / 3) % 5 <> 1 THEN 'CAPS STARTTLS STLS'
            WHEN turn = 0 THEN 'CAPS'
            WHEN turn % 2 = 0 AND conv_id % 3 = 1 THEN CASE WHEN floor(conv_id / 3) % 5 = 2 THEN 'NO' ELSE 'OK' END
            WHEN turn % 2 = 0 AND conv_id % 3 = 2 THEN CASE WHEN floor(conv_id / 3) % 5 = 2 THEN '-ERR' ELSE '+OK' END END AS text,
       floor(conv_id / 3) % 5 = 0 AS client_hello
FROM conversations
"""

VIEWS["x_ssl"] = """
SELECT CAST(o_orderkey AS STRING) AS uid,
       CASE o_orderkey % 5 WHEN 0 THEN 769 WHEN 1 THEN 770 ELSE 771 END AS server_version,
       CASE WHEN o_orderkey % 5 >= 3 THEN 772 END AS server_supported_version,
       CASE WHEN o_orderkey % 17 = 0 THEN 'C' WHEN o_orderkey % 5 >= 3 THEN 'Csi' ELSE 'CsxknGIif' END AS ssl_history,
       o_orderkey % 13 <> 0 AS established, o_orderkey % 10 = 0 AS resumed,
       CASE WHEN o_orderkey % 5 >= 3 THEN CASE o_orderkey % 2 WHEN 0 THEN 'TLS_AES_256_GCM_SHA384' ELSE 'TLS_CHACHA20_POLY1305_SHA256' END
            ELSE CASE o_custkey % 6 WHEN 0 THEN 'TLS_RSA_WITH_AES_128_CBC_SHA' WHEN 1 THEN 'TLS_DHE_RSA_WITH_AES_128_GCM_SHA256'
                 WHEN 2 THEN 'TLS_RSA_WITH_RC4_128_SHA' WHEN 3 THEN 'TLS_ECDH_RSA_WITH_AES_128_GCM_SHA256'
                 WHEN 4 THEN 'TLS_RSA_WITH_3DES_EDE_CBC_SHA' ELSE 'TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256' END END AS cipher,
       CASE WHEN o_orderkey % 5 >= 3 THEN CASE o_custkey % 4 WHEN 0 THEN 29 WHEN 1 THEN 4588 WHEN 2 THEN 256 END END AS server_key_share_group,
       CASE WHEN o_custkey % 6 = 1 THEN CASE o_orderkey % 2 WHEN 0 THEN 1024 ELSE 2048 END END AS dh_param_size,
       CASE WHEN o_orderkey % 19 = 0 THEN 'handshake_failure' END AS last_alert
FROM orders
"""

VIEWS["x_findings"] = """
SELECT concat('f', lpad(CAST(o_orderkey AS STRING), 12, '0')) AS finding_id,
       concat('RULE_', CAST(o_orderkey % 9 AS STRING)) AS code,
       concat('198.51.100.', CAST(o_custkey % 50 AS STRING)) AS affected_endpoint,
       CASE o_custkey % 2 WHEN 0 THEN 'profile_a' ELSE 'profile_b' END AS policy_profile,
       CASE o_orderstatus WHEN 'P' THEN 'indeterminate' ELSE 'negative' END AS outcome,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' WHEN o_orderpriority = '2-HIGH' THEN 'medium'
            WHEN o_orderpriority = '5-LOW' THEN 'informational' ELSE 'low' END AS severity,
       CASE o_custkey % 7 WHEN 0 THEN 'conflicting' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'indeterminate' WHEN 3 THEN 'not_observable'
            WHEN 4 THEN 'inferred' WHEN 5 THEN 'observed' ELSE 'verified' END AS basis_state,
       CASE o_orderkey % 3 WHEN 0 THEN 'session' WHEN 1 THEN 'handshake' ELSE 'flow' END AS record_type,
       CAST(o_custkey AS STRING) AS record_key,
       o_orderdate AS evaluated_at
FROM orders
"""

VIEWS["x_checks"] = """
SELECT concat('RULE_', CAST(l_partkey % 9 AS STRING)) AS code,
       CASE l_suppkey % 4 WHEN 0 THEN 'smtp' WHEN 1 THEN 'imap' WHEN 2 THEN 'pop3' ELSE 'unclassified' END AS protocol,
       CASE l_partkey % 4 WHEN 0 THEN 'transport' WHEN 1 THEN 'mail_protocol' WHEN 2 THEN 'tls_handshake' ELSE 'certificate' END AS category,
       concat('198.51.100.', CAST(l_suppkey % 50 AS STRING)) AS affected_endpoint,
       CAST(l_orderkey AS STRING) AS record_key, l_linenumber AS line,
       CASE WHEN l_returnflag = 'R' THEN 'fail' WHEN l_returnflag = 'A' THEN 'pass'
            WHEN l_linenumber % 2 = 0 THEN 'unknown' ELSE 'not_observable' END AS outcome
FROM lineitem
"""

VIEWS["x_assets"] = """
SELECT concat(CASE WHEN s_suppkey % 10 = 4 THEN '203.0.113.' ELSE '198.51.100.' END, CAST(s_suppkey AS STRING)) AS endpoint,
       CASE s_nationkey % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'partner' WHEN 2 THEN 'internal' WHEN 3 THEN 'isolated' ELSE 'unknown' END AS exposure,
       CASE WHEN s_acctbal > 7000 THEN 'critical' WHEN s_acctbal > 4000 THEN 'high' WHEN s_acctbal > 1000 THEN 'medium' ELSE 'low' END AS asset_criticality,
       CASE s_nationkey % 3 WHEN 0 THEN 'organization' WHEN 1 THEN 'multi_asset' ELSE 'single_endpoint' END AS blast_radius
FROM supplier
"""

VIEWS["x_daily"] = """
SELECT CAST(user_id AS STRING) AS endpoint_id, concat('site_', CAST(user_id % 3 AS STRING)) AS site_id,
       CASE user_id % 4 WHEN 0 THEN 'smtp_mx' WHEN 1 THEN 'smtp_submission' WHEN 2 THEN 'imap_access' ELSE 'pop3_access' END AS protocol_role,
       CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS BIGINT) AS day_index, count(*) AS session_count,
       avg(CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END) AS handshake_failure_rate,
       avg(CASE WHEN event_type = 'signup' THEN 1.0E0 ELSE 0.0E0 END) AS alert_rate,
       avg(CASE WHEN event_type = 'view' THEN 1.0E0 ELSE 0.0E0 END) AS tls13_share,
       avg(CASE WHEN event_type = 'click' THEN 1.0E0 ELSE 0.0E0 END) AS tls12_share,
       avg(CASE WHEN event_type = 'purchase' THEN 1.0E0 ELSE 0.0E0 END) AS starttls_fallback_rate,
       min(event_type) AS issuer_id, max(event_type) AS dominant_tls_version,
       user_id % 25 = 3 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-18' AND DATE '2024-01-20' AS in_maintenance
FROM events GROUP BY user_id, CAST(ts AS DATE)
"""

VIEWS["x_labels"] = """
SELECT DISTINCT concat('ep_', CAST(user_id AS STRING)) AS event_id, CAST(user_id AS STRING) AS endpoint_id,
       CASE user_id % 20 WHEN 0 THEN 'univariate' ELSE 'multivariate' END AS kind,
       16 + user_id % 8 AS start_day, 19 + user_id % 8 AS end_day
FROM events WHERE user_id % 10 = 0
"""

VIEWS["x_cert"] = """
SELECT p_partkey AS cert_no, CAST(p_partkey % 500 AS STRING) AS uid, CAST(floor(p_partkey / 500) AS BIGINT) % 4 AS chain_index, 'server' AS role,
       CASE p_size % 3 WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECDSA' ELSE 'Ed25519' END AS public_key_algorithm,
       CASE p_size % 3 WHEN 0 THEN CASE p_partkey % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1536 WHEN 2 THEN 2048 ELSE 4096 END
            WHEN 1 THEN CASE p_partkey % 2 WHEN 0 THEN 256 ELSE 384 END ELSE 256 END AS public_key_size,
       CASE p_partkey % 5 WHEN 0 THEN 'sha1WithRSAEncryption' ELSE 'sha256WithRSAEncryption' END AS signature_algorithm,
       concat('subject_', CAST(p_partkey AS STRING)) AS subject, concat('subject_', CAST(p_partkey + 500 AS STRING)) AS issuer,
       CASE p_partkey % 3 WHEN 0 THEN '*.example.com' WHEN 1 THEN '*.example.net' ELSE 'ththth.example.org' END AS san
FROM part
"""

VIEWS["x_host"] = """
SELECT page_id, CAST(page_id % 500 AS STRING) AS uid, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host FROM pages
"""


def _refs(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Adapter view ``name`` over the tables in ``sf_dir``."""
    sql = VIEWS[name]
    frames = {}
    for ref in _refs(sql, [*TABLES, *VIEWS]):
        frames[ref] = view(spark, sf_dir, ref) if ref in VIEWS else table(spark, sf_dir, ref)
        sql = re.sub(rf"\b(FROM|JOIN)\s+{ref}\b", rf"\1 {{{ref}}}", sql)
    return spark.sql(sql, **frames)


def with_views(body: str) -> str:
    """Checking SQL: ``body`` preceded by the views it reads, in dependency order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for ref in _refs(sql, VIEWS):
            if ref not in needed:
                visit(VIEWS[ref])
                needed.append(ref)

    visit(body)
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in needed]
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
