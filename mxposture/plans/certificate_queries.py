"""Certificate queries over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mxposture.functions import identity, tls
from mxposture.operators import certificates as ops
from mxposture.plans.adapters import VIEWS, view
from mxposture.plans.registry import query
from mxposture.session import settled

# Extracted certificates: digests are padded numbers, so both engines write them alike.
VIEWS["x_extracted"] = """
SELECT p_partkey AS cert_no, lpad(CAST(p_partkey AS STRING), 64, CASE WHEN p_partkey % 11 = 0 THEN 'e' ELSE '0' END) AS sha256,
       lpad(CAST(p_partkey AS STRING), 40, CASE WHEN p_partkey % 11 = 0 THEN 'e' ELSE '0' END) AS sha1,
       concat(CASE WHEN p_partkey % 11 = 0 THEN 'E' ELSE 'F' END, CAST(p_partkey AS STRING)) AS fuid
FROM part
"""

VIEWS["x_fingerprints"] = """
SELECT CAST(l_orderkey AS STRING) AS uid, CASE WHEN l_suppkey % 5 = 0 THEN 'client' ELSE 'server' END AS role,
       l_linenumber - 1 AS chain_index, l_partkey AS part,
       CASE l_partkey % 4 WHEN 0 THEN lpad(CAST(l_partkey AS STRING), 64, '0') WHEN 1 THEN lpad(CAST(l_partkey AS STRING), 40, '0')
            WHEN 2 THEN concat(' 00:', lpad(CAST(l_partkey AS STRING), 62, '0')) ELSE 'abcd' END AS fingerprint
FROM lineitem
"""

VIEWS["x_cert_files"] = """
SELECT CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_orderkey AS STRING) END AS uid, CAST(l_orderkey AS STRING) AS conn_uid,
       l_linenumber AS ord, l_partkey AS part,
       CASE WHEN l_suppkey % 3 = 0 THEN lpad(CAST(l_partkey AS STRING), 64, '0') END AS sha256,
       CASE WHEN l_suppkey % 3 = 1 THEN lpad(CAST(l_partkey AS STRING), 40, '0') END AS sha1,
       concat('F', CAST(l_partkey AS STRING)) AS fuid, l_suppkey % 10 = 0 AS truncated,
       CASE l_suppkey % 6 WHEN 0 THEN 'application/pkix-cert' WHEN 1 THEN '' WHEN 2 THEN 'text/html'
            WHEN 3 THEN 'application/x-x509-ca-cert' WHEN 4 THEN 'application/octet-stream' END AS mime_type,
       CASE WHEN l_partkey % 7 = 0 THEN 'HTTP' ELSE 'SSL' END AS source
FROM lineitem
"""

VIEWS["x_cert_dated"] = """
SELECT cert_no, uid, chain_index, role, public_key_algorithm, public_key_size, signature_algorithm, subject, issuer, san,
       lpad(CAST(cert_no AS STRING), 64, '0') AS der_sha256,
       cert_no % 13 = 0 AS truncated, cert_no % 17 <> 0 AS syntax_valid,
       TIMESTAMP '2020-01-01 00:00:00' AS not_before,
       CASE WHEN cert_no % 9 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' WHEN cert_no % 9 = 1 THEN TIMESTAMP '2024-07-10 00:00:00'
            ELSE TIMESTAMP '2026-01-01 00:00:00' END AS not_after,
       TIMESTAMP '2024-02-01 00:00:00' AS capture_time
FROM x_cert
"""

VIEWS["x_anchors"] = "SELECT subject FROM x_cert WHERE cert_no % 7 = 3"
ANALYSIS_TIME = "2024-07-01 00:00:00"


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "x_cert_dated")
    places = rows.select("cert_no", "uid", "role", "chain_index", "der_sha256", "truncated", "capture_time", "san")
    facts = rows.select(
        "der_sha256",
        "syntax_valid",
        "subject",
        "issuer",
        "not_before",
        "not_after",
        "public_key_algorithm",
        "public_key_size",
        "signature_algorithm",
    )
    return ops.assemble(places, facts, F.lit(ANALYSIS_TIME).cast("timestamp"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates with path and identity outcomes, shared by rule and report queries."""
    certs = settled(certificates(spark, sf_dir))
    anchors = view(spark, sf_dir, "x_anchors")
    capture = ops.validate_paths(certs, anchors, F.col("capture_time"))
    analysis = ops.validate_paths(certs, anchors, F.lit(ANALYSIS_TIME).cast("timestamp"))
    sans = certs.where((F.col("chain_index") == 0) & F.col("syntax_valid")).select(
        "uid", F.lit("dns").alias("kind"), F.col("san").alias("value")
    )
    hosts = view(spark, sf_dir, "x_host").groupBy("uid").agg(F.min("host").alias("reference"))
    names = ops.match_identity(hosts, sans, ascii_only=True)
    return ops.attach_validation(certs, capture, analysis, names)


@query(
    "p15_certificate_files",
    """SELECT fuid, ord, conn_uid FROM x_cert_files WHERE source = 'SSL' AND coalesce(mime_type, '') <> 'text/html'""",
)
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.certificate_files(view(spark, sf_dir, "x_cert_files")).select("fuid", "ord", "conn_uid")


@query(
    "j08_fingerprint_join",
    """SELECT DISTINCT uid, role, chain_index, sha256 AS der_sha256 FROM x_fingerprints JOIN x_extracted ON part = cert_no
       WHERE part % 4 <> 3 AND part % 11 <> 0""",
)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "x_fingerprints").drop("part")
    return ops.match_fingerprints(rows, view(spark, sf_dir, "x_extracted"))


@query(
    "j09_file_fallback",
    """SELECT uid, CAST(row_number() OVER (PARTITION BY uid ORDER BY ord, der_sha256) - 1 AS INTEGER) AS chain_index, der_sha256, truncated
       FROM (SELECT conn_uid AS uid, sha256_of AS der_sha256, min(ord) AS ord, bool_or(truncated) AS truncated
             FROM x_cert_files f JOIN (SELECT cert_no, sha256 AS sha256_of FROM x_extracted WHERE cert_no % 11 <> 0) e ON f.part = e.cert_no
             WHERE conn_uid IN (SELECT uid FROM x_ssl WHERE contains(ssl_history, 'x')) GROUP BY 1, 2)""",
)
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "x_cert_files").withColumn("conn_uids", F.array("conn_uid"))
    ssl = view(spark, sf_dir, "x_ssl").where(F.col("ssl_history").contains("x"))
    out = ops.match_files(ssl, files, view(spark, sf_dir, "x_extracted"))
    return out.select("uid", "chain_index", "der_sha256", "truncated")


@query(
    "j10_leaf_chains",
    """SELECT l.cert_no, s.chain_length, s.intermediates, s.last_index FROM x_cert l JOIN
       (SELECT uid, role, count(*) AS chain_length, count(*) FILTER (chain_index > 0) AS intermediates,
        max(chain_index) AS last_index FROM x_cert GROUP BY uid, role) s USING (uid, role) WHERE l.chain_index = 0""",
)
def leaf_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.leaf_chains(view(spark, sf_dir, "x_cert")).select(
        "cert_no", "chain_length", "intermediates", "last_index"
    )


@query(
    "a29_ordered_chains",
    """SELECT cert_no, row_number() OVER (PARTITION BY uid, role ORDER BY chain_index, der_sha256) AS position FROM x_cert_dated""",
)
def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chain_positions(view(spark, sf_dir, "x_cert_dated")).select("cert_no", "position")


@query(
    "u04_distinct_places",
    "SELECT DISTINCT uid, role, chain_index, lpad(CAST(part % 50 AS VARCHAR), 64, '0') AS der_sha256 FROM x_fingerprints",
)
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "x_fingerprints").select(
        "uid",
        "role",
        "chain_index",
        F.lpad((F.col("part") % 50).cast("string"), 64, "0").alias("der_sha256"),
    )
    return ops.distinct_places(rows)


@query(
    "f21_key_strength",
    """SELECT cert_no, CASE public_key_algorithm WHEN 'Ed25519' THEN 128
         WHEN 'RSA' THEN CASE WHEN public_key_size >= 4096 THEN 152 WHEN public_key_size >= 2048 THEN 112 ELSE 80 END
         ELSE CASE WHEN public_key_size >= 384 THEN 192 ELSE 128 END END AS bits,
       CASE cert_no % 3 WHEN 0 THEN 192 WHEN 1 THEN 128 ELSE 0 END AS curve_bits FROM x_cert""",
)
def strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("cert_no") % 3
    curve = F.when(number == 0, "P-384").when(number == 1, "prime256v1")
    return view(spark, sf_dir, "x_cert").select(
        "cert_no",
        tls.strength_bits(F.col("public_key_algorithm"), F.col("public_key_size"), F.lit(None)).alias("bits"),
        F.coalesce(tls.strength_bits(F.lit("EC"), F.lit(100), curve), F.lit(0)).alias("curve_bits"),
    )


_CERTS = f"""
SELECT *, syntax_valid AND NOT truncated AS good,
  CASE WHEN good THEN not_after >= TIMESTAMP '{ANALYSIS_TIME}' END AS now_ok,
  CASE WHEN good THEN not_after >= capture_time END AS then_ok FROM x_cert_dated
"""


@query(
    "f22_validity_windows",
    f"""SELECT cert_no, coalesce(CAST(then_ok AS VARCHAR), '') AS at_capture, coalesce(CAST(now_ok AS VARCHAR), '') AS at_analysis,
        coalesce(CAST(CASE WHEN good THEN now_ok AND not_after <= TIMESTAMP '2024-07-31 00:00:00' END AS VARCHAR), '') AS expiring
        FROM ({_CERTS})""",
)
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = certificates(spark, sf_dir)

    def text(name: str, alias: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)

    return out.select(
        "cert_no",
        text("valid_at_capture_time", "at_capture"),
        text("valid_at_analysis_time", "at_analysis"),
        text("expires_within_warning_window", "expiring"),
    )


@query(
    "f23_certificate_records",
    f"""SELECT cert_no, good AS syntax_valid, CASE WHEN good THEN '' WHEN syntax_valid THEN 'certificate_extract_truncated' ELSE '' END AS syntax_error,
        CASE WHEN NOT good AND truncated THEN 'incomplete' ELSE 'observed' END AS evidence_state,
        CASE WHEN good THEN subject ELSE '' END AS subject FROM ({_CERTS})""",
)
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certificates(spark, sf_dir).select(
        "cert_no",
        "syntax_valid",
        F.coalesce("syntax_error", F.lit("")).alias("syntax_error"),
        "evidence_state",
        F.coalesce("subject", F.lit("")).alias("subject"),
    )


_IDENTITY = """
SELECT h.page_id, h.uid, h.host, EXISTS (SELECT 1 FROM x_cert c WHERE c.uid = h.uid AND c.chain_index = 0) AS has_san,
  EXISTS (SELECT 1 FROM x_cert c WHERE c.uid = h.uid AND c.chain_index = 0 AND (c.san = h.host
     OR (starts_with(c.san, '*.') AND substr(c.san, 3) = regexp_replace(h.host, '^[^.]*\\.', '') AND contains(h.host, '.')))) AS hit
FROM x_host h
"""


@query(
    "j24_identity_match",
    f"""SELECT page_id, hit AS identity_match, CASE WHEN hit THEN '' WHEN has_san THEN 'san_mismatch' ELSE 'san_missing' END AS identity_reason
        FROM ({_IDENTITY})""",
)
def san_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    sans = view(spark, sf_dir, "x_cert").where("chain_index = 0").select(
        "uid", F.lit("dns").alias("kind"), F.col("san").alias("value")
    )
    refs = view(spark, sf_dir, "x_host").withColumnRenamed("host", "reference")
    out = ops.match_identity(refs, sans, ascii_only=True)
    return out.select(
        "page_id", "identity_match", F.coalesce("identity_reason", F.lit("")).alias("identity_reason")
    )


_PATHS = f"""
WITH c AS (SELECT cert_no, uid, chain_index, subject, issuer, good, then_ok FROM ({_CERTS}) WHERE good),
 a AS (SELECT DISTINCT subject FROM x_anchors),
 n AS (SELECT uid, count(*) FILTER (chain_index > 0) AS inter FROM ({_CERTS}) GROUP BY uid),
 p AS (SELECT l.cert_no, l.then_ok, coalesce(n.inter, 0) AS inter,
   a0.subject IS NOT NULL AS r0, a1.subject IS NOT NULL AS r1, a2.subject IS NOT NULL AS r2, a3.subject IS NOT NULL AS r3,
   coalesce(i1.then_ok, false) AS v1, coalesce(i2.then_ok, false) AS v2, coalesce(i3.then_ok, false) AS v3
  FROM c l LEFT JOIN n ON n.uid = l.uid LEFT JOIN a a0 ON a0.subject = l.issuer
  LEFT JOIN c i1 ON i1.uid = l.uid AND i1.chain_index > 0 AND i1.subject = l.issuer LEFT JOIN a a1 ON a1.subject = i1.issuer
  LEFT JOIN c i2 ON i2.uid = l.uid AND i2.chain_index > 0 AND i2.subject = i1.issuer LEFT JOIN a a2 ON a2.subject = i2.issuer
  LEFT JOIN c i3 ON i3.uid = l.uid AND i3.chain_index > 0 AND i3.subject = i2.issuer LEFT JOIN a a3 ON a3.subject = i3.issuer
  WHERE l.chain_index = 0)
SELECT cert_no, valid AS path_valid, CASE WHEN valid THEN '' WHEN inter + 1 > 16 THEN 'max_chain_depth_exceeded'
   WHEN NOT then_ok THEN 'expired_at_verification_time' WHEN named THEN 'expired_at_verification_time'
   WHEN inter = 0 THEN 'missing_intermediate' ELSE 'untrusted_issuer' END AS path_reason
FROM (SELECT *, r0 OR r1 OR r2 OR r3 AS named,
   then_ok AND inter + 1 <= 16 AND (r0 OR (v1 AND r1) OR (v1 AND v2 AND r2) OR (v1 AND v2 AND v3 AND r3)) AS valid FROM p)
"""


@query("j25_chain_walk", _PATHS)
def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    certs = settled(certificates(spark, sf_dir))
    out = ops.validate_paths(certs, view(spark, sf_dir, "x_anchors"), F.col("capture_time"))
    readable = certs.where("syntax_valid").select("uid", "role", "der_sha256", "cert_no")
    return out.join(readable, ["uid", "role", "der_sha256"]).select(
        "cert_no", "path_valid", F.coalesce("path_reason", F.lit("")).alias("path_reason")
    )


@query(
    "f24_leaf_validation",
    f"""WITH paths AS ({_PATHS.strip()}), ref AS (SELECT uid, min(host) AS host FROM x_host GROUP BY uid),
       hit AS (SELECT r.uid, bool_or(c.san = r.host OR (starts_with(c.san, '*.') AND contains(r.host, '.')
                 AND substr(c.san, 3) = regexp_replace(r.host, '^[^.]*\\.', ''))) AS hit
               FROM ref r LEFT JOIN x_cert_dated c ON c.uid = r.uid AND c.chain_index = 0 AND c.syntax_valid AND NOT c.truncated
               GROUP BY r.uid)
       SELECT c.cert_no, CASE WHEN p.path_valid THEN 'true' WHEN p.path_valid IS NULL THEN '' ELSE 'false' END AS path_then,
         CASE WHEN NOT good OR h.uid IS NULL THEN '' WHEN coalesce(h.hit, false) THEN 'true' ELSE 'false' END AS named,
         concat_ws(',', CASE WHEN NOT good THEN 'syntax_invalid_leaf' END,
                   CASE WHEN h.uid IS NULL THEN 'reference_identity_unavailable' END) AS reasons
       FROM ({_CERTS}) c LEFT JOIN paths p ON c.cert_no = p.cert_no LEFT JOIN hit h ON c.uid = h.uid WHERE c.chain_index = 0""",
)
def leaf_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validated(spark, sf_dir).where("chain_index = 0")

    def text(name: str, alias: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)

    return out.select(
        "cert_no",
        text("path_valid_at_capture_time", "path_then"),
        text("identity_match", "named"),
        F.array_join("indeterminate_reasons", ",").alias("reasons"),
    )


@query(
    "f25_dns_names",
    """SELECT page_id, host AS plain, CASE WHEN page_id % 5 = 0 THEN '' ELSE host END AS shaped,
       regexp_replace(host, '^[^.]*\\.', '') AS tail FROM x_host""",
)
def dns_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.col("host")
    noisy = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("a..b."), host)).otherwise(
        F.concat(F.lit(" "), F.upper(host), F.lit("."))
    )
    return view(spark, sf_dir, "x_host").select(
        "page_id",
        identity.dns_name(host, ascii_only=True).alias("plain"),
        F.coalesce(identity.dns_name(noisy), F.lit("")).alias("shaped"),
        identity.wildcard_tail(host).alias("tail"),
    )


@query(
    "f26_ip_literals",
    """SELECT uid, orig_h AS v4, '2001:db8::' || lower(hex(CAST(CAST(uid AS BIGINT) % 60000 + 1 AS BIGINT))) AS v6, '' AS none FROM x_conn""",
)
def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(F.hex(F.col("uid").cast("bigint") % 60000 + 1))
    long_form = F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), low)
    return view(spark, sf_dir, "x_conn").select(
        "uid",
        identity.ip_literal(F.concat(F.lit(" "), F.col("orig_h"))).alias("v4"),
        identity.ip_literal(long_form).alias("v6"),
        F.coalesce(identity.ip_literal(F.concat(F.col("orig_h"), F.lit(".9"))), F.lit("")).alias("none"),
    )
