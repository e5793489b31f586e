"""Code tables for cipher suites and groups, and trust anchors, read as small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Registered suite names and codes used when no snapshot file is given (fixed values).
CIPHER_SUITES = {
    "TLS_RSA_WITH_NULL_MD5": "0x0001",
    "TLS_RSA_WITH_NULL_SHA": "0x0002",
    "TLS_RSA_EXPORT_WITH_RC4_40_MD5": "0x0003",
    "TLS_RSA_WITH_RC4_128_MD5": "0x0004",
    "TLS_RSA_WITH_RC4_128_SHA": "0x0005",
    "TLS_RSA_WITH_3DES_EDE_CBC_SHA": "0x000A",
    "TLS_DHE_RSA_WITH_3DES_EDE_CBC_SHA": "0x0016",
    "TLS_RSA_WITH_AES_128_CBC_SHA": "0x002F",
    "TLS_DH_RSA_WITH_AES_128_CBC_SHA": "0x0031",
    "TLS_DHE_RSA_WITH_AES_128_CBC_SHA": "0x0033",
    "TLS_RSA_WITH_AES_256_CBC_SHA": "0x0035",
    "TLS_DHE_RSA_WITH_AES_256_CBC_SHA": "0x0039",
    "TLS_RSA_WITH_AES_128_CBC_SHA256": "0x003C",
    "TLS_RSA_WITH_AES_256_CBC_SHA256": "0x003D",
    "TLS_DHE_RSA_WITH_AES_128_CBC_SHA256": "0x0067",
    "TLS_DHE_RSA_WITH_AES_256_CBC_SHA256": "0x006B",
    "TLS_RSA_WITH_AES_128_GCM_SHA256": "0x009C",
    "TLS_RSA_WITH_AES_256_GCM_SHA384": "0x009D",
    "TLS_DHE_RSA_WITH_AES_128_GCM_SHA256": "0x009E",
    "TLS_DHE_RSA_WITH_AES_256_GCM_SHA384": "0x009F",
    "TLS_DH_RSA_WITH_AES_128_GCM_SHA256": "0x00A0",
    "TLS_AES_128_GCM_SHA256": "0x1301",
    "TLS_AES_256_GCM_SHA384": "0x1302",
    "TLS_CHACHA20_POLY1305_SHA256": "0x1303",
    "TLS_AES_128_CCM_SHA256": "0x1304",
    "TLS_AES_128_CCM_8_SHA256": "0x1305",
    "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA": "0xC009",
    "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA": "0xC00A",
    "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA": "0xC013",
    "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA": "0xC014",
    "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256": "0xC023",
    "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA384": "0xC024",
    "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256": "0xC027",
    "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA384": "0xC028",
    "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256": "0xC02B",
    "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384": "0xC02C",
    "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256": "0xC02F",
    "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384": "0xC030",
    "TLS_ECDH_RSA_WITH_AES_128_GCM_SHA256": "0xC031",
    "TLS_RSA_WITH_AES_128_CCM": "0xC09C",
    "TLS_RSA_WITH_AES_256_CCM": "0xC09D",
    "TLS_RSA_WITH_AES_128_CCM_8": "0xC0A0",
    "TLS_RSA_WITH_AES_256_CCM_8": "0xC0A1",
    "TLS_ECDHE_ECDSA_WITH_AES_128_CCM": "0xC0AC",
    "TLS_ECDHE_ECDSA_WITH_AES_256_CCM": "0xC0AD",
    "TLS_ECDHE_ECDSA_WITH_AES_128_CCM_8": "0xC0AE",
    "TLS_ECDHE_ECDSA_WITH_AES_256_CCM_8": "0xC0AF",
}
# Registered group codes and names (fixed values).
GROUPS = {
    23: "secp256r1",
    24: "secp384r1",
    25: "secp521r1",
    29: "x25519",
    30: "x448",
    256: "ffdhe2048",
    257: "ffdhe3072",
    258: "ffdhe4096",
    259: "ffdhe6144",
    260: "ffdhe8192",
    4587: "SecP256r1MLKEM768",
    4588: "X25519MLKEM768",
    4589: "SecP384r1MLKEM1024",
}


def read_code_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Suites and groups from a snapshot file ``{cipher_suites: [...], groups: [...]}``.

    Codes are upper-cased, the first entry of a code wins, group codes must fit 16 bits. The
    snapshot has one entry per registered code (at most 65 536 by the width of the code).
    """
    schema = (
        "cipher_suites array<struct<code string, name string>>, "
        "groups array<struct<code bigint, name string>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)

    def first_per_code(rows: DataFrame) -> DataFrame:
        return rows.groupBy("code").agg(F.min_by("name", "pos").alias("name"))

    suites = doc.select(F.posexplode("cipher_suites")).select(
        "pos",
        F.concat(F.lit("0x"), F.upper(F.substring("col.code", 3, 4))).alias("code"),
        "col.name",
    )
    groups = doc.select(F.posexplode("groups")).select("pos", "col.code", "col.name")
    suites = suites.where(F.col("code").rlike("^0x[0-9A-F]{4}$") & F.col("name").isNotNull())
    groups = groups.where(F.col("code").between(0, 65535) & F.col("name").isNotNull())
    return first_per_code(suites), first_per_code(groups)


def read_trust_anchors(spark: SparkSession, path: str, max_anchors: int | None = None) -> DataFrame:
    """Trust anchors as parsed facts (subject, validity); their number is checked if a bound is given."""
    anchors = spark.read.schema(
        "subject string, key_id string, not_before timestamp, not_after timestamp"
    ).json(path)
    if max_anchors is not None and anchors.limit(max_anchors + 1).count() > max_anchors:
        raise ValueError("trust store holds too many anchors")
    if anchors.limit(1).count() == 0:
        raise ValueError("trust store holds no anchor")
    return anchors
