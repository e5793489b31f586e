"""Certificates: linkage to connections, record assembly, identity and name-path validation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mxposture.constants import EXPIRY_WARNING_SECONDS, MAX_CHAIN_DEPTH
from mxposture.functions import identity, tls
from mxposture.operators.scale import join_few, join_named, running
from mxposture.session import checkpointed, settled

CERTIFICATE_MIME = [
    "application/pkix-cert",
    "application/x-x509-user-cert",
    "application/x-x509-ca-cert",
    "application/x-x509-ca-ra-cert",
    "",
    "application/octet-stream",
]


def certificate_files(files: DataFrame) -> DataFrame:
    """Files that came from TLS and may hold a certificate."""
    mime = F.coalesce(F.col("mime_type"), F.lit(""))
    return files.where((F.col("source") == "SSL") & mime.isin(CERTIFICATE_MIME))


def fingerprint_rows(tls_rows: DataFrame) -> DataFrame:
    """Chain fingerprints of both roles to one row per certificate place."""

    def role_rows(column: str, role: str) -> DataFrame:
        return tls_rows.select(
            "uid",
            F.lit(role).alias("role"),
            F.posexplode(column).alias("chain_index", "fingerprint"),
        )

    return role_rows("cert_chain_fps", "server").unionByName(
        role_rows("client_cert_chain_fps", "client")
    )


def digest_index(extracted: DataFrame) -> DataFrame:
    """token -> sha256 for SHA-256 (64) and SHA-1 (40) digests; one row per token."""
    tokens = F.explode(F.array(F.col("sha256"), F.col("sha1"))).alias("token")
    rows = extracted.select("sha256", tokens).where(F.length("token").isin(64, 40))
    return rows.groupBy(F.lower("token").alias("token")).agg(F.max("sha256").alias("der_sha256"))


def match_fingerprints(rows: DataFrame, extracted: DataFrame) -> DataFrame:
    """Certificate places whose fingerprint names an extracted certificate."""
    token = F.lower(F.trim(F.replace("fingerprint", F.lit(":"), F.lit(""))))
    keyed = rows.withColumn("token", token).where(F.length("token").isin(64, 40))
    # A certificate has two tokens.
    joined = join_few(keyed, digest_index(extracted), ["token"], most=2 * extracted.count())
    return distinct_places(joined.drop("token", "fingerprint"), rows.count())


PLACE = ["uid", "chain_index", "role", "der_sha256"]
PLACES_PER_TASK = 200_000


def distinct_places(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rows that differ as places of certificates. Almost all do, so a task that reads files would hold all its
    rows to drop nothing: they are dealt by place first, over as many tasks as ``most`` rows need."""
    if most is None:
        return rows.repartition(*PLACE).dropDuplicates(PLACE)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(most / PLACES_PER_TASK))
    return rows.repartition(tasks, *PLACE).dropDuplicates(PLACE)


def match_files(tls_rows: DataFrame, files: DataFrame, extracted: DataFrame) -> DataFrame:
    """Fallback for connections without fingerprints: their certificate files, in file order.

    A file belongs to its uid, or to each of its connection uids when it names none. It matches
    by SHA-256, then SHA-1, then file id; a certificate counts once per connection.
    """
    owners = F.when(F.col("uid").isNotNull(), F.array("uid")).otherwise(F.col("conn_uids"))
    owned = files.withColumn("uid", F.explode(owners))
    rows = owned.join(tls_rows.select("uid").distinct(), "uid", "left_semi")
    by_sha = digest_index(extracted)
    by_id = extracted.groupBy("fuid").agg(F.max("sha256").alias("_by_id"))

    def digest(alias: str, column: str) -> DataFrame:
        return by_sha.select(F.col("token").alias(column), F.col("der_sha256").alias(alias))

    rows = rows.withColumns({"_t64": F.lower("sha256"), "_t40": F.lower("sha1")})
    for side, key in ((digest("_by64", "_t64"), "_t64"), (digest("_by40", "_t40"), "_t40"), (by_id, "fuid")):
        rows = join_named(rows, side, key, ["uid", "ord", "fuid"])
    rows = rows.withColumn("der_sha256", F.coalesce("_by64", "_by40", "_by_id")).where(F.col("der_sha256").isNotNull())
    first = rows.groupBy("uid", "der_sha256").agg(
        F.min("ord").alias("ord"), F.max(F.coalesce("truncated", F.lit(False))).alias("truncated")
    )
    numbered = running(first, ["uid"], ["ord", "der_sha256"], {"_n": F.lit(1)}, counted=owned)
    return numbered.select(
        "uid",
        F.lit("server").alias("role"),
        (F.col("_n") - 1).cast("int").alias("chain_index"),
        "der_sha256",
        "truncated",
    )


def assemble(
    places: DataFrame,
    facts: DataFrame,
    analysis_time: Column,
    warning_seconds: int = EXPIRY_WARNING_SECONDS,
) -> DataFrame:
    """Certificate records: parsed facts, validity at both clocks, strength and state.

    ``places`` has uid, role, chain_index, der_sha256, truncated and capture_time; ``facts`` one
    row per der_sha256. A truncated or unreadable certificate keeps only its identity.
    """
    joined = places.join(facts, "der_sha256", "left")
    cut = F.coalesce(F.col("truncated"), F.lit(False))
    readable = F.coalesce(F.col("syntax_valid"), F.lit(False))
    good = readable & ~cut
    names = [
        "subject",
        "issuer",
        "serial_number",
        "not_before",
        "not_after",
        "public_key_algorithm",
        "public_key_size",
        "public_key_curve",
        "signature_algorithm",
    ]
    dated = F.col("not_before").isNotNull() & F.col("not_after").isNotNull()
    out = joined.withColumns(
        {
            "_syntax": good,
            "syntax_error": F.when(good, None)
            .when(readable & cut, "certificate_extract_truncated")
            .otherwise(F.col("syntax_error") if "syntax_error" in facts.columns else F.lit(None)),
            "evidence_state": F.when(~good & cut, "incomplete").otherwise("observed"),
        }
    )
    out = out.withColumns({n: F.when(F.col("_syntax"), F.col(n)) for n in names if n in facts.columns})
    out = out.withColumns(
        {
            "valid_at_capture_time": F.when(
                dated, tls.valid_at(F.col("capture_time"), F.col("not_before"), F.col("not_after"))
            ),
            "valid_at_analysis_time": F.when(
                dated, tls.valid_at(analysis_time, F.col("not_before"), F.col("not_after"))
            ),
            "expires_within_warning_window": F.when(
                dated, tls.expires_within(analysis_time, F.col("not_after"), warning_seconds)
            ),
            "effective_strength_bits": tls.strength_bits(
                F.col("public_key_algorithm"),
                F.col("public_key_size"),
                F.col("public_key_curve") if "public_key_curve" in out.columns else F.lit(None),
            ),
        }
    )
    return out.withColumn("syntax_valid", F.col("_syntax")).drop("_syntax")


def chain_summary(certs: DataFrame) -> DataFrame:
    """Per connection and role: certificates, intermediates, highest place. No member lists."""
    upper = F.col("chain_index") > 0
    return certs.groupBy("uid", "role").agg(
        F.count(F.lit(1)).alias("chain_length"),
        F.count_if(upper).alias("intermediates"),
        F.max("chain_index").alias("last_index"),
    )


def leaf_chains(certs: DataFrame) -> DataFrame:
    """Server leaves with the size of the chain they were sent with."""
    leaves = certs.where((F.col("chain_index") == 0) & (F.col("role") == "server"))
    return leaves.join(chain_summary(certs), ["uid", "role"])


def chain_positions(certs: DataFrame) -> DataFrame:
    """Place of every certificate in its ordered chain (by index, then digest).

    The digest prefix cuts a long chain into pieces that sort like the chain itself.
    """
    prefix = F.conv(F.substring("der_sha256", 1, 3), 16, 10).cast("bigint")
    chunk = F.col("chain_index").cast("bigint") * 4096 + prefix
    return running(
        certs, ["uid", "role"], ["chain_index", "der_sha256"], {"position": F.lit(1)}, chunk=chunk
    )


def leaf_per_uid(certs: DataFrame) -> DataFrame:
    """The server leaf with the smallest digest for each connection."""
    leaves = certs.where((F.col("chain_index") == 0) & (F.col("role") == "server"))
    cols = [c for c in certs.columns if c not in ("uid", "der_sha256")]
    first = F.min(F.struct("der_sha256", *cols))
    return leaves.groupBy("uid").agg(first.alias("_c")).select("uid", "_c.*")


# --- identity ------------------------------------------------------------------------------


def match_identity(references: DataFrame, sans: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """Reference names against the alternative names of the same connection's certificate.

    ``references``: uid, reference and any other columns; ``sans``: uid, kind ('dns' or 'ip'),
    value. Names are reduced to distinct (uid, key) rows and met by equality: the whole host, or
    the host without its first label against the tail of a wildcard. No pair is ever built.
    """
    host = identity.dns_name(F.col("reference"), ascii_only=ascii_only)
    address = identity.ip_literal(F.col("reference"), v4_only=ascii_only)
    given = F.coalesce(F.length(F.trim("reference")) > 0, F.lit(False))
    refs = references.withColumns({"_given": given, "_ip": address}).withColumn(
        "_host", F.when(F.col("_ip").isNull(), host)
    )
    refs = refs.withColumns(
        {
            "_key": F.when(F.col("_ip").isNotNull(), F.concat(F.lit("ip|"), "_ip")).otherwise(
                F.concat(F.lit("dns|"), "_host")
            ),
            "_tail": F.concat(F.lit("tail|"), identity.wildcard_tail(F.col("_host"))),
        }
    )
    pattern = identity.dns_name(F.col("value"), ascii_only=ascii_only)
    keys = sans.select(
        "uid",
        F.when(F.col("kind") == "ip", F.concat(F.lit("ip|"), F.trim("value")))
        .when(pattern.contains("*"), F.concat(F.lit("tail|"), identity.pattern_tail(pattern)))
        .otherwise(F.concat(F.lit("dns|"), pattern))
        .alias("key"),
    )
    usable = sans.where((F.col("kind") == "ip") | pattern.isNotNull()).select("uid").distinct()
    keys = keys.where(F.col("key").isNotNull()).distinct()
    exact = keys.select("uid", F.col("key").alias("_key"), F.lit(True).alias("_hit"))
    wild = keys.select("uid", F.col("key").alias("_tail"), F.lit(True).alias("_wild"))
    out = (
        refs.join(usable.withColumn("_has", F.lit(True)), "uid", "left")
        .join(exact, ["uid", "_key"], "left")
        .join(wild, ["uid", "_tail"], "left")
    )
    hit = F.col("_hit").isNotNull() | F.col("_wild").isNotNull()
    return out.withColumns(
        {
            "identity_match": F.when(F.col("_given"), hit),
            "identity_reason": F.when(~F.col("_given"), "reference_identity_unavailable")
            .when(hit, F.lit(None))
            .when(F.col("_has").isNull(), "san_missing")
            .otherwise("san_mismatch"),
        }
    ).drop("_given", "_ip", "_host", "_key", "_tail", "_has", "_hit", "_wild")


# --- name-path validation ---------------------------------------------------------------------


def _reached(certs: DataFrame, anchors: DataFrame, rounds: int) -> DataFrame:
    """Subjects of each connection that lead to an anchor through its own intermediates.

    Breadth-first from the anchors: one semi join per hop, never a list of paths. A subject is
    kept once, so cross-signed certificates do not multiply. What a hop reads is worked out before the first, and
    the hops are shuffled: the planner takes their sides for smaller than they are and would send them around.
    """
    cols = ["uid", "role", "subject", "issuer"]
    open_ = settled(certs.where(F.col("chain_index") > 0).select(*cols).distinct())
    trusted = anchors.select(F.col("subject").alias("issuer")).distinct()
    frontier = open_.join(trusted.hint("merge"), "issuer", "left_semi").select("uid", "role", "subject").distinct()
    frontier = checkpointed(frontier)
    found = frontier
    for _ in range(rounds - 1):
        if frontier.isEmpty():
            break
        step = frontier.withColumnRenamed("subject", "issuer")
        grown = open_.join(step.hint("merge"), ["uid", "role", "issuer"], "left_semi")
        frontier = grown.select("uid", "role", "subject").distinct()
        frontier = frontier.join(found.hint("merge"), ["uid", "role", "subject"], "left_anti")
        frontier = checkpointed(frontier)
        found = found.unionByName(frontier)
    return found


def validate_paths(
    certs: DataFrame, anchors: DataFrame, instant: Column, rounds: int = MAX_CHAIN_DEPTH
) -> DataFrame:
    """Name path of every server leaf to an anchor, all valid at ``instant``, with a reason.

    Signatures are not checked; names, depth and validity are.
    """
    scoped = certs.select(
        "uid",
        "role",
        "chain_index",
        "der_sha256",
        "subject",
        "issuer",
        "not_before",
        "not_after",
        instant.alias("_at"),
    )
    ok = tls.valid_at(F.col("_at"), F.col("not_before"), F.col("not_after"))
    live = scoped.where(ok)
    good = _reached(live, anchors, rounds)
    named = _reached(scoped, anchors, rounds)
    roots = anchors.select("subject").distinct()
    leaves = scoped.where((F.col("chain_index") == 0) & (F.col("role") == "server"))

    def hit(alias: str) -> Column:
        return F.lit(True).alias(alias)

    joined = (
        leaves.join(
            good.select("uid", "role", F.col("subject").alias("issuer"), hit("_good")),
            ["uid", "role", "issuer"],
            "left",
        )
        .join(
            named.select("uid", "role", F.col("subject").alias("issuer"), hit("_named")),
            ["uid", "role", "issuer"],
            "left",
        )
        .join(roots.select(F.col("subject").alias("issuer"), hit("_root")), "issuer", "left")
        .join(roots.select("subject", hit("_self")), "subject", "left")
        .join(chain_summary(scoped).select("uid", "role", "intermediates"), ["uid", "role"], "left")
    )
    leaf_ok = tls.valid_at(F.col("_at"), F.col("not_before"), F.col("not_after"))
    path = F.col("_good").isNotNull() | F.col("_root").isNotNull()
    by_name = F.col("_named").isNotNull() | F.col("_root").isNotNull()
    deep = F.col("intermediates") + 1 > MAX_CHAIN_DEPTH
    valid = leaf_ok & path & ~deep
    reason = (
        F.when(valid, None)
        .when(deep, "max_chain_depth_exceeded")
        .when(F.col("_at") > F.col("not_after"), "expired_at_verification_time")
        .when(F.col("_at") < F.col("not_before"), "not_yet_valid_at_verification_time")
        .when(by_name, "expired_at_verification_time")
        .when((F.col("subject") == F.col("issuer")) & F.col("_self").isNull(), "self_signed")
        .when(F.col("intermediates") == 0, "missing_intermediate")
        .otherwise("untrusted_issuer")
    )
    return joined.select(
        "uid",
        "role",
        "der_sha256",
        F.when(F.col("_at").isNotNull(), F.coalesce(valid, F.lit(False))).alias("path_valid"),
        F.when(F.col("_at").isNull(), "capture_time_unavailable").otherwise(reason).alias("path_reason"),
    )


def attach_validation(
    certs: DataFrame, capture: DataFrame, analysis: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """Certificates with the outcome of both clocks and of the identity match on their leaves.

    ``capture`` and ``analysis`` come from :func:`validate_paths`; ``names`` has uid,
    identity_match and identity_reason, one row per connection.
    """
    key = ["uid", "role", "der_sha256"]
    left = capture.dropDuplicates(key).select(
        *key,
        F.col("path_valid").alias("path_valid_at_capture_time"),
        F.col("path_reason").alias("capture_reason"),
    )
    right = analysis.dropDuplicates(key).select(
        *key,
        F.col("path_valid").alias("path_valid_at_analysis_time"),
        F.col("path_reason").alias("analysis_reason"),
    )
    out = certs.join(left, key, "left").join(right, key, "left")
    leaf = (F.col("chain_index") == 0) & (F.col("role") == "server")
    if names is not None:
        out = out.join(names.select("uid", "identity_match", "identity_reason"), "uid", "left")
    else:
        out = out.withColumns(
            {
                "identity_match": F.lit(None).cast("boolean"),
                "identity_reason": F.lit("reference_identity_unavailable"),
            }
        )
    readable = F.col("syntax_valid")
    out = out.withColumn(
        "identity_reason",
        F.when(F.col("identity_match").isNull(), "reference_identity_unavailable").otherwise(
            F.col("identity_reason")
        ),
    )
    no_reference = F.col("identity_reason") == "reference_identity_unavailable"
    cols = [
        "path_valid_at_capture_time",
        "capture_reason",
        "path_valid_at_analysis_time",
        "analysis_reason",
        "identity_match",
    ]
    out = out.withColumns({c: F.when(leaf & readable, F.col(c)) for c in cols})
    unknown = F.array_compact(
        F.array(
            F.when(~readable, "syntax_invalid_leaf"),
            F.when(F.col("capture_reason") == "capture_time_unavailable", "capture_time_unavailable"),
            F.when(no_reference, "reference_identity_unavailable"),
        )
    )
    return out.withColumn("indeterminate_reasons", F.when(leaf, unknown)).withColumn(
        "identity_reason", F.when(leaf & readable, F.col("identity_reason"))
    )
