"""Rule packs: bounds, storage as rows, and tests of every rule through the compiled columns."""

import pytest

from mxposture.operators.validate import run_rule_tests
from mxposture.sources import rulepacks as packs

DAY = "2026-09-01"
HS, KX, CERT = "handshake", "handshake.key_exchange", "certificate"
V12 = {"handshake.version.selected": "TLSv12", "handshake.version.evidence_state": "observed"}
LEAF = {"certificate.role": "server", "certificate.chain_index": 0, "certificate.evidence_state": "observed"}


def version(value):
    return {"handshake.version.selected": value, "handshake.version.evidence_state": "observed"}


def suite(name, **more):
    return {"handshake.cipher_suite.name": name, "handshake.cipher_suite.evidence_state": "observed", **more}


def mechanism(value, **more):
    return {**V12, f"{KX}.mechanism": value, f"{KX}.evidence_state": "inferred", **more}


def signature(value):
    return {f"{HS}.certificate_verify_signature.algorithm": value, f"{HS}.certificate_verify_signature.evidence_state": "observed"}


def secrecy(value):
    return {"derived.forward_secrecy.outcome": value, "derived.forward_secrecy.evidence_state": "observed" if value != "indeterminate" else value}


def leaf(**values):
    return {**LEAF, **{f"certificate.{k.replace('__', '.')}": v for k, v in values.items()}}


def session(role=None, protocol="smtp", **values):
    out = {"session.protocol": protocol, "session.evidence_state": "observed"}
    if role:
        out["derived.service_role"] = role
    return {**out, **{k.replace("__", "."): v for k, v in values.items()}}


def upgrade(state, role=None):
    return {**session(role), "session.explicit_upgrade.state": state, "session.explicit_upgrade.evidence_state": "observed"}


TLS = "derived__transport_tls_established"
# code: (values that fail, values that pass)
TESTS = {
    "TLS_NEGOTIATED_SSL3": (version("SSLv3"), version("TLSv12")),
    "TLS_NEGOTIATED_TLS10": (version("TLSv10"), version("TLSv12")),
    "TLS_NEGOTIATED_TLS11": (version("TLSv11"), version("TLSv12")),
    "TLS_CIPHER_NULL": (suite("TLS_RSA_WITH_NULL_SHA"), suite("TLS_AES_128_GCM_SHA256")),
    "TLS_CIPHER_EXPORT": (suite("TLS_RSA_EXPORT_WITH_RC4_40_MD5"), suite("TLS_AES_128_GCM_SHA256")),
    "TLS_CIPHER_RC4": (suite("TLS_RSA_WITH_RC4_128_SHA"), suite("TLS_AES_128_GCM_SHA256")),
    "TLS_CIPHER_3DES": (suite("TLS_RSA_WITH_3DES_EDE_CBC_SHA"), suite("TLS_AES_128_GCM_SHA256")),
    "TLS_CIPHER_CBC": (suite("TLS_RSA_WITH_AES_128_CBC_SHA", **V12), suite("TLS_RSA_WITH_AES_128_GCM_SHA256", **V12)),
    "TLS12_STATIC_RSA_NEGOTIATED": (mechanism("RSA"), mechanism("ECDHE")),
    "TLS12_STATIC_DH_NEGOTIATED": (mechanism("DH"), mechanism("ECDHE")),
    "TLS12_DHE_NEGOTIATED": (mechanism("DHE"), mechanism("ECDHE")),
    "TLS12_STATIC_ECDH_NEGOTIATED": (mechanism("ECDH"), mechanism("ECDHE")),
    "TLS12_DHE_PARAMETERS_LT2048": (
        mechanism("DHE", **{f"{KX}.dh_param_size": 1024}), mechanism("DHE", **{f"{KX}.dh_param_size": 2048}),
    ),
    "TLS_HANDSHAKE_SIGNATURE_MD5": (signature("rsa_pkcs1_md5"), signature("ed25519")),
    "TLS_HANDSHAKE_SIGNATURE_SHA1": (signature("ecdsa_sha1"), signature("ed25519")),
    "TLS_FORWARD_SECRECY_ABSENT": (secrecy("absent"), secrecy("present")),
    "TLS_FORWARD_SECRECY_INDETERMINATE": (secrecy("indeterminate"), secrecy("present")),
    "CERT_RSA_KEY_LT2048": (leaf(public_key_algorithm="RSA", public_key_size=1536), leaf(public_key_algorithm="RSA", public_key_size=2048)),
    "CERT_PUBLIC_KEY_STRENGTH_LT112": (leaf(effective_strength_bits=80), leaf(effective_strength_bits=112)),
    "CERT_SIGNATURE_MD5": (leaf(signature_algorithm="md5WithRSA"), leaf(signature_algorithm="sha256WithRSA")),
    "CERT_SIGNATURE_SHA1": (leaf(signature_algorithm="sha1WithRSA"), leaf(signature_algorithm="sha256WithRSA")),
    "CERT_EXPIRED_AT_CAPTURE": (leaf(valid_at_capture_time=False), leaf(valid_at_capture_time=True)),
    "CERT_PATH_INVALID_AT_CAPTURE": (
        leaf(validation__path_valid_at_capture_time=False), leaf(validation__path_valid_at_capture_time=True),
    ),
    "CERT_IDENTITY_MISMATCH": (leaf(validation__identity_match=False), leaf(validation__identity_match=True)),
    "CERT_BECAME_INVALID_AFTER_CAPTURE": (
        leaf(valid_at_capture_time=True, valid_at_analysis_time=False), leaf(valid_at_capture_time=True, valid_at_analysis_time=True),
    ),
    "MAIL_SUBMISSION_CLEARTEXT": (session("smtp_submission", **{TLS: False}), session("smtp_submission", **{TLS: True})),
    "MAIL_ACCESS_CLEARTEXT": (session("imap_access", "imap", **{TLS: False}), session("imap_access", "imap", **{TLS: True})),
    "IMAP_LOGIN_WITHOUT_TLS": (
        session(None, "imap", derived__observed_commands=["LOGIN"], **{TLS: False}),
        session(None, "imap", derived__observed_commands=["LOGIN"], **{TLS: True}),
    ),
    "POP3_PASS_WITHOUT_TLS": (
        session(None, "pop3", derived__observed_commands=["PASS"], **{TLS: False}),
        session(None, "pop3", derived__observed_commands=["PASS"], **{TLS: True}),
    ),
    "UPGRADE_ACCEPTED_WITHOUT_TLS_TRANSITION": (upgrade("violation"), upgrade("tls_established")),
    "UPGRADE_PLAINTEXT_FALLBACK": (upgrade("plaintext_fallback", "smtp_submission"), upgrade("tls_established", "smtp_submission")),
    "NIST_TLS_SUITE_NOT_APPROVED": (suite("TLS_CHACHA20_POLY1305_SHA256"), suite("TLS_RSA_WITH_AES_128_CBC_SHA")),
    "TLS_NEGOTIATED_TLS10_DISCOURAGED": (version("TLSv10"), version("TLSv12")),
    "TLS_NEGOTIATED_TLS11_DISCOURAGED": (version("TLSv11"), version("TLSv12")),
    "TLS12_STATIC_RSA_DISCOURAGED": (mechanism("RSA"), mechanism("ECDHE")),
}


def rule_tests(pack):
    out = []
    for rule in pack.rules:
        bad, good = TESTS[rule.code]
        day = DAY if rule.effective_until is None else "2018-01-01"
        wanted = "indeterminate" if rule.fail_outcome == "indeterminate" else "negative"
        out.append((rule.code, day, bad, wanted))
        out.append((rule.code, day, good, "pass"))
        # Before the first day the rule does not apply.
        out.append((rule.code, "1990-01-01", bad, "not_applicable"))
        if rule.effective_until:
            out.append((rule.code, rule.effective_until, bad, "not_applicable"))
    return out


@pytest.mark.parametrize("profile,count", [("ietf_current", 31), ("nist_federal", 28), ("historical_at_capture", 34)])
def test_every_rule(spark, profile, count):
    pack = packs.built_in_pack(profile)
    assert len(pack.rules) == count
    assert run_rule_tests(spark, pack, rule_tests(pack)).collect() == []


def test_a_wrong_expectation_is_reported(spark):
    pack = packs.built_in_pack("ietf_current")
    out = run_rule_tests(spark, pack, [("TLS_NEGOTIATED_SSL3", DAY, version("SSLv3"), "pass")])
    assert [(r.rule, r.got) for r in out.collect()] == [("TLS_NEGOTIATED_SSL3", "negative")]


def test_unusable_evidence(spark):
    pack = packs.built_in_pack("ietf_current")
    hidden = {"handshake.version.evidence_state": "not_observable", "handshake.version.selected": None}
    tests = [
        ("TLS_NEGOTIATED_SSL3", DAY, hidden, "not_applicable"),
        ("TLS_HANDSHAKE_SIGNATURE_MD5", DAY, signature(None), "indeterminate"),
        ("CERT_EXPIRED_AT_CAPTURE", DAY, leaf(valid_at_capture_time=None), "indeterminate"),
    ]
    assert run_rule_tests(spark, pack, tests).collect() == []


def test_packs_as_rows(spark, tmp_path):
    both = [packs.built_in_pack(p) for p in packs.PROFILES]
    packs.rule_table(spark, both).write.json(str(tmp_path / "rules"))
    for pack in both:
        read = packs.read_pack(spark, str(tmp_path / "rules"), pack.profile)
        assert {r.code: r for r in read.rules} == {r.code: r for r in pack.rules}
    with pytest.raises(ValueError):
        packs.read_pack(spark, str(tmp_path / "rules"), "nobody")


def test_bad_packs_are_refused():
    pack = packs.built_in_pack("ietf_current")
    rule = pack.rules[0]

    def broken(**changes):
        from dataclasses import replace

        return packs.RulePack("p", "1", "analysis_time", (replace(rule, **changes),))

    for bad in (
        broken(target="host"),
        broken(roles=("nobody",)),
        broken(check=()),
        broken(check=(packs.Predicate("session.secret", "eq", 1),)),
        broken(check=(packs.Predicate("session.protocol", "like", "x"),)),
        broken(check=(packs.Predicate("session.protocol", "in", "x"),)),
        packs.RulePack("p", "1", "analysis_time", (rule, rule)),
    ):
        with pytest.raises(ValueError):
            packs.check_pack(bad)


def test_evidence_is_worked_out_once_for_all_targets(spark, sf_dir):
    from pyspark.sql import functions as F

    from mxposture.operators import rules as ops
    from mxposture.plans import registry

    if not registry.QUERIES:
        registry.load_all()
    from mxposture.plans import rule_queries

    structs = rule_queries._structs(spark, sf_dir)
    _, seen = ops.evaluate_pack(rule_queries._PACK, *structs, rule_queries.clock(), F.lit("capture"))
    # What the targets read has no way back to the tables.
    assert "FileScan" not in seen._jdf.queryExecution().executedPlan().toString()


def test_tallies_build_no_references(spark, sf_dir):
    from mxposture.plans import registry, rule_queries

    registry.load_all()
    full = rule_queries.judged(spark, sf_dir, "handshake")
    short = rule_queries.judged(spark, sf_dir, "handshake", references=False)
    assert [c for c in full.columns if c != "references"] == short.columns
    number = full["uid"].cast("bigint")
    rows = rule_queries._tallied(full, number)
    tally = rule_queries.historical(spark, sf_dir)
    assert "field_path" in rows._jdf.queryExecution().analyzed().toString()
    assert "field_path" not in tally._jdf.queryExecution().analyzed().toString()
    plain = rule_queries.handshake_rules(spark, sf_dir)
    assert sorted(rows.collect()) == sorted(plain.collect())
