"""Rule packs compiled to Columns: one projection evaluates all rules of a target.

Records meet their rules without a join: the rules become an array of structs per record that is
exploded after the rules that do not apply are filtered out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mxposture.constants import CHECK_CATEGORY, STATE_RANK, USABLE_STATES
from mxposture.functions.states import predicate, sql_literal, state_from_rank, state_rank
from mxposture.functions.text import joined_digest
from mxposture.operators.certificates import leaf_per_uid
from mxposture.session import settled
from mxposture.sources.rulepacks import Predicate, Rule, RulePack

# Evaluation context: one struct per evidence kind.
CONTEXT_DDL = (
    "flow struct<uid:string,orig:struct<host:string,port:bigint>,resp:struct<host:string,port:bigint>,"
    "evidence_state:string>,"
    "session struct<uid:string,protocol:string,evidence_state:string,"
    "explicit_upgrade:struct<state:string,evidence_state:string>,"
    "implicit_tls:struct<correlated_protocol:string,evidence_state:string>>,"
    "handshake struct<uid:string,established:boolean,resumed:boolean,evidence_state:string,visibility:string,"
    "version:struct<selected:string,evidence_state:string>,"
    "cipher_suite:struct<name:string,code:string,evidence_state:string>,"
    "key_exchange:struct<mechanism:string,evidence_state:string,dh_param_size:bigint>,"
    "certificate_verify_signature:struct<algorithm:string,evidence_state:string>>,"
    "certificate struct<uid:string,chain_index:bigint,role:string,der_sha256:string,evidence_state:string,"
    "public_key_algorithm:string,public_key_size:bigint,public_key_curve:string,"
    "effective_strength_bits:bigint,signature_algorithm:string,valid_at_capture_time:boolean,"
    "valid_at_analysis_time:boolean,validation:struct<path_valid_at_capture_time:boolean,"
    "path_valid_at_analysis_time:boolean,identity_match:boolean>>,"
    "derived struct<service_role:string,forward_secrecy:struct<outcome:string,evidence_state:string>,"
    "observed_commands:array<string>,transport_tls_established:boolean>"
)


def _col(df: DataFrame, name: str, dtype: str) -> Column:
    value = F.col(name) if name in df.columns else F.lit(None)
    return value.cast(dtype).alias(name)


def flow_struct(flows: DataFrame) -> DataFrame:
    def end(host: str, port: str) -> Column:
        return F.struct(F.col(host).alias("host"), F.col(port).cast("bigint").alias("port"))

    return flows.select(
        "uid",
        F.struct(
            "uid",
            end("orig_h", "orig_p").alias("orig"),
            end("resp_h", "resp_p").alias("resp"),
            "evidence_state",
        ).alias("flow"),
    )


def session_struct(sessions: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    out = sessions.select(
        "uid",
        F.struct(
            "uid",
            "protocol",
            "evidence_state",
            F.struct(
                F.col("upgrade_state").alias("state"),
                F.col("upgrade_evidence_state").alias("evidence_state"),
            ).alias("explicit_upgrade"),
            F.struct(
                _col(sessions, "implicit_protocol", "string").alias("correlated_protocol"),
                _col(sessions, "implicit_state", "string").alias("evidence_state"),
            ).alias("implicit_tls"),
        ).alias("session"),
    )
    if commands is None:
        return out.withColumn("commands", F.array().cast("array<string>"))
    joined = out.join(commands, "uid", "left")
    return joined.withColumn(
        "commands", F.coalesce("commands", F.array().cast("array<string>"))
    )


def pack_words(pack: RulePack) -> list[str]:
    """The command words that the pack's rules look for, upper-cased."""
    words = set()
    for rule in pack.rules:
        for p in (*rule.where, *rule.check):
            if p.path == "derived.observed_commands" and p.value is not None:
                words.update(p.value if isinstance(p.value, (list, tuple, set, frozenset)) else [p.value])
    return sorted(w.upper() for w in words)


def observed_commands(events: DataFrame, words: list[str]) -> DataFrame:
    """Which of ``words`` each session used; the set is bounded by the rule vocabulary."""
    used = events.withColumn("_c", F.upper("command")).where(F.col("_c").isin(words))
    return used.groupBy("uid").agg(F.sort_array(F.collect_set("_c")).alias("commands"))


def handshake_struct(handshakes: DataFrame) -> DataFrame:
    """Handshake records; an ``ord`` column, when present, decides which is the first of a uid."""
    return handshakes.select(
        "uid",
        *(["ord"] if "ord" in handshakes.columns else []),
        F.struct(
            "uid",
            "established",
            "resumed",
            "evidence_state",
            "visibility",
            F.struct(
                F.col("version").alias("selected"), F.col("version_state").alias("evidence_state")
            ).alias("version"),
            F.struct(
                F.col("cipher_name").alias("name"),
                F.col("cipher_code").alias("code"),
                F.col("cipher_state").alias("evidence_state"),
            ).alias("cipher_suite"),
            F.struct(
                F.col("kx_mechanism").alias("mechanism"),
                F.col("kx_state").alias("evidence_state"),
                _col(handshakes, "dh_param_size", "bigint"),
            ).alias("key_exchange"),
            F.struct(
                _col(handshakes, "signature_algorithm", "string").alias("algorithm"),
                F.coalesce(
                    _col(handshakes, "signature_state", "string"), F.lit("not_observable")
                ).alias("evidence_state"),
            ).alias("certificate_verify_signature"),
        ).alias("handshake"),
        F.struct(
            F.col("fs_outcome").alias("outcome"), F.col("fs_state").alias("evidence_state")
        ).alias("_secrecy"),
    )


def certificate_struct(certs: DataFrame) -> DataFrame:
    return certs.select(
        "uid",
        F.struct(
            "uid",
            F.col("chain_index").cast("bigint").alias("chain_index"),
            "role",
            "der_sha256",
            "evidence_state",
            _col(certs, "public_key_algorithm", "string"),
            _col(certs, "public_key_size", "bigint"),
            _col(certs, "public_key_curve", "string"),
            _col(certs, "effective_strength_bits", "bigint"),
            _col(certs, "signature_algorithm", "string"),
            _col(certs, "valid_at_capture_time", "boolean"),
            _col(certs, "valid_at_analysis_time", "boolean"),
            F.struct(
                _col(certs, "path_valid_at_capture_time", "boolean"),
                _col(certs, "path_valid_at_analysis_time", "boolean"),
                _col(certs, "identity_match", "boolean"),
            ).alias("validation"),
        ).alias("certificate"),
    )


def contexts(
    target: str,
    pack: RulePack,
    flows: DataFrame,
    sessions: DataFrame,
    handshakes: DataFrame,
    certificates: DataFrame,
) -> DataFrame:
    """Records of one target with the other evidence of their connection.

    The inputs are the ``*_struct`` frames. Every joined side has one row per uid (first
    handshake, smallest server leaf), so a busy connection cannot multiply.
    """
    first_handshake = handshakes.groupBy("uid").agg(
        F.min_by(
            F.struct("handshake", "_secrecy"),
            F.col("ord") if "ord" in handshakes.columns else F.lit(0),
        ).alias("_h")
    ).select("uid", "_h.*")
    leaf = leaf_per_uid(
        certificates.select("uid", "certificate.chain_index", "certificate.role", "certificate.der_sha256", "certificate")
    ).select("uid", "certificate")
    sides = {
        "flow": flows.select("uid", "flow"),
        "session": sessions.select("uid", "session", "commands"),
        "handshake": first_handshake,
        "certificate": leaf,
    }
    records = {
        "flow": flows.select("uid", "flow"),
        "session": sessions.select("uid", "session", "commands"),
        "handshake": handshakes.select("uid", "handshake", "_secrecy"),
        "certificate": certificates.select("uid", "certificate"),
    }
    out = records[target]
    for name, side in sides.items():
        if name != target:
            out = out.join(side, "uid", "left")
    key = F.col("uid")
    if target == "certificate":
        c = F.col("certificate")
        key = F.concat_ws(":", "uid", c["role"], c["chain_index"].cast("string"), c["der_sha256"])
    return with_derived(out.withColumn("record_key", key), pack)


def with_derived(context: DataFrame, pack: RulePack) -> DataFrame:
    """Service role, forward secrecy, commands and whether TLS was on."""
    hits = []
    for role, (protocol, ports) in pack.roles.items():
        known = predicate(
            "eq", F.col("session.protocol"), protocol, "string", F.col("session.evidence_state")
        ) & predicate("in", F.col("flow.resp.port"), ports, "bigint", F.col("flow.evidence_state"))
        hits.append((role, F.coalesce(known, F.lit(False))))
    count = sum((h.cast("int") for _, h in hits), F.lit(0))
    named = F.coalesce(*[F.when(h, role) for role, h in hits])
    role = F.when(count == 1, named).when(count > 1, "indeterminate").otherwise("unclassified")
    on = F.coalesce(F.col("handshake.established"), F.lit(False)) | F.coalesce(
        F.col("session.explicit_upgrade.state") == "tls_established", F.lit(False)
    )
    commands = F.coalesce(F.col("commands"), F.array().cast("array<string>"))
    return context.withColumn(
        "derived",
        F.struct(
            role.alias("service_role"),
            F.when(F.col("handshake").isNotNull(), F.col("_secrecy")).alias("forward_secrecy"),
            commands.alias("observed_commands"),
            on.alias("transport_tls_established"),
        ),
    ).drop("commands", "_secrecy")


def _field_type(schema: T.StructType, path: str) -> str | None:
    node: T.DataType = schema
    for part in path.split("."):
        if not isinstance(node, T.StructType) or part not in node.names:
            return None
        node = node[part].dataType
    return node.simpleString()


def _state_column(schema: T.StructType, path: str) -> Column:
    """Evidence state that speaks for a path, found at compile time."""
    options = []
    if path.endswith("evidence_state") and _field_type(schema, path):
        options.append(F.col(path))
    parent = path.rsplit(".", 1)[0] + ".evidence_state"
    root = path.split(".", 1)[0] + ".evidence_state"
    for other in (parent, root):
        if _field_type(schema, other) == "string":
            options.append(F.col(other))
    options.append(F.lit("inferred" if path.startswith("derived.") else "observed"))
    return F.coalesce(*options)


def evaluate(context: DataFrame, pack: RulePack, target: str, clock: Column, references: bool = True) -> DataFrame:
    """One row per applicable (record, rule): result, check outcome, states and references.

    ``context`` keeps its other columns (capture id and the like). ``clock`` is the evaluation
    instant; rows without one have no active rule. ``references`` are built for every rule and
    record; where no findings are made of the rows, they can be left out.
    """
    rules = [r for r in pack.rules if r.target == target]
    schema = context.schema
    slots: dict[tuple, int] = {}

    def slot(p: Predicate) -> int:
        return slots.setdefault((p.path, p.op, repr(p.value), p.state_path), len(slots))

    predicates: dict[int, Predicate] = {}
    for rule in rules:
        for p in (*rule.where, *rule.check):
            predicates[slot(p)] = p
    columns: dict[str, Column] = {"_day": F.to_date(clock)}
    for index, p in predicates.items():
        dtype = _field_type(schema, p.path)
        if dtype is None:
            raise ValueError(f"path {p.path} is not in the evaluation context")
        state = F.col(p.state_path) if p.state_path else None
        value = F.col(p.path)
        columns[f"_p{index}"] = predicate(p.op, value, p.value, dtype, state)
        source = _state_column(schema, p.state_path or p.path)
        rank = state_rank(F.when(value.isNull() & source.isin(USABLE_STATES), "indeterminate").otherwise(source))
        columns[f"_r{index}"] = F.coalesce(rank, F.lit(STATE_RANK["indeterminate"]))
    ready = context.withColumns(columns)
    judged = ", ".join(_judge(rule, slot, references) for rule in rules)
    keep = [F.col(f"`{c}`") for c in context.columns]
    applied = F.expr(f"filter(array({judged}), j -> j.check_outcome IS NOT NULL)")
    return ready.select(*keep, F.explode(applied).alias("_j")).select(*keep, "_j.*")


def _least(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else f"least({', '.join(parts)})"


def _judge(rule: Rule, slot, with_references: bool = True) -> str:
    """SQL struct with the judgement of one rule over the predicate columns ``_p<n>`` (true, false,
    null for unusable) and their state ranks ``_r<n>``."""
    where = [slot(p) for p in rule.where]
    check = [slot(p) for p in rule.check]
    active = f"_day >= DATE'{rule.effective_from}'"
    if rule.effective_until is not None:
        active += f" AND _day < DATE'{rule.effective_until}'"
    if rule.roles:
        names = ", ".join(sql_literal(r) for r in rule.roles)
        active += f" AND derived.service_role IN ({names})"
    # SQL AND is the conjunction wanted here: false beats null beats true.
    w = " AND ".join(f"_p{i}" for i in where) or "true"
    a = " AND ".join(f"_p{i}" for i in check)

    def unusable(ids: list[int]) -> str:
        return _least([f"if(_p{i} IS NULL, _r{i}, 99)" for i in ids]) if ids else "99"

    def gap(rank: str) -> str:
        return f"if({rank} = {STATE_RANK['not_observable']}, 'not_observable', 'unknown')"

    soft = rule.fail_outcome == "indeterminate"
    outcome = (
        f"CASE WHEN NOT coalesce({active}, false) THEN NULL WHEN ({w}) IS NULL THEN {gap(unusable(where))} "
        f"WHEN NOT ({w}) THEN NULL WHEN ({a}) IS NULL THEN {gap(unusable(check))} "
        f"WHEN {a} THEN 'pass' ELSE '{'unknown' if soft else 'fail'}' END"
    )
    result = (
        f"CASE WHEN ({w}) IS NULL OR NOT ({w}) THEN 'not_applicable' WHEN ({a}) IS NULL THEN 'indeterminate' "
        f"WHEN {a} THEN 'pass' ELSE '{'indeterminate' if soft else 'negative'}' END"
    )
    states = _least([f"_r{i}" for i in check])
    coverage = (
        f"CASE WHEN ({w}) IS NULL THEN {unusable(where)} WHEN ({a}) IS NULL THEN {unusable(check)} "
        f"ELSE {states} END"
    )
    by_path: dict[str, list[str]] = {}
    for p in (*rule.where, *rule.check):
        by_path.setdefault(p.path, []).append(f"_r{slot(p)}")
    if rule.roles:
        by_path["derived.service_role"] = [str(STATE_RANK["inferred"])]
    references = ", ".join(
        f"named_struct('field_path', '{path}', 'rank', CAST({_least(ranks)} AS INT))"
        for path, ranks in sorted(by_path.items())
    )
    basis = _least([r for ranks in by_path.values() for r in ranks])
    return (
        f"named_struct('code', {sql_literal(rule.code)}, 'result', {result}, 'check_outcome', {outcome}, "
        f"'coverage_rank', CAST({coverage} AS INT), 'basis_rank', CAST({basis} AS INT)"
        + (f", 'references', array({references}))" if with_references else ")")
    )


def _rule_facts(spark, pack: RulePack) -> DataFrame:
    """Texts and severities per code: at most 128 rows, safe to broadcast."""
    rows = [
        (r.code, r.title, r.remediation_id, list(r.standards), r.severity, r.indeterminate_severity,
         r.effective_from, r.effective_until)
        for r in pack.rules
    ]
    schema = (
        "code string, title string, remediation_id string, standards array<string>, severity_negative string, "
        "severity_indeterminate string, rule_effective_from date, rule_effective_until date"
    )
    return F.broadcast(spark.createDataFrame(rows, schema))


def _endpoint() -> Column:
    resp = F.col("flow.resp")
    return F.when(
        resp["host"].isNotNull(), F.concat_ws(":", resp["host"], resp["port"].cast("string"))
    ).otherwise("unknown")


def checks(judged: DataFrame, pack: RulePack, target: str, capture: Column) -> DataFrame:
    """Coverage observations with deterministic ids."""
    protocol = F.col("session.protocol")
    known = F.when(protocol.isin("smtp", "imap", "pop3"), protocol).otherwise("unclassified")
    digest = joined_digest(
        capture,
        F.lit(pack.profile),
        F.lit(pack.digest),
        F.col("code"),
        F.col("check_outcome"),
        F.lit(target),
        F.col("record_key"),
    )
    return judged.select(
        digest.alias("check_id"),
        "code",
        F.lit(CHECK_CATEGORY[target]).alias("category"),
        known.alias("protocol"),
        _endpoint().alias("affected_endpoint"),
        F.lit(target).alias("record_type"),
        "record_key",
        F.col("check_outcome").alias("outcome"),
        state_from_rank(F.col("coverage_rank")).alias("evidence_state"),
    )


def findings(judged: DataFrame, pack: RulePack, target: str, capture: Column, clock: Column) -> DataFrame:
    """Negative and indeterminate judgements as findings with their evidence references."""
    rows = judged.where(F.col("result").isin("negative", "indeterminate"))
    rows = rows.join(_rule_facts(judged.sparkSession, pack), "code")
    negative = F.col("result") == "negative"
    digest = joined_digest(
        capture,
        F.lit(pack.profile),
        F.lit(pack.digest),
        F.col("code"),
        F.col("result"),
        F.lit(target),
        F.col("record_key"),
    )
    references = F.transform(
        F.col("references"),
        lambda r: F.struct(
            F.lit(target).alias("record_type"),
            F.col("record_key").alias("record_key"),
            r["field_path"].alias("field_path"),
            state_from_rank(r["rank"]).alias("evidence_state"),
            F.lit(None).cast("int").alias("frame_number"),
        ),
    )
    return rows.select(
        digest.alias("finding_id"),
        "code",
        F.col("result").alias("outcome"),
        "title",
        "remediation_id",
        "standards",
        F.when(negative, F.col("severity_negative"))
        .otherwise(F.col("severity_indeterminate"))
        .alias("severity"),
        F.when(negative, "verified").otherwise("indeterminate").alias("evaluation_state"),
        state_from_rank(F.col("basis_rank")).alias("basis_state"),
        F.lit(pack.profile).alias("policy_profile"),
        F.lit(pack.digest).alias("policy_pack_version"),
        "rule_effective_from",
        "rule_effective_until",
        clock.alias("policy_evaluation_time"),
        _endpoint().alias("affected_endpoint"),
        F.lit(target).alias("record_type"),
        "record_key",
        references.alias("evidence_references"),
    )


def evaluation_clock(pack: RulePack, analysis_time: Column, capture_start: Column) -> Column:
    """Instant the pack judges at; null where a capture-clock pack has no capture time."""
    return analysis_time if pack.clock == "analysis_time" else capture_start


def evaluate_pack(
    pack: RulePack,
    flows: DataFrame,
    sessions: DataFrame,
    handshakes: DataFrame,
    certificates: DataFrame,
    clock: Column,
    capture: Column,
) -> tuple[DataFrame, DataFrame]:
    """Findings and checks of all targets the pack names.

    Each target meets the evidence of all four kinds, so that is worked out once, before the first.
    """
    flows, sessions, handshakes, certificates = (
        settled(evidence) for evidence in (flows, sessions, handshakes, certificates)
    )
    found, seen = None, None
    for target in dict.fromkeys(r.target for r in pack.rules):
        judged = evaluate(
            contexts(target, pack, flows, sessions, handshakes, certificates), pack, target, clock
        )
        f = findings(judged, pack, target, capture, clock)
        c = checks(judged, pack, target, capture)
        found = f if found is None else found.unionByName(f)
        seen = c if seen is None else seen.unionByName(c)
    return found, seen


def active_rules(rules: DataFrame, days: DataFrame) -> DataFrame:
    """Which stored rules hold on which days: the rule side (at most 128 rows a profile) is the
    broadcast side of a range condition."""
    cond = (F.col("day") >= F.col("effective_from").cast("date")) & (
        F.col("effective_until").isNull() | (F.col("day") < F.col("effective_until").cast("date"))
    )
    return days.join(F.broadcast(rules), cond)
