"""Hashes against Python's own json and hashlib, and rules on rows with nulls."""

import hashlib
import json

from pyspark.sql import functions as F

from foldlog.operators import integrity, joins, outcomes, registry, rules

ENVELOPE = "event_id string, stream_id string, stream_position long, global_position long, event_type string, event_version int, payload string, metadata string, recorded_at timestamp_ntz"
PAYLOADS = ['{"b": 1.50, "a": {"z": null, "y": [1, 2.0, 50000.0]}}', '{"name": "Zo\u00eb \u65e5", "n":-0.0}', '{"x":"\\"q\\"", "e": 1e3}']


def digest(payload):
    return hashlib.sha256(json.dumps(json.loads(payload), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def audit(spark, payloads, checks=()):
    rows = [(f"e{i}", "audit-loan-A", i, i, "ApplicationSubmitted", 1, p, "{}") for i, p in enumerate(payloads, 1)]
    rows += [(None, "audit-loan-A", None, at, "AuditIntegrityCheckRun", 1, json.dumps(p), "{}") for at, p in checks]
    return spark.createDataFrame([(*r, None) for r in rows], ENVELOPE).withColumn("recorded_at", F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"))


def test_hashes_equal_python(spark):
    want = hashlib.sha256("".join(map(digest, PAYLOADS)).encode()).hexdigest()
    got = integrity.integrity_hash(audit(spark, PAYLOADS)).first()
    assert (got.integrity_hash, got.previous_hash, got.events_hashed) == (want, "", 3)
    events = [{"event_id": f"e{i}", "event_type": "ApplicationSubmitted", "event_version": 1, "stream_position": i, "global_position": i, "recorded_at": "2026-01-02T03:04:05+00:00", "payload": json.loads(p)} for i, p in enumerate(PAYLOADS, 1)]
    whole = hashlib.sha256(json.dumps(events, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert integrity.package_checksum(audit(spark, PAYLOADS)).first().checksum == whole


def test_chain_knows_values_from_spelling(spark):
    one = hashlib.sha256("".join(map(digest, PAYLOADS)).encode()).hexdigest()
    check = [(4, {"integrity_hash": one, "previous_hash": "", "events_hashed": 3})]
    spelled = [json.dumps(json.loads(p), indent=1) + " " for p in PAYLOADS]
    changed = [PAYLOADS[0].replace("1.50", "1.51"), *PAYLOADS[1:]]
    verdict = lambda p, c=check: integrity.verify_chain(audit(spark, p, c)).first()
    assert verdict(PAYLOADS).is_valid and verdict(spelled).is_valid
    assert (verdict(changed).is_valid, verdict(changed).failure, verdict(changed).failed_at) == (False, "hash_mismatch", 4)
    assert verdict(PAYLOADS, [(4, {**check[0][1], "previous_hash": "x"})]).failure == "chain_broken"


def test_regulations_on_nulls(spark):
    ddl = "application_id string, jurisdiction string, legal_type string, founded_year int, requested_amount double, aml_watch boolean, sanctions boolean"
    apps = spark.createDataFrame([("a", None, None, 2000, None, None, None), ("b", None, None, None, None, False, False), ("c", "MT", "LLC", 2000, 1.0, True, False)], ddl)
    got = rules.evaluate_regulations(apps, 2026)
    status = {(r.application_id, r.rule_id): (r.status, r.is_block) for r in got.collect()}
    assert all(status["a", f"REG-00{i}"] == ("PASSED", False) for i in range(1, 6)) and status["a", "REG-006"] == ("NOTED", False)
    assert status["b", "REG-005"] == ("FAILED", True) and ("b", "REG-006") not in status
    assert status["c", "REG-001"] == ("FAILED", False) and status["c", "REG-003"] == ("FAILED", True) and ("c", "REG-004") not in status
    out = {r.stream_id: (r.event_type, json.loads(r.payload)) for r in outcomes.compliance_outcome_events(got).collect()}
    assert out["loan-a"] == ("DecisionRequested", {"application_id": "a"}) and out["loan-b"][1]["reason"] == "Compliance hard block: REG-005"


def test_policy_names_a_default_only_where_it_changes_the_tier(spark):
    rows = spark.createDataFrame([(1e6, True, True, 400000.0, "HIGH", 0.9), (0.0, True, False, 5.0, "LOW", 0.4)], "revenue double, has_default boolean, has_high_flag boolean, limit_usd double, risk_tier string, confidence double")
    got = registry.credit_policy(rows).collect()
    assert got[0].overrides == "POLICY_REV_CAP: limit capped at 35% of revenue ($350,000); POLICY_COMPLIANCE_FLAG: confidence capped at 0.50"
    assert got[1].overrides == "POLICY_PRIOR_DEFAULT: risk_tier elevated to HIGH" and (got[1].risk_tier, got[1].confidence, got[1].limit_usd) == ("HIGH", 0.4, 5.0)


def test_command_errors(spark):
    rows = spark.createDataFrame([("a", "r", True, " ", "APPROVE"), ("a", "r", None, None, "MAYBE"), (None, "", False, None, "REFER")], "application_id string, reviewer_id string, `override` boolean, override_reason string, final_decision string")
    got = [[(e.error_type, e.message) for e in r.errors] for r in rules.validate_commands(rows, outcomes.command_rules("record_review")).collect()]
    wrong = lambda text: [("VALIDATION_ERROR", text)]
    assert got == [wrong("override_reason is required when override=True."), wrong("final_decision must be APPROVE, DECLINE, or REFER."), wrong("reviewer_id is required.")]


def test_every_command_has_rules_and_events(spark):
    ddl = "application_id string, agent_id string, session_id string, applicant_id string, reviewer_id string, document_id string, file_path string, model_version string, requested_amount_usd double, context_token_count int, risk_tier string, confidence_score double, fraud_score double, screening_result string, rule_id string, status string, regulation_set string, recommendation string, contributing_agent_sessions array<string>, final_decision string, `override` boolean, override_reason string, approved_amount_usd double"
    row = ("A", "g", "s", "c", "r", "d", "/d", "v1", 1.0, 0, "VERY_HIGH", 1.0, 0.0, "REVIEW", "KYC", "PASSED", "EU-AI-ACT-2025", "REFER", ["agent-g-s"], "REFER", True, "because", 2.0)
    for command, (event, _, targets, _) in outcomes.COMMANDS.items():
        ok = rules.validate_commands(spark.createDataFrame([row], ddl), outcomes.command_rules(command))
        assert ok.first().is_valid, command
        got = outcomes.command_events(ok, command).collect()
        assert {r.event_type for r in got} == {event} and len(got) == len(targets)


def test_chains_of_causes_over_many_rounds_and_cycles(spark):
    meta = lambda corr, up: json.dumps({"correlation_id": corr, "causation_id": up})
    rows = [(f"a{i}", meta("one", f"a{i - 1}" if i else None)) for i in range(100)] + [("x", meta("two", "y")), ("y", meta("two", "x")), ("z", meta("three", "a5")), ("n", "{}")]
    log = spark.createDataFrame([(e, "s", 1, i, "T", 1, "{}", m, None) for i, (e, m) in enumerate(rows)], ENVELOPE)
    got = {r.event_id: r.depth for r in joins.causation_chain(log).collect()}
    assert got == {**{f"a{i}": i for i in range(100)}, "z": 0}
    assert joins.causation_chain(log, 3).count() == 5
