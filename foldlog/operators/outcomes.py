"""Rows that become events: outcomes of rules and decisions, commands and the streams they fan out to, and what waits for what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import narrative, typed
from .integrity import verify_chain

# Names in stored logs, messages that callers match.
RULES = {"EU-AI-ACT-2024": ("AML", "FRAUD_SCREEN", "KYC"), "EU-AI-ACT-2025": ("AML", "DATA_PRIVACY", "FRAUD_SCREEN", "KYC", "MODEL_BIAS")}
#: Stage, in order, and the events that end it.
STAGES = (
    ("document", ("PackageReadyForAnalysis", "CreditAnalysisRequested")), ("credit", ("CreditAnalysisCompleted",)), ("fraud", ("FraudScreeningCompleted",)),
    ("compliance", ("ComplianceRulePassed", "ComplianceRuleFailed", "ComplianceCheckCompleted", "DecisionRequested")), ("decision", ("DecisionGenerated",)))
OUTCOMES = ("ApplicationApproved", "ApplicationDeclined", "ApplicationWithdrawn")
#: command: the event it writes, its version, the streams that get a copy, and the payload's fields (name, or name in the payload and column).
COMMANDS: dict[str, tuple[str, int, tuple[str, ...], tuple[str | tuple[str, str], ...]]] = {
    "submit_application": ("ApplicationSubmitted", 1, ("loan",), ("application_id", "applicant_id", "requested_amount_usd")),
    "upload_document": ("DocumentUploaded", 1, ("loan",), ("application_id", "document_id", "file_path", "document_type")),
    "start_session": ("AgentContextLoaded", 1, ("agent",), ("agent_id", "session_id", "context_source", "context_token_count", "model_version")),
    "request_credit": ("CreditAnalysisRequested", 1, ("loan",), ("application_id",)),
    "record_credit": ("CreditAnalysisCompleted", 2, ("loan", "agent"), (
        "application_id", "agent_id", "session_id", "model_version", "confidence_score", "risk_tier", "recommended_limit_usd", "analysis_duration_ms", "reasoning", ("risk_score_raw", "confidence_score"))),
    "record_fraud": ("FraudScreeningCompleted", 1, ("loan", "agent"), ("application_id", "agent_id", "session_id", "fraud_score", "screening_result", "flags")),
    "request_compliance": ("ComplianceCheckRequested", 1, ("loan", "compliance"), ("application_id", "required_rules")),
    "record_compliance": ("ComplianceRulePassed", 1, ("compliance",), ("application_id", "rule_id")),
    "generate_decision": ("DecisionGenerated", 2, ("loan", "agent"), (
        "application_id", ("orchestrator_agent_id", "agent_id"), "recommendation", "confidence_score", "contributing_agent_sessions", "model_versions")),
    "record_review": ("HumanReviewCompleted", 1, ("loan",), ("application_id", "reviewer_id", "override", "final_decision", "override_reason")),
    "approve": ("ApplicationApproved", 1, ("loan",), ("application_id", "approved_amount_usd")),
    "decline": ("ApplicationDeclined", 1, ("loan",), ("application_id", "reason")),
}


def command_rules(command: str) -> list[tuple[str, Column, Column | str, Column | str]]:
    """What must hold of a command's row, in the order of checks: error type, predicate, message, suggested action. Feed it to validate_commands."""
    c = F.col
    filled = lambda f: (F.trim(c(f)) != "", f"{f} must not be empty.", "")
    unit = lambda f: (c(f).between(0.0, 1.0), f"{f} must be between 0.0 and 1.0.", "")
    one_of = lambda f, *names: (c(f).isin(*names), f"{f} must be {', '.join(names[:-1])}{',' if len(names) > 2 else ''} or {names[-1]}.", "")
    listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in parts))
    known = (c("regulation_set").isin(*RULES), text("Unknown regulation_set_version '", c("regulation_set"), "'."), f"Use one of: {listed(RULES)}")
    own = F.lit(False)
    valid = F.lit("")
    for name, rules in RULES.items():
        own = own | ((c("regulation_set") == name) & c("rule_id").isin(*rules))
        valid = F.when(c("regulation_set") == name, f"Valid rules: {listed(rules)}").otherwise(valid)
    # of a set that isn't known no rule is missed as well
    in_set = (~F.coalesce(known[0], F.lit(False)) | own, text("rule_id '", c("rule_id"), "' not in regulation set '", c("regulation_set"), "'."), valid)
    rules = {
        "submit_application": [filled("application_id"), filled("applicant_id"), (c("requested_amount_usd") > 0, "requested_amount_usd must be positive.", "")],
        "upload_document": [filled("application_id"), filled("document_id"), filled("file_path")],
        "start_session": [filled("agent_id"), filled("session_id"), filled("model_version"), (c("context_token_count") >= 0, "context_token_count must be non-negative.", "")],
        "request_credit": [filled("application_id")],
        "record_credit": [(c("risk_tier").isin("LOW", "MEDIUM", "HIGH", "VERY_HIGH"), text("Invalid risk_tier '", c("risk_tier"), "'. Must be LOW, MEDIUM, HIGH, or VERY_HIGH."), ""), unit("confidence_score")],
        "record_fraud": [unit("fraud_score"), one_of("screening_result", "PASS", "FAIL", "REVIEW")],
        "request_compliance": [filled("application_id"), known],
        "record_compliance": [one_of("status", "PASSED", "FAILED"), known, in_set],
        "generate_decision": [one_of("recommendation", "APPROVE", "DECLINE", "REFER"), unit("confidence_score"),
                              (F.size("contributing_agent_sessions") > 0, "contributing_sessions must not be empty.", "Include at least one contributing agent session.")],
        "record_review": [(F.trim("reviewer_id") != "", "reviewer_id is required.", "Provide an authenticated reviewer_id."), one_of("final_decision", "APPROVE", "DECLINE", "REFER"),
                          (~F.coalesce(c("override"), F.lit(False)) | (F.trim("override_reason") != ""), "override_reason is required when override=True.", "Provide a reason for the override.")],
        "approve": [filled("application_id")],
        "decline": [filled("application_id")],
    }
    return [("VALIDATION_ERROR", *rule) for rule in rules[command]]


def command_events(df: DataFrame, command: str, *keep: str) -> DataFrame:
    """keep, k, stream_id, event_type, event_version and payload of the events that rows of valid commands write, a copy for each stream (k numbers them).

    A rule's result is ComplianceRulePassed or, with a failure_reason, ComplianceRuleFailed, by its status; where the column clears is
    true, the loan's stream gets a clearance as well. Fields that df lacks, and nulls, are left out of the payload.
    """
    event, version, targets, fields = COMMANDS[command]
    stream = {
        "loan": lambda: F.concat(F.lit("loan-"), "application_id"), "compliance": lambda: F.concat(F.lit("compliance-"), "application_id"),
        "agent": lambda: F.concat_ws("-", F.lit("agent"), "agent_id", "session_id")}
    pairs = [f if isinstance(f, tuple) else (f, f) for f in fields]
    values = [F.col(c).alias(n) for n, c in pairs if c in df.columns]
    kind = F.lit(event)
    if command == "record_credit":
        values.append(F.lit("EU-AI-ACT-2025").alias("regulatory_basis"))
    if command == "record_compliance":
        passed = F.col("status") == "PASSED"
        why = F.col("failure_reason") if "failure_reason" in df.columns else F.lit(None).cast("string")
        kind = F.when(passed, event).otherwise("ComplianceRuleFailed")
        values += [F.lit("1.0").alias("rule_version"), F.when(~passed, F.coalesce(why, F.lit("Compliance requirement not met"))).alias("failure_reason")]
    to = lambda k, name, clears: F.struct(F.lit(k).alias("k"), stream[name]().alias("stream_id"), F.lit(clears).alias("clears"))
    copies, clearance = [to(k, t, False) for k, t in enumerate(targets)], F.lit(None).cast("string")
    if command == "record_compliance" and "clears" in df.columns:
        clearance = F.to_json(F.struct(F.col("application_id"), F.lit("compliance_clearance").alias("rule_id"), F.lit("1.0").alias("rule_version")))
        copies.append(F.when(F.col("clears"), to(len(targets), "loan", True)))
    # the payload is written once, below the copies
    rows = df.select(*keep, kind.alias("_type"), F.to_json(F.struct(*values)).alias("_payload"), clearance.alias("_clearance"), F.explode(F.array_compact(F.array(*copies))).alias("e"))
    own = lambda c, other: F.when(F.col("e.clears"), other).otherwise(F.col(c))
    return rows.select(*keep, "e.k", "e.stream_id", own("_type", F.lit(event)).alias("event_type"), F.lit(version).alias("event_version"), own("_payload", F.col("_clearance")).alias("payload"))


def _event(kind: Column | str, **payload: Column) -> list[Column]:
    return [F.concat(F.lit("loan-"), "application_id").alias("stream_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"),
            F.to_json(F.struct(F.col("application_id"), *(v.alias(k) for k, v in payload.items()))).alias("payload")]


def compliance_outcome_events(evaluated: DataFrame) -> DataFrame:
    """Per application of evaluate_regulations: ApplicationDeclined where a rule blocks, DecisionRequested otherwise."""
    block = evaluated.groupBy("application_id").agg(F.min(F.when(F.col("is_block"), F.col("rule_id"))).alias("rule"))
    blocked = F.col("rule").isNotNull()
    return block.select(*_event(
        F.when(blocked, "ApplicationDeclined").otherwise("DecisionRequested"), reason=F.concat(F.lit("Compliance hard block: "), "rule"),
        adverse_action_notice_required=F.when(blocked, True)))


def fraud_anomaly_events(rows: DataFrame) -> DataFrame:
    """One FraudAnomalyDetected for each medium or high anomaly of rows (application_id, anomalies: type, severity, evidence and perhaps affected_fields)."""
    fields = rows.schema["anomalies"].dataType.elementType.names
    touched = F.coalesce("a.affected_fields", F.array().cast("array<string>")) if "affected_fields" in fields else F.array().cast("array<string>")
    each = rows.select("application_id", F.explode(F.filter("anomalies", lambda a: a["severity"].isin("MEDIUM", "HIGH"))).alias("a"))
    stream, kind, payload = _event("FraudAnomalyDetected", anomaly_type=F.coalesce("a.type", F.lit("UNKNOWN")), severity=F.col("a.severity"), evidence=F.coalesce("a.evidence", F.lit("")), affected_fields=touched)
    return each.select(F.concat(F.lit("fraud-"), "application_id").alias("stream_id"), kind, payload)


def credit_fallback(rows: DataFrame) -> DataFrame:
    """What stands in for an analysis that failed: medium risk, three quarters of requested_amount (null: 0), confidence 0.45, and why.

    error, if rows has it, is what went wrong; its first 80 characters go into the rationale.
    """
    error = F.substring(F.coalesce("error", F.lit("")), 1, 80) if "error" in rows.columns else F.lit("")
    one = lambda text: F.array(F.lit(text))
    return rows.withColumns({
        "risk_tier": F.lit("MEDIUM"), "limit_usd": (0.75 * F.coalesce("requested_amount", F.lit(0))).cast("long"), "confidence": F.lit(0.45),
        "rationale": F.concat(F.lit("Automated analysis failed ("), error, F.lit("). Human review required.")),
        "key_concerns": one("Automated analysis error \u2014 human review required"), "data_quality_caveats": F.array().cast("array<string>"), "policy_overrides_applied": one("ANALYSIS_FALLBACK")})


def decision_outcome_events(decided: DataFrame) -> DataFrame:
    """The event after each decision of decision_constraints' rows: approved, declined, or human review requested.

    An approval carries approved_amount_usd (0 without such a column) and conditions (none without), a decline its notice flag.
    """
    r = F.col("final_recommendation")
    approved, declined = r == "APPROVE", r == "DECLINE"
    own = lambda c, none: F.coalesce(F.col(c), none) if c in decided.columns else none
    kind = F.when(approved, "ApplicationApproved").when(declined, "ApplicationDeclined").otherwise("HumanReviewRequested")
    quoted = F.regexp_replace(F.col("constraints"), "([A-Z_]+),?", "'$1', ")
    listed = F.concat(F.lit("["), F.regexp_replace(quoted, ", $", ""), F.lit("]"))
    reason = F.when(declined, "Orchestrator decision: DECLINE").when(
        ~approved, F.concat(F.lit("Recommendation: "), r, F.lit(". Constraints applied: "), listed))
    return decided.select(*_event(
        kind, approved_amount_usd=F.when(approved, own("approved_amount_usd", F.lit(0.0))), conditions=F.when(approved, own("conditions", F.array().cast("array<string>"))),
        reason=reason, adverse_action_notice_required=F.when(declined, True)))


def next_stage(log: DataFrame, stages: tuple[tuple[str, tuple[str, ...]], ...] = STAGES) -> DataFrame:
    """Per application: the first stage that none of its ending events has ended; 'done' if all have, or once there is an outcome.

    A check that failed ends its stage like one that passed; a hard block declines the application, which is an outcome.
    """
    e = typed(log).select(F.col("p")["application_id"].alias("application_id"), "event_type").where("application_id is not null")
    t = F.col("event_type")
    done = e.groupBy("application_id").agg(*(F.bool_or(t.isin(*ends)).alias(name) for name, ends in stages), F.bool_or(t.isin(*OUTCOMES)).alias("has_outcome"))
    waits = F.coalesce(F.when(F.col("has_outcome"), F.lit("done")), *(F.when(~F.col(name), F.lit(name)) for name, _ in stages), F.lit("done"))
    return done.select("application_id", waits.alias("next_stage"))


def decision_history(log: DataFrame) -> DataFrame:
    """Every application's loan events in order: when, the sentence about it, and for analyses and decisions who made them.

    at: to the second. agent_id, model_version, confidence, input_hash (the first 16 characters) and recommendation are null for other
    events. chain: whether the application's audit chain holds; VALID if it was never checked.
    """
    p, t = F.col("p"), F.col("event_type")
    e = typed(log.where(F.col("stream_id").startswith("loan-")))
    decided, made = t == "DecisionGenerated", t.isin("CreditAnalysisCompleted", "DecisionGenerated")
    agent = F.when(decided, p["orchestrator_agent_id"]).when(made, p["agent_id"])
    chain = verify_chain(log).select(F.regexp_replace("stream_id", "^audit-", "").alias("stream_id"), F.when(F.col("is_valid"), "VALID").otherwise("TAMPERED").alias("chain"))
    out = e.select(
        "stream_id", F.regexp_replace("stream_id", "^loan-", "").alias("application_id"), "stream_position", F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type",
        narrative().alias("sentence"), agent.alias("agent_id"), F.when(decided, F.try_element_at(p["model_versions"], agent)).when(made, p["model_version"]).alias("model_version"),
        F.when(made, p["confidence_score"]).alias("confidence"), F.when(made, F.substring(F.get_json_object("payload", "$.input_data_hash"), 1, 16)).alias("input_hash"),
        F.when(decided, p["recommendation"]).alias("recommendation"))
    return out.join(chain, "stream_id", "left").withColumn("chain", F.coalesce("chain", F.lit("VALID"))).drop("stream_id")


def node_profile(nodes: DataFrame) -> DataFrame:
    """Runs, durations and cost of every node of every agent type; nodes: agent_type, node_name, duration_ms, cost."""
    return nodes.groupBy("agent_type", "node_name").agg(
        F.count("*").alias("runs"), F.avg("duration_ms").alias("avg_duration_ms"), F.max("duration_ms").alias("max_duration_ms"), F.sum("cost").alias("cost"))
