"""Column expressions over events and payloads. None of them needs Python at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONFIDENCE_FLOOR, PAYLOAD_DDL


def typed(log: DataFrame) -> DataFrame:
    """log with p, the payload's known fields. Spark parses only the fields that a query reads."""
    return log.withColumn("p", F.from_json("payload", PAYLOAD_DDL))


def by_category(log: DataFrame, prefix: str) -> DataFrame:
    return log.where(F.col("stream_id").startswith(prefix))


def subscribe(log: DataFrame, types: list[str]) -> DataFrame:
    """Events of the given types; an empty list means all."""
    return log.where(F.col("event_type").isin(list(types))) if types else log


def in_shard(position: Column, start: Column, end: Column) -> Column:
    """Both ends belong to the shard; a null end is open."""
    return (position >= start) & (end.isNull() | (position <= end))


def as_of(log: DataFrame, moment) -> DataFrame:
    return log.where(F.col("recorded_at") <= F.lit(moment))


def has_key(payload: Column, key: str) -> Column:
    """Whether a JSON object has the key, be its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def payload_get(payload: Column, key: str, default: Column | None = None) -> Column:
    """A field as text. The default stands for an absent key only; a present null stays null."""
    value = F.get_json_object(payload, f"$.{key}")
    return value if default is None else F.when(has_key(payload, key), value).otherwise(default)


def clean_app_id(app: Column) -> Column:
    return F.regexp_replace(app, "^loan-", "")


def parse_audit_stream(stream: Column) -> Column:
    """audit-{type}-{id} as a struct; without a second dash the type is 'unknown' and the id what follows the first."""
    rest = F.regexp_replace(stream, "^audit-", "")
    parts = F.split(rest, "-", 2)
    two = F.size(parts) == 2
    return F.struct(
        F.when(two, parts[0]).otherwise(F.lit("unknown")).alias("entity_type"), F.when(two, parts[1]).otherwise(rest).alias("entity_id"))


def session_stream_id(agent: Column, session: Column) -> Column:
    none = F.lit("None")
    return F.concat(F.lit("agent-"), F.coalesce(agent, none), F.lit("-"), F.coalesce(session, none))


def short_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text in quotes."""
    return F.substring(F.sha2(F.concat(F.lit('"'), text, F.lit('"')), 256), 1, 16)


def recommendation_with_floor(recommendation: Column, confidence: Column) -> Column:
    """REFER below the confidence floor; a missing confidence passes, a missing recommendation is REFER."""
    low = F.coalesce(confidence, F.lit(1.0)) < CONFIDENCE_FLOOR
    return F.when(low, "REFER").otherwise(F.coalesce(recommendation, F.lit("REFER")))


def pending_state(recommendation: Column) -> Column:
    return F.when(recommendation == "APPROVE", "APPROVED_PENDING_HUMAN").when(
        recommendation == "DECLINE", "DECLINED_PENDING_HUMAN").otherwise("REFERRED")


def final_state(decision: Column, other: str | None) -> Column:
    """State after a human decision; other: what a decision besides APPROVE and DECLINE gives (None: no change)."""
    out = F.when(decision == "APPROVE", "FINAL_APPROVED").when(decision == "DECLINE", "FINAL_DECLINED")
    return out.otherwise(other) if other else out


def state_of_event(mode: str = "summary") -> Column:
    """The state that an event sets, or null. mode: summary, aggregate or whatif (they differ on floor and reviews)."""
    t, p = F.col("event_type"), F.col("p")
    floor = {"summary": p["recommendation"], "aggregate": recommendation_with_floor(p["recommendation"], p["confidence_score"])}
    decided = floor.get(mode, recommendation_with_floor(p["recommendation"], p["confidence_score"]))
    simple = {
        "ApplicationSubmitted": "SUBMITTED", "CreditAnalysisRequested": "AWAITING_ANALYSIS", "CreditAnalysisCompleted": "ANALYSIS_COMPLETE",
        "ComplianceCheckRequested": "COMPLIANCE_REVIEW", "ComplianceRulePassed": "PENDING_DECISION",
        "ApplicationApproved": "FINAL_APPROVED", "ApplicationDeclined": "FINAL_DECLINED"}
    out = F.when(t == "DecisionGenerated", pending_state(decided)).when(
        t == "HumanReviewCompleted", final_state(p["final_decision"], "REFERRED" if mode == "summary" else None))
    for name, state in simple.items():
        out = out.when(t == name, state)
    return out


def summary_line(event_type: Column, app: Column) -> Column:
    return F.when(F.coalesce(app, F.lit("")) != "", F.concat(event_type, F.lit(" for "), app)).otherwise(event_type)


def iso_timestamp(ts: Column) -> Column:
    """As Python's isoformat prints it: no fraction if it is zero."""
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def narrative() -> Column:
    """One sentence about each event, from event_type and p; absent values print as ?."""
    t, p = F.col("event_type"), F.col("p")
    or_ = lambda f, d="?": F.coalesce(p[f].cast("string"), F.lit(d))
    app = or_("application_id", "")
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    confidence = F.when(p["confidence_score"].isNull(), "").otherwise(F.format_string(" with confidence %.2f", p["confidence_score"]))
    # These sentences are part of stored packages.
    sentences = {
        "ApplicationSubmitted": say("Application ", app, " submitted by ", or_("applicant_id"), " for $", or_("requested_amount_usd"), "."),
        "CreditAnalysisRequested": say("Credit analysis requested for application ", app, "."),
        "CreditAnalysisCompleted": say("Credit analysis completed: risk tier ", or_("risk_tier"), confidence, " (model ", or_("model_version"), ")."),
        "ComplianceCheckRequested": say("Compliance check initiated for application ", app, "."),
        "ComplianceRulePassed": say("Compliance rule '", or_("rule_id"), "' passed for application ", app, "."),
        "ComplianceRuleFailed": say("Compliance rule '", or_("rule_id"), "' failed for application ", app, ": ", or_("failure_reason", ""), "."),
        "FraudScreeningCompleted": say("Fraud screening completed: score ", or_("fraud_score"), ", result ", or_("screening_result"), "."),
        "DecisionGenerated": say("Decision generated: ", or_("recommendation"), " (confidence ", or_("confidence_score"), ")."),
        "HumanReviewCompleted": say(
            "Human reviewer ", or_("reviewer_id"), " recorded final decision: ", or_("final_decision"),
            F.when(F.coalesce(p["override"], F.lit(False)), " (override)").otherwise(""), "."),
        "ApplicationApproved": say("Application ", app, " approved for $", or_("approved_amount_usd"), "."),
        "ApplicationDeclined": say("Application ", app, " declined."),
        "FraudScreeningRequested": say("Fraud screening requested for application ", app, "."),
        "ApplicationWithdrawn": say(
            "Application ", app, " was withdrawn by the applicant",
            F.when(F.coalesce(p["reason"], F.lit("")) != "", say(" (reason: ", p["reason"], ")")).otherwise(""), "."),
        "ComplianceClearanceIssued": say("Final compliance clearance issued for ", app, " by ", or_("cleared_by"), " under ", or_("regulation_set"), "."),
        "AuditStreamInitialised": say("Audit stream initialised for ", or_("entity_type"), " ", app, "."),
        "AuditIntegrityCheckRun": say("Integrity check run: ", or_("events_hashed"), " events hashed."),
    }
    out = None
    for name, sentence in sentences.items():
        out = F.when(t == name, sentence) if out is None else out.when(t == name, sentence)
    return out.otherwise(say("Event ", t, " recorded for application ", app, "."))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def fraud_recommendation(score: Column) -> Column:
    return F.when(score > 0.60, "DECLINE").when(score >= 0.30, "FLAG_FOR_REVIEW").otherwise("PROCEED")


def fraud_risk_level(score: Column) -> Column:
    return F.when(score < 0.2, "LOW").when(score < 0.5, "MEDIUM").otherwise("HIGH")


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(tokens_in / 1e6 * 3 + tokens_out / 1e6 * 15, 6)


def lag_status(lag_s: Column) -> Column:
    return F.when(lag_s > 5, "CRITICAL").when(lag_s > 1, "WARNING").otherwise("OK")


def fact_from_text(text: Column, name: str) -> Column:
    """The number after a fact's name in free text: 'Total Revenue: $1,234' gives 1234."""
    found = F.regexp_extract(text, rf"(?i){name}[:\s]+\$?([\d,]+)", 1)
    return F.regexp_replace(F.nullif(found, F.lit("")), ",", "").cast("double")


def first_json_object(text: Column) -> Column:
    """What stands from the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
