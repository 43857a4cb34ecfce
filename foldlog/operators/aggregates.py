"""Aggregate states of loans, sessions, compliance records and audit streams, for all streams at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import by_category, clean_app_id, state_of_event, summary_line, typed
from ..schema import CONTEXT_PARTIAL, SESSION_ENDS
from .readmodels import last

POS = "stream_position"


def loan_state(log: DataFrame) -> DataFrame:
    """Per loan stream: state, models that analysed it, override and compliance flags, sessions of the last decision."""
    e = typed(by_category(log, "loan-")).withColumn("set_state", state_of_event("aggregate"))
    t, p = F.col("event_type"), F.col("p")
    reviewed = t.isin("HumanReviewCompleted", "HumanReviewOverride")
    return e.groupBy("stream_id").agg(
        F.coalesce(last(F.col("set_state"), F.col("set_state").isNotNull(), POS), F.lit("SUBMITTED")).alias("state"),
        F.array_sort(F.collect_set(F.when(t == "CreditAnalysisCompleted", F.nullif(p["model_version"], F.lit(""))))).alias("model_versions"),
        F.coalesce(last(F.when(t == "HumanReviewOverride", True).otherwise(F.coalesce(p["override"], F.lit(False))), reviewed, POS), F.lit(False)).alias("has_human_override"),
        F.coalesce(last(t == "ComplianceRulePassed", t.isin("ComplianceRulePassed", "ComplianceRuleFailed"), POS), F.lit(False)).alias("is_compliance_passed"),
        F.coalesce(last(p["contributing_agent_sessions"], t == "DecisionGenerated", POS), F.array().cast("array<string>")).alias("contributing_sessions"),
        F.max(POS).alias("version"))


def session_state(log: DataFrame) -> DataFrame:
    """Per agent stream: whether the context was loaded, activity, identity and the applications it worked on."""
    e, t, p = typed(by_category(log, "agent-")), F.col("event_type"), F.col("p")
    loads = t == "AgentContextLoaded"
    return e.groupBy("stream_id").agg(
        F.bool_or(loads).alias("context_loaded"), F.coalesce(last(loads, loads | t.isin(*SESSION_ENDS), POS), F.lit(False)).alias("is_active"),
        last(p["agent_id"], loads, POS).alias("agent_id"), last(p["model_version"], loads, POS).alias("model_version"),
        F.array_sort(F.collect_set(F.when(~loads, clean_app_id(p["application_id"])))).alias("contributed_apps"), F.max(POS).alias("version"))


def compliance_rule_registers(log: DataFrame) -> DataFrame:
    """stream_id, rule_id, ok, required: the last result of each rule of a compliance stream; a row without rule holds what was last required.

    One aggregation of registers, which a stream folds as well.
    """
    e, t, p = typed(by_category(log, "compliance-")), F.col("event_type"), F.col("p")
    result = t.isin("ComplianceRulePassed", "ComplianceRuleFailed") & p["rule_id"].isNotNull()
    asks = (t == "ComplianceCheckRequested") & (F.size(p["required_rules"]) > 0)
    return e.groupBy("stream_id", F.when(result, p["rule_id"]).alias("rule_id")).agg(
        last(t == "ComplianceRulePassed", result, POS).alias("ok"), last(p["required_rules"], asks, POS).alias("required"))


def compliance_record_totals(registers: DataFrame) -> DataFrame:
    """compliance_record from compliance_rule_registers."""
    rules = lambda ok: F.array_sort(F.collect_list(F.when(F.col("ok") == ok, F.col("rule_id"))))
    out = registers.groupBy("stream_id").agg(
        rules(True).alias("passed"), rules(False).alias("failed"), F.coalesce(F.max(F.when(F.col("rule_id").isNull(), F.col("required"))), F.array().cast("array<string>")).alias("required"))
    return out.withColumn("missing", F.array_except("required", "passed")).withColumn("is_passed", F.when(F.size("required") > 0, F.size("missing") == 0).otherwise(
        (F.size("failed") == 0) & (F.size("passed") > 0)))


def compliance_record(log: DataFrame) -> DataFrame:
    """Per compliance stream: last result of each rule, required rules, whether all that is required passed."""
    return compliance_record_totals(compliance_rule_registers(log))


def uncovered_at_approval(log: DataFrame) -> DataFrame:
    """application_id, approved_at and uncovered: approved applications, and the rules that were required and not passed when they were approved.

    What was last required, and the last result of each rule, both before the (last) approval's position count. Applications
    with all required rules passed, or with none required, have no row.
    """
    t, p = F.col("event_type"), F.col("p")
    approved = by_category(log, "loan-").where("event_type = 'ApplicationApproved'").groupBy(F.regexp_replace("stream_id", "^loan-", "").alias("application_id")).agg(F.max("global_position").alias("approved_at"))
    e = typed(by_category(log, "compliance-")).withColumn("application_id", F.regexp_replace("stream_id", "^compliance-", ""))
    before = e.join(approved, "application_id").where(F.col("global_position") < F.col("approved_at"))
    result = t.isin("ComplianceRulePassed", "ComplianceRuleFailed") & p["rule_id"].isNotNull()
    registers = before.groupBy("application_id", "approved_at", F.when(result, p["rule_id"]).alias("rule_id")).agg(
        last(t == "ComplianceRulePassed", result, "global_position").alias("ok"),
        last(p["required_rules"], (t == "ComplianceCheckRequested") & (F.size(p["required_rules"]) > 0), "global_position").alias("required"))
    out = registers.groupBy("application_id", "approved_at").agg(
        F.max(F.when(F.col("rule_id").isNull(), F.col("required"))).alias("required"), F.collect_list(F.when(F.col("ok"), F.col("rule_id"))).alias("passed"))
    left = F.array_sort(F.array_except("required", "passed"))
    return out.withColumn("uncovered", left).where(F.size("uncovered") > 0).select("application_id", "approved_at", "uncovered")


def clearance_events(log: DataFrame) -> DataFrame:
    """Positions at which a compliance stream turns from not passed to passed (all rules seen so far passed last)."""
    e = typed(by_category(log, "compliance-")).where(F.col("event_type").isin("ComplianceRulePassed", "ComplianceRuleFailed"))
    ok, rule = (F.col("event_type") == "ComplianceRulePassed").cast("int"), F.col("p")["rule_id"]
    e = e.select("stream_id", POS, "global_position", ok.alias("ok"), rule.alias("rule_id"))
    before = F.lag("ok").over(W.partitionBy("stream_id", "rule_id").orderBy(POS))
    # rules that fail now = rules seen failing less those mended: a running sum of each rule's changes
    change = F.when(before.isNull(), 1 - F.col("ok")).otherwise(before - F.col("ok"))
    run = e.withColumn("change", change).withColumn("failing", F.sum("change").over(W.partitionBy("stream_id").orderBy(POS)))
    run = run.withColumn("passed", F.col("failing") == 0).withColumn("was", F.lag("passed", 1, False).over(W.partitionBy("stream_id").orderBy(POS)))
    return run.where("passed and not was").select("stream_id", POS, "global_position")


def audit_state(log: DataFrame) -> DataFrame:
    """Per audit stream: the last integrity hash and the number of checks."""
    e, t = typed(by_category(log, "audit-")), F.col("event_type")
    check = t == "AuditIntegrityCheckRun"
    return e.groupBy("stream_id").agg(last(F.col("p")["integrity_hash"], check, POS).alias("last_hash"), F.count_if(check).alias("checks"))


def agent_context(log: DataFrame, tail: int = 3) -> DataFrame:
    """Per agent stream, over all its events: what an agent needs to go on after a crash.

    The array of a stream's events is bounded by the stream, as is its use by the agent.
    """
    e, t, p = typed(by_category(log, "agent-")), F.col("event_type"), F.col("p")
    partial = t.isin(*CONTEXT_PARTIAL)
    back = F.row_number().over(W.partitionBy("stream_id").orderBy(F.desc(POS)))
    line = F.struct(F.col(POS), summary_line(t, p["application_id"]).alias("line"))
    out = e.withColumn("back", back).groupBy("stream_id").agg(
        F.min_by(p["agent_id"], POS).alias("agent_id"), F.min_by(p["model_version"], POS).alias("model_version"),
        F.max_by(~t.isin(*SESSION_ENDS), POS).alias("is_active"), last(t, ~partial, POS).alias("last_completed_action"),
        F.max_by(F.when(partial, t), POS).alias("pending"), F.count("*").alias("total_events"), F.max(POS).alias("last_event_position"),
        F.array_sort(F.collect_list(F.when(F.col("back") > tail, line))).alias("older"),
        F.array_sort(F.collect_list(F.when(F.col("back") <= tail, F.struct(F.col(POS), t.alias("event_type"), F.col("payload"))))).alias("recent_events"))
    return out.select(
        F.col("stream_id").alias("session_id"), "agent_id", "model_version", "is_active", "last_completed_action", F.col("pending").alias("pending_work"),
        "total_events", "last_event_position", F.array_join(F.transform("older", lambda x: x["line"]), "\n").alias("context_text"),
        F.when(F.col("pending").isNotNull(), "NEEDS_RECONCILIATION").otherwise("OK").alias("session_health_status"), "recent_events")
