"""State at past moments, snapshots with tails, counterfactual replay, examination packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import as_of, by_category, narrative, recommendation_with_floor, state_of_event, typed
from .integrity import package_row, rows_checksum, verify_chain
from .readmodels import compliance_history, last
from .rules import few_rows

OUTCOME = ("state", "risk_tier", "fraud_score", "compliance_status", "decision", "confidence_score", "final_decision", "human_reviewer_id", "approved_amount_usd")
# Branch events and what depends on each.
DEPENDENTS = [
    (branch, event) for branch in ("CreditAnalysisCompleted", "ComplianceCheckRequested", "FraudScreeningCompleted")
    for event in ("DecisionGenerated", "ApplicationApproved", "ApplicationDeclined", "HumanReviewCompleted")]


def compliance_at(log: DataFrame, moments: DataFrame) -> DataFrame:
    """application_id, moment, rule_id, status: the last result of each rule at or before each (application_id, moment)."""
    h = compliance_history(log).where("rule_id is not null")
    seen = h.join(moments, "application_id").where("recorded_at <= moment")
    return seen.groupBy("application_id", "moment", "rule_id").agg(
        F.max_by(F.when(F.col("event_type") == "ComplianceRulePassed", "PASSED").otherwise("FAILED"), "global_position").alias("status"))


def compliance_snapshots(log: DataFrame, every: int = 50) -> DataFrame:
    """application_id, at (position), rule_id, status after each every-th history row of an application."""
    h = compliance_history(log)
    n = F.row_number().over(W.partitionBy("application_id").orderBy("global_position"))
    h = h.withColumn("n", n).withColumn("snap", F.floor((F.col("n") - 1) / every))
    result = F.when(F.col("event_type") == "ComplianceRulePassed", "PASSED").when(F.col("event_type") == "ComplianceRuleFailed", "FAILED")
    ends = h.groupBy("application_id", "snap").agg(F.max("global_position").alias("at"), F.count("*").alias("size")).where(F.col("size") == every)
    # the last result within each stretch, then carried over the stretches that lack one
    part = h.where("rule_id is not null").groupBy("application_id", "snap", "rule_id").agg(F.max_by(result, "global_position").alias("status"))
    grid = ends.join(part.select("application_id", "rule_id").distinct(), "application_id")
    run = grid.join(part, ["application_id", "snap", "rule_id"], "left").withColumn(
        "status", F.last("status", ignorenulls=True).over(W.partitionBy("application_id", "rule_id").orderBy("snap")))
    return run.where("status is not null").select("application_id", "at", "rule_id", "status")


def state_from_snapshot(log: DataFrame, snapshots: DataFrame, moment) -> DataFrame:
    """application_id, rule_id, status at a moment, from the newest snapshot before it and the events after that."""
    h = as_of(compliance_history(log), moment)
    last_pos = h.groupBy("application_id").agg(F.max("global_position").alias("upto"))
    newest = snapshots.join(last_pos, "application_id").where("at <= upto").groupBy("application_id").agg(F.max("at").alias("at"))
    base = snapshots.join(newest, ["application_id", "at"]).select("application_id", "rule_id", F.col("at").alias("pos"), "status")
    tail = h.where("rule_id is not null").join(newest, "application_id", "left").where("at is null or global_position > at").select(
        "application_id", "rule_id", F.col("global_position").alias("pos"), F.when(F.col("event_type") == "ComplianceRulePassed", "PASSED").otherwise("FAILED").alias("status"))
    return base.unionByName(tail).groupBy("application_id", "rule_id").agg(F.max_by("status", "pos").alias("status"))


def _outcome() -> list[Column]:
    t, p, pos = F.col("event_type"), F.col("p"), "ord"
    decided, credit = t == "DecisionGenerated", t == "CreditAnalysisCompleted"
    reviewed, approved = t == "HumanReviewCompleted", t == "ApplicationApproved"
    state = state_of_event("whatif")
    floor = recommendation_with_floor(p["recommendation"], p["confidence_score"])
    return [
        F.coalesce(last(state, state.isNotNull(), pos), F.lit("SUBMITTED")).alias("state"), last(p["risk_tier"], credit, pos).alias("risk_tier"),
        last(p["fraud_score"], t == "FraudScreeningCompleted", pos).alias("fraud_score"),
        last(F.when(t == "ComplianceRulePassed", "PASSED").otherwise("FAILED"), t.startswith("ComplianceRule"), pos).alias("compliance_status"),
        last(floor, decided, pos).alias("decision"),
        last(F.when(decided, F.coalesce(p["confidence_score"], F.lit(1.0))).otherwise(p["confidence_score"]), decided | credit, pos).alias("confidence_score"),
        last(p["final_decision"], reviewed, pos).alias("final_decision"), last(p["reviewer_id"], reviewed, pos).alias("human_reviewer_id"),
        last(p["approved_amount_usd"], approved, pos).alias("approved_amount_usd")]


def outcome(log: DataFrame) -> DataFrame:
    """Nine fields of each loan stream, folded in stream order."""
    e = typed(by_category(log, "loan-")).withColumn("ord", F.col("stream_position").cast("double"))
    return e.groupBy("stream_id").agg(*_outcome())


def causally_dependent(branch: str, dependents: DataFrame | None = None) -> list[str]:
    """Event types that depend on a branch event, by rows (branch, dependent), DEPENDENTS without; none for an unknown branch."""
    rows = DEPENDENTS if dependents is None else [(r["branch"], r["dependent"]) for r in few_rows(dependents)]
    return sorted({event for b, event in rows if b == branch})


def what_if(log: DataFrame, branch: str, payload: Column, dependents: DataFrame | None = None) -> DataFrame:
    """Per loan stream: real and counterfactual outcome, the fields that differ, events replayed and skipped.

    The first branch event is replaced by one with the given payload; later events that depend on it are dropped. A stream without
    one gets the counterfactual event at its end. dependents: see causally_dependent. Both scenarios are one fold, keyed by stream and scenario.
    """
    e = by_category(log, "loan-").select("stream_id", "stream_position", "event_type", "payload", F.min(
        F.when(F.col("event_type") == branch, F.col("stream_position"))).over(W.partitionBy("stream_id")).alias("at"))
    pos, at = F.col("stream_position"), F.col("at")
    later = F.coalesce(pos > at, F.lit(False))
    skipped = later & F.coalesce(F.col("event_type").isin(causally_dependent(branch, dependents)), F.lit(False))
    real = e.select("stream_id", F.lit("real").alias("scenario"), pos.cast("double").alias("ord"), "event_type", "payload")
    kept = e.where(~skipped & ~F.coalesce(pos == at, F.lit(False)))
    changed = kept.select("stream_id", F.lit("counterfactual").alias("scenario"), pos.cast("double").alias("ord"), "event_type", "payload")
    ends = e.groupBy("stream_id").agg(F.coalesce(F.first("at"), F.max("stream_position") + 1).cast("double").alias("ord"), F.count_if(skipped).alias("events_skipped"))
    event = ends.select("stream_id", F.lit("counterfactual").alias("scenario"), "ord", F.lit(branch).alias("event_type"), payload.alias("payload"))
    folded = typed(real.unionByName(changed).unionByName(event)).groupBy("stream_id", "scenario").agg(*_outcome(), F.count("*").alias("n"))
    r, c = folded.where("scenario = 'real'").alias("r"), folded.where("scenario = 'counterfactual'").alias("c")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"r.{f}").eqNullSafe(F.col(f"c.{f}")), F.lit(f)) for f in OUTCOME)))
    return r.join(c, F.col("r.stream_id") == F.col("c.stream_id")).join(ends.select("stream_id", "events_skipped").alias("s"), F.col("r.stream_id") == F.col("s.stream_id")).select(
        F.col("r.stream_id").alias("stream_id"), F.struct(*(F.col(f"r.{f}") for f in OUTCOME)).alias("real"), F.struct(*(F.col(f"c.{f}") for f in OUTCOME)).alias("counterfactual"),
        differ.alias("divergence"), F.col("c.n").alias("events_replayed"), "events_skipped")


def agent_attribution(log: DataFrame) -> DataFrame:
    """Per loan: the first analysis of each agent and session, and the first decision of each orchestrator."""
    e, p = typed(by_category(log, "loan-")), F.col("p")
    t = F.col("event_type")
    who = F.when(t == "CreditAnalysisCompleted", p["agent_id"]).when(t == "DecisionGenerated", p["orchestrator_agent_id"])
    rows = e.where(t.isin("CreditAnalysisCompleted", "DecisionGenerated")).select(
        "stream_id", who.alias("agent_id"), F.when(t == "CreditAnalysisCompleted", p["session_id"]).alias("session_id"), "event_type", "stream_position",
        p["confidence_score"].alias("confidence_score"))
    return rows.groupBy("stream_id", "agent_id", "session_id", "event_type").agg(
        F.min("stream_position").alias("first_position"), F.min_by("confidence_score", "stream_position").alias("confidence_score"))


def regulatory_package(log: DataFrame, moment) -> DataFrame:
    """Per loan as of a moment: events, outcome, narrative, attribution, chain verdict (over all audit events) and checksum, nested.

    A package holds one loan's events: its size is bounded by the loan.
    """
    log = log.where(F.col("stream_id").startswith("loan-") | F.col("stream_id").startswith("audit-")).checkpoint()  # read by four parts
    own = by_category(as_of(log, moment), "loan-")
    row = F.struct("stream_position", "event_type", "payload", "recorded_at", narrative().alias("sentence"), package_row().alias("row"))
    events = typed(own).select("stream_id", row.alias("e")).groupBy("stream_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    whole = F.transform("e", lambda x: F.struct(*(x[c].alias(c) for c in ("stream_position", "event_type", "payload", "recorded_at"))))
    out = events.select("stream_id", whole.alias("events"), F.col("e.sentence").alias("narrative"), rows_checksum(F.col("e.row")).alias("checksum"))
    agents = agent_attribution(own).groupBy("stream_id").agg(F.collect_list(F.struct("agent_id", "session_id", "event_type", "first_position")).alias("agents"))
    chain = verify_chain(log).select(F.regexp_replace("stream_id", "^audit-", "").alias("stream_id"), "is_valid", "checks")
    state = outcome(own).select("stream_id", F.struct(*OUTCOME).alias("summary"))
    for part in (state, agents, chain):
        out = out.join(part, "stream_id", "left")
    return out
