"""Read models: one row per entity, folded from its events.

A fold is a set of last-writer-wins registers: max(struct(position, value)) over the events that write it. Such maxima merge,
so they are combined before the shuffle and need no sort; a hot application is one partial row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import by_category, parse_audit_stream, session_stream_id, state_of_event, subscribe, summary_line, typed
from ..schema import SESSION_ENDS, SESSION_PARTIAL, SESSION_TYPES

REVIEWED = ("DecisionGenerated", "HumanReviewCompleted")
#: Entries of an array of a running mean at most: positions in a range, and ranges in a coarser one.
RANGE = 4096


def register(value: Column, when: Column, position: str = "global_position") -> Column:
    """pos and v of the event at the highest position among those that match; null values count."""
    return F.max(F.when(when, F.struct(F.col(position).alias("pos"), value.alias("v"))))


def last(value: Column, when: Column, position: str = "global_position") -> Column:
    return register(value, when, position)["v"]


def application_summary(log: DataFrame) -> DataFrame:
    """One row per submitted application, from all streams but audit copies, in global order.

    Nothing counts before an application's first valid submission: a register whose last writer stands before it is empty, so the
    start is one more minimum of the same aggregation. The sessions are in the order they were first seen.
    """
    types = (
        "ApplicationSubmitted", "CreditAnalysisRequested", "CreditAnalysisCompleted", "ComplianceCheckRequested", "ComplianceRulePassed",
        "ComplianceRuleFailed", "FraudScreeningCompleted", "DecisionGenerated", "HumanReviewCompleted", "ApplicationApproved", "ApplicationDeclined")
    e = typed(log.where(~F.col("stream_id").startswith("audit-") & F.col("event_type").isin(*types)))
    t, p, pos = F.col("event_type"), F.col("p"), F.col("global_position")
    submits = (t == "ApplicationSubmitted") & (F.coalesce(p["applicant_id"], F.lit("")) != "")
    # conditions on parsed fields stand in the registers: as filters they would have the payload parsed once more each
    counts = (t != "ApplicationSubmitted") | submits
    e = e.withColumn("app", p["application_id"]).withColumn("set_state", F.when(counts, state_of_event("summary")))
    decided = t == "DecisionGenerated"
    session = session_stream_id(p["agent_id"], p["session_id"])
    fields = {
        "state": register(F.col("set_state"), F.col("set_state").isNotNull()), "applicant_id": register(p["applicant_id"], submits),
        "requested_amount_usd": register(F.coalesce(p["requested_amount_usd"], F.lit(0.0)), submits),
        "risk_tier": register(p["risk_tier"], t == "CreditAnalysisCompleted"),
        "fraud_score": register(F.coalesce(p["fraud_score"], F.lit(0.0)).cast("decimal(5,2)"), t == "FraudScreeningCompleted"),
        "compliance_status": register(F.when(t == "ComplianceRulePassed", "PASSED").otherwise("FAILED"), t.startswith("ComplianceRule")),
        "decision": register(p["recommendation"], decided), "orchestrator_agent_id": register(p["orchestrator_agent_id"], decided),
        "orchestrator_model_version": register(F.try_element_at(p["model_versions"], p["orchestrator_agent_id"]), decided),
        "human_reviewer_id": register(p["reviewer_id"], t == "HumanReviewCompleted"),
        "approved_amount_usd": register(F.coalesce(p["approved_amount_usd"], F.lit(0.0)), t == "ApplicationApproved"),
        "final_decision_at": register(F.col("recorded_at"), t.isin("ApplicationApproved", "ApplicationDeclined")),
        "last_event_type": register(t, counts), "last_event_at": register(F.col("recorded_at"), counts)}
    seen = F.collect_set(F.when(t == "CreditAnalysisCompleted", F.struct(pos.alias("pos"), session.alias("s"))))
    out = e.groupBy("app").agg(F.bool_or(F.col("app") != "").alias("named"), F.min(F.when(submits, pos)).alias("start"), seen.alias("seen"), *(c.alias(n) for n, c in fields.items())).where("start is not null and named")
    after = F.array_sort(F.filter("seen", lambda x: x["pos"] >= F.col("start")))
    return out.select(
        F.col("app").alias("application_id"), *(F.when(F.col(f"{n}.pos") >= F.col("start"), F.col(f"{n}.v")).alias(n) for n in fields),
        F.array_distinct(F.transform(after, lambda x: x["s"])).alias("agent_sessions_completed"))


def review_attribution(log: DataFrame) -> DataFrame:
    """Each human review with the orchestrator and model of the application's last decision before it (as-of by position)."""
    e = typed(subscribe(log, list(REVIEWED))).where(~F.col("stream_id").startswith("audit-"))
    p, before = F.col("p"), W.partitionBy(F.col("p")["application_id"]).orderBy("global_position").rowsBetween(W.unboundedPreceding, -1)
    made = F.when(F.col("event_type") == "DecisionGenerated", F.struct(
        p["orchestrator_agent_id"].alias("agent"), F.try_element_at(p["model_versions"], p["orchestrator_agent_id"]).alias("model")))
    out = e.withColumn("made", F.last(made, ignorenulls=True).over(before))
    return out.where("event_type = 'HumanReviewCompleted'").select(
        "global_position", p["application_id"].alias("application_id"), F.col("made.agent").alias("agent_id"), F.col("made.model").alias("model_version"),
        F.coalesce(p["override"], F.lit(False)).alias("override"), "recorded_at")


def agent_performance(log: DataFrame, streams: str = "all", override_field: str | None = None) -> DataFrame:
    """Counts, averages and rates per agent and model.

    streams: 'all' counts audit and session copies as the stored logs hold them, 'primary' only loan and agent-context streams.
    avg_duration_ms is the running mean that skips durations of 0 but still counts them; 0 without analyses.
    override_field: None reports no overrides; 'override' counts that payload field.
    The log is read and parsed once; its rows of four types are kept for the two folds over them.
    """
    own = log if streams == "all" else log.where(F.col("stream_id").startswith("loan-") | (F.col("event_type") == "AgentContextLoaded"))
    rows = subscribe(own, ["AgentContextLoaded", "CreditAnalysisCompleted", *REVIEWED]).select("stream_id", "global_position", "event_type", "recorded_at", "payload").checkpoint()
    return performance_totals(performance_parts(rows), review_attribution(rows), override_field)


def performance_parts(log: DataFrame) -> DataFrame:
    """Counts and sums per agent, model and range of RANGE positions, and the range's analyses (own: position and ms).

    One aggregation with bounded groups: a hot agent is many of them, and a stream folds it as it is, in any order. An event that
    a source delivers twice counts twice.
    """
    e, t, p = typed(subscribe(log, ["AgentContextLoaded", "CreditAnalysisCompleted", "DecisionGenerated"])), F.col("event_type"), F.col("p")
    decided, analysed = t == "DecisionGenerated", t == "CreditAnalysisCompleted"
    agent = F.when(decided, p["orchestrator_agent_id"]).otherwise(p["agent_id"])
    model = F.when(decided, F.try_element_at(p["model_versions"], p["orchestrator_agent_id"])).otherwise(p["model_version"])
    own = F.struct("global_position", F.coalesce(p["analysis_duration_ms"], F.lit(0.0)).alias("ms"))
    said = lambda rec: F.count_if(decided & (p["recommendation"] == rec))
    keyed = e.withColumns({"agent_id": agent, "model_version": model, "part": F.floor(F.col("global_position") / RANGE)})
    return keyed.where("agent_id is not null and model_version is not null").groupBy("agent_id", "model_version", "part").agg(
        F.count_if(analysed).alias("analyses"), F.count_if(decided).alias("decisions"), F.coalesce(F.sum(F.when(decided, F.coalesce(p["confidence_score"], F.lit(0.0)))), F.lit(0.0)).alias("confidence"),
        said("APPROVE").alias("approved"), said("DECLINE").alias("declined"), said("REFER").alias("referred"),
        F.min("recorded_at").alias("first_seen_at"), F.max("recorded_at").alias("last_seen_at"), F.array_sort(F.collect_list(F.when(analysed, own))).alias("own"))


def performance_totals(parts: DataFrame, reviews: DataFrame, override_field: str | None = None) -> DataFrame:
    """agent_performance from performance_parts and review_attribution, also from those that a stream keeps.

    The analysis after k others takes the mean m to (m * k + ms) / (k + 1), and leaves it where ms is 0: an affine map of m.
    The maps of a range compose to one, those of RANGE such ranges again. k is the sum of what stands before: over coarse
    ranges, then over the ranges in one, so that no task holds all ranges of an agent.
    """
    keys = ["agent_id", "model_version"]
    coarse = [*keys, "coarse"]
    parts = parts.withColumn("coarse", F.floor(F.col("part") / RANGE)).checkpoint()
    offsets = parts.groupBy(*coarse).agg(F.sum("analyses").alias("n"))
    offsets = offsets.select(*coarse, (F.sum("n").over(W.partitionBy(*keys).orderBy("coarse")) - F.col("n")).alias("before"))
    state = lambda a, b, k: F.struct(a.alias("a"), b.alias("b"), k.alias("k"))
    step = lambda m, x: state(
        F.when(x["ms"] > 0, m["a"] * m["k"] / (m["k"] + 1)).otherwise(m["a"]),
        F.when(x["ms"] > 0, (m["b"] * m["k"] + x["ms"]) / (m["k"] + 1)).otherwise(m["b"]), m["k"] + 1)
    k = F.col("before") + F.sum("analyses").over(W.partitionBy(*coarse).orderBy("part")) - F.col("analyses")
    maps = parts.join(offsets, coarse).withColumn("k", k.cast("double")).withColumn("m", F.aggregate("own", state(F.lit(1.0), F.lit(0.0), F.col("k")), step)).drop("own")
    sums = ("analyses", "decisions", "confidence", "approved", "declined", "referred")
    then = lambda m, x: F.struct((x["a"] * m["a"]).alias("a"), (x["a"] * m["b"] + x["b"]).alias("b"))
    for level, place in ((coarse, "part"), (keys, "coarse")):
        own = F.array_sort(F.collect_list(F.struct(place, "m.a", "m.b")))
        maps = maps.groupBy(*level).agg(*(F.sum(c).alias(c) for c in sums), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), own.alias("own"))
        maps = maps.withColumn("m", F.aggregate("own", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), then)).drop("own")
    overridden = F.count_if("override") if override_field else F.lit(0).cast("long")
    seen = reviews.where("agent_id is not null and model_version is not null").groupBy(*keys).agg(
        F.count("*").alias("reviews"), overridden.alias("overrides"), F.min("recorded_at").alias("first"), F.max("recorded_at").alias("last"))
    none = lambda c: F.coalesce(c, F.lit(0))
    rate = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("decisions"), F.lit(0)), F.lit(0.0))
    return maps.join(seen, keys, "full_outer").select(
        *keys, none(F.col("analyses")).alias("analyses_completed"), none(F.col("decisions")).alias("decisions_generated"), (F.col("confidence") / F.nullif(F.col("decisions"), F.lit(0))).alias("avg_confidence_score"),
        rate("approved").alias("approve_rate"), rate("declined").alias("decline_rate"), rate("referred").alias("refer_rate"),
        none(F.col("reviews")).alias("human_reviews_total"), none(F.col("overrides")).alias("human_overrides_total"),
        F.least("first_seen_at", "first").alias("first_seen_at"), F.greatest("last_seen_at", "last").alias("last_seen_at"), F.coalesce("m.b", F.lit(0.0)).alias("avg_duration_ms"))


def compliance_events(log: DataFrame) -> DataFrame:
    e = typed(log.where(F.col("event_type").isin("ComplianceCheckRequested", "ComplianceRulePassed", "ComplianceRuleFailed")))
    p = F.col("p")
    return e.where(p["application_id"].isNotNull()).select(
        p["application_id"].alias("application_id"), "global_position", "event_type", p["rule_id"].alias("rule_id"), "recorded_at")


def compliance_history(log: DataFrame) -> DataFrame:
    """Compliance events, once per application and position."""
    return compliance_events(log).dropDuplicates(["application_id", "global_position"])


def compliance_registers(log: DataFrame) -> DataFrame:
    """application_id, rule_id, status, last_updated: the last result of each rule; a row without rule for events that name none.

    One aggregation of maxima, which events that come twice don't change, so a stream folds it as well.
    """
    asked = F.col("event_type") == "ComplianceCheckRequested"
    result = F.when(F.col("event_type") == "ComplianceRulePassed", "PASSED").otherwise("FAILED")
    e = compliance_events(log).withColumn("rule_id", F.when(~asked, F.col("rule_id")))
    return e.groupBy("application_id", "rule_id").agg(
        F.max_by(F.when(F.col("rule_id").isNotNull(), result), "global_position").alias("status"), F.max("recorded_at").alias("last_updated"))


def compliance_rules(log: DataFrame) -> DataFrame:
    """application_id, rule_id, status: the last result of each rule."""
    return compliance_registers(log).where("rule_id is not null").drop("last_updated")


def compliance_current(log: DataFrame) -> DataFrame:
    """Per application: counts of passed and failed rules, overall status and the last update.

    PASSED if every rule passed, FAILED if one failed, IN_PROGRESS after a request without results.
    """
    return compliance_totals(compliance_registers(log))


def compliance_totals(registers: DataFrame) -> DataFrame:
    """compliance_current from compliance_registers, also from those that a stream keeps."""
    out = registers.groupBy("application_id").agg(
        F.max("last_updated").alias("last_updated"), F.count_if(F.col("status") == "PASSED").alias("passed"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    return out.withColumn("overall_status", F.when(F.col("failed") > 0, "FAILED").when(F.col("passed") > 0, "PASSED").otherwise("IN_PROGRESS"))


def audit_trail(log: DataFrame) -> DataFrame:
    """Rows of the audit copies of loans, with the stream they were copied from; once per application and position."""
    e = by_category(log, "audit-loan-")
    return e.select(
        parse_audit_stream(F.col("stream_id"))["entity_id"].alias("application_id"), "global_position", "event_type",
        F.coalesce(F.get_json_object("metadata", "$.source_stream_id"), F.col("stream_id")).alias("source_stream_id"), "recorded_at",
    ).dropDuplicates(["application_id", "global_position"])


def agent_session_view(log: DataFrame, tail: int = 3) -> DataFrame:
    """Per agent stream, from the subscribed types: identity, last action, pending work, older events as lines, the last ones whole."""
    e = typed(by_category(subscribe(log, list(SESSION_TYPES)), "agent-"))
    t, p, pos = F.col("event_type"), F.col("p"), "stream_position"
    begins, partial = t.isin("AgentContextLoaded", "DecisionOrchestratorSessionStarted"), t.isin(*SESSION_PARTIAL)
    e = e.withColumn("back", F.row_number().over(W.partitionBy("stream_id").orderBy(F.desc(pos))))
    line = F.struct(F.col(pos), summary_line(t, p["application_id"]).alias("line"))
    out = e.groupBy("stream_id").agg(
        last(F.coalesce(p["agent_id"], F.lit("unknown")), begins, pos).alias("agent_id"),
        last(F.coalesce(p["model_version"], F.lit("unknown")), begins, pos).alias("model_version"),
        F.coalesce(last(~t.isin(*SESSION_ENDS), begins | t.isin(*SESSION_ENDS), pos), F.lit(True)).alias("is_active"),
        last(t, ~partial, pos).alias("last_completed_action"), last(F.when(partial, t), F.lit(True), pos).alias("pending_work"),
        last(partial, F.lit(True), pos).alias("needs_reconciliation"), F.count("*").alias("total_events"),
        F.array_sort(F.collect_list(F.when(F.col("back") > tail, line))).alias("older"),
        F.array_sort(F.collect_list(F.when(F.col("back") <= tail, F.struct(F.col(pos), t.alias("event_type"), F.col("payload"))))).alias("recent_events"))
    return out.withColumn("summary", F.transform("older", lambda x: x["line"])).drop("older").withColumnRenamed("stream_id", "session_id")


def evaluation_backlog(log: DataFrame) -> DataFrame:
    return application_summary(log).groupBy("state").agg(F.count("*").alias("n"))
