"""Business rules over stored logs: which events break the state machine or a guard, for all streams at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import by_category, state_of_event, typed
from ..schema import CONFIDENCE_FLOOR

# The states from which each event is allowed.
ALLOWED_FROM = {
    "CreditAnalysisRequested": ("SUBMITTED",),
    "CreditAnalysisCompleted": ("AWAITING_ANALYSIS", "ANALYSIS_COMPLETE"),
    "ComplianceCheckRequested": ("ANALYSIS_COMPLETE",),
    "ComplianceRulePassed": ("COMPLIANCE_REVIEW",),
    "ComplianceRuleFailed": ("COMPLIANCE_REVIEW",),
    "DecisionGenerated": ("PENDING_DECISION",),
    "HumanReviewCompleted": ("APPROVED_PENDING_HUMAN", "DECLINED_PENDING_HUMAN", "REFERRED"),
}


def with_prior(log: DataFrame) -> DataFrame:
    """Loan events with what held before each: state, whether a model was recorded, override and compliance flags."""
    e = typed(by_category(log, "loan-")).withColumn("set_state", state_of_event("aggregate"))
    t, p = F.col("event_type"), F.col("p")
    before = W.partitionBy("stream_id").orderBy("stream_position").rowsBetween(W.unboundedPreceding, -1)
    prior = lambda c, none: F.coalesce(F.last(c, ignorenulls=True).over(before), none)
    analysed = F.when((t == "CreditAnalysisCompleted") & (F.coalesce(p["model_version"], F.lit("")) != ""), True)
    override = F.when(t == "HumanReviewOverride", True).when(t == "HumanReviewCompleted", F.coalesce(p["override"], F.lit(False)))
    passed = F.when(t == "ComplianceRulePassed", True).when(t == "ComplianceRuleFailed", False)
    return e.withColumns({
        "prior_state": prior(F.col("set_state"), F.lit("SUBMITTED")), "had_model": prior(analysed, F.lit(False)),
        "had_override": prior(override, F.lit(False)), "was_passed": prior(passed, F.lit(False))})


def _checks() -> dict[str, Column]:
    t, p = F.col("event_type"), F.col("p")
    state = F.lit(False)
    for name, states in ALLOWED_FROM.items():
        state = state | ((t == name) & ~F.col("prior_state").isin(*states))
    low = F.coalesce(p["confidence_score"] < CONFIDENCE_FLOOR, F.lit(False))
    return {
        # in the order in which a writer would meet them
        "model_version_locking": (t == "CreditAnalysisCompleted") & F.col("had_model") & ~F.col("had_override"),
        "state_machine": state,
        "causal_chain": (t == "DecisionGenerated") & (F.coalesce(F.size(p["contributing_agent_sessions"]), F.lit(0)) <= 0),
        "confidence_floor": (t == "DecisionGenerated") & low & ~p["recommendation"].eqNullSafe(F.lit("REFER")),
        "compliance_dependency": (t == "ApplicationApproved") & ~F.col("was_passed"),
    }


def audit_transitions(log: DataFrame) -> DataFrame:
    """Events that break a rule, with the first rule they break and the state they came from."""
    first = F.coalesce(*(F.when(broken, F.lit(rule)) for rule, broken in _checks().items()))
    return with_prior(log).withColumn("rule_name", first).where("rule_name is not null").select(
        "stream_id", "stream_position", "event_type", "prior_state", "rule_name")


def rule_violations(log: DataFrame, rule: str) -> DataFrame:
    """All events that break one rule, whatever else they break."""
    return with_prior(log).where(_checks()[rule]).select("stream_id", "stream_position", "global_position", "event_type")


def override_needs_reason(log: DataFrame) -> DataFrame:
    e, p = typed(log), F.col("p")
    asked = (F.col("event_type") == "HumanReviewOverride") | ((F.col("event_type") == "HumanReviewCompleted") & F.coalesce(p["override"], F.lit(False)))
    return e.where(asked & (F.coalesce(p["override_reason"], F.lit("")) == "")).select("global_position", p["application_id"].alias("application_id"), "event_type")


def session_protocol(log: DataFrame) -> DataFrame:
    """Agent events that come before their context, and contexts that are not the first event."""
    e = by_category(log, "agent-")
    loads = (F.col("event_type") == "AgentContextLoaded").cast("int")
    before = F.coalesce(F.sum(loads).over(W.partitionBy("stream_id").orderBy("stream_position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    late = (loads == 1) & (F.col("stream_position") > 1)
    early = F.col("event_type").isin("CreditAnalysisCompleted", "FraudScreeningCompleted", "DecisionGenerated") & (F.col("before") == 0)
    out = e.withColumn("before", before).withColumn("rule_name", F.when(late, "context_must_be_first").when(early, "context_required"))
    return out.where("rule_name is not null").select("stream_id", "stream_position", "event_type", "rule_name")


def model_version_mismatch(log: DataFrame) -> DataFrame:
    """Analyses whose model differs from the one their session's context locked."""
    e = typed(log)
    own = e.where("event_type = 'AgentContextLoaded'").groupBy(F.col("stream_id").alias("session")).agg(F.max_by(F.col("p")["model_version"], "stream_position").alias("locked"))
    p = F.col("p")
    done = e.where(F.col("event_type") == "CreditAnalysisCompleted").select(
        "global_position", F.concat_ws("-", F.lit("agent"), p["agent_id"], p["session_id"]).alias("session"), p["model_version"].alias("declared"))
    return done.join(own, "session").where("declared is not null and declared != locked")


def validate_commands(df: DataFrame, rules: list[tuple[str, Column, Column | str, Column | str]]) -> DataFrame:
    """df with errors, an array of (error_type, message, suggested_action) of the rules that fail, and is_valid.

    rules: error type, what must hold, message, suggested action, as outcomes.command_rules gives them. Unknown counts as not held.
    """
    return df.withColumn("errors", rule_errors(rules)).withColumn("is_valid", F.size("errors") == 0)


def rule_errors(rules: list[tuple[str, Column, Column | str, Column | str]]) -> Column:
    """The array of errors of the rules that fail, in their order."""
    error = lambda *texts: F.struct(*((F.lit(x) if isinstance(x, str) else x).alias(n) for x, n in zip(texts, ("error_type", "message", "suggested_action"), strict=True)))
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), error(kind, say, do)) for kind, ok, say, do in rules)))


def evaluate_regulations(apps: DataFrame, as_of_year: int, rules: DataFrame | None = None) -> DataFrame:
    """One row per application and rule evaluated; evaluation stops at the first hard block.

    apps: application_id and the fields that rules name, such as jurisdiction, legal_type, founded_year, requested_amount, aml_watch and
    sanctions. rules: rows of RULE_DDL, REGULATIONS without. age_years is the age of the applicant; an unknown year of foundation
    counts as as_of_year. A condition on an unknown doesn't hold, so the rule passes.
    """
    held = apps if "founded_year" not in apps.columns else apps.withColumn("age_years", F.lit(as_of_year) - F.coalesce("founded_year", F.lit(as_of_year)))
    table = compiled(apps.sparkSession.createDataFrame(REGULATIONS, RULE_DDL) if rules is None else rules, held)
    if not table:
        return held.where("false").select("application_id", F.lit("").alias("rule_id"), F.lit("").alias("status"), F.lit(False).alias("is_block"))
    status = lambda hit, action: F.when(hit, "NOTED" if action == "NOTE" else "FAILED").otherwise("PASSED")
    rows = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(r).alias("rule_id"), status(hit, action).alias("status"), (F.lit(hard and action == "FAIL") & hit).alias("block")) for i, (r, hit, action, hard) in enumerate(table)))
    stop = F.array_min(F.transform(F.filter(rows, lambda x: x["block"]), lambda x: x["ordinal"]))
    out = held.withColumn("stop", F.coalesce(stop, F.lit(len(table)))).withColumn("r", F.explode(rows)).where("r.ordinal <= stop")
    return out.select("application_id", "r.rule_id", "r.status", F.col("r.block").alias("is_block"))


#: A rule takes its action where all of its conditions hold: FAIL or NOTE. One without a condition always does. A hard one that fails blocks.
RULE_DDL = "ordinal int, rule_id string, field string, operator string, value string, action string, hard boolean"
# The regulations of stored logs.
REGULATIONS = [
    (1, "REG-001", "aml_watch", "=", "true", "FAIL", False), (2, "REG-002", "sanctions", "=", "true", "FAIL", True),
    (3, "REG-003", "jurisdiction", "=", "MT", "FAIL", True), (4, "REG-004", "legal_type", "=", "Sole Proprietor", "FAIL", False),
    (4, "REG-004", "requested_amount", ">", "250000", "FAIL", False), (5, "REG-005", "age_years", "<", "2", "FAIL", True),
    (6, "REG-006", None, None, None, "NOTE", False)]
OPERATORS = {
    "=": lambda c, v: c == v(0), "!=": lambda c, v: c != v(0), "<": lambda c, v: c < v(0), "<=": lambda c, v: c <= v(0), ">": lambda c, v: c > v(0), ">=": lambda c, v: c >= v(0),
    "in": lambda c, v: c.isin(v()), "not in": lambda c, v: ~c.isin(v())}


def compiled(rules: DataFrame, df: DataFrame) -> list[tuple[str, Column, str, bool]]:
    """Rule, whether its conditions hold (never null), action and whether it is hard, in order of ordinal and rule_id.

    A value is read as the type of df's field; lists of in and not in are split at commas. Unknown fields, operators, actions
    and values that don't fit the field are errors, found when the plan is made.
    """
    out: dict[tuple, list] = {}
    for r in sorted(few_rows(rules), key=lambda r: (r["ordinal"], r["rule_id"])):
        if r["action"] not in ("FAIL", "NOTE") or (r["field"] is not None and (r["field"] not in df.columns or r["operator"] not in OPERATORS or r["value"] is None)):
            raise ValueError(f"rule {r['rule_id']}: unknown field, operator or action, or no value, in {r.asDict()}")
        rule = out.setdefault((r["ordinal"], r["rule_id"]), [F.lit(True), r["action"], bool(r["hard"])])
        if rule[1:] != [r["action"], bool(r["hard"])]:
            raise ValueError(f"rule {r['rule_id']}: its rows differ in action or hard")
        if r["field"] is not None:
            kind, text = df.schema[r["field"]].dataType, r["value"]

            def value(at: int | None = None, kind=kind, text=text):
                return F.lit(text).cast(kind) if at is not None else [F.lit(x.strip()).cast(kind) for x in text.split(",")]

            rule[0] = rule[0] & F.coalesce(OPERATORS[r["operator"]](F.col(r["field"]), value), F.lit(False))
    return [(rule, *rest) for (_, rule), rest in out.items()]


def few_rows(table: DataFrame, most: int = 1000) -> list:
    """The rows of a table of rules; one of more than most rows is an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of rules has more than {most} rows")
    return rows


def compliance_verdict(evaluated: DataFrame) -> DataFrame:
    """Per application: BLOCKED, CONDITIONAL (soft failures) or CLEAR, counts, failed rules in order."""
    s = F.col("status")
    return evaluated.groupBy("application_id").agg(
        F.count_if(s == "PASSED").alias("passed"), F.count_if(s == "FAILED").alias("failed"), F.count_if(s == "NOTED").alias("noted"),
        F.bool_or("is_block").alias("blocked"), F.array_join(F.array_sort(F.collect_list(F.when(s == "FAILED", F.col("rule_id")))), ",").alias("failed_rules")).select(
        "application_id", "passed", "failed", "noted", "failed_rules", F.when(F.col("blocked"), "BLOCKED").when(F.col("failed") > 0, "CONDITIONAL").otherwise("CLEAR").alias("verdict"))


def decision_constraints(rows: DataFrame) -> DataFrame:
    """rows (verdict, confidence, fraud_score, risk_tier, recommendation) with the final recommendation and the constraints applied.

    Later constraints override earlier ones: a blocked application with a low confidence is referred. A confidence of 0 or
    null counts as 0.5.
    """
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.5).otherwise(F.col("confidence"))
    # Names in stored logs.
    steps = [
        ("COMPLIANCE_BLOCKED", F.col("verdict") == "BLOCKED", "DECLINE"), ("CONFIDENCE_FLOOR", confidence < CONFIDENCE_FLOOR, "REFER"),
        ("FRAUD_SCORE_THRESHOLD", F.col("fraud_score") > 0.60, "REFER"), ("HIGH_RISK_CONFIDENCE_FLOOR", (F.col("risk_tier") == "HIGH") & (confidence < 0.70), "REFER")]
    final = F.col("recommendation")
    for _, hit, to in steps:
        final = F.when(F.coalesce(hit, F.lit(False)), to).otherwise(final)
    names = F.array_join(F.array_compact(F.array(*(F.when(hit, F.lit(n)) for n, hit, _ in steps))), ",")
    return rows.withColumn("final_recommendation", final).withColumn("constraints", names)
