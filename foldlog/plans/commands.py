"""Registered queries over commands, decisions and what follows from them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission as A
from ..operators import aggregates as G
from ..operators import facts as D
from ..operators import outcomes as O
from ..operators import quality as Q
from ..operators import rules as U
from ..sources.stored import stored
from .fixtures import LOG, events_log, table
from .stages import _PK, packages
from .tables import CO, applications

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_lacks = lambda fact: f"coalesce(max(CASE WHEN fact = '{fact}' THEN CAST(value AS DOUBLE) END), 0) = 0"


@query("g19_deferrals", f"""{_PK}, t AS (
  SELECT p.stream_id, {_lacks("total_revenue")} AS r, {_lacks("net_income")} AS n, {_lacks("total_assets")} AS a
  FROM (SELECT DISTINCT stream_id FROM pk) p LEFT JOIN m ON p.stream_id = m.stream_id AND fact <> 'extraction_notes' GROUP BY p.stream_id)
SELECT stream_id, CAST(r AS INT) + CAST(n AS INT) + CAST(a AS INT) >= 2 AS is_deferred,
  concat_ws(',', CASE WHEN r THEN 'Missing critical field: total_revenue' END, CASE WHEN n THEN 'Missing critical field: net_income' END,
    CASE WHEN a THEN 'Missing critical field: total_assets' END) AS issues FROM t""")
def _deferrals(s, d):
    return D.deferrals(packages(s, d)).withColumn("issues", F.array_join("issues", ","))


@query("r13_fraud_anomalies", """SELECT 'fraud-APP-' || l_orderkey AS stream_id, 'FraudAnomalyDetected' AS event_type,
  '{"application_id":"APP-' || l_orderkey || '","anomaly_type":"T' || l_suppkey % 5 || '","severity":"' || CASE l_returnflag WHEN 'A' THEN 'HIGH' ELSE 'MEDIUM' END
  || '","evidence":"line ' || l_linenumber || '","affected_fields":' || CASE WHEN l_linenumber % 2 = 0 THEN '[]' ELSE '["ebitda","f' || l_linenumber || '"]' END || '}' AS payload
FROM lineitem WHERE l_returnflag <> 'N'""")
def _anomalies(s, d):
    n = F.col("l_linenumber")
    anomaly = F.struct(
        F.concat(F.lit("T"), F.col("l_suppkey") % 5).alias("type"), F.when(F.col("l_returnflag") == "A", "HIGH").when(F.col("l_returnflag") == "R", "MEDIUM").otherwise("LOW").alias("severity"),
        F.concat(F.lit("line "), n).alias("evidence"), F.when(n % 2 == 1, F.array(F.lit("ebitda"), F.concat(F.lit("f"), n))).alias("affected_fields"))
    return O.fraud_anomaly_events(table(s, d, "lineitem").groupBy(F.concat(F.lit("APP-"), "l_orderkey").alias("application_id")).agg(F.collect_list(anomaly).alias("anomalies")))


@query("r15_credit_fallback", CO + """SELECT application_id, 'MEDIUM' AS risk_tier, CAST(trunc(0.75::DOUBLE * requested_amount) AS BIGINT) AS limit_usd, 0.45::DOUBLE AS confidence,
  'Automated analysis failed (no answer for ' || application_id || '). Human review required.' AS rationale,
  'Automated analysis error — human review required' AS concerns, 'ANALYSIS_FALLBACK' AS overrides FROM ap""")
def _fallback(s, d):
    return O.credit_fallback(applications(s, d).withColumn("error", F.concat(F.lit("no answer for "), "application_id"))).select(
        "application_id", "risk_tier", "limit_usd", "confidence", "rationale", F.array_join("key_concerns", ";").alias("concerns"), F.array_join("policy_overrides_applied", ";").alias("overrides"))


@query("r17_decision_outcomes", """WITH x AS (SELECT 'APP-' || o_orderkey AS id, o_orderkey % 13 = 0 AS blocked, CASE WHEN o_orderkey % 100 = 0 THEN 0.5 ELSE (o_orderkey % 100) / 100.0 END AS c,
  (o_orderkey % 71) / 71.0 AS f, o_orderkey % 3 = 2 AS high, CAST(floor(o_totalprice) AS BIGINT) AS amount, CASE WHEN o_orderkey % 2 = 1 THEN '["quarterly report"]' ELSE '[]' END AS conditions FROM orders),
y AS (SELECT *, CASE WHEN high AND c < 0.7 OR f > 0.6 OR c < 0.6 THEN 'REFER' WHEN blocked THEN 'DECLINE' ELSE 'APPROVE' END AS r,
  concat_ws(', ', CASE WHEN blocked THEN '''COMPLIANCE_BLOCKED''' END, CASE WHEN c < 0.6 THEN '''CONFIDENCE_FLOOR''' END, CASE WHEN f > 0.6 THEN '''FRAUD_SCORE_THRESHOLD''' END,
    CASE WHEN high AND c < 0.7 THEN '''HIGH_RISK_CONFIDENCE_FLOOR''' END) AS names FROM x)
SELECT 'loan-' || id AS stream_id, CASE r WHEN 'APPROVE' THEN 'ApplicationApproved' WHEN 'DECLINE' THEN 'ApplicationDeclined' ELSE 'HumanReviewRequested' END AS event_type,
  '{"application_id":"' || id || '"' || CASE r WHEN 'APPROVE' THEN ',"approved_amount_usd":' || amount || '.0,"conditions":' || conditions
    WHEN 'DECLINE' THEN ',"reason":"Orchestrator decision: DECLINE","adverse_action_notice_required":true'
    ELSE ',"reason":"Recommendation: REFER. Constraints applied: [' || names || ']"' END || '}' AS payload FROM y""")
def _outcomes(s, d):
    k = F.col("o_orderkey")
    return O.decision_outcome_events(U.decision_constraints(table(s, d, "orders").select(
        F.concat(F.lit("APP-"), k).alias("application_id"), F.when(k % 13 == 0, "BLOCKED").otherwise("CLEAR").alias("verdict"), (k % 100 / 100.0).alias("confidence"), (k % 71 / 71.0).alias("fraud_score"),
        F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (k % 3 + 1).cast("int")).alias("risk_tier"), F.lit("APPROVE").alias("recommendation"),
        F.floor("o_totalprice").alias("approved_amount_usd"), F.when(k % 2 == 1, F.array(F.lit("quarterly report"))).alias("conditions"))))


@query("r18_next_stage", LOG + """, l AS (SELECT app, event_type AS t FROM log WHERE event_type <> 'AgentContextLoaded' AND user_id % 9 < 5 + global_position % 3 AND NOT (event_type IN ('ApplicationApproved', 'ApplicationDeclined') AND user_id % 2 = 0))
SELECT app AS application_id, CASE WHEN bool_or(t IN ('ApplicationApproved', 'ApplicationDeclined')) THEN 'done' WHEN NOT bool_or(t = 'CreditAnalysisRequested') THEN 'document'
  WHEN NOT bool_or(t = 'CreditAnalysisCompleted') THEN 'credit' WHEN NOT bool_or(t = 'FraudScreeningCompleted') THEN 'fraud'
  WHEN NOT bool_or(t IN ('ComplianceRulePassed', 'ComplianceRuleFailed')) THEN 'compliance' WHEN NOT bool_or(t = 'DecisionGenerated') THEN 'decision' ELSE 'done' END AS next_stage FROM l GROUP BY app""")
def _next_stage(s, d):
    user = "cast(substring_index(get_json_object(payload, '$.application_id'), '-', -1) as int)"
    return O.next_stage(events_log(s, d).where(f"{user} % 9 < 5 + global_position % 3 and not (event_type in ('ApplicationApproved', 'ApplicationDeclined') and {user} % 2 = 0)"))


_CMD = """WITH c AS (SELECT *, CASE WHEN o_orderkey % 29 = 0 THEN ' ' ELSE 'APP-' || o_orderkey END AS id, 'a' || o_orderkey % 5 AS agent, 's' || o_orderkey AS session,
  CASE o_orderkey % 7 WHEN 0 THEN 'EXTREME' WHEN 1 THEN 'VERY_HIGH' ELSE 'LOW' END AS tier, (o_orderkey % 120) / 100.0::DOUBLE AS conf,
  CASE o_orderkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'MAYBE' ELSE 'PASSED' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'EU-AI-ACT-2024' WHEN 1 THEN 'EU-AI-ACT-2025' ELSE 'EU-AI-ACT-2023' END AS regulations,
  ['KYC', 'AML', 'MODEL_BIAS', 'REG-9'][o_orderkey % 11 % 4 + 1] AS rule FROM orders)
"""


def _commands(s, d):
    k = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return table(s, d, "orders").select(
        "o_orderkey", F.when(k % 29 == 0, " ").otherwise(F.concat(F.lit("APP-"), k)).alias("application_id"), F.concat(F.lit("a"), k % 5).alias("agent_id"), F.concat(F.lit("s"), k).alias("session_id"),
        F.when(k % 7 == 0, "EXTREME").when(k % 7 == 1, "VERY_HIGH").otherwise("LOW").alias("risk_tier"), (k % 120 / 100.0).alias("confidence_score"), F.concat(F.lit("C"), "o_custkey").alias("applicant_id"),
        F.floor("o_totalprice").alias("requested_amount_usd"), pick(4, "FAILED", "MAYBE", "PASSED", "PASSED").alias("status"), pick(3, "EU-AI-ACT-2024", "EU-AI-ACT-2025", "EU-AI-ACT-2023").alias("regulation_set"),
        F.element_at(F.array(*map(F.lit, ("KYC", "AML", "MODEL_BIAS", "REG-9"))), (k % 11 % 4 + 1).cast("int")).alias("rule_id"), F.lit("APPROVE").alias("recommendation"),
        F.array(F.concat_ws("-", F.lit("agent"), F.concat(F.lit("a"), k % 5), F.concat(F.lit("s"), k))).alias("contributing_agent_sessions"),
        F.create_map(F.concat(F.lit("a"), k % 5), F.lit("v1")).alias("model_versions"))


def _errors(df):
    return df.select("o_orderkey", F.array_join("errors.error_type", "; ").alias("kinds"), F.array_join("errors.message", "; ").alias("messages"), F.array_join("errors.suggested_action", "; ").alias("actions"), "is_valid")


@query("f25_validate_commands", _CMD + """SELECT o_orderkey, concat_ws('; ', CASE WHEN tier = 'EXTREME' THEN 'VALIDATION_ERROR' END, CASE WHEN conf > 1 THEN 'VALIDATION_ERROR' END) AS kinds,
  concat_ws('; ', CASE WHEN tier = 'EXTREME' THEN 'Invalid risk_tier ''EXTREME''. Must be LOW, MEDIUM, HIGH, or VERY_HIGH.' END, CASE WHEN conf > 1 THEN 'confidence_score must be between 0.0 and 1.0.' END) AS messages,
  CASE WHEN tier = 'EXTREME' AND conf > 1 THEN '; ' ELSE '' END AS actions, NOT (tier = 'EXTREME' OR conf > 1) AS is_valid FROM c""")
def _validated(s, d):
    return _errors(U.validate_commands(_commands(s, d), O.command_rules("record_credit")))


@query("f25_validate_compliance", _CMD + """, v AS (SELECT o_orderkey, status = 'MAYBE' AS a, regulations = 'EU-AI-ACT-2023' AS b,
  (regulations = 'EU-AI-ACT-2024' AND rule NOT IN ('KYC', 'AML', 'FRAUD_SCREEN')) OR (regulations = 'EU-AI-ACT-2025' AND rule = 'REG-9') AS w, rule, regulations FROM c)
SELECT o_orderkey, concat_ws('; ', CASE WHEN a THEN 'VALIDATION_ERROR' END, CASE WHEN b THEN 'VALIDATION_ERROR' END, CASE WHEN w THEN 'VALIDATION_ERROR' END) AS kinds,
  concat_ws('; ', CASE WHEN a THEN 'status must be PASSED or FAILED.' END, CASE WHEN b THEN 'Unknown regulation_set_version ''EU-AI-ACT-2023''.' END,
    CASE WHEN w THEN 'rule_id ''' || rule || ''' not in regulation set ''' || regulations || '''.' END) AS messages,
  concat_ws('; ', CASE WHEN a THEN '' END, CASE WHEN b THEN 'Use one of: [''EU-AI-ACT-2024'', ''EU-AI-ACT-2025'']' END, CASE WHEN w THEN CASE regulations WHEN 'EU-AI-ACT-2024' THEN
    'Valid rules: [''AML'', ''FRAUD_SCREEN'', ''KYC'']' ELSE 'Valid rules: [''AML'', ''DATA_PRIVACY'', ''FRAUD_SCREEN'', ''KYC'', ''MODEL_BIAS'']' END END) AS actions, NOT (a OR b OR w) AS is_valid FROM v""")
def _validated_compliance(s, d):
    return _errors(U.validate_commands(_commands(s, d), O.command_rules("record_compliance")))


@query("r19_command_events", _CMD + """, e AS (
  SELECT unnest(['loan-' || id, 'agent-' || agent || '-' || session]) AS stream_id, 'CreditAnalysisCompleted' AS event_type, 2 AS event_version, id AS application_id, tier AS said, conf AS score, NULL AS who FROM c WHERE tier <> 'EXTREME' AND conf <= 1
  UNION ALL SELECT 'loan-' || id, 'ApplicationSubmitted', 1, id, NULL, NULL, NULL FROM c WHERE id <> ' ' AND floor(o_totalprice) > 0
  UNION ALL SELECT unnest(['loan-' || id, 'agent-' || agent || '-' || session]), 'DecisionGenerated', 2, id, 'APPROVE', conf, agent || '=v1' FROM c WHERE conf <= 1
  UNION ALL SELECT 'compliance-' || id, CASE status WHEN 'PASSED' THEN 'ComplianceRulePassed' ELSE 'ComplianceRuleFailed' END, 1, id, rule || CASE status WHEN 'PASSED' THEN '' ELSE ': Compliance requirement not met' END, NULL, NULL
    FROM c WHERE status <> 'MAYBE' AND (regulations = 'EU-AI-ACT-2024' AND rule IN ('KYC', 'AML') OR regulations = 'EU-AI-ACT-2025' AND rule <> 'REG-9')
  UNION ALL SELECT 'loan-' || id, 'ComplianceRulePassed', 1, id, 'compliance_clearance', NULL, NULL
    FROM c WHERE status = 'PASSED' AND (regulations = 'EU-AI-ACT-2024' AND rule IN ('KYC', 'AML') OR regulations = 'EU-AI-ACT-2025' AND rule <> 'REG-9'))
SELECT * FROM e""")
def _written(s, d):
    rows = _commands(s, d).withColumn("clears", F.col("status") == "PASSED")
    p = F.col("p")
    fields = "application_id string, orchestrator_agent_id string, model_versions map<string,string>, recommendation string, risk_tier string, rule_id string, failure_reason string, confidence_score double"
    who = F.concat(p["orchestrator_agent_id"], F.lit("="), p["model_versions"][p["orchestrator_agent_id"]])
    said = F.coalesce(p["recommendation"], p["risk_tier"], F.concat(p["rule_id"], F.coalesce(F.concat(F.lit(": "), p["failure_reason"]), F.lit(""))))
    out = None
    for c in ("record_credit", "submit_application", "generate_decision", "record_compliance"):
        own = O.command_events(U.validate_commands(rows, O.command_rules(c)).where("is_valid"), c)
        out = own if out is None else out.unionByName(own)
    return out.withColumn("p", F.from_json("payload", fields)).select(
        "stream_id", "event_type", "event_version", p["application_id"].alias("application_id"), said.alias("said"), p["confidence_score"].alias("score"), who.alias("who"))


def command_batch(s, d):
    """A command for each line of an order: mostly the next step of an application, now and then another one, or one with a wrong value."""
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("q")).dropDuplicates(["l_orderkey", "l_linenumber"])
    steps = ("submit_application", "start_session", "request_credit", "record_credit", "request_compliance", "record_compliance", "generate_decision", "record_review", "approve", "decline", "record_fraud", "upload_document")
    app, part = F.floor(F.col("l_orderkey") / 2), F.col("l_partkey")
    step = F.when(part % 13 == 0, part % len(steps)).otherwise(F.col("l_orderkey") % 2 * 4 + F.col("l_linenumber") - 1) % len(steps)
    odd = lambda n, a, b: F.when(part % n == 0, a).otherwise(b)
    session = F.concat(F.lit("s"), app)
    return line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.element_at(F.array(*map(F.lit, steps)), (step + 1).cast("int")).alias("command"), F.concat(odd(5, F.lit("loan-"), F.lit("")), F.lit("N"), app).alias("application_id"),
        F.lit("C1").alias("applicant_id"), odd(17, F.lit(-1.0), F.col("q")).alias("requested_amount_usd"), F.lit("D").alias("document_id"), odd(3, F.lit(" "), F.lit("/d")).alias("file_path"), F.lit("a1").alias("agent_id"), session.alias("session_id"),
        F.concat(F.lit("v"), part % 3).alias("model_version"), odd(7, F.lit("EXTREME"), F.lit("LOW")).alias("risk_tier"), (F.col("l_suppkey") % 100 / 100.0).alias("confidence_score"), F.lit(0.2).alias("fraud_score"),
        odd(11, F.lit("FRAUD_SCREEN"), F.lit("KYC")).alias("rule_id"), odd(6, F.lit("FAILED"), F.lit("PASSED")).alias("status"), F.lit("EU-AI-ACT-2024").alias("regulation_set"), F.array(F.lit("KYC")).alias("required_rules"),
        odd(4, F.lit("DECLINE"), F.lit("APPROVE")).alias("recommendation"), F.array(F.concat_ws("-", F.lit("agent"), F.lit("a1"), session)).alias("contributing_agent_sessions"), F.lit("r1").alias("reviewer_id"),
        F.lit("APPROVE").alias("final_decision"), (part % 9 == 0).alias("override"), odd(2, F.lit("because"), F.lit("")).alias("override_reason"))


@query("f25_admit_commands")
def _admitted(s, d):
    """One row for each command: its verdict, and the events it wrote with their positions; an application's commands see what those before wrote."""
    accepted, rejected = A.admit_commands(command_batch(s, d), stored(events_log(s, d).drop("event_id", "metadata", "recorded_at")))
    return accepted.select("ord", F.lit(True).alias("accepted"), "stream_id", "stream_position", "event_type", F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("message")).unionByName(
        rejected.select("ord", F.lit(False).alias("accepted"), "error_type", "message"), allowMissingColumns=True)


@query("p6_decision_history", LOG + """, s AS (SELECT *, CASE event_type WHEN 'ApplicationSubmitted' THEN 'Application ' || app || ' submitted by U' || user_id || ' for $' || value || '.'
  WHEN 'CreditAnalysisRequested' THEN 'Credit analysis requested for application ' || app || '.'
  WHEN 'CreditAnalysisCompleted' THEN 'Credit analysis completed: risk tier ' || risk_tier || ' with confidence ' || printf('%.2f', score) || ' (model ' || coalesce(model_version, '?') || ').'
  WHEN 'ComplianceCheckRequested' THEN 'Compliance check initiated for application ' || app || '.' WHEN 'FraudScreeningRequested' THEN 'Fraud screening requested for application ' || app || '.'
  WHEN 'FraudScreeningCompleted' THEN 'Fraud screening completed: score ' || score || ', result ?.' WHEN 'DecisionGenerated' THEN 'Decision generated: ' || recommendation || ' (confidence ' || score || ').'
  WHEN 'HumanReviewCompleted' THEN 'Human reviewer ' || reviewer_id || ' recorded final decision: ' || final_decision || CASE WHEN is_override THEN ' (override)' ELSE '' END || '.'
  WHEN 'ApplicationApproved' THEN 'Application ' || app || ' approved for $' || value || '.' ELSE 'Application ' || app || ' declined.' END AS sentence,
  event_type IN ('CreditAnalysisCompleted', 'DecisionGenerated') AS made FROM log WHERE stream_id LIKE 'loan-%')
SELECT app AS application_id, stream_position, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') AS at, event_type, sentence, CASE WHEN made THEN agent_id END AS agent_id, CASE WHEN made THEN model_version END AS model_version,
  CASE WHEN made THEN score END AS confidence, CAST(NULL AS VARCHAR) AS input_hash, CASE WHEN event_type = 'DecisionGenerated' THEN recommendation END AS recommendation, 'VALID' AS chain FROM s""")
def _history(s, d):
    return O.decision_history(events_log(s, d))


@query("j10_uncovered_at_approval", LOG + """, a AS (SELECT app, max(global_position) AS approved_at FROM log WHERE event_type = 'ApplicationApproved' GROUP BY app),
b AS (SELECT l.*, approved_at FROM log l JOIN a USING (app) WHERE l.global_position < approved_at),
q AS (SELECT app, arg_max(CASE k % 3 WHEN 0 THEN ['KYC', 'AML'] WHEN 1 THEN ['KYC', 'MODEL_BIAS'] ELSE ['FRAUD_SCREEN'] END, global_position) AS required FROM b WHERE event_type = 'ComplianceCheckRequested' GROUP BY app),
r AS (SELECT app, rule_id, arg_max(event_type, global_position) = 'ComplianceRulePassed' AS ok FROM b WHERE event_type LIKE 'ComplianceRule%' GROUP BY app, rule_id),
n AS (SELECT app, approved_at, unnest(required) AS rule_id FROM q JOIN a USING (app))
SELECT n.app AS application_id, n.approved_at, string_agg(n.rule_id, ',' ORDER BY n.rule_id) AS uncovered FROM n LEFT JOIN r ON n.app = r.app AND n.rule_id = r.rule_id WHERE NOT coalesce(ok, false) GROUP BY n.app, n.approved_at""")
def _uncovered(s, d):
    """Compliance requests of the log go to the compliance stream, with rules that depend on the event."""
    asks = F.col("event_type") == "ComplianceCheckRequested"
    k = F.get_json_object("props", "$.k").cast("int") % 3
    asked = table(s, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(k == 0, '["KYC","AML"]').when(k == 1, '["KYC","MODEL_BIAS"]').otherwise('["FRAUD_SCREEN"]').alias("rules"))
    log = events_log(s, d).join(asked, "event_id").withColumns({
        "stream_id": F.when(asks, F.regexp_replace("stream_id", "^loan-", "compliance-")).otherwise(F.col("stream_id")),
        "payload": F.when(asks, F.concat(F.lit('{"application_id":"'), F.get_json_object("payload", "$.application_id"), F.lit('","required_rules":'), F.col("rules"), F.lit("}"))).otherwise(F.col("payload"))})
    return G.uncovered_at_approval(log.drop("rules")).withColumn("uncovered", F.array_join("uncovered", ","))


def _damaged(s, d):
    """The log with amounts that are words, scores that are objects, and events of no known type."""
    n, t = F.col("event_id").cast("long"), F.col("event_type")
    payload = F.when((t == "ApplicationApproved") & (n % 5 == 0), F.regexp_replace("payload", r'"approved_amount_usd":[^,}]*', '"approved_amount_usd":"lots"')).when(
        (t == "FraudScreeningCompleted") & (n % 4 == 1), F.regexp_replace("payload", r'"fraud_score":[^,}]*', '"fraud_score":{"v":1}')).when((t == "HumanReviewCompleted") & (n % 3 == 0), F.lit("[1]")).otherwise(F.col("payload"))
    return events_log(s, d).withColumns({"payload": payload, "event_type": F.when((t == "ApplicationDeclined") & (n % 7 == 2), "Mystery").otherwise(t)})


_DAMAGED = LOG + """, t AS (SELECT global_position, stream_id, CASE WHEN event_type = 'ApplicationDeclined' AND event_id % 7 = 2 THEN 'Mystery' ELSE event_type END AS event_type, CASE
  WHEN event_type = 'ApplicationDeclined' AND event_id % 7 = 2 THEN ['/unknown_type'] WHEN event_type = 'HumanReviewCompleted' AND event_id % 3 = 0 THEN ['/not_an_object']
  WHEN event_type = 'ApplicationApproved' AND event_id % 5 = 0 THEN ['approved_amount_usd/not_a_number'] WHEN event_type = 'FraudScreeningCompleted' AND event_id % 4 = 1 THEN ['fraud_score/not_a_number']
  WHEN event_type = 'CreditAnalysisCompleted' AND event_version = 1 THEN ['model_version/missing'] WHEN event_type = 'DecisionGenerated' AND event_version = 1 THEN ['model_versions/missing'] END AS faults FROM log)
"""


@query("g24_typed_errors", _DAMAGED + """, x AS (SELECT global_position, event_type, unnest(faults) AS f FROM t)
SELECT global_position, event_type, nullif(split_part(f, '/', 1), '') AS field, split_part(f, '/', 2) AS error FROM x""")
def _typed_errors(s, d):
    return Q.typed_errors(_damaged(s, d))


@query("g24_schema_report", _DAMAGED + """, f AS (SELECT global_position, event_type, faults[1] AS f FROM t WHERE faults IS NOT NULL ORDER BY global_position LIMIT 10)
SELECT count(*) FILTER (faults IS NULL) AS valid, count(*) FILTER (faults IS NOT NULL) AS faulty, count(*) FILTER (event_type = 'Mystery') AS mysteries, count(*) FILTER (stream_id LIKE 'loan-%') AS loans,
  (SELECT string_agg(global_position || ':' || f, ',' ORDER BY global_position) FROM f) AS first_errors FROM t""")
def _schema_report(s, d):
    line = lambda x: F.concat(x["global_position"].cast("string"), F.lit(":"), F.coalesce(x["field"], F.lit("")), F.lit("/"), x["error"])
    return Q.schema_report(_damaged(s, d)).select(
        "valid", "faulty", F.coalesce(F.col("by_event_type")["Mystery"], F.lit(0)).alias("mysteries"), F.coalesce(F.col("by_prefix")["loan"], F.lit(0)).alias("loans"), F.array_join(F.transform("first_errors", line), ",").alias("first_errors"))
