"""Registered queries: read models, aggregates, joins, rules, integrity and time travel over the log of table events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import aggregates as A
from ..operators import integrity as I
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import readmodels as R
from ..operators import rules as U
from ..operators import timetravel as T
from ..operators import upcast as V
from ..sources import log as S
from ..streaming import stage_timeouts
from .fixtures import LOG, events_log

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_TYPES = "('ApplicationSubmitted','CreditAnalysisRequested','CreditAnalysisCompleted','ComplianceCheckRequested','ComplianceRulePassed','ComplianceRuleFailed','FraudScreeningCompleted','DecisionGenerated','HumanReviewCompleted','ApplicationApproved','ApplicationDeclined')"
_PENDING = "CASE {r} WHEN 'APPROVE' THEN 'APPROVED_PENDING_HUMAN' WHEN 'DECLINE' THEN 'DECLINED_PENDING_HUMAN' ELSE 'REFERRED' END"
_SET = """CASE event_type WHEN 'ApplicationSubmitted' THEN 'SUBMITTED' WHEN 'CreditAnalysisRequested' THEN 'AWAITING_ANALYSIS' WHEN 'CreditAnalysisCompleted' THEN 'ANALYSIS_COMPLETE'
 WHEN 'ComplianceCheckRequested' THEN 'COMPLIANCE_REVIEW' WHEN 'ComplianceRulePassed' THEN 'PENDING_DECISION' WHEN 'ApplicationApproved' THEN 'FINAL_APPROVED' WHEN 'ApplicationDeclined' THEN 'FINAL_DECLINED'
 WHEN 'HumanReviewCompleted' THEN 'FINAL_' || final_decision || 'D' WHEN 'DecisionGenerated' THEN {decided} END""".replace("'FINAL_' || final_decision || 'D'", "CASE final_decision WHEN 'APPROVE' THEN 'FINAL_APPROVED' ELSE 'FINAL_DECLINED' END")
SUMMARY_STATE = _SET.format(decided=_PENDING.format(r="recommendation"))
FLOORED = "CASE WHEN score < 0.6 THEN 'REFER' ELSE recommendation END"
FLOOR_STATE = _SET.format(decided=_PENDING.format(r=FLOORED))


def query(name: str, sql: str | None = None):
    """Register f(log) as a query over table events; sql goes on from the CTE named log."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(events_log(spark, sf_dir))
        if sql:
            ORACLES[name] = LOG + sql
        return f

    return keep


query("a2_load_stream", "SELECT global_position, stream_position, event_type FROM log WHERE stream_id = 'loan-APP-7' AND stream_position > 3 AND stream_position <= 40")(
    lambda log: S.load_stream(log, "loan-APP-7", 3, 40).select("global_position", "stream_position", "event_type"))
query("a3_load_all", "SELECT global_position, stream_id, event_type FROM log WHERE global_position > 100 AND global_position <= 5000 AND event_type IN ('DecisionGenerated', 'ApplicationApproved')")(
    lambda log: S.load_all(log, 100, 5000, ["DecisionGenerated", "ApplicationApproved"]).select("global_position", "stream_id", "event_type"))
query("a5_stream_heads", "SELECT stream_id, max(stream_position) AS version FROM log GROUP BY stream_id")(S.stream_heads)
query("a6_stream_metadata", "SELECT stream_id, max(stream_position) AS current_version, min(recorded_at) AS created_at, split_part(stream_id, '-', 1) AS aggregate_type FROM log GROUP BY stream_id")(S.stream_metadata)
query("a11_mirror_to_audit", """SELECT 'audit-loan-' || app AS stream_id, global_position, row_number() OVER (PARTITION BY app ORDER BY global_position) AS stream_position, stream_id AS source_stream_id
 FROM log WHERE event_type <> 'AgentContextLoaded'""")(lambda log: S.mirror_to_audit(log).select("stream_id", "global_position", "stream_position", F.get_json_object("metadata", "$.source_stream_id").alias("source_stream_id")))
query("a12_outbox_rows", "SELECT CAST(event_id AS VARCHAR) AS event_id, 'ALL' AS destination, 0 AS attempts, recorded_at AS created_at FROM log")(lambda log: S.outbox_rows(log).select("event_id", "destination", "attempts", "created_at"))
query("a13_pending_outbox", "SELECT CAST(event_id AS VARCHAR) AS event_id FROM log WHERE event_id % 2 = 1 ORDER BY recorded_at, CAST(event_id AS VARCHAR) LIMIT 100")(
    lambda log: S.pending_outbox(S.outbox_rows(log).withColumn("attempts", F.when(F.col("event_id").cast("long") % 2 == 0, 5).otherwise(0))).select("event_id"))

query("f1_by_category", "SELECT global_position, stream_id FROM log WHERE stream_id LIKE 'agent-%'")(lambda log: X.by_category(log, "agent-").select("global_position", "stream_id"))
query("f3_in_shard", "SELECT global_position FROM log WHERE global_position BETWEEN 6 AND 5011")(lambda log: log.where(X.in_shard(F.col("global_position"), F.lit(6), F.lit(5011))).select("global_position"))
query("f5_payload_get", "SELECT global_position, CASE WHEN event_type = 'CreditAnalysisCompleted' THEN risk_tier ELSE '?' END AS tier FROM log")(
    lambda log: log.select("global_position", X.payload_get(F.col("payload"), "risk_tier", F.lit("?")).alias("tier")))
query("f7_parse_audit_stream", "SELECT global_position, 'loan' AS entity_type, app AS entity_id FROM log WHERE event_type <> 'AgentContextLoaded'")(
    lambda log: S.mirror_to_audit(log).select("global_position", X.parse_audit_stream(F.col("stream_id")).alias("s")).select("global_position", "s.*"))
query("f11_short_hash", "SELECT global_position, substr(sha256('\"' || stream_id || '\"'), 1, 16) AS h FROM log")(lambda log: log.select("global_position", X.short_hash(F.col("stream_id")).alias("h")))
query("f14_confidence_floor", f"SELECT global_position, {FLOORED} AS recommendation, score < 0.6 AND recommendation <> 'REFER' AS overridden FROM log WHERE event_type = 'DecisionGenerated'")(
    lambda log: X.typed(log.where("event_type = 'DecisionGenerated'")).select("global_position", X.recommendation_with_floor(F.col("p.recommendation"), F.col("p.confidence_score")).alias("recommendation"), (
        (F.col("p.confidence_score") < 0.6) & (F.col("p.recommendation") != "REFER")).alias("overridden")))
query("f16_narrative", """SELECT global_position, CASE event_type WHEN 'CreditAnalysisRequested' THEN 'Credit analysis requested for application ' || app || '.'
 WHEN 'CreditAnalysisCompleted' THEN 'Credit analysis completed: risk tier ' || risk_tier || ' with confidence ' || printf('%.2f', score) || ' (model ' || coalesce(model_version, '?') || ').'
 WHEN 'ComplianceCheckRequested' THEN 'Compliance check initiated for application ' || app || '.' WHEN 'ComplianceRulePassed' THEN 'Compliance rule ''' || rule_id || ''' passed for application ' || app || '.'
 WHEN 'ComplianceRuleFailed' THEN 'Compliance rule ''' || rule_id || ''' failed for application ' || app || ': .' WHEN 'FraudScreeningRequested' THEN 'Fraud screening requested for application ' || app || '.'
 WHEN 'HumanReviewCompleted' THEN 'Human reviewer ' || reviewer_id || ' recorded final decision: ' || final_decision || CASE WHEN is_override THEN ' (override)' ELSE '' END || '.'
 ELSE 'Application ' || app || ' declined.' END AS sentence FROM log
 WHERE event_type IN ('CreditAnalysisRequested','CreditAnalysisCompleted','ComplianceCheckRequested','ComplianceRulePassed','ComplianceRuleFailed','FraudScreeningRequested','HumanReviewCompleted','ApplicationDeclined')""")(
    lambda log: X.typed(log.where("event_type in ('CreditAnalysisRequested','CreditAnalysisCompleted','ComplianceCheckRequested','ComplianceRulePassed','ComplianceRuleFailed','FraudScreeningRequested','HumanReviewCompleted','ApplicationDeclined')")).select(
        "global_position", X.narrative().alias("sentence")))
query("f18_iso_timestamp", "SELECT global_position, strftime(recorded_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(recorded_at) % 1000000 = 0 THEN '' ELSE strftime(recorded_at, '.%f') END AS iso FROM log")(
    lambda log: log.select("global_position", X.iso_timestamp(F.col("recorded_at")).alias("iso")))
query("f19_fraud_recommendation", """SELECT global_position, CASE WHEN score > 0.6 THEN 'DECLINE' WHEN score >= 0.3 THEN 'FLAG_FOR_REVIEW' ELSE 'PROCEED' END AS rec,
 CASE WHEN score < 0.2 THEN 'LOW' WHEN score < 0.5 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM log WHERE event_type = 'FraudScreeningCompleted'""")(
    lambda log: X.typed(log.where("event_type = 'FraudScreeningCompleted'")).select("global_position", X.fraud_recommendation(X.clamp01(F.col("p.fraud_score"))).alias("rec"), X.fraud_risk_level(F.col("p.fraud_score")).alias("level")))

query("g1_application_summary", f""", s AS (SELECT *, min(CASE WHEN event_type = 'ApplicationSubmitted' THEN global_position END) OVER (PARTITION BY app) AS start FROM log WHERE event_type <> 'AgentContextLoaded'),
 w AS (SELECT *, {SUMMARY_STATE} AS st FROM s WHERE global_position >= start AND event_type IN {_TYPES})
 SELECT app AS application_id, arg_max(st, global_position) FILTER (st IS NOT NULL) AS state, 'U' || max(user_id) AS applicant_id,
  arg_max(value, global_position) FILTER (event_type = 'ApplicationSubmitted') AS requested_amount_usd, arg_max(risk_tier, global_position) FILTER (event_type = 'CreditAnalysisCompleted') AS risk_tier,
  CAST(arg_max(score, global_position) FILTER (event_type = 'FraudScreeningCompleted') AS DECIMAL(5,2)) AS fraud_score,
  arg_max(CASE event_type WHEN 'ComplianceRulePassed' THEN 'PASSED' ELSE 'FAILED' END, global_position) FILTER (event_type LIKE 'ComplianceRule%') AS compliance_status,
  arg_max(recommendation, global_position) FILTER (event_type = 'DecisionGenerated') AS decision, arg_max(agent_id, global_position) FILTER (event_type = 'DecisionGenerated') AS orchestrator_agent_id,
  arg_max_null(model_version, global_position) FILTER (event_type = 'DecisionGenerated') AS orchestrator_model_version, arg_max(reviewer_id, global_position) FILTER (event_type = 'HumanReviewCompleted') AS human_reviewer_id,
  arg_max(value, global_position) FILTER (event_type = 'ApplicationApproved') AS approved_amount_usd, max(recorded_at) FILTER (event_type IN ('ApplicationApproved', 'ApplicationDeclined')) AS final_decision_at,
  arg_max(event_type, global_position) AS last_event_type, max(recorded_at) AS last_event_at,
  coalesce(max('agent-' || agent_id || '-' || session_id) FILTER (event_type = 'CreditAnalysisCompleted'), '') AS agent_sessions FROM w GROUP BY app""")(
    lambda log: R.application_summary(log).withColumn("agent_sessions", F.array_join("agent_sessions_completed", ",")).drop("agent_sessions_completed"))
_PERF = """, rv AS (SELECT r.global_position, r.recorded_at, r.is_override, d.agent_id, d.model_version FROM log r ASOF JOIN (SELECT * FROM log WHERE event_type = 'DecisionGenerated') d ON r.app = d.app AND r.global_position > d.global_position
  WHERE r.event_type = 'HumanReviewCompleted')"""
query("j4_review_attribution", ", rev AS (SELECT * FROM log WHERE event_type = 'HumanReviewCompleted'), dec AS (SELECT * FROM log WHERE event_type = 'DecisionGenerated') SELECT rev.global_position, dec.agent_id, dec.model_version FROM rev ASOF LEFT JOIN dec ON rev.app = dec.app AND rev.global_position > dec.global_position")(
    lambda log: R.review_attribution(log).select("global_position", "agent_id", "model_version"))
query("g2_agent_performance", _PERF + """, x AS (SELECT agent_id, model_version, event_type AS t, global_position, recorded_at, recommendation AS rec, score, duration_ms, false AS ov FROM log WHERE event_type IN ('AgentContextLoaded', 'CreditAnalysisCompleted', 'DecisionGenerated')
  UNION ALL SELECT agent_id, model_version, 'HumanReviewCompleted', global_position, recorded_at, NULL, 0, 0, is_override FROM rv)
 SELECT agent_id, model_version, count(*) FILTER (t = 'CreditAnalysisCompleted') AS analyses_completed, count(*) FILTER (t = 'DecisionGenerated') AS decisions_generated,
  round(avg(score) FILTER (t = 'DecisionGenerated'), 9) AS avg_confidence_score, round(coalesce(avg(CASE rec WHEN 'APPROVE' THEN 1.0 ELSE 0.0 END) FILTER (t = 'DecisionGenerated'), 0), 9) AS approve_rate,
  count(*) FILTER (t = 'HumanReviewCompleted') AS human_reviews_total, count(*) FILTER (t = 'HumanReviewCompleted' AND ov) AS human_overrides_total, min(recorded_at) AS first_seen_at, max(recorded_at) AS last_seen_at,
  round(coalesce(list_reduce(list_prepend({'a': 0.0::DOUBLE, 'n': 0::DOUBLE}, list({'a': duration_ms, 'n': 0::DOUBLE} ORDER BY global_position) FILTER (t = 'CreditAnalysisCompleted')),
    lambda s, y: {'a': CASE WHEN y.a > 0 THEN (s.a * s.n + y.a) / (s.n + 1) ELSE s.a END, 'n': s.n + 1}).a, 0), 6) AS avg_duration_ms
 FROM x WHERE agent_id IS NOT NULL AND model_version IS NOT NULL GROUP BY agent_id, model_version""")(
    lambda log: R.agent_performance(log, override_field="override").select(
        "agent_id", "model_version", "analyses_completed", "decisions_generated", F.round("avg_confidence_score", 9).alias("avg_confidence_score"), F.round("approve_rate", 9).alias("approve_rate"),
        "human_reviews_total", "human_overrides_total", "first_seen_at", "last_seen_at", F.round("avg_duration_ms", 6).alias("avg_duration_ms")))
query("g3_compliance_history", "SELECT app AS application_id, global_position, event_type, CASE WHEN event_type LIKE 'ComplianceRule%' THEN rule_id END AS rule_id, recorded_at FROM log WHERE event_type IN ('ComplianceCheckRequested','ComplianceRulePassed','ComplianceRuleFailed')")(R.compliance_history)
_RULES = ", h AS (SELECT * FROM log WHERE event_type LIKE 'ComplianceRule%'), r AS (SELECT app AS application_id, rule_id, arg_max(CASE event_type WHEN 'ComplianceRulePassed' THEN 'PASSED' ELSE 'FAILED' END, global_position) AS status FROM h GROUP BY app, rule_id)"
query("g4_compliance_rules", _RULES + " SELECT * FROM r")(R.compliance_rules)
query("g4_compliance_current", _RULES + """, u AS (SELECT app, max(recorded_at) AS last_updated FROM log WHERE event_type IN ('ComplianceCheckRequested','ComplianceRulePassed','ComplianceRuleFailed') GROUP BY app)
 SELECT app AS application_id, last_updated, count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed,
 CASE WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'FAILED' WHEN count(*) FILTER (status = 'PASSED') > 0 THEN 'PASSED' ELSE 'IN_PROGRESS' END AS overall_status FROM u LEFT JOIN r ON app = application_id GROUP BY app, last_updated""")(R.compliance_current)
query("g5_compliance_at", ", mo AS (SELECT min(recorded_at) + (max(recorded_at) - min(recorded_at)) / 2 AS m FROM log) SELECT app AS application_id, rule_id, arg_max(CASE event_type WHEN 'ComplianceRulePassed' THEN 'PASSED' ELSE 'FAILED' END, global_position) AS status FROM log, mo WHERE event_type LIKE 'ComplianceRule%' AND recorded_at <= m GROUP BY app, rule_id")(
    lambda log: T.compliance_at(log, R.compliance_history(log).select("application_id").distinct().crossJoin(_middle(log))).drop("moment"))
query("g6_compliance_snapshots", """, h AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY global_position) AS n FROM log WHERE event_type IN ('ComplianceCheckRequested','ComplianceRulePassed','ComplianceRuleFailed')),
 s AS (SELECT app, global_position AS "at" FROM h WHERE n % 10 = 0)
 SELECT s.app AS application_id, "at", rule_id, arg_max(CASE event_type WHEN 'ComplianceRulePassed' THEN 'PASSED' ELSE 'FAILED' END, h.global_position) AS status FROM s JOIN h ON s.app = h.app AND h.global_position <= "at" AND event_type LIKE 'ComplianceRule%' GROUP BY ALL""")(lambda log: T.compliance_snapshots(log, 10))
query("j7_state_from_snapshot", ORACLES["g5_compliance_at"][len(LOG):])(lambda log: _from_snapshot(log))
query("g7_audit_trail", "SELECT app AS application_id, global_position, event_type, stream_id AS source_stream_id, recorded_at FROM log WHERE event_type <> 'AgentContextLoaded'")(lambda log: R.audit_trail(S.mirror_to_audit(log)))
query("g8_agent_session_view", """, a AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY stream_position DESC) AS back FROM log WHERE stream_id LIKE 'agent-%')
 SELECT stream_id AS session_id, max(agent_id) AS agent_id, arg_max(model_version, stream_position) AS model_version, true AS is_active, 'AgentContextLoaded' AS pending_work, true AS needs_reconciliation, count(*) AS total_events,
 coalesce(string_agg(event_type, '|' ORDER BY stream_position) FILTER (back > 3), '') AS summary FROM a GROUP BY stream_id""")(
    lambda log: R.agent_session_view(log).withColumn("summary", F.array_join("summary", "|")).drop("recent_events", "last_completed_action"))
query("g10_loan_state", f""", l AS (SELECT *, {FLOOR_STATE} AS st FROM log WHERE stream_id LIKE 'loan-%')
 SELECT stream_id, coalesce(arg_max(st, stream_position) FILTER (st IS NOT NULL), 'SUBMITTED') AS state, coalesce(string_agg(DISTINCT model_version, ',' ORDER BY model_version) FILTER (event_type = 'CreditAnalysisCompleted'), '') AS model_versions,
 coalesce(arg_max(is_override, stream_position) FILTER (event_type = 'HumanReviewCompleted'), false) AS has_human_override, false AS is_compliance_passed, max(stream_position) AS version FROM l GROUP BY stream_id""")(
    lambda log: A.loan_state(log).withColumn("model_versions", F.array_join("model_versions", ",")).drop("contributing_sessions"))
query("g11_session_state", "SELECT stream_id, true AS context_loaded, true AS is_active, max(agent_id) AS agent_id, arg_max(model_version, stream_position) AS model_version, max(stream_position) AS version FROM log WHERE stream_id LIKE 'agent-%' GROUP BY stream_id")(
    lambda log: A.session_state(log).drop("contributed_apps"))
query("g12_compliance_record", _RULES + " SELECT 'compliance-' || application_id AS stream_id, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (status = 'PASSED'), '') AS passed, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (status = 'FAILED'), '') AS failed, bool_and(status = 'PASSED') AS is_passed FROM r GROUP BY application_id")(
    lambda log: A.compliance_record(log).select("stream_id", F.array_join("passed", ",").alias("passed"), F.array_join("failed", ",").alias("failed"), "is_passed"))
query("g13_clearance_events", """, h AS (SELECT * FROM log WHERE event_type LIKE 'ComplianceRule%'), st AS (SELECT a.stream_id, a.stream_position, a.global_position, b.rule_id, arg_max(b.event_type, b.stream_position) AS t FROM h a JOIN h b ON a.stream_id = b.stream_id AND b.stream_position <= a.stream_position GROUP BY ALL),
 p AS (SELECT stream_id, stream_position, global_position, bool_and(t = 'ComplianceRulePassed') AS ok FROM st GROUP BY ALL), q AS (SELECT *, lag(ok, 1, false) OVER (PARTITION BY stream_id ORDER BY stream_position) AS was FROM p) SELECT stream_id, stream_position, global_position FROM q WHERE ok AND NOT was""")(A.clearance_events)
query("g9_agent_context", """, a AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY stream_position DESC) AS back FROM log WHERE stream_id LIKE 'agent-%')
 SELECT stream_id AS session_id, arg_min(agent_id, stream_position) AS agent_id, arg_min(model_version, stream_position) AS model_version, count(*) AS total_events, max(stream_position) AS last_event_position,
 coalesce(string_agg(event_type, chr(10) ORDER BY stream_position) FILTER (back > 3), '') AS context_text, 'NEEDS_RECONCILIATION' AS session_health_status FROM a GROUP BY stream_id""")(
    lambda log: A.agent_context(log).drop("recent_events", "pending_work", "last_completed_action", "is_active"))
query("g32_evaluation_backlog", ", gs AS (" + "SELECT app, arg_max(st, global_position) FILTER (st IS NOT NULL) AS state FROM (SELECT *, " + SUMMARY_STATE + f" AS st, min(CASE WHEN event_type = 'ApplicationSubmitted' THEN global_position END) OVER (PARTITION BY app) AS start FROM log WHERE event_type IN {_TYPES}) z WHERE global_position >= start GROUP BY app) SELECT state, count(*) AS n FROM gs GROUP BY state")(R.evaluation_backlog)

query("j1_session_model_versions", "SELECT stream_id, arg_min(model_version, stream_position) AS model_version FROM log WHERE stream_id LIKE 'agent-%' GROUP BY stream_id")(J.session_model_versions)
query("j2_reconstruct_model_versions", ", sm AS (SELECT stream_id, arg_min(model_version, stream_position) AS mv FROM log WHERE stream_id LIKE 'agent-%' GROUP BY stream_id) SELECT global_position, CASE WHEN mv IS NULL THEN '{}' ELSE '{\"' || sm.stream_id || '\":\"' || mv || '\"}' END AS model_versions FROM log LEFT JOIN sm ON sm.stream_id = 'agent-' || agent_id || '-' || session_id WHERE event_type = 'DecisionGenerated' AND event_version = 1")(
    lambda log: J.reconstruct_model_versions(log).withColumn("model_versions", F.to_json("model_versions")))
query("j5_schedule", "SELECT global_position, CASE WHEN d < DATE '2024-01-01' THEN NULL WHEN d < DATE '2024-07-01' THEN 'v1.0' WHEN d < DATE '2025-01-01' THEN 'v1.1' WHEN d < DATE '2026-01-01' THEN 'v2.0' ELSE 'v2.1' END AS model FROM (SELECT global_position, CAST(recorded_at + to_days(CAST(global_position % 900 AS INTEGER)) AS DATE) AS d FROM log)")(
    lambda log: _schedule(log))
query("j6_checkpoint_lag", ", z AS (SELECT max(recorded_at) AS newest, min(recorded_at) AS oldest FROM log), c AS (SELECT * FROM (VALUES ('a', 100), ('b', 5000), ('none', NULL)) t(name, last_position)) SELECT name, CAST(last_position AS BIGINT) AS last_position, date_diff('microsecond', coalesce(recorded_at, oldest), newest) // 1000 AS lag_ms FROM c LEFT JOIN log ON global_position = last_position, z")(
    lambda log: J.checkpoint_lag(log, log.sparkSession.createDataFrame([("a", 100), ("b", 5000), ("none", None)], "name string, last_position long")))
query("j9_causal_chain_violations", "SELECT 'agent-' || agent_id || '-' || session_id AS session, app AS application_id, global_position FROM log WHERE event_type = 'DecisionGenerated'")(J.causal_chain_violations)
query("j11_pending_work_items", """, m AS (SELECT app, global_position, CASE WHEN event_type IN ('CreditAnalysisRequested','CreditAnalysisCompleted') THEN 'credit' WHEN event_type IN ('FraudScreeningRequested','FraudScreeningCompleted') THEN 'fraud' WHEN event_type IN ('ComplianceCheckRequested','ComplianceRulePassed') THEN 'compliance' END AS stage,
  event_type LIKE '%Requested' AS asked FROM log), p AS (SELECT app AS application_id, stage, max(CASE WHEN asked THEN global_position END) AS asked_at, max(CASE WHEN NOT asked THEN global_position END) AS done_at FROM m WHERE stage IS NOT NULL GROUP BY app, stage)
 SELECT * FROM p WHERE asked_at IS NOT NULL AND (done_at IS NULL OR done_at < asked_at)""")(J.pending_work_items)
query("j13_causation_chain", """ SELECT CAST(event_id AS VARCHAR) AS event_id, 'corr-' || user_id AS correlation_id, event_type, global_position,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS depth FROM log""")(J.causation_chain)
query("j14_entity_timeline", "SELECT app AS application_id, stream_id, event_type, global_position, recorded_at, row_number() OVER (PARTITION BY app ORDER BY recorded_at, global_position) AS seq FROM log WHERE event_type <> 'AgentContextLoaded'")(J.entity_timeline)
query("j16_latest_stage_results", """SELECT app AS application_id, arg_max(risk_tier, global_position) FILTER (event_type = 'CreditAnalysisCompleted') AS risk_tier, arg_max(score, global_position) FILTER (event_type = 'FraudScreeningCompleted') AS fraud_score,
 arg_max(event_type, global_position) FILTER (event_type LIKE 'ComplianceRule%') AS compliance FROM log WHERE event_type <> 'AgentContextLoaded' GROUP BY app""")(J.latest_stage_results)
query("j17_decision_model_versions", ", sm AS (SELECT stream_id, max(agent_id) AS agent_id, arg_max(model_version, stream_position) AS model_version FROM log WHERE stream_id LIKE 'agent-%' GROUP BY stream_id) SELECT global_position, sm.agent_id, sm.model_version FROM log JOIN sm ON sm.stream_id = 'agent-' || log.agent_id || '-' || session_id WHERE event_type = 'DecisionGenerated'")(J.decision_model_versions)

_PRIOR = f""", l AS (SELECT *, {FLOOR_STATE} AS st FROM log WHERE stream_id LIKE 'loan-%'), pr AS (SELECT *, coalesce(last_value(st IGNORE NULLS) OVER w, 'SUBMITTED') AS prior_state,
  coalesce(bool_or(event_type = 'CreditAnalysisCompleted' AND model_version IS NOT NULL) OVER w, false) AS had_model, coalesce(last_value(CASE WHEN event_type = 'HumanReviewCompleted' THEN is_override END IGNORE NULLS) OVER w, false) AS had_override
  FROM l WINDOW w AS (PARTITION BY stream_id ORDER BY stream_position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 b AS (SELECT *, (event_type = 'CreditAnalysisRequested' AND prior_state <> 'SUBMITTED') OR (event_type = 'CreditAnalysisCompleted' AND prior_state NOT IN ('AWAITING_ANALYSIS','ANALYSIS_COMPLETE')) OR (event_type = 'ComplianceCheckRequested' AND prior_state <> 'ANALYSIS_COMPLETE')
   OR (event_type = 'DecisionGenerated' AND prior_state <> 'PENDING_DECISION') OR (event_type = 'HumanReviewCompleted' AND prior_state NOT IN ('APPROVED_PENDING_HUMAN','DECLINED_PENDING_HUMAN','REFERRED')) AS bad_state,
   event_type = 'CreditAnalysisCompleted' AND had_model AND NOT had_override AS locked FROM pr)"""
query("r1_audit_transitions", _PRIOR + """, v AS (SELECT stream_id, stream_position, event_type, prior_state, CASE WHEN locked THEN 'model_version_locking' WHEN bad_state THEN 'state_machine' WHEN event_type = 'DecisionGenerated' AND score < 0.6 AND recommendation <> 'REFER' THEN 'confidence_floor'
  WHEN event_type = 'ApplicationApproved' THEN 'compliance_dependency' END AS rule_name FROM b) SELECT * FROM v WHERE rule_name IS NOT NULL""")(U.audit_transitions)
query("r2_model_version_lock", _PRIOR + " SELECT stream_id, stream_position, global_position, event_type FROM b WHERE locked")(lambda log: U.rule_violations(log, "model_version_locking"))
query("r3_confidence_floor", "SELECT stream_id, stream_position, global_position, event_type FROM log WHERE event_type = 'DecisionGenerated' AND score < 0.6 AND recommendation <> 'REFER'")(lambda log: U.rule_violations(log, "confidence_floor"))
query("r5_approval_needs_compliance", "SELECT stream_id, stream_position, global_position, event_type FROM log WHERE event_type = 'ApplicationApproved'")(lambda log: U.rule_violations(log, "compliance_dependency"))
query("r7_session_protocol", "SELECT stream_id, stream_position, event_type, 'context_must_be_first' AS rule_name FROM log WHERE event_type = 'AgentContextLoaded' AND stream_position > 1")(U.session_protocol)
query("r8_model_version_mismatch", ", sm AS (SELECT stream_id AS session, arg_max(model_version, stream_position) AS locked FROM log WHERE stream_id LIKE 'agent-%' GROUP BY stream_id) SELECT session, global_position, model_version AS declared, locked FROM log JOIN sm ON session = 'agent-' || agent_id || '-' || session_id WHERE event_type = 'CreditAnalysisCompleted' AND model_version <> locked")(U.model_version_mismatch)
query("r9_override_needs_reason", "SELECT global_position, app AS application_id, event_type FROM log WHERE event_type = 'HumanReviewCompleted' AND is_override")(U.override_needs_reason)

_CHAIN = """, au AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY global_position) AS n FROM log WHERE event_type <> 'AgentContextLoaded')"""
query("g14_audit_state", _CHAIN + " SELECT 'audit-loan-' || app AS stream_id, count(*) // 20 AS checks FROM au GROUP BY app")(lambda log: A.audit_state(_renumber(I.close_segments(S.mirror_to_audit(log)))).select("stream_id", "checks"))
query("g15_integrity_hash", """, au AS (SELECT app, global_position, sha256('{"a":"' || stream_id || '","z":' || stream_position || '}') AS h FROM log WHERE event_type <> 'AgentContextLoaded')
 SELECT 'audit-loan-' || app AS stream_id, sha256(string_agg(h, '' ORDER BY global_position)) AS integrity_hash, CAST(count(*) AS INTEGER) AS events_hashed FROM au GROUP BY app""")(
    lambda log: I.integrity_hash(_with_payload(S.mirror_to_audit(log.withColumn("text", _plain_payload())))).drop("previous_hash"))
query("g16_verify_chain", _CHAIN + " SELECT 'audit-loan-' || app AS stream_id, true AS is_valid, count(*) // 20 AS checks FROM au GROUP BY app")(lambda log: I.verify_chain(I.close_segments(S.mirror_to_audit(log))).select("stream_id", "is_valid", "checks"))
query("g16_verify_tampered", _CHAIN + ", x AS (SELECT app, max(n) AS size, min(CASE WHEN event_id % 997 = 0 THEN n END) AS bad FROM au GROUP BY app) SELECT 'audit-loan-' || app AS stream_id, bad IS NULL OR bad > size // 20 * 20 AS is_valid, CASE WHEN bad <= size // 20 * 20 THEN 'hash_mismatch' END AS failure FROM x")(
    lambda log: I.verify_chain(_tampered(I.close_segments(S.mirror_to_audit(log)))).select("stream_id", "is_valid", "failure"))
query("g30_package_checksum", """, r AS (SELECT stream_id, stream_position, '{"event_id":"' || event_id || '","event_type":"' || event_type || '","event_version":' || event_version || ',"global_position":' || global_position
 || ',"payload":{"a":"' || stream_id || '","z":' || stream_position || '},"recorded_at":"' || CASE WHEN epoch_us(recorded_at) % 1000000 = 0 THEN strftime(recorded_at, '%Y-%m-%dT%H:%M:%S') ELSE strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%f') END
 || '+00:00","stream_position":' || stream_position || '}' AS row FROM log WHERE stream_id LIKE 'loan-%')
 SELECT stream_id, sha256('[' || string_agg(row, ',' ORDER BY stream_position) || ']') AS checksum FROM r GROUP BY stream_id""")(
    lambda log: I.package_checksum(X.by_category(log, "loan-").withColumn("payload", _plain_payload())))
query("g26_version_distribution", "SELECT event_type, event_version, count(*) AS n, min(recorded_at) AS oldest, max(recorded_at) AS newest, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY event_type), 1)::DOUBLE AS pct FROM log GROUP BY event_type, event_version")(
    lambda log: Q.version_distribution(log).withColumn("pct", F.col("pct").cast("double")))
query("g27_event_type_counts", "SELECT event_type, count(*) AS n FROM log GROUP BY event_type ORDER BY n DESC, event_type LIMIT 8")(Q.event_type_counts)
query("g24_validate_schema", "SELECT global_position, event_type, CASE event_type WHEN 'CreditAnalysisCompleted' THEN 'missing model_version' ELSE 'missing model_versions' END AS error FROM log WHERE event_version = 1 AND event_type IN ('CreditAnalysisCompleted', 'DecisionGenerated')")(Q.validate_schema)
query("g29_agent_attribution", """SELECT stream_id, agent_id, CASE WHEN event_type = 'CreditAnalysisCompleted' THEN session_id END AS session_id, event_type, min(stream_position) AS first_position, arg_min(score, stream_position) AS confidence_score
 FROM log WHERE event_type IN ('CreditAnalysisCompleted', 'DecisionGenerated') GROUP BY ALL""")(T.agent_attribution)
query("w10_dwell_times", ", g AS (SELECT event_type, date_diff('microsecond', recorded_at, lead(recorded_at) OVER (PARTITION BY stream_id ORDER BY stream_position)) // 1000000 AS s FROM log) SELECT event_type, count(*) AS n, CAST(sum(s) AS BIGINT) AS total_s, max(s) AS longest_s FROM g WHERE s IS NOT NULL GROUP BY event_type")(Q.dwell_times)
query("t9_stage_timeouts", """, a AS (SELECT * FROM log WHERE event_type = 'CreditAnalysisRequested'), d AS (SELECT * FROM log WHERE event_type = 'CreditAnalysisCompleted')
 SELECT a.stream_id, a.stream_position FROM a ASOF LEFT JOIN d ON a.stream_id = d.stream_id AND a.stream_position < d.stream_position WHERE d.recorded_at IS NULL OR date_diff('microsecond', a.recorded_at, d.recorded_at) // 1000000 > 86400""")(
    lambda log: stage_timeouts(log, "CreditAnalysisRequested", "CreditAnalysisCompleted", 86400))
# one event after the other, with the times of those allowed in the last day
query("t8_throttle", """, r AS (SELECT stream_id, stream_position, epoch_us(recorded_at) / 1e6 AS t, row_number() OVER (PARTITION BY stream_id ORDER BY recorded_at, stream_position) AS n FROM log),
 f(stream_id, stream_position, n, allowed, recent) AS (
  SELECT stream_id, stream_position, n, true, [t] FROM r WHERE n = 1 UNION ALL
  SELECT r.stream_id, r.stream_position, r.n, len(list_filter(f.recent, lambda x: x + 86400 > r.t)) < 2,
   CASE WHEN len(list_filter(f.recent, lambda x: x + 86400 > r.t)) < 2 THEN list_append(list_filter(f.recent, lambda x: x + 86400 > r.t), r.t) ELSE list_filter(f.recent, lambda x: x + 86400 > r.t) END
  FROM f JOIN r ON r.stream_id = f.stream_id AND r.n = f.n + 1)
 SELECT stream_id, stream_position, allowed FROM f""")(
    lambda log: Q.throttle(log.select("stream_id", "stream_position", F.col("stream_position").alias("ord"), "recorded_at"), "stream_id", "recorded_at", 2, 86400.0).select("stream_id", "stream_position", "allowed"))
ORACLES["t8_throttle"] = ORACLES["t8_throttle"].replace("WITH", "WITH RECURSIVE", 1)
query("u2_upcast", "SELECT global_position, CASE WHEN event_type IN ('CreditAnalysisCompleted', 'DecisionGenerated') THEN 2 ELSE event_version END AS event_version, CASE WHEN event_type = 'CreditAnalysisCompleted' AND event_version = 1 THEN CASE WHEN CAST(recorded_at AS DATE) < DATE '2024-01-01' THEN 'unknown' WHEN CAST(recorded_at AS DATE) < DATE '2024-07-01' THEN 'v1.0' WHEN CAST(recorded_at AS DATE) < DATE '2025-01-01' THEN 'v1.1' WHEN CAST(recorded_at AS DATE) < DATE '2026-01-01' THEN 'v2.0' ELSE 'v2.1' END WHEN event_type = 'CreditAnalysisCompleted' OR event_type = 'AgentContextLoaded' THEN model_version END AS model_version FROM log")(
    lambda log: V.upcast(log).select("global_position", "event_version", F.get_json_object("payload", "$.model_version").alias("model_version")))

_FOLD = f"SELECT stream_id, scenario, count(*) AS n, coalesce(arg_max(st, stream_position) FILTER (st IS NOT NULL), 'SUBMITTED') AS state, arg_max(risk_tier, stream_position) FILTER (event_type = 'CreditAnalysisCompleted') AS risk_tier, arg_max(score, stream_position) FILTER (event_type = 'FraudScreeningCompleted') AS fraud_score, arg_max({FLOORED}, stream_position) FILTER (event_type = 'DecisionGenerated') AS decision, arg_max(score, stream_position) FILTER (event_type IN ('DecisionGenerated', 'CreditAnalysisCompleted')) AS confidence_score, arg_max(final_decision, stream_position) FILTER (event_type = 'HumanReviewCompleted') AS final_decision, arg_max(reviewer_id, stream_position) FILTER (event_type = 'HumanReviewCompleted') AS human_reviewer_id, arg_max(value, stream_position) FILTER (event_type = 'ApplicationApproved') AS approved_amount_usd"
query("p2_outcome", f", l AS (SELECT *, {FLOOR_STATE} AS st, 'real' AS scenario FROM log WHERE stream_id LIKE 'loan-%'), o AS ({_FOLD} FROM l GROUP BY stream_id, scenario) SELECT stream_id, state, risk_tier, fraud_score, decision, confidence_score, final_decision, human_reviewer_id, approved_amount_usd FROM o")(
    lambda log: T.outcome(log).drop("compliance_status"))
_CF = '{"risk_tier":"HIGH","confidence_score":0.5}'
query("p1_what_if", f""", l AS (SELECT stream_id, CAST(stream_position AS DOUBLE) AS stream_position, event_type, risk_tier, score, recommendation, final_decision, reviewer_id, value, min(CASE WHEN event_type = 'CreditAnalysisCompleted' THEN stream_position END) OVER (PARTITION BY stream_id) AS branch_at FROM log WHERE stream_id LIKE 'loan-%'),
 f AS (SELECT *, stream_position > branch_at AND event_type IN ('DecisionGenerated','ApplicationApproved','ApplicationDeclined','HumanReviewCompleted') AS skip FROM l),
 u AS (SELECT stream_id, 'real' AS scenario, stream_position, event_type, risk_tier, score, recommendation, final_decision, reviewer_id, value FROM l UNION ALL
  SELECT stream_id, 'cf', stream_position, event_type, risk_tier, score, recommendation, final_decision, reviewer_id, value FROM f WHERE NOT coalesce(skip, false) AND NOT coalesce(stream_position = branch_at, false) UNION ALL
  SELECT stream_id, 'cf', coalesce(max(branch_at), max(stream_position) + 1), 'CreditAnalysisCompleted', 'HIGH', 0.5, NULL, NULL, NULL, NULL FROM l GROUP BY stream_id),
 o AS ({_FOLD} FROM (SELECT *, {FLOOR_STATE} AS st FROM u) z GROUP BY stream_id, scenario), sk AS (SELECT stream_id, count(*) FILTER (skip) AS events_skipped FROM f GROUP BY stream_id)
 SELECT r.stream_id, concat_ws(',', {", ".join(f"CASE WHEN r.{c} IS DISTINCT FROM c.{c} THEN '{c}' END" for c in ("state", "risk_tier", "fraud_score", "decision", "confidence_score", "final_decision", "human_reviewer_id", "approved_amount_usd"))}) AS divergence,
 c.n AS events_replayed, events_skipped, r.state AS real_state, c.state AS cf_state FROM o r JOIN o c ON r.stream_id = c.stream_id AND r.scenario = 'real' AND c.scenario = 'cf' JOIN sk ON sk.stream_id = r.stream_id""")(
    lambda log: T.what_if(log, "CreditAnalysisCompleted", F.lit(_CF), log.sparkSession.createDataFrame(T.DEPENDENTS, "branch string, dependent string")).select("stream_id", F.array_join("divergence", ",").alias("divergence"), "events_replayed", "events_skipped", F.col("real.state").alias("real_state"), F.col("counterfactual.state").alias("cf_state")))
query("p5_regulatory_package")(lambda log: T.regulatory_package(log.unionByName(S.mirror_to_audit(log)), "2030-01-01").select(
    "stream_id", F.size("events").alias("n_events"), F.col("summary.state").alias("state"), F.size("narrative").alias("n_sentences"), "checksum", "is_valid"))


def _middle(log):
    ends = log.agg(F.min("recorded_at").alias("a"), F.max("recorded_at").alias("b"))
    return ends.select(F.expr("a + (b - a) / 2").alias("moment"))  # one row


def _from_snapshot(log):
    at = _middle(log).first()["moment"]
    return T.state_from_snapshot(log, T.compliance_snapshots(log, 10), at)


def _schedule(log):
    schedule = log.sparkSession.createDataFrame(V.MODEL_SCHEDULE, "start string, end string, model string")
    schedule = schedule.select(F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), "model")
    return J.schedule_join(log.withColumn("recorded_at", F.expr("recorded_at + make_dt_interval(cast(global_position % 900 as int))")), schedule).select("global_position", "model")


def _renumber(log):
    return log.withColumn("stream_position", F.row_number().over(W.partitionBy("stream_id").orderBy("global_position")).cast("long"))


def _tampered(log):
    """One value of some payloads changed; others only written differently, which is no tampering."""
    bad = F.col("event_id").isNotNull() & (F.col("event_id").cast("long") % 997 == 0)
    changed = F.regexp_replace("payload", '"application_id":"', '"application_id":"X')
    return log.withColumn("payload", F.when(bad, changed).otherwise(F.regexp_replace("payload", '":', '" : ')))


def _plain_payload():
    """A payload whose keys aren't in order and that both engines can write."""
    return F.concat(F.lit('{"z": '), F.col("stream_position"), F.lit(', "a": "'), F.col("stream_id"), F.lit('"}'))


def _with_payload(log):
    return log.withColumn("payload", F.col("text")).drop("text")
