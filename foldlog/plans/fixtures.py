"""Event logs derived from the driver's tables, by Spark (logs with JSON payloads) and in SQL (flat, for the oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EVENT_TYPE = """CASE event_type WHEN 'signup' THEN 'ApplicationSubmitted'
  WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'CreditAnalysisRequested' WHEN 1 THEN 'ComplianceCheckRequested' WHEN 2 THEN 'FraudScreeningRequested' ELSE 'AgentContextLoaded' END
  WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'CreditAnalysisCompleted' WHEN 1 THEN 'FraudScreeningCompleted' ELSE 'ComplianceRulePassed' END
  WHEN 'error' THEN 'ComplianceRuleFailed'
  ELSE CASE k % 4 WHEN 0 THEN 'DecisionGenerated' WHEN 1 THEN 'HumanReviewCompleted' WHEN 2 THEN 'ApplicationApproved' ELSE 'ApplicationDeclined' END END"""

#: The log as SQL that both engines run: flat, one column for each payload field; null where the type has no such field.
FLAT = f"""SELECT event_id + 1 AS global_position, 'APP-' || user_id AS app, 'a' || user_id % 10 AS agent_id, 's' || user_id AS session_id,
  event_id, user_id, k, value, ts, {EVENT_TYPE} AS event_type FROM (SELECT *, {{k}} AS k FROM events) e0"""

LOG = f"""WITH e1 AS ({FLAT.format(k="CAST(json_extract_string(props, '$.k') AS INTEGER)")}),
e2 AS (SELECT *, CASE WHEN event_type = 'AgentContextLoaded' THEN 'agent-' || agent_id || '-' || session_id
    WHEN event_type LIKE 'ComplianceRule%' THEN 'compliance-' || app ELSE 'loan-' || app END AS stream_id,
  CASE WHEN event_type IN ('CreditAnalysisCompleted', 'DecisionGenerated') AND k % 2 = 1 THEN 2 ELSE 1 END AS event_version,
  CASE k % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_tier,
  CASE k % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'DECLINE' ELSE 'REFER' END AS recommendation,
  CASE k % 2 WHEN 0 THEN 'APPROVE' ELSE 'DECLINE' END AS final_decision, k / 100.0::DOUBLE AS score,
  CASE k % 5 WHEN 0 THEN 'KYC' WHEN 1 THEN 'AML' WHEN 2 THEN 'FRAUD_SCREEN' WHEN 3 THEN 'DATA_PRIVACY' ELSE 'MODEL_BIAS' END AS rule_id,
  k * 10.0::DOUBLE AS duration_ms, 'v' || (k % 3 + 1) || '.0' AS version_name, k % 5 = 0 AS is_override, 'rev-' || k % 7 AS reviewer_id FROM e1),
log AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY event_id) AS stream_position, ts AS recorded_at,
  CASE WHEN event_type = 'AgentContextLoaded' OR event_version = 2 THEN version_name END AS model_version FROM e2)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of table events: the envelope with JSON payloads that hold only the keys of their type."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("type", F.expr(EVENT_TYPE)).withColumn("app", F.concat(F.lit("APP-"), F.col("user_id")))
    agent, session = F.concat(F.lit("a"), F.col("user_id") % 10), F.concat(F.lit("s"), F.col("user_id"))
    stream = F.when(F.col("type") == "AgentContextLoaded", F.concat_ws("-", F.lit("agent"), agent, session)).when(
        F.col("type").startswith("ComplianceRule"), F.concat(F.lit("compliance-"), F.col("app"))).otherwise(F.concat(F.lit("loan-"), F.col("app")))
    k, t = F.col("k"), F.col("type")
    version = F.when(t.isin("CreditAnalysisCompleted", "DecisionGenerated") & (k % 2 == 1), 2).otherwise(1)
    only = lambda types, c: F.when(t.isin(*types), c)
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), k % n + 1)
    credit, fraud, decision = "CreditAnalysisCompleted", "FraudScreeningCompleted", "DecisionGenerated"
    payload = F.struct(
        F.when(t != "AgentContextLoaded", F.col("app")).alias("application_id"),
        only(["ApplicationSubmitted"], F.concat(F.lit("U"), F.col("user_id"))).alias("applicant_id"),
        only(["ApplicationSubmitted"], F.col("value")).alias("requested_amount_usd"),
        only(["AgentContextLoaded", credit, fraud], agent).alias("agent_id"),
        only(["AgentContextLoaded", credit, fraud], session).alias("session_id"),
        F.when((t == "AgentContextLoaded") | ((t == credit) & (version == 2)), F.concat(F.lit("v"), k % 3 + 1, F.lit(".0"))).alias("model_version"),
        only([credit], pick(3, "LOW", "MEDIUM", "HIGH")).alias("risk_tier"),
        only([credit, decision], k / F.lit(100.0)).alias("confidence_score"),
        only([credit], k * F.lit(10.0)).alias("analysis_duration_ms"),
        only([fraud], k / F.lit(100.0)).alias("fraud_score"),
        F.when(t.startswith("ComplianceRule"), pick(5, "KYC", "AML", "FRAUD_SCREEN", "DATA_PRIVACY", "MODEL_BIAS")).alias("rule_id"),
        only([decision], agent).alias("orchestrator_agent_id"),
        only([decision], pick(3, "APPROVE", "DECLINE", "REFER")).alias("recommendation"),
        only([decision], F.array(F.concat_ws("-", F.lit("agent"), agent, session))).alias("contributing_agent_sessions"),
        F.when((t == decision) & (version == 2), F.create_map(agent, F.concat(F.lit("v"), k % 3 + 1, F.lit(".0")))).alias("model_versions"),
        only(["HumanReviewCompleted"], F.concat(F.lit("rev-"), k % 7)).alias("reviewer_id"),
        only(["HumanReviewCompleted"], k % 5 == 0).alias("override"),
        only(["HumanReviewCompleted"], pick(2, "APPROVE", "DECLINE")).alias("final_decision"),
        only(["ApplicationApproved"], F.col("value")).alias("approved_amount_usd"),
    )
    metadata = F.struct(
        F.concat(F.lit("corr-"), F.col("user_id")).alias("correlation_id"),
        F.lag(F.col("event_id").cast("string")).over(W.partitionBy("user_id").orderBy("event_id")).alias("causation_id"))
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), stream.alias("stream_id"),
        F.row_number().over(W.partitionBy(stream).orderBy("event_id")).cast("long").alias("stream_position"),
        (F.col("event_id") + 1).alias("global_position"), t.alias("event_type"), version.alias("event_version"),
        F.to_json(payload).alias("payload"), F.to_json(metadata).alias("metadata"), F.col("ts").alias("recorded_at"))
