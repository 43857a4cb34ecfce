"""Registered queries over document packages, outcomes, commands and profiles, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import facts as D
from ..operators import joins as J
from ..operators import outcomes as O
from ..operators import registry as G
from ..operators import rules as U
from ..operators.scans import running_averages
from ..sources import log as S
from .fixtures import LOG, events_log, table
from .tables import CO, _REG, _joined, _regulated, applications, companies, history

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def packages(spark, d):
    """Document events of each order: a line is an upload, an extraction or an assessment."""
    line = table(spark, d, "lineitem")
    n = F.col("l_linenumber") % 4
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    facts = F.struct(
        F.when(F.col("l_partkey") % 3 != 0, F.floor("l_extendedprice")).alias("total_revenue"), F.when(F.col("l_suppkey") % 2 == 0, 0).otherwise(F.col("l_suppkey")).alias("net_income"),
        F.when(F.col("l_linenumber") != 1, F.col("l_partkey")).alias("total_assets"), F.when(F.col("l_suppkey") % 5 == 0, F.array(F.concat(F.lit("note-"), "l_suppkey"))).alias("extraction_notes"))
    payload = F.when(n == 3, F.to_json(F.struct(F.concat(F.lit("DOC-"), "l_partkey").alias("document_id"), F.concat(F.lit("/docs/"), "l_partkey", F.lit(".csv")).alias("file_path")))).when(
        n == 0, F.to_json(F.struct(
            F.when(F.col("l_partkey") % 2 == 0, F.array(F.concat(F.lit("anomaly-"), F.col("l_partkey") % 10))).alias("anomalies"),
            F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("ebitda"))).alias("critical_missing_fields")))).otherwise(F.to_json(F.struct(facts.alias("facts"))))
    return line.select(
        F.concat(F.lit("docpkg-APP-"), "l_orderkey").alias("stream_id"), F.row_number().over(order).cast("long").alias("stream_position"),
        F.when(n == 0, "QualityAssessmentCompleted").when(n == 3, "DocumentUploaded").otherwise("ExtractionCompleted").alias("event_type"), payload.alias("payload"))


_PK = """WITH pk AS (SELECT *, 'docpkg-APP-' || l_orderkey AS stream_id, l_linenumber % 4 AS kind,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos FROM lineitem),
 ex AS (SELECT stream_id, pos, CASE WHEN l_partkey % 3 <> 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS total_revenue,
  CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE l_suppkey END AS net_income, CASE WHEN l_linenumber <> 1 THEN l_partkey END AS total_assets,
  CASE WHEN l_suppkey % 5 = 0 THEN '["note-' || l_suppkey || '"]' END AS extraction_notes FROM pk WHERE kind IN (1, 2)),
 m AS (SELECT stream_id, fact, arg_min(value, pos) AS value FROM (
  SELECT stream_id, pos, 'total_revenue' AS fact, CAST(total_revenue AS VARCHAR) AS value FROM ex UNION ALL SELECT stream_id, pos, 'net_income', CAST(net_income AS VARCHAR) FROM ex
  UNION ALL SELECT stream_id, pos, 'total_assets', CAST(total_assets AS VARCHAR) FROM ex UNION ALL SELECT stream_id, pos, 'extraction_notes', extraction_notes FROM ex)
  WHERE value IS NOT NULL GROUP BY stream_id, fact)
"""
query("g17_merged_facts", _PK + "SELECT * FROM m")(lambda s, d: D.merged_facts(packages(s, d)))
query("g18_quality_flags", _PK + """, f AS (SELECT stream_id, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS phase, pos, unnest(CASE WHEN kind = 0 THEN
  list_concat(CASE WHEN l_partkey % 2 = 0 THEN ['anomaly-' || l_partkey % 10] ELSE [] END, CASE WHEN l_suppkey % 3 = 0 THEN ['CRITICAL_MISSING:ebitda'] ELSE [] END)
  WHEN l_suppkey % 5 = 0 THEN ['note-' || l_suppkey] ELSE [] END) AS flag FROM pk WHERE kind <> 3),
 o AS (SELECT DISTINCT stream_id FROM pk WHERE kind <> 3)
 SELECT o.stream_id, coalesce(string_agg(flag, ',' ORDER BY phase, pos, flag LIKE 'CRITICAL%'), '') AS flags FROM o LEFT JOIN f USING (stream_id) GROUP BY o.stream_id""")(
    lambda s, d: D.quality_flags(packages(s, d)).select("stream_id", F.array_join("flags", ",").alias("flags")))
query("g31_document_inventory", _PK + "SELECT stream_id, string_agg('DOC-' || l_partkey, ',' ORDER BY pos) AS document_ids, string_agg('/docs/' || l_partkey || '.csv', ',' ORDER BY pos) AS file_paths FROM pk WHERE kind = 3 GROUP BY stream_id")(
    lambda s, d: D.document_inventory(packages(s, d)).select("stream_id", F.array_join("document_ids", ",").alias("document_ids"), F.array_join("file_paths", ",").alias("file_paths")))
query("f22_facts_from_text", """SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS total_revenue, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) END AS net_income,
 CAST(o_orderkey * 1000 AS DOUBLE) AS total_assets, CAST(NULL AS DOUBLE) AS total_liabilities, CAST(o_custkey * 3 AS DOUBLE) AS ebitda FROM orders""")(
    lambda s, d: D.facts_from_text(table(s, d, "orders").select("o_orderkey", F.concat(
        F.lit("Notes on TOTAL REVENUE: $"), F.format_number(F.floor("o_totalprice"), 0), F.lit(" net. "), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Net income "), "o_custkey")).otherwise("no profit"),
        F.lit("\ntotal assets:  "), F.col("o_orderkey") * 1000, F.lit("; EBITDA $"), F.col("o_custkey") * 3).alias("text"))).drop("text"))
query("f23_facts_from_rows", """WITH r AS (SELECT l_orderkey, ['total_revenue', 'net_income', 'other'][l_linenumber % 3 + 1] AS field, l_partkey AS value,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS n FROM lineitem)
 SELECT l_orderkey, CAST(arg_max(value, n) FILTER (field = 'total_revenue') AS DOUBLE) AS total_revenue, CAST(arg_max(value, n) FILTER (field = 'net_income') AS DOUBLE) AS net_income FROM r WHERE field <> 'other' GROUP BY l_orderkey""")(
    lambda s, d: D.facts_from_rows(table(s, d, "lineitem").select(
        "l_orderkey", F.element_at(F.array(F.lit("Total_Revenue"), F.lit("net_income"), F.lit("other")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("field"), F.col("l_partkey").cast("string").alias("value"),
        F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")).alias("ordinal")), "l_orderkey").select("l_orderkey", "total_revenue", "net_income"))


def statements(s, d):
    """The financial history with the lines that ratios need, as shares of revenue."""
    h, share = history(s, d), lambda x: F.round(F.col("total_revenue") * x, 2)
    return h.withColumns({"gross_profit": share(0.4), "ebitda": share(0.2), "operating_income": share(0.15), "interest_expense": share(0.03), "net_income": share(0.08),
                          "current_assets": F.round(F.col("total_assets") * 0.4, 2), "current_liabilities": F.round(F.col("total_liabilities") * 0.3, 2)})


_ST = CO + """, st AS (SELECT *, round(total_revenue * 0.4, 2) AS gross_profit, round(total_revenue * 0.2, 2) AS ebitda, round(total_revenue * 0.15, 2) AS operating_income, round(total_revenue * 0.03, 2) AS interest_expense,
 round(total_revenue * 0.08, 2) AS net_income, round(total_assets * 0.4, 2) AS current_assets, round(total_liabilities * 0.3, 2) AS current_liabilities FROM h),
ra AS (SELECT *, round(total_liabilities / greatest(total_equity, 1), 2) AS debt_to_equity, round(current_assets / greatest(current_liabilities, 1), 2) AS current_ratio, round(total_liabilities / greatest(ebitda, 1), 2) AS debt_to_ebitda,
 round(operating_income / greatest(interest_expense, 1), 2) AS interest_coverage, round(gross_profit / greatest(total_revenue, 1), 2) AS gross_margin, round(ebitda / greatest(total_revenue, 1), 2) AS ebitda_margin,
 round(net_income / greatest(total_revenue, 1), 2) AS net_margin FROM st)
"""
_RATIOS = ["debt_to_equity", "current_ratio", "debt_to_ebitda", "interest_coverage", "gross_margin", "ebitda_margin", "net_margin"]
query("f26_financial_ratios", _ST + f"SELECT company_id, fiscal_year, {', '.join(_RATIOS)} FROM ra")(lambda s, d: G.financial_ratios(statements(s, d)).select("company_id", "fiscal_year", *_RATIOS))
query("f28_derived_statement_lines", _ST + """SELECT company_id, fiscal_year, round(total_revenue - gross_profit, 2) AS cost_of_revenue, round(total_assets - current_assets, 2) AS non_current_assets,
 round(total_liabilities + total_equity, 2) AS liabilities_and_equity FROM st""")(
    lambda s, d: D.derived_statement_lines(statements(s, d)).select("company_id", "fiscal_year", *(F.round(c, 2).alias(c) for c in ("cost_of_revenue", "non_current_assets", "liabilities_and_equity"))))
query("f30_credit_score", _ST + """, x AS (SELECT company_id, fiscal_year, (1 - least(debt_to_ebitda / 6, 1)) * 0.3::DOUBLE + least(current_ratio / 2, 1) * 0.25::DOUBLE + (1 - least(debt_to_equity / 3, 1)) * 0.25::DOUBLE
  + (CASE WHEN trajectory IN ('GROWTH', 'STABLE') THEN 0.3::DOUBLE WHEN trajectory = 'DECLINING' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END) * 0.2::DOUBLE AS s FROM ra JOIN co USING (company_id))
 SELECT company_id, fiscal_year, CASE WHEN s > 0.7::DOUBLE THEN 'LOW' WHEN s > 0.45::DOUBLE THEN 'MEDIUM' ELSE 'HIGH' END AS risk_tier, round(0.55::DOUBLE + s * 0.38::DOUBLE, 2) AS confidence FROM x""")(
    lambda s, d: D.credit_score(G.financial_ratios(statements(s, d)).join(companies(s, d), "company_id")).select("company_id", "fiscal_year", "risk_tier", "confidence"))

_OUT = "json_extract_string(payload, '$.application_id')"
query("r11_compliance_outcomes", _REG + """, b AS (SELECT application_id, min(rule_id) FILTER (is_block) AS rule FROM ev GROUP BY application_id)
 SELECT 'loan-' || application_id AS stream_id, CASE WHEN rule IS NULL THEN 'DecisionRequested' ELSE 'ApplicationDeclined' END AS event_type, CASE WHEN rule IS NULL THEN '{"application_id":"' || application_id || '"}'
 ELSE '{"application_id":"' || application_id || '","reason":"Compliance hard block: ' || rule || '","adverse_action_notice_required":true}' END AS payload FROM b""".replace(", b AS", ", bb AS").replace("FROM b\n", "FROM bb\n").replace("FROM b", "FROM bb"))(
    lambda s, d: O.compliance_outcome_events(_regulated(s, d)))
query("g23_node_profile", """SELECT 'agent-' || l_suppkey % 5 AS agent_type, l_returnflag AS node_name, count(*) AS runs, round(avg(l_quantity), 6) AS avg_duration_ms, CAST(max(l_quantity) AS DOUBLE) AS max_duration_ms,
 round(sum(l_partkey / 1e6), 6) AS cost FROM lineitem GROUP BY ALL""")(
    lambda s, d: O.node_profile(table(s, d, "lineitem").select(F.concat(F.lit("agent-"), F.col("l_suppkey") % 5).alias("agent_type"), F.col("l_returnflag").alias("node_name"), F.col("l_quantity").cast("double").alias("duration_ms"), (F.col("l_partkey") / 1e6).alias("cost"))).withColumns(
        {"avg_duration_ms": F.round("avg_duration_ms", 6), "cost": F.round("cost", 6)}))


@query("w9_running_averages", LOG + """SELECT global_position, agent_id, round(sum(score) OVER w, 2) / count(*) OVER w AS running_confidence
 FROM log WHERE event_type = 'CreditAnalysisCompleted' WINDOW w AS (PARTITION BY agent_id ORDER BY global_position ROWS UNBOUNDED PRECEDING)""")
def _running_averages(s, d):
    rows = X.typed(events_log(s, d).where("event_type = 'CreditAnalysisCompleted'")).select("global_position", F.col("p.agent_id").alias("agent_id"), F.col("p.confidence_score").alias("score"))
    return running_averages(rows, ["agent_id"], F.col("score"), span=4096).select("global_position", "agent_id", (F.round("running_sum", 2) / F.col("running_count")).alias("running_confidence"))



# What a sound log doesn't hold: events lost, doubled or written out of turn
_APP = "cast(substring_index(stream_id, '-', -1) as int)"
query("a25_check_constraints", LOG + """, b AS (SELECT stream_id, CASE WHEN event_id % 97 = 0 THEN stream_position + 1 ELSE stream_position END AS pos FROM log)
 SELECT 'unique' AS rule, stream_id || '@' || pos AS key, count(*) AS n FROM b GROUP BY stream_id, pos HAVING count(*) > 1
 UNION ALL SELECT 'dense', stream_id, max(pos) - count(DISTINCT pos) FROM b GROUP BY stream_id HAVING max(pos) <> count(DISTINCT pos)
 UNION ALL SELECT 'not_null', 'event_type', count(*) FROM log WHERE event_id % 101 = 0""")(
    lambda s, d: S.check_constraints(events_log(s, d).withColumns({
        "stream_position": F.col("stream_position") + (F.col("event_id").cast("long") % 97 == 0).cast("long"), "event_type": F.when(F.col("event_id").cast("long") % 101 != 0, F.col("event_type"))})))
query("j12_sessions_without_context", LOG + """, x AS (SELECT stream_id, stream_position, CASE WHEN user_id % 3 = 0 AND stream_position = 1 THEN 'CreditAnalysisRequested' ELSE event_type END AS t FROM log WHERE stream_id LIKE 'agent-%')
 SELECT stream_id, arg_min(t, stream_position) AS first_type FROM x GROUP BY stream_id HAVING arg_min(t, stream_position) <> 'AgentContextLoaded'""")(
    lambda s, d: J.sessions_without_context(events_log(s, d).withColumn("event_type", F.when(
        F.expr("stream_id like 'agent-%' and stream_position = 1 and cast(substring_index(stream_id, '-s', -1) as int) % 3 = 0"), "CreditAnalysisRequested").otherwise(F.col("event_type")))))
query("j15_orphan_events", LOG + """SELECT global_position, app AS application_id, event_type FROM log WHERE event_type NOT IN ('AgentContextLoaded', 'ApplicationSubmitted') AND
 (user_id % 4 = 0 OR app NOT IN (SELECT app FROM log WHERE event_type = 'ApplicationSubmitted'))""")(
    lambda s, d: J.orphan_events(events_log(s, d).where(f"not (event_type = 'ApplicationSubmitted' and {_APP} % 4 = 0)")))
query("r4_decision_needs_sessions", LOG + "SELECT stream_id, stream_position, global_position, event_type FROM log WHERE event_type = 'DecisionGenerated' AND k % 8 = 4")(
    lambda s, d: U.rule_violations(events_log(s, d).withColumn("payload", F.when(
        F.expr("event_type = 'DecisionGenerated' and cast(round(cast(get_json_object(payload, '$.confidence_score') as double) * 100) as int) % 8 = 4"),
        F.regexp_replace("payload", r'"contributing_agent_sessions":\[[^\]]*\]', '"contributing_agent_sessions":[]')).otherwise(F.col("payload"))), "causal_chain"))
