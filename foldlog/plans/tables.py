"""Registered queries over the other tables: applicants, appends, sessions, extraction, streaming."""

from __future__ import annotations

import tempfile
import uuid
from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import expressions as X
from ..operators import quality as Q
from ..operators import registry as G
from ..operators import rules as U
from ..operators.readmodels import compliance_totals
from ..sources import log as S
from ..streaming import FOLDS, latest_by_key, read_latest, replay, run_projection, stream_progress
from .fixtures import LOG, events_log, table
from .folds import ORACLES as FOLD_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def companies(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    legal = F.element_at(F.array(*map(F.lit, ("LLC", "Corporation", "Partnership", "Sole Proprietor", "LLC", "Corporation", "LLC", "Corporation"))), (F.col("c_custkey") % 8 + 1).cast("int"))
    trend = F.element_at(F.array(*map(F.lit, ("GROWTH", "STABLE", "DECLINING", "RECOVERING", "VOLATILE"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("COMP-"), "c_custkey").alias("company_id"), F.col("c_mktsegment").alias("industry"),
        F.when(F.col("c_nationkey") == 3, "MT").otherwise(F.col("n_name")).alias("jurisdiction"), legal.alias("legal_type"),
        (2000 + F.col("c_custkey") % 26).alias("founded_year"), trend.alias("trajectory"))


def flags(spark, d):
    c = table(spark, d, "customer")
    both = F.array_compact(F.array(
        F.when(F.col("c_acctbal") < 0, F.struct(F.lit("AML_WATCH").alias("flag_type"), F.lit("MEDIUM").alias("severity"))),
        F.when(F.col("c_custkey") % 17 == 0, F.struct(F.lit("SANCTIONS_REVIEW").alias("flag_type"), F.lit("HIGH").alias("severity")))))
    return c.select(F.concat(F.lit("COMP-"), "c_custkey").alias("company_id"), (F.col("c_custkey") % 2 == 0).alias("is_active"), F.lit(None).cast("string").alias("note"), F.explode(both).alias("f")).select("company_id", "is_active", "note", "f.*")


def history(spark, d):
    o = table(spark, d, "orders")
    h = o.groupBy("o_custkey", F.year("o_orderdate").alias("fiscal_year")).agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("total_revenue"))
    a, li = F.round(F.col("total_revenue") * 1.8, 2), F.round(F.col("total_revenue") * 0.9, 2)
    return h.select(F.concat(F.lit("COMP-"), "o_custkey").alias("company_id"), "fiscal_year", "total_revenue", a.alias("total_assets"), li.alias("total_liabilities"),
                    F.round(a - li + F.when(F.col("o_custkey") % 11 == 0, 500).otherwise(0), 2).alias("total_equity"))


def loans(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.select(F.concat(F.lit("COMP-"), "o_custkey").alias("company_id"), F.col("o_totalprice").alias("loan_amount"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 7 == 0)).alias("default_occurred"))


def applications(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("APP-"), "o_orderkey").alias("application_id"), F.concat(F.lit("COMP-"), "o_custkey").alias("company_id"), F.col("o_totalprice").alias("requested_amount"), "o_orderkey")


CO = """WITH co AS (SELECT 'COMP-' || c_custkey AS company_id, c_custkey, c_mktsegment AS industry, CASE WHEN c_nationkey = 3 THEN 'MT' ELSE n_name END AS jurisdiction,
  ['LLC','Corporation','Partnership','Sole Proprietor','LLC','Corporation','LLC','Corporation'][c_custkey % 8 + 1] AS legal_type, 2000 + c_custkey % 26 AS founded_year,
  ['GROWTH','STABLE','DECLINING','RECOVERING','VOLATILE'][c_custkey % 5 + 1] AS trajectory, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
fl AS (SELECT company_id, c_custkey % 2 = 0 AS is_active, 'AML_WATCH' AS flag_type, 'MEDIUM' AS severity FROM co WHERE c_acctbal < 0 UNION ALL SELECT company_id, c_custkey % 2 = 0, 'SANCTIONS_REVIEW', 'HIGH' FROM co WHERE c_custkey % 17 = 0),
h0 AS (SELECT o_custkey, year(o_orderdate) AS fiscal_year, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS DOUBLE) AS total_revenue FROM orders GROUP BY ALL),
h1 AS (SELECT *, round(total_revenue * 1.8, 2) AS total_assets, round(total_revenue * 0.9, 2) AS total_liabilities FROM h0),
h AS (SELECT 'COMP-' || o_custkey AS company_id, fiscal_year, total_revenue, total_assets, total_liabilities, round(total_assets - total_liabilities + CASE WHEN o_custkey % 11 = 0 THEN 500 ELSE 0 END, 2) AS total_equity FROM h1),
lo AS (SELECT 'COMP-' || o_custkey AS company_id, o_totalprice AS loan_amount, o_orderpriority = '1-URGENT' AND o_custkey % 7 = 0 AS default_occurred FROM orders WHERE o_orderstatus = 'F'),
ap AS (SELECT 'APP-' || o_orderkey AS application_id, 'COMP-' || o_custkey AS company_id, o_totalprice AS requested_amount, o_orderkey FROM orders)
"""
query("a17_companies", CO + "SELECT company_id, industry, jurisdiction, legal_type, founded_year, trajectory FROM co")(companies)
query("a18_financial_history", CO + "SELECT company_id, fiscal_year, total_revenue FROM h WHERE fiscal_year IN (1995, 1996)")(lambda s, d: G.financial_history(history(s, d), [1995, 1996]).select("company_id", "fiscal_year", "total_revenue"))
query("a19_compliance_flags", CO + "SELECT company_id, flag_type, severity, '' AS note FROM fl WHERE is_active")(lambda s, d: G.compliance_flags(flags(s, d), True).drop("is_active"))
query("a20_loan_relationships", CO + "SELECT * FROM lo")(loans)
query("a21_upsert_companies", CO + ", u AS (SELECT company_id || CASE WHEN c_custkey % 3 = 0 THEN '-new' ELSE '' END AS company_id, 'NEW' AS industry FROM co WHERE c_custkey % 2 = 0) SELECT coalesce(u.company_id, co.company_id) AS company_id, coalesce(u.industry, co.industry) AS industry, jurisdiction FROM co FULL JOIN u ON co.company_id = u.company_id")(
    lambda s, d: _upsert(s, d))
query("a22_insert_ignore", CO + "SELECT company_id, 'old' AS note FROM co WHERE c_custkey % 2 = 0 UNION ALL SELECT company_id, 'new' FROM co WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")(lambda s, d: _insert(s, d))
query("f27_balance_sheet_check", CO + "SELECT company_id, fiscal_year, abs(total_assets - total_liabilities - total_equity) < 1.0 AS balanced FROM h")(lambda s, d: G.balance_sheet_check(history(s, d)).select("company_id", "fiscal_year", "balanced"))
query("j8_application_registry", CO + """, ly AS (SELECT company_id, max(fiscal_year) AS fiscal_year, arg_max(total_revenue, fiscal_year) AS total_revenue FROM h GROUP BY company_id),
 f AS (SELECT company_id, bool_or(is_active) AS has_flag FROM fl GROUP BY company_id), p AS (SELECT company_id, count(*) AS prior_loans, bool_or(default_occurred) AS has_default FROM lo GROUP BY company_id)
 SELECT application_id, company_id, jurisdiction, fiscal_year, total_revenue, coalesce(has_flag, false) AS has_flag, coalesce(prior_loans, 0) AS prior_loans, coalesce(has_default, false) AS has_default FROM ap LEFT JOIN co USING (company_id) LEFT JOIN ly USING (company_id) LEFT JOIN f USING (company_id) LEFT JOIN p USING (company_id)""")(
    lambda s, d: _joined(s, d).select("application_id", "company_id", "jurisdiction", "fiscal_year", "total_revenue", "has_flag", "prior_loans", "has_default"))
query("f29_risk_segment", CO + """, f AS (SELECT company_id, bool_or(is_active) AS flag FROM fl GROUP BY company_id), p AS (SELECT company_id, bool_or(default_occurred) AS def FROM lo GROUP BY company_id)
 SELECT application_id, CASE WHEN coalesce(def, false) OR coalesce(flag, false) THEN 'HIGH' WHEN trajectory IN ('GROWTH', 'STABLE') THEN CASE WHEN requested_amount < 100000 THEN 'LOW' ELSE 'MEDIUM' END ELSE 'MEDIUM' END AS segment FROM ap LEFT JOIN co USING (company_id) LEFT JOIN f USING (company_id) LEFT JOIN p USING (company_id)""")(
    lambda s, d: _joined(s, d).select("application_id", G.risk_segment(F.col("trajectory"), F.when(F.col("requested_amount") < 100000, 0.3).otherwise(0.5), F.col("has_default"), F.col("has_flag")).alias("segment")))
_REG = CO + """, b AS (SELECT application_id, coalesce(bool_or(flag_type = 'AML_WATCH' AND is_active), false) AS aml, coalesce(bool_or(flag_type = 'SANCTIONS_REVIEW' AND is_active), false) AS san FROM ap LEFT JOIN fl USING (company_id) GROUP BY application_id),
 a AS (SELECT ap.application_id, aml, san, jurisdiction, legal_type, founded_year, requested_amount FROM ap JOIN co USING (company_id) JOIN b USING (application_id)),
 r AS (SELECT application_id, unnest([{'o': 0, 'id': 'REG-001', 'ok': NOT aml, 'hard': false}, {'o': 1, 'id': 'REG-002', 'ok': NOT san, 'hard': true}, {'o': 2, 'id': 'REG-003', 'ok': jurisdiction <> 'MT', 'hard': true},
  {'o': 3, 'id': 'REG-004', 'ok': NOT (legal_type = 'Sole Proprietor' AND requested_amount > 250000), 'hard': false}, {'o': 4, 'id': 'REG-005', 'ok': 2025 - founded_year >= 2, 'hard': true}, {'o': 5, 'id': 'REG-006', 'ok': true, 'hard': false}]) AS x FROM a),
 st AS (SELECT application_id, min(x.o) FILTER (x.hard AND NOT x.ok) AS stop FROM r GROUP BY application_id),
 ev AS (SELECT application_id, x.id AS rule_id, CASE WHEN x.id = 'REG-006' THEN 'NOTED' WHEN x.ok THEN 'PASSED' ELSE 'FAILED' END AS status, x.hard AND NOT x.ok AS is_block FROM r JOIN st USING (application_id) WHERE x.o <= coalesce(stop, 6))"""
query("r10_evaluate_regulations", _REG + " SELECT * FROM ev")(lambda s, d: _regulated(s, d))
query("g21_compliance_verdict", _REG + " SELECT application_id, count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'NOTED') AS noted, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (status = 'FAILED'), '') AS failed_rules, CASE WHEN bool_or(is_block) THEN 'BLOCKED' WHEN bool_or(status = 'FAILED') THEN 'CONDITIONAL' ELSE 'CLEAR' END AS verdict FROM ev GROUP BY application_id")(
    lambda s, d: U.compliance_verdict(_regulated(s, d)))
query("g20_historical_profile", CO + ", p AS (SELECT company_id, bool_or(default_occurred) AS def FROM lo GROUP BY company_id) SELECT company_id, string_agg(DISTINCT fiscal_year, ',' ORDER BY fiscal_year) AS years, def IS NOT NULL AS has_prior_loans, coalesce(def, false) AS has_defaults FROM h LEFT JOIN p USING (company_id) GROUP BY company_id, def")(
    lambda s, d: G.historical_profile(history(s, d), loans(s, d)))
query("g28_registry_distributions", CO + "SELECT trajectory, jurisdiction, count(*) AS n FROM co GROUP BY ALL")(lambda s, d: companies(s, d).groupBy("trajectory", "jurisdiction").agg(F.count("*").alias("n")))
query("r14_credit_policy", CO + """, p AS (SELECT company_id, bool_or(default_occurred) AS def FROM lo GROUP BY company_id), f AS (SELECT company_id, bool_or(is_active AND severity = 'HIGH') AS hi FROM fl GROUP BY company_id),
 ly AS (SELECT company_id, arg_max(total_revenue, fiscal_year) AS rev FROM h GROUP BY company_id), x AS (SELECT application_id, requested_amount, floor(0.35 * rev) AS cap, coalesce(def, false) AS def, coalesce(hi, false) AS hi FROM ap LEFT JOIN p USING (company_id) LEFT JOIN f USING (company_id) LEFT JOIN ly USING (company_id))
 SELECT application_id, CASE WHEN cap > 0 AND requested_amount > cap THEN cap ELSE requested_amount END AS limit_usd, CASE WHEN def THEN 'HIGH' ELSE 'MEDIUM' END AS risk_tier, CASE WHEN hi THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence,
 concat_ws('; ', CASE WHEN cap > 0 AND requested_amount > cap THEN 'POLICY_REV_CAP: limit capped at 35% of revenue ($' || format('{:,}', CAST(cap AS BIGINT)) || ')' END,
 CASE WHEN def THEN 'POLICY_PRIOR_DEFAULT: risk_tier elevated to HIGH' END, CASE WHEN hi THEN 'POLICY_COMPLIANCE_FLAG: confidence capped at 0.50' END) AS overrides FROM x""")(
    lambda s, d: G.credit_policy(_joined(s, d).select("application_id", F.col("total_revenue").alias("revenue"), "has_default", "has_high_flag", F.col("requested_amount").alias("limit_usd"), F.lit("MEDIUM").alias("risk_tier"), F.lit(0.8).alias("confidence"))).select(
        "application_id", "limit_usd", "risk_tier", "confidence", "overrides"))
query("r16_decision_constraints", """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'BLOCKED' ELSE 'CLEAR' END AS verdict, (o_orderkey % 100) / 100.0 AS c, (o_orderkey % 71) / 71.0 AS f, ['LOW','MEDIUM','HIGH'][o_orderkey % 3 + 1] AS tier FROM orders), y AS (SELECT *, CASE WHEN c = 0 THEN 0.5 ELSE c END AS cc FROM x)
 SELECT id, CASE WHEN tier = 'HIGH' AND cc < 0.7 THEN 'REFER' WHEN f > 0.6 THEN 'REFER' WHEN cc < 0.6 THEN 'REFER' WHEN verdict = 'BLOCKED' THEN 'DECLINE' ELSE 'APPROVE' END AS final_recommendation,
 concat_ws(',', CASE WHEN verdict = 'BLOCKED' THEN 'COMPLIANCE_BLOCKED' END, CASE WHEN cc < 0.6 THEN 'CONFIDENCE_FLOOR' END, CASE WHEN f > 0.6 THEN 'FRAUD_SCORE_THRESHOLD' END, CASE WHEN tier = 'HIGH' AND cc < 0.7 THEN 'HIGH_RISK_CONFIDENCE_FLOOR' END) AS constraints FROM y""")(
    lambda s, d: U.decision_constraints(table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 13 == 0, "BLOCKED").otherwise("CLEAR").alias("verdict"), (F.col("o_orderkey") % 100 / 100.0).alias("confidence"), (F.col("o_orderkey") % 71 / 71.0).alias("fraud_score"),
        F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("risk_tier"), F.lit("APPROVE").alias("recommendation"))).select("id", "final_recommendation", "constraints"))
query("r12_fraud_signals", CO + """, ly AS (SELECT company_id, arg_max(total_revenue, fiscal_year) AS rev, arg_max(total_assets, fiscal_year) AS ta, arg_max(total_liabilities, fiscal_year) AS tl, arg_max(total_equity, fiscal_year) AS te FROM h GROUP BY company_id),
 x AS (SELECT application_id, abs(requested_amount - rev) / greatest(abs(rev), 1) > 0.40 AND trajectory NOT IN ('GROWTH', 'RECOVERING') AS rs, abs(ta - tl - te) / greatest(ta, 1) > 0.05 AS bs FROM ap JOIN co USING (company_id) JOIN ly USING (company_id))
 SELECT application_id, rs AS revenue_signal, bs AS balance_signal, round(0.05 + CASE WHEN rs THEN 0.25 ELSE 0 END + CASE WHEN bs THEN 0.20 ELSE 0 END, 2)::DOUBLE AS fraud_score FROM x""")(
    lambda s, d: G.fraud_signals(_joined(s, d).select("application_id", F.col("requested_amount").alias("claimed_revenue"), F.col("total_revenue").alias("registered_revenue"), F.col("total_assets").alias("assets"), F.col("total_liabilities").alias("liabilities"), F.col("total_equity").alias("equity"), "trajectory")).select(
        "application_id", "revenue_signal", "balance_signal", "fraud_score"))
query("f24_first_json_object", "SELECT event_id, props AS found FROM events")(lambda s, d: table(s, d, "events").select("event_id", X.first_json_object(F.concat(F.lit("answer: "), "props", F.lit(" end"))).alias("found")))
query("g25_session_sequence", "SELECT 'agent-conv-' || conv_id AS stream_id, arg_min(role, turn) = 'system' AS begins, arg_max(role, turn) = 'assistant' AS ends, bool_or(role = 'user') AS has_user FROM conversations GROUP BY conv_id")(
    lambda s, d: Q.session_sequence_check(table(s, d, "conversations").select(F.concat(F.lit("agent-conv-"), "conv_id").alias("stream_id"), F.col("role").alias("event_type"), (F.col("turn") + 1).alias("stream_position")), "system", "assistant", ["user"]))
query("g22_session_totals", "SELECT l_orderkey AS session_id, count(*) AS nodes, count(*) FILTER (l_returnflag = 'R') AS llm_calls, CAST(sum(l_partkey) AS BIGINT) AS tokens_in, CAST(sum(l_suppkey) AS BIGINT) AS tokens_out, round(sum(l_partkey / 1e6 * 3 + l_suppkey / 1e6 * 15), 6) AS cost, sum(l_quantity) AS duration_ms FROM lineitem GROUP BY l_orderkey")(
    lambda s, d: Q.session_totals(table(s, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_returnflag") == "R").alias("llm_called"), F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"), F.col("l_quantity").alias("duration_ms"))))


def proposals(spark, d):
    order = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("loan-"), "l_orderkey").alias("stream_id"), F.row_number().over(order).cast("long").alias("ord"),
        F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("l_linenumber") - 1).cast("long").alias("expected_version"))


def _heads(spark):
    return spark.createDataFrame([], "stream_id string, version long")


query("a8_append_events", """WITH RECURSIVE p AS (SELECT 'loan-' || l_orderkey AS stream_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS ord, CASE WHEN l_linenumber = 1 THEN -1 ELSE l_linenumber - 1 END AS expected FROM lineitem),
 f AS (SELECT stream_id, ord, expected, -1 AS head, expected = -1 AS ok FROM p WHERE ord = 1 UNION ALL
  SELECT p.stream_id, p.ord, p.expected, CASE WHEN f.ok THEN greatest(f.head, 0) + 1 ELSE f.head END, p.expected = CASE WHEN f.ok THEN greatest(f.head, 0) + 1 ELSE f.head END FROM f JOIN p ON p.stream_id = f.stream_id AND p.ord = f.ord + 1)
 SELECT stream_id, ord, greatest(head, 0) + 1 AS stream_position FROM f WHERE ok""")(
    lambda s, d: S.append_events(proposals(s, d), _heads(s))[0].select("stream_id", "ord", "stream_position"))
query("a9_admit_groups")(lambda s, d: S.admit_groups(proposals(s, d).withColumn("group_id", F.shiftleft(F.floor(F.regexp_extract("stream_id", r"(\d+)", 1).cast("long") / 3), 20) + F.col("ord")), _heads(s)))
query("a10_assign_global_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS global_position FROM orders")(
    lambda s, d: S.assign_global_positions(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("global_position").cast("long").alias("global_position")))
query("t1_streaming_projection", LOG + "SELECT stream_id, count(*) AS n, max(stream_position) AS version, arg_max(event_type, stream_position) AS last_type FROM log GROUP BY stream_id")(lambda s, d: _streamed(s, d, stream_progress, ["stream_id"]))
query("t5_bounded_replay", LOG + """, b AS (SELECT max(global_position) // 4 AS lo, max(global_position) // 4 * 3 AS hi FROM log)
 SELECT stream_id, count(*) AS n, max(stream_position) AS version, arg_max(event_type, stream_position) AS last_type FROM log, b WHERE global_position BETWEEN lo AND hi GROUP BY stream_id""")(lambda s, d: _replayed(s, d))
query("t7_application_summary", FOLD_SQL["g1_application_summary"])(
    lambda s, d: _folded(s, d, "application_summary").withColumn("agent_sessions", F.array_join("agent_sessions_completed", ",")).drop("agent_sessions_completed"))
query("t7_loan_state", FOLD_SQL["g10_loan_state"])(
    lambda s, d: _folded(s, d, "loan_state").withColumn("model_versions", F.array_join("model_versions", ",")).drop("contributing_sessions"))
query("t7_session_state", FOLD_SQL["g11_session_state"])(lambda s, d: _folded(s, d, "session_state").drop("contributed_apps"))
query("t7_compliance_current", FOLD_SQL["g4_compliance_current"])(lambda s, d: compliance_totals(_folded(s, d, "compliance_registers")))


def _shared(spark):
    """The folder that driver and executors share; only a local master may go without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _streamed(spark, d, fold, keys, run=run_projection):
    """What a stream over the log, in several micro-batches, has kept of a fold at its end."""
    base = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    events_log(spark, d).repartitionByRange(4, "global_position").write.parquet(f"{base}/log")
    events = spark.readStream.schema(spark.read.parquet(f"{base}/log").schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/log")
    run(events, fold, latest_by_key(spark, f"{base}/out", keys), f"{base}/checkpoint").awaitTermination()
    return read_latest(spark, f"{base}/out", keys)


def _folded(spark, d, name):
    return _streamed(spark, d, *FOLDS[name])


def _replayed(spark, d):
    newest = table(spark, d, "events").agg(F.max("event_id") + 1).first()[0] or 0
    return _streamed(spark, d, stream_progress, ["stream_id"], partial(replay, first=newest // 4, last=newest // 4 * 3))


def _upsert(s, d):
    c = companies(s, d).select("company_id", "industry", "jurisdiction")
    key = F.regexp_extract("company_id", r"(\d+)", 1).cast("long")
    new = c.where(key % 2 == 0).select(F.concat("company_id", F.when(key % 3 == 0, "-new").otherwise("")).alias("company_id"), F.lit("NEW").alias("industry"), F.lit(None).cast("string").alias("jurisdiction"))
    return S.upsert(c, new, "company_id", ["industry"])


def _insert(s, d):
    c, key = companies(s, d).select("company_id"), F.regexp_extract("company_id", r"(\d+)", 1).cast("long")
    return S.insert_ignore(c.where(key % 2 == 0).withColumn("note", F.lit("old")), c.where(key % 3 == 0).withColumn("note", F.lit("new")), ["company_id"])


def _joined(s, d):
    return G.application_registry_join(applications(s, d), companies(s, d), history(s, d), flags(s, d), loans(s, d))


def _regulated(s, d):
    f = flags(s, d).where("is_active").groupBy("company_id").agg(F.bool_or(F.col("flag_type") == "AML_WATCH").alias("aml_watch"), F.bool_or(F.col("flag_type") == "SANCTIONS_REVIEW").alias("sanctions"))
    apps = applications(s, d).join(companies(s, d), "company_id").join(f, "company_id", "left").fillna(False, ["aml_watch", "sanctions"])
    return U.evaluate_regulations(apps, 2025, s.createDataFrame(U.REGULATIONS, U.RULE_DDL))
