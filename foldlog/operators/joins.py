"""Joins between events: sessions, models, causes, schedules, missing and pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expressions import by_category, clean_app_id, typed
from ..schema import SESSION_ENDS

#: Trigger and completion of each stage, in order.
STAGES = {
    "credit": ("CreditAnalysisRequested", "CreditAnalysisCompleted"), "fraud": ("FraudScreeningRequested", "FraudScreeningCompleted"),
    "compliance": ("ComplianceCheckRequested", "ComplianceRulePassed"), "decision": ("DecisionRequested", "DecisionGenerated")}


def session_model_versions(log: DataFrame) -> DataFrame:
    """Model version of each session stream: that of its first context."""
    e = typed(by_category(log, "agent-")).where("event_type = 'AgentContextLoaded'")
    return e.groupBy("stream_id").agg(F.min_by(F.col("p")["model_version"], "stream_position").alias("model_version"))


def reconstruct_model_versions(log: DataFrame) -> DataFrame:
    """Old decisions without model_versions: global_position and the map from known contributing sessions to their models.

    Decisions whose sessions are all unknown keep an empty map.
    """
    e = typed(log.where("event_type = 'DecisionGenerated' and event_version = 1"))
    old = e.where(F.col("p")["model_versions"].isNull()).select("global_position", F.explode_outer(F.col("p")["contributing_agent_sessions"]).alias("session"))
    found = old.join(session_model_versions(log).withColumnRenamed("stream_id", "session"), "session", "left")
    entry = F.when(F.col("model_version").isNotNull(), F.struct("session", "model_version"))
    return found.groupBy("global_position").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("model_versions"))


def schedule_join(rows: DataFrame, schedule: DataFrame, ts: str = "recorded_at") -> DataFrame:
    """rows with the schedule's value whose [start, end) holds the UTC date; null outside. The schedule is a table of at most 1,000 rows; a longer one is an error."""
    if schedule.limit(1001).count() > 1000:
        raise ValueError("a schedule has more than 1000 rows")
    day = F.to_date(F.col(ts))
    return rows.join(F.broadcast(schedule), (day >= F.col("start")) & (day < F.col("end")), "left").drop("start", "end")


def checkpoint_lag(log: DataFrame, checkpoints: DataFrame, no_checkpoint: str = "first") -> DataFrame:
    """Milliseconds between each projection's last event and the newest one; never negative, 0 for an empty log.

    Without a checkpoint the lag counts from the first event ('first') or is 0 ('zero').
    """
    ends = log.agg(F.max_by("recorded_at", "global_position").alias("newest"), F.min_by("recorded_at", "global_position").alias("oldest"))
    at = checkpoints.join(log.select(F.col("global_position").alias("last_position"), F.col("recorded_at").alias("seen")), "last_position", "left")
    start = F.coalesce("seen", "oldest" if no_checkpoint == "first" else "newest")
    # one row of two timestamps
    lag = F.greatest(F.timestamp_diff("MILLISECOND", F.col("from"), F.col("newest")), F.lit(0))
    return at.join(F.broadcast(ends)).withColumn("from", start).select("name", "last_position", F.coalesce(lag, F.lit(0)).alias("lag_ms"))


def decision_sessions(log: DataFrame) -> DataFrame:
    """global_position, application (bare) and contributing session of each decision on a loan stream."""
    e = typed(by_category(log, "loan-")).where("event_type = 'DecisionGenerated'")
    p = F.col("p")
    return e.select("global_position", clean_app_id(p["application_id"]).alias("application_id"), F.explode(p["contributing_agent_sessions"]).alias("session"))


def causal_chain_violations(log: DataFrame) -> DataFrame:
    """Decisions that cite a session which never worked on the application."""
    worked = typed(by_category(log, "agent-")).where("event_type != 'AgentContextLoaded'").select(
        F.col("stream_id").alias("session"), clean_app_id(F.col("p")["application_id"]).alias("application_id")).distinct()
    return decision_sessions(log).join(worked, ["session", "application_id"], "left_anti")


def decision_model_versions(log: DataFrame) -> DataFrame:
    """Per decision, agent and model of its contributing sessions (the sessions' last state)."""
    own = typed(by_category(log, "agent-")).where("event_type = 'AgentContextLoaded'").groupBy(F.col("stream_id").alias("session")).agg(
        F.max_by(F.col("p")["agent_id"], "stream_position").alias("agent_id"), F.max_by(F.col("p")["model_version"], "stream_position").alias("model_version"))
    return decision_sessions(log).join(own, "session").select("global_position", "agent_id", "model_version").distinct()


def pending_work_items(log: DataFrame) -> DataFrame:
    """Applications and stages whose trigger stands after the last completion, or that never were completed."""
    e = typed(log)
    app, t = F.col("p")["application_id"], F.col("event_type")
    marks = F.array(*(F.when(t.isin(*pair), F.struct(F.lit(s).alias("stage"), (t == pair[0]).alias("asked"))) for s, pair in STAGES.items()))
    rows = e.select(app.alias("application_id"), "global_position", F.explode(F.array_compact(marks)).alias("m"))
    per = rows.where("application_id is not null").groupBy("application_id", "m.stage").agg(
        F.max(F.when(F.col("m.asked"), F.col("global_position"))).alias("asked_at"), F.max(F.when(~F.col("m.asked"), F.col("global_position"))).alias("done_at"))
    return per.where("asked_at is not null and (done_at is null or done_at < asked_at)")


def missing_trigger(log: DataFrame, stage: str) -> DataFrame:
    """Applications with a submission but no trigger of the stage."""
    e = typed(log).select(F.col("p")["application_id"].alias("application_id"), "event_type")
    apps = e.where("event_type = 'ApplicationSubmitted'").select("application_id").distinct()
    return apps.join(e.where(F.col("event_type") == STAGES[stage][0]).select("application_id"), "application_id", "left_anti")


def sessions_without_context(log: DataFrame) -> DataFrame:
    first = by_category(log, "agent-").groupBy("stream_id").agg(F.min_by("event_type", "stream_position").alias("first_type"))
    return first.where("first_type != 'AgentContextLoaded'")


def orphan_events(log: DataFrame) -> DataFrame:
    """Events of applications that were never submitted."""
    e = typed(log).withColumn("application_id", F.col("p")["application_id"]).where("application_id is not null")
    submitted = e.where("event_type = 'ApplicationSubmitted'").select("application_id").distinct()
    return e.join(submitted, "application_id", "left_anti").select("global_position", "application_id", "event_type")


def causation_chain(log: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Events of every correlation and how many causes of that correlation stand above each (up to max_depth, if given).

    Pointers double: after n rounds each event knows its cause 2**n steps up, so a chain takes the logarithm of its
    length in rounds. Events on a cycle of causes are under no root and left out. Rounds are checkpointed.
    """
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    own = log.select("event_id", meta("correlation_id").alias("correlation_id"), meta("causation_id").alias("up"), "event_type", "global_position").where("correlation_id is not null")
    causes = own.select(F.col("event_id").alias("up"), "correlation_id", F.lit(1).alias("d"))
    now = own.join(causes, ["up", "correlation_id"], "left").select("event_id", F.when(F.col("d") == 1, F.col("up")).alias("up"), F.coalesce("d", F.lit(0)).alias("depth")).checkpoint()
    longest, reach = now.count(), 1
    while reach <= longest and not now.where("up is not null").isEmpty():
        next_ = now.select(F.col("event_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        now = now.join(next_, "up", "left").select("event_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")).checkpoint()
        reach *= 2
    out = own.drop("up").join(now.where("up is null").drop("up"), "event_id")
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def entity_timeline(log: DataFrame) -> DataFrame:
    """All events of each application across streams, with their number in order of time and position."""
    app = F.coalesce(F.get_json_object("payload", "$.application_id"), F.when(F.col("stream_id").startswith("loan-"), clean_app_id(F.col("stream_id"))))
    e = log.withColumn("application_id", app).where("application_id is not null")
    return e.select("application_id", "stream_id", "event_type", "global_position", "recorded_at", F.row_number().over(
        W.partitionBy("application_id").orderBy("recorded_at", "global_position")).alias("seq"))


def latest_stage_results(log: DataFrame) -> DataFrame:
    """Per application the last credit, fraud and compliance result."""
    e, t, p = typed(log), F.col("event_type"), F.col("p")
    reg = lambda v, *types: F.max(F.when(t.isin(*types), F.struct("global_position", v.alias("v"))))["v"]
    return e.where(p["application_id"].isNotNull() & ~F.col("stream_id").startswith("audit-")).groupBy(p["application_id"].alias("application_id")).agg(
        reg(p["risk_tier"], "CreditAnalysisCompleted").alias("risk_tier"), reg(p["fraud_score"], "FraudScreeningCompleted").alias("fraud_score"),
        reg(t, "ComplianceRulePassed", "ComplianceRuleFailed").alias("compliance"))


def open_sessions(log: DataFrame) -> DataFrame:
    """Agent streams that were begun and not ended."""
    ends = by_category(log, "agent-").groupBy("stream_id").agg(F.max_by("event_type", "stream_position").alias("last_type"))
    return ends.where(~F.col("last_type").isin(*SESSION_ENDS))
