"""Registered queries that run as streams: stateful views, timeouts and the relay, fed with the log in several runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import aggregates as A
from ..operators.readmodels import performance_parts, performance_totals
from ..sources.log import outbox_rows
from ..streaming import KeyedTable, relay_outbox, reviews_as_of, run_projection, session_views, start_stateful, streamed_timeouts
from ..streaming.relay import OUTBOX_DDL
from .fixtures import LOG, events_log, table
from .folds import ORACLES as FOLD_SQL
from .tables import _shared

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _runs(spark, d, start: Callable[[DataFrame, str], list[StreamingQuery]], order: tuple[int, ...], tick: bool = False) -> str:
    """Appends the log to a folder by ranges of positions, in an order of its own, and runs the streams over it after each; their folder.

    tick: at the end an event of no stream of interest, two days after all others, so that time moves past them.
    """
    base = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    log = events_log(spark, d)
    log.write.parquet(f"{base}/whole")
    log = spark.read.parquet(f"{base}/whole")
    top = log.agg(F.max("global_position"), F.max("recorded_at")).first()
    size = (top[0] or 0) // len(order) + 1
    parts = [log.where((F.col("global_position") > i * size) & (F.col("global_position") <= (i + 1) * size)) for i in order]
    if tick and top[0]:
        one = log.where(F.col("global_position") == top[0]).limit(1)
        parts.append(one.withColumns({"stream_id": F.lit("clock"), "event_type": F.lit("Tick"), "recorded_at": F.expr("recorded_at + interval 2 days 1 hour")}))
    for part in parts:
        part.write.mode("append").parquet(f"{base}/log")
        for q in start(spark.readStream.schema(log.schema).parquet(f"{base}/log"), base):
            q.awaitTermination()
    return base


@query("t7_agent_session_view", FOLD_SQL["g8_agent_session_view"])
def _session_views(spark, d):
    keys = ["session_id"]
    base = _runs(spark, d, lambda events, b: [start_stateful(session_views(events), KeyedTable(spark, f"{b}/out", keys).sink(), f"{b}/checkpoint")], (1, 0, 2))
    return KeyedTable(spark, f"{base}/out", keys).read().withColumn("summary", F.array_join("summary", "|")).drop("recent_events", "last_completed_action")


@query("t7_agent_performance", FOLD_SQL["g2_agent_performance"])
def _performance(spark, d):
    parts = lambda b: KeyedTable(spark, f"{b}/parts", ["agent_id", "model_version", "part"])
    reviews = lambda b: KeyedTable(spark, f"{b}/reviews", ["global_position"])
    base = _runs(spark, d, lambda events, b: [
        run_projection(events, performance_parts, parts(b).sink(), f"{b}/parts-checkpoint"), start_stateful(reviews_as_of(events), reviews(b).sink(), f"{b}/reviews-checkpoint")], (2, 0, 1))
    return performance_totals(parts(base).read(), reviews(base).read(), "override").select(
        "agent_id", "model_version", "analyses_completed", "decisions_generated", F.round("avg_confidence_score", 9).alias("avg_confidence_score"), F.round("approve_rate", 9).alias("approve_rate"),
        "human_reviews_total", "human_overrides_total", "first_seen_at", "last_seen_at", F.round("avg_duration_ms", 6).alias("avg_duration_ms"))


@query("t7_compliance_record", FOLD_SQL["g12_compliance_record"])
def _compliance(spark, d):
    keys = ["stream_id", "rule_id"]
    base = _runs(spark, d, lambda events, b: [run_projection(events, A.compliance_rule_registers, KeyedTable(spark, f"{b}/out", keys).sink(), f"{b}/checkpoint")], (1, 2, 0))
    return A.compliance_record_totals(KeyedTable(spark, f"{base}/out", keys).read()).select(
        "stream_id", F.array_join("passed", ",").alias("passed"), F.array_join("failed", ",").alias("failed"), "is_passed")


@query("t9_streamed_timeouts", FOLD_SQL["t9_stage_timeouts"])
def _timeouts(spark, d):
    keys = ["stream_id", "stream_position"]
    base = _runs(spark, d, lambda events, b: [start_stateful(
        streamed_timeouts(events, "CreditAnalysisRequested", "CreditAnalysisCompleted", 86400), KeyedTable(spark, f"{b}/out", keys, "stream_id string, stream_position long").sink(), f"{b}/checkpoint")],
        (0, 1, 2), tick=True)
    return KeyedTable(spark, f"{base}/out", keys, "stream_id string, stream_position long").read()


@query("a13_relay", LOG + "SELECT CAST(event_id AS VARCHAR) AS event_id, least(event_id % 7, 5) AS attempts, event_id % 7 < 5 AS published, event_id % 7 >= 5 AS dead FROM log")
def _relayed(spark, d):
    """A publisher that fails on an event so often as its id leaves over by 7; five attempts are the end."""
    publish = lambda rows: rows.select("event_id", (F.col("attempts") >= F.col("event_id").cast("long") % 7).alias("ok"))
    outbox = lambda b: KeyedTable(spark, f"{b}/outbox", ["event_id"], OUTBOX_DDL)
    size = 100_000
    lanes = table(spark, d, "events").count() // size + 1  # a publisher for so many rows as it takes in a round
    base = _runs(spark, d, lambda events, b: [relay_outbox(outbox_rows(events), outbox(b), publish, f"{b}/checkpoint", batch_size=size, lanes=lanes)], (0,))
    published = F.col("published_at").isNotNull()
    return outbox(base).read().select("event_id", F.col("attempts").cast("long").alias("attempts"), published.alias("published"), (~published & (F.col("attempts") >= 5)).alias("dead"))
