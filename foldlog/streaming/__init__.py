"""Continuous read models over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import in_shard
from ..operators.aggregates import compliance_rule_registers, loan_state, session_state
from ..operators.readmodels import application_summary, compliance_registers, performance_parts
from .health import ProjectionHealth
from .relay import dead, drain, relay_outbox, take_in
from .stateful import reviews_as_of, session_views, start_stateful, streamed_timeouts
from .tables import KeyedTable, latest_by_key, read_latest

__all__ = [
    "FOLDS", "KeyedTable", "ProjectionHealth", "dead", "drain", "latest_by_key", "quarantine", "read_latest", "relay_outbox", "replay", "reviews_as_of", "run_projection", "session_views", "stage_timeouts",
    "start_stateful", "stream_progress", "streamed_timeouts", "take_in"]

#: Read models that are one aggregation of mergeable registers, so that a stream keeps them as it is, and the keys of their rows.
#: Totals follow from the registers: compliance_totals, compliance_record_totals, performance_totals.
FOLDS = {
    "application_summary": (application_summary, ["application_id"]), "loan_state": (loan_state, ["stream_id"]),
    "session_state": (session_state, ["stream_id"]), "compliance_registers": (compliance_registers, ["application_id", "rule_id"]),
    "compliance_rule_registers": (compliance_rule_registers, ["stream_id", "rule_id"]), "performance_parts": (performance_parts, ["agent_id", "model_version", "part"])}


def run_projection(events: DataFrame, fn: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, name: str | None = None) -> StreamingQuery:
    """One query per projection, with a checkpoint of its own; fn folds mergeable registers (groupBy and max of structs). Health goes by name.

    sink gets the groups that a micro-batch changed, whole; writing them again has the same effect.
    """
    out = fn(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    out = out.queryName(name) if name else out
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="5 seconds")).start()


def replay(events: DataFrame, fn: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, first: int, last: int) -> StreamingQuery:
    """A projection over the positions first to last only, which ends with them."""
    return run_projection(events.where(in_shard(F.col("global_position"), F.lit(first), F.lit(last))), fn, sink, checkpoint)


def stream_progress(events: DataFrame) -> DataFrame:
    """Per stream: events, head, last type: the fold that the streaming queries share with the batch ones."""
    return events.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.max("stream_position").alias("version"), F.max(F.struct("stream_position", "event_type"))["event_type"].alias("last_type"))


def quarantine(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those whose payload is no JSON object: a deterministic fold would fail on them each time."""
    good = F.try_parse_json("payload").isNotNull() & F.coalesce(F.json_object_keys("payload").isNotNull(), F.lit(False))
    return log.where(good), log.where(~good)


def stage_timeouts(log: DataFrame, asked: str, done: str, seconds: int) -> DataFrame:
    """Requests of a stream with no completion within so many seconds after them."""
    next_done = F.first(F.when(F.col("event_type") == done, F.col("recorded_at")), ignorenulls=True).over(
        W.partitionBy("stream_id").orderBy("stream_position").rowsBetween(1, W.unboundedFollowing))
    e = log.where(F.col("event_type").isin(asked, done)).withColumn("done_time", next_done).where(F.col("event_type") == asked)
    late = F.col("done_time").isNull() | (F.timestamp_diff("SECOND", F.col("recorded_at"), F.col("done_time")) > seconds)
    return e.where(late).select("stream_id", "stream_position")
