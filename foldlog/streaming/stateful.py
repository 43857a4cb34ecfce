"""Streams that a single aggregation can't fold: session views, reviews as of decisions, timeouts. State is keyed, order is by position.

Events may come in any order and more than once; a row's position tells whether it is known. Each call on a state goes through a socket
and each data frame costs milliseconds, so a key's state is read and written in few calls a batch, whatever its events, and rows stay rows.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.expressions import by_category, subscribe, summary_line, typed
from ..operators.readmodels import REVIEWED
from ..schema import SESSION_ENDS, SESSION_PARTIAL, SESSION_TYPES

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH, _MICRO = datetime(1970, 1, 1), timedelta(microseconds=1)
VIEW_DDL = (
    "session_id string, agent_id string, model_version string, is_active boolean, last_completed_action string, pending_work string, needs_reconciliation boolean, "
    "total_events long, recent_events array<struct<stream_position: long, event_type: string, payload: string>>, summary array<string>")


def start_stateful(out: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query over keyed state, which RocksDB keeps on the executors and in the checkpoint."""
    spark = out.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        to = out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
        return (to.trigger(availableNow=True) if available_now else to.trigger(processingTime="5 seconds")).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class SessionViews(StatefulProcessor):
    """One session: registers by position, the last events whole, and a line for each older one. Its row holds all lines, and so does its state."""

    OWN = (
        "begun_at long, agent_id string, model_version string, active_at long, is_active boolean, done_at long, done string, last_at long, last_type string, "
        "recent array<struct<stream_position: long, event_type: string, payload: string, line: string>>, older array<struct<stream_position: long, line: string>>")

    def __init__(self, tail: int = 3):
        self.tail = tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("own", self.OWN)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        begun_at, agent, model, active_at, active, done_at, done, last_at, last_type, recent, older = self.own.get() or (-1, None, None, -1, True, -1, None, -1, None, [], [])
        events, lines = {r[0]: tuple(r) for r in recent}, {r[0]: r[1] for r in older}
        for r in rows:
            at, kind = r.stream_position, r.event_type
            if at in events or at in lines:
                continue
            begins, ends, partial = kind in ("AgentContextLoaded", "DecisionOrchestratorSessionStarted"), kind in SESSION_ENDS, kind in SESSION_PARTIAL
            if begins and at > begun_at:
                begun_at, agent, model = at, r.agent_id, r.model_version
            if (begins or ends) and at > active_at:
                active_at, active = at, not ends
            if not partial and at > done_at:
                done_at, done = at, kind
            if at > last_at:
                last_at, last_type = at, kind
            events[at] = (at, kind, r.payload, r.line)
            if len(events) > self.tail:
                oldest = events.pop(min(events))
                lines[oldest[0]] = oldest[3]
        recent, older = sorted(events.values(), key=lambda r: r[0]), sorted(lines.items())
        self.own.update((begun_at, agent, model, active_at, active, done_at, done, last_at, last_type, recent, older))
        partial = last_type in SESSION_PARTIAL
        yield Row(
            session_id=key[0], agent_id=agent, model_version=model, is_active=active, last_completed_action=done, pending_work=last_type if partial else None, needs_reconciliation=partial,
            total_events=len(events) + len(lines), recent_events=[Row(stream_position=r[0], event_type=r[1], payload=r[2]) for r in recent], summary=[line for _, line in older])

    def close(self) -> None:
        pass


def session_views(events: DataFrame, tail: int = 3) -> DataFrame:
    """The rows of agent_session_view that a micro-batch changes, whole."""
    p = F.col("p")
    e = typed(by_category(subscribe(events, list(SESSION_TYPES)), "agent-")).select(
        "stream_id", "stream_position", "event_type", "payload", F.coalesce(p["agent_id"], F.lit("unknown")).alias("agent_id"),
        F.coalesce(p["model_version"], F.lit("unknown")).alias("model_version"), summary_line(F.col("event_type"), p["application_id"]).alias("line"))
    return e.groupBy("stream_id").transformWithState(SessionViews(tail), VIEW_DDL, "Update", "None")


class ReviewsAsOf(StatefulProcessor):
    """One application: each review gets the last decision before it. In order it needs the newest decision alone; what comes late is looked up.

    A batch's new events are one entry of the state, by their first position.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "at long, made_at long, agent_id string, model_version string")
        self.seen = handle.getMapState(
            "seen", "first long", "events array<struct<at: long, is_decision: boolean, agent_id: string, model_version: string, override: boolean, micros: long>>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at, *newest = self.head.get() or (-1, -1, None, None)
        new = {r.global_position: (r.global_position, r.is_decision, r.agent_id, r.model_version, r.override, (r.recorded_at - _EPOCH) // _MICRO) for r in rows}
        known: dict[int, tuple] = {}
        if min(new) <= at:
            known = {e[0]: tuple(e) for _, v in self.seen.iterator() for e in v[0]}
            new = {place: e for place, e in new.items() if place not in known}
        if not new:
            return
        self.seen.updateValue((min(new),), (sorted(new.values(), key=lambda e: e[0]),))
        was = before = tuple(newest) if not known else (-1, None, None)  # the last decision without and with the new events
        for place in sorted(known.keys() | new.keys()):
            _, is_decision, agent, model, override, micros = known.get(place) or new[place]
            if is_decision:
                before = (place, agent, model)
                was = before if place in known else was
            elif place in new or was[0] != before[0]:
                yield Row(application_id=key[0], global_position=place, agent_id=before[1], model_version=before[2], override=override, recorded_at=_EPOCH + micros * _MICRO)
        self.head.update((max(at, *new), *before))

    def close(self) -> None:
        pass


REVIEWS_DDL = "application_id string, global_position long, agent_id string, model_version string, override boolean, recorded_at timestamp_ntz"


def reviews_as_of(events: DataFrame) -> DataFrame:
    """The rows of review_attribution that a micro-batch adds or, by a decision that came late, changes; keyed by global_position."""
    p = F.col("p")
    e = typed(subscribe(events, list(REVIEWED))).where(~F.col("stream_id").startswith("audit-")).select(
        p["application_id"].alias("application_id"), "global_position", (F.col("event_type") == "DecisionGenerated").alias("is_decision"), p["orchestrator_agent_id"].alias("agent_id"),
        F.try_element_at(p["model_versions"], p["orchestrator_agent_id"]).alias("model_version"), F.coalesce(p["override"], F.lit(False)).alias("override"), "recorded_at")
    return e.groupBy("application_id").transformWithState(ReviewsAsOf(), REVIEWS_DDL, "Update", "None")


class Timeouts(StatefulProcessor):
    """One stream: the times (microseconds) of open requests and of completions by position, and one timer, for the end that comes first."""

    OWN = "asked array<struct<at: long, micros: long>>, done array<struct<at: long, micros: long>>, timer long"

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", self.OWN)

    def _ends(self, micros: int) -> int:
        """Milliseconds at which so many whole seconds are over."""
        return micros // 1000 + 1000 * (self.seconds + 1) + 1

    def _get(self) -> tuple[dict[int, int], dict[int, int], int | None]:
        asked, done, timer = self.own.get() or ([], [], None)
        return {r[0]: r[1] for r in asked}, {r[0]: r[1] for r in done}, timer

    def _keep(self, asked: dict[int, int], done: dict[int, int], timer: int | None) -> None:
        """Writes the state, with a timer (the one that is set, or None) for the first end."""
        first = min(map(self._ends, asked.values()), default=None)
        if first is not None and (timer is None or first < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.own.update((sorted(asked.items()), sorted(done.items()), timer))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        asked, done, timer = self._get()
        for r in rows:
            (asked if r.asks else done)[r.stream_position] = r.micros
        self._keep(asked, done, timer)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        asked, done, _ = self._get()
        # what the watermark has passed is over, too, and needs no timer of its own
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        over = sorted(at for at, micros in asked.items() if self._ends(micros) <= now)
        places = sorted(done)
        for at in over:
            micros, i = asked.pop(at), bisect(places, at)
            if i == len(places) or (done[places[i]] - micros) // 1_000_000 > self.seconds:
                yield Row(stream_id=key[0], stream_position=at)
        # no request before it is open, and none can come that is older than the watermark
        still = min(asked, default=None)
        self._keep(asked, {at: micros for at, micros in done.items() if self._ends(micros) >= now or (still is not None and at >= still)}, None)

    def close(self) -> None:
        pass


def streamed_timeouts(events: DataFrame, asked: str, done: str, seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """stage_timeouts as a stream: a request's row comes once, when the watermark has passed its end and a second; a later completion withdraws nothing.

    Events older than the watermark (the newest recorded_at less lateness) don't count. The watermark follows all event types,
    so any event moves time on.
    """
    times = events.withColumn("event_time", F.col("recorded_at").cast("timestamp")).withWatermark("event_time", lateness)
    # the condition names event_time, or else it would be pushed below the watermark, which then missed the other types
    e = times.where(F.when(F.col("event_time").isNotNull(), F.col("event_type").isin(asked, done))).select(
        "stream_id", "stream_position", (F.col("event_type") == asked).alias("asks"), F.unix_micros("event_time").alias("micros"), "event_time")
    return e.groupBy("stream_id").transformWithState(Timeouts(seconds), "stream_id string, stream_position long", "Update", "EventTime")
