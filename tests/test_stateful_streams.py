"""Keyed tables, stateful streams and the relay: order, replays, crashes, and how many files a reader meets."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foldlog.operators import readmodels
from foldlog.sources.log import outbox_rows
from foldlog.streaming import (
    KeyedTable, dead, drain, latest_by_key, relay_outbox, reviews_as_of, run_projection, session_views, stage_timeouts, start_stateful, streamed_timeouts, take_in)
from foldlog.streaming.relay import OUTBOX_DDL

from .test_folds import make


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def feed(spark, log, folder, start, orders):
    """Writes the positions of each list of orders and runs the stream over what is new."""
    for positions in orders:
        log.where(F.col("global_position").isin(positions)).write.mode("append").parquet(f"{folder}/log")
        start(spark.readStream.schema(log.schema).parquet(f"{folder}/log")).awaitTermination()


def history(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        app, agent = f"A{rng.randrange(4)}", f"a{rng.randrange(2)}"
        session = f"agent-{agent}-s{rng.randrange(2)}"
        kind = rng.choice(["AgentContextLoaded", "CreditAnalysisCompleted", "FraudScreeningCompleted", "DecisionGenerated", "HumanReviewCompleted", "SessionTerminated"])
        payload = {"application_id": app, "agent_id": agent, "model_version": f"v{rng.randrange(2)}", "analysis_duration_ms": float(rng.randrange(4)), "confidence_score": rng.random()}
        if kind == "DecisionGenerated":
            payload |= {"orchestrator_agent_id": agent, "recommendation": rng.choice(["APPROVE", "REFER"]), "model_versions": {agent: "v1"} if rng.random() < 0.8 else {}}
        if kind == "HumanReviewCompleted":
            payload |= {"override": rng.random() < 0.5}
        own = kind in ("AgentContextLoaded", "SessionTerminated") or (kind != "HumanReviewCompleted" and rng.random() < 0.5)
        out.append((session if own else f"loan-{app}", kind, payload))
    return out


SPLITS = [[list(range(1, 21)), list(range(21, 41)), list(range(41, 61))], [list(range(41, 61)), list(range(1, 41, 2)), list(range(2, 41, 2))], [random.Random(1).sample(range(1, 61), 60)[i::3] for i in range(3)]]


@pytest.mark.parametrize("orders", SPLITS)
def test_session_view_as_a_stream_equals_batch(spark, tmp_path, orders):
    log, table = make(spark, history(60, 5)), KeyedTable(spark, f"{tmp_path}/out", ["session_id"])
    twice = lambda df, b: (table.write(df, b), table.write(df, b))
    feed(spark, log, tmp_path, lambda e: start_stateful(session_views(e), twice, f"{tmp_path}/checkpoint"), [*orders, orders[0][:7]])
    assert plain(table.read()) == plain(readmodels.agent_session_view(log))


@pytest.mark.parametrize("orders", SPLITS)
def test_agent_performance_as_a_stream_equals_batch(spark, tmp_path, orders, monkeypatch):
    monkeypatch.setattr(readmodels, "RANGE", 8)
    log = make(spark, history(60, 6))
    parts, reviews = KeyedTable(spark, f"{tmp_path}/parts", ["agent_id", "model_version", "part"]), KeyedTable(spark, f"{tmp_path}/reviews", ["global_position"])

    def start(e):
        run_projection(e, readmodels.performance_parts, parts.sink(), f"{tmp_path}/parts-checkpoint").awaitTermination()
        return start_stateful(reviews_as_of(e), reviews.sink(), f"{tmp_path}/reviews-checkpoint")

    feed(spark, log, tmp_path, start, orders)
    assert plain(reviews.read()) == plain(readmodels.review_attribution(log))
    want = readmodels.agent_performance(log, override_field="override").orderBy("agent_id", "model_version").collect()
    got = readmodels.performance_totals(parts.read(), reviews.read(), "override").orderBy("agent_id", "model_version").collect()
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == pytest.approx(y, rel=1e-12) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_timeouts_fire_once_and_stay(spark, tmp_path):
    hours = lambda h: datetime(2025, 1, 1) + timedelta(hours=h)
    rows = [("loan-1", 1, "Asked", 0), ("loan-1", 2, "Done", 3), ("loan-2", 1, "Asked", 0), ("loan-3", 1, "Asked", 1), ("loan-3", 2, "Asked", 4), ("clock", 1, "Tick", 8), ("loan-2", 2, "Done", 9), ("loan-3", 3, "Done", 9), ("clock", 2, "Tick", 30)]
    log = spark.createDataFrame([(f"e{i}", s, at, i, kind, 1, "{}", "{}", hours(h)) for i, (s, at, kind, h) in enumerate(rows, 1)], "event_id string, stream_id string, stream_position long, global_position long, event_type string, event_version int, payload string, metadata string, recorded_at timestamp_ntz")
    seen = []
    sink = lambda df, b: seen.extend((b, r.stream_id, r.stream_position) for r in df.collect())
    start = lambda e: start_stateful(streamed_timeouts(e, "Asked", "Done", 5 * 3600), sink, f"{tmp_path}/checkpoint")
    feed(spark, log, tmp_path, start, [[4, 3, 1], [5, 2], [6]])
    assert sorted(x[1:] for x in seen) == [("loan-2", 1), ("loan-3", 1)]
    feed(spark, log, tmp_path, start, [[7, 8], [9]])
    assert sorted(x[1:] for x in seen) == [("loan-2", 1), ("loan-3", 1)]
    want = stage_timeouts(log, "Asked", "Done", 5 * 3600).collect()
    assert sorted(x[1:] for x in seen) == sorted((r.stream_id, r.stream_position) for r in want)


def test_keyed_table_keeps_few_folders(spark, tmp_path):
    table, want = KeyedTable(spark, f"{tmp_path}/t", ["k"], "k long, v string"), {}
    assert table.read().count() == 0 and table.version() == -1
    for version in range(23):
        rows = [(k, f"{version}-{k}") for k in range(version % 5, 12, 3)]
        table.write(spark.createDataFrame(rows, "k long, v string"), version)
        table.write(spark.createDataFrame(rows, "k long, v string"), version)  # a batch that runs again
        want |= dict(rows)
        assert len(table.live()) <= 8
    assert {r.k: r.v for r in table.read().collect()} == want and table.version() == 22
    assert len(table._folders()) <= 13


def test_keyed_table_ignores_what_a_crash_left(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"])
    for version in range(5):
        table.write(spark.createDataFrame([(1, version)], "k long, v long"), version)
    merged = [f for f in table.live() if f[0] == 1]
    assert merged == [(1, 0, 3)]
    (tmp_path / "t" / "L1-0000000000-0000000003" / "_SUCCESS").unlink()  # a merge that hasn't ended
    assert table.read().first().v == 4 and len([f for f in table.live() if f[0] == 0]) == 5
    table.write(spark.createDataFrame([(1, 5)], "k long, v long"), 5)
    assert table.read().first().v == 5 and [f[0] for f in table.live()] == [0, 1]
    with pytest.raises(ValueError):
        KeyedTable(spark, f"{tmp_path}/none", ["k"]).read()


def test_latest_by_key_with_null_keys(spark, tmp_path):
    sink = latest_by_key(spark, f"{tmp_path}/t", ["a", "b"])
    sink(spark.createDataFrame([(1, None, "x"), (None, None, "y")], "a long, b string, v string"), 0)
    sink(spark.createDataFrame([(1, None, "z")], "a long, b string, v string"), 1)
    assert plain(KeyedTable(spark, f"{tmp_path}/t", ["a", "b"]).read()) == plain(spark.createDataFrame([(1, None, "z"), (None, None, "y")], "a long, b string, v string"))


def test_relay_counts_attempts_survives_a_crash_and_buries_the_dead(spark, tmp_path):
    log = make(spark, [("loan-1", "ApplicationSubmitted", {"application_id": str(i)}) for i in range(9)])
    outbox_rows(log).write.parquet(f"{tmp_path}/rows")
    rows = lambda: spark.readStream.schema(outbox_rows(log).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    outbox, sent, calls = KeyedTable(spark, f"{tmp_path}/outbox", ["event_id"], OUTBOX_DDL), [], []

    def publish(df):
        got = df.collect()
        calls.append(len(got))
        if len(calls) == 2:
            raise ConnectionError("the broker is gone")
        ok = [(r.event_id, r.event_id not in ("3", "7") or (r.event_id == "3" and r.attempts >= 2)) for r in got]
        sent.extend(e for e, good in ok if good)
        return spark.createDataFrame(ok[:-1] if len(calls) == 1 else ok, "event_id string, ok boolean")  # the first answer is one short

    with pytest.raises(Exception, match="broker|ConnectionError"):
        relay_outbox(rows(), outbox, publish, f"{tmp_path}/checkpoint", batch_size=4).awaitTermination()
    relay_outbox(rows(), outbox, publish, f"{tmp_path}/checkpoint", batch_size=4).awaitTermination()
    got = {r.event_id: (r.attempts, r.published_at is not None) for r in outbox.read().collect()}
    assert len(got) == 9 and got["3"] == (2, True) and got["7"] == (5, False) and {r.event_id for r in dead(outbox).collect()} == {"7"}
    assert all(ok for e, (_, ok) in got.items() if e != "7") and set(sent) == set(got) - {"7"} and max(calls) <= 4
    take_in(outbox, outbox_rows(log))
    assert drain(outbox, publish) == 0 and {r.event_id: (r.attempts, r.published_at is not None) for r in outbox.read().collect()} == got


def test_relay_in_lanes_takes_no_more_rounds_for_more_rows(spark, tmp_path):
    log = make(spark, [("loan-1", "ApplicationSubmitted", {"application_id": str(i)}) for i in range(120)])
    outbox_rows(log).write.parquet(f"{tmp_path}/rows")
    outbox, calls = KeyedTable(spark, f"{tmp_path}/outbox", ["event_id"], OUTBOX_DDL), []

    def publish(df):
        lanes = df.groupBy(F.pmod(F.xxhash64("event_id"), F.lit(12))).count().collect()
        calls.append(max((r["count"] for r in lanes), default=0))
        return df.select("event_id", (F.col("attempts") >= F.length("event_id") - 1).alias("ok"))

    rows = spark.readStream.schema(outbox_rows(log).schema).parquet(f"{tmp_path}/rows")
    relay_outbox(rows, outbox, publish, f"{tmp_path}/checkpoint", batch_size=20, lanes=12).awaitTermination()
    got = {r.event_id: (r.attempts, r.published_at is not None) for r in outbox.read().collect()}
    assert len(got) == 120 and all(at == (len(e) - 1, True) for e, at in got.items())
    assert max(calls) <= 20 and len(calls) <= 5  # one lane takes 12


class Calls:
    """A handle whose states are kept here and whose calls are counted."""

    def __init__(self, processor):
        self.n, self.timers = 0, set()
        processor.init(self)

    def _counted(self, f):
        def call(*a):
            self.n += 1
            return f(*a)
        return call

    def getValueState(self, name, schema):
        box = [None]
        return SimpleNamespace(get=self._counted(lambda: box[0]), update=self._counted(lambda v: box.__setitem__(0, v)))

    def getMapState(self, name, key, value):
        box = {}
        return SimpleNamespace(updateValue=self._counted(box.__setitem__), iterator=self._counted(lambda: iter(box.items())))

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.discard(at)

    def of(self, rows):
        before, out = self.n, list(rows)
        return out, self.n - before


def test_reviews_take_few_state_calls_a_batch(spark):
    from foldlog.streaming.stateful import ReviewsAsOf

    state = Calls(p := ReviewsAsOf())
    row = lambda at: Row(global_position=at, is_decision=at % 3 == 0, agent_id=f"a{at}", model_version=None, override=at % 2 == 0, recorded_at=datetime(2025, 1, 1, 0, 0, 0, at))
    out, calls = state.of(p.handleInputRows(("A",), iter(map(row, range(300, 600))), None))
    assert len(out) == 200 and calls <= 3
    out, calls = state.of(p.handleInputRows(("A",), iter(map(row, range(1, 299))), None))  # late, and no review of the first batch follows another decision now
    assert len(out) == 199 and calls <= 4 and {r.agent_id for r in out if r.global_position < 3} == {None}
    out += (again := state.of(p.handleInputRows(("A",), iter(map(row, range(1, 600))), None))[0])
    assert [r.global_position for r in again] == [299]  # the others are known
    want = {at: None if at < 3 else f"a{at // 3 * 3}" for at in range(1, 600) if at % 3}
    assert all(r.agent_id == want[r.global_position] and r.recorded_at.microsecond == r.global_position for r in out)


def test_timeouts_take_one_timer_and_few_state_calls(spark):
    from foldlog.streaming.stateful import Timeouts

    state = Calls(p := Timeouts(60))
    rows = [Row(stream_position=i, asks=i != 150, micros=i * 1_000_000) for i in range(1, 301)]
    assert state.of(p.handleInputRows(("s",), iter(rows), None))[1] <= 3 and len(state.timers) == 1
    at = state.timers.pop()
    out, calls = state.of(p.handleExpiredTimer(("s",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 261_500), SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    assert [r.stream_position for r in out] == [i for i in range(1, 201) if not 90 <= i <= 150] and calls <= 3 and state.timers == {262_001}
    out, _ = state.of(p.handleExpiredTimer(("s",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9), SimpleNamespace(getExpiryTimeInMs=lambda: 262_001)))
    assert [r.stream_position for r in out] == list(range(201, 301))


def test_session_views_take_two_state_calls_a_batch(spark):
    from foldlog.streaming.stateful import SessionViews

    state = Calls(p := SessionViews())
    row = lambda at: Row(stream_position=at, event_type="AgentContextLoaded" if at == 1 else "DecisionGenerated", agent_id="a", model_version=f"v{at}", payload="{}", line=f"l{at}")
    for positions in (range(101, 201), range(1, 101), range(1, 201)):
        (view,), calls = state.of(p.handleInputRows(("s",), iter(map(row, positions)), None))
        assert calls == 2
    assert view.total_events == 200 and view.summary == [f"l{i}" for i in range(1, 198)] and [r.stream_position for r in view.recent_events] == [198, 199, 200] and view.model_version == "v1"
