"""Streams against batch: folds in several micro-batches, a batch that is run again, a replay between two positions."""

import uuid

import pytest
from pyspark.sql import functions as F

from foldlog.operators import readmodels
from foldlog.streaming import FOLDS, latest_by_key, read_latest, replay, run_projection, stream_progress

from .test_folds import HISTORY, make


@pytest.fixture
def stream(spark, tmp_path):
    """A log in five files, read two at a time, and folders for a projection."""
    log = make(spark, HISTORY * 3)
    path = str(tmp_path / "log")
    log.repartitionByRange(5, "global_position").write.parquet(path)
    return log, spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(path), tmp_path


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_fold_equals_batch_also_after_a_replayed_batch(spark, stream, name):
    log, events, folder = stream
    fold, keys = FOLDS[name]
    out, seen = f"{folder}/out-{uuid.uuid4().hex}", []
    sink = latest_by_key(spark, out, keys)

    def twice(df, batch):
        seen.append(batch)
        sink(df, batch)
        sink(df, batch)

    run_projection(events, fold, twice, f"{folder}/checkpoint").awaitTermination()
    got = read_latest(spark, out, keys)
    assert len(seen) > 1 and plain(got) == plain(fold(log))
    if name == "compliance_registers":
        assert plain(readmodels.compliance_totals(got)) == plain(readmodels.compliance_current(log))


def test_replay_between_two_positions(spark, stream):
    log, events, folder = stream
    replay(events, stream_progress, latest_by_key(spark, f"{folder}/out", ["stream_id"]), f"{folder}/checkpoint", 4, 13).awaitTermination()
    assert plain(read_latest(spark, f"{folder}/out", ["stream_id"])) == plain(stream_progress(log.where("global_position between 4 and 13")))


def test_running_means_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(readmodels, "RANGE", 4)
    rows = [("a" if i % 3 else "b", float(i * 7 % 5)) for i in range(1, 90)]
    log = make(spark, [(f"loan-{i}", "CreditAnalysisCompleted", {"application_id": str(i), "agent_id": a, "model_version": "m", "analysis_duration_ms": ms}) for i, (a, ms) in enumerate(rows)])
    got = {r.agent_id: r.avg_duration_ms for r in readmodels.agent_performance(log).collect()}
    for agent in ("a", "b"):
        mean, n = 0.0, 0
        for name, ms in rows:
            if name == agent:
                mean, n = (mean * n + ms) / (n + 1) if ms > 0 else mean, n + 1
        assert got[agent] == pytest.approx(mean, rel=1e-12)


def test_no_analyses_give_a_mean_of_zero(spark):
    loaded = ("agent-a-s", "AgentContextLoaded", {"agent_id": "a", "session_id": "s", "model_version": "v"})
    assert readmodels.agent_performance(make(spark, [loaded])).select(F.col("avg_duration_ms")).first()[0] == 0.0
