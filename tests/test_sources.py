"""Readers and writers in round trips, archives, loads at the newest version or as stored, and health of projections."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from foldlog.functions import expressions as X
from foldlog.schema import EVENT_DDL
from foldlog.sources import log as S
from foldlog.streaming import KeyedTable, ProjectionHealth, latest_by_key, run_projection, stream_progress

from .test_folds import HISTORY, make


def plain(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_log_round_trip(spark, tmp_path):
    log = make(spark, HISTORY)
    log.write.parquet(f"{tmp_path}/log")
    assert plain(S.read_log(spark, f"{tmp_path}/log")) == plain(log)
    stream = S.read_log(spark, f"{tmp_path}/log", stream=True)
    assert stream.isStreaming and stream.schema == spark.createDataFrame([], EVENT_DDL).schema


def test_seed_round_trip(spark, tmp_path):
    payload = {"b": [1, {"c": None}], "a": "é\n\"quoted\"", "n": 1.5}
    log = make(spark, [("loan-1", "ApplicationSubmitted", payload), ("loan-1", "DecisionGenerated", {}, 2)])
    S.write_seed_jsonl(log, f"{tmp_path}/seed")
    got = S.read_seed_jsonl(spark, f"{tmp_path}/seed").orderBy("recorded_at").collect()
    assert [(r.stream_id, r.event_type, r.event_version) for r in got] == [("loan-1", "ApplicationSubmitted", 1), ("loan-1", "DecisionGenerated", 2)]
    assert json.loads(got[0].payload) == payload and got[0].recorded_at == datetime(2025, 6, 1, 1)


def test_profiles_with_and_without_flags(spark, tmp_path):
    rows = [{"company_id": "C1", "name": "A", "compliance_flags": [{"flag_type": "AML_WATCH", "severity": "HIGH", "is_active": True, "note": "n"}, {"flag_type": "PEP", "severity": "LOW", "is_active": False}]}, {"company_id": "C2", "name": "B", "compliance_flags": []}]
    (tmp_path / "profiles.json").write_text(json.dumps(rows, indent=1))
    got = S.read_profiles_json(spark, f"{tmp_path}/profiles.json").select("company_id", "flag.flag_type", "flag.is_active").collect()
    assert sorted(map(str, ((r.company_id, r.flag_type, r.is_active) for r in got))) == ["('C1', 'AML_WATCH', True)", "('C1', 'PEP', False)", "('C2', None, None)"]


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "b.txt").write_text("line one\nline two")
    (tmp_path / "a.csv").write_text("field,value,fiscal_year,currency\ntotal_revenue,12.5,2024,USD\nebitda,,2023,\n")
    assert [(r.name, r.length) for r in S.list_documents(spark, str(tmp_path)).collect()] == [("a.csv", 75), ("b.txt", 17)]
    assert [tuple(r) for r in S.read_text_documents(spark, str(tmp_path)).collect()] == [("b.txt", "line one\nline two")]
    assert [tuple(r) for r in S.read_fact_csv(spark, str(tmp_path)).collect()] == [("total_revenue", "12.5", 2024, "USD"), ("ebitda", None, 2023, None)]


def test_archived_streams_keep_their_time_and_still_load(spark):
    first, second = datetime(2025, 1, 1), datetime(2025, 2, 1)
    archive = spark.createDataFrame([], "stream_id string, archived_at timestamp_ntz")
    streams = lambda *names: spark.createDataFrame([(n,) for n in names], "stream_id string")
    once = S.archive_streams(archive, streams("loan-1", "loan-1"), first)
    twice = S.archive_streams(once, streams("loan-1", "loan-2"), second)
    assert {r.stream_id: r.archived_at for r in twice.collect()} == {"loan-1": first, "loan-2": second} and twice.count() == 2
    log = make(spark, HISTORY)
    assert {r.stream_id: r.archived_at for r in S.stream_metadata(log, twice).collect()} == {"loan-1": first, "loan-2": second, "compliance-1": None}
    assert S.load_stream(log, "loan-1").count() == 5
    assert {r.stream_id: r.version for r in S.stream_version(log, streams("loan-1", "none")).collect()} == {"loan-1": 5, "none": -1}


def test_a_stream_loads_at_its_newest_version_or_as_stored(spark):
    log = make(spark, [("loan-1", "CreditAnalysisCompleted", {"risk_tier": "LOW"}), ("loan-1", "ApplicationDeclined", {})])
    raw, new = (f(log, "loan-1").collect() for f in (S.load_raw, S.load_stream))
    assert (raw[0].event_version, json.loads(raw[0].payload)) == (1, {"risk_tier": "LOW"}) and new[0].event_version == 2 and json.loads(new[0].payload)["model_version"] == "v2.0"
    assert [r.event_type for r in new] == ["CreditAnalysisCompleted", "ApplicationDeclined"] and S.load_stream(log, "loan-1", 1).count() == 1 and S.load_raw(log, "loan-1", 0, 1).count() == 1


def test_dead_letters_and_mixed_batches(spark):
    outbox = S.outbox_rows(make(spark, HISTORY)).withColumn("attempts", F.col("event_id").cast("int"))
    assert {r.event_id for r in S.dead_letters(outbox, 5).collect()} == {"5", "6", "7"} and {r.event_id for r in S.pending_outbox(outbox, 2, 5).collect()} == {"1", "2"}
    rows = make(spark, HISTORY).withColumn("batch", F.when(F.col("global_position") > 5, "late").otherwise("early"))
    assert {r.batch for r in S.mixed_batches(rows, "batch").collect()} == {"late"}


def test_lag_status(spark):
    got = spark.createDataFrame([(0.5,), (1.0,), (3.0,), (5.0,), (9.0,)], "s double").select(X.lag_status(F.col("s"))).collect()
    assert [r[0] for r in got] == ["OK", "OK", "WARNING", "WARNING", "CRITICAL"]


def test_costs_of_tokens(spark):
    row = spark.createDataFrame([(1_000_000, 200_000)], "i long, o long").select(X.token_cost(F.col("i"), F.col("o"))).first()
    assert row[0] == 6.0


def test_health_of_a_running_and_a_paused_projection(spark, tmp_path):
    log, table = make(spark, HISTORY * 2), KeyedTable(spark, f"{tmp_path}/health", ["projection"])
    health = ProjectionHealth(table)
    spark.streams.addListener(health)
    try:
        def run(name):
            events = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
            run_projection(events, stream_progress, latest_by_key(spark, f"{tmp_path}/{name}", ["stream_id"]), f"{tmp_path}/{name}-checkpoint", name=name).awaitTermination()

        log.where("global_position <= 8").write.parquet(f"{tmp_path}/log")
        run("live")
        run("paused")
        log.where("global_position > 8").write.mode("append").parquet(f"{tmp_path}/log")
        run("live")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        got = {r.projection: (r.processed, r.lag) for r in health.report(log, ["live", "paused", "never"]).collect()}
        assert got == {"live": (14, 0), "paused": (8, 6), "never": (0, 14)}
        health.save()
        assert ProjectionHealth(table).seen.keys() == {"live", "paused"} and ProjectionHealth(table).seen["paused"][1] == 8
    finally:
        spark.streams.removeListener(health)
