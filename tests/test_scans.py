"""Running sums in ranges, typed validation and rules at approval, on awkward rows."""

import json
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlog.operators import aggregates, quality, scans

from .test_folds import make


def test_running_sums_of_a_hot_key_equal_a_window(spark, monkeypatch):
    monkeypatch.setattr(scans, "FAN", 4)
    rows = [("hot" if i % 10 else (None if i % 20 else "cold"), i, None if i % 7 == 0 else float(i % 5)) for i in range(1, 2000)]
    df = spark.createDataFrame(rows, "k string, at long, v double")
    got = scans.running_averages(df, ["k"], F.col("v"), "at", span=16)
    own = W.partitionBy("k").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("*", F.sum(F.coalesce("v", F.lit(0.0))).over(own).alias("running_sum"), F.count("*").over(own).alias("running_count"))
    assert got.columns == ["k", "at", "v", "running_sum", "running_count", "running_average"]
    key = lambda r: (r.at, r.running_sum, r.running_count)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert scans.running_sums(df.where("false"), ["k"], "at", {"s": F.col("v")}).count() == 0


def test_no_task_of_running_sums_has_a_whole_hot_key(spark):
    df = spark.range(1, 20_001).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = scans.running_sums(df, ["k"], "at", {"n": F.lit(1)}, span=256)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * sorted(sizes)[2] and out.agg(F.max("n")).first()[0] == 20_000


def test_typed_errors(spark):
    credit = {"application_id": "1", "risk_tier": "LOW", "model_version": "v"}
    log = make(spark, [
        ("loan-1", "CreditAnalysisCompleted", credit | {"confidence_score": "0.5"}), ("loan-1", "CreditAnalysisCompleted", credit | {"confidence_score": "high", "risk_tier": None}),
        ("loan-1", "DecisionGenerated", {"application_id": 7, "recommendation": "APPROVE", "model_versions": ["v"], "contributing_agent_sessions": "s"}), ("loan-1", "Mystery", {}), ("loan-1", "ApplicationDeclined", [1]),
        ("loan-1", "HumanReviewCompleted", {"application_id": "1", "reviewer_id": "r", "final_decision": "REFER", "override": None}), ("agent-a-s", "ApplicationApproved", {"application_id": "1", "approved_amount_usd": True})])
    log = log.unionByName(log.limit(1).withColumns({"payload": F.lit("{no json"), "global_position": F.lit(8).cast("long")}))
    got = sorted((r.global_position, r.field or "", r.error) for r in quality.typed_errors(log).collect())
    assert got == [
        (2, "confidence_score", "not_a_number"), (2, "risk_tier", "missing"), (3, "application_id", "not_a_string"), (3, "contributing_agent_sessions", "not_a_array"), (3, "model_versions", "not_a_object"),
        (4, "", "unknown_type"), (5, "", "not_an_object"), (7, "approved_amount_usd", "not_a_number"), (8, "", "not_an_object")]
    report = quality.schema_report(log, 2).first()
    assert (report.valid, report.faulty) == (2, 6) and report.by_prefix == {"loan": 7, "agent": 1} and [e.global_position for e in report.first_errors] == [2, 2]
    empty = quality.schema_report(log.where("false")).first()
    assert (empty.valid, empty.faulty, empty.first_errors) == (0, 0, [])


def test_uncovered_rules_are_judged_at_the_approval(spark):
    ask = lambda app, *names: (f"compliance-{app}", "ComplianceCheckRequested", {"application_id": app, "required_rules": list(names)})
    say = lambda app, rule, ok=True: (f"compliance-{app}", "ComplianceRulePassed" if ok else "ComplianceRuleFailed", {"application_id": app, "rule_id": rule})
    approve = lambda app: (f"loan-{app}", "ApplicationApproved", {"application_id": app})
    log = make(spark, [
        ask("1", "KYC", "AML"), say("1", "KYC"), approve("1"), say("1", "AML"), ask("2", "KYC"), say("2", "KYC"), approve("2"), say("2", "KYC", False), ask("3", "KYC", "AML"), say("3", "KYC"), say("3", "KYC", False), approve("3"),
        ask("4", "KYC"), approve("5"), say("6", "KYC"), approve("6"), ask("7", "AML"), ask("7", "KYC"), say("7", "KYC"), approve("7")])
    assert {r.application_id: r.uncovered for r in aggregates.uncovered_at_approval(log).collect()} == {"1": ["AML"], "3": ["AML", "KYC"]}
    assert json.loads(log.first().payload)["required_rules"] == ["KYC", "AML"]


def in_turn(rows, calls, period):
    """The rows of each key in order of time and ord, one after the other."""
    recent, out = {}, {}
    for k, o, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        busy = [x for x in recent.get(k, []) if x + period > t]
        out[k, o] = len(busy) < calls
        recent[k] = busy + [t] * out[k, o]
    return out | {(k, o): False for k, o, t in rows if t is None}


@pytest.mark.parametrize("calls", [1, 3])
def test_throttle_equals_one_row_after_the_other(spark, calls):
    rng = random.Random(calls)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, float(rng.choice([rng.randrange(900), rng.randrange(5000)]))) for i in range(500)]
    rows += [("far", 1, 0.0), ("far", 2, 1e7), ("far", 3, 1e7 + 59.0), ("far", 4, 1e7 + 60.0), ("a", 900, None), ("nothing", 1, None)]
    rows += [("burst", i, 7.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, ord long, t double")
    got = {(r.k, r.ord): r.allowed for r in quality.throttle(df, "k", "t", calls, 60.0).collect()}
    assert got == in_turn(rows, calls, 60.0)


def test_throttle_of_nothing_and_of_timestamps(spark):
    from datetime import datetime

    assert quality.throttle(spark.createDataFrame([], "k string, ord long, t double"), "k", "t").collect() == []
    df = spark.createDataFrame([("k", i, datetime(2024, 1, 1, 0, i)) for i in range(3)], "k string, ord long, t timestamp_ntz")
    assert [r.allowed for r in quality.throttle(df, "k", "t", 1, 120.0).orderBy("ord").collect()] == [True, False, True]


@pytest.mark.parametrize(("calls", "fold"), [(1, 60), (2, 60), (2, 0)])
def test_throttle_doubles_pointers_for_hot_keys_alone(spark, monkeypatch, calls, fold):
    rng, seen, one_call = random.Random(calls), [], quality._one_call
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "c", None]), i, float(rng.randrange(2000))) for i in range(250)] + [("burst", i, 7.0) for i in range(300, 500)] + [("a", 900, None)]
    monkeypatch.setattr(quality, "FOLD", fold * calls, raising=False)
    monkeypatch.setattr(quality, "_one_call", lambda moments, period: (seen.append({r.k.key for r in moments.select("k").distinct().collect()}), one_call(moments, period))[1])
    df = spark.createDataFrame(rows, "k string, ord long, t double")
    got = {(r.k, r.ord): r.allowed for r in quality.throttle(df, "k", "t", calls, 60.0).collect()}
    assert got == in_turn(rows, calls, 60.0)
    assert len(seen) == calls and seen[0] == ({"hot"} if fold else {"hot", "a", "b", "c", None, "burst"})
