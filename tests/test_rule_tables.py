"""Rules, dependents and schedules as rows of tables: a changed row changes the result."""

import pytest
from pyspark.sql import functions as F

from foldlog.operators import joins, rules, timetravel, upcast

from .test_folds import HISTORY, make

APPS = "application_id string, jurisdiction string, legal_type string, founded_year int, requested_amount double, aml_watch boolean, sanctions boolean"


@pytest.fixture(scope="module")
def apps(spark):
    return spark.createDataFrame([("a", "US", "LLC", 2000, 5.0, False, False), ("b", "MT", None, 2025, 900.0, True, None), ("c", None, "LLP", None, None, None, False)], APPS)


def table(spark, rows):
    return spark.createDataFrame(rows, rules.RULE_DDL)


def found(apps, t):
    return sorted((r.application_id, r.rule_id, r.status, r.is_block) for r in rules.evaluate_regulations(apps, 2026, t).collect())


def test_a_changed_row_changes_the_result(spark, apps):
    usual = rules.REGULATIONS
    assert found(apps, table(spark, usual)) == sorted((r.application_id, r.rule_id, r.status, r.is_block) for r in rules.evaluate_regulations(apps, 2026).collect())
    soft = [(*r[:6], False) if r[1] == "REG-003" else r for r in usual]
    before, after = found(apps, table(spark, usual)), found(apps, table(spark, soft))
    assert ("b", "REG-003", "FAILED", True) in before and not any(r[:2] == ("b", "REG-004") for r in before)
    assert ("b", "REG-003", "FAILED", False) in after and ("b", "REG-004", "PASSED", False) in after and ("b", "REG-005", "FAILED", True) in after


def test_operators_and_order(spark, apps):
    t = table(spark, [(2, "X-2", "requested_amount", ">=", "900", "FAIL", False), (1, "X-1", "jurisdiction", "in", "US, FR", "NOTE", False), (3, "X-3", "legal_type", "not in", "LLC,INC", "FAIL", True), (4, "X-4", None, None, None, "FAIL", False)])
    assert found(apps, t) == [
        ("a", "X-1", "NOTED", False), ("a", "X-2", "PASSED", False), ("a", "X-3", "PASSED", False), ("a", "X-4", "FAILED", False),
        ("b", "X-1", "PASSED", False), ("b", "X-2", "FAILED", False), ("b", "X-3", "PASSED", False), ("b", "X-4", "FAILED", False),
        ("c", "X-1", "PASSED", False), ("c", "X-2", "PASSED", False), ("c", "X-3", "FAILED", True)]
    assert found(apps, table(spark, [])) == [] and found(apps.where("false"), t) == []


@pytest.mark.parametrize("row", [(1, "X", "no_field", "=", "1", "FAIL", False), (1, "X", "jurisdiction", "~", "1", "FAIL", False), (1, "X", "jurisdiction", "=", "1", "STOP", False), (1, "X", "jurisdiction", "=", None, "FAIL", False)])
def test_rows_that_mean_nothing_are_errors(spark, apps, row):
    with pytest.raises(ValueError, match="rule X"):
        rules.evaluate_regulations(apps, 2026, table(spark, [row]))


def test_tables_of_rules_are_small(spark, apps):
    with pytest.raises(ValueError, match="1000"):
        rules.few_rows(spark.range(1001))
    with pytest.raises(ValueError, match="1000"):
        joins.schedule_join(spark.range(1), spark.range(1001), "id")


def test_dependents_come_from_a_table(spark):
    log = make(spark, HISTORY)
    skipped = lambda t=None, b="CreditAnalysisCompleted": timetravel.what_if(log, b, F.lit("{}"), t).where("stream_id = 'loan-1'").first().events_skipped
    one = spark.createDataFrame([("CreditAnalysisCompleted", "DecisionGenerated"), ("Other", "HumanReviewCompleted")], "branch string, dependent string")
    all_ = spark.createDataFrame(timetravel.DEPENDENTS, "branch string, dependent string")
    assert (skipped(), skipped(all_), skipped(one), skipped(one.where("false"))) == (2, 2, 1, 0)
    assert len(timetravel.DEPENDENTS) == 12 and timetravel.causally_dependent("NoSuchEvent") == []


def test_schedules_come_from_a_table(spark):
    t = spark.createDataFrame([("model", *r) for r in upcast.MODEL_SCHEDULE] + [("rules", *r) for r in upcast.REGULATION_SCHEDULE], "schedule string, start string, end string, value string")
    assert upcast.schedule_rows(t, "model") == upcast.MODEL_SCHEDULE and upcast.schedule_rows(t, "rules") == upcast.REGULATION_SCHEDULE
    day = spark.sql("select timestamp '2024-08-01 00:00:00' as ts")
    assert day.select(upcast.infer_from_schedule(F.col("ts"), upcast.schedule_rows(t, "model"))).first()[0] == "v1.1"
