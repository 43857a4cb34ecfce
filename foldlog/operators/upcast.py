"""Schema versions: a registry of hops, each a Column-to-Column transform of the payload, applied in version order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import has_key
from .joins import reconstruct_model_versions
from .rules import few_rows

# Fixed values: [start, end) dates and what was in force.
MODEL_SCHEDULE = [("2024-01-01", "2024-07-01", "v1.0"), ("2024-07-01", "2025-01-01", "v1.1"), ("2025-01-01", "2026-01-01", "v2.0"), ("2026-01-01", "2099-01-01", "v2.1")]
REGULATION_SCHEDULE = [("2024-01-01", "2025-01-01", "EU-AI-ACT-2024"), ("2025-01-01", "2099-01-01", "EU-AI-ACT-2025")]


def infer_from_schedule(ts: Column, schedule: list[tuple[str, str, str]]) -> Column:
    """The value whose [start, end) holds the date; null outside."""
    day, out = F.to_date(ts), None
    for start, end, value in schedule:
        holds = (day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date"))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out


def schedule_rows(table: DataFrame, name: str) -> list[tuple[str, str, str]]:
    """[start, end) dates and values of one schedule of a table (schedule, start, end, value), in order, for infer_from_schedule."""
    return sorted((str(r["start"]), str(r["end"]), r["value"]) for r in few_rows(table.where(F.col("schedule") == name)))


class Upcasters:
    """register(type, from_version) decorates a function of (payload, recorded_at) that returns the next version's payload."""

    def __init__(self):
        self.hops: dict[tuple[str, int], Callable[[Column, Column], Column]] = {}

    def register(self, event_type: str, from_version: int):
        def keep(f):
            self.hops[event_type, from_version] = f  # a later registration takes the place of an earlier one
            return f

        return keep

    def apply(self, log: DataFrame) -> DataFrame:
        """log with payloads and versions as new as the hops lead; stored rows stay as they are."""
        for version in sorted({v for _, v in self.hops}):
            payload, moved = F.col("payload"), F.lit(False)
            for (name, v), f in self.hops.items():
                if v == version:
                    mine = (F.col("event_type") == name) & (F.col("event_version") == version)
                    payload = F.when(mine, f(F.col("payload"), F.col("recorded_at"))).otherwise(payload)
                    moved = moved | mine
            log = log.withColumns({"payload": payload, "event_version": F.when(moved, version + 1).otherwise(F.col("event_version"))})
        return log


def add_fields(payload: Column, fields: dict[str, Column]) -> Column:
    """payload with JSON fields added where their keys are absent; values are JSON texts, an empty object is handled."""
    for key, value in fields.items():
        body = F.regexp_replace(payload, r"\}\s*$", "")
        comma = F.when(body.rlike(r"^\s*\{\s*$"), "").otherwise(",")
        payload = F.when(has_key(payload, key), payload).otherwise(F.concat(body, comma, F.lit(f'"{key}":'), value, F.lit("}")))
    return payload


DEFAULT = Upcasters()


@DEFAULT.register("CreditAnalysisCompleted", 1)
def _credit(payload: Column, at: Column) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("unknown")), F.lit('"'))
    return add_fields(payload, {
        "model_version": quoted(infer_from_schedule(at, MODEL_SCHEDULE)), "confidence_score": F.lit("null"),
        "regulatory_basis": quoted(infer_from_schedule(at, REGULATION_SCHEDULE))})


def upcast(log: DataFrame) -> DataFrame:
    """log at the newest versions: the registry's hops, and old decisions' model versions joined from their sessions."""
    out = DEFAULT.apply(log)
    maps = reconstruct_model_versions(log)
    joined = out.join(maps, "global_position", "left")
    old = (F.col("event_type") == "DecisionGenerated") & (F.col("event_version") == 1)
    filled = add_fields(F.col("payload"), {"model_versions": F.coalesce(F.to_json("model_versions"), F.lit("{}"))})
    return joined.select(*(F.when(old, filled).otherwise(F.col("payload")).alias("payload") if c == "payload" else F.when(old, 2).otherwise(F.col(c)).alias(c) if c == "event_version" else c for c in out.columns))
