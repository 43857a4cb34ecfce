"""Document facts: extraction from text and rows, merging over a package's events, quality flags, deferrals, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import fact_from_text

# The facts that documents are searched for, and those that an analysis can't do without.
FACTS = ("total_revenue", "net_income", "total_assets", "total_liabilities", "ebitda")
CRITICAL = ("total_revenue", "net_income", "total_assets")


def facts_from_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column for each of FACTS: the number after its name in the text, null if there is none."""
    return docs.withColumns({f: fact_from_text(F.col(text), f.replace("_", " ")) for f in FACTS})


def facts_from_rows(rows: DataFrame, key: str) -> DataFrame:
    """One row a key with a column for each of FACTS, from rows (key, ordinal, field, value); of a field named twice the last counts."""
    own = rows.withColumn("field", F.lower("field")).where(F.col("field").isin(*FACTS))
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value").try_cast("double")), F.when(F.col("field") == f, F.col("ordinal")))
    return own.groupBy(key).agg(*(last(f).alias(f) for f in FACTS))


def merged_facts(log: DataFrame) -> DataFrame:
    """stream_id, fact, value: of each fact of a package the first value that isn't null, in stream order."""
    facts = F.from_json(F.get_json_object("payload", "$.facts"), "map<string,string>")
    each = log.where("event_type = 'ExtractionCompleted'").select("stream_id", "stream_position", F.explode(facts).alias("fact", "value"))
    return each.where("value is not null").groupBy("stream_id", "fact").agg(F.min_by("value", "stream_position").alias("value"))


def quality_flags(log: DataFrame) -> DataFrame:
    """stream_id and flags: extraction notes in stream order, then each assessment's anomalies and missing critical fields."""
    strings = lambda path: F.coalesce(F.from_json(F.get_json_object("payload", path), "array<string>"), F.array().cast("array<string>"))
    missing = F.transform(strings("$.critical_missing_fields"), lambda x: F.concat(F.lit("CRITICAL_MISSING:"), x))
    notes = F.when(F.col("event_type") == "ExtractionCompleted", strings("$.facts.extraction_notes")).otherwise(F.concat(strings("$.anomalies"), missing))
    phase = F.when(F.col("event_type") == "ExtractionCompleted", 0).otherwise(1)
    each = log.where("event_type in ('ExtractionCompleted', 'QualityAssessmentCompleted')").select("stream_id", F.struct(phase.alias("phase"), "stream_position", notes.alias("notes")).alias("n"))
    return each.groupBy("stream_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["notes"])).alias("flags"))


def deferrals(log: DataFrame) -> DataFrame:
    """Per package (stream) of log: issues (critical facts that are absent or 0) and whether two of them defer the analysis.

    A package without any fact lacks all of them.
    """
    known = merged_facts(log).where(F.col("fact").isin(*CRITICAL)).groupBy("stream_id").agg(
        *(F.max(F.when(F.col("fact") == f, F.col("value").try_cast("double"))).alias(f) for f in CRITICAL))
    all_ = log.select("stream_id").distinct().join(known, "stream_id", "left")
    issues = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f), F.lit(0.0)) == 0, F.lit(f"Missing critical field: {f}")) for f in CRITICAL)))
    return all_.select("stream_id", (F.size(issues) >= 2).alias("is_deferred"), issues.alias("issues"))


def document_inventory(log: DataFrame) -> DataFrame:
    """stream_id, document_ids and file_paths of the uploads of each application, in stream order; absent fields are ''."""
    field = lambda k: F.coalesce(F.get_json_object("payload", f"$.{k}"), F.lit(""))
    row = F.struct("stream_position", field("document_id").alias("id"), field("file_path").alias("path"))
    out = log.where("event_type = 'DocumentUploaded'").groupBy("stream_id").agg(F.array_sort(F.collect_list(row)).alias("d"))
    return out.select("stream_id", F.col("d.id").alias("document_ids"), F.col("d.path").alias("file_paths"))


def derived_statement_lines(h: DataFrame) -> DataFrame:
    return h.withColumns({
        "cost_of_revenue": F.col("total_revenue") - F.col("gross_profit"), "non_current_assets": F.col("total_assets") - F.col("current_assets"),
        "liabilities_and_equity": F.col("total_liabilities") + F.col("total_equity")})


def credit_score(rows: DataFrame) -> DataFrame:
    """rows (debt_to_ebitda, current_ratio, debt_to_equity, trajectory) with score, risk_tier and confidence."""
    part = lambda c, most: F.least(F.col(c) / most, F.lit(1.0))
    trend: Column = F.when(F.col("trajectory").isin("GROWTH", "STABLE"), 0.3).when(F.col("trajectory") == "DECLINING", 0.1).otherwise(0.2)
    score = (1 - part("debt_to_ebitda", 6)) * 0.3 + part("current_ratio", 2) * 0.25 + (1 - part("debt_to_equity", 3)) * 0.25 + trend * 0.2
    tier = F.when(score > 0.70, "LOW").when(score > 0.45, "MEDIUM").otherwise("HIGH")
    return rows.withColumns({"score": score, "risk_tier": tier, "confidence": F.round(0.55 + score * 0.38, 2)})
