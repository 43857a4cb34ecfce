"""Applicants: companies, financial history, flags and prior loans, and the checks and scores over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clamp01, fraud_recommendation


def financial_history(history: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Rows of the given fiscal years; no years or an empty list: all."""
    return history.where(F.col("fiscal_year").isin(years)) if years else history


def compliance_flags(flags: DataFrame, active_only: bool = False) -> DataFrame:
    out = flags.withColumn("note", F.coalesce("note", F.lit("")))
    return out.where("is_active") if active_only else out


def financial_ratios(h: DataFrame) -> DataFrame:
    """Leverage, liquidity, coverage and margins, denominators at least 1, two decimals."""
    over = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 2)
    return h.withColumns({
        "debt_to_equity": over("total_liabilities", "total_equity"), "current_ratio": over("current_assets", "current_liabilities"),
        "debt_to_ebitda": over("total_liabilities", "ebitda"), "interest_coverage": over("operating_income", "interest_expense"),
        "gross_margin": over("gross_profit", "total_revenue"), "ebitda_margin": over("ebitda", "total_revenue"), "net_margin": over("net_income", "total_revenue")})


def balance_sheet_check(h: DataFrame) -> DataFrame:
    gap = F.col("total_assets") - F.col("total_liabilities") - F.col("total_equity")
    return h.withColumn("discrepancy", gap).withColumn("balanced", F.abs(gap) < 1.0)


def latest_year(history: DataFrame) -> DataFrame:
    cols = [c for c in history.columns if c not in ("company_id", "fiscal_year")]
    return history.groupBy("company_id").agg(F.max_by(F.struct(*cols), "fiscal_year").alias("h"), F.max("fiscal_year").alias("fiscal_year")).select("company_id", "fiscal_year", "h.*")


def risk_segment(trajectory: Column, debt_ratio: Column, has_default: Column, has_flag: Column) -> Column:
    return F.when(has_default | has_flag, "HIGH").when(trajectory.isin("GROWTH", "STABLE") & (debt_ratio < 0.40), "LOW").otherwise("MEDIUM")


def credit_policy(rows: DataFrame) -> DataFrame:
    """rows (revenue, has_default, has_high_flag, limit_usd, risk_tier, confidence) after the policy, with what it changed."""
    cap = F.floor(0.35 * F.col("revenue")).cast("double")
    capped = (cap > 0) & (F.col("limit_usd") > cap)
    lower = F.col("has_high_flag") & (F.col("confidence") > 0.50)
    raised = F.col("has_default") & ~F.col("risk_tier").eqNullSafe("HIGH")
    # Texts in stored logs.
    names = F.array_join(F.array_compact(F.array(
        F.when(capped, F.concat(F.lit("POLICY_REV_CAP: limit capped at 35% of revenue ($"), F.format_number(cap, 0), F.lit(")"))),
        F.when(raised, "POLICY_PRIOR_DEFAULT: risk_tier elevated to HIGH"), F.when(lower, "POLICY_COMPLIANCE_FLAG: confidence capped at 0.50"))), "; ")
    return rows.withColumns({
        "overrides": names, "limit_usd": F.when(capped, cap).otherwise(F.col("limit_usd")),
        "risk_tier": F.when(F.col("has_default"), "HIGH").otherwise(F.col("risk_tier")), "confidence": F.when(lower, 0.50).otherwise(F.col("confidence"))})


def fraud_signals(rows: DataFrame) -> DataFrame:
    """rows (claimed and registered revenue, assets, liabilities, equity, trajectory) with fraud_score and recommendation."""
    base = F.greatest(F.abs("registered_revenue"), F.lit(1.0))
    revenue = (F.abs(F.col("claimed_revenue") - F.col("registered_revenue")) / base > 0.40) & ~F.coalesce("trajectory", F.lit("STABLE")).isin("GROWTH", "RECOVERING")
    gap = F.abs(F.col("assets") - F.col("liabilities") - F.col("equity")) / F.greatest(F.col("assets"), F.lit(1.0)) > 0.05
    score = F.round(clamp01(0.05 + F.when(revenue, 0.25).otherwise(0) + F.when(gap, 0.20).otherwise(0)), 2)
    return rows.withColumns({"revenue_signal": revenue, "balance_signal": gap, "fraud_score": score}).withColumn("fraud_recommendation", fraud_recommendation(F.col("fraud_score")))


def application_registry_join(apps: DataFrame, companies: DataFrame, history: DataFrame, flags: DataFrame, loans: DataFrame) -> DataFrame:
    """Applications (company_id) with their company, latest year, flag and loan facts. All sides are one row a company before the join."""
    f = flags.groupBy("company_id").agg(F.bool_or("is_active").alias("has_flag"), F.bool_or(F.col("is_active") & (F.col("severity") == "HIGH")).alias("has_high_flag"))
    p = loans.groupBy("company_id").agg(F.count("*").alias("prior_loans"), F.bool_or("default_occurred").alias("has_default"))
    out = apps.join(companies, "company_id", "left").join(latest_year(history), "company_id", "left").join(f, "company_id", "left").join(p, "company_id", "left")
    return out.fillna(False, ["has_flag", "has_high_flag", "has_default"]).fillna(0, ["prior_loans"])


def historical_profile(history: DataFrame, loans: DataFrame) -> DataFrame:
    """Per company: its fiscal years in order and whether it has loans or defaults."""
    h = history.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_set("fiscal_year")), ",").alias("years"))
    p = loans.groupBy("company_id").agg(F.bool_or("default_occurred").alias("has_defaults"))
    return h.join(p, "company_id", "left").select("company_id", "years", F.col("has_defaults").isNotNull().alias("has_prior_loans"), F.coalesce("has_defaults", F.lit(False)).alias("has_defaults"))
