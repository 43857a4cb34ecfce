"""Running sums in three levels: over coarse ranges of a key, over the ranges in one, over the rows of a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Values of the order column in a range, and ranges in a coarse one.
SPAN, FAN = 1 << 16, 1 << 12


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], span: int = SPAN) -> DataFrame:
    """df with running sums (each row's own included) of some columns by keys, in the order of a whole-number column that tells rows apart.

    A window over a key's rows is one task a key. Here a task has one range of the order: it starts from what the ranges before
    it sum up to, which is one row a range. Null keys are keys of their own; a null in a sum counts as 0. df is read twice.
    """
    key, part, coarse = ("__key", "__part", "__coarse")
    rows = df.withColumns({key: F.struct(*(F.col(f"`{k}`") for k in keys)), part: F.floor(F.col(order) / span), coarse: F.floor(F.col(order) / (span * FAN))})
    rows = rows.withColumns({f"__own_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    before = lambda n, *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    each = rows.groupBy(key, coarse, part).agg(*(F.sum(f"__own_{n}").alias(n) for n in sums))
    top = each.groupBy(key, coarse).agg(*(F.sum(n).alias(n) for n in sums))
    top = top.select(key, coarse, *(F.coalesce(F.sum(n).over(before(n, key, coarse)), F.lit(0)).alias(f"__top_{n}") for n in sums))
    mid = each.join(top, [key, coarse]).select(
        key, coarse, part, *((F.col(f"__top_{n}") + F.coalesce(F.sum(n).over(before(n, key, coarse, part)), F.lit(0))).alias(f"__before_{n}") for n in sums))
    local = W.partitionBy(key, coarse, part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(mid, [key, coarse, part])
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"__before_{n}") + F.sum(f"__own_{n}").over(local)).alias(n) for n in sums))


def running_averages(analyses: DataFrame, keys: list[str], value: Column, order: str = "global_position", span: int = SPAN) -> DataFrame:
    """analyses with running_sum, running_count and running_average of a value by keys; null values count as 0."""
    out = running_sums(analyses, keys, order, {"running_sum": value, "running_count": F.lit(1)}, span)
    return out.withColumn("running_average", F.col("running_sum") / F.col("running_count"))
