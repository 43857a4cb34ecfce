"""Connected components of links, by label passing over a written table; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A table of links is written in parts of about so many: small tables in few files, large ones in many.
PART_LINKS = 200_000


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) of every node of links (a, b).

    Alternates large-star and small-star steps: each round points the larger neighbours, then the smaller ones, of every
    node to its smallest neighbour, until nothing changes. A star with many leaves is one minimum (combined before
    the shuffle) and one join, which adaptive execution splits. Nulls and self-links are left out.
    """
    now = written(links.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = _mark(now)
    while mark != (0, 0):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s")).select("s.*")
        after = written(small.where("a != b").distinct().coalesce(_parts(mark)), "cc")
        seen, mark = mark, _mark(after)
        now = after
        if mark == seen:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return roots.coalesce(_parts(mark))


def _parts(mark: tuple[int, int]) -> int:
    """How many files a round writes, by the links before it; results don't depend on it."""
    return mark[0] // PART_LINKS + 1


def _mark(links: DataFrame) -> tuple[int, int]:
    """Number of links and a sum over their hashes: equal for equal sets."""
    r = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(r["n"]), int(r["h"])
