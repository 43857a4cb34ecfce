"""Quality rules whose thresholds adapt to each language and source, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_name, table, written

WINDOW = 5
#: Metric: (numerator, denominator, scale, what counts as one finding, tails). A repeated passage has two windows' words at least.
METRICS = {
    "symbols": ("n_symbols", "word_chars", 1000, 1, "high"),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1, "high"),
    "repeats": ("n_repeat_words", "n_words", 1000, 2 * WINDOW, "high"),
    "word_length": ("word_chars", "n_words", 100, 1, "both"),
}
#: Quartile ranges beyond the quartiles, how many documents a coarser sketch counts for beside a group's own, and standard errors of a count.
FENCE, PRIOR, ERRORS = 3, 30, 2
#: Buckets an octave of a sketch, a power of two.
BUCKETS = 256
#: Result columns; columns of a caller's table with these names give way.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept")


def _others(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS]


def word_stats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each whole text.

    Words stay inside their row: windows are hashed, and only where some are equal are they sorted with their
    places, so a text costs n log n however often it repeats itself. Null and empty texts give zeros; columns of docs
    named like a result (RESULTS) give way, all others stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    w, ln, h, p, f = (free_name(docs, c) for c in ("words", "lines", "hashes", "places", "found"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(*_others(docs)).withColumn(w, words).withColumn(ln, lines).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    size, one = F.size(w), F.col(h)
    windows = F.transform(F.sequence(F.lit(0), size - window), lambda i: F.xxhash64(*(F.get(one, i + k) for k in range(window))))
    out = out.withColumn(h, F.when(size > window, windows))
    out = out.withColumn(p, F.when(
        F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.col(p)
    same = lambda x, j: (F.get(at, j - 1)["h"] == x["h"]) | (F.get(at, j + 1)["h"] == x["h"])
    out = out.withColumn(f, F.sort_array(F.transform(F.filter(at, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        f, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    return out.select(
        *_others(docs), size.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"), F.size(ln).cast("long").alias("n_lines"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def sketch_bucket(value: Column) -> Column:
    """Bucket of a whole number >= 0 in a mergeable quantile sketch: exact below 2 * BUCKETS, then BUCKETS an octave (0.4 % wide).

    Bucket counts add up, so sketches of tasks, sources or languages merge by summing; there are at most 14,336.
    """
    octave = F.length(F.bin(value)) - BUCKETS.bit_length()
    return F.when(value < 2 * BUCKETS, value).otherwise(octave * BUCKETS + F.call_function("shiftright", value, octave)).cast("long")


def sketches(values: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys, metric and bucket; values has keys, metric and a whole-number value."""
    return values.withColumn("bucket", sketch_bucket(F.col("value"))).groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, rows, q1, q3 (lower edges of the buckets that hold the quartile)."""
    at = W.partitionBy(*keys, "metric")
    b = F.col("bucket")
    octave = F.greatest(F.floor(b / BUCKETS) - 1, F.lit(0)).cast("int")
    edge = F.when(b < 2 * BUCKETS, b).otherwise(F.call_function("shiftleft", b - BUCKETS * octave, octave))
    ranked = sketch.withColumn("upto", F.sum("n").over(at.orderBy("bucket"))).withColumn("rows", F.max("upto").over(at)).withColumn("edge", edge)
    return ranked.groupBy(*keys, "metric").agg(
        F.max("rows").alias("rows"),
        F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("edge"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("edge"))).alias("q3"))


def blended(own: DataFrame, coarser: DataFrame, keys: list[str], upper: list[str]) -> DataFrame:
    """Sketches of keys in which the coarser sketch (by upper, some of keys) counts for PRIOR documents beside the group's own.

    One rule at every size: a group of few documents is close to the coarser sketch, one of many to its own.
    """
    at = W.partitionBy(*upper, "metric")
    # totals add up in the buckets' order, so fractions come out alike in every run
    shares = coarser.withColumn("upto", F.sum("n").over(at.orderBy("bucket"))).withColumn("n", PRIOR * F.col("n") / F.max("upto").over(at))
    shares = shares.select(*(F.col(k).alias(f"up_{k}") for k in upper), F.col("metric").alias("up_metric"), "bucket", "n")
    on = F.col("metric") == F.col("up_metric")
    for k in upper:
        on = on & F.col(k).eqNullSafe(F.col(f"up_{k}"))
    prior = own.select(*keys, "metric").distinct().join(shares, on).select(*keys, "metric", "bucket", "n")
    both = own.select(*keys, "metric", "bucket", F.col("n").cast("double").alias("n")).unionByName(prior)
    return both.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def adaptive_limits(stats: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """keys, metric, lo, hi: the range that a language and source's own documents keep to.

    hi = q3 + FENCE quartile ranges, lo = q1 - FENCE quartile ranges; no fixed cutoff or margin. Quartiles come from
    the group's sketch blended with that of its language, which is blended with that of the whole corpus.
    """
    lang = keys[0]
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _metric(m).alias("value")) for m in METRICS)))
    fine = sketches(stats.where("n_words > 0").select(*keys, pairs.alias("m")).select(*keys, "m.*"), list(keys))
    # merging is adding counts: the coarser sketches come from the finer ones, not from the documents
    by_lang = fine.groupBy(lang, "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    out = quartiles(blended(fine, blended(by_lang, whole, [lang], []), list(keys), [lang]), list(keys))
    reach, both = FENCE * (F.col("q3") - F.col("q1")), F.col("metric").isin([m for m, row in METRICS.items() if row[4] == "both"])
    return out.select(*keys, "metric", F.when(both, F.col("q1") - reach).otherwise(F.lit(-1)).alias("lo"), (F.col("q3") + reach).alias("hi"))


def _metric(name: str) -> Column:
    top, under, scale, _, _ = METRICS[name]
    return F.floor(scale * F.col(top) / F.greatest(F.col(under), F.lit(1))).cast("long")


def _evident(name: str, sign: int) -> Column:
    """The metric with its count moved by ERRORS standard errors (square roots of a count of findings): a short text shows little."""
    top, under, scale, unit, _ = METRICS[name]
    found = F.col(top) / F.lit(float(unit))
    moved = F.greatest(found + sign * ERRORS * F.sqrt(found), F.lit(0.0))
    return scale * unit * moved / F.greatest(F.col(under), F.lit(1))


def judged(stats: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """stats with base_failed, failed_rules and kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated five-word windows. A document that passes
    is kept unless a metric of METRICS lies outside the limits of its language and source by more than its count's standard
    errors: one double line of four says little of a text, forty of a hundred and sixty do. Null keys form a group
    of their own. A group's limits are one row, so the join that applies them splits a hot group as it likes.
    """
    name, own = free_name(stats, "limits"), [free_name(stats, f"limits_{k}") for k in keys]
    limits = adaptive_limits(stats, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct("lo", "hi")))).alias(name))
    limits = limits.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), name)
    on = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    bad = [F.when((_evident(m, -1) > F.col(name)[m]["hi"]) | (_evident(m, 1) < F.col(name)[m]["lo"]), F.lit(m)) for m in METRICS]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.join(limits, on, "left").withColumn("base_failed", base).withColumn(
        "failed_rules", F.array_compact(F.array(*bad))).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(name, *own)


def quality_rules(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """docs without the text, with word statistics, base_failed, failed_rules and kept; each text is read once."""
    return judged(written(word_stats(docs).drop("text"), "word-stats"), keys)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document; null and empty texts have no words and fail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
