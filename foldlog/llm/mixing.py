"""Mixing sources to target weights by pivotal dependent rounding of copy counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, table, written

BLOCK_ROWS, FAN_IN, MOST_COPIES = 4096, 64, 3
_COLUMNS = ["row", "source", "bin", "block", "size", "prob", "picked"]
_SCHEMA = "row long, source string, bin int, block long, size long, prob double, picked int"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size and target of each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. No target is above
    MOST_COPIES times its source's size; what is cut off is shared again by weight among the others, round by round.
    The driver holds one row per source. (Spark orders strings by their UTF-8 bytes, which is by code point.)
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    whole, n = sum(r["n"] for r in rows), len(rows)
    weight = [weights[i % len(weights)] for i in range(n)]
    target, full = [0.0] * n, [False] * n
    while True:
        left = whole - sum(t for t, f in zip(target, full, strict=True) if f)
        shared = sum(w for w, f in zip(weight, full, strict=True) if not f)
        over = []
        for i in range(n):
            if not full[i]:
                target[i] = left * weight[i] / shared
                if target[i] > MOST_COPIES * rows[i]["n"]:
                    over.append(i)
        if not over:
            break
        for i in over:
            target[i], full[i] = float(MOST_COPIES * rows[i]["n"]), True
    spark = sizes.sparkSession
    return spark.createDataFrame([(r["source"], r["n"], t) for r, t in zip(rows, target, strict=True)], "source string, source_size long, target double")


def _pivotal(group: pd.DataFrame) -> pd.DataFrame:
    """Settle all rows of a group but one at most.

    Of each pair, words move from one document's expectation to the other's until one copy probability is 0 or 1.
    Which way is drawn so that both probabilities hold on average; the expected words of the group never change.
    """
    g = group.sort_values(["size", "row"], ascending=[False, True], kind="stable")
    rows, size, prob = g["row"].to_numpy(), np.maximum(g["size"].to_numpy(), 1), g["prob"].to_numpy(copy=True)
    picked = np.full(len(g), -1, dtype=np.int32)
    carry = -1

    def settled(i: int) -> bool:
        if 1e-9 < prob[i] < 1 - 1e-9:
            return False
        picked[i] = int(prob[i] > 0.5)
        return True

    for j in range(len(g)):
        if settled(j):
            continue
        if carry < 0:
            carry = j
            continue
        a, b = carry, j
        up = min((1 - prob[a]) * size[a], prob[b] * size[b])  # words that a can gain from b
        down = min(prob[a] * size[a], (1 - prob[b]) * size[b])
        u = xxhash.xxh64_intdigest(b"%d,%d" % (rows[a], rows[b])) / 2.0**64
        words = up if u * (up + down) < down else -down
        prob[a] += words / size[a]
        prob[b] -= words / size[b]
        carry = next((i for i in (a, b) if not settled(i)), -1)
    return g.assign(prob=prob, picked=picked)[_COLUMNS]


def _settle_last(group: pd.DataFrame) -> pd.DataFrame:
    g = _pivotal(group)
    u = np.array([xxhash.xxh64_intdigest(b"last,%d" % r) / 2.0**64 for r in g["row"]])
    return g.assign(picked=np.where(g["picked"] < 0, (u < g["prob"]).astype(np.int32), g["picked"]).astype(np.int32))[_COLUMNS]


def mix_sources(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each row, 0 to MOST_COPIES.

    A document is due target / source_size copies: the whole part is certain, the rest is rounded so that a source's
    sum holds. Rows of a source are dealt into blocks of about BLOCK_ROWS rows of like size; a block settles all its
    rows but one by pivotal rounding. The residual rows of FAN_IN blocks meet in the next round, and so on up to
    one group per source: a reduction tree, in which no task ever holds more than a block. What a pair exchanges
    is words, so a source's taken words miss its target by one document at most. Random numbers are hashes of row keys: reruns agree.

    Null text: size 0. A source of size 0 gets target 0 and no copies. Null source: a source of its own, last.
    Equal rows are told apart by their order and get their own copies. An empty table gives an empty result.
    Columns of docs named like one of the four new ones are replaced; all others stay, whatever their names.
    """
    new = ["size", "source_size", "target", "copies"]
    keep = [F.col(f"own.`{c}`") for c in docs.columns if c.lower() not in new]
    return _with_copies(docs, size).select(*keep, *new)


def _with_copies(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """own (the row of docs), size, source_size, target and copies of each row."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sized = docs.select(F.struct(*columns).alias("own"), "source", (word_count(F.col("text")) if size is None else size).alias("size"), F.xxhash64(*columns).alias("hash"))
    # equal rows need keys of their own: the hash and a number within it
    numbered = F.row_number().over(W.partitionBy("hash").orderBy("size"))
    keyed = sized.withColumn("row", F.xxhash64("hash", numbered)).drop("hash")
    slim = written(keyed.select("row", "source", "size"), "mix-rows")
    targets = source_targets(slim)
    limit = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    bins = slim.withColumn("bin", F.floor(F.log2(F.col("size") + F.lit(1.0)) * 8).cast("int"))
    due = bins.join(targets, bins["source"].eqNullSafe(targets["source"])).select(
        "row", bins["source"], "bin", "size", F.floor(limit).cast("int").alias("whole"), (limit - F.floor(limit)).alias("prob"))
    counts = bins.groupBy("source", "bin").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    dealt = due.join(counts, due["source"].eqNullSafe(counts["source"]) & (due["bin"] == counts["bin"])).select(
        "row", due["source"], due["bin"], F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"), "size", "prob", "whole")
    most = counts.agg(F.max("blocks")).first()[0] or 1
    work = dealt.select("row", "source", "bin", "block", "size", "prob", F.lit(-1).alias("picked"))
    done, keys = [], ["source", "bin", "block"]
    for level in range(math.ceil(math.log(max(2, most), FAN_IN)) + 1):
        settled = written(work.groupBy(*keys).applyInPandas(_pivotal, _SCHEMA), f"mix-level{level}")
        done.append(settled.where("picked >= 0"))
        work = settled.where("picked < 0").withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
    done.append(work.groupBy("source").applyInPandas(_settle_last, _SCHEMA))
    picked = done[0]
    for d in done[1:]:
        picked = picked.unionByName(d)
    # a row is known by its key, size and source, so keys that meet by chance part rows all the same
    k, p = keyed.alias("k"), picked.select("row", "size", "source", "picked").alias("p")
    same = (F.col("k.row") == F.col("p.row")) & (F.col("k.size") == F.col("p.size")) & F.col("k.source").eqNullSafe(F.col("p.source"))
    both = k.join(p, same).select("k.own", "k.source", "k.size", "p.picked")
    out = both.join(targets, both["source"].eqNullSafe(targets["source"]))
    return out.select("own", "size", "source_size", "target", (F.floor(limit).cast("int") + F.col("picked")).alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources takes it, with all columns of docs, whatever their names."""
    out = _with_copies(docs).where("copies > 0")
    return out.select("own", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("own.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n")), "mix-sizes")
    out = mix_sources(docs, F.col("n"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
