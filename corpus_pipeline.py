"""A training-data pipeline over documents: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlog.llm import bpe, mixing, simhash, suffixes, toxicity
from foldlog.llm.common import deflated, free_name, inflate, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, with all their columns; the models learn from docs and the labels in sf_dir.

    Null and empty texts and rows without id are scored like others; repeated rows stay or go together.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return toxicity.scored(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar rows the first, once, by doc_id and text; rows without id come after all others.

    SimHash fingerprints are linked and of each group the first goes on. Fingerprints only estimate, so an exact check of shingle sets
    follows among those: no two rows that stay are similar at 0.8. A row is known by its doc_id and text, so unlike texts under one doc_id are told apart.
    """
    id_ = F.col("doc_id").cast("long")
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    keyed = docs.select(key.alias("key"), "text")
    firsts = written(simhash.firsts_by_fingerprint(keyed, "key"), "simhash-firsts")
    left = written(deflated(keyed).join(firsts, "key", "left_semi").dropDuplicates(["key"]), "simhash-left")
    groups = simhash.similar_documents(inflate(left), "key")
    stay = groups.where("key = component").select("key").distinct()
    # repeated rows are equal in key and text; of those that differ elsewhere the first by a hash stays
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(key.alias("key"), others.alias("row"), F.xxhash64(*(f"`{c}`" for c in docs.columns)).alias("by"), "text")
    first = F.row_number().over(W.partitionBy("key").orderBy("by"))
    once = rows.join(stay, "key", "left_semi").withColumn("n", first).where("n = 1")
    return once.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that also start earlier."""
    return suffixes.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document of the mix."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("mixing", mix),
    ("byte_level_bpe", encode),
]
#: Trained models, draws and tokenizers have no SQL. tests/llm holds the last four stages against plain versions, toxicity by its operator's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
