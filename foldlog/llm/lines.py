"""Lines that many documents share, dropped from all but the last that holds them, with DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

SPACE = " \t\n\x0b\f\r"
#: A shared line has at least so many code points and stands in at least so many documents.
LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A to Z in lower case; other letters stay as they are."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _text_key(text: Column) -> Column:
    """What tells the texts of one id apart: 128 bits, so that rows without id may be many."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def shared_lines(docs: DataFrame, key: str, least_length: int, least_documents: int) -> tuple[DataFrame, DataFrame]:
    """Every long line (doc, text_key, place, a, b), and the line keys that enough documents share (a, b, keeper).

    a and b are 128 bits of hash of the line's key. Documents are counted in two steps, a line of a document and then a
    line, both combined before their shuffle: a line that a third of all documents hold is one row a task.
    """
    every = docs.select(F.col(key).alias("doc"), _text_key(F.col("text")).alias("text_key"), F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("place", "line"))
    lines = every.where(F.length("line") >= least_length).select("doc", "text_key", "place", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    holders = lines.select("a", "b", "doc").distinct().groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
    return lines, holders.where(F.col("n") >= least_documents).select("a", "b", "keeper")


def line_dedup(docs: DataFrame, key: str = "doc_id", least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with shared lines taken out of text, and n_lines (before) and n_dropped (longs).

    A line's key is the line stripped of ASCII white space, A to Z lower-cased. Keys of at least least_length code points
    found in at least least_documents documents lose all their lines but those of the largest document holding the key.
    A null text counts as one empty line and comes back empty. Rows of one id are one document; so are the rows without id,
    which stands before all others. An empty table gives no rows. Other columns stay, whatever their names; n_lines and
    n_dropped get leading underscores where docs has such columns.

    Only hashes and places travel to be counted; the text is shuffled once, to meet the places of its dropped lines. A
    document's places are the only group that is collected, bounded by its own lines.
    """
    lines, shared = shared_lines(docs, key, least_length, least_documents)
    lost = lines.join(shared, ["a", "b"]).where(F.col("doc").isNull() | (F.col("doc") != F.col("keeper")))
    drops = lost.groupBy("doc", "text_key").agg(F.collect_set("place").alias("places"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(key).alias("id"), _text_key(F.col("text")).alias("own_key"))
    both = rows.join(drops, F.col("id").eqNullSafe(F.col("doc")) & (F.col("own_key") == F.col("text_key")), "left")
    # array_except keeps the order of places, and is linear however many go
    parts = both.withColumn("lines", _lines(F.col("own.text"))).withColumn(
        "stay", F.when(F.col("places").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")))
    text = F.when(F.col("stay").isNull(), F.coalesce("own.text", F.lit(""))).otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    return parts.select(
        *(text.alias(c) if c == "text" else F.col(f"own.`{c}`") for c in docs.columns), F.size("lines").cast("long").alias(n_lines),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias(n_dropped))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, n_lines, n_dropped, kept_sha256; see line_dedup for nulls and repeated rows."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents),
keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, place, line, coalesce(doc_id <> keeper, false) AS dropped FROM keys LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
