"""Hash chains over audit streams: links, verification, tampering, package checksums.

A link hashes the previous hash and the payload hashes of the events since. Payloads are hashed as canonical JSON, so
blanks and the order of keys don't matter. All links are recomputed at once: the stored hash of
the check before is part of the data, so no link waits for another. A segment's hashes are collected per segment,
which is bounded by how often checks are run, not by the log.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from ..functions.expressions import by_category, iso_timestamp

CHECK = "AuditIntegrityCheckRun"


@F.pandas_udf(StringType())
def canonical_json(payload: pd.Series) -> pd.Series:
    """Sorted keys, no blanks, ASCII only: the text that hashes are taken of. Text that is no JSON stays as it is."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return x

    return payload.map(one)


def payload_hash(payload: Column) -> Column:
    """SHA-256 of the canonical payload."""
    return F.sha2(canonical_json(payload), 256)


def segments(log: DataFrame, hash_of: Column | None = None) -> DataFrame:
    """Audit events with hash (of the payload), is_check and segment (checks before the event in its stream)."""
    e = by_category(log, "audit-").withColumn("is_check", F.col("event_type") == CHECK)
    before = W.partitionBy("stream_id").orderBy("global_position").rowsBetween(W.unboundedPreceding, -1)
    return e.withColumn("hash", payload_hash(F.col("payload")) if hash_of is None else hash_of).withColumn(
        "segment", F.coalesce(F.sum(F.col("is_check").cast("int")).over(before), F.lit(0)))


def _link(previous: Column, hashes: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.array_join(F.transform(F.array_sort(hashes), lambda x: x["hash"]), "")), 256)


def integrity_hash(log: DataFrame) -> DataFrame:
    """Per audit stream: the next check's hash over the events since the last one, how many, and the hash before."""
    e = segments(log)
    last = e.where("is_check").groupBy("stream_id").agg(
        F.max_by(F.get_json_object("payload", "$.integrity_hash"), "global_position").alias("previous_hash"), F.max("global_position").alias("at"))
    rest = e.where("not is_check").join(last, "stream_id", "left").where("at is null or global_position > at")
    out = rest.groupBy("stream_id").agg(F.first("previous_hash").alias("previous_hash"), F.collect_list(F.struct("global_position", "hash")).alias("h"))
    return out.select("stream_id", _link(F.col("previous_hash"), F.col("h")).alias("integrity_hash"), F.coalesce("previous_hash", F.lit("")).alias("previous_hash"), F.size("h").alias("events_hashed"))


def verify_chain(log: DataFrame) -> DataFrame:
    """Per audit stream: is_valid, checks and the first position that fails, with which of the two failures.

    A missing previous hash counts as '', a JSON null doesn't and breaks the chain. Streams without checks are valid.
    Payloads are hashed once: of each event its hash and what a check says are kept, and streams and links come from these.
    """
    json_ = lambda k: F.get_json_object("payload", f"$.{k}")
    absent = ~F.coalesce(F.array_contains(F.json_object_keys("payload"), "previous_hash"), F.lit(False))
    said = F.when(F.col("is_check"), F.struct("global_position", json_("integrity_hash").alias("stored"), F.when(absent, "").otherwise(json_("previous_hash")).alias("said")))
    e = segments(log).select("stream_id", "segment", "global_position", "hash", said.alias("check"))
    at = W.partitionBy("stream_id").orderBy("segment")
    per = e.groupBy("stream_id", "segment").agg(
        F.collect_list(F.when(F.col("check").isNull(), F.struct("global_position", "hash"))).alias("h"), F.max("check").alias("check")).checkpoint()
    linked = per.where("check is not null").withColumn("before", F.lag("check.stored", 1, "").over(at))
    broken = ~F.col("check.said").eqNullSafe(F.col("before"))
    wrong = ~_link(F.col("before"), F.col("h")).eqNullSafe(F.col("check.stored"))
    failed = linked.withColumn("failure", F.when(broken, "chain_broken").when(wrong, "hash_mismatch"))
    out = failed.groupBy("stream_id").agg(
        F.count("*").alias("checks"), F.min(F.when(F.col("failure").isNotNull(), F.struct(F.col("check.global_position").alias("at"), "failure"))).alias("f"))
    return per.select("stream_id").distinct().join(out, "stream_id", "left").select(
        "stream_id", F.col("f").isNull().alias("is_valid"), F.coalesce("checks", F.lit(0)).alias("checks"), F.col("f.at").alias("failed_at"), F.col("f.failure").alias("failure"))


def close_segments(log: DataFrame, every: int = 20) -> DataFrame:
    """log's audit events and a check after each every events of a stream, as a well-behaved auditor writes them.

    A check's previous hash depends on all links before it, so the links of one stream are folded in order, over
    one hash a segment.
    """
    e = by_category(log, "audit-").withColumn("n", F.row_number().over(W.partitionBy("stream_id").orderBy("global_position")))
    e = e.withColumn("segment", F.floor((F.col("n") - 1) / every)).withColumn("hash", payload_hash(F.col("payload"))).checkpoint()
    seg = e.groupBy("stream_id", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("global_position", "hash"))), lambda x: x["hash"]), "").alias("joined"),
        F.max("global_position").alias("at"), F.max("recorded_at").alias("recorded_at"), F.count("*").alias("size")).where(F.col("size") == every)
    chain = seg.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("segment", "joined", "at", "recorded_at"))).alias("s"))
    start = F.array().cast("array<string>")
    links = F.aggregate("s", start, lambda a, x: F.concat(a, F.array(F.sha2(F.concat(F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(""), x["joined"]), 256))))
    row = chain.withColumn("links", links).select("stream_id", F.posexplode(F.arrays_zip("s", "links")).alias("i", "z")).withColumn(
        "previous", F.lag("z.links", 1, "").over(W.partitionBy("stream_id").orderBy("i")))
    # a check stands between the event that closes its segment and the next one: doubled positions leave room
    checks = row.select(
        F.lit(None).cast("string").alias("event_id"), "stream_id", F.lit(None).cast("long").alias("stream_position"), (2 * F.col("z.s.at") + 1).alias("global_position"),
        F.lit(CHECK).alias("event_type"), F.lit(1).alias("event_version"),
        F.to_json(F.struct(F.col("z.links").alias("integrity_hash"), F.col("previous").alias("previous_hash"), F.lit(every).alias("events_hashed"))).alias("payload"),
        F.lit("{}").alias("metadata"), F.col("z.s.recorded_at").alias("recorded_at"))
    return e.drop("n", "segment", "hash").withColumn("global_position", 2 * F.col("global_position")).unionByName(checks)


def package_row() -> Column:
    """An event as a canonical JSON object, for a package's checksum. Times are UTC."""
    text = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    parts = {"event_id": text("event_id"), "event_type": text("event_type"), "event_version": F.col("event_version").cast("string"),
             "global_position": F.col("global_position").cast("string"), "payload": F.coalesce("payload", F.lit("null")),
             "recorded_at": F.concat(F.lit('"'), iso_timestamp(F.col("recorded_at")), F.lit('+00:00"')), "stream_position": F.col("stream_position").cast("string")}
    items = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in parts.items()]
    return canonical_json(F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}")))


def rows_checksum(rows: Column) -> Column:
    """SHA-256 over an array of package rows in their order."""
    return F.sha2(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")), 256)


def package_checksum(log: DataFrame) -> DataFrame:
    """Per stream: SHA-256 over its events as a canonical JSON array, in order (bounded by the stream)."""
    rows = log.select("stream_id", F.struct("stream_position", package_row().alias("r")).alias("e")).groupBy("stream_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return rows.select("stream_id", rows_checksum(F.col("e.r")).alias("checksum"))
