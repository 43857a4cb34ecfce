"""Reading, checking and appending to event logs; writes are DataFrames of accepted, rejected or outgoing rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.upcast import upcast
from ..schema import EVENT_DDL
from .stored import dealt, stored


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(EVENT_DDL).parquet(path)


def read_seed_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line: stream_id, event_type, event_version, payload (an object, kept as text), recorded_at."""
    raw = spark.read.text(path).select(F.parse_json("value").alias("v"))
    return raw.select(*(F.try_variant_get("v", f"$.{n}", t).alias(n) for n, t in (("stream_id", "string"), ("event_type", "string"), ("event_version", "int"))),
                      F.to_json(F.variant_get("v", "$.payload", "variant")).alias("payload"), F.try_variant_get("v", "$.recorded_at", "string").cast("timestamp").alias("recorded_at"))


def write_seed_jsonl(log: DataFrame, path: str) -> None:
    log.select("stream_id", "event_type", "event_version", F.parse_json("payload").alias("payload"), "recorded_at").write.json(path)


def read_profiles_json(spark: SparkSession, path: str, flag_ddl: str = "flag_type string, severity string, is_active boolean, note string") -> DataFrame:
    """Companies with nested flags, one row per company and flag (or one without)."""
    ddl = f"company_id string, name string, industry string, jurisdiction string, legal_type string, trajectory string, risk_segment string, compliance_flags array<struct<{flag_ddl.replace(' ', ':').replace(',:', ',')}>>"
    return spark.read.option("multiLine", True).schema(ddl).json(path).withColumn("flag", F.explode_outer("compliance_flags")).drop("compliance_flags")


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return files.orderBy("name")


def read_text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files: name, text."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


def read_fact_csv(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", True).option("pathGlobFilter", "*.csv").schema("field string, value string, fiscal_year int, currency string").csv(folder)


def load_stream(log: DataFrame, stream_id: str, from_position: int = 0, to_position: int | None = None) -> DataFrame:
    """load_raw's events at their newest version: older payloads get the keys that they lack."""
    return upcast(load_raw(log, stream_id, from_position, to_position)).orderBy("stream_position")


def load_raw(log: DataFrame, stream_id: str, from_position: int = 0, to_position: int | None = None) -> DataFrame:
    """Events after from_position up to to_position, which 0 and None leave open, as they are stored; archived streams load as well."""
    out = log.where((F.col("stream_id") == stream_id) & (F.col("stream_position") > from_position))
    return (out.where(F.col("stream_position") <= to_position) if to_position else out).orderBy("stream_position")


def load_all(log: DataFrame, from_global: int = 0, to_global: int | None = None, event_types: list[str] | None = None) -> DataFrame:
    """Events after from_global up to to_global, unordered: order them where a caller needs it."""
    out = log.where(F.col("global_position") > from_global)
    out = out.where(F.col("global_position") <= to_global) if to_global is not None else out
    return out.where(F.col("event_type").isin(event_types)) if event_types else out


def stream_heads(log: DataFrame) -> DataFrame:
    return log.groupBy("stream_id").agg(F.max("stream_position").alias("version"))


def stream_version(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Version of each wanted stream_id; -1 for one that doesn't exist."""
    return wanted.join(stream_heads(log), "stream_id", "left").withColumn("version", F.coalesce("version", F.lit(-1)))


def stream_metadata(log: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Header rows; archive: stream_id and archived_at of archived streams."""
    out = log.groupBy("stream_id").agg(F.max("stream_position").alias("current_version"), F.min("recorded_at").alias("created_at"))
    out = out.withColumn("aggregate_type", F.split("stream_id", "-")[0])
    return out.join(archive, "stream_id", "left") if archive is not None else out


def archive_streams(archive: DataFrame, streams: DataFrame, moment) -> DataFrame:
    """The archive table with streams marked; those marked before keep their time."""
    new = streams.select("stream_id").distinct().join(archive, "stream_id", "left_anti").withColumn("archived_at", F.lit(moment))
    return archive.unionByName(new)


def admit(proposals: DataFrame, heads: DataFrame) -> DataFrame:
    """Optimistic appends: proposals (stream_id, ord, expected_version, ...) with accepted and the version they met (actual).

    In order of ord, a proposal is accepted iff it expects the head (-1: a stream that doesn't exist), which then
    moves on. The fold of a stream is a loop over its own proposals only; they arrive in Arrow batches, sorted.
    """
    head = F.coalesce("version", F.lit(-1))
    work = proposals.join(heads, "stream_id", "left").withColumn("version", head)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in proposals.schema)}, actual long, accepted boolean"
    names = proposals.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, at = None, 0
        for pdf in batches:
            actual, ok = [], []
            for s, expected, version in zip(pdf["stream_id"], pdf["expected_version"], pdf["version"], strict=True):
                if s != stream:
                    stream, at = s, int(version)
                actual.append(at)
                ok.append(int(expected) == at)
                if ok[-1]:
                    at = max(at, 0) + 1
            yield pdf[names].assign(actual=actual, accepted=ok)

    return dealt(work, "stream_id").sortWithinPartitions("stream_id", "ord").mapInPandas(fold, schema)


def append_events(proposals: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accepted (with stream_position) and rejected (stream_id, expected, actual)."""
    out = admit(proposals, heads)
    accepted = out.where("accepted").withColumn("stream_position", F.greatest("actual", F.lit(0)) + 1).drop("actual", "accepted")
    return accepted, out.where("not accepted").select("stream_id", F.col("expected_version").alias("expected"), "actual")


def admit_groups(proposals: DataFrame, heads: DataFrame, group: str = "group_id") -> DataFrame:
    """All-or-nothing appends over several streams: group and accepted.

    A group stands on a stream where its first proposal there does (of equal ord, the smaller group first); its own later ones
    follow on the head that the first moved. A group is decided when it is first on all its streams: accepted if every first
    proposal meets its head and the others follow; the heads then move on. Groups that wait for each other in a circle have no
    order: ValueError. A null group is a group of its own; every proposal names a stream.

    Streams that groups tie together are a component. Its groups are one ordered fold, in Arrow batches: it keeps the heads of
    the component's streams and the groups that still wait, so a chain of groups needs no round of its own.
    """
    own = W.partitionBy(group, "stream_id").orderBy("ord")
    begin, k = F.first("expected_version").over(own), F.row_number().over(own)
    follows = (k == 1) | (F.col("expected_version") == F.greatest(begin, F.lit(0)) + k - 1)
    rows = proposals.select(F.col(group).alias("member"), F.col("stream_id"), "ord", begin.alias("expected"), F.coalesce(follows, F.lit(False)).alias("follows"))
    steps = stored(rows.groupBy("member", "stream_id").agg(F.min("ord").alias("ord"), F.count("*").alias("n"), F.first("expected").alias("expected"), F.bool_and("follows").alias("follows")))
    mates = W.partitionBy("member")
    steps = steps.withColumns({"width": F.count("*").over(mates), "anchor": F.min("stream_id").over(mates)})
    tied = steps.where("stream_id != anchor").select(F.col("stream_id").alias("a"), F.col("anchor").alias("b")).distinct()
    work = steps.join(connected(tied), F.col("stream_id") == F.col("node"), "left").join(heads.select("stream_id", "version"), "stream_id", "left")
    work = work.select(F.coalesce("root", "stream_id").alias("component"), "ord", "member", "stream_id", "n", "expected", "follows", "width", F.coalesce("version", F.lit(-1)).alias("version"))
    kind = proposals.schema[group].dataType.simpleString()
    done = stored(dealt(work, "component").sortWithinPartitions("component", "ord", "member", "stream_id").mapInArrow(_decide, f"member {kind}, accepted boolean"))
    circle = done.where("accepted is null").count()
    if circle:
        raise ValueError(f"{circle} groups wait for each other in a circle")
    return done.withColumnRenamed("member", group)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fold of admit_groups over steps in order of component and place; a group in a circle gets null."""
    now, kept, heads, queues, waiting = None, None, {}, {}, {}
    out: list[tuple] = []

    def settle(first) -> None:
        ready = [first]
        while ready:
            g = ready.pop()
            if g not in waiting or waiting[g][0] or any(queues[s][0] != g for s, *_ in waiting[g][1]):
                continue
            mine = waiting.pop(g)[1]
            ok = all(follows and expected == heads[s] for s, n, expected, follows in mine)
            out.append((g, ok))
            for s, n, *_ in mine:
                heads[s] = max(heads[s], 0) + n if ok else heads[s]
                queues[s].popleft()
            ready += dict.fromkeys(queues[s][0] for s, *_ in mine if queues[s])

    for batch in batches:
        for component, _, g, s, n, expected, follows, width, version in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != now:
                out += [(other, None) for other in waiting]
                now = component
                for state in (heads, queues, waiting):
                    state.clear()
            heads.setdefault(s, version)
            queues.setdefault(s, deque()).append(g)
            steps = waiting.setdefault(g, [width, []])
            steps[0] -= 1
            steps[1].append((s, n, expected, follows))
            if not steps[0]:
                settle(g)
        kept = batch.schema.field("member").type
        yield _verdicts(out, kept)
        out.clear()
    if waiting:
        yield _verdicts([(other, None) for other in waiting], kept)


def _verdicts(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.bool_())], names=["member", "accepted"])


def connected(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) of every node of links (a, b).

    Each round every root with a smaller neighbour points to the smallest, pointers double until they are flat, and links between
    roots go on: at least half of the roots that still have links are gone after it.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    out, edges = stored(nodes.select("node", F.col("node").alias("root"))), stored(links.where("a != b"))
    while not edges.isEmpty():
        up = stored(edges.select(F.greatest("a", "b").alias("root"), F.least("a", "b").alias("to")).groupBy("root").agg(F.min("to").alias("to")))
        while not up.join(up.select(F.col("root").alias("to")), "to", "left_semi").isEmpty():
            next_ = up.select(F.col("root").alias("to"), F.col("to").alias("top"))
            up = stored(up.join(next_, "to", "left").select("root", F.coalesce("top", "to").alias("to")))
        out = stored(out.join(up, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        for end in ("a", "b"):
            edges = edges.join(up.withColumnRenamed("root", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = stored(edges.where("a != b").distinct())
    return out


def assign_global_positions(accepted: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Dense positions after start in the order of the given columns, without one task that sorts all rows.

    Rows are dealt by range into the session's number of shuffle partitions and numbered there; each partition starts
    where those before it end.
    """
    ranged = stored(accepted.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    starts = sizes.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("before"))  # one row a partition
    number = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_n", number).join(F.broadcast(starts), "_part").withColumn("global_position", F.col("before") + F.col("_n") + start).drop("_part", "_n", "before")


def mirror_to_audit(log: DataFrame) -> DataFrame:
    """Copies of events with an application id, for the stream audit-loan-{application}, with the source stream in their metadata."""
    app = F.get_json_object("payload", "$.application_id")
    copies = log.where(app.isNotNull() & ~F.col("stream_id").startswith("audit-"))
    meta = F.to_json(F.struct(
        F.get_json_object("metadata", "$.correlation_id").alias("correlation_id"), F.get_json_object("metadata", "$.causation_id").alias("causation_id"),
        F.col("stream_id").alias("source_stream_id")))
    out = copies.withColumn("metadata", meta).withColumn("stream_id", F.concat(F.lit("audit-loan-"), app))
    return out.withColumn("stream_position", F.row_number().over(W.partitionBy("stream_id").orderBy("global_position")).cast("long"))


def mixed_batches(rows: DataFrame, batch: str) -> DataFrame:
    """Write batches that name more than one application, which may not be mirrored."""
    return rows.groupBy(batch).agg(F.count_distinct(F.get_json_object("payload", "$.application_id")).alias("apps")).where("apps > 1")


def outbox_rows(log: DataFrame) -> DataFrame:
    return log.select("event_id", F.lit("ALL").alias("destination"), "payload", F.col("recorded_at").alias("created_at"),
                      F.lit(None).cast("timestamp_ntz").alias("published_at"), F.lit(0).alias("attempts"))


def pending_outbox(outbox: DataFrame, batch_size: int = 100, max_attempts: int = 5) -> DataFrame:
    return outbox.where((F.col("published_at").isNull()) & (F.col("attempts") < max_attempts)).orderBy("created_at", "event_id").limit(batch_size)


def pending_in_lanes(outbox: DataFrame, lanes: int, batch_size: int = 100, max_attempts: int = 5) -> DataFrame:
    """pending_outbox for several publishers side by side: each has a lane, the rows of some event_ids, and takes the oldest of its own."""
    if lanes == 1:
        return pending_outbox(outbox, batch_size, max_attempts)
    oldest = F.row_number().over(W.partitionBy(F.pmod(F.xxhash64("event_id"), F.lit(lanes))).orderBy("created_at", "event_id"))
    waits = outbox.where(F.col("published_at").isNull() & (F.col("attempts") < max_attempts))
    return waits.withColumn("_n", oldest).where(F.col("_n") <= batch_size).drop("_n")


def dead_letters(outbox: DataFrame, max_attempts: int = 5) -> DataFrame:
    return outbox.where(F.col("published_at").isNull() & (F.col("attempts") >= max_attempts))


def upsert(target: DataFrame, updates: DataFrame, key: str, changed: list[str]) -> DataFrame:
    """target with updates' new keys inserted; on known keys only the changed columns are taken."""
    t, u = target.alias("t"), updates.alias("u")
    both = t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer")
    own = lambda c: F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")) if c in changed else F.coalesce(F.col(f"t.{c}"), F.col(f"u.{c}"))
    return both.select(*(own(c).alias(c) for c in target.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def check_constraints(log: DataFrame) -> DataFrame:
    """Violations: rule, key and n; none for a sound log."""
    need = ["event_id", "stream_id", "stream_position", "global_position", "event_type", "payload"]
    nulls = log.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in need)).select(F.explode(F.array(*(F.struct(F.lit("not_null").alias("rule"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in need))).alias("v")).select("v.*").where("n > 0")
    twice = log.groupBy("stream_id", "stream_position").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("unique").alias("rule"), F.concat_ws("@", "stream_id", "stream_position").alias("key"), "n")
    gaps = log.groupBy("stream_id").agg((F.max("stream_position") - F.count_distinct("stream_position")).alias("n")).where("n != 0").select(
        F.lit("dense").alias("rule"), F.col("stream_id").alias("key"), "n")
    return nulls.unionByName(twice).unionByName(gaps)
