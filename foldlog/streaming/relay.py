"""Publishing from an outbox: at least once, with attempts counted and dead letters after too many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.log import dead_letters, pending_in_lanes
from .tables import KeyedTable

OUTBOX_DDL = "event_id string, destination string, payload string, created_at timestamp_ntz, published_at timestamp_ntz, attempts int"


def take_in(outbox: KeyedTable, rows: DataFrame) -> None:
    """Adds the rows whose event_id the table doesn't know; those it knows keep their attempts."""
    new = rows.select(*outbox.read().columns).dropDuplicates(["event_id"]).join(outbox.read().select("event_id"), "event_id", "left_anti")
    outbox.write(new, outbox.version() + 1)


def drain(outbox: KeyedTable, publish: Callable[[DataFrame], DataFrame], batch_size: int = 100, max_attempts: int = 5, lanes: int = 1) -> int:
    """One round over the oldest pending rows: those that publish names as ok get published_at, the others one attempt more; how many were tried.

    publish gets the rows and returns event_id and ok; a row it doesn't return has failed. It runs before anything is recorded: a crash in
    between publishes again. Rows are dealt to lanes by event_id, and a round is bounded by batch_size in each.
    """
    version = outbox.version() + 1
    # one folder for what was tried, so that the publisher sees the rows that are recorded
    held = f"{outbox.path}-tried"
    pending_in_lanes(outbox.read(), lanes, batch_size, max_attempts).write.mode("overwrite").parquet(held)
    now = outbox.spark.read.schema(OUTBOX_DDL).parquet(held)
    ok = publish(now).select("event_id", F.coalesce("ok", F.lit(False)).alias("ok")).dropDuplicates(["event_id"])
    done = now.join(ok, "event_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    moved = done.withColumn("published_at", F.when(F.col("ok"), F.current_timestamp().cast("timestamp_ntz")).otherwise(F.col("published_at"))).withColumn(
        "attempts", F.col("attempts") + F.when(F.col("ok"), 0).otherwise(1))
    outbox.write(moved.select(*now.columns), version)
    return now.count()


def relay_outbox(
        rows: DataFrame, outbox: KeyedTable, publish: Callable[[DataFrame], DataFrame], checkpoint: str, batch_size: int = 100, max_attempts: int = 5, lanes: int = 1) -> StreamingQuery:
    """Takes in each micro-batch of outbox rows, then drains until nothing is pending. A batch that runs again takes in nothing twice."""

    def each(df: DataFrame, batch: int) -> None:
        take_in(outbox, df)
        while drain(outbox, publish, batch_size, max_attempts, lanes):
            pass

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead(outbox: KeyedTable, max_attempts: int = 5) -> DataFrame:
    """Rows that were tried max_attempts times in vain."""
    return dead_letters(outbox.read(), max_attempts)
