"""How far running projections are behind the log, from the progress that their queries report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from .tables import KeyedTable

_DDL = "projection string, batch long, processed long, at string"


class ProjectionHealth(StreamingQueryListener):
    """Counts, by query name, the events that each projection has read; add it with spark.streams.addListener before queries start.

    A batch counts once, also if it runs again. save writes the counts to a keyed table, from which a new listener goes on.
    """

    def __init__(self, table: KeyedTable | None = None):
        self.table = table
        self.seen: dict[str, tuple[int, int, str]] = {}
        if table is not None and table.version() >= 0:
            self.seen = {r.projection: (r.batch, r.processed, r.at) for r in table.read().collect()}  # one row a projection

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        if event.name:
            self.seen.setdefault(event.name, (-1, 0, event.timestamp))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if p.name:
            batch, processed, _ = self.seen.get(p.name, (-1, 0, ""))
            new = p.batchId > batch
            self.seen[p.name] = (max(batch, p.batchId), processed + (p.numInputRows if new else 0), p.timestamp)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def save(self) -> None:
        if self.table is not None and self.seen:
            self.table.write(self.table.spark.createDataFrame([(k, *v) for k, v in self.seen.items()], _DDL), self.table.version() + 1)

    def report(self, log: DataFrame, projections: list[str]) -> DataFrame:
        """projection, batch, processed, at, head (events of log) and lag (events) of each projection; one that has never run has processed nothing."""
        spark = log.sparkSession
        rows = [(n, *self.seen.get(n, (-1, 0, None))) for n in projections]
        head = log.agg(F.count("*").alias("head"))  # one row
        return spark.createDataFrame(rows, _DDL).crossJoin(head).withColumn("lag", F.greatest(F.col("head") - F.col("processed"), F.lit(0)))
