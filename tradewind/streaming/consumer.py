"""A consumer of micro-batches whose effects happen once, though batches may come again.

A batch that was under way when its query died comes again with the same number and the same
records. Each query therefore keeps its batch's number in the commit that makes the batch's rows
visible: a batch whose number is committed is skipped, one that died before its commit has left
a folder that nobody reads. Records that fail go to a table of their own, in the same way, with
what they failed of; counts of both are in the commits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tradewind.session import landed
from tradewind.sources.tables import Table


class Consumer:
    """Rows and failures of a stream in two tables below path.

    process gives a batch's rows with a column failures (an array; null or empty: the record is
    good). A null value there counts as no failure.
    """

    def __init__(self, spark: SparkSession, path: str, process: Callable[[DataFrame], DataFrame], failures: str = "failures"):
        self.good, self.bad = Table(spark, f"{path}/rows"), Table(spark, f"{path}/failed")
        self.process, self.failures = process, failures

    def last_batch(self, table: Table) -> int:
        return table.current()[1]["notes"].get("batch", -1)

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; the failures first, so that a committed batch is whole."""
        if number <= self.last_batch(self.good):
            return
        done = landed(self.process(batch), "batch")  # both sides from one reading
        fails = F.coalesce(F.size(F.array_compact(F.coalesce(self.failures, F.array().cast("array<string>")))), F.lit(0)) > 0
        sides = [(self.bad, done.filter(fails)), (self.good, done.filter(~fails).drop(self.failures))]
        counts = done.agg(F.count_if(fails).alias("failed"), F.count_if(~fails).alias("done")).first()
        for table, rows in sides:
            if number > self.last_batch(table):
                before = table.current()[1]["notes"]
                table.append(rows, {"batch": number, "failed": counts.failed, "done": counts.done, "failed_before": before.get("failed_before", 0) + before.get("failed", 0), "done_before": before.get("done_before", 0) + before.get("done", 0)})

    def start(self, stream: DataFrame, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
        """The stream's query: all that is there, or continuous with an interval."""
        w = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=continuous) if continuous else w.trigger(availableNow=True)).start()

    def state(self) -> dict:
        """Batches that were taken, and records done and failed so far."""
        n = self.good.current()[1]["notes"]
        return {"batch": n.get("batch", -1), "done": n.get("done_before", 0) + n.get("done", 0), "failed": n.get("failed_before", 0) + n.get("failed", 0)}
