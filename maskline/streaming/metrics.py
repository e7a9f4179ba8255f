"""What streams count of themselves, as a table: rows dropped as late by each operator, and observed metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = "query string, run string, batch long, at string, kind string, name string, metric string, value double"


class StreamCounts(StreamingQueryListener):
    """Appends to a Parquet folder, once a batch that has some: rows dropped by the watermark (kind `late`, name: the stateful
    operator and its place), and metrics named by observe() (kind `observed`). Register it with spark.streams.addListener().

    Batches without late rows or metrics write nothing; a row that a metric leaves null has no value."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        head = (p.name or str(p.id), str(p.runId), p.batchId, p.timestamp)
        rows = [(*head, "late", f"{i} {op.operatorName}", "dropped", float(op.numRowsDroppedByWatermark)) for i, op in enumerate(p.stateOperators) if op.numRowsDroppedByWatermark > 0]
        for name, found in p.observedMetrics.items():
            rows += [(*head, "observed", name, k, None if v is None else float(v)) for k, v in found.asDict().items()]
        if rows:
            self.spark.createDataFrame(rows, COUNTS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def totals(counts: DataFrame) -> DataFrame:
    """query, kind, name, metric, value: the sums over a table of StreamCounts' batches."""
    from pyspark.sql import functions as F

    return counts.groupBy("query", "kind", "name", "metric").agg(F.sum("value").alias("value"))
