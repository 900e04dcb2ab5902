"""Recorders: what streams observe of each batch, kept as a table."""

from __future__ import annotations

import threading
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

SCHEMA = "name string, batch long, metric string, value double"


def feature_losses(df: DataFrame, name: str, losses: dict[str, str], size: str = "n") -> DataFrame:
    """Observe each feature's mean loss of a batch, weighted by size, and their total. losses: columns by feature."""
    mean = {f: F.sum(F.col(c) * F.col(size)) / F.sum(size) for f, c in losses.items()}
    total = sum(list(mean.values())[1:], list(mean.values())[0])
    return df.observe(name, *[m.alias(f"{f} loss") for f, m in mean.items()], total.alias("total loss"), F.sum(size).cast("double").alias("rows"))


class Recorder(StreamingQueryListener):
    """Appends the metrics that streams of this session observe (streams.loss_observer, feature_losses) to a Parquet table: a row for each name,
    batch and metric. Use it as a context manager around the query; table() is what has been recorded.

    Batches without metrics leave no row. A batch that was run twice, after a failure, is there twice; table() takes the last.
    """

    def __init__(self, spark: SparkSession, path: str, names: list[str] | None = None):
        self.spark, self.path, self.names = spark, path, names
        self.lock = threading.Lock()
        self.written = 0

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        rows = []
        for name, metrics in event.progress.observedMetrics.items():
            if self.names is None or name in self.names:
                rows += [(name, event.progress.batchId, k, float(v)) for k, v in metrics.asDict().items() if isinstance(v, (int, float))]
        if rows:
            with self.lock:
                at = f"{self.path}/part={self.written}"
                self.written += 1
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(at)

    def __enter__(self) -> Recorder:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.finish()

    def finish(self) -> None:
        """Wait for what is still on its way, then record no more."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)

    def table(self) -> DataFrame:
        """name, batch, metric, value."""
        if not self.written:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        return rows.groupBy("name", "batch", "metric").agg(F.max_by("value", "part").alias("value"))
