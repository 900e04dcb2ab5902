"""Streams: texts by file, running word counts, encoding by micro-batch, and one file an epoch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.functions import text as X

__all__ = ["epochs", "files_stream", "loss_observer", "running_counts", "start_memory", "windowed_counts", "write_batches"]


def files_stream(spark: SparkSession, path: str, schema: str, sep: str = "\t", files_per_batch: int = 1) -> DataFrame:
    """Delimited files as they come, so many a micro-batch."""
    return spark.readStream.schema(schema).option("sep", sep).option("header", True).option("escape", '"').option("maxFilesPerTrigger", files_per_batch).csv(path)


def running_counts(docs: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """word, label, freq so far: the stateful form of chunk-wise dictionaries."""
    words = docs.select(F.explode(F.split(text, " +")).alias("word"), F.col(label).alias("label"))
    return words.where(F.char_length("word") <= X.MAX_WORD_SIZE).groupBy("word", "label").agg(F.count(F.lit(1)).alias("freq"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by event-time window and key; events later than `late` are dropped and their state with them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")


def start_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Run what there is into a table in memory (tests and small reports)."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()


def write_batches(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Transform each micro-batch and write it as Parquet under its number, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def epochs(spark: SparkSession, paths: list[str], read: Callable[[str], DataFrame], seed: int = 42) -> Iterator[DataFrame]:
    """One file a time, in an order that the seed decides."""
    order = spark.createDataFrame([(p,) for p in paths], "path string").orderBy(F.xxhash64("path", F.lit(seed)), "path")
    for row in order.collect():  # paths only
        yield read(row.path)


def loss_observer(df: DataFrame, name: str, loss: str = "loss", size: str = "n") -> DataFrame:
    """Record the weighted mean loss of each batch as an observed metric."""
    return df.observe(name, (F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("loss"), F.sum(size).alias("rows"))
