"""Stateful streams: sentences whose lines come in several batches, and running counts kept as a table in a shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wordloom.session import ensure_checkpoint_dir

__all__ = ["MergedCounts", "SENTENCE", "open_sentences", "sentence_stream", "state_store"]

#: Rows of finished sentences.
SENTENCE = "file {0}, words array<string>, tags array<string>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that arbitrary state needs, for queries started inside; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Sentences(StatefulProcessor):
    """Keeps the words and tags of the sentence that a file's lines so far leave open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "words array<string>, tags array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else ([], [])
        words, tags = [*held[0]], [*held[1]]
        done: list[tuple[list[str], list[str]]] = []
        batch = pd.concat(rows)
        for line in batch.sort_values("pos", kind="stable")["value"]:
            line = (line or "").strip()
            if not line or line.startswith("#"):
                if words:
                    done.append((words, tags))
                    words, tags = [], []
                continue
            parts = line.split("\t")
            words.append(parts[1] if len(parts) > 1 else "")
            tags.append(parts[3] if len(parts) > 3 else "")
        if words:
            self.open.update((words, tags))
        elif self.open.exists():
            self.open.clear()
        if done:
            yield pd.DataFrame({"file": [key[0]] * len(done), "words": [w for w, _ in done], "tags": [t for _, t in done]})

    def close(self) -> None:
        pass


def sentence_stream(lines: DataFrame) -> DataFrame:
    """Sentences of annotated lines (value, file, pos) as their delimiter comes, in this batch or a later one; a file's lines have to come in the order
    of pos from batch to batch. Start the query within state_store(); what has no delimiter yet is in open_sentences."""
    kind = lines.schema["file"].dataType.simpleString()
    return lines.select("value", "file", "pos").groupBy("file").transformWithStateInPandas(_Sentences(), SENTENCE.format(kind), "Append", "None")


def open_sentences(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sentences that a stopped query has left open, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return state.select(F.col("key.file").alias("file"), F.col("value.words").alias("words"), F.col("value.tags").alias("tags"))


class MergedCounts:
    """Running counts as a table: each batch's changed counts are written under the batch's number, and every `every` batches merged with the
    base into a new one. A batch that runs again replaces itself; a reader takes each key's latest count."""

    def __init__(self, spark: SparkSession, keys: list[str], value: str, path: str | None = None, every: int = 20):
        self.spark, self.keys, self.value, self.every = spark, keys, value, every
        self.path = path or f"{ensure_checkpoint_dir(spark)}/counts-{uuid.uuid4().hex}"

    def _folders(self) -> list[tuple[int, str]]:
        """(number, path) of the base, which comes first with the number of the last batch in it, and of the batches after it."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if fs.exists(root.suffix(f"/{n}/_SUCCESS"))]
        bases = [int(n[5:]) for n in done if n.startswith("base=")]
        base = max(bases, default=-1)
        later = sorted(k for k in (int(n[6:]) for n in done if n.startswith("batch=")) if k > base)
        return [(base, f"{self.path}/base={base}")] * bool(bases) + [(k, f"{self.path}/batch={k}") for k in later]

    def _latest(self, folders: list[tuple[int, str]]) -> DataFrame | None:
        parts = [self.spark.read.parquet(p).withColumn("__at", F.lit(k)) for k, p in folders]
        if not parts:
            return None
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy(*self.keys).agg(F.max_by(self.value, "__at").alias(self.value))

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch, in update mode."""
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        folders = self._folders()
        if len(folders) > self.every:
            self._latest(folders).write.mode("overwrite").parquet(f"{self.path}/base={folders[-1][0]}")

    def read(self) -> DataFrame:
        """The counts so far."""
        latest = self._latest(self._folders())
        if latest is None:
            raise ValueError(f"no batch has been written to {self.path}")
        return latest

    def start(self, counts: DataFrame, checkpoint: str) -> StreamingQuery:
        """Count what there is."""
        return counts.writeStream.foreachBatch(self.write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
