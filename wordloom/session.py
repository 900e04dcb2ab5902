"""Sessions: settings that the plans are made for, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; what the cluster sets otherwise is left as it is."""
    builder = SparkSession.builder.appName("wordloom").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Only on one machine (a local master) a temporary one stands in for it."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        at = context.getConf().get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="wordloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written as Parquet in the shared folder and read back, so that no later filter is drawn below it."""
    at = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


#: Bytes of an Arrow batch between the JVM and Python, at most (a longer single row still goes as one).
BATCH_BYTES = 4 << 20


def lean(spark: SparkSession) -> None:
    """Let Arrow batches have BATCH_BYTES at most in this session: the default of 64 MB costs each task several such buffers in the executor and
    in its Python worker, outside the heap. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).strip().lower())
    have = int(size[1]) << (10 * " kmgt".index(size[2] or " ")) if size else -1
    if have <= 0 or have > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
