"""Helpers that the training-data operators share: materialised steps, word hashing in Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.session import lean  # noqa: F401  (common.lean)

#: Words memorised by a Python worker at most (hash or count of a word); the memo starts anew beyond it.
MEMO_LIMIT = 1 << 18
#: Ids that may be broadcast: 8 bytes each, so 16 MB of keys at the very most. Beyond it joins shuffle.
BROADCAST_IDS = 1 << 21

UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only on one machine (a local master) a temporary one stands in for it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            at = jvm_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            at = tempfile.mkdtemp(prefix="wordloom-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return at.rstrip("/")


#: Paths of the tables that the innermost settle() has written so far.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wordloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation."""
    done, path = _write(df, label)
    scratch = _SCRATCH.get()
    if scratch is not None:
        scratch.append(path)
    return done


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settle(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Materialise what build() returns, then delete all tables that were materialised on the way to it."""
    return settled(spark, label, build)[0]


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """As settle, with the path of the table."""
    mine: list[str] = []
    outer = _SCRATCH.set(mine)
    try:
        done, path = _write(build(), label)
    finally:
        _SCRATCH.reset(outer)
        for p in mine:
            delete(spark, p)
    scratch = _SCRATCH.get()
    if scratch is not None:
        scratch.append(path)
    return done, path


def small_join(big: DataFrame, ids: DataFrame, on: str | list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a broadcast only where ids has been counted and is within BROADCAST_IDS, else as Spark plans it."""
    rows = ids.count() if rows is None else rows
    return big.join(F.broadcast(ids) if rows <= BROADCAST_IDS else ids, on, how)


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, with underscores added until no taken name equals it (names differ by more than case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(run: Run) -> Run:
    """run, and give free memory back to the system at its end: Python workers are reused, and the next task's needs differ."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # not with every C library

    return inner


#: Values of a label whose shares are written into the plan; beyond it the rows are joined with the shares.
MOST_GROUPS = 4096


def bounded_sample(rows: DataFrame, by: str, text: str, salt: str, most: int, most_bytes: int) -> DataFrame:
    """(by, text) of at most `most` different rows for each value of `by`, and of not much more than most_bytes of text, in the order of a hash of the
    whole row. Rows first pass a share by hash that leaves some four times as many different ones, so that little is sorted; a value with
    no more different rows than that passes whole, however often they are repeated."""
    order = F.xxhash64(*rows.columns, F.lit(salt))
    hashed = rows.withColumn("__order", order)
    sizes = hashed.groupBy(by).agg(F.approx_count_distinct("__order").cast("double").alias("__n"))  # sketches, a few KB a value
    shares = sizes.select(F.col(by).alias("__by"), F.least(F.lit(1.0), F.lit(4.0 * most) / F.greatest("__n", F.lit(1.0))).alias("__share"))
    known = shares.limit(MOST_GROUPS + 1).collect()
    if not known:
        return rows.select(by, text)
    if len(known) <= MOST_GROUPS:
        share = F.element_at(F.create_map(*[F.lit(x) for r in sorted(known, key=lambda r: str(r["__by"])) for x in (r["__by"], r["__share"])]), F.col(by))
    else:
        hashed, share = hashed.join(shares, F.col(by) == F.col("__by")), F.col("__share")
    near = hashed.where(F.col("__order") / 2.0**64 + 0.5 <= share)
    once = near.groupBy(by, "__order").agg(F.first(text).alias(text))  # however often a row is repeated
    up = Window.partitionBy(by).orderBy("__order")
    ranked = once.withColumn("__k", F.row_number().over(up)).withColumn("__upto", F.sum(F.octet_length(text)).over(up) - F.octet_length(text))
    return ranked.where((F.col("__k") <= most) & (F.col("__upto") < most_bytes)).select(by, text)


class WordHash(dict):
    """64-bit hash of a word's bytes, remembered up to MEMO_LIMIT words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_LIMIT:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(batches: Iterable[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.Table]:
    """Runs of whole rows of about limit bytes of text: never less than one row, never more than limit but for a single longer row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                if i > at:
                    held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, i
            size += int(n)
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def squeeze(x: np.ndarray) -> bytes:
    """An integer array as byte planes, so that small numbers leave planes of zeros, which compress away."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def swell(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
RK_BASE = 0x9E3779B97F4A7C15
#: Windows that rolling() hashes at once.
ROLL_STEP = 1 << 16


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd, so it has an inverse)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _POWERS[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def rolling(hashes: np.ndarray, width: int, base: int = RK_BASE) -> np.ndarray:
    """Rabin-Karp hash of every window of width elements, from prefix sums modulo 2**64; element i is the window that starts at i.

    Works in steps of ROLL_STEP windows: a hash doesn't depend on the place of its window, so the table of powers need not grow with the input.
    """
    n = len(hashes)
    out = np.empty(max(0, n - width + 1), np.uint64)
    for at in range(0, len(out), ROLL_STEP):
        part = hashes[at : at + ROLL_STEP + width - 1]
        up, down = _powers(len(part), base)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * down, out=prefix[1:])
        out[at : at + ROLL_STEP] = mix((prefix[width:] - prefix[:-width]) * up[: len(part) - width + 1])
    return out


def window_hashes(rows: Iterable[list[bytes]], memo: WordHash, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row number of every window of width words that lies within one row, rows in order; and the words of each row.

    Rows can come from a generator: only their hashes are held.
    """
    parts = [memo.of(x) for x in rows]
    n = np.array([len(x) for x in parts], np.int64)
    h = rolling(np.concatenate(parts) if parts else np.empty(0, np.uint64), width)
    row = np.repeat(np.arange(len(parts), dtype=np.int32), n)
    inside = row[: len(h)] == row[width - 1 :] if len(h) else np.empty(0, bool)
    return h[inside], row[: len(h)][inside], n


def stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: the components are found."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return node.where("up > 1 or (up = 1 and least = 0)").select(F.lit(1)).limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Distributed union-find by alternating large-star and small-star steps.

    edges has long columns u and v in any direction; loops and repeats are harmless. Returns (node, component), where component is
    the smallest node reachable; nodes without a link to another do not appear. Each round ends in a written table; rounds go on until only stars are
    left, which takes about the square of the logarithm of the nodes at most.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialise(small.where("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
