"""N-gram Jaccard join by vertical partitioning.

All n-grams have a global order (frequent ones last, by a fixed-size count sketch; equal counts by hash), which is cut into fragments at pivots,
so that each holds about as many occurrences.

1. Records with equal sets become one class.
2. A class lists its rarest n-grams in that order, as many as a partner of the asked similarity must meet (prefix filter), with their places in
   it; places and set sizes bound the overlap of a pair that meets there.
3. Pairs that may link (see ``linking``) are counted fragment by fragment: each fragment's n-grams meet in a join of their own, which gives
   the partial overlaps; their sum per pair is exact.
4. Links make components by distributed union-find.

A document with fewer words than the n-gram has its whole word sequence as its one n-gram; without words it has none and links with
nothing. Null texts count as empty; very long texts are read whole, a block of their own each. Rows without a doc_id get the component of equal
or linked texts that have one, else null. Rows of the same doc_id are one node: the links of each hold for both. An empty table gives an empty
result. Columns other than the named ones are not carried, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER_TO_LOWER, WordHash, blocks, lean, materialise, mix, settle, small_join, texts, trimmed, window_hashes
from .linking import components, parity_sketch, screened

BLOCK_BYTES = 2 << 20
#: Counters of the order's sketch: 4 MB, whatever the corpus.
SKETCH = 1 << 20
SKETCH_SLICES = 16
#: Task sketches that one task adds up, and steps until one is left: with three, a million tasks' sketches.
FAN_IN, LEVELS = 128, 3
#: 64-bit words of a record's parity sketch, and fragments that the order is cut into.
PARITY_WORDS, FRAGMENTS = 16, 4


def shingle_sets(rows: list[bytes], memo: WordHash, width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    h, row, n = window_hashes((x.translate(UPPER_TO_LOWER).split() for x in rows), memo, width)
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    out = []
    for i, words in enumerate(n.tolist()):
        if words >= width:
            out.append(np.unique(h[ends[i] : ends[i + 1]]))
        elif words:
            w = rows[i].translate(UPPER_TO_LOWER).split()
            out.append(np.array([memo.of([b" ".join(w) + b"\n%d" % words])[0]], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_hash(h: np.ndarray) -> tuple[int, int]:
    one = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    return int(h.sum(dtype=np.uint64).view(np.int64)), int(one.sum(dtype=np.uint64).view(np.int64))


def order_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How often n-grams occur in documents, by hash modulo SKETCH: its size never follows the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = WordHash(), np.zeros(SKETCH, np.int64)
        for block in blocks(batches, BLOCK_BYTES):
            sets = shingle_sets(texts(block.column("text")), memo, width)
            if sets:
                total += np.bincount(np.concatenate(sets).astype(np.int64) & (SKETCH - 1), minlength=SKETCH)
        parts = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(SKETCH_SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // SKETCH_SLICES, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint32)
        total = pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())
        return pa.table([table.column("slice").slice(0, 1).combine_chunks(), table.column("part").slice(0, 1).combine_chunks(), total], ["slice", "part", "counts"])

    # a tree of LEVELS steps: FAN_IN sketches of a slice meet in a task, then their sums do, and last what is left
    parts = docs.select("text").mapInArrow(trimmed(run), "slice int, counts binary").withColumn("part", F.spark_partition_id())
    for level in range(LEVELS):
        part = F.floor(F.col("part") / FAN_IN).cast("int") if level + 1 < LEVELS else F.lit(0)
        parts = parts.withColumn("part", part).groupBy("slice", "part").applyInArrow(add, "slice int, part int, counts binary")
    slices = {r.slice: r.counts for r in parts.select("slice", "counts").collect()}  # SKETCH counters
    if not slices:
        return np.zeros(SKETCH, np.uint32)
    return np.concatenate([np.frombuffer(slices[k], np.uint32) for k in range(SKETCH_SLICES)])


def places(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys of n-grams in the global order: the count, then the hash's first bits."""
    return (counts[h & np.uint64(SKETCH - 1)].astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))


def pivots(counts: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Keys at which the order is cut, so that fragments have about as many occurrences (within a count, hashes spread evenly)."""
    c = np.sort(counts[counts > 0])
    if not len(c):
        return np.zeros(fragments - 1, np.uint64)
    upto = np.cumsum(c, dtype=np.float64)
    value, first, size = np.unique(c, return_index=True, return_counts=True)
    out = []
    for f in range(1, fragments):
        k = min(int(np.searchsorted(upto, upto[-1] * f / fragments)), len(c) - 1)
        j = int(np.searchsorted(value, c[k]))
        out.append((int(value[j]) << 32) | int((k - first[j]) / size[j] * (1 << 32)))
    return np.array(out, np.uint64)


def signatures(docs: DataFrame, width: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """doc_id, n (set size), c1 and c2 (hash of the set), prefix (rarest n-grams in order), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for block in blocks(batches, BLOCK_BYTES):
            sets = shingle_sets(texts(block.column("text")), memo, width)
            prefixes, sketches, classes = [], [], []
            for h in sets:
                n = len(h)
                keep = n - -(-num * n // den) + 1 if n else 0
                order = np.argsort(places(h, counts), kind="stable")[:keep]
                prefixes.append(h[order].view(np.int64))
                sketches.append(parity_sketch(h, PARITY_WORDS))
                classes.append(class_hash(h))
            yield from pa.table(
                [
                    block.column("doc_id"),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([c for c, _ in classes], pa.int64()),
                    pa.array([c for _, c in classes], pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "c1", "c2", "prefix", "sketch"],
            ).to_batches()

    return docs.mapInArrow(trimmed(run), "doc_id long, n long, c1 long, c2 long, prefix array<long>, sketch array<long>")


def segments(docs: DataFrame, width: int, counts: np.ndarray) -> DataFrame:
    """node, fragment, grams of the documents (doc_id, c1, text) whose set is the one asked for: fragments are cut from the global order."""
    at = pivots(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for block in blocks(batches, BLOCK_BYTES):
            ids, wanted = block.column("doc_id").to_pylist(), block.column("c1").to_pylist()
            nodes, parts, grams = [], [], []
            for node, c1, h in zip(ids, wanted, shingle_sets(texts(block.column("text")), memo, width), strict=True):
                if class_hash(h)[0] == c1:
                    which = np.searchsorted(at, places(h, counts), "right")
                    for f in range(FRAGMENTS):
                        nodes.append(node)
                        parts.append(f)
                        grams.append(h[which == f].view(np.int64))
            yield from pa.table([pa.array(nodes, pa.int64()), pa.array(parts, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["node", "fragment", "grams"]).to_batches()

    return docs.mapInArrow(trimmed(run), "node long, fragment int, grams array<long>").dropDuplicates(["node", "fragment"])


def ngram_jaccard(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link where den * intersection >= num * union."""
    lean(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return settle(docs.sparkSession, "jaccard", lambda: _joined(source, width, num, den))


def _joined(source: DataFrame, width: int, num: int, den: int) -> DataFrame:
    counts = order_sketch(source, width)
    sig = materialise(signatures(source, width, num, den, counts), "signatures")
    classes = sig.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")).where("node is not null")
    classes = materialise(classes, "classes")
    listed = classes.select(F.posexplode("prefix").alias("pos", "key"), "node", "n")
    shared = listed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    members = materialise(listed.join(shared, "key", "left_semi"), "members")
    records = classes.select("node", "n", "sketch")
    both = num + den

    def fits(x: str, y: str) -> str:
        return f"least({x}.n - {x}.pos, {y}.n - {y}.pos) * {both} >= {num} * ({x}.n + {y}.n)"

    def verify(every: DataFrame) -> DataFrame:
        pairs = materialise(screened(every, records, num, den, PARITY_WORDS), "pairs")
        ids = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(classes.select("node", "n", "c1"), "node"), "nodes")
        rows = ids.count()
        wanted = ids.select(F.col("node").alias("doc_id"), "c1")
        parts = materialise(segments(small_join(source, wanted, "doc_id", rows=rows).select("doc_id", "c1", "text"), width, counts), "segments")
        partial = []
        for f in range(FRAGMENTS):
            one = parts.where(F.col("fragment") == f).select("node", "grams")
            met = pairs.join(one.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(one.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
            partial.append(met.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("partial")))
        overlap = reduce(DataFrame.union, partial).groupBy("a", "b").agg(F.sum("partial").alias("common"))
        for side in "ab":
            overlap = overlap.join(ids.select(F.col("node").alias(side), F.col("n").alias(f"n{side}")), side)
        return overlap.where(f"common * {both} >= {num} * (na + nb)").select("a", "b")

    found = components(members, records, fits, verify, num, den, PARITY_WORDS)
    named = classes.join(found, "node", "left").select("c1", "c2", "n", F.coalesce("component", "node").alias("component_id"))
    out = sig.select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
