"""Substring deduplication: Rabin-Karp hashes of every window of a fixed number of words, counted in Spark.

1. ``pack``: each task rolls the hash over the words of a bounded block of documents. Within the block a window keeps only its
   smallest document (a map-side combine); the others are known copies at once. What is left is dealt to buckets by the hash's top
   bits, as sorted, gap-coded arrays, so that a window costs a few bytes in the shuffle.
2. ``count``: each bucket sorts its windows and finds those with several documents: all but the smallest are copies. However often
   a window occurs, a block sends it once, so no window makes a bucket large.
3. ``cut``: copies meet their documents again (dealt by document), covered words merge into maximal intervals and go.

Windows are judged on the input. Words are runs of anything but space and the control characters 9 to 13. Null and empty texts have no
words; very long texts are processed whole. An empty table gives an empty result. Rows without a doc_id neither remove nor lose words. Rows of the same doc_id don't remove each other's words (no smaller id), and
each loses what a smaller id has. Columns other than the named ones are not carried.

A window is known by 80 bits: the hash that deals it, and 16 bits of a second one of another base (each byte more costs a quarter of the input in
the shuffle). Among n different windows some n * n / 2**81 pairs agree (for 10**11 windows, one in two hundred and fifty; for 10**13, forty). A reply to a document names a window by both mixed to 64 bits, which
only that document's own windows are compared with.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, blocks, lean, mix, rolling, squeeze, swell, texts, trimmed

BLOCK_BYTES = 12 << 20
CHECK_BASE = 0xC2B2AE3D27D4EB4F
#: Windows a bucket should get, and text bytes a group of documents should get.
BUCKET_WINDOWS, GROUP_BYTES = 1 << 21, 8 << 20
PACKED = "bucket long, kind int, payload binary"
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept string"


def both_hashes(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window: the hash, and the bits that tell apart windows which agree in it."""
    return rolling(words, width), (rolling(words, width, CHECK_BASE) >> np.uint64(48)).astype(np.uint16)


def name(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Windows as a reply names them."""
    return hashes ^ mix(checks.astype(np.uint64) + np.uint64(1))


def in_order(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order in which equal windows are neighbours and keep theirs, starts of different windows in it)"""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    same = h[1:] == h[:-1]
    if (same & (c[1:] != c[:-1])).any():  # different windows of one hash
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
        same = h[1:] == h[:-1]
    return order, np.flatnonzero(np.concatenate(([True], ~same | (c[1:] != c[:-1])))[: len(h)])


def encode(hashes: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> bytes:
    """(sorted hashes, index of each one's document, ascending document ids) as bytes."""
    parts = [squeeze(np.diff(hashes, prepend=np.uint64(0))), squeeze(docs.astype(np.uint32)), squeeze(np.diff(ids.view(np.uint64), prepend=np.uint64(0)))]
    return struct.pack("<2I", len(parts[0]), len(parts[1])) + b"".join(parts)


def decode(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document id of each)"""
    x, y = struct.unpack_from("<2I", b)
    ids = np.cumsum(swell(b[8 + x + y :], np.uint64)).view(np.int64)
    return np.cumsum(swell(b[8 : 8 + x], np.uint64)), ids[swell(b[8 + x : 8 + x + y], np.uint32)]


def group_of(doc_id: int, groups: int) -> int:
    """As Spark's pmod(crc32(cast(doc_id as string)), groups)."""
    return zlib.crc32(str(doc_id).encode()) % groups


def replies(hashes: np.ndarray, docs: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Copies (a window's name, the document that loses it), packed by group of documents."""
    if not len(hashes):
        return
    ids, code = np.unique(docs, return_inverse=True)
    to = np.array([group_of(x, groups) for x in ids.tolist()], np.int64)[code]
    order = np.lexsort((hashes, to))
    to, hashes, code = to[order], hashes[order], code[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)], strict=True):
        own, mine = np.unique(code[a:b], return_inverse=True)
        yield int(to[a]), encode(hashes[a:b], mine, ids[own])


def pack(docs: DataFrame, width: int, buckets: int, groups: int) -> DataFrame:
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for block in blocks(batches, BLOCK_BYTES):
            id_array = np.array(block.column("doc_id").to_pylist(), np.int64)
            order = np.argsort(id_array, kind="stable")
            rows = texts(block.column("text"))
            ids, code = np.unique(id_array[order], return_inverse=True)
            parts = [memo.of(rows[i].split()) for i in order.tolist()]
            row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
            h, check = both_hashes(np.concatenate(parts) if parts else np.empty(0, np.uint64), width)
            del rows, block, parts
            inside = row[: len(h)] == row[len(row) - len(h) :]
            h, check, doc = h[inside], check[inside], code[row[: len(inside)][inside]]
            if not len(h):
                continue
            order, first = in_order(h, check)  # rows go by ascending id, and so do equal windows
            h, check, doc = h[order], check[order], doc[order]
            copy = doc > np.repeat(doc[first], np.diff(np.append(first, len(h))))
            out = [(g % buckets, 1, struct.pack("<q", g) + b) for g, b in replies(name(h[copy], check[copy]), ids[doc[copy]], groups)]
            h, check, doc = h[first], check[first], doc[first]
            to = (h >> shift).astype(np.int64) if shift is not None else np.zeros(len(h), np.int64)
            cuts = np.flatnonzero(np.diff(to)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)], strict=True):
                own, mine = np.unique(doc[a:b], return_inverse=True)
                checked = squeeze(check[a:b])
                out.append((int(to[a]), 0, struct.pack("<I", len(checked)) + checked + encode(h[a:b], mine, ids[own])))
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[a : a + 256], strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "payload"])

    return docs.where("doc_id is not null").mapInArrow(trimmed(run), PACKED)


def count(packed: DataFrame, groups: int) -> DataFrame:
    """Copies by group of documents: rows of (grp, payload)."""

    def run(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        out = [(struct.unpack_from("<q", p)[0], p[8:]) for k, p in zip(kinds, payloads, strict=True) if k == 1]
        parts = [p for k, p in zip(kinds, payloads, strict=True) if k == 0]
        del kinds, payloads
        if len(parts) > 1:
            sizes = [4 + struct.unpack_from("<I", p)[0] for p in parts]
            check = np.concatenate([swell(p[4:n], np.uint16) for p, n in zip(parts, sizes, strict=True)])
            h, doc = (np.concatenate(x) for x in zip(*(decode(p[n:]) for p, n in zip(parts, sizes, strict=True)), strict=True))
            del parts
            order, start = in_order(h, check)
            size = np.diff(np.append(start, len(h)))
            order = order[np.repeat(size > 1, size)]
            h, check, doc, size = h[order], check[order], doc[order], size[size > 1]
            if len(h):
                lowest = np.repeat(np.minimum.reduceat(doc, np.cumsum(size) - size), size)
                copy = doc > lowest
                out += replies(name(h[copy], check[copy]), doc[copy], groups)
        return pa.table([pa.array([g for g, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], ["grp", "payload"])

    return packed.groupBy("bucket").applyInArrow(run, "grp long, payload binary")


def cut(docs: DataFrame, copies: DataFrame, width: int, groups: int) -> DataFrame:
    """Remove covered words: RESULT rows, one per row of docs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lost: dict[int, list[np.ndarray]] = {}
        for p in right.column("payload").to_pylist():
            h, doc = decode(p)
            order = np.argsort(doc, kind="stable")
            own, at = np.unique(doc[order], return_index=True)
            for d, part in zip(own.tolist(), np.split(h[order], at[1:]), strict=True):
                lost.setdefault(d, []).append(part)
        memo, out = WordHash(), []
        for d, text in zip(left.column("doc_id").to_pylist(), texts(left.column("text")), strict=True):
            w = text.split()
            spans = np.empty((0, 2), np.int64)
            kept = w
            if d in lost and len(w) >= width:
                hit = np.isin(name(*both_hashes(memo.of(w), width)), np.concatenate(lost[d]))
                edge = np.zeros(len(w) + 1, np.int32)
                edge[: len(hit)] += hit
                edge[width : width + len(hit)] -= hit
                gone = np.cumsum(edge[:-1]) > 0
                flips = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                spans = flips.reshape(-1, 2)
                kept = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
            out.append((d, len(w), len(w) - len(kept), [{"start": a, "stop": b} for a, b in spans.tolist()], b" ".join(kept).decode()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string())
        return pa.table([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    own = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    keyed = docs.withColumn("grp", F.pmod(F.coalesce(own, F.monotonically_increasing_id()), F.lit(groups)))  # any group does for a row without an id
    return keyed.groupBy("grp").cogroup(copies.groupBy("grp")).applyInArrow(run, RESULT)


def substring_dedup(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, the removed word intervals and the kept words (joined by one space) of every row."""
    lean(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(1, -(-size // (6 * BUCKET_WINDOWS))), max(1, -(-size // GROUP_BYTES))
    return cut(source, count(pack(source, width, buckets, groups), groups), width, groups)
