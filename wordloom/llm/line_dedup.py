"""Fuzzy line deduplication by MinHash.

1. ``pack``: each task cuts a bounded block of rows into lines, keeps the first place of each distinct line (the others are known copies at
   once) and folds a one-permutation MinHash signature of its character shingles into bands. Places are dealt to buckets by the line's hash,
   bands by the band's. A band that several lines of a block share goes to its bucket once, however many they are.
2. ``regroup``: each bucket finds the copies of lines across blocks, and the bands that lines of several blocks share.
3. Lines that share a band are candidates. Their texts are fetched once and dealt out by band (``linked``): every pair of a band is held
   against the exact Jaccard similarity of the shingle sets inside the band's task, and only links that make its components leave the task, no
   more than it has lines. A frequent band is cut into slices, two of which meet in a group. With 9 bands of 4 values a pair of similarity 0.8 is
   found with a probability of 0.99, one of 0.85 with 0.998.
4. Distributed union-find joins links; of each component, the first line by (doc_id, line number, hash of the row) stays and all others go.

Lines are cut at line feeds and compared without white space at their ends. Lines without a word stay and are not counted. A line shorter
than the shingle is one shingle. A line is known by 96 bits of its hash, a row by a 64-bit hash of its id and text, so that rows of one doc_id
are told apart; a line is only removed from a row where its own hash agrees. Should two lines of the corpus agree in the 64 bits that bands
carry, only one of them is compared with similar lines; copies of both go.

Null and empty texts have no lines and stay as they are. Very long texts and lines are processed whole; a row longer than a block is a block of
its own. Rows without a doc_id keep all lines and remove none. Repeated rows (equal id and text) keep and lose the same lines. An empty table gives
an empty result. All columns of the input are carried; n_lines and n_removed are added (replacing columns of these names).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, connected_components, lean, materialise, mix, rolling, settle, small_join, squeeze, swell, texts, trimmed

BLOCK_BYTES = 2 << 20
#: Bytes of text for each bucket of line places and of bands, about.
LINE_BUCKET, BAND_BUCKET = 64 << 20, 16 << 20
SHINGLE, BAND_ROWS, BANDS = 7, 4, 9
BINS = BAND_ROWS * BANDS
#: 64-bit words of a candidate's parity sketch.
PARITY_WORDS = 16
#: Candidate lines whose places may be broadcast: up to 16 bytes each with their rows' keys.
BROADCAST_LINES = 1 << 19
#: Elements that a verification sorts at once.
SORTED = 1 << 20
#: Lines and bytes of text of a slice of a frequent band, about; lines of a group whose pairs are listed; shingles that are counted at once.
SLICE, SLICE_BYTES, FEW, COLUMNS = 1 << 9, 4 << 20, 8, 1 << 10
#: Of a bin without a shingle.
EMPTY = np.uint32(0xFFFFFFFF)
SPACES = b" \t\n\x0b\x0c\r"
#: Kinds of packed and regrouped rows: first place of a line, band, copy, member of a shared band.
FIRST, BAND, COPY, MEMBER = range(4)
REGROUPED = "kind int, a long, b long, c long, line int"


def lines_of(text: bytes) -> list[tuple[int, bytes]]:
    """(number, line without white space at its ends) of the lines with a word."""
    return [(i, x) for i, line in enumerate(text.split(b"\n")) if (x := line.strip(SPACES))]


def line_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits that name a line, 32 more that tell lines of one name apart)"""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.uint64).reshape(-1, 2)
    return both[:, 1].copy(), (both[:, 0] >> np.uint64(32)).astype(np.uint32)


def characters(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all lines, line number of each, length of each line)"""
    rows = [x.decode() for x in lines]
    length = np.fromiter(map(len, rows), np.int64, len(rows))
    codes = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    return codes, np.repeat(np.arange(len(rows), dtype=np.int32), length), length


def short_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, 32-bit hash) of every shingle, repeats included, of the lines that are no shorter than one; and all lines' lengths."""
    codes, row, length = characters(lines)
    n = max(0, len(codes) - SHINGLE + 1)
    h = np.zeros(n, np.uint32)
    for i in range(SHINGLE):
        h *= np.uint32(0x01000193)
        h += codes[i : i + n]
    within = row[:n] == row[SHINGLE - 1 :] if n else np.empty(0, bool)
    h = h[within]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return row[:n][within], h, length


def signatures(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(which lines have a signature, their BANDS band hashes): lines no shorter than a shingle; a shorter one is similar to its copies only."""
    owner, value, length = short_hashes(lines)
    rows = len(lines)
    least = np.full(rows * BINS, EMPTY, np.uint32)
    np.minimum.at(least, owner * np.int64(BINS) + (((value >> np.uint32(8)) * np.uint32(BINS)) >> np.uint32(24)), value)  # equal types: the fast loop
    least = least.reshape(-1, BINS)
    full, sig = least != EMPTY, least.astype(np.uint64)
    carry, far = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    for at in range(2 * BINS - 1, -1, -1):  # an empty bin takes the next full one's value, marked by the distance
        i = at % BINS
        carry = np.where(full[:, i], sig[:, i], carry)
        far = np.where(full[:, i], np.uint64(0), far + np.uint64(1))
        if at < BINS:
            sig[:, i] = carry + (far << np.uint64(32))
    has = np.flatnonzero(length >= SHINGLE)
    sig = sig[has]
    bands = np.zeros((len(has), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(has), b + 1, np.uint64)
        for r in range(BAND_ROWS):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, b * BAND_ROWS + r])
        bands[:, b] = x
    return has, bands


def distinct_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, hash) of the distinct shingles of each line, sorted: hashes have 64 bits less those of the number of lines."""
    codes, row, length = characters(lines)
    h = rolling(codes.astype(np.uint64) + np.uint64(1), SHINGLE)
    within = row[: len(h)] == row[SHINGLE - 1 :] if len(h) else np.empty(0, bool)
    h, owner = h[within], row[: len(h)][within]
    short = np.flatnonzero(length < SHINGLE)
    if len(short):
        own = np.array([xxhash.xxh3_64_intdigest(lines[i]) for i in short.tolist()], np.uint64)
        h, owner = np.concatenate([h, own]), np.concatenate([owner, short.astype(np.int32)])
    # one sort of the line number over as many bits of the hash as there is room for
    bits = np.uint64(len(lines).bit_length())
    key = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return (key >> (np.uint64(64) - bits)).astype(np.int64), key << bits


def sketches(owner: np.ndarray, value: np.ndarray, rows: int, words: int) -> np.ndarray:
    """Parity sketches of each row's distinct values."""
    size = 64 * words
    at = owner * size + (value >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
    bits = np.bincount(at, minlength=rows * size) & 1
    return np.packbits(bits.astype(np.uint8).reshape(rows, size), axis=1).view(np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays, the first sorted, as bytes."""
    parts = [squeeze(np.diff(arrays[0], prepend=arrays[0].dtype.type(0))), *map(squeeze, arrays[1:])]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(kinds)}I", data)
    out, at = [], 4 * len(kinds)
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(swell(data[at : at + n], kind))
        at += n
    return [np.cumsum(out[0], dtype=kinds[0]), *out[1:]]


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(x)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True)) if len(x) else []


def repeated(x: np.ndarray) -> np.ndarray:
    """Which values of a sorted array occur more than once."""
    same = x[1:] == x[:-1]
    return np.append(same, False) | np.insert(same, 0, False) if len(x) else same


def _scaled(h: np.ndarray, buckets: int) -> np.ndarray:
    """0 to buckets - 1, in the order of the hashes."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


PLACE = (np.uint64, np.uint32, np.int64, np.int64, np.int32)


def pack(docs: DataFrame, lines: int, bands: int) -> DataFrame:
    """docs: doc_id (not null), row, text. bucket, kind, payload: buckets below `lines` are of places, the `bands` ones from there of bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            number: dict[bytes, int] = {}
            which, at, count = [], [], []
            for text in texts(block.column("text")):
                own = lines_of(text)
                count.append(len(own))
                for i, line in own:
                    which.append(number.setdefault(line, len(number)))
                    at.append(i)
            if not which:
                continue
            distinct = list(number)
            del number
            code, line = np.array(which, np.int64), np.array(at, np.int32)
            doc, row = (np.repeat(block.column(c).to_numpy(), count) for c in ("doc_id", "row"))
            order = np.lexsort((row, line, doc, code))
            code, line, doc, row = code[order], line[order], doc[order], row[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            h, check = line_hashes(distinct)
            out = []
            place = np.repeat(first, np.diff(np.append(first, len(code))))
            copy = np.flatnonzero((doc != doc[place]) | (line != line[place]) | (row != row[place]))
            if len(copy):
                by_row = copy[np.argsort(row[copy], kind="stable")]
                out.append((int(h[0] % np.uint64(lines)), COPY, _packed(row[by_row].view(np.uint64), h[code[by_row]], line[by_row])))
            order = np.argsort(h)
            at_first = first[order]
            sorted_h = h[order]
            for a, b in _runs(_scaled(sorted_h, lines)):
                out.append((int(_scaled(sorted_h[a : a + 1], lines)[0]), FIRST, _packed(sorted_h[a:b], check[order[a:b]], doc[at_first[a:b]], row[at_first[a:b]], line[at_first[a:b]])))
            has, keys = signatures(distinct)
            if len(has):
                node = np.repeat(h[has], BANDS)
                key = keys.ravel()
                order = np.argsort(key)
                key, node = key[order], node[order]
                start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                shared = np.repeat(np.diff(np.append(start, len(key))) > 1, np.diff(np.append(start, len(key))))
                if shared.any():
                    out.append((lines + int(h[0] % np.uint64(bands)), MEMBER, _packed(key[shared], node[shared])))
                key, node = key[start], node[start]
                for a, b in _runs(_scaled(key, bands)):
                    out.append((lines + int(_scaled(key[a : a + 1], bands)[0]), BAND, _packed(key[a:b], node[a:b])))
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[a : a + 256], strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "payload"])

    return docs.mapInArrow(trimmed(run), "bucket long, kind int, payload binary")


def regroup(packed: DataFrame) -> DataFrame:
    """Rows of one kind each: FIRST (a line's name, doc_id, row, line), COPY (name, null, row, line), MEMBER (band, line's name)."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray | None = None, c: np.ndarray | None = None, line: np.ndarray | None = None) -> pa.Table:
        n = len(a)
        cols = [pa.array(np.full(n, kind, np.int32)), pa.array(a.view(np.int64))]
        cols += [pa.nulls(n, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (b, c)]
        return pa.table([*cols, pa.nulls(n, pa.int32()) if line is None else pa.array(line)], ["kind", "a", "b", "c", "line"])

    def run(table: pa.Table) -> pa.Table:
        held: dict[int, list[bytes]] = {k: [] for k in (FIRST, BAND, COPY, MEMBER)}
        for k, x in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
            held[k].append(x)
        out = [rows(FIRST, np.empty(0, np.uint64))]
        for x in held[COPY]:
            row, h, line = _unpacked(x, np.uint64, np.uint64, np.int32)
            out.append(rows(COPY, h, None, row, line))
        for x in held[MEMBER]:
            out.append(rows(MEMBER, *_unpacked(x, np.uint64, np.uint64)))
        if held[FIRST]:
            h, check, doc, row, line = (np.concatenate(x) for x in zip(*(_unpacked(x, *PLACE) for x in held[FIRST]), strict=True))
            order = np.argsort(h)
            many = repeated(h[order])
            one, order = order[~many], order[many]
            out.append(rows(FIRST, h[one], doc[one], row[one], line[one]))
            order = order[np.lexsort((row[order], line[order], doc[order], check[order], h[order]))]
            h, check, doc, row, line = (x[order] for x in (h, check, doc, row, line))
            new_name = np.diff(h, prepend=~h[:1]) != 0
            start = np.flatnonzero(new_name | (np.diff(check, prepend=~check[:1]) != 0))
            place = np.repeat(start, np.diff(np.append(start, len(h))))
            copy = (doc != doc[place]) | (line != line[place]) | (row != row[place])
            out.append(rows(COPY, h[copy], None, row[copy], line[copy]))
            out.append(rows(FIRST, h[new_name], doc[new_name], row[new_name], line[new_name]))
        if held[BAND]:
            key, node = (np.concatenate(x) for x in zip(*(_unpacked(x, np.uint64, np.uint64) for x in held[BAND]), strict=True))
            order = np.argsort(key)
            order = order[repeated(key[order])]
            order = order[np.lexsort((node[order], key[order]))]
            key, node = key[order], node[order]
            new = (np.diff(key, prepend=~key[:1]) != 0) | (np.diff(node, prepend=~node[:1]) != 0)
            key, node = key[new], node[new]
            shared = repeated(key)
            out.append(rows(MEMBER, key[shared], node[shared]))
        return pa.concat_tables(out)

    return packed.groupBy("bucket").applyInArrow(run, REGROUPED)


def candidate_lines(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n (distinct shingles), sketch and text of wanted (node, row, line)."""
    by = wanted.groupBy("row").agg(F.collect_list("line").alias("lines"))  # no longer than the row's text
    n = wanted.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            found: set[bytes] = set()
            for text, numbers in zip(texts(block.column("text")), block.column("lines").to_pylist(), strict=True):
                every = text.split(b"\n")
                found.update(every[i].strip(SPACES) for i in numbers)
            lines = list(found)
            if lines:
                owner, value = distinct_shingles(lines)
                size = np.bincount(owner, minlength=len(lines))
                sketch = sketches(owner, value, len(lines), PARITY_WORDS)
                cut = pa.array(np.arange(len(lines) + 1, dtype=np.int32) * PARITY_WORDS)
                yield from pa.table(
                    [pa.array(line_hashes(lines)[0].view(np.int64)), pa.array(size, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(sketch.ravel())), pa.array(lines, pa.binary())], ["node", "n", "sketch", "text"]
                ).to_batches(max_chunksize=5_000)

    joined = source.join(F.broadcast(by), "row") if n <= BROADCAST_LINES else source.join(by, "row")
    return joined.select("text", "lines").mapInArrow(trimmed(run), "node long, n long, sketch array<long>, text binary").dropDuplicates(["node"])


def shingle_set(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def common_shingles(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(size of the intersection, sum of the sizes) of the shingle sets of each pair, by one sort of both sets' hashes under the pair's number."""
    number: dict[bytes, int] = {}
    sides = [np.fromiter((number.setdefault(x, len(number)) for x in part), np.int64, len(part)) for part in (left, right)]
    owner, value = distinct_shingles(list(number))
    size = np.bincount(owner, minlength=len(number))
    start = np.cumsum(size) - size
    total = size[sides[0]] + size[sides[1]]
    common = np.zeros(len(left), np.int64)
    ends, at = np.cumsum(total), 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SORTED, "right")))
        bits = np.uint64((stop - at).bit_length())
        keys = []
        for side in sides:
            own = side[at:stop]
            n = size[own]
            index = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys.append((np.repeat(np.arange(stop - at, dtype=np.uint64), n) << (np.uint64(64) - bits)) | (value[index] >> bits))
        key = np.sort(np.concatenate(keys))
        same = key[1:][key[1:] == key[:-1]]
        common[at:stop] = np.bincount((same >> (np.uint64(64) - bits)).astype(np.int64), minlength=stop - at)
        at = stop
    return common, total


def components_of(lines: list[bytes], num: int, den: int) -> np.ndarray:
    """Of each line, the number of the first line of its component, by all pairs' exact similarities: shingles that several lines have are counted
    by products of a few columns, so that memory follows the lines, not their pairs' shingles."""
    owner, value = distinct_shingles(lines)
    n = np.bincount(owner, minlength=len(lines))
    order = np.argsort(value, kind="stable")
    order = order[repeated(value[order])]
    owner, value = owner[order], value[order]
    column = np.cumsum(np.diff(value, prepend=value[:1]) != 0)
    common = np.zeros((len(lines), len(lines)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(lines), COLUMNS), np.float32)
        has[owner[lo:hi], column[lo:hi] - at] = 1
        common += has @ has.T
    near = (den + num) * common >= num * (n[:, None] + n[None, :])
    np.fill_diagonal(near, True)
    first = np.arange(len(lines))
    while True:
        low = np.where(near, first[None, :], len(lines)).min(axis=1)
        low = low[low]
        if (low == first).all():
            return first
        first = low


def linked(members: DataFrame, records: DataFrame, num: int, den: int) -> DataFrame:
    """u and v: links that join the same lines as all pairs of one key with a similarity of num / den at least.

    members: key, node. records: node, n, sketch, text. A pair of lines that meets in several small groups is only tried in the first of their keys."""
    sizes = members.join(records.select("node", F.octet_length("text").alias("bytes")), "node").groupBy("key")
    slices = sizes.agg(F.least(F.count(F.lit(1)), F.ceil(F.greatest(F.count(F.lit(1)) / SLICE, F.sum("bytes") / SLICE_BYTES))).cast("int").alias("slices")).where("slices > 1")
    keys = members.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # BANDS at most
    each = records.join(keys, "node").withColumn("key", F.explode("keys"))
    cut = small_join(each, materialise(slices, "slices"), "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    # of several slices, each two meet in a group
    other = F.when(F.col("slices") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("slices") - 1), F.col("own")))
    dealt = cut.withColumn("own", own).withColumn("other", F.explode(other)).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def listed(nodes: np.ndarray, table: pa.Table, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pairs = []
        for g in np.unique(size).tolist():
            i, j = np.triu_indices(g, 1)
            at = start[size == g]
            pairs.append(((at[:, None] + i).ravel(), (at[:, None] + j).ravel()))
        if not pairs:
            return
        left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
        key, n = (table.column(c).to_numpy() for c in ("key", "n"))
        sketch = pa.compute.list_flatten(table.column("sketch")).to_numpy().view(np.uint64).reshape(-1, PARITY_WORDS)
        keys, text = table.column("keys").to_pylist(), table.column("text")
        for at in range(0, len(left), 4_000):
            a, b = left[at : at + 4_000], right[at : at + 4_000]
            total = n[a] + n[b]
            near = (np.minimum(n[a], n[b]) * den >= num * np.maximum(n[a], n[b])) & (np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) * (den + num) <= total * (den - num))
            a, b = a[near], b[near]
            first = np.fromiter((min(set(keys[x]).intersection(keys[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a)) == key[a]
            a, b = a[first], b[first]
            if len(a):
                common, total = common_shingles(text.take(a).to_pylist(), text.take(b).to_pylist())
                near = den * common >= num * (total - common)
                yield nodes[a[near]], nodes[b[near]]

    def links(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(np.append(start, table.num_rows))
        nodes = table.column("node").to_numpy()
        found = list(listed(nodes, table, start[(size > 1) & (size <= FEW)], size[(size > 1) & (size <= FEW)]))
        for at, g in zip(start[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            first = components_of(table.column("text").slice(at, g).to_pylist(), num, den)
            own = np.flatnonzero(first != np.arange(g))
            found.append((nodes[at + own], nodes[at + first[own]]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            place = np.stack([table.column(c).to_numpy() for c in ("key", "lo", "hi")])
            start = np.flatnonzero(np.append(True, (place[:, 1:] != place[:, :-1]).any(axis=0))) if table.num_rows else np.zeros(1, np.int64)
            if start[-1]:
                yield from links(table.slice(0, start[-1]), start[:-1])
            held = table.slice(start[-1])  # its last group may go on
        if held is not None and held.num_rows:
            yield from links(held, np.zeros(1, np.int64))

    dealt = dealt.select("key", "lo", "hi", "node", "n", "keys", "sketch", "text")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(trimmed(run), "u long, v long").distinct()


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def line_dedup(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The input's columns with the text without the lines that go, n_lines (lines with a word before) and n_removed (under these names)."""
    lean(docs.sparkSession)
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    source = docs.select(doc_id.alias("doc_id"), row_key(doc_id, text).alias("row"), text.alias("text")).where("doc_id is not null")
    gone = settle(docs.sparkSession, "gone", lambda: _gone(source, num, den))
    return _rebuilt(docs, gone, id_col, text_col, names)


def _gone(source: DataFrame, num: int, den: int) -> DataFrame:
    """row, and number and name of its lines that go."""
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = materialise(regroup(pack(source, max(1, -(-size // LINE_BUCKET)), max(1, -(-size // BAND_BUCKET)))), "lines")
    first = found.where(F.col("kind") == FIRST).select(F.col("a").alias("node"), F.struct(F.col("b").alias("doc_id"), "line", F.col("c").alias("row")).alias("first"))
    members = materialise(found.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("node")).distinct(), "members")
    wanted = materialise(members.select("node").distinct().join(first, "node").select("node", "first.row", "first.line"), "wanted")
    records = materialise(candidate_lines(source, wanted), "records")
    joined = connected_components(linked(members, records, num, den))
    grouped = materialise(joined.join(first, "node"), "linked")
    keepers = grouped.groupBy("component").agg(F.min("first").alias("keeper"))
    similar = grouped.join(keepers, "component").where("first <> keeper").select("first.row", "first.line", F.col("node").alias("h"))
    copies = found.where(F.col("kind") == COPY).select(F.col("c").alias("row"), "line", F.col("a").alias("h"))
    # copies of a similar line that goes are copies of its first place too
    return similar.union(copies).groupBy("row").agg(F.collect_list(F.struct("line", "h")).alias("gone"))  # no longer than the row's text


def _rebuilt(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, names: tuple[str, str]) -> DataFrame:
    plain = [c for c in docs.columns if c not in (*names, text_col)]
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    joined = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(plain)], text.alias("text"), row_key(doc_id, text).alias("__row"), doc_id.isNull().alias("__bare"))
    joined = joined.join(gone.select(F.col("row").alias("__row"), "gone", F.lit(False).alias("__bare")), ["__row", "__bare"], "left")
    joined = joined.select(*[f"keep_{i}" for i in range(len(plain))], "text", F.col("gone.line").alias("__line"), F.col("gone.h").alias("__h"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, numbers, hashes in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("__line").to_pylist(), batch.column("__h").to_pylist(), strict=True):
                if text is None:
                    out.append((None, 0, 0))
                    continue
                lines = text.split(b"\n")
                own = [x.strip(SPACES) for x in lines]
                n = sum(map(bool, own))
                if numbers:
                    at = [(i, h) for i, h in zip(numbers, hashes, strict=True) if i < len(own) and own[i]]
                    same = line_hashes([own[i] for i, _ in at])[0].view(np.int64).tolist() if at else []
                    away = {i for (i, h), mine in zip(at, same, strict=True) if h == mine}
                    text = b"\n".join(x for i, x in enumerate(lines) if i not in away)
                    out.append((text.decode(), n, len(away)))
                else:
                    out.append((text.decode(), n, 0))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f"keep_{i}") for i in range(len(plain))], *[pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)]], [*[f"keep_{i}" for i in range(len(plain))], "text", "n_lines", "n_removed"])

    kinds = ", ".join([*[f"keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(plain)], "text string, n_lines long, n_removed long"])
    done = joined.mapInArrow(trimmed(rebuild), kinds)
    place = {c: f"keep_{i}" for i, c in enumerate(plain)} | {text_col: "text"}
    return done.select(*[F.col(place[c]).alias(c) for c in docs.columns if c not in names], F.col("n_lines").alias(names[0]), F.col("n_removed").alias(names[1]))
