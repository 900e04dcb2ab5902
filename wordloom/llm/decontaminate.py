"""Benchmark decontamination over a distributed positional inverted index.

The corpus is cut into shards (one index row each, of bounded text size). A row stores the shard's terms and, for each, the sorted
positions at which it stands. Test phrases whose terms a shard has are then looked up in it: their posting lists, rarest term first, are shifted
by the term's offset in the phrase and intersected. With a slop, each term may stand that many words away from its place after the phrase's
first word; those are the proximity matches, found from the rarest term too. No row is shuffled, so no frequent passage, document or source can make one task larger than the others.

The test set travels to the tasks in blocks of bounded size (``BENCH_BYTES`` of different items) as a list of terms and a matrix of their numbers;
a larger test set makes more passes over the index row, never a larger broadcast.

Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters. Null and empty texts have no words, are never hit and are
returned. Very long texts are indexed whole, a shard of their own each. An empty table gives an empty result, an empty test set no hits. Test items without an id or without words are left out; repeated items count once. Rows of the same doc_id are separate
documents. Columns other than the named ones are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, materialise, settle, texts, trimmed

SHARD_BYTES = 4 << 20
BENCH_BYTES = 2 << 20
#: Separators become spaces, A-Z become a-z, digits, a-z and bytes of non-ASCII characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "ids array<long>, starts array<int>, lengths array<int>, terms binary, bounds binary, postings binary"


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def build_index(docs: DataFrame, gap: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard. Between documents gap positions stay free, so that no match whose words lie within gap of its first runs across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, shard_bytes):
            vocab: dict[bytes, int] = {}
            number = vocab.setdefault
            codes: list[np.ndarray] = []
            lengths = []
            for text in texts(block.column("text")):
                w = words(text)
                lengths.append(len(w))
                codes.append(np.fromiter((number(x, len(vocab)) for x in w), np.int32, len(w)))
            n = np.array(lengths, np.int64)
            starts = np.concatenate(([0], np.cumsum(n + gap)[:-1]))
            at = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            code = np.concatenate(codes) if codes else np.empty(0, np.int32)
            order = np.argsort(code, kind="stable")
            bounds = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(vocab)))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([starts.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([n.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([b"\n".join(vocab)], pa.binary()),
                    pa.array([bounds.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([at[order].astype(np.int32).tobytes()], pa.binary()),
                ],
                ["ids", "starts", "lengths", "terms", "bounds", "postings"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), INDEX)


def phrases(rows: list, width: int) -> dict[tuple[bytes, ...], list[int]]:
    """Windows of width words (all words of a shorter item) and the items that have them."""
    out: dict[tuple[bytes, ...], dict[int, None]] = {}
    for item, text in rows:
        w = words((text or "").encode())
        if item is not None and w:
            for i in range(max(1, len(w) - width + 1)):
                out.setdefault(tuple(w[i : i + width]), {})[item] = None
    return {k: list(v) for k, v in out.items()}


@dataclass
class Phrases:
    """Phrases as rows of term numbers, a matrix for each length, and their items."""

    terms: dict[bytes, int]
    parts: list[tuple[np.ndarray, list[list[int]]]]

    @classmethod
    def of(cls, tests: dict[tuple[bytes, ...], list[int]]) -> Phrases:
        terms: dict[bytes, int] = {}
        by: dict[int, tuple[list[list[int]], list[list[int]]]] = {}
        for phrase, items in tests.items():
            rows, owners = by.setdefault(len(phrase), ([], []))
            rows.append([terms.setdefault(x, len(terms)) for x in phrase])
            owners.append(items)
        return cls(terms, [(np.array(rows, np.int32), owners) for rows, owners in by.values()])

    def within(self, vocab: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
        """(numbers in the vocabulary of the terms in order, items) of the phrases whose terms it all has."""
        number = np.full(len(self.terms), -1, np.int64)
        for i, x in enumerate(vocab):
            if (k := self.terms.get(x)) is not None:
                number[k] = i
        for rows, owners in self.parts:
            local = number[rows]
            for k in np.flatnonzero((local >= 0).all(axis=1)).tolist():
                yield local[k].tolist(), owners[k]


def intersect(lists: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Starts at which every (offset, positions) list has start + offset; lists: rarest first."""
    offset, first = lists[0]
    starts = first - offset
    for offset, at in lists[1:]:
        starts = starts[_within(starts + offset, at, 0)]
        if not len(starts):
            break
    return starts


def nearby(lists: list[tuple[int, np.ndarray]], slop: int) -> np.ndarray:
    """Positions of the first word (offset 0) with a position within slop of start + offset in every list; lists: rarest first."""
    offset, rare = lists[0]
    starts = np.unique((rare[:, None] - offset + np.arange(-slop, slop + 1)).ravel())
    for offset, at in sorted(lists, key=lambda x: x[0] > 0):
        starts = starts[_within(starts + offset, at, slop if offset else 0)]
        if not len(starts):
            break
    return starts


def _within(wanted: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
    k = np.searchsorted(at, wanted - slop)
    return (k < len(at)) & (at[np.minimum(k, len(at) - 1)] <= wanted + slop)


STATE = f"{INDEX}, cover binary, found_doc array<int>, found_item array<long>, found_exact array<boolean>"
RESULT = "doc_id long, n_words long, n_hit long, items array<long>, near_items array<long>"


def search(index: DataFrame, tests: dict[tuple[bytes, ...], list[int]], slop: int = 0, last: bool = True) -> DataFrame:
    """Look one block of phrases up in every shard, whose gap is at least the longest phrase and the slop.

    last: one row per indexed document comes back (RESULT): n_hit counts words inside exact matches, near_items have proximity matches
    only. Otherwise the index row comes back with what has been found so far, for the next block of phrases.
    """

    phrases = Phrases.of(tests)

    def look(row: dict) -> pa.RecordBatch:
        starts, lengths = np.array(row["starts"], np.int64), np.array(row["lengths"], np.int64)
        vocab = row["terms"].split(b"\n") if row["postings"] else []
        bounds, postings = np.frombuffer(row["bounds"], np.int32), np.frombuffer(row["postings"], np.int32).astype(np.int64)
        size = int(starts[-1] + lengths[-1]) + 1 if len(starts) else 1
        found: dict[tuple[int, int], bool] = dict(zip(zip(row.get("found_doc") or (), row.get("found_item") or (), strict=True), row.get("found_exact") or (), strict=True))
        edge = np.zeros(size, np.int32)
        for ids, items in phrases.within(vocab):
            lists = sorted(((k, postings[bounds[i] : bounds[i + 1]]) for k, i in enumerate(ids)), key=lambda x: len(x[1]))
            exact = intersect(lists)
            for at, kind in ((nearby(lists, slop) if slop else exact[:0], False), (exact, True)):
                for d in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                    for item in items:
                        found[d, item] = kind or found.get((d, item), False)
            np.add.at(edge, exact, 1)
            np.add.at(edge, exact + len(ids), -1)
        cover = np.cumsum(edge) > 0
        if row.get("cover"):
            cover |= np.unpackbits(np.frombuffer(row["cover"], np.uint8), count=size).astype(bool)
        if not last:
            done = {"cover": np.packbits(cover).tobytes(), "found_doc": [d for d, _ in found], "found_item": [i for _, i in found], "found_exact": list(found.values())}
            return pa.RecordBatch.from_pylist([row | done], schema=state_schema)
        total = np.concatenate(([0], np.cumsum(cover)))
        by: list[tuple[list[int], list[int]]] = [([], []) for _ in starts]
        for (d, item), kind in sorted(found.items()):
            by[d][not kind].append(item)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(row["ids"], pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(total[starts + lengths] - total[starts] if len(starts) else [], pa.int64()),
                pa.array([x[0] for x in by], pa.list_(pa.int64())),
                pa.array([x[1] for x in by], pa.list_(pa.int64())),
            ],
            ["doc_id", "n_words", "n_hit", "items", "near_items"],
        )

    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    state_schema = pa.schema([("ids", longs), ("starts", ints), ("lengths", ints), ("terms", pa.binary()), ("bounds", pa.binary()), ("postings", pa.binary()), ("cover", pa.binary()), ("found_doc", ints), ("found_item", longs), ("found_exact", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield look(batch.slice(i, 1).to_pylist()[0])

    return index.mapInArrow(trimmed(run), RESULT if last else STATE)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bench_bytes: int = BENCH_BYTES) -> DataFrame:
    """Every document with its words, hit words, items found as exact phrases and items found by proximity only."""
    lean(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // bench_bytes))

    def found() -> DataFrame:
        state = materialise(build_index(docs, width + slop, id_col, text_col), "index")
        for part in range(parts):
            mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
            state = search(state, phrases(mine.collect(), width), slop, part == parts - 1)
        return state

    return settle(docs.sparkSession, "found", found)
