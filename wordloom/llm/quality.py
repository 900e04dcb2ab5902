"""Quality rules: exact base rules, then a hashed n-gram logistic regression trained on labelled rows.

The regression sees a text as two averages: of word unigram and bigram weights, and of character 3- to 5-gram weights, each hashed into a
fixed table. It is trained on the driver from a bounded sample (``SAMPLE`` documents a class and about ``SAMPLE_BYTES`` of their text, taken by
the hash of the row), calibrated by Platt scaling on a quarter of the sample that training did not see, and applied in Arrow batches to
whole texts. A document is kept if the base rules pass and its calibrated probability of being good reaches ``KEEP``.

Null and empty texts have no words and fail the base rules. Very long texts are read whole. An empty table gives an empty result. Labels that are null or name no document are ignored; where a doc_id has several
labels the worst holds. Without labels of both classes there is no model, and the base rules decide. Repeated rows are scored each. Columns
other than the named ones are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, blocks, bounded_sample, lean, mix, rolling, texts, trimmed

#: Labelled documents a class that training and calibration see at most, and about how many bytes of text.
SAMPLE, SAMPLE_BYTES = 1500, 16 << 20
#: Slots of each of the two weight tables.
SLOTS = 1 << 18
#: A good document's calibrated probability, at least.
KEEP = 0.5
EPOCHS, RATE, DECAY = 12, 20.0, 1e-6
BLOCK_BYTES = 2 << 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CHAR_GRAMS = (3, 4, 5)

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_numbers(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    chars = len(text.decode()) - sum(text.count(bytes([c])) for c in SPACES)
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    repeated = 0
    h = rolling(hashes, 5)
    if len(h) > 1:
        _, code, times = np.unique(h, return_inverse=True, return_counts=True)
        if len(times) < len(h):
            again = (times > 1)[code]
            edge = np.zeros(len(words) + 1, np.int32)
            edge[: len(again)] += again
            edge[5 : 5 + len(again)] -= again
            repeated = int((np.cumsum(edge) > 0).sum())
    return len(words), chars, symbols, dup, repeated


def slots(text: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the word n-grams and of the character n-grams of a text, one for each occurrence."""
    word = np.concatenate([mix(hashes), rolling(hashes, 2)]) & np.uint64(SLOTS - 1)
    codes = np.frombuffer(text, np.uint8).astype(np.uint32) if text.isascii() else np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    chars = []
    for n in CHAR_GRAMS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) ^ codes[i : len(codes) - n + 1 + i]
            chars.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - (SLOTS - 1).bit_length()))
    return word.astype(np.int64), np.concatenate(chars).astype(np.int64) if chars else np.empty(0, np.int64)


@dataclass
class Model:
    words: np.ndarray
    chars: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, word: np.ndarray, char: np.ndarray) -> float:
        a = float(self.words[word].mean()) if len(word) else 0.0
        b = float(self.chars[char].mean()) if len(char) else 0.0
        return a + b + self.bias

    def probability(self, raw: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30))))


Sparse = tuple[np.ndarray, np.ndarray]


def fit(rows: list[tuple[int, Sparse, Sparse]], seed: int = 7) -> Model | None:
    """rows: (label, (word slots, shares), (character slots, shares)); logistic regression by averaged gradient steps, then Platt scaling."""
    if len({y for y, _, _ in rows}) < 2:
        return None
    order = np.random.default_rng(seed).permutation(len(rows))
    held = {int(i) for k, i in enumerate(order) if k % 4 == 3}
    train = [rows[i] for i in order if int(i) not in held]
    if len({y for y, _, _ in train}) < 2 or len({rows[i][0] for i in held}) < 2:
        train, held = [rows[i] for i in order], set(range(len(rows)))
    weigh = {y: len(train) / 2 / max(1, sum(z == y for z, _, _ in train)) for y in (0, 1)}
    w, c, bias = np.zeros(SLOTS, np.float64), np.zeros(SLOTS, np.float64), 0.0
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for y, (wi, wx), (ci, cx) in train:
            p = 1 / (1 + np.exp(-np.clip(w[wi] @ wx + c[ci] @ cx + bias, -30, 30)))
            g = (y - p) * weigh[y]
            w[wi] += rate * (g * wx - DECAY * w[wi])
            c[ci] += rate * (g * cx - DECAY * c[ci])
            bias += 0.01 * g
    model = Model(w.astype(np.float32), c.astype(np.float32), bias)
    raw = np.array([w[wi] @ wx + c[ci] @ cx + bias for i in sorted(held) for _, (wi, wx), (ci, cx) in [rows[i]]])
    y = np.array([rows[i][0] for i in sorted(held)], float)
    good, bad = y.sum(), (1 - y).sum()
    aim = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))  # Platt's smoothed targets
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        r = p * (1 - p) + 1e-9
        grad = np.array([((p - aim) * raw).sum() + 1e-3 * (a - 1), (p - aim).sum()])
        hess = np.array([[(r * raw * raw).sum() + 1e-3, (r * raw).sum()], [(r * raw).sum(), r.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = max(float(a), 1e-3), float(b)
    return model


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, Sparse, Sparse]]:
    """Features of the training sample; their number is bounded by SAMPLE, their length by SAMPLE_BYTES and the tables' slots."""
    rated = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rated = rated.withColumn("order", F.xxhash64("doc_id"))
    chosen = [rated.where(F.col("quality") == q).orderBy("order", "doc_id").limit(2 * SAMPLE) for q in (0, 1)]
    wanted = F.broadcast(chosen[0].union(chosen[1]).select("doc_id", F.col("quality").cast("int").alias("quality")))  # 4 * SAMPLE rows at most
    found = bounded_sample(docs.join(wanted, "doc_id").select("doc_id", "quality", "text").where("text is not null"), "quality", "text", "quality", SAMPLE, SAMPLE_BYTES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for block in blocks(batches, BLOCK_BYTES):
            out = []
            for text in texts(block.column("text")):
                row: list = []
                for s in slots(text, memo.of(text.split())):
                    at, n = np.unique(s, return_counts=True)
                    row += [at.astype(np.int32), (n / max(1, len(s))).astype(np.float32)]
                out.append(row)
            cols = list(zip(*out, strict=True))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float32())) * 2
            yield pa.RecordBatch.from_arrays([block.column("quality").combine_chunks(), pa.array([xxhash.xxh3_64_hexdigest(x) for x in texts(block.column("text"))]), *[pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]], ["quality", "name", "wi", "wx", "ci", "cx"])

    got = found.mapInArrow(features, "quality int, name string, wi array<int>, wx array<float>, ci array<int>, cx array<float>").toArrow()
    got = got.sort_by([("quality", "ascending"), ("name", "ascending")])
    col = {name: got.column(name).to_pylist() if name in ("quality",) else [np.asarray(x.values) for x in got.column(name)] for name in ("quality", "wi", "wx", "ci", "cx")}
    return [(int(y > 0), (a, b.astype(np.float64)), (c, d.astype(np.float64))) for y, a, b, c, d in zip(*(col[k] for k in ("quality", "wi", "wx", "ci", "cx")), strict=True)]


def quality_rules(docs: DataFrame, labels: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base numbers, base_failed, probability (null without a model) and kept, for every row."""
    lean(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(sample(source, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for block in blocks(batches, BLOCK_BYTES):
            rows = []
            for text in texts(block.column("text")):
                words = text.split()
                hashes = memo.of(words)
                numbers = base_numbers(text, words, hashes)
                failed = numbers[0] < 10 or 100 * numbers[4] > 20 * numbers[0]
                p = model.probability(model.raw(*slots(text, hashes))) if model else None
                rows.append((*numbers, failed, p, not failed and (p is None or p >= keep)))
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_())
            yield from pa.table([block.column("doc_id"), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]).to_batches()

    return source.mapInArrow(trimmed(run), f"doc_id long, {BASE}, base_failed boolean, probability double, kept boolean")
