"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum, over all ways to cut it
into pieces, of the product of their probabilities: a forward pass, done for all new words of a batch and all languages at once. A text's
score is the product over its words, so all segmentations of the text are summed. Piece probabilities are learned by expectation
maximisation over the words of a bounded sample of labelled documents (``SAMPLE`` a language and about ``SAMPLE_BYTES`` of text, by the hash of
the row). Words of more than ``LONG`` letters are learned from in parts of that length; predictions take words of any length whole.

Words are runs of letters (Unicode's category L, so no numerals such as ½ or Ⅷ), lower-cased, with the vocabulary's word mark in front. A letter that is no piece costs as the one common unknown
piece. The reported score is the posterior of the predicted language with the evidence tempered to at most ``EVIDENCE`` words.

Texts that are null or empty or have no letter get ``und`` and score 0. Very long texts count whole. An empty table gives an empty result. If no row can be learned from, all texts get ``und``. Labels are never
inputs of a prediction. Repeated rows are predicted each; ties go to the first language by name. Columns other than the named ones are
not carried.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_sample, lean, texts, trimmed

#: Documents a language that are learned from at most, bytes of their texts, and expectation maximisation steps.
SAMPLE, SAMPLE_BYTES, STEPS = 300, 16 << 20, 4
LONG = 60
EVIDENCE = 30
BLOCK_BYTES = 2 << 20
#: Words whose evidence a Python worker keeps, about, and words that it looks up in the lattice at a time.
MEMO_LIMIT, AT_ONCE = 1 << 18, 5_000
NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{re.escape(NUMERALS)}]+")
#: The same with numerals, which is much faster; what it finds is split by LETTERS once for each distinct word.
RUNS = re.compile(r"[^\W\d_]+")
MARK = "▁"
PRIME = np.uint64(0x100000001B3)
#: Steps after which the forward values are scaled back into range.
RESCALE = 8


def letters(run: str) -> list[str]:
    """The words of a match of RUNS."""
    return [run] if run.isascii() else LETTERS.findall(run)


def vocabulary(model: str) -> list[str]:
    """The vocabulary's pieces that can stand in a marked, lower-case word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return [p for p in pieces if p == p.lower() and (p == MARK or LETTERS.fullmatch(p.removeprefix(MARK)))]


class Lattice:
    """Finds the vocabulary's pieces at all places of many words at once, by prefix hashes."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces))
        self.powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(256, PRIME, np.uint64))))
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int64)
        self.lengths = sorted({len(p) for p in pieces})

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(PRIME) + ord(c) * 2654435761 + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, words: list[str]) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """For each end position: (end, [(start, rows, piece ids)]) over marked words, longest words first (rows count from there)."""
        n = np.array([len(w) for w in words])
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) * np.uint64(2654435761) + np.uint64(1)
        at = np.concatenate(([0], np.cumsum(n)[:-1]))
        width = self.longest
        recent = [np.zeros(len(words), np.uint64)]  # prefix hashes, the last width + 1 of them
        for end in range(1, int(n[0]) + 1):
            live = int(np.searchsorted(-n, -end, "right"))
            recent = [x[:live] for x in recent[-width:]]
            recent.append(recent[-1] * PRIME + flat[at[:live] + end - 1])
            out = []
            for size in self.lengths:
                if size > end:
                    break
                key = recent[-1] - recent[-1 - size] * self.powers[size]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[k] == key
                rows = np.flatnonzero(hit)
                if len(rows):
                    out.append((end - size, rows, self.ids[k[rows]]))
                if size == 1 and not hit.all():
                    rows = np.flatnonzero(~hit)
                    out.append((end - 1, rows, np.full(len(rows), self.unknown)))
            yield end, out

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each marked word (any order) under each column of p."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        rows = [words[i] for i in order]
        n = np.array([len(w) for w in rows])
        values = {0: np.ones((len(rows), p.shape[1]))}
        scale = np.zeros((len(rows), p.shape[1]))
        out = np.empty((len(rows), p.shape[1]))
        for end, edges in self.edges(rows):
            live = int(np.searchsorted(-n, -end, "right"))
            here = np.zeros((live, p.shape[1]))
            for start, at, ids in edges:
                here[at] += values[start][at] * p[ids]
            values[end] = here
            values.pop(end - self.longest, None)
            done = np.flatnonzero(n[:live] == end)
            out[done] = np.log(here[done] + 1e-300) + scale[done]
            if end % RESCALE == 0:
                by = here + 1e-300
                scale[:live] += np.log(by)
                for k in values:
                    values[k] = values[k][:live] / by
        back = np.empty_like(out)
        back[order] = out
        return back

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations of the words (of up to LONG + 1 characters) under one language's p."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        rows, counts = [words[i] for i in order], counts[order]
        n = np.array([len(w) for w in rows])
        steps = list(self.edges(rows))
        a = np.zeros((int(n[0]) + 1, len(rows)))
        a[0] = 1
        for end, edges in steps:
            for start, at, ids in edges:
                a[end, at] += a[start, at] * p[ids]
        b = np.zeros_like(a)
        b[n, np.arange(len(rows))] = 1
        total = a[n, np.arange(len(rows))] + 1e-300
        out = np.zeros(len(p))
        for end, edges in reversed(steps):
            for start, at, ids in edges:
                b[start, at] += b[end, at] * p[ids]
                out += np.bincount(ids, a[start, at] * p[ids] * b[end, at] * counts[at] / total[at], minlength=len(p))
        return out


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    p: np.ndarray
    lattice: Lattice = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._fresh()

    def _fresh(self) -> None:
        self.lattice = Lattice(self.pieces)
        self.forget()

    def forget(self) -> None:
        """Drop the memo, so that a reused Python worker doesn't hold it into the next stage."""
        self.memo: dict[str, int] = {}
        self.table = np.empty((0, len(self.langs) + 1))

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "pieces": self.pieces, "p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._fresh()

    def evidence(self, rows: list[str]) -> list[tuple[np.ndarray, int]]:
        """(log probability by language, words) of each text."""
        split = [RUNS.findall(x.lower()) for x in rows]
        if len(self.memo) > MEMO_LIMIT:
            self.forget()
        new = sorted({w for x in split for w in x}.difference(self.memo))
        if new:
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            parts = [letters(w) for w in new]
            count = np.array([len(x) for x in parts])
            owner, flat = np.repeat(np.arange(len(new)), count), [MARK + p for x in parts for p in x]
            found = np.zeros((len(new), len(self.langs) + 1))
            found[:, -1] = count
            for i in range(0, len(flat), AT_ONCE):
                np.add.at(found[:, :-1], owner[i : i + AT_ONCE], self.lattice.forward(flat[i : i + AT_ONCE], self.p))
            known = len(self.memo)
            if known > len(self.table):  # more rows than are needed now: pages that aren't written to take no memory
                table = np.empty((2 * known, len(self.langs) + 1))
                table[: known - len(new)] = self.table[: known - len(new)]
                self.table = table
            self.table[known - len(new) : known] = found
        look = self.memo.__getitem__
        sums = [self.table[np.fromiter(map(look, w), np.int64, len(w))].sum(axis=0) for w in split]
        return [(x[:-1], int(x[-1])) for x in sums]

    def predict(self, rows: list[str]) -> list[tuple[str, float]]:
        out = []
        for log, n in self.evidence(rows):
            if not n:
                out.append(("und", 0.0))
                continue
            x = (log - log.max()) * min(1.0, EVIDENCE / n)
            k = int(np.argmax(x))
            out.append((self.langs[k], float(1 / np.exp(x).sum())))
        return out


def learn(counts: dict[str, dict[str, int]], pieces: list[str], steps: int = STEPS) -> Model | None:
    """counts: words of each language. Starts from equal probabilities; half an occurrence is added to every piece."""
    if not counts:
        return None
    lattice, langs = Lattice(pieces), sorted(counts)
    columns = []
    for lang in langs:
        parts: dict[str, int] = {}
        for w, n in counts[lang].items():
            for i in range(0, len(w), LONG):
                part = w[i : i + LONG] if i else MARK + w[:LONG]
                parts[part] = parts.get(part, 0) + n
        words, n = list(parts), np.array(list(parts.values()), float)
        p = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
        for _ in range(steps if words else 0):
            e = np.zeros_like(p)
            for i in range(0, len(words), 50_000):
                e += lattice.expected(words[i : i + 50_000], n[i : i + 50_000], p)
            p = (e + 0.5) / (e + 0.5).sum()
        columns.append(p)
    return Model(langs, pieces, np.stack(columns, axis=1))


def train(docs: DataFrame, model: str, sample: int = SAMPLE) -> Model | None:
    """docs: doc_id, text, lang of the rows that may be learned from."""
    lean(docs.sparkSession)
    chosen = bounded_sample(docs.where("lang is not null and text is not null"), "lang", "text", "language", sample, SAMPLE_BYTES)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = [x for run in RUNS.findall(text.lower()) for x in letters(run)]
                langs += [lang] * len(w)
                found += w
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string())], ["lang", "word"])

    rows = chosen.select("lang", "text").mapInArrow(words, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts.setdefault(lang, {})[word] = n
    return learn(counts, vocabulary(model))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns (doc_id alone by default) and the prediction and its score under the given names, for every row. Kept columns of
    these names are left out."""
    lean(docs.sparkSession)
    columns = [c for c in (keep or (id_col,)) if c not in names]
    source = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(columns)], F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            rows = [x.decode() for x in texts(block.column("text"))]
            found = model.predict(rows) if model else [("und", 0.0)] * len(rows)
            kept = [block.column(f"keep_{i}") for i in range(len(columns))]
            yield from pa.table([*kept, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*[f"keep_{i}" for i in range(len(columns))], "lang_pred", "score"]).to_batches()
        if model:
            model.forget()

    kinds = ", ".join(f"keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    out = source.mapInArrow(trimmed(run), f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(columns)], F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))
