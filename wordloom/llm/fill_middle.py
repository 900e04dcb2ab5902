"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put together again in another order, with ropes.

A text is a rope: a balanced tree whose leaves hold up to ``LEAF`` code points and whose nodes remember how many units (runs of ASCII letters, or
single other characters) begin below them and how many code points lie there. Two splits at unit ranks give the three parts; sentinels and parts are
joined in the order of the form. The inverse reads the ends of the sentinels off the output, splits its rope there by code points and joins
the parts in the order of the text. Nothing is copied but the two leaves that a split goes through.

The two ranks and the form depend on the id and the salt alone. A null text is empty; an empty text, or one with a sentinel in it, stays plain.
A null id counts as an empty one. Texts are read whole, however long; a run of letters may span leaves. Repeated rows are transformed each, an empty
table gives an empty result, and columns other than the named ones are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, texts, trimmed

#: Code points of a leaf at most.
LEAF = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 2 << 20
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
LETTERS = re.compile("[A-Za-z]+")


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf has text; an inner node has left and right. joined: a leaf's first letters go on with a unit that begins in the leaf before it."""

    units: int
    chars: int
    text: str = ""
    joined: bool = False
    left: Rope | None = None
    right: Rope | None = None


def leaf(text: str, joined: bool = False) -> Rope:
    runs = letters = 0
    for m in LETTERS.finditer(text):
        runs += 1
        letters += m.end() - m.start()
    return Rope(runs + len(text) - letters - joined, len(text), text, joined)


def join(a: Rope | None, b: Rope | None) -> Rope | None:
    if a is None or b is None:
        return a or b
    return Rope(a.units + b.units, a.chars + b.chars, left=a, right=b)


def build(text: str, size: int = LEAF) -> Rope | None:
    """A balanced rope; None for an empty text."""
    level = []
    for at in range(0, len(text), size):
        level.append(leaf(text[at : at + size], bool(at and LETTERS.match(text[at]) and LETTERS.match(text[at - 1]))))
    while len(level) > 1:
        level = [reduce(join, level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else None


Parts = tuple[Rope | None, Rope | None]


def split_units(rope: Rope | None, rank: int) -> Parts:
    """What lies before the beginning of unit number rank (from 0), and the rest."""
    if rope is None or rank >= rope.units:
        return rope, None
    if rope.left is not None:
        if rank < rope.left.units:
            a, b = split_units(rope.left, rank)
            return a, join(b, rope.right)
        a, b = split_units(rope.right, rank - rope.left.units)
        return join(rope.left, a), b
    at = next(islice(UNIT.finditer(rope.text), rank + rope.joined, None)).start()
    if not at:
        return None, rope
    return Rope(rank, at, rope.text[:at], rope.joined), Rope(rope.units - rank, rope.chars - at, rope.text[at:])


def split_chars(rope: Rope | None, at: int) -> Parts:
    """The first `at` code points, and the rest."""
    if rope is None or at >= rope.chars:
        return rope, None
    if at <= 0:
        return None, rope
    if rope.left is not None:
        if at < rope.left.chars:
            a, b = split_chars(rope.left, at)
            return a, join(b, rope.right)
        a, b = split_chars(rope.right, at - rope.left.chars)
        return join(rope.left, a), b
    within = bool(LETTERS.match(rope.text[at]) and LETTERS.match(rope.text[at - 1]))
    return leaf(rope.text[:at], rope.joined), leaf(rope.text[at:], within)


def flat(rope: Rope | None) -> str:
    out, todo = [], [rope]
    while todo:
        node = todo.pop()
        if node is None:
            continue
        if node.left is None:
            out.append(node.text)
        else:
            todo += (node.right, node.left)
    return "".join(out)


def transform(text: str, name: str, salt: int, plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None where plain), and the output. plain and spm: percent of the forms."""
    rope = build(text)
    n = rope.units if rope else 0
    digest = hashlib.sha256(f"{salt}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, tail = split_units(rope, high)
    prefix, middle = split_units(head, low)
    p, s, m = leaf(PREFIX), leaf(SUFFIX), leaf(MIDDLE)
    order = (s, tail, p, prefix, m, middle) if h4 % 100 < spm else (p, prefix, s, tail, m, middle)
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, prefix.chars if prefix else 0, middle.chars if middle else 0, flat(reduce(join, order))


def restore(output: str, form: str) -> str:
    """The text that an output was made of: no part holds a sentinel, and no sentinel overlaps itself, so the first match is the sentinel."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    rest: Rope | None = build(output)
    _, rest = split_chars(rest, len(first))
    cut = output.index(second, len(first))
    last = output.index(MIDDLE, cut + len(second))
    one, rest = split_chars(rest, cut - len(first))
    _, rest = split_chars(rest, len(second))
    two, rest = split_chars(rest, last - cut - len(second))
    _, middle = split_chars(rest, len(MIDDLE))
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return flat(join(join(prefix, middle), suffix))


def fill_in_middle(docs: DataFrame, salt: int = 1, plain: int = 10, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output, for every row; plain is the percentage of texts that
    stay as they are, spm that of the others that begin with the suffix."""
    lean(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            rows = [transform(x.decode(), name, salt, plain, spm) for x, name in zip(texts(block.column("text")), block.column("name").to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield from pa.table([block.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]).to_batches()

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(trimmed(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(done: DataFrame) -> DataFrame:
    """The result of fill_in_middle with restored: the text, from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES, "output"):
            back = [restore(x.decode(), form) for x, form in zip(texts(block.column("output")), block.column("form").to_pylist(), strict=True)]
            yield from block.append_column("restored", pa.array(back, pa.string())).to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in done.schema)
    return done.mapInArrow(trimmed(run), f"{fields}, restored string")
