"""Character ids: words as fixed-width id arrays, and back, as native expressions.

Ids: five special characters, then ranges of code points in the order in which they were added, then single characters. Ranges are tried
before single characters. Single characters are numbered from the end of all ranges, so adding a range after them moves their ids onto
those of the last ranges; ``collisions`` lists such ids, and decoding takes the single character there.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .exact import APART, SELECTOR

# Special characters (pad, unknown, separator, class, mask) and the ranges that every table has.
SPECIAL = "ꝐꞸꟉꞒꞢ"
PAD, UNKNOWN, SEPARATOR, CLASS, MASK = range(5)
RANGES = ((9984, 10175), (128512, 128591), (9728, 9983), (127744, 128511), (129648, 129782), (129280, 129535), (8192, 8303), (128640, 128764), (127232, 127487))
SINGLES = APART + "." + SELECTOR
#: The sample configuration: printable ASCII, Latin-1, IPA to modifier letters, Arabic, Tifinagh.
SAMPLE_RANGES = ((33, 126), (161, 255), (592, 687), (1536, 1791), (11568, 11647))


@dataclass(frozen=True)
class CharTable:
    """An immutable id table; width is the length of an encoded word."""

    ranges: tuple[tuple[int, int], ...] = RANGES
    singles: str = SINGLES
    width: int = 20
    bases: tuple[int, ...] = field(init=False)
    single_base: int = field(init=False)

    def __post_init__(self) -> None:
        # a range added after the single characters starts behind them
        at, bases = len(SPECIAL), []
        for k, (a, b) in enumerate(self.ranges):
            bases.append(at + (len(self.singles) if k >= len(RANGES) else 0))
            at += b - a + 1
        object.__setattr__(self, "bases", tuple(bases))
        object.__setattr__(self, "single_base", at)

    @property
    def size(self) -> int:
        return self.single_base + len(self.singles)

    def with_ranges(self, ranges: tuple[tuple[int, int], ...]) -> CharTable:
        return CharTable(self.ranges + tuple(tuple(r) for r in ranges), self.singles, self.width)

    def collisions(self) -> set[int]:
        """Ids that a single character shares with a range."""
        singles = set(range(self.single_base, self.size))
        return {i for base, (a, b) in zip(self.bases, self.ranges, strict=True) for i in singles & set(range(base, base + b - a + 1))}

    def to_json(self) -> str:
        return json.dumps({"ranges": self.ranges, "singles": self.singles, "width": self.width}, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> CharTable:
        x = json.loads(text)
        return CharTable(tuple(map(tuple, x["ranges"])), x["singles"], x["width"])

    def save(self, spark: SparkSession, path: str, mode: str = "error") -> None:
        """The table as a folder with one line of JSON, in whatever store Spark writes to."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode(mode).text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CharTable:
        return CharTable.from_json(spark.read.text(path, wholetext=True).where("trim(value) <> ''").first().value)

    def _piecewise(self, value: Column, cases: list[tuple[Column, Column]], default: Column) -> Column:
        out = None
        for when, then in cases:
            out = F.when(when, then) if out is None else out.when(when, then)
        return default if out is None else out.otherwise(default)

    def encode_char(self, char: Column) -> Column:
        """Id of the (first) character."""
        code = F.ascii(char)
        cases = [(char == c, F.lit(i)) for i, c in enumerate(SPECIAL)]
        cases += [(code.between(a, b), code - a + base) for base, (a, b) in zip(self.bases, self.ranges, strict=True)]
        cases += [(code == ord(c), F.lit(self.single_base + i)) for i, c in enumerate(self.singles)]
        return self._piecewise(code, cases, F.lit(UNKNOWN)).cast("int")

    def encode_word(self, word: Column, add_class: bool = True, add_separator: bool = True) -> Column:
        """width ids: class, characters, separator, padding. With both marks the last place is always padding."""
        end = self.width - (2 if add_class else 1)
        room = end + 1 - (1 if add_class else 0)
        kept = F.slice(F.filter(F.split(word, ""), lambda c: c != ""), 1, room - 1 if add_separator else room)
        ids = F.transform(kept, self.encode_char)
        parts = [F.array(F.lit(CLASS))] if add_class else []
        parts += [ids, F.array(F.lit(SEPARATOR))] if add_separator else [ids]
        return F.slice(F.concat(*parts, F.array_repeat(F.lit(PAD), self.width)), 1, self.width)

    @staticmethod
    def attention(ids: Column) -> Column:
        return F.transform(ids, lambda x: (x != PAD).cast("int"))

    def decode_char(self, id_: Column) -> Column:
        cases = [(id_ == i, F.lit(c)) for i, c in enumerate(SPECIAL)]
        cases += [(id_ == self.single_base + i, F.lit(c)) for i, c in enumerate(self.singles)]
        # Spark's char() knows one byte only: code points become characters through UTF-32
        text = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        cases += [(id_.between(base, base + b - a), text((id_ - base + a).cast("long"))) for base, (a, b) in zip(self.bases, self.ranges, strict=True)]
        return self._piecewise(id_, cases, F.lit(SPECIAL[UNKNOWN]))

    def decode_word(self, ids: Column, length: Column | None = None) -> Column:
        """All characters; with a length, that many after the class mark."""
        shown = ids if length is None else F.slice(ids, F.lit(2), length)
        return F.array_join(F.transform(shown, self.decode_char), "")

    def mask_ids(self, ids: Column, key: Column, probability: float = 0.15, seed: int = 1) -> Column:
        """struct(ids, labels) for masked training, the same for the same key and seed: of ids that are not special, about `probability` are
        chosen; 80% of those become the mask, 10% any id, 10% stay. Labels are -100 where nothing was chosen."""

        def uniform(i: Column, what: int) -> Column:
            return F.pmod(F.xxhash64(key, i, F.lit(seed), F.lit(what)), F.lit(1 << 30)) / float(1 << 30)

        chosen = lambda x, i: (x >= len(SPECIAL)) & (uniform(i, 0) < probability)
        random_id = lambda i: F.pmod(F.xxhash64(key, i, F.lit(seed), F.lit(2)), F.lit(self.size)).cast("int")
        new = lambda x, i: F.when(~chosen(x, i), x).when(uniform(i, 1) < 0.8, F.lit(MASK)).when(uniform(i, 1) < 0.9, random_id(i)).otherwise(x)
        labels = lambda x, i: F.when(chosen(x, i), x).otherwise(F.lit(-100))
        return F.struct(F.transform(ids, new).alias("ids"), F.transform(ids, labels).alias("labels"))


def tokenize(text: Column) -> Column:
    """Words where there is a space, else characters."""
    return F.when(F.contains(text, F.lit(" ")), F.filter(F.split(text, r"\s+"), lambda x: x != "")).otherwise(F.filter(F.split(text, ""), lambda x: x != ""))
