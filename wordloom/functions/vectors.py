"""Vector expressions over array columns; sums are in double precision, element by element in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return _fold(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column, floor: float = 0.0) -> Column:
    """Cosine similarity; each norm counts as floor at least. Null where a norm is 0."""
    bottom = F.greatest(norm(x), F.lit(floor)) * F.greatest(norm(y), F.lit(floor))
    return F.when(bottom > 0, dot(x, y) / bottom)


def euclid(x: Column, y: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))))


def add(x: Column, *more: Column) -> Column:
    for y in more:
        x = F.zip_with(x, y, lambda a, b: a.cast("double") + b.cast("double"))
    return x


def multiply(x: Column, *more: Column) -> Column:
    for y in more:
        x = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return x


def scale(x: Column, by: Column | float) -> Column:
    return F.transform(x, lambda a: a.cast("double") * by)


def power(x: Column, exponent: Column | float) -> Column:
    return F.transform(x, lambda a: F.pow(a.cast("double"), F.lit(exponent)))


def argmax(x: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def binary_decision(logit: Column) -> Column:
    """1 where the logistic function of the logit exceeds one half."""
    return (logit > 0).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(x: Column) -> Column:
    top = F.array_max(x).cast("double")
    e = F.transform(x, lambda a: F.exp(a.cast("double") - top))
    return F.transform(e, lambda a: a / _fold(e))


def mean_tokens(tokens: Column, first: int = 1, drop_last: bool = True) -> Column:
    """Mean of an array of vectors from position first on (0: all), without the last where drop_last."""
    n = F.size(tokens) - first - (1 if drop_last else 0)
    kept = F.slice(tokens, F.lit(first + 1), n)
    total = F.aggregate(F.slice(kept, F.lit(2), n), F.transform(F.element_at(kept, 1), lambda a: a.cast("double")), lambda a, b: add(a, b))
    return F.when(n > 0, F.transform(total, lambda a: a / n))


def word_starts(pieces: Column, style: str = "##") -> Column:
    """Booleans: does a piece begin a word? style '##': continuations begin with ##; '</w>': the piece before ends with </w>;
    'space': pieces begin with a space mark. Special pieces ([...] and <...>) never do."""
    special = lambda x: x.rlike(r"^(\[[A-Z]+\]|</?s>|<[a-z]+>)$")
    if style == "##":
        return F.transform(pieces, lambda x: ~special(x) & ~F.startswith(x, F.lit("##")))
    if style == "space":
        return F.transform(pieces, lambda x: ~special(x) & F.substring(x, 1, 1).isin("▁", "Ġ"))
    if style == "</w>":
        before = lambda i: F.try_element_at(pieces, F.greatest(i, F.lit(1)))
        return F.transform(pieces, lambda x, i: ~special(x) & ((i == 0) | special(before(i)) | F.endswith(before(i), F.lit("</w>"))))
    raise ValueError(style)
