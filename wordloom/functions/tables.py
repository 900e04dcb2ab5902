"""Table functions for SQL: the vocabulary tokenizer, its counts, and conversations read in order. `register` adds them to a session."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import MAX_WORD_SIZE, WORD_ENTITIES

TAGS = frozenset(name for _, name in WORD_ENTITIES)
BLANKS = re.compile("[ \t]+")
#: Different parts of words that a task counts before it hands its counts on.
HELD = 1 << 17


class Stemmer:
    """The longest suffix goes first, then the longest prefix of what is left."""

    def __init__(self, prefixes: list[str] | None, suffixes: list[str] | None):
        longest = lambda x: sorted({a for a in x or [] if a}, key=lambda a: (-len(a), a))
        self.prefixes, self.suffixes = longest(prefixes), longest(suffixes)

    def stem(self, word: str) -> tuple[str, str, str]:
        suffix = next((a for a in self.suffixes if word.endswith(a)), "")
        rest = word[: len(word) - len(suffix)]
        prefix = next((a for a in self.prefixes if rest.startswith(a)), "")
        return prefix, rest[len(prefix) :], suffix


def stems(text: str | None, stemmer: Stemmer, double_tags: bool) -> Iterator[tuple[str, str, str]]:
    """prefix, root and suffix of each word; entity tags are roots of their own, which count twice with double_tags."""
    for word in BLANKS.split(text or ""):
        if len(word) > MAX_WORD_SIZE:
            continue
        if word in TAGS:
            yield "", word, ""
            if not double_tags:
                continue
        yield stemmer.stem(word)


class _Prepared:
    """The stemmer of the lists that a call names, made once."""

    def __init__(self) -> None:
        self.lists: tuple | None = None

    def stemmer(self, prefixes: list[str] | None, suffixes: list[str] | None) -> Stemmer:
        if self.lists != (prefixes, suffixes):
            self.lists = (prefixes, suffixes)
            self.made = Stemmer(prefixes, suffixes)
        return self.made


@F.udtf(returnType="prefix string, root string, suffix string")
class VocabWords:
    """vocab_words(text, prefixes, suffixes, double_tags): a row a word."""

    def __init__(self) -> None:
        self.prepared = _Prepared()

    def eval(self, text: str, prefixes: list[str], suffixes: list[str], double_tags: bool = False) -> Iterator[tuple[str, str, str]]:
        yield from stems(text, self.prepared.stemmer(prefixes, suffixes), double_tags)


@F.udtf(returnType="kind string, token string, freq bigint")
class VocabCounts:
    """vocab_counts(TABLE(...), prefixes, suffixes, double_tags): counts of the parts of the words of a column text, combined within a task up to HELD
    different ones; their sums by kind and token are the frequencies."""

    def __init__(self) -> None:
        self.prepared, self.counts = _Prepared(), Counter()

    def eval(self, row: Row, prefixes: list[str], suffixes: list[str], double_tags: bool = False) -> Iterator[tuple[str, str, int]]:
        stemmer = self.prepared.stemmer(prefixes, suffixes)
        for parts in stems(row["text"], stemmer, double_tags):
            for kind, token in zip(("prefix", "root", "suffix"), parts, strict=True):
                if token:
                    self.counts[kind, token] += 1
        if len(self.counts) >= HELD:
            yield from self.terminate()

    def terminate(self) -> Iterator[tuple[str, str, int]]:
        for (kind, token), n in self.counts.items():
            yield kind, token, n
        self.counts = Counter()


@F.udtf(returnType="conv_id bigint, turn bigint, role string, words bigint, words_so_far bigint, after string")
class Turns:
    """turns(TABLE(...) PARTITION BY conv_id ORDER BY turn): each turn with its words, those of the conversation so far, and the role that spoke before."""

    def __init__(self) -> None:
        self.words, self.before = 0, None

    def eval(self, row: Row) -> Iterator[tuple]:
        n = len((row["text"] or "").split(" "))
        self.words += n
        yield row["conv_id"], row["turn"], row["role"], n, self.words, self.before
        self.before = row["role"]


def register(spark: SparkSession) -> None:
    """vocab_words, vocab_counts and turns in this session's SQL."""
    for name, f in (("vocab_words", VocabWords), ("vocab_counts", VocabCounts), ("turns", Turns)):
        spark.udtf.register(name, f)
