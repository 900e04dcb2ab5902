"""Sentences cut by rules that are learned from a corpus: which words are abbreviations, and which begin sentences.

Learning follows Kiss and Strunk (2006). A word that stands before a full stop far more often than chance has it, is short, and seldom stands without one, is an
abbreviation; the measure is a log-likelihood ratio, scaled. A word that follows a sentence's end more often than chance has it begins sentences. All counts are
Spark aggregates over the whole corpus; equal tokens are counted first, so that what a token is like is found out once for each different one. The rules, few by
nature, are then applied text by text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import stored

OPENING, CLOSING = "\"'([{«“‘„", "\"')]}»”’"
#: Scores from which a word is an abbreviation, and begins sentences.
ABBREVIATION, STARTER = 0.3, 30.0
#: Rules of each kind, at most.
MOST_RULES = 1 << 17
#: Chance of a full stop after an abbreviation.
NEARLY_ALWAYS = 0.99

TOKEN = re.compile(r"\S+")
#: Marks at the end of a token that isn't the last, and what may close after them.
ENDS = re.compile(rf"([.!?؟…]+)[{re.escape(CLOSING)}]*(?=\s)")
NUMBER = re.compile(r"^[-+]?\d[\d.,]*$")
ARABIC_QUESTION = re.compile("([^؟]+(?:؟|$)) ?")


def _bare(token: Column) -> Column:
    """Without brackets, quotes and commas around."""
    return F.regexp_replace(token, f"^[{re.escape(OPENING)}]+|[,;:{re.escape(CLOSING)}]+$", "")


def _kind(bare: Column) -> Column:
    """Lower case, one full stop or other marks at the end cut off; numbers are one kind."""
    word = F.regexp_replace(F.lower(bare), "(?<=[^.])\\.$|[!?؟…]+$", "")
    return F.when(word.rlike(NUMBER.pattern), "##").otherwise(word)


def _stopped(bare: Column) -> Column:
    return bare.rlike("[^.]\\.$")


def _tokens(text: str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\s+")


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """token and n of all different tokens, computed once."""
    every = texts.select(F.explode(_tokens(text)).alias("token")).where("token <> ''")
    return stored(every.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "tokens")


def stop_counts(texts: DataFrame, text: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    """word, with_stop, without: how often each kind of word stands before a full stop and not. tokens: token_counts of the texts, if there are any."""
    tokens = token_counts(texts, text) if tokens is None else tokens
    bare = tokens.select(_bare(F.col("token")).alias("b"), "n")
    kinds = bare.select(_kind(F.col("b")).alias("word"), _stopped(F.col("b")).alias("s"), "n").where("word <> ''")
    return kinds.groupBy("word").agg(F.sum(F.when(F.col("s"), F.col("n")).otherwise(0)).alias("with_stop"), F.sum(F.when(F.col("s"), 0).otherwise(F.col("n"))).alias("without"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """counts with score, for the words that stand before a full stop at all and have a letter."""
    total = counts.agg(F.sum("with_stop").alias("stops"), F.sum(F.col("with_stop") + F.col("without")).alias("all"))
    rows = counts.where(F.col("with_stop") > 0).where(F.col("word").rlike("\\p{L}")).crossJoin(total)  # one row
    k, n = F.col("with_stop").cast("double"), (F.col("with_stop") + F.col("without")).cast("double")
    p = F.col("stops") / F.col("all")
    usual = k * F.ln(p) + F.when(n > k, (n - k) * F.ln(1 - p)).otherwise(0.0)
    always = k * F.ln(F.lit(NEARLY_ALWAYS)) + (n - k) * F.ln(F.lit(1 - NEARLY_ALWAYS))
    inner = F.char_length("word") - F.char_length(F.replace("word", F.lit(".")))
    letters = (F.char_length("word") - inner).cast("double")
    score = -2 * (usual - always) * F.exp(-letters) * (inner + 1) * F.pow(letters, -(n - k))
    return rows.select(*counts.columns, score.alias("score"))


def starter_scores(texts: DataFrame, abbreviations: DataFrame, text: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    """word, at_start, anywhere, score: which words follow the ends of sentences more often than chance has it. tokens: as in stop_counts."""
    tokens = token_counts(texts, text) if tokens is None else tokens
    known = abbreviations.select(F.col("word").alias("before")).distinct().withColumn("short", F.lit(True))

    def ended(rows: DataFrame, token: str) -> DataFrame:
        """rows with before, the token's kind, and whether it ends a sentence."""
        bare = rows.withColumn("b", _bare(F.col(token))).withColumn("before", _kind(F.col("b"))).join(known, "before", "left")
        stop = _stopped(F.col("b")) & F.col("short").isNull() & (F.col("before") != "##") & (F.char_length("before") > 1)
        return bare.withColumn("ends", F.col("b").rlike("[!?؟]$") | stop)

    listed = texts.select(F.filter(_tokens(text), lambda x: x != "").alias("t"))
    pairs = listed.select(F.explode(F.arrays_zip(F.col("t").alias("x"), F.expr("slice(t, 2, greatest(size(t) - 1, 0))").alias("y"))).alias("p")).select("p.x", "p.y")
    # what can't be an end and a name is left out before it is looked at closely
    likely = pairs.where(F.col("x").rlike(f"[.!?؟][,;:{re.escape(CLOSING)}]*$") & F.col("y").rlike(f"^[{re.escape(OPENING)}]*\\p{{Lu}}"))
    named = likely.withColumn("name", _bare(F.col("y"))).where(F.col("name").rlike("^\\p{Lu}\\p{L}*$|^\\p{Lu}\\p{L}*[.,;:!?]$"))
    starts = ended(named, "x").where("ends").groupBy(_kind(F.col("name")).alias("word")).agg(F.count(F.lit(1)).alias("at_start"))
    met = ended(tokens, "token")
    anywhere = met.groupBy("before").agg(F.sum("n").alias("anywhere")).withColumnRenamed("before", "word")
    total = met.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("ends"), F.col("n")).otherwise(0)).alias("ends"))
    rows = starts.join(anywhere, "word").where(F.char_length("word") > 1).crossJoin(total)  # one row
    a, b, ab, n = F.col("ends").cast("double"), F.greatest("anywhere", "at_start").cast("double"), F.col("at_start").cast("double"), F.col("all").cast("double")
    cell = [ab, a - ab, b - ab, n - a - b + ab]  # of the two-by-two table
    ratio = 2 * (sum((_xlogx(x) for x in cell), F.lit(0.0)) + _xlogx(n) - _xlogx(a) - _xlogx(n - a) - _xlogx(b) - _xlogx(n - b))
    oftener = ab / a > b / n
    return rows.select("word", "at_start", "anywhere", F.when(oftener, ratio).otherwise(0.0).alias("score"))


@dataclass(frozen=True)
class Rules:
    abbreviations: frozenset[str] = field(default_factory=frozenset)
    starters: frozenset[str] = field(default_factory=frozenset)


def learn(texts: DataFrame, text: str = "text", known: list[str] | None = None) -> Rules:
    """Rules of a corpus; known abbreviations (lower case, without their last full stop) are added."""

    def taken(scores: DataFrame, least: float) -> frozenset[str]:
        rows = scores.where(F.col("score") >= least).select("word").limit(MOST_RULES + 1).collect()
        if len(rows) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        return frozenset(r.word for r in rows)

    tokens = token_counts(texts, text)
    short = taken(abbreviation_scores(stop_counts(texts, text, tokens)), ABBREVIATION) | frozenset(known or [])
    as_table = texts.sparkSession.createDataFrame([(x,) for x in sorted(short)], "word string")
    return Rules(short, taken(starter_scores(texts, as_table, text, tokens), STARTER))


def word_kind(token: str) -> str:
    """The kind of a token, as in counting."""
    bare = token.lstrip(OPENING).rstrip(",;:" + CLOSING).lower()
    stopped = len(bare) > 1 and bare[-1] == "." != bare[-2]
    bare = bare[:-1] if stopped else bare.rstrip("!?؟…")
    return "##" if NUMBER.match(bare) else bare


def cut(text: str, rules: Rules, language: str = "") -> list[str]:
    """The sentences of a text, without the white space between them."""
    first = TOKEN.search(text)
    if not first:
        return []
    out, start = [], first.start()

    def token(end: int) -> str:
        at = end
        while at > start and not text[at - 1].isspace():
            at -= 1
        return text[at:end]

    def begins(following: str) -> bool:
        return following.lstrip(OPENING)[:1].isupper() and word_kind(following) in rules.starters

    for m in ENDS.finditer(text):  # tokens without such marks end nothing
        following = TOKEN.search(text, m.end())
        if not following:
            break
        marks = m[1]
        if marks == ".":
            kind = word_kind(token(m.end()))
            if (kind in rules.abbreviations or kind == "##" or len(kind) == 1 and kind.isalpha()) and not begins(following.group()):
                continue
        elif set(marks) <= {".", "…"} and not begins(following.group()):
            continue
        out.append(text[start : m.end()])
        start = following.start()
    out.append(text[start:].rstrip())
    if language == "arabic":
        out = [x for s in out for x in ARABIC_QUESTION.findall(s)]
    return out


def cut_sentences(text: Column, rules: Rules, language: str = "") -> Column:
    """cut as a column of arrays; null stays null."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: cut(x, rules, language), na_action="ignore")

    return run(text)
