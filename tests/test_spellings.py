"""The spelling queries against brute force, with words of all lengths."""

from itertools import product

import pytest

from wordloom.functions.text import ARABIZI, LEET
from wordloom.operators import morphology
from wordloom.plans.catalogue import QUERIES

TEXT = "at Tactics institutes\nassociates 1a!b a1it $ea5 4tt xyz été"


def documents(spark, path, text=TEXT):
    spark.createDataFrame([(1, text, "fr", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def brute_leet(word):
    every = {"".join(x) for x in product(*[[c, *LEET.get(c, "")] for c in word])}
    return {v for v in every if v != word and not any(a in v and b in v for a, b in ("5$", "1!", "7+", "4@"))}


def test_leet_spellings(spark, tmp_path):
    got = sorted((r.word, r.variant) for r in QUERIES["leet_spellings"](spark, documents(spark, tmp_path)).collect())
    assert got == sorted((w, v) for w in set(TEXT.split()) for v in brute_leet(w.lower()))
    assert sum(w == "institutes" for w, _ in got) > 100


def test_leet_batches(spark):
    df = spark.createDataFrame([("associates",), (None,), ("xyz",), ("at",)], "word string")
    got = sorted((r.word, r.variant) for r in morphology.leet_spellings(df, batch=7).collect())
    assert got == sorted((w, v) for w in ("associates", "at") for v in brute_leet(w))


def brute_closure(word):
    seen, todo = {word}, [word]
    while todo:
        w = todo.pop()
        more = {w.replace(old, new, 1) for old, news in ARABIZI.items() for new in news} - seen
        seen |= more
        todo += more
    return seen - {word}


def test_arabizi_closure(spark, tmp_path):
    """Words above 8 characters, and one that needs more than 12 replacements."""
    words = ["chouk7dq7", "constitutional", "tststytstytsty", "x"]
    got = sorted((r.word, r.variant) for r in QUERIES["arabizi_closure"](spark, documents(spark, tmp_path, " ".join(words))).collect())
    assert got == sorted((w, v) for w in words for v in brute_closure(w))


def test_closure_bound(spark):
    df = spark.createDataFrame([("tststy",)], "word string")
    with pytest.raises(RuntimeError, match="3 rounds"):
        morphology.arabizi_closure(df, rounds=3)
    assert morphology.arabizi_closure(df, rounds=7).count() == len(brute_closure("tststy"))
