import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import make
from wordloom.llm.common import WordHash
from wordloom.llm.quality import base_numbers, quality_rules


def brute_numbers(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.append(line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    again = set()
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            again |= set(range(k, k + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t#|日", max_size=80))
def test_base_numbers(text):
    raw = text.encode()
    assert base_numbers(raw, raw.split(), WordHash().of(raw.split())) == brute_numbers(text)


def rows_and_labels(n=400):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randint(30, 80))
        good = i % 3 > 0
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w] if i % 2 else [x for y in w for x in (y, "|")])))
        if i % 4 < 2:
            labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = rows_and_labels()
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (99999, 0)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules(make(spark, rows), table).collect()}
    known = {d for d, _ in labels}
    unseen = [r for d, r in out.items() if d not in known and not r.base_failed]
    right = sum(r.kept == (r.doc_id % 3 > 0) for r in unseen)
    assert len(unseen) > 100
    assert right / len(unseen) > 0.97
    assert all(0 <= r.probability <= 1 for r in unseen)
    sure = [r for r in unseen if r.probability > 0.8]
    assert sum(r.doc_id % 3 > 0 for r in sure) / len(sure) > 0.9  # calibrated


@pytest.mark.parametrize("labels", [[], [(4, 1), (9, 1)], [(4, 1), (8, 0)]])
def test_edges(edge, spark, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words if r.n_words < 99 else -1)) for r in quality_rules(edge, table).collect())
    want = []
    for r in edge.collect():
        short = len(r.text or "") < 9999
        n = brute_numbers(r.text or "") if short else (30000, sum(map(len, r.text.split())), 0, 0, -1)
        want.append(str((r.doc_id, *n)))
    assert got == sorted(want)
    for r in quality_rules(edge, table).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_empty_table(empty, spark):
    assert quality_rules(empty, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).collect() == []
