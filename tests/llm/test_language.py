import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest

from tests.llm.conftest import make
from wordloom.llm.language import MARK, Lattice, Model, identify, learn, train, RUNS, letters

VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, pieces, p):
    """Sum over all segmentations, by trying all cuts."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[at:k])
                at = k
        value = 1.0
        for x in parts:
            value *= p[pieces.index(x)] if x in pieces else p[-1] if len(x) == 1 else 0.0
        total += value
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = [MARK, "a", "b", MARK + "a", "ab", "ba", "aba", "bab", MARK + "ab"]
    p = rng.dirichlet(np.ones(len(pieces) + 1), size=2).T
    lattice = Lattice(pieces)
    words = [MARK + "".join(random.Random(k).choices("abc", k=k % 12)) for k in range(40)]
    got = lattice.forward(words, p)
    for i, w in enumerate(words):
        for k in range(2):
            assert math.isclose(got[i, k], math.log(brute(w, pieces, p[:, k])), rel_tol=1e-9)


def test_long_words_stay_in_range():
    lattice = Lattice(["a", "aa"])
    p = np.array([[0.001], [0.002], [0.001]])
    short, long = lattice.forward(["a" * 50, "a" * 5000], p)[:, 0]
    assert math.isclose(long / 5000, short / 50, rel_tol=0.01)


def test_expectation_counts_add_up():
    pieces = [MARK, "a", "b", "ab"]
    lattice = Lattice(pieces)
    p = np.array([0.2, 0.2, 0.2, 0.3, 0.1])
    e = lattice.expected([MARK + "ab"], np.array([2.0]), p)
    whole, cut = 0.2 * 0.3, 0.2 * 0.2 * 0.2
    assert np.allclose(e, [2, 2 * cut / (whole + cut), 2 * cut / (whole + cut), 2 * whole / (whole + cut), 0])


def language_rows(n=120):
    rng = random.Random(4)
    letters = {"xx": "aeioubcd", "yy": "zwkxvqñé"}
    rows = []
    for i in range(n):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, " ".join("".join(rng.choices(letters[lang] + "st", k=rng.randint(2, 7))) for _ in range(rng.randint(3, 40))), lang))
    return rows


def test_held_out_accuracy(spark):
    docs = make(spark, language_rows())
    model = train(docs.where("doc_id < 80"), VOCAB)
    rows = identify(docs.where("doc_id >= 80"), model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) == len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark, edge, empty):
    docs = make(spark, language_rows())
    model = train(docs, VOCAB)
    rows = identify(edge, model).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3))
        assert r.lang_pred in ("xx", "yy", "und")
    assert identify(empty, model).collect() == []
    assert train(empty, VOCAB) is None
    assert {r.lang_pred for r in identify(edge, None).collect()} == {"und"}


def test_model_travels():
    import pickle

    model = learn({"b": {"bb": 2}, "a": {"aa": 3}}, ["a", "b", "aa", "bb"])
    again = pickle.loads(pickle.dumps(model))
    assert isinstance(again, Model)
    assert model.predict(["aa aa", "BB", "1 2"]) == again.predict(["aa aa", "BB", "1 2"])
    assert [x for x, _ in again.predict(["aa aa", "BB", "1 2"])] == ["a", "b", "und"]


@pytest.mark.parametrize("text", ["", "123 !!", " "])
def test_no_letters(text):
    assert learn({"a": {"aa": 1}}, ["a"]).predict([text]) == [("und", 0.0)]


def test_numerals_are_no_letters():
    assert [x for run in RUNS.findall("ab½c ² Ⅷ ② x٣y 日本") for x in letters(run)] == ["ab", "c", "x", "y", "日本"]
    model = learn({"a": {"cat": 3, "w" * 150: 1}, "b": {"dog": 3}}, ["c", "a", "t", "d", "o", "g", "w"])
    assert model.predict(["½ ² Ⅷ ②", "", "12 ."]) == [("und", 0.0)] * 3
    assert model.predict(["cat½cat"]) == model.predict(["cat cat"])
    assert model.predict(["w" * 500])[0][0] == "a"
