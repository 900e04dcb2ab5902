import numpy as np
import pytest

from tests.llm.conftest import make
from wordloom.llm.decontaminate import decontaminate, intersect, nearby, words


def brute(rows, items, width):
    grams = {}
    for item, text in items:
        w = words((text or "").encode())
        if item is not None and w:
            for k in range(max(1, len(w) - width + 1)):
                grams.setdefault(tuple(w[k : k + width]), set()).add(item)
    out = []
    for doc, text in rows:
        w = words((text or "").encode())
        hit, found = [False] * len(w), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    found |= grams[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        out.append((str(doc), len(w), sum(hit), sorted(found)))
    return sorted(out)


def got(docs, bench, **more):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, bench, **more).collect())


@pytest.fixture(scope="module")
def items(corpus):
    texts = [r.text for r in corpus.orderBy("doc_id").collect()]
    w = " ".join(texts).split()
    return [(1, " ".join(w[40:70])), (2, " ".join(w[300:304]).upper()), (3, "not there at all, ever"), (4, None), (5, "... !"), (None, texts[0]), (6, " ".join(w[40:52])), (6, " ".join(w[40:52])), (7, "a")]


@pytest.fixture(scope="module")
def bench(spark, items):
    return spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, n_hit string")


def test_words():
    assert words("Né-E9 日本;x_Y\x7fz".encode()) == ["né".encode(), b"e9", "日本".encode(), b"x", b"y", b"z"]


def test_brute_force(corpus, bench, items):
    want = brute([(r.doc_id, r.text) for r in corpus.collect()], items, 5)
    assert any(x[3] for x in want)
    assert got(corpus, bench, width=5, slop=0) == want
    assert got(corpus, bench, width=5, slop=2) == want


def test_test_set_in_blocks(corpus, bench):
    assert got(corpus, bench, width=5, bench_bytes=60) == got(corpus, bench, width=5)


@pytest.mark.parametrize("name", ["edge", "empty"])
def test_edges(name, request, bench, items, spark):
    docs = request.getfixturevalue(name)
    more = [*items, (8, "w5 w6 w7 w8 w9 w10 w11")]
    table = spark.createDataFrame(more, "item_id long, text string")
    assert got(docs, table, width=5) == brute([(r.doc_id, r.text) for r in docs.collect()], more, 5)
    assert got(docs, table.limit(0), width=5) == brute([(r.doc_id, r.text) for r in docs.collect()], [], 5)


def test_proximity(spark):
    docs = make(spark, [(1, "p q a b c d r"), (2, "p a b x c d r"), (3, "a q q q q q b c d")])
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    rows = {r.doc_id: (r["items"], r.near_items) for r in decontaminate(docs, bench, width=4, slop=1).collect()}
    assert rows == {1: ([1], []), 2: ([], [1]), 3: ([], [])}


def test_proximity_belongs_to_the_document_of_its_words(spark):
    """Matches at the edges of neighbouring documents of one shard, in any order of the words."""
    docs = make(spark, [(1, "x y z"), (2, "b a c"), (3, "d e a b"), (4, "c d"), (5, "c b a d")]).coalesce(1)
    bench = spark.createDataFrame([(1, "a b c"), (2, "b a c d"), (3, "a b c d")], "item_id long, text string")
    want = {}
    for doc, text in [(1, "x y z"), (2, "b a c"), (3, "d e a b"), (4, "c d"), (5, "c b a d")]:
        w = text.split()
        near, exact = set(), set()
        for item, phrase in ((1, "a b c"), (2, "b a c d"), (3, "a b c d")):
            g = phrase.split()
            for s in range(len(w)):
                if w[s] == g[0] and all(any(w[p] == x for p in range(max(0, s + k - 2), min(len(w), s + k + 3))) for k, x in enumerate(g)):
                    near.add(item)
                if w[s : s + len(g)] == g:
                    exact.add(item)
        want[doc] = (sorted(exact), sorted(near - exact))
    assert any(x[1] for x in want.values())
    assert {r.doc_id: (r["items"], r.near_items) for r in decontaminate(docs, bench, width=4, slop=2).collect()} == want


def test_intersect():
    at = [(2, np.array([7])), (0, np.array([1, 5, 9])), (1, np.array([2, 6]))]
    assert intersect(at).tolist() == [5]
    assert nearby([(1, np.array([4])), (0, np.array([1, 2, 5])), (2, np.array([5, 9]))], 1).tolist() == [2]
