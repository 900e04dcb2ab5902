from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import make
from wordloom.llm.common import UPPER_TO_LOWER, connected_components
from wordloom.llm.ngram_join import ngram_jaccard


def brute(rows, width, num):
    sets = []
    for d, t in rows:
        w = (t or "").encode().translate(UPPER_TO_LOWER).split()
        sets.append((d, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(k)
    common = Counter()
    for members in by.values():
        for i, a in enumerate(members):
            for b in members[:i]:
                common[b, a] += 1
    for (a, b), n in common.items():
        (x, s), (y, t) = sets[a], sets[b]
        if x is not None and y is not None and 100 * n >= num * (len(s) + len(t) - n):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    return sorted((str(d), len(s), str(find(d) if d is not None else None)) for d, s in sets)


def got(docs, width, num):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard(docs, width, num).collect())


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 60)])
def test_brute_force(corpus, width, num):
    want = brute([(r.doc_id, r.text) for r in corpus.collect()], width, num)
    assert len({x[2] for x in want}) < len(want)
    assert got(corpus, width, num) == want


@pytest.mark.parametrize("name", ["edge", "empty"])
def test_edges(name, request):
    docs = request.getfixturevalue(name)
    assert got(docs, 3, 90) == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 90)


def test_rows_without_an_id_follow_equal_texts(spark):
    docs = make(spark, [(5, "a b c d"), (None, "A b c d"), (3, "a b c d")])
    assert got(docs, 3, 90) == sorted([("5", 2, "3"), ("None", 2, "3"), ("3", 2, "3")])


def test_chain_of_near_copies_across_a_bucket(spark):
    """A chain whose ends do not link: the components need the links between members, not only those to a centre."""
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(12):
        w = list(base)
        w[: 2 * k] = [f"c{i}" for i in range(2 * k)]
        rows.append((k, " ".join(w)))
    docs = make(spark, rows[::-1])
    want = brute(rows, 3, 90)
    assert got(docs, 3, 90) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (200, 150), (150, 200)]
    rows = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert dict(rows) == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars already are written once: no round of joins shows that nothing changes."""
    written = []
    monkeypatch.setattr("wordloom.llm.common.materialise", lambda df, label: written.append(label) or df.localCheckpoint())
    edges = [(5, 1), (1, 6), (7, 1), (9, 8), (3, 3)]
    rows = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.component) for r in rows) == [(1, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 8)]
    assert written == ["edges"]
