import math
from collections import defaultdict

import pytest

from tests.llm.conftest import make
from wordloom.llm.mixing import label_quality, mix_sources


def water(sizes, cap=3):
    """Targets by the rule itself: share, stop at cap times the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    open_, left, out = set(names), sum(sizes.values()), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(rows, want_rows, cap=3):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r, source in rows:
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
        assert 0 <= r.taken <= cap * r.size
    assert len(rows) == want_rows
    for s, want in water(sizes, cap).items():
        assert math.isclose(target[s], want, rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - want) <= 1


def test_targets_and_reruns(spark):
    rows = [(i, "w " * (i % 40), "x", None if i % 11 == 0 else "big" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    docs = make(spark, rows)
    one = sorted(map(tuple, mix_sources(docs).collect()))
    assert one == sorted(map(tuple, mix_sources(docs.repartition(7)).collect()))
    source = {r[0]: r[3] for r in rows}
    check([(r, source[r.doc_id]) for r in mix_sources(docs).collect()], 3000)
    whole = defaultdict(set)  # complete epochs come before the fraction: within a source, counts differ by one epoch at most
    for doc, size, source_size, target, taken in one:
        if size:
            whole[source[doc]] |= {taken // size, -(-taken // size)}
    assert all(max(x) - min(x) <= 1 for x in whole.values())


def test_small_sources_are_capped(spark):
    docs = make(spark, [(1, "a b", "x", "a"), (2, "a " * 1000, "x", "b"), (3, "c", "x", "c"), (4, None, "x", "d")])
    source = {1: "a", 2: "b", 3: "c", 4: "d"}
    rows = mix_sources(docs).collect()
    check([(r, source[r.doc_id]) for r in rows], 4)
    assert {r.doc_id: r.taken for r in rows} == {1: 6, 2: 994, 3: 3, 4: 0}


def test_quality_moves_documents_forward(spark):
    docs = make(spark, [(i, "w " * 10, "x", "ab"[i % 2]) for i in range(4000)])
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(4000)] + [(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    taken = defaultdict(int)
    for r in mix_sources(docs, label_quality(labels)).collect():
        if r.doc_id % 2 == 0:  # source a gets less than its size
            taken[r.doc_id % 4 < 2] += r.taken
    assert taken[True] > 1.3 * taken[False]


@pytest.mark.parametrize("name", ["edge", "empty"])
def test_edges(name, request, spark):
    docs = request.getfixturevalue(name)
    rows = mix_sources(docs, keep=("text", "taken")).collect() if name == "empty" else mix_sources(docs, keep=("text",)).collect()
    check([(r, None) for r in rows], docs.count())
