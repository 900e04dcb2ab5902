import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import make
from wordloom.llm import substring_dedup as module
from wordloom.llm.substring_dedup import decode, encode, substring_dedup


def brute(rows, width):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for k in range(len(w) - width + 1):
                g = tuple(w[k : k + width])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        if d is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < d:
                    gone[k : k + width] = [True] * width
        out.append((str(d), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def got(docs, width):
    rows = substring_dedup(docs, width).collect()
    for r in rows:
        assert r.n_removed == sum(x.stop - x.start for x in r.removed)
        assert all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))  # maximal intervals
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in rows)


@pytest.mark.parametrize(("name", "width"), [("corpus", 4), ("corpus", 13), ("edge", 2), ("edge", 13), ("empty", 13)])
def test_brute_force(name, width, request):
    docs = request.getfixturevalue(name)
    assert got(docs, width) == brute([(r.doc_id, r.text) for r in docs.collect()], width)


def test_many_blocks_buckets_and_groups(corpus, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_BYTES", 500)
    monkeypatch.setattr(module, "BUCKET_WINDOWS", 100)
    monkeypatch.setattr(module, "GROUP_BYTES", 1000)
    assert got(corpus, 4) == brute([(r.doc_id, r.text) for r in corpus.collect()], 4)


def test_hashes_that_collide(corpus, monkeypatch):
    """With so few values of the hash that deals windows, the check keeps them apart."""

    def weak(words, width):
        return module.rolling(words, width) & np.uint64((1 << 16) - 1), (module.rolling(words, width, module.CHECK_BASE) >> np.uint64(48)).astype(np.uint16)

    monkeypatch.setattr(module, "both_hashes", weak)
    monkeypatch.setattr(module, "BLOCK_BYTES", 500)
    assert got(corpus, 4) == brute([(r.doc_id, r.text) for r in corpus.collect()], 4)


def test_rows_without_an_id_spread(spark, monkeypatch):
    monkeypatch.setattr(module, "GROUP_BYTES", 100)
    docs = make(spark, [(None, "the same text of some words")] * 40)
    out = substring_dedup(docs, 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 40
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.doc_id, r.n_removed, r.kept) for r in out.collect()} == {(None, 0, "the same text of some words")}


def test_in_order():
    h, c = np.array([5, 3, 5, 5, 3], np.uint64), np.array([1, 9, 0, 1, 9], np.uint16)
    order, starts = module.in_order(h, c)
    assert (order.tolist(), starts.tolist()) == ([1, 4, 2, 0, 3], [0, 2, 3])
    assert [x.tolist() for x in module.in_order(h[:0], c[:0])] == [[], []]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 4)), min_size=1), st.lists(st.integers(-(2**63), 2**63 - 1), min_size=5, max_size=5, unique=True))
def test_coding_round_trip(entries, ids):
    entries, ids = sorted(entries), sorted(ids)
    h, d = np.array([x for x, _ in entries], np.uint64), np.array([x for _, x in entries])
    a, b = decode(encode(h, d, np.array(ids, np.int64)))
    assert a.tolist() == h.tolist()
    assert b.tolist() == [ids[i] for i in d]
