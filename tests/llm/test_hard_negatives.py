"""Hard negatives against all products, on rows with ties, repeats, odd components and several lengths."""

import math
import random

import pytest
from pyspark.sql import functions as F

import wordloom.llm.hard_negatives as H
from wordloom.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q string, score string, h string, anchor string, p string, rank string, i string, j string"


def make(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA)


def brute(rows, every, positives=5, negatives=10):
    once = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            once[i, label, tuple(math.floor(256 * x) for x in v)] = None
    out = []
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for a, la, u in once:
        if a is None or a % every:
            continue
        scored = [(b, sum(x * y for x, y in zip(u, v, strict=True)), lb == la) for b, lb, v in once if len(u) == len(v) and b != a]
        for p, ps, _ in sorted((x for x in scored if x[2]), key=order)[:positives]:
            fit = sorted((x for x in scored if not x[2] and 30 * ps <= 100 * x[1] <= 90 * ps), key=order)[:negatives]
            out += [(a, p, k, b, ps, bs) for k, (b, bs, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors(n, d, seed, decay=0.7):
    rng = random.Random(seed)
    hot = [rng.gauss(0.3, 1) for _ in range(d)]
    rows = []
    for i in range(n):
        v = hot if i % 3 == 0 else [rng.gauss(0.3, 1) * decay**k for k in range(d)]
        rows.append((i, [float(f"{x:.3f}") for x in v], rng.randrange(3)))
    return rows


@pytest.mark.parametrize("d,decay", [(5, 1.0), (40, 0.8), (40, 1.0)])
def test_agrees_with_all_products(spark, monkeypatch, d, decay):
    monkeypatch.setattr(H, "FEW_ROWS", 40)
    rows = vectors(300, d, d, decay)
    rows = [(i, [F32(x) for x in v], y) for i, v, y in rows]
    want = brute(rows, 10)
    assert want
    assert got(hard_negatives(make(spark, rows), F.col("vec_id") % 10 == 0)) == want


def F32(x):
    import numpy as np

    return float(np.float32(x))


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(H, "TILE_BYTES", 8 * 6 * 20)  # twenty rows a slice
    rows = [(i, [F32(x) for x in v], y) for i, v, y in vectors(120, 6, 9)]
    assert got(hard_negatives(make(spark, rows), F.col("vec_id") % 4 == 0)) == brute(rows, 4)


def test_odd_rows(spark):
    rows = [(i, [0.5, 0.25 * (i % 5), -0.125], i % 2) for i in range(40)]
    rows += [(0, None, 1), (10, [1.0, 2.0], 0), (20, [1.0, 1.5], 0), (21, [1.0, 0.5], 1), (22, [0.5, 0.5], 1)]  # another length
    rows += [(30, [], 0), (31, [], 0), (32, [], 1), (50, [1.0, None, 1.0], 0), (60, [float("nan"), 1.0, 1.0], 0), (70, [float("inf"), 1.0, 1.0], 0), (80, [1.0, 1.0, 1.0], None)]
    rows += [(3, [0.5, 0.75, -0.125], 1), (3, [0.5, 0.75, -0.125], 1), (3, [0.5, 0.7, -0.125], 0), (None, [0.5, 0.5, 0.5], 1), (None, [0.5, 0.5, 0.5], 0), (90, [0.0, 0.0, 0.0], 0), (91, [-1.0, -1.0, -1.0], 0)]
    rows = [(i, None if v is None else [None if x is None else F32(x) for x in v], y) for i, v, y in rows]
    assert got(hard_negatives(make(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows, 10)


def test_large_values_are_exact(spark):
    rows = [(i, [6e6 + i, 4e6 - 7 * i, 1.0], i % 2) for i in range(30)]
    schema = "vec_id long, embedding array<double>, label int"
    assert got(hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0, high=100)) == sorted(
        {x for x in brute_share(rows)}, key=str
    )


def brute_share(rows):
    q = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows]
    order = lambda x: (-x[1], x[0])
    for a, u, la in q:
        if a % 10 == 0:
            scored = [(b, sum(x * y for x, y in zip(u, v, strict=True)), lb == la) for b, v, lb in q if b != a]
            for p, ps, _ in sorted((x for x in scored if x[2]), key=order)[:5]:
                fit = sorted((x for x in scored if not x[2] and 30 * ps <= 100 * x[1] <= 100 * ps), key=order)[:10]
                yield from ((a, p, k, b, ps, bs) for k, (b, bs, _) in enumerate(fit, 1))


def test_empty_tables_and_no_anchors(spark):
    assert got(hard_negatives(make(spark, []), F.col("vec_id") % 10 == 0)) == []
    assert got(hard_negatives(make(spark, [(1, [1.0], 0), (2, [1.0], 1)]), F.col("vec_id") % 10 == 0)) == []
    assert hard_negatives(make(spark, []), F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
