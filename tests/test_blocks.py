"""Scatter matrices, centred components and two-way reductions against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import blocks


def pca(x, k):
    """Scores of the k principal components."""
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    return u[:, :k] * s[:k]


def same(a, b):
    """Equal up to the signs of columns."""
    a, b = np.array(a), np.array(b)
    assert a.shape == b.shape
    for k in range(a.shape[1]):
        assert np.allclose(a[:, k], b[:, k], atol=1e-7) or np.allclose(a[:, k], -b[:, k], atol=1e-7)


@pytest.fixture(scope="module")
def matrix(spark):
    x = np.random.default_rng(3).normal(0, 1, (60, 24)) * np.linspace(3, 0.2, 24) + 1000
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "i int, v array<double>").repartition(5)


def test_scatter(matrix):
    x, df = matrix
    got = {(r.i, r.j): r.value for r in blocks.scatter(df, "v").collect()}
    want = np.cov(x.T) * 59
    assert all(abs(got[i, j] - want[i, j]) < 1e-7 for i in range(24) for j in range(24))


def test_centred_components(matrix):
    x, df = matrix
    rows = {r.i: r.reduced for r in blocks.centred_pca(df, "v", 5).collect()}
    assert rows.pop(99) is None
    same([rows[i] for i in range(60)], pca(x, 5))


@pytest.mark.parametrize("n_blocks", [1, 3])
def test_rows_then_columns(matrix, n_blocks):
    x, df = matrix
    width = 24 // n_blocks
    want = np.hstack([pca(pca(x[:, k * width : (k + 1) * width], 6).T, 4) for k in range(n_blocks)])
    got = sorted(blocks.reduce_blocks(df, "v", 6, 4, n_blocks).collect(), key=lambda r: r.place)
    same([r.vector for r in got], want)


def test_by_an_actual_transposition(matrix):
    """The same as both reductions carried out one after the other on tables."""
    x, df = matrix
    first = blocks.centred_pca(df.where("v IS NOT NULL"), "v", 6).select("i", "reduced")
    turned = blocks.transpose(first, "i", "reduced")
    assert turned.count() == 6
    second = sorted(blocks.centred_pca(turned, "vector", 4).collect(), key=lambda r: r.place)
    got = sorted(blocks.reduce_blocks(df, "v", 6, 4).collect(), key=lambda r: r.place)
    same([r.reduced for r in second], [r.vector for r in got])


def test_transposition(spark):
    df = spark.createDataFrame([(2, [3, 4]), (1, [1, 2]), (3, None), (4, [5])], "i int, v array<int>")
    assert {r.place: r.vector for r in blocks.transpose(df, "i", "v").collect()} == {0: [1, 3, 5], 1: [2, 4]}


def test_small_and_empty(spark):
    empty = spark.createDataFrame([], "v array<double>")
    assert blocks.reduce_blocks(empty, "v", 3, 2, 2).collect() == []
    assert blocks.centred_pca(empty, "v", 3).collect() == []
    one = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert [r.reduced for r in blocks.centred_pca(one, "v", 1).collect()] == [[0.0]]
    with pytest.raises(ValueError, match="equal blocks"):
        blocks.moments(one, "v", 3)
    assert one.select(F.size("v")).first()[0] == 2
