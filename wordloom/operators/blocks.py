"""Matrices as tables of rows: scatter matrices, centred principal components, transposition, and the reduction of blocks in both directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, vector: str, blocks: int = 1) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each of so many equal parts of the vectors: rows, sum, and scatter matrix around the mean. Tasks add up their rows, so only matrices of a
    part's width travel; sums are taken around the first row, so that a large mean costs no digits. Null vectors don't count; others are of one length."""
    first = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v")).first()
    if first is None:
        return [(0, np.zeros(0), np.zeros((0, 0)))] * blocks
    origin = np.asarray(first.v, float)
    width = len(origin) // blocks
    if width * blocks != len(origin):
        raise ValueError(f"{len(origin)} entries don't divide into {blocks} equal blocks")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, np.zeros(len(origin)), np.zeros((blocks, width, width))
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(origin)) - origin
            n += len(x)
            total += x.sum(axis=0)
            for k in range(blocks):
                part = x[:, k * width : (k + 1) * width]
                gram[k] += part.T @ part
        flat = np.concatenate([[float(n)], total, gram.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "x"])

    rows = df.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda a: a.cast("double")).alias("v"))
    got = rows.mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()  # as many numbers as the matrices have
    flat = np.zeros(1 + len(origin) + blocks * width * width)
    flat[got.i] = got.x
    n, total = int(flat[0]), flat[1 : 1 + len(origin)]
    grams = flat[1 + len(origin) :].reshape(blocks, width, width)
    out = []
    for k in range(blocks):
        t = total[k * width : (k + 1) * width]
        out.append((n, t + n * origin[k * width : (k + 1) * width], grams[k] - np.outer(t, t) / n))
    return out


def scatter(df: DataFrame, vector: str) -> DataFrame:
    """i, j, value: the sums of products of the entries' deviations from their means."""
    (_, _, s), spark = moments(df, vector)[0], df.sparkSession
    return spark.createDataFrame(pd.DataFrame([(i, j, float(s[i, j])) for i in range(len(s)) for j in range(len(s))], columns=["i", "j", "value"]), "i int, j int, value double")


def axes(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k strongest axes of a scatter matrix as columns, the largest entry of each positive, and their shares of it."""
    values, vectors = np.linalg.eigh(s)
    vectors = vectors[:, ::-1][:, :k]
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1, 1), np.maximum(values[::-1][:k], 0)


def centred_pca(df: DataFrame, vector: str, k: int, name: str = "reduced") -> DataFrame:
    """df with the k principal components of its vectors' deviations from their mean."""
    n, total, s = moments(df, vector)[0]
    if not n:
        return df.withColumn(name, F.lit(None).cast("array<double>"))
    turn, mean = axes(s, k)[0], total / n

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        there = v.notna().to_numpy()
        scores = iter((np.stack(v[there].tolist()).astype(float) - mean) @ turn if there.any() else [])
        return pd.Series([next(scores) if x else None for x in there])

    return df.withColumn(name, run(F.col(vector)))


def reduce_blocks(df: DataFrame, vector: str, n_row: int, n_col: int, blocks: int = 1) -> DataFrame:
    """place, vector: each of the equal column blocks of the matrix that df's rows make up, reduced by its principal components to n_row columns, and then, as
    columns are turned to rows, those to n_col; the blocks' results stand side by side.

    The second reduction is of n_row points with an entry for each row of df. Their inner products, around the mean point, are the first reduction's
    variances with rows and columns centred, so neither the reduced rows nor their transposition have to be made. Signs of the result's columns are free;
    here the largest entry is positive.
    """
    parts = []
    for n, _, s in moments(df, vector, blocks):
        k = min(n_row, len(s), n)
        centre = np.eye(k) - 1 / max(k, 1)
        turn, strength = axes(centre @ np.diag(axes(s, k)[1]) @ centre, n_col) if k else (np.zeros((0, 0)), np.zeros(0))
        parts.append(turn * np.sqrt(strength))
    whole = np.hstack(parts)
    return df.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(whole)], "place int, vector array<double>")


def transpose(df: DataFrame, order: str, vector: str) -> DataFrame:
    """place, vector: the columns of the matrix whose rows are df's vectors by order; cells are regrouped by their column. A null vector leaves no cells."""
    cells = df.select(F.col(order).alias("o"), F.posexplode(vector).alias("place", "x"))
    columns = cells.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("o", "x"))).alias("c"))  # a result row's own entries
    return columns.select("place", F.transform("c", lambda c: c["x"]).alias("vector"))
