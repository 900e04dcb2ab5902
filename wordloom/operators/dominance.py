"""Ordered pairs of weighted points, counted in n log n: what rank correlations need of all pairs without meeting them pair by pair.

Points are cut into ranges of x and into ranges of y. A pair of points falls into one of three kinds: within one range of x, within one range of y
but not of x, or apart in both. The first two are counted range by range, by radix-ordered prefix sums in Arrow batches; pairs that are apart in both
need only the weights of the ranges' meetings, which are far fewer points, counted the same way again. A value at a cut has a range of
its own, whose pairs are ties and so count nothing; thus a value that many points share makes no large range.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import ensure_checkpoint_dir

#: Points that one task counts, and points of a range, about.
ALONE, RANGE = 1 << 18, 1 << 16
MOST_RANGES = 1 << 15


def rising(y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w[i] * w[j] over i < j with y[i] < y[j]; y are small whole numbers. Digit by digit: within those that agree so far, ones after zeros."""
    total = 0.0
    for bit in range(int(y.max(initial=0)).bit_length() - 1, -1, -1):
        one = (y >> bit & 1).astype(bool)
        low = np.where(one, 0.0, w)
        upto = np.cumsum(low)
        group = y >> (bit + 1)
        first = np.r_[True, group[1:] != group[:-1]]
        before = np.repeat((upto - low)[first], np.diff(np.r_[np.flatnonzero(first), len(y)]))
        total += float(w[one] @ (upto - before)[one])
        order = np.argsort(y >> bit, kind="stable")
        y, w = y[order], w[order]
    return total


def signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w[a] * w[b] * sign(y[b] - y[a]) over all pairs with x[a] < x[b]."""
    if len(x) < 2:
        return 0.0
    y = np.unique(y, return_inverse=True)[1].astype(np.int64)
    up, down = np.lexsort((-y, x)), np.lexsort((y, x))  # among equal x no pair rises, nor falls
    return rising(y[up], w[up]) - rising(y.max() - y[down], w[down])


def _counted(parts: DataFrame, by: Column, x: str, y: str) -> DataFrame:
    """s of each group."""

    def count(group: pa.Table) -> pa.Table:
        columns = (group.column(c).to_numpy() for c in ("x", "y", "w"))
        return pa.table({"s": pa.array([signed_pairs(*columns)], pa.float64())})

    return parts.select(by.alias("g"), F.col(x).alias("x"), F.col(y).alias("y"), "w").groupBy("g").applyInArrow(count, "s double")


def _ranged(points: DataFrame, ranges: int) -> DataFrame:
    """points with xr and yr: even numbers for what lies between cuts, odd ones for the cuts' own values."""
    shares = [i / ranges for i in range(1, ranges)]
    got = points.agg(*[F.percentile_approx(c, shares, 20 * ranges).alias(c) for c in ("x", "y")]).first()
    cuts = {c: np.unique(np.array(got[c])) for c in ("x", "y")}

    def number(c: str) -> Column:
        @F.pandas_udf("int")
        def run(values: pd.Series) -> pd.Series:
            v = values.to_numpy()
            at = np.searchsorted(cuts[c], v, side="left")
            return pd.Series(2 * at + (cuts[c][np.minimum(at, len(cuts[c]) - 1)] == v))

        return run(F.col(c))

    return points.withColumns({"xr": number("x"), "yr": number("y")})


def signed_sum(points: DataFrame) -> float:
    """Sum of w_a * w_b * sign(y_b - y_a) over all pairs with x_a < x_b. points: numbers x and y without nulls or NaN, weights w; each (x, y) once."""
    ensure_checkpoint_dir(points.sparkSession)
    total = 0.0
    while True:
        n = points.count()
        if n <= ALONE:
            return total + sum(r.s for r in _counted(points, F.lit(0), "x", "y").collect())
        coded = _ranged(points, max(2, min(MOST_RANGES, math.ceil(n / RANGE), math.isqrt(n) // 4))).checkpoint()
        within = _counted(coded.where("xr % 2 = 0"), F.col("xr"), "x", "y").union(_counted(coded.where("yr % 2 = 0"), F.col("yr"), "xr", "y"))
        total += within.agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]
        points = coded.groupBy(F.col("xr").alias("x"), F.col("yr").alias("y")).agg(F.sum("w").alias("w")).checkpoint()
