"""Duplicate rows, keyword filters and set operations on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as X


def keep_last(df: DataFrame, subset: list[str], order: str | Column) -> DataFrame:
    """Of rows that agree in subset, the last by order stays. An aggregate with map-side combination rather than a window: a value
    that a third of all rows share is not sorted in one task. A null order comes before all others; rows of equal order are decided by their other columns
    (those that can be ordered), so that reruns agree."""
    key = F.col(order) if isinstance(order, str) else order
    others = [F.col(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    last = df.groupBy(*subset).agg(F.max_by(F.struct(*df.columns), F.struct(key.isNotNull(), key, *others)).alias("row"))
    return last.select("row.*")


def without_keywords(df: DataFrame, column: str, pattern: str | None) -> DataFrame:
    return df.where(X.without_keywords(F.col(column), pattern))


def concat(parts: list[DataFrame], missing: bool = True) -> DataFrame:
    """All rows of several tables, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), parts)


def union(parts: list[DataFrame]) -> DataFrame:
    return concat(parts).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of left that right does not have."""
    return left.subtract(right)


def index_videos(df: DataFrame, video: DataFrame, on: str = "vid") -> DataFrame:
    """Comments with the columns of their video; the id column goes and the address becomes a link column."""
    return df.join(video, on, "left").drop(on).withColumnRenamed("url", "link")
