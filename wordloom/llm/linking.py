"""From candidate buckets to components, without all pairs of a bucket.

A record belongs to buckets (a shared rare n-gram, an equal band). Two rounds find the components of exactly verified links:

1. every bucket links its members to one centre of its own (a star);
2. where a bucket's members are still in different components, pairs across components are tried, and only those. A parity sketch of
   each record's set (bit i is the parity of the elements that hash to i) is compared inside the join: differing bits never exceed the
   sets' symmetric difference, so the filter loses no pair that links.

Links that stay within one component after round 1 change no component and are not tried.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, small_join

Verify = Callable[[DataFrame], DataFrame]

#: Members of a slice of a large bucket, about.
SLICE = 1 << 12


def parity_sketch(hashes: np.ndarray, words: int) -> list[int]:
    """Bits that an odd number of the (distinct) hashes fall on, as 64-bit integers."""
    bits = np.bincount((hashes >> np.uint64(7)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def differing_bits(x: Column, y: Column, words: int) -> Column:
    total = F.bit_count(x[0].bitwiseXOR(y[0]))
    for i in range(1, words):
        total = total + F.bit_count(x[i].bitwiseXOR(y[i]))
    return total


def may_link(nx: Column, ny: Column, sx: Column, sy: Column, num: int, den: int, words: int) -> Column:
    """Jaccard num/den needs |difference| * (den + num) <= (|x| + |y|) * (den - num)."""
    return differing_bits(sx, sy, words) * (den + num) <= (nx + ny) * (den - num)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after joining the components of the links' ends; a node without a label is its own component."""
    for side in "ab":
        links = links.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    second = connected_components(links.select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")))
    whole = labels.union(second.select("node", F.col("node").alias("component")).join(labels, "node", "left_anti"))
    joined = whole.join(second.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return materialise(joined.select("node", F.coalesce("to", "component").alias("component")), "components")


def opened(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with their component, in buckets that have several components."""
    known = materialise(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "known")
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return small_join(known, materialise(mixed, "mixed"), "key", "left_semi")


def screened(pairs: DataFrame, records: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """Those of (a, b) that may link by the records' (node, n, sketch)."""
    for side in "ab":
        pairs = pairs.join(records.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    return pairs.where(may_link(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), num, den, words)).select("a", "b")


def components(members: DataFrame, records: DataFrame, fits: Callable[[str, str], str], verify: Verify, num: int, den: int, words: int) -> DataFrame:
    """(node, component) of all nodes with a link.

    members: key, pos, node, n (one row for each bucket of each record; buckets with one member only waste time).
    records: node, sketch. fits(x, y): SQL condition on two aliased members that a linking pair meets in one bucket at least.
    verify: from distinct (a, b) to the pairs that link.
    """

    def ordered(pairs: DataFrame) -> DataFrame:
        return materialise(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")

    centre = members.groupBy("key").agg(F.min(F.struct("pos", "node", "n")).alias("c"))
    star = members.alias("x").join(centre.select("key", "c.*").alias("y"), F.expr(f"x.key = y.key and x.node <> y.node and {fits('x', 'y')}"))
    labels = materialise(connected_components(verify(ordered(star)).select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    rest = materialise(opened(members, labels).join(records.select("node", "sketch"), "node"), "open")
    # a large bucket is cut into slices of SLICE members: each slice of one side meets the whole bucket in a task of its own
    slices = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")).where("slices > 1")
    cut = small_join(rest, materialise(slices, "slices"), "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    x = cut.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).alias("x")
    y = cut.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("y")
    near = may_link(F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch"), num, den, words)
    across = x.join(y, F.expr(f"x.key = y.key and x.slice = y.slice and x.component < y.component and {fits('x', 'y')}") & near)
    pairs = ordered(across)
    return labels if pairs.isEmpty() else merged(labels, verify(pairs))
