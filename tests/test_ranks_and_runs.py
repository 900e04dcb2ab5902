"""Pairs counted by ranges, runs by a segmented scan, and silhouettes by tiles, against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import wordloom.operators.dominance as D
from wordloom.operators import metrics
from wordloom.operators.runs import label_runs


def slow_signed(x, y, w):
    return sum(w[a] * w[b] * (np.sign(y[b] - y[a])) for a in range(len(x)) for b in range(len(x)) if x[a] < x[b])


@pytest.mark.parametrize("values", [1, 3, 40, 10_000])
def test_signed_pairs(values):
    rng = np.random.default_rng(values)
    x, y, w = rng.integers(0, values, 120), rng.integers(0, values, 120) / 3, rng.integers(1, 9, 120).astype(float)
    assert D.signed_pairs(x, y, w) == slow_signed(x, y, w)


def slow_kendall(x, y):
    x, y = np.array(x, float), np.array(y, float)
    sx, sy = (np.sign(v[:, None] - v[None, :]) for v in (x, y))
    bottom = np.sqrt((sx * sx).sum() * (sy * sy).sum())
    return (sx * sy).sum() / bottom if bottom else None


@pytest.mark.parametrize("kind", ["continuous", "ties", "hot", "constant"])
def test_kendall_over_many_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(D, "ALONE", 60)
    monkeypatch.setattr(D, "RANGE", 25)
    rng = random.Random(kind)
    draw = {"continuous": lambda: (rng.random(), rng.random()), "ties": lambda: (rng.randrange(30), rng.randrange(40)), "hot": lambda: (rng.choice((7, 7, rng.randrange(100))), rng.randrange(100)), "constant": lambda: (1, rng.random())}[kind]
    rows = [draw() for _ in range(700)]
    odd = [(None, 1.0), (1.0, None), (float("nan"), 1.0)] if kind == "continuous" else []
    schema = "x double, y double" if kind == "continuous" else "x long, y double"
    got = metrics.kendall(spark.createDataFrame([*((x, float(y)) for x, y in rows), *odd], schema), "x", "y").first().kendall
    want = slow_kendall(*zip(*rows))
    assert got == (pytest.approx(want) if want is not None else None)


def test_kendall_of_a_million_cells(spark):
    """Values reversed in blocks of 1024: the discordant pairs are those within blocks."""
    n, block = 1_000_000 // 1024 * 1024, 1024
    df = spark.range(n).select(F.col("id").alias("x"), F.expr(f"id ^ {block - 1}").alias("y"))
    pairs, against = n * (n - 1) // 2, n // block * (block * (block - 1) // 2)
    assert metrics.kendall(df, "x", "y").first().kendall == pytest.approx((pairs - 2 * against) / pairs, abs=1e-12)


def test_no_join_of_cells(spark):
    plan = metrics.kendall(spark.range(50).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y")), "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "x#" in plan
    assert plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct") <= 2  # one-row tables


def slow_runs(rows):
    out, run, before = [], 0, object()
    for k, label in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        first = label != before
        run += first
        before = label
        out.append((k, label, run, first))
    return out


@pytest.mark.parametrize("parts", [1, 3, 7, 40])
def test_runs_over_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["a", "a", "a", "b", None])) for i in range(150)] + [(i, "long") for i in range(150, 400)] + [(400, None), (401, None), (402, "z")]
    rng.shuffle(rows)
    got = label_runs(spark.createDataFrame(rows, "k long, label string"), "k", "label", head="k", parts=parts).collect()
    want = slow_runs(rows)
    assert sorted((r.k, r.label, r.run, r.first) for r in got) == sorted(want, key=lambda r: r[0])
    heads = {run: k for k, _, run, first in want if first}
    assert all(r.run_head == heads[r.run] for r in got)


def test_a_run_over_three_ranges(spark):
    """One label all over: ranges in the middle hold no beginning at all."""
    got = label_runs(spark.range(500).select("id", F.lit("x").alias("label"), F.col("id").cast("string").alias("v")), "id", "label", head="v", parts=9).collect()
    assert {(r.run, r.run_head) for r in got} == {(1, "0")}
    assert [r.id for r in got if r.first] == [0]


def test_runs_of_nothing(spark):
    assert label_runs(spark.createDataFrame([], "k long, label string"), "k", "label", head="k").collect() == []


def test_representatives_need_no_global_window(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 3), 1.0], "ab"[i // 40 % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v array<double>, label string")
    v = np.array([r[1] for r in rows])
    heads = np.array([v[i // 40 * 40] for i in range(200)])
    cos = (v * heads).sum(1) / np.linalg.norm(v, axis=1) / np.linalg.norm(heads, axis=1)
    keep = np.arange(200) % 40 != 0
    for parts in (1, 11):
        got = metrics.to_representative(df, "k", "v", "label", parts=parts).first()
        assert got.mean_cosine == pytest.approx(cos[keep].sum() / 198)
        assert got.mean_euclid == pytest.approx(np.linalg.norm(v - heads, axis=1)[keep].sum() / 198)


@pytest.mark.parametrize("block", [16, 4096])
def test_silhouette_by_tiles(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (150, 6)) + 50
    v[100:120] = v[0]  # copies, whose distances cancel wholly
    label = rng.integers(0, 4, 150)
    label[3] = 9  # alone in its cluster
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    values = []
    for i in range(150):
        own = (label == label[i]) & (np.arange(150) != i)
        if not own.any():
            values.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][label == k].mean() for k in set(label.tolist()) if k != label[i])
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    df = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label))] + [(900, None, 1), (901, [0.0] * 6, None)], "k long, v array<double>, l int")
    assert metrics.silhouette(df, "k", "v", "l", block).first().silhouette == pytest.approx(np.mean(values), abs=1e-9)


def test_silhouette_of_texts_as_labels_and_of_nothing(spark):
    schema = "k string, v array<double>, l string"
    assert metrics.silhouette(spark.createDataFrame([], schema), "k", "v", "l").first().silhouette is None
    df = spark.createDataFrame([("a", [0.0], "x"), ("b", [1.0], "x"), ("c", [5.0], "y")], schema)
    assert metrics.silhouette(df, "k", "v", "l").first().silhouette == pytest.approx((0.8 + 0.75) / 3)
