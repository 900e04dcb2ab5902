"""Splits by several labels at once, and rows dealt by rank without sorting a stratum."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.operators import splits


def shares(combinations, quotas):
    rows, train = Counter(), Counter()
    for (names, n), q in zip(combinations, quotas, strict=True):
        assert 0 <= q <= n
        for x in (*names, "all"):
            rows[x] += n
            train[x] += q
    return {x: (rows[x], train[x]) for x in rows}


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("share", [0.6, 0.5, 0.9])
def test_quotas_meet_every_label(seed, share):
    rng = random.Random(seed)
    names = [f"l{i}" for i in range(12)]
    weights = [1 / (i + 1) ** 1.5 for i in range(12)]
    sets = Counter(tuple(sorted({*rng.choices(names, weights, k=rng.randrange(5))})) for _ in range(20_000))
    combinations = sorted(sets.items(), key=lambda x: (-x[1], x[0]))
    for n, t in shares(combinations, splits.label_quotas(combinations, share)).values():
        assert abs(t - share * n) <= max(1.5, 0.01 * n)


def test_quotas_of_small_sets():
    assert splits.label_quotas([], 0.6) == []
    assert splits.label_quotas([((), 5)], 0.6) == [3]
    assert splits.label_quotas([(("a",), 1)], 0.6) == [1]
    assert sum(splits.label_quotas([((f"l{i}", "all"), 1) for i in range(100)], 0.6)) == 60


def test_multilabel_split(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["x", "x", "y", None, ""]), int(rng.random() < 0.05), rng.random() < 0.3, rng.choice([0, 1, 2])) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, name string, rare int, flag boolean, class long")
    done = splits.multilabel_stratified(df, ["name", "rare", "flag", "class"], "k").collect()
    assert sorted(r.k for r in done) == list(range(6000))
    for label in (lambda r: r.name == "x", lambda r: r.name == "y", lambda r: r.rare == 1, lambda r: r.flag, lambda r: r["class"] == 1, lambda r: r["class"] == 2):
        own = [r.split for r in done if label(r)]
        assert abs(own.count("train") - 0.6 * len(own)) <= max(1.5, 0.01 * len(own))
    again = splits.multilabel_stratified(df.repartition(7), ["name", "rare", "flag", "class"], "k").collect()
    assert sorted(map(str, done)) == sorted(map(str, again))


def test_multilabel_split_of_nothing(spark):
    df = spark.createDataFrame([], "k long, name string")
    assert splits.multilabel_stratified(df, ["name"], "k").collect() == []


def test_too_many_combinations(spark, monkeypatch):
    monkeypatch.setattr(splits, "MOST_COMBINATIONS", 5)
    with pytest.raises(ValueError, match="more than 5"):
        splits.multilabel_stratified(spark.range(10).withColumn("l", F.col("id")), ["l"], "id")


def test_dealing_by_rank_is_the_order_by_rank(spark):
    """The same rows as a window over whole strata gives, null strata and repeated keys included."""
    rng = random.Random(2)
    rows = [(rng.randrange(400), rng.choice(["a", "a", None]), rng.choice([1, None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k long, s string, t int")
    from pyspark.sql import Window

    strata, n = ["s", "t"], F.count(F.lit(1)).over(Window.partitionBy("s", "t"))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(splits.rank_key("k"), "k"))
    want = df.withColumn("split", F.when(place <= F.round(n * 0.6), "train").otherwise("test"))
    got = splits.stratified(df, strata, "k")
    assert Counter(map(str, got.collect())) == Counter(map(str, want.collect()))
    assert got.columns == ["k", "s", "t", "split"]
