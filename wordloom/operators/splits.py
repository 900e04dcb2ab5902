"""Shuffles, splits and chunks that depend on keys and seeds only, never on partitions."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Ranges that an integer key is cut into.
RANGES = 4096


def rank_key(key: str | Column, seed: int = 42) -> Column:
    return F.xxhash64(key, F.lit(seed))


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in an order that the key and the seed decide."""
    return df.orderBy(rank_key(key, seed), key)


def chunks(df: DataFrame, rows: int, key: str, seed: int | None = 42) -> DataFrame:
    """df with chunk: numbers from 0, `rows` rows each (the last has the rest), in shuffled order, or in the key's order with seed None.
    The order is cut by the first bits of the rank, or into RANGES equal ranges of an integer key (nulls come first); a group's offset is the number
    of rows before it, so no task sorts all rows."""
    if seed is not None:
        ranked = df.withColumn("__rank", rank_key(key, seed)).withColumn("__group", F.shiftright("__rank", 48))
    else:
        ranked = df.withColumn("__rank", F.col(key).cast("long"))
        low, high = ranked.agg(F.min("__rank"), F.max("__rank")).first()
        width = ((high - low) // RANGES + 1) if low is not None else 1
        ranked = ranked.withColumn("__group", F.coalesce(F.floor((F.col("__rank").cast("decimal(38,0)") - F.lit(low or 0)) / F.lit(width)).cast("long"), F.lit(-1)))
    sizes = ranked.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__group", (F.sum("__n").over(Window.orderBy("__group")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__group").orderBy("__rank", key)) - 1
    placed = ranked.withColumn("__at", place).join(sizes, "__group")
    return placed.withColumn("chunk", F.floor((F.col("__at") + F.col("__before")) / rows).cast("int")).drop("__rank", "__group", "__n", "__before", "__at")


def dealt(df: DataFrame, strata: list[str], quotas: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with split: 'train' for the first rows of each stratum by rank, as many as quotas (strata, quota) say, else 'test'. Nulls are a stratum.

    A stratum's rows are counted by the first bits of their rank, so that only what one of 65,536 parts holds is ever sorted together."""
    ranked = df.withColumn("__rank", rank_key(key, seed)).withColumn("__group", F.shiftright("__rank", 48))
    sizes = ranked.groupBy(*[F.col(c).alias(f"__{c}") for c in strata], F.col("__group").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    wanted = quotas.select(*[F.col(c).alias(f"__q_{c}") for c in strata], "quota")
    met = sizes.join(wanted, [F.col(f"__{c}").eqNullSafe(F.col(f"__q_{c}")) for c in strata], "left")
    upto = F.sum("__n").over(Window.partitionBy(*[f"__{c}" for c in strata]).orderBy("__at"))
    parts = met.select(*[f"__{c}" for c in strata], "__at", (F.coalesce("quota", F.lit(0)) - upto + F.col("__n")).alias("__left"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in strata]
    rows = ranked.join(parts, [F.col("__group") == F.col("__at"), *on])
    place = F.row_number().over(Window.partitionBy(*strata, "__group").orderBy("__rank", key))
    return rows.withColumn("split", F.when(place <= F.col("__left"), "train").otherwise("test")).select(*df.columns, "split")


def stratified(df: DataFrame, strata: list[str], key: str, share: float = 0.6, seed: int = 42) -> DataFrame:
    """df with split: 'train' for the first `share` of each combination of strata by rank, else 'test'."""
    quotas = df.groupBy(*strata).agg(F.round(F.count(F.lit(1)) * share).cast("long").alias("quota"))
    return dealt(df, strata, quotas, key, seed)


#: Combinations of labels that a plan is made for, at most, and rounds of shifts.
MOST_COMBINATIONS, SHIFTS = 1 << 20, 50


def label_quotas(combinations: list[tuple[tuple[str, ...], int]], share: float) -> list[int]:
    """How many rows of each combination of labels go to the first side, so that each label's rows divide by share.

    The label with the fewest rows left comes first. Rows of its combinations go to the sides in proportion to what each still desires of the label; an
    odd row goes where it brings its labels and the table nearer to their shares. Then combinations are shifted, one after another, by the whole number of
    rows that brings theirs nearest, until none moves.
    """
    of: dict[str, list[int]] = {}
    left: dict[str, int] = {}
    for i, (names, n) in enumerate(combinations):
        for x in (*names, ""):  # "" is the table
            of.setdefault(x, []).append(i)
            left[x] = left.get(x, 0) + n
    off = dict.fromkeys(left, 0.0)  # rows that the first side has beyond its share of those given
    want = {x: [n * share, n * (1 - share)] for x, n in left.items()}
    out: list[int | None] = [None] * len(combinations)

    def give(i: int, desire: list[float]) -> None:
        names, n = combinations[i]
        a, b = (max(d, 0.0) for d in desire)
        if a + b <= 0:
            a, b = share, 1 - share
        t = int(n * a / (a + b))
        odd = n - t - int(n * b / (a + b))  # one at most, but for rounding
        if odd:
            t += odd if sum(2 * (off[x] + t - n * share) + odd for x in (*names, "")) <= 0 else 0
        out[i] = t
        for x in (*names, ""):
            off[x] += t - n * share
            want[x][0] -= t
            want[x][1] -= n - t
            left[x] -= n

    queue = [(n, x) for x, n in left.items() if x]
    heapq.heapify(queue)
    while queue:
        n, x = heapq.heappop(queue)
        if n != left[x]:
            heapq.heappush(queue, (left[x], x))  # others took rows of it meanwhile
            continue
        for i in of[x]:
            if out[i] is None:
                give(i, want[x])
    for i, t in enumerate(out):
        if t is None:  # without a label
            give(i, want[""])
    quotas = [int(t or 0) for t in out]
    for _ in range(SHIFTS):
        moved = False
        for i, (names, n) in enumerate(combinations):
            own = quotas[i] - n * share
            shift = -round((own + sum(off[x] for x in (*names, ""))) / (len(names) + 2))
            shift = max(-quotas[i], min(n - quotas[i], shift))
            if shift:
                moved = True
                quotas[i] += shift
                for x in (*names, ""):
                    off[x] += shift
        if not moved:
            break
    return quotas


def multilabel_stratified(df: DataFrame, labels: list[str], key: str, share: float = 0.6, seed: int = 42) -> DataFrame:
    """df with split: 'train' and 'test' by share, for the rows of every label at once (iterative stratification).

    A label is a column with a value; null, an empty string, 0 and false are none, so indicator columns do as well as columns of names. The plan is made on
    the counts of label combinations, of which there may be MOST_COMBINATIONS; rows are dealt by rank. A label's share is met but for a row or so
    for each label that comes before it.
    """
    spark = df.sparkSession
    none = {c: (F.col(c) == 0 if t not in ("string", "boolean") else F.col(c).cast("string").isin("", "false")) | F.col(c).isNull() for c, t in df.select(labels).dtypes}
    names = [F.when(~none[c], F.concat(F.lit(f"{c}="), F.col(c).cast("string"))).alias(f"__{i}") for i, c in enumerate(labels)]
    counted = df.groupBy(*labels).agg(F.count(F.lit(1)).alias("__n")).select(*labels, "__n", F.array_compact(F.array(*names)).alias("__labels"), F.to_json(F.struct(*labels)).alias("__json"))
    rows = sorted(counted.limit(MOST_COMBINATIONS + 1).collect(), key=lambda r: (-r["__n"], r["__json"]))
    if len(rows) > MOST_COMBINATIONS:
        raise ValueError(f"{labels} have more than {MOST_COMBINATIONS} combinations")
    quotas = label_quotas([(tuple(r["__labels"]), r["__n"]) for r in rows], share)
    schema = T.StructType([*[df.schema[c] for c in labels], T.StructField("quota", T.LongType())])
    return dealt(df, labels, spark.createDataFrame([(*[r[c] for c in labels], q) for r, q in zip(rows, quotas, strict=True)], schema), key, seed)


def hashed_split(df: DataFrame, key: str, share: float = 0.6, seed: int = 42) -> DataFrame:
    """The same without a window, for strata that hold most rows: each row decides alone, so shares hold on average."""
    return df.withColumn("split", F.when(F.pmod(rank_key(key, seed), F.lit(1_000_000)) < int(share * 1_000_000), "train").otherwise("test"))
