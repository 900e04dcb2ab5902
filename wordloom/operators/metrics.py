"""Evaluation: similarities, correlations, clustering quality, reports and aggregated losses, as aggregate queries."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import vectors as V
from wordloom.operators.dominance import signed_sum
from wordloom.operators.runs import label_runs
from wordloom.session import ensure_checkpoint_dir


def mean_similarity(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row: mean cosine and mean Euclidean distance of paired vectors."""
    return pairs.agg(F.avg(V.cosine(F.col(x), F.col(y))).alias("mean_cosine"), F.avg(V.euclid(F.col(x), F.col(y))).alias("mean_euclid"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("pearson"))


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the mean rank of ties. Values are counted first; a value's rank comes from the counts before it, summed by range."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    bounds = [float(r) for r in sizes.select(F.percentile_approx(F.col(column).cast("double"), [i / 64 for i in range(1, 64)])).first()[0] or []]
    part = F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>"), lambda b: b < F.col(column).cast("double")))
    parted = sizes.withColumn("__part", part)
    offset = parted.groupBy("__part").agg(F.sum("__n").alias("__total"))
    offset = offset.select("__part", (F.sum("__total").over(Window.orderBy("__part")) - F.col("__total")).alias("__before"))
    up = F.sum("__n").over(Window.partitionBy("__part").orderBy(column))
    ranks = parted.withColumn("__up", up).join(F.broadcast(offset), "__part")  # 64 rows at most
    ranks = ranks.select(F.col(column).alias("__value"), (F.col("__before") + F.col("__up") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("__value")).drop("__value")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "__rx"), y, "__ry")
    return ranked.agg(F.corr("__rx", "__ry").alias("spearman"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b, exact: distinct (x, y) cells with their counts, whose concordant and discordant pairs are counted range by range (dominance.signed_sum).
    Rows with a null or NaN take no part; decimals are compared as doubles."""
    number = lambda c: F.col(c).cast("double") if dict(df.dtypes)[c].startswith("decimal") else F.col(c)
    ensure_checkpoint_dir(df.sparkSession)
    cells = df.select(number(x).alias("x"), number(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    cells = cells.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")).checkpoint()
    signed = F.lit(signed_sum(cells))
    ties = lambda c: cells.groupBy(c).agg(F.sum("w").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"t{c}"))
    one = ties("x").crossJoin(ties("y")).crossJoin(cells.agg(F.sum("w").alias("m")))  # one row each
    pairs = F.col("m") * (F.col("m") - 1) / 2
    bottom = F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))
    return one.select(F.when(bottom > 0, signed / bottom).alias("kendall"))


def adjusted_rand(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    two = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    cells = df.groupBy(F.col(truth).alias("t"), F.col(found).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    inner = cells.agg(F.sum(two("n")).alias("s"), F.sum("n").cast("double").alias("m"))
    rows = cells.groupBy("t").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("a"))
    cols = cells.groupBy("f").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("b"))
    one = inner.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("m") * (F.col("m") - 1) / 2)
    top, bottom = F.col("s") - expected, (F.col("a") + F.col("b")) / 2 - expected
    return one.select(F.when(bottom == 0, F.lit(1.0)).otherwise(top / bottom).alias("ari"))


#: Rows of a block of silhouette (each row goes to as many tasks as there are blocks, so they are large), and rows and other rows whose distances are taken at once.
BLOCK, AT_ONCE, OTHERS = 1 << 16, 256, 1024


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, by a matrix product; the few that cancel too much of it once more by differences."""
    aa, bb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    square = aa + bb - 2 * (a @ b.T)
    i, j = np.nonzero(square < 1e-3 * (aa + bb))
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        square[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def silhouette(df: DataFrame, key: str, vector: str, label: str, block: int = BLOCK) -> DataFrame:
    """Exact mean silhouette with Euclidean distances. Rows are dealt to blocks by their keys (which are unique), and each pair of blocks is one tile: a
    task's matrix products. A tile gives a row one sum for each label of the other block, so nothing quadratic is stored. Rows without a vector or label take no part."""
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(label).alias("l")).where("v IS NOT NULL AND l IS NOT NULL")
    n = rows.count()
    busy = math.ceil(2 * math.sqrt(df.sparkSession.sparkContext.defaultParallelism))
    m = max(1, math.ceil(n / block), min(busy, math.ceil(n / AT_ONCE)))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(m)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    tiles = dealt.withColumn("o", other).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") <= F.col("o")).alias("left"), "k", "l", "v")
    kinds = {c: rows.schema[c].dataType for c in ("k", "l")}

    def one_way(a: pa.Table, b: pa.Table, same: bool, schema: pa.Schema) -> pa.Table:
        x, y = (np.stack(t.column("v").to_numpy(zero_copy_only=False)).astype(float) for t in (a, b))
        labels, code = np.unique(b.column("l").to_numpy(zero_copy_only=False), return_inverse=True)
        member = np.zeros((len(y), len(labels)))
        member[np.arange(len(y)), code] = 1
        sums = np.zeros((len(x), len(labels)))
        for at in range(0, len(x), AT_ONCE):
            for to in range(0, len(y), OTHERS):
                sums[at : at + AT_ONCE] += distances(x[at : at + AT_ONCE], y[to : to + OTHERS]) @ member[to : to + OTHERS]
        counts = np.broadcast_to(member.sum(axis=0), sums.shape).copy()
        if same:
            counts[np.arange(len(x)), code] -= 1
        at = np.repeat(np.arange(len(x)), len(labels))
        return pa.table([a.column("k").take(at), a.column("l").take(at), pa.array(np.tile(labels, len(x)), schema.field("l2").type), pa.array(sums.ravel()), pa.array(counts.ravel().astype(np.int64))], schema=schema)

    def tile(group: pa.Table) -> pa.Table:
        schema = pa.schema([("k", group.schema.field("k").type), ("l", group.schema.field("l").type), ("l2", group.schema.field("l").type), ("d", pa.float64()), ("n", pa.int64())])
        if group.column("i")[0].as_py() == group.column("j")[0].as_py():
            return one_way(group, group, True, schema)
        left = group.column("left")
        a, b = group.filter(left), group.filter(pc.invert(left))
        if not len(a) or not len(b):
            return schema.empty_table()
        return pa.concat_tables([one_way(a, b, False, schema), one_way(b, a, False, schema)])

    out = f"k {kinds['k'].simpleString()}, l {kinds['l'].simpleString()}, l2 {kinds['l'].simpleString()}, d double, n long"
    sums = tiles.repartition(m * (m + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(tile, out).groupBy("k", "l", "l2").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).where("n > 0")
    per = sums.groupBy("k").agg(F.max(F.when(F.col("l") == F.col("l2"), F.col("d") / F.col("n"))).alias("a"), F.min(F.when(F.col("l") != F.col("l2"), F.col("d") / F.col("n"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.avg(value).alias("silhouette"))


def to_representative(df: DataFrame, order: str, vector: str, label: str, parts: int | None = None) -> DataFrame:
    """One row: mean cosine and Euclidean distance of the members of clusters to the first row of their run of equal labels; divided by the
    rows less the distinct labels. Runs come from a segmented scan (runs.label_runs)."""
    runs = label_runs(df.select(order, label, vector), order, label, head=vector, parts=parts)
    sums = runs.where("NOT first").agg(F.sum(V.cosine(F.col(vector), F.col("run_head"))).alias("c"), F.sum(V.euclid(F.col(vector), F.col("run_head"))).alias("e"))
    n = df.agg((F.count(F.lit(1)) - F.count_distinct(label)).alias("n"))
    return sums.crossJoin(n).select(F.try_divide("c", "n").alias("mean_cosine"), F.try_divide("e", "n").alias("mean_euclid"))  # one row each


def classification_report(df: DataFrame, truth: str, found: str) -> DataFrame:
    """class, precision, recall, f1, support for each class, and rows accuracy, macro avg and weighted avg; empty divisions give 0."""
    cells = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(found).cast("string").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    long = cells.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.lit(0).cast("long").alias("hit")), F.struct(F.col("f").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.when(F.col("t") == F.col("f"), F.col("n")).otherwise(0).alias("hit")))).alias("x")).select("x.*")
    by = long.groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by = by.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    by = by.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    per = by.select("class", *names, "support")
    macro = by.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = by.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    right = ratio(F.sum("hit"), F.sum("support"))
    accuracy = by.agg(*[right.alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("accuracy").alias("class"), *names, "support")
    return per.union(accuracy).union(macro).union(weighted)


def confusion(df: DataFrame, truth: str, found: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(found).alias("found")).agg(F.count(F.lit(1)).alias("count"))


def weighted_loss(batches: DataFrame, loss: str = "loss", size: str = "n") -> DataFrame:
    return batches.agg((F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("loss"))


def binary_cross_entropy(df: DataFrame, logits: str, labels: str) -> DataFrame:
    """Mean over all entries of multi-label logits and 0/1 labels, in the form that does not overflow."""
    each = F.zip_with(logits, labels, lambda z, y: F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z))))
    return df.agg((F.sum(F.aggregate(each, F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size(each))).alias("loss"))


def cross_entropy(df: DataFrame, logits: str, label: str, ignore: int = -100) -> DataFrame:
    """Mean negative log probability of the label under a softmax; rows with the ignored label don't count."""
    z = F.transform(logits, lambda a: a.cast("double"))
    top = F.array_max(z)
    log_sum = top + F.log(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return df.where(F.col(label) != ignore).agg(F.avg(log_sum - F.element_at(z, F.col(label).cast("int") + 1)).alias("loss"))


def evaluate(df: DataFrame, truth: str, found: str, criteria: dict[str, Callable[[DataFrame, str, str], DataFrame]]) -> dict[str, DataFrame]:
    """Each criterion's own result."""
    return {name: f(df, truth, found) for name, f in criteria.items()}
