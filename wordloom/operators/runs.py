"""Runs of equal labels in an order, by a segmented scan: no task sees the whole order.

Rows are dealt to ranges of the order. Each range gives its first and its last label; a scan over these few summaries tells every range whether its
first row begins a run and how many runs began before. Inside the ranges windows number the rows' runs. What is needed of a run's first row is
taken inside the range where the run begins; a range that a run enters from before gets it from there, one row a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import ensure_checkpoint_dir


def label_runs(df: DataFrame, order: str | list[str], label: str, head: str | None = None, parts: int | None = None) -> DataFrame:
    """df with run (from 1, in order), first (whether the row begins its run) and, where head names a column, its value in the run's first row as run_head.

    Rows of equal order come by label, then by a hash of the row. A null label is a label of its own. An empty table gives an empty one.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order = [order] if isinstance(order, str) else order
    key = F.struct(*[F.col(c) for c in order], F.col(label), F.xxhash64(*df.columns).alias("__h"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__key", key).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()).checkpoint()  # ranges stay as they are
    w = Window.partitionBy("__part").orderBy("__key")
    differs = ~F.lag(label).over(w).eqNullSafe(F.col(label))
    inner = ranged.withColumn("__place", F.row_number().over(w)).withColumn("__differs", differs & (F.col("__place") > 1))

    edges = inner.groupBy("__part").agg(F.min_by(label, "__key").alias("low"), F.max_by(label, "__key").alias("high"), F.count_if("__differs").alias("changes"))
    plan, began, before, last = [], 0, None, None  # one row a range: (range, whether its first row begins a run, runs begun before, range where the entering run began)
    for r in sorted(edges.collect(), key=lambda r: r["__part"]):
        first = before is None or r.low != before[0]
        plan.append((r["__part"], first, began, None if first else last))
        began += first + r.changes
        before = (r.high,)
        if first or r.changes:
            last = r["__part"]
    known = spark.createDataFrame(plan, "__part int, __first boolean, __began long, __from int")
    numbered = inner.join(known, "__part")
    numbered = numbered.withColumn("first", F.when(F.col("__place") == 1, F.col("__first")).otherwise(F.col("__differs")))
    numbered = numbered.withColumn("run", F.col("__began") + F.sum(F.col("first").cast("long")).over(w))
    keep = [*df.columns, "run", "first"]
    if head is None:
        return numbered.select(keep)
    numbered = numbered.withColumn("__own", F.first(head).over(Window.partitionBy("__part", "run").orderBy("__key")))
    open_heads = numbered.where("first").groupBy(F.col("__part").alias("__from")).agg(F.max_by(head, "__key").alias("__carried"))  # of the last run that begins in a range
    carried = known.select("__part", "__from").join(open_heads, "__from").select("__part", "__carried")  # by the range that a run enters
    met = numbered.join(carried, "__part", "left")
    entered = F.col("__from").isNotNull() & (F.col("run") == F.col("__began"))
    return met.select(*keep, F.when(entered, F.col("__carried")).otherwise(F.col("__own")).alias("run_head"))
