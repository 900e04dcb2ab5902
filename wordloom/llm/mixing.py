"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

1. Every document's size is its number of words; a source's size is the sum.
2. Targets: the sources share the whole size by weight; none gets more than ``cap`` times its own size, and what is above is shared
   again by weight (water filling, solved in closed form by one pass over the sources sorted by cap / weight).
3. A source is taken in complete epochs first. The fraction that is left is filled with its documents in the order of exponential keys
   ``-ln(u) / quality``: u is a hash of the document's id and the seed, so that reruns agree, and a better document tends to come
   earlier. The document at the end of the budget gives only the words that are missing.

Prefix sums don't sort a source in one task: keys fall into buckets by a monotone map, about as many as the square root of the source's
documents; sums of buckets find the bucket where the budget ends, and only that bucket is sorted.

Null and empty texts have size 0; very long texts count whole. A null source is a source of its own. The key is by id and text, so rows of one id
(or of none) have keys of their own; repeated rows count each and share their key. Ties of keys go by id, then size. An empty table gives an
empty result. Other columns of the input are kept where ``keep`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_join

WORD = r"[^\x20\x09-\x0D]+"
#: Rows a bucket of keys has at least, about.
BUCKET_ROWS = 512


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on id, text and seed alone: 52 bits of MD5."""
    name = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, cap: int) -> DataFrame:
    """sources: skey, weight, source_size (a row a source) -> the same with target."""
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "skey")
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = sources.withColumn("total", F.sum("source_size").over(all_))
    x = x.withColumn("below", F.sum(cap * F.col("source_size")).over(up.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("left", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("capped", (F.col("total") - F.coalesce("below", F.lit(0))).cast("double") * F.col("weight") >= F.col("left") * F.col("source_size").cast("double") * cap)
    x = x.withColumn("given", F.sum(F.when(F.col("capped"), cap * F.col("source_size")).otherwise(0)).over(all_))
    x = x.withColumn("open", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(all_))
    share = F.col("weight") * (F.col("total") - F.col("given")).cast("double") / F.col("open")
    return x.select("skey", "source_size", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the kept columns) of every row.

    weights repeat over the sources by code point, null last. quality: (doc_id, quality) with a positive weight (another is an error), 2 where a
    document has none; repeated ids count once, with their mean. Kept columns named as a result column are left out.
    """
    keep = tuple(c for c in keep if c not in ("doc_id", "size", "source_size", "target", "taken"))
    source = F.col(source_col).cast("string")
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        uniform(F.col(id_col), F.col(text_col), seed).alias("u"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
    )
    if quality is None:
        sized = sized.withColumn("quality", F.lit(2.0))
    else:
        rated = quality.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
        sized = small_join(sized, materialise(rated, "rated"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(2.0)))
    positive = F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.raise_error(F.lit("a quality weight has to be positive")))
    sized = materialise(sized.withColumn("key", -F.ln("u") / positive).drop("u"), "sized")

    by_source = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.avg("key").alias("scale"))
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int")))
    plan = targets(ranked, cap).join(by_source.select("skey", "rows", "scale"), "skey")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size"))
    plan = materialise(plan.withColumn("buckets", F.ceil(F.col("rows") / F.greatest(F.lit(float(BUCKET_ROWS)), F.sqrt("rows")))).drop("rows"), "plan")
    n = plan.count()

    place = F.least(F.col("buckets") - 1, F.floor(F.col("buckets") * (1 - F.exp(-F.col("key") / F.col("scale")))))
    dealt = small_join(sized, plan, "skey", rows=n).withColumn("bucket", place)
    sums = dealt.where("budget > 0").groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    upto = F.sum("words").over(Window.partitionBy("skey").orderBy("bucket"))
    ends = sums.withColumn("upto", upto).where("upto - words < budget and upto >= budget").select("skey", F.col("bucket").alias("cut"), (F.col("upto") - F.col("words")).alias("before"))
    dealt = small_join(dealt, materialise(ends, "ends"), "skey", "left", rows=n)
    inside = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    whole = dealt.where(~inside).withColumn("part", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0))
    running = F.sum("size").over(Window.partitionBy("skey").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ending = dealt.where(inside).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before") - running + F.col("size"))))
    done = whole.unionByName(ending)
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return done.select("doc_id", "size", "source_size", "target", taken, *[F.col(f"keep_{c}").alias(c) for c in keep])


def label_quality(labels: DataFrame) -> DataFrame:
    """Labelled rows as weights: 4 for good, 1 for bad; rows without a label are left out."""
    return labels.where("quality is not null").select("doc_id", (1.0 + 3.0 * F.col("quality")).alias("quality"))
