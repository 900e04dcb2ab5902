"""Queries of the catalogue for what the others leave out: sources by stream and epoch, labelled sinks, character tables in files, masks of words,
inference word by word, and operators whose results SQL can only know by their properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import charset, exact
from wordloom.functions import text as X
from wordloom.functions import vectors as V
from wordloom.operators import metrics, models, morphology, splits
from wordloom.plans.analysis import folder
from wordloom.plans.catalogue import TABLE, distinct_words, query, read, rounded
from wordloom.plans.roundtrips import TALK, talk
from wordloom.sources import readers, writers
from wordloom.streaming import stateful, streams

# ---- sources and sinks


@query("SELECT role AS label, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT role, replace(regexp_replace(text, '\\n\\z', ''), chr(9), ' ') AS text FROM conversations) GROUP BY role")
def labelled_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their labels as a sink takes them."""
    rows = writers.labelled(read(spark, sf_dir, "conversations"), "text", F.col("role"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.char_length("text")).alias("chars"))


@query(f"SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM {TALK} GROUP BY role")
def streamed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited table read as a stream, file by file, and counted in a table (files_stream)."""
    at = folder(spark, "table")
    writers.write_table(talk(spark, sf_dir), at)
    schema = ", ".join(f"{c} {t}" for c, t in talk(spark, sf_dir).dtypes)
    stream = streams.files_stream(spark, at, schema, files_per_batch=4)
    counts = stateful.MergedCounts(spark, ["role"], "both")
    counts.start(stream.groupBy("role").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars")).alias("both")), f"{at}-checkpoint").awaitTermination()
    return counts.read().select("role", "both.n", "both.chars")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def epochs_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in three parts, one part an epoch, in an order that the seed decides; each part comes once."""
    at = folder(spark, "epochs")
    events = read(spark, sf_dir, "events").select("event_id", "event_type")
    for k in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == k).write.parquet(f"{at}/{k}")
    parts = [p for p in streams.epochs(spark, [f"{at}/{k}" for k in range(3)], spark.read.parquet)]
    every = parts[0].union(parts[1]).union(parts[2])
    return every.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word")
def affix_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct affixes of lists separated by semicolons, joined back to their rows."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("; ")).alias("parts"))
    known = morphology.distinct_affixes(part, "parts")
    rows = part.select(F.explode(X.affix_parts(F.col("parts"))).alias("affix")).join(known, "affix")
    return rows.groupBy(F.col("affix").alias("word")).agg(F.count(F.lit(1)).alias("n"))


# ---- character tables and words


@query("SELECT word, CAST(len(string_split(word, '')) AS BIGINT) AS n FROM (SELECT DISTINCT p_type AS word FROM part) WHERE word <> ''")
def saved_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words encoded with a character table that was written to a file and read again; the number of ids that aren't padding or marks."""
    at = folder(spark, "characters")
    charset.CharTable(TABLE.ranges, TABLE.singles, 64).save(spark, at)
    table = charset.CharTable.load(spark, at)
    words = read(spark, sf_dir, "part").select(F.col("p_type").alias("word")).distinct().where("word <> ''")
    return words.select("word", F.size(F.filter(table.encode_word(F.col("word")), lambda x: ~x.isin(charset.PAD, charset.CLASS, charset.SEPARATOR))).cast("long").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, ' ') THEN list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') ELSE list_filter(string_split(text, ''), lambda x: x <> '') END AS tokens FROM conversations")
def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words where a text has a space, else characters."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", charset.tokenize(F.col("text")).alias("tokens"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(replace(text, chr(10), ' '), ' +')) AS word FROM documents) WHERE length(word) <= 30)) AS words, TRUE AS rest_stays, TRUE AS labels_tell, TRUE AS special_stay, TRUE AS by_share")
def masked_id_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking for training by its properties: unlabelled ids stay, labels are the ids that were there, special ids stay, and a fifth of the others is labelled."""
    rows = distinct_words(spark, sf_dir).select("word", TABLE.encode_word(F.col("word")).alias("ids"))
    rows = rows.select("word", "ids", TABLE.mask_ids(F.col("ids"), F.col("word"), 0.2).alias("m"))
    all_of = lambda f: F.forall(F.arrays_zip(F.col("ids").alias("a"), F.col("m.ids").alias("b"), F.col("m.labels").alias("l")), f)
    checked = rows.select(
        all_of(lambda x: (x["l"] != -100) | (x["a"] == x["b"])).alias("rest"),
        all_of(lambda x: (x["l"] == -100) | (x["a"] == x["l"])).alias("labels"),
        all_of(lambda x: (x["a"] >= 5) | (x["l"] == -100)).alias("special"),
        F.size(F.filter("ids", lambda x: x >= 5)).alias("open"),
        F.size(F.filter("m.labels", lambda x: x != -100)).alias("chosen"),
    )
    near = F.abs(F.sum("chosen") - 0.2 * F.sum("open")) <= 5 * F.sqrt(0.16 * F.sum("open"))  # five standard deviations
    return checked.agg(F.count(F.lit(1)).alias("words"), F.every("rest").alias("rest_stays"), F.every("labels").alias("labels_tell"), F.every("special").alias("special_stay"), near.alias("by_share"))


@query("SELECT CAST(chunk AS INT) AS chunk, least(1000, n - 1000 * chunk) AS rows FROM (SELECT count(*) AS n FROM orders), range(1000000) t(chunk) WHERE 1000 * chunk < n")
def shuffled_chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in shuffled order are full but for the last, and no row is in two."""
    done = splits.chunks(read(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey")
    return done.groupBy("chunk").agg(F.count_distinct("o_orderkey").alias("rows"))


_STARTS = "list_transform(range(1, CAST(len(p) AS BIGINT) + 1), lambda i: i % 2 = 1)"


@query(f"SELECT conv_id, turn, {_STARTS} AS starts FROM (SELECT conv_id, turn, list_transform(range(2 * len(w)), lambda i: i) AS p FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: length(x) > 2 AND regexp_full_match(x, '[a-z]+')) AS w FROM conversations))")
def compared_word_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces compared with the words that they make up: every word in two pieces, of which the first begins it."""
    words = F.filter(F.split("text", " "), lambda x: (F.char_length(x) > 2) & x.rlike("^[a-z]+$"))
    cut = F.flatten(F.transform("w", lambda x: F.array(F.substring(x, 1, 2), F.concat(F.lit("#"), F.substring(x, 3, 1000), F.lit("</w>")))))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w")).withColumn("p", cut)
    return rows.select("conv_id", "turn", exact.compared_starts(F.col("p"), F.col("w")).alias("starts"))


@query("SELECT conv_id, turn, regexp_replace(lower(nfc_normalize(replace(replace(text, '``', '\"'), '''''', '\"'))), '\\p{C}', '', 'g') AS text FROM conversations")
def french_moses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, plain punctuation, lower case, no control characters."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", exact.moses_french(F.col("text")).alias("text"))


# ---- vectors and models


_LENGTHS = "list_transform(list_concat(list_transform(w[1:6], lambda x: length(x)), [0, 0, 0, 0, 0, 0])[1:6], lambda x: x)"


@query(f"SELECT conv_id, turn, {_LENGTHS} AS sizes, CAST(least(len(w), 6) AS BIGINT) AS words FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)")
def word_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference word by word, padded to six: an encoder that gives a word's length and one."""

    def load():
        return lambda words: np.array([[len(w), 1.0] for w in words], np.float32)

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    done = models.encode_sequences(rows, "w", load, 6)
    total = F.aggregate("embeddings_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select("conv_id", "turn", F.transform("embeddings", lambda v: v[0].cast("long")).alias("sizes"), total.alias("words"))


@query("SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS far FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean distances of neighbours."""
    e = read(spark, sf_dir, "embeddings")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return rounded(pairs.select("vec_id", V.euclid(F.col("embedding"), F.col("next")).alias("far")))


@query("SELECT count(*) AS rows, round(avg(CASE WHEN t = f THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT quality AS t, toxic AS f FROM labels)")
def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named criteria over one table of truths and findings (evaluate)."""
    both = {"rows": lambda d, t, f: d.agg(F.count(F.lit(1)).alias("rows")), "right": lambda d, t, f: d.agg(F.avg((F.col(t) == F.col(f)).cast("double")).alias("accuracy"))}
    done = metrics.evaluate(read(spark, sf_dir, "labels"), "quality", "toxic", both)
    return rounded(done["rows"].crossJoin(done["right"]))  # one row each


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'progress' ELSE 'state' END AS feature, o_orderstatus AS value FROM orders")
def tag_file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags looked up in a dimension that is kept as lines of a file."""
    at = folder(spark, "tags")
    names = F.when(F.col("o_orderstatus") == "P", "progress").otherwise("state")
    found = read(spark, sf_dir, "orders").groupBy(names.alias("feature")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("tags"))
    writers.write_lines(found.select(F.concat("feature", F.lit(": "), F.array_join("tags", " ")).alias("value")), at)
    dimension = morphology.tag_dimension(readers.lines(spark, at))
    return morphology.lookup(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", dimension).select("o_orderkey", "feature", "value")
