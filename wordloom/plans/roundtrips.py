"""More queries of the catalogue: tables written by each sink and read back by each source, plain projections, text operators and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions import vectors as V
from wordloom.operators import duplicates, models, morphology, splits, words
from wordloom.plans.catalogue import ORACLES, query, read, rounded
from wordloom.session import ensure_checkpoint_dir
from wordloom.sources import readers, writers
from wordloom.streaming import streams


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _flat(column: str) -> F.Column:
    return F.regexp_replace(column, "[\\n\\t]", " ")


FLAT = "regexp_replace({0}, '[\\n\\t]', ' ', 'g')"
TALK = f"(SELECT conv_id, turn, role, {FLAT.format('text')} AS text FROM conversations)"


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", _flat("text").alias("text"))


# ---- sources and sinks


@query(f"SELECT conv_id, turn, role, text FROM {TALK}")
def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited table with quotes and empty strings (write_table, table)."""
    at = folder(spark, "table")
    writers.write_table(talk(spark, sf_dir), at)
    schema = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").schema
    return readers.table(spark, at, schema)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type FROM part")
def string_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as strings, another separator (string_table)."""
    at = folder(spark, "strings")
    writers.write_table(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), at, sep=";")
    return readers.string_table(spark, at, ["p_partkey", "p_name", "p_type"], sep=";")


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY value")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text (write_lines, lines)."""
    at = folder(spark, "lines")
    writers.write_lines(read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")), at)
    return readers.lines(spark, at).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


_CHUNKS = "(SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders)"


@query(f"SELECT CAST(chunk AS INT) AS chunk, o_orderkey FROM {_CHUNKS}")
def chunks_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a thousand rows, a folder each, read back (write_chunks)."""
    at = folder(spark, "chunks")
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    writers.write_chunks(splits.chunks(orders, 1000, "o_orderkey", None), at, 1000)
    return spark.read.csv(at, schema=f"o_orderkey {orders.schema[0].dataType.simpleString()}, chunk int", sep="\t", header=True).select("chunk", "o_orderkey")


@query(f"SELECT DISTINCT 'chunk=' || CAST(chunk AS BIGINT) AS name FROM {_CHUNKS}")
def chunk_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the folders below a path (subfolders)."""
    at = folder(spark, "chunks")
    writers.write_chunks(splits.chunks(read(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey", None), at, 1000)
    return spark.createDataFrame([(x,) for x in readers.subfolders(spark, at)], "name string")


@query(f"SELECT count(DISTINCT chunk) AS files FROM {_CHUNKS}")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by suffix in all folders (files)."""
    at = folder(spark, "chunks")
    writers.write_chunks(splits.chunks(read(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey", None), at, 1000)
    return readers.files(spark, at, ".csv", recursive=True).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT p_name AS word, CAST(p_size AS INT) AS cluster FROM part")
def cluster_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "clusters")
    writers.write_table(read(spark, sf_dir, "part").select(F.col("p_name").alias("word"), F.col("p_size").alias("cluster")), at)
    return readers.cluster_table(spark, at)


@query("SELECT p_name AS word, replace(p_brand, '#', '*') AS obfus1fix, p_type AS obfus1var FROM part")
def noise_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned spellings in Base64 lines (write_encoded_lines, decoded_lines, noise_table)."""
    coded, plain = folder(spark, "coded"), folder(spark, "noise")
    rows = read(spark, sf_dir, "part").select(F.concat_ws("\t", "p_name", F.replace("p_brand", F.lit("#"), F.lit("*")), "p_type").alias("value"))
    writers.write_encoded_lines(rows, coded)
    writers.write_lines(readers.decoded_lines(spark, coded), plain)
    named = folder(spark, "noise-table")
    writers.write_table(readers.string_table(spark, plain, ["word", "obfus1fix", "obfus1var"], header=False), named)
    return readers.noise_table(spark, named)


_WORDS = "list_filter(string_split(text, ' '), lambda x: x <> '')"


@query(f"SELECT array_to_string(w, ' ') AS words, CAST(len(w) AS INT) AS n FROM (SELECT {_WORDS} AS w FROM {TALK}) WHERE len(w) > 0")
def tagged_sentences_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of words and as many tags (tagged_sentences)."""
    at = folder(spark, "tagged")
    w = F.filter(F.split("text", " "), lambda x: x != "")
    lines = talk(spark, sf_dir).select(F.concat(F.array_join(w, " "), F.lit("\t"), F.array_join(F.transform(w, lambda x: F.lit("X")), " ")).alias("value"))
    writers.write_lines(lines, at)
    return readers.tagged_sentences(spark, at).select(F.array_join("words", " ").alias("words"), F.size("tags").alias("n"))


@query(f"SELECT text, CASE turn WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' ELSE 'unknown' END AS class FROM {TALK}")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of a text and a label (write_report, json_lines)."""
    at = folder(spark, "json")
    writers.write_report(talk(spark, sf_dir).select("text", F.col("turn").alias("label")), at)
    return readers.json_lines(spark, at)


@query("SELECT p_name AS lemma, p_type AS form, 'N;' || p_brand AS tags FROM part")
def unimorph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "unimorph")
    writers.write_lines(read(spark, sf_dir, "part").select(F.concat_ws("\t", "p_name", "p_type", F.concat(F.lit("N;"), "p_brand")).alias("value")), at)
    return readers.unimorph(spark, at).select("lemma", "form", F.array_join("tags", ";").alias("tags"))


@query(f"SELECT len(w) AS length, count(*) AS sentences FROM (SELECT {_WORDS} AS w FROM {TALK}) WHERE len(w) > 0 GROUP BY 1")
def conllu_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated sentences, a line a word (conllu_lines, sentences)."""
    at = folder(spark, "conllu")
    w = F.filter(F.split("text", " "), lambda x: x != "")
    body = F.array_join(F.transform(w, lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), x, F.lit("_"), F.lit("X"))), "\n")
    writers.write_lines(talk(spark, sf_dir).select(F.concat(F.lit("# turn\n"), body, F.lit("\n")).alias("value")), at)
    found = morphology.sentence_lengths(morphology.sentences(readers.conllu_lines(spark, at)))
    return found.select(F.col("length").cast("long").alias("length"), "sentences")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, lang, {FLAT.format('text')} AS text FROM documents WHERE lang IN ('de', 'fr')")
def tatoeba_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of two languages from lines of id, language and text; other lines are left out (tatoeba)."""
    at = folder(spark, "tatoeba")
    rows = read(spark, sf_dir, "documents").select(F.concat_ws("\t", F.col("doc_id").cast("string"), "lang", _flat("text")).alias("value"))
    writers.write_lines(rows.union(spark.createDataFrame([("no tab",), ("a\tde",)], "value string")), at)
    return readers.tatoeba(spark, at, ["de", "fr"])


@query("SELECT DISTINCT p_name AS affix FROM part")
def affix_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct affixes of a file with comments and blank lines (affix_file, word_list)."""
    at = folder(spark, "affixes")
    writers.write_lines(read(spark, sf_dir, "part").select(F.col("p_name").alias("value")).union(spark.createDataFrame([("# no",), (" ",)], "value string")), at)
    return readers.affix_file(spark, at)


@query("SELECT doc_id, source FROM documents WHERE NOT regexp_matches(text, '(licen[sc]e|password)')")
def keyword_file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the keywords of a file (keyword_file)."""
    at = folder(spark, "keywords")
    writers.write_lines(spark.createDataFrame([("licen[sc]e",), ("password",)], "value string").coalesce(1), at)
    return duplicates.without_keywords(read(spark, sf_dir, "documents"), "text", readers.keyword_file(spark, at)).select("doc_id", "source")


@query("SELECT p_name AS word, CAST(i AS INT) AS place, CAST(CASE i WHEN 0 THEN p_size ELSE p_partkey END AS FLOAT) AS label FROM part, range(2) t(i)")
def labelled_columns_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.labelled_columns(read(spark, sf_dir, "part").select("p_name", "p_size", "p_partkey"))
    return rows.select("word", F.posexplode("labels").alias("place", "label"))


@query("SELECT CAST(p_partkey AS INT) AS a, CAST(p_size AS INT) AS b, 1 AS mask, CAST(p_partkey % 3 AS INT) AS label FROM part")
def encoded_words_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless numeric rows of ids, mask and labels (encoded_words)."""
    at = folder(spark, "encoded")
    read(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(1).alias("m"), F.lit(1).alias("n"), F.col("p_partkey") % 3).write.csv(at)
    rows = readers.encoded_words(spark, at, 2, 1)
    return rows.select(F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b"), F.col("mask")[1].alias("mask"), F.col("labels")[0].alias("label"))


@query("SELECT source AS key, CAST(count(*) AS VARCHAR) AS value FROM documents WHERE source IS NOT NULL GROUP BY source")
def config_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration made of a table's counts, written as JSON and read again."""
    at = folder(spark, "config")
    counted = read(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("source", "n")))  # a row a source
    writers.write_lines(counted.agg(F.to_json(F.map_from_entries(pairs), {"pretty": "true"}).alias("value")), at)
    return spark.createDataFrame([(k, str(v)) for k, v in readers.config(spark, at).items()], "key string, value string")


@query("SELECT 'documents.parquet' AS file, count(*) AS rows FROM documents")
def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by file of a table that is one file, or a folder of part files."""
    return words.rows_per_file(read(spark, sf_dir, "documents"), "documents.parquet")


# ---- streams


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files, written batch by batch (write_batches), read back and counted."""
    at = folder(spark, "batches")
    stream = spark.readStream.schema(read(spark, sf_dir, "documents").schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents.parquet*")
    streams.write_batches(stream, at, f"{at}-state", lambda batch: batch.select("source")).awaitTermination()
    return spark.read.parquet(at).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type (windowed_counts; over a finished table no event is late)."""
    return streams.windowed_counts(read(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "10 minutes").select("start", "event_type", "n")


# ---- rows


@query("SELECT doc_id AS id, CAST(n_chars AS VARCHAR) AS size, 'corpus' AS origin FROM documents WHERE lang IN ('en', 'es') AND source IS NOT NULL")
def projected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by value, without nulls, renamed, cast, with a constant."""
    docs = read(spark, sf_dir, "documents").dropna(subset=["source"]).where(F.col("lang").isin("en", "es"))
    return docs.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("string").alias("size"), F.lit("corpus").alias("origin"))


@query("SELECT p_partkey, p_size, CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS BIGINT) AS index FROM part")
def integer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the order of an integer label."""
    return morphology.label_index(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size")


_HOLES = "(SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS k FROM orders)"


@query(f"SELECT k, CAST((row_number() OVER (ORDER BY k NULLS FIRST) - 1) // 1000 AS INT) AS chunk FROM {_HOLES}")
def chunks_with_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("k"))
    return splits.chunks(rows, 1000, "k", None)


@query("SELECT conv_id, role, turn FROM (SELECT conv_id, role, CASE WHEN role <> 'user' THEN turn END AS turn FROM conversations) QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC NULLS LAST) = 1")
def keep_last_with_null_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "role", F.when(F.col("role") != "user", F.col("turn")).alias("turn"))
    return duplicates.keep_last(rows, ["conv_id", "role"], "turn")


@query("SELECT doc_id, lang FROM documents")
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shuffle(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query("SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS value FROM orders")
def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag's feature value by a dimension table."""
    tags = spark.createDataFrame([("F", "state", "done"), ("O", "state", "open"), ("P", "state", "part")], "tag string, feature string, value string")
    return morphology.lookup(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", tags).select("o_orderkey", "o_orderstatus", "value")


_FORMS = "(SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'V' WHEN 1 THEN 'N' ELSE 'ADJ' END AS pos, CASE conv_id % 2 WHEN 0 THEN 'SG' ELSE 'PL' END AS number FROM conversations)"


@query(f"SELECT 'w' || conv_id || '_' || turn AS word, 'l' || conv_id AS lemma, CASE number WHEN 'SG' THEN 'singular' ELSE 'plural' END AS number, CASE pos WHEN 'N' THEN 'noun' ELSE 'adjective' END AS pos, 'NA' AS tense FROM {_FORMS} WHERE pos <> 'V'")
def inflected_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjectives and nouns with a column for each feature."""
    tags = [("V", "pos", "verb"), ("N", "pos", "noun"), ("ADJ", "pos", "adjective"), ("SG", "number", "singular"), ("PL", "number", "plural")]
    pos = F.when(F.col("turn") % 3 == 0, "V").when(F.col("turn") % 3 == 1, "N").otherwise("ADJ")
    number = F.when(F.col("conv_id") % 2 == 0, "SG").otherwise("PL")
    forms = read(spark, sf_dir, "conversations").select(F.concat(F.lit("l"), "conv_id").alias("lemma"), F.concat(F.lit("w"), "conv_id", F.lit("_"), "turn").alias("form"), F.array(pos, number).alias("tags"))
    found = morphology.inflections(forms, spark.createDataFrame(tags, "tag string, feature string, value string"), ["pos", "number", "tense"], verbs=False)
    return found.select("word", "lemma", "number", "pos", "tense")


@query(ORACLES["affix_counts"].replace("count(*) AS n", "1 AS here").replace("SELECT affix, 1 AS here", "SELECT affix"))
def common_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that twenty rows have at least (frequent_affixes)."""
    part = read(spark, sf_dir, "part").select(F.array_join(F.array_distinct(F.split("p_name", " ")), ";").alias("p_name"))
    return spark.createDataFrame([(a,) for a in morphology.frequent_affixes(part, "p_name", 20)], "affix string")


# ---- texts


@query("SELECT doc_id, regexp_replace(text, '[' || chr(1611) || '-' || chr(1630) || chr(1600) || ']', '', 'g') AS text FROM documents")
def without_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.drop_marks(F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn, string_split_regex(text, '[ ]') AS parts, ltrim(text, ' ') AS joined FROM {TALK}")
def split_and_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts between single blanks, and put together again without the blanks in front."""
    parts = X.split_keep(F.col("text"))
    return talk(spark, sf_dir).select("conv_id", "turn", parts.alias("parts"), X.join(parts).alias("joined"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\.{2,}', ' .. ', 'g'), '\s*,\s*', ' , ', 'g') AS text FROM documents")
def respaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.respace(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(regexp_replace(text, '\\n\\z', ''), chr(9), ' ') || ' ' AS text FROM documents")
def chomped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.chomp(F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x NOT IN ('the', 'of')) AS words FROM {TALK}")
def without_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).select("conv_id", "turn", X.drop_words(F.split("text", " "), ["the", "of"]).alias("words"))


@query("SELECT p_partkey, replace(p_brand, '*', '#') AS masked, replace(p_type, '-', '') AS affix FROM part")
def masks_and_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.swap_mask(F.col("p_brand")).alias("masked"), X.affix(F.col("p_type")).alias("affix"))


# ---- vectors


_V = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"SELECT vec_id, CAST(i AS INT) AS place, round(v[i + 1] + v[i + 1], 6) AS total, round(v[i + 1] * v[i + 1], 6) AS product FROM {_V}, range(64) t(i)")
def composed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), F.col("embedding").alias("y"))
    both = models.compose_product(models.compose_sum(rows, ["x", "y"], "s"), ["x", "y"], "p")
    return rounded(both.select("vec_id", F.posexplode(F.arrays_zip("s", "p")).alias("place", "b")).select("vec_id", "place", F.col("b.s").alias("total"), F.col("b.p").alias("product")))


@query(f"SELECT vec_id, CAST(i AS INT) AS place, round(exp(v[i + 1] - top) / list_sum(list_transform(v, lambda a: exp(a - top))), 6) AS share FROM (SELECT *, list_max(v) AS top FROM {_V}), range(64) t(i)")
def softmax_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.softmax(F.col("embedding"))).alias("place", "share"))
    return rounded(rows)


@query(f"SELECT a.vec_id, CAST(i AS INT) AS place, round((b.v[i + 1] + c.v[i + 1]) / 2, 6) AS mean FROM {_V} a JOIN {_V} b ON b.vec_id = a.vec_id + 1 JOIN {_V} c ON c.vec_id = a.vec_id + 2, range(64) t(i)")
def pooled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the middle two of four vectors: without the first and the last token (mean_tokens)."""
    e = read(spark, sf_dir, "embeddings")
    at = lambda k: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(f"v{k}"))
    rows = at(0).join(at(1), "vec_id").join(at(2), "vec_id")
    pooled = V.mean_tokens(F.array("v0", "v1", "v2", "v0"))
    return rounded(rows.select("vec_id", F.posexplode(pooled).alias("place", "mean")))
