"""More queries of the catalogue: ranks, runs, splits, composed stages, table functions, stateful streams, sentences and mark-up."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import stages, tables
from wordloom.functions.wikitext import plain_text
from wordloom.operators import blocks, metrics, morphology, sentences, splits
from wordloom.operators.runs import label_runs
from wordloom.plans.catalogue import ORACLES, PREFIX_CASE, PREFIXES, SUFFIX_CASE, SUFFIXES, WORDS, annotated_turns, flat_text, literal, query, read, rounded
from wordloom.session import ensure_checkpoint_dir
from wordloom.streaming import recorders, stateful, streams

# ---- ranks and runs


_PAIRS = "(SELECT o_totalprice AS x, c_acctbal AS y FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""SELECT round((SELECT sum(sign(b.y - a.y)) FROM {_PAIRS} a JOIN {_PAIRS} b ON a.x < b.x) / sqrt((m * (m - 1) / 2 - tx) * (m * (m - 1) / 2 - ty)), 6) AS kendall FROM (SELECT count(*)::DOUBLE AS m FROM {_PAIRS}),
    (SELECT sum(n * (n - 1) / 2) AS tx FROM (SELECT count(*) AS n FROM {_PAIRS} GROUP BY x)), (SELECT sum(n * (n - 1) / 2) AS ty FROM (SELECT count(*) AS n FROM {_PAIRS} GROUP BY y))""")
def kendall_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of two continuous columns: the price of orders and the balance of those who ordered."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    pairs = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_totalprice").alias("x"), F.col("c_acctbal").alias("y"))
    return rounded(metrics.kendall(pairs, "x", "y"))


_RUNS = """(SELECT *, sum(CASE WHEN event_type IS NOT DISTINCT FROM prev AND k > 1 THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS run FROM
    (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS prev, row_number() OVER (ORDER BY event_id) AS k FROM events))"""


@query(f"SELECT event_id, event_type, CAST(run AS BIGINT) AS run, first_value(event_id) OVER (PARTITION BY run ORDER BY event_id) AS run_head FROM {_RUNS}")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number of their run of equal types, and the id of the event that begins it."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type")
    return label_runs(events, "event_id", "event_type", head="event_id").select("event_id", "event_type", "run", "run_head")


@query(f"SELECT length, count(*) AS runs FROM (SELECT run, count(*) AS length FROM {_RUNS} GROUP BY run) GROUP BY 1")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs of equal event types have which length."""
    runs = label_runs(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type")
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("runs"))


# ---- splits


@query("SELECT quality, toxic, CAST(round(count(*) * 0.6) AS BIGINT) AS train, CAST(count(*) - round(count(*) * 0.6) AS BIGINT) AS test FROM labels GROUP BY 1, 2")
def stratified_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each side of a stratified split."""
    done = splits.stratified(read(spark, sf_dir, "labels"), ["quality", "toxic"], "doc_id")
    return done.groupBy("quality", "toxic").agg(*[F.count_if(F.col("split") == x).alias(x) for x in ("train", "test")])


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic")


_RATED = "(SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
_BY_LABEL = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS rows FROM {_RATED} WHERE {c} IS NOT NULL{where} GROUP BY {c}" for c, where in (("lang", ""), ("source", ""), ("quality", " AND quality <> 0"), ("toxic", " AND toxic <> 0")))


@query(f"SELECT *, TRUE AS by_share FROM ({_BY_LABEL})")
def multilabel_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's rows, and whether its share of the training side is 0.6, within 1 % of its rows or one row."""
    done = splits.multilabel_stratified(_rated(spark, sf_dir), ["lang", "source", "quality", "toxic"], "doc_id")
    feature = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
    long = done.select("split", F.explode(F.array(*map(feature, ("lang", "source", "quality", "toxic")))).alias("x")).select("split", "x.*")
    long = long.where("value IS NOT NULL AND NOT (feature IN ('quality', 'toxic') AND value = '0')")
    by = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("split") == "train").alias("train"))
    return by.select("feature", "value", "rows", (F.abs(F.col("train") - 0.6 * F.col("rows")) <= F.greatest(F.lit(1.0), 0.01 * F.col("rows"))).alias("by_share"))


_LABEL_SETS = f"(SELECT lang, source, quality, toxic, count(*) AS rows FROM {_RATED} GROUP BY ALL)"


@query(f"SELECT lang, source, quality, toxic, rows FROM {_LABEL_SETS}")
def multilabel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each combination of labels over both sides of the split: none is lost or doubled."""
    done = splits.multilabel_stratified(_rated(spark, sf_dir), ["lang", "source", "quality", "toxic"], "doc_id")
    return done.groupBy("lang", "source", "quality", "toxic").agg(F.count_distinct("doc_id").alias("rows"))


# ---- composed stages and table functions


@query(
    """SELECT doc_id, list_transform(range(0, CAST(len(w) AS BIGINT), 7), lambda i: array_to_string(w[i + 1 : i + 7], '_')) AS groups
    FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \n\t]+'), lambda x: x NOT IN ('', 'the', 'de')) AS w FROM documents)"""
)
def staged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline of stages: split, drop words, fill groups of seven, whose rest comes at the end."""
    run = stages.composed(lambda: stages.Each(re.compile("[ \n\t]+").split), lambda: stages.Drop(["", "the", "de"]), lambda: stages.Fill(7, "_"))
    return read(spark, sf_dir, "documents").select("doc_id", run(F.col("text")).alias("groups"))


_AFFIXES = f"array({', '.join(map(literal, PREFIXES))}), array({', '.join(map(literal, SUFFIXES))})"


def _with_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    tables.register(spark)
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


@query(ORACLES["stem_freq"])
def vocab_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's frequencies in SQL, by the table function that counts within a task."""
    flat_text(spark, sf_dir).createOrReplaceTempView("flat_documents")
    _with_tables(spark, sf_dir)
    return spark.sql(f"SELECT kind, token, sum(freq) AS freq FROM vocab_counts(TABLE(SELECT text FROM flat_documents), {_AFFIXES}) GROUP BY kind, token")


@query(
    f"""SELECT lang, kind, token, count(*) AS freq FROM (UNPIVOT (SELECT lang, suffix, prefix, substr(rest, length(prefix) + 1) AS root FROM (SELECT *, CASE {PREFIX_CASE} ELSE '' END AS prefix FROM
    (SELECT lang, word, suffix, substr(word, 1, length(word) - length(suffix)) AS rest FROM (SELECT lang, word, CASE {SUFFIX_CASE} ELSE '' END AS suffix FROM {WORDS} WHERE length(word) <= 30)))) ON prefix, root, suffix INTO NAME kind VALUE token)
    WHERE token <> '' GROUP BY ALL"""
)
def vocab_udtf_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by language, by the table function that gives a row a word, joined laterally to the different words of each language."""
    flat_text(spark, sf_dir).createOrReplaceTempView("flat_documents")
    _with_tables(spark, sf_dir)
    return spark.sql(
        f"""SELECT lang, kind, token, sum(n) AS freq FROM (
            SELECT lang, n, stack(3, 'prefix', prefix, 'root', root, 'suffix', suffix) AS (kind, token)
            FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, explode(split(text, '[ \t]+')) AS word FROM flat_documents) GROUP BY lang, word), LATERAL vocab_words(word, {_AFFIXES}, false))
        WHERE token <> '' GROUP BY lang, kind, token"""
    )


@query(
    """SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, n AS words, CAST(sum(n) OVER w AS BIGINT) AS words_so_far, lag(role) OVER w AS after
    FROM (SELECT *, len(string_split(text, ' ')) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def turns_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations read turn by turn: a table function with PARTITION BY and ORDER BY."""
    _with_tables(spark, sf_dir, "conversations")
    return spark.sql("SELECT * FROM turns(TABLE(SELECT conv_id, turn, role, text FROM conversations) PARTITION BY conv_id ORDER BY turn)")


# ---- streams with state


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(ORACLES["sentence_lengths"])
def stream_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the sentences of a stream whose lines come in two parts, cut within the second turn of each conversation; what a part leaves open
    waits in the state."""
    at = folder(spark, "lines")
    lines = annotated_turns(spark, sf_dir)
    for part in ("pos < 100003", "pos >= 100003"):
        lines.where(part).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 64).parquet(f"{at}/in")
        with stateful.state_store(spark):
            streams.write_batches(stateful.sentence_stream(stream), f"{at}/out", f"{at}/checkpoint", lambda x: x).awaitTermination()
    done = spark.read.parquet(f"{at}/out").select("words").union(stateful.open_sentences(spark, f"{at}/checkpoint").select("words"))
    return morphology.sentence_lengths(done).select(F.col("length").cast("long").alias("length"), "sentences")


@query("SELECT round(avg(value), 6) AS loss, CAST(count(*) AS DOUBLE) AS rows FROM events WHERE value IS NOT NULL")
def recorded_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the losses that a recorder kept of each batch of a stream, weighted by the batches' rows."""
    at = folder(spark, "losses")
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    seen = recorders.feature_losses(stream.where("value IS NOT NULL").withColumn("n", F.lit(1)), "training", {"value": "value"})
    with recorders.Recorder(spark, f"{at}/table", ["training"]) as recorder:
        streams.write_batches(seen, f"{at}/out", f"{at}/checkpoint", lambda batch: batch.select("event_id")).awaitTermination()
    by = recorder.table().groupBy("batch").pivot("metric", ["total loss", "rows"]).agg(F.max("value"))
    return rounded(metrics.weighted_loss(by, "total loss", "rows").crossJoin(by.agg(F.sum("rows").alias("rows"))))  # one row each


# ---- sentences and mark-up


_BARE = f"regexp_replace(regexp_replace(t, {literal('^[' + re.escape(sentences.OPENING) + ']+')}, ''), {literal('[,;:' + re.escape(sentences.CLOSING) + ']+$')}, '')"
_KINDS = f"""(SELECT CASE WHEN regexp_matches(k, '^[-+]?[0-9][0-9.,]*$') THEN '##' ELSE k END AS word, s FROM (SELECT CASE WHEN s THEN left(lower(b), length(b) - 1) ELSE regexp_replace(lower(b), '[!?؟…]+$', '') END AS k, s
    FROM (SELECT b, regexp_matches(b, '[^.][.]$') AS s FROM (SELECT {_BARE} AS b FROM (SELECT unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS t FROM documents) WHERE t <> ''))))"""
_STOPS = f"(SELECT word, count(*) FILTER (s) AS with_stop, count(*) FILTER (NOT s) AS without FROM {_KINDS} WHERE word <> '' GROUP BY word)"


@query(f"SELECT word, with_stop, without FROM {_STOPS}")
def stop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of word stands before a full stop and not: what abbreviations are learned from."""
    return sentences.stop_counts(read(spark, sf_dir, "documents"))


@query(
    f"""SELECT word, with_stop, without, round(-2 * (k * ln(p) + CASE WHEN n > k THEN (n - k) * ln(1 - p) ELSE 0 END - k * ln(0.99::DOUBLE) - (n - k) * ln(0.01::DOUBLE)) * exp(-letters) * (dots + 1) * pow(letters, k - n), 6) + 0.0 AS score
    FROM (SELECT *, with_stop::DOUBLE AS k, (with_stop + without)::DOUBLE AS n, length(word) - length(replace(word, '.', '')) AS dots, length(replace(word, '.', ''))::DOUBLE AS letters FROM {_STOPS}),
    (SELECT sum(with_stop)::DOUBLE / sum(with_stop + without)::DOUBLE AS p FROM {_STOPS}) WHERE with_stop > 0 AND regexp_matches(word, '\\p{{L}}')"""
)
def abbreviation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each word behaves like an abbreviation."""
    scores = sentences.abbreviation_scores(sentences.stop_counts(read(spark, sf_dir, "documents")))
    return scores.withColumn("score", F.round("score", 6) + 0.0)  # no minus zero


@query("SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM documents")
def learned_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into sentences by rules learned from all of them, and put together again."""
    docs = read(spark, sf_dir, "documents")
    cut = docs.select("doc_id", sentences.cut_sentences(F.col("text"), sentences.learn(docs)).alias("s"))
    return cut.select("doc_id", F.regexp_replace(F.array_join("s", " "), "\\s+", " ").alias("text"))


_LETTER_WORDS = "regexp_extract_all(text, '[A-Za-z]+')"


@query(f"SELECT doc_id, array_to_string({_LETTER_WORDS}, ' ') AS text FROM documents")
def wiki_markup_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, wrapped in nested templates, tables, links, files, notes and quotes, and read back from the mark-up."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    wraps = [("[[Some page|", "]]"), ("'''", "'''"), ("{{box|{{inner|x}}|{{{1|y}}}}}", ""), ("", "<ref>see {{cite|[[z]]}}</ref>"), ("[[File:p.jpg|thumb|A [[q|caption]]]]", "<!-- {{ -->"), ("{|\n| {{t}}\n{|\n|}\n|}", ""), ("[http://example.com/a ", "]"), ("''", "''")]
    before, after = (F.array(*[F.lit(w[k]) for w in wraps]) for k in (0, 1))
    wrapped = F.transform(words, lambda w, i: F.concat(F.get(before, i % len(wraps)), w, F.get(after, i % len(wraps))))
    return read(spark, sf_dir, "documents").select("doc_id", plain_text(F.array_join(wrapped, " ")).alias("text"))


# ---- matrices


_CENTRED = "(SELECT vec_id, list_transform(range(0, 64), lambda i: v[i + 1] - m[i + 1]) AS c FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(embedding[i + 1]::DOUBLE) AS a FROM embeddings, range(64) t(i) GROUP BY i)))"


@query(f"SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(c[i + 1] * c[j + 1]), 6) + 0.0 AS value FROM {_CENTRED}, range(64) a(i), range(64) b(j) GROUP BY ALL")
def scatter_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the embedding's entries around their means: what the reductions of blocks are made of."""
    done = blocks.scatter(read(spark, sf_dir, "embeddings"), "embedding")
    return done.withColumn("value", F.round("value", 6) + 0.0)


@query("SELECT CAST(i AS INT) AS place, list(CAST(embedding[i + 1] AS DOUBLE) ORDER BY vec_id) AS vector FROM embeddings, range(64) t(i) GROUP BY i")
def transposed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.transpose(read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda a: a.cast("double")).alias("v")), "vec_id", "v")
