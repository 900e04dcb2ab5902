"""Queries by name, each with the DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import exact
from wordloom.functions import text as X
from wordloom.functions import vectors as V
from wordloom.functions.charset import PAD, SAMPLE_RANGES, SPECIAL, UNKNOWN, CharTable
from wordloom.operators import duplicates, metrics, models, morphology, splits, words
from wordloom.session import lean
from wordloom.streaming import stateful, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LANGS = ["de", "en", "es", "fr"]
PREFIXES, SUFFIXES = ["an", "be", "en", "re", "th"], ["ed", "en", "er", "ing", "ion", "ly", "tion"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)  # whole texts in Python
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))


FLAT = "(SELECT doc_id, lang, source, replace(text, chr(10), ' ') AS text FROM documents)"
WORDS = f"(SELECT lang, unnest(string_split_regex(text, ' +')) AS word FROM {FLAT})"
DISTINCT = f"(SELECT DISTINCT word FROM {WORDS} WHERE length(word) <= 30)"


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.exploded(flat_text(spark, sf_dir), label="lang").select("word").distinct()


def per_lang(form: str) -> str:
    return ", ".join(f"{form.format(k)} AS {k}" for k in LANGS)


# ---- words and vocabularies


@query(f"SELECT word, {per_lang("count(*) FILTER (lang = '{}')")} FROM {WORDS} WHERE length(word) <= 30 GROUP BY word")
def word_lang_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word by language frequencies."""
    return words.frequency(flat_text(spark, sf_dir), LANGS, label="lang")


@query(f"SELECT word, {per_lang("max(CASE WHEN lang = '{}' THEN 1 ELSE 0 END)")} FROM {WORDS} WHERE length(word) <= 30 GROUP BY word")
def word_lang_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.presence(flat_text(spark, sf_dir), LANGS, label="lang")


@query(f"SELECT length(word) AS length, count(*) AS words FROM {WORDS} GROUP BY 1")
def word_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = flat_text(spark, sf_dir).select(F.explode(F.split("text", " +")).alias("word"))
    return words.length_histogram(every).select(F.col("length").cast("long").alias("length"), "words")


@query(f"SELECT word AS token, count(*) AS freq FROM {WORDS} WHERE length(word) <= 30 GROUP BY 1 HAVING count(*) >= 50 ORDER BY 1")
def vocab_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of two halves of the corpus, merged, cut at 50 and sorted."""
    docs = flat_text(spark, sf_dir)
    halves = [words.exploded(docs.where(F.pmod("doc_id", F.lit(2)) == k), label="lang").groupBy(F.col("word").alias("token")).agg(F.count(F.lit(1)).alias("freq")) for k in (0, 1)]
    return words.frequent(words.merge_frequencies(halves), 50)


@query(
    f"""SELECT concat_ws('+', CASE WHEN de THEN 'de' END, CASE WHEN en THEN 'en' END, CASE WHEN es THEN 'es' END, CASE WHEN fr THEN 'fr' END) AS combination,
    CAST(de AS BIGINT) + 2 * CAST(en AS BIGINT) + 4 * CAST(es AS BIGINT) + 8 * CAST(fr AS BIGINT) AS code, count(*) AS count
    FROM (SELECT word, {per_lang("bool_or(lang = '{}')")} FROM {WORDS} WHERE length(word) <= 30 GROUP BY word) GROUP BY 1, 2"""
)
def lang_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.combinations(word_lang_presence(spark, sf_dir), LANGS)


_LABELS = "(SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))"


@query(f"SELECT i AS code, coalesce(string_agg(lang, '+' ORDER BY k), '') AS combination FROM (SELECT unnest(range(1 << count(*)::INT)) AS i FROM {_LABELS}) LEFT JOIN {_LABELS} ON (i >> k::INT) & 1 = 1 GROUP BY i")
def all_label_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of the languages that the documents have."""
    found = read(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang").distinct()
    return words.all_combinations(found, sorted(r.lang for r in found.collect()))  # a few labels


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def rows_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query()
def rows_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.rows_per_file(read(spark, sf_dir, "documents"))


SUFFIX_CASE = " ".join(f"WHEN suffix(word, {literal(x)}) THEN {literal(x)}" for x in sorted(SUFFIXES, key=lambda x: (-len(x), x)))
PREFIX_CASE = " ".join(f"WHEN prefix(rest, {literal(x)}) THEN {literal(x)}" for x in sorted(PREFIXES, key=lambda x: (-len(x), x)))
_STEMS = f"""(SELECT suffix, prefix, substr(rest, length(prefix) + 1) AS root FROM (SELECT *, CASE {PREFIX_CASE} ELSE '' END AS prefix FROM
    (SELECT word, suffix, substr(word, 1, length(word) - length(suffix)) AS rest FROM (SELECT word, CASE {SUFFIX_CASE} ELSE '' END AS suffix FROM {WORDS} WHERE length(word) <= 30))))"""


@query(f"SELECT kind, token, count(*) AS freq FROM (UNPIVOT {_STEMS} ON prefix, root, suffix INTO NAME kind VALUE token) WHERE token <> '' GROUP BY 1, 2")
def stem_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of prefixes, roots and suffixes of all words; the affix lists are literals."""
    stems = morphology.stem(words.exploded(flat_text(spark, sf_dir), label="lang"), PREFIXES, SUFFIXES)
    return words.affix_frequency(stems)


@query(ORACLES["stem_freq"])
def stem_freq_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with affix tables, by equal-string joins on candidate lengths."""
    tables = [spark.createDataFrame([(a,) for a in x], "affix string") for x in (PREFIXES, SUFFIXES)]
    return words.affix_frequency(morphology.stem_join(words.exploded(flat_text(spark, sf_dir), label="lang"), *tables))


# ---- text operators


@query("SELECT doc_id, translate(text, {0}, {1}) AS text FROM documents".format(literal("".join(c for g in X.SIMILAR for c in g[1:])), literal("".join(g[0] for g in X.SIMILAR for _ in g[1:]))))
def similar_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.normalize_similar(F.col("text")).alias("text"))


@query(
    f"""SELECT word, list_reduce(list_concat([''], string_split(word, '')), lambda a, x: CASE WHEN x NOT BETWEEN '0' AND '9' AND right(a, 2) = x || x THEN a ELSE a || x END) AS squeezed
    FROM {DISTINCT} WHERE word <> ''"""
)
def squeeze_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_words(spark, sf_dir).where("word <> ''").select("word", X.squeeze_repeats(F.col("word")).alias("squeezed"))


@query("SELECT page_id, " + "regexp_replace(" * len(X.WEB_TAGS) + "html" + "".join(f", {literal(p.replace('$', chr(92) + 'z'))}, '', 'g')" for p in X.WEB_TAGS) + " AS text FROM pages")
def strip_web_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", X.strip_web_tags(F.col("html")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, 'http\S+|www\S+|https\S+', '', 'g'), '@\w+', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents")
def clean_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.clean_tweet(F.col("text")).alias("text"))


@query(f"SELECT word, trim(translate(lower(word), {literal(X.LEET_BACK[0])}, {literal(X.LEET_BACK[1])})) AS plain FROM {DISTINCT}")
def deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_words(spark, sf_dir).select("word", X.deobfuscate(F.col("word")).alias("plain"))


_TAGGED = "token"
for _p, _t in X.WORD_ENTITIES:
    _TAGGED = f"regexp_replace({_TAGGED}, {literal(_p.replace(chr(92) + 'w', '[0-9A-Za-z_]').replace('[[0-9A-Za-z_]', '[0-9A-Za-z_'))}, {literal(_t)}, 'g')"


@query(f"SELECT token, count(*) AS count FROM (SELECT {_TAGGED} AS token FROM (SELECT unnest(string_split_regex(text, '[ \t]')) AS token FROM documents) WHERE token <> '') WHERE starts_with(token, '<') GROUP BY 1")
def entity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often entity tags stand for tokens (with all other tokens that begin like one)."""
    tokens = read(spark, sf_dir, "documents").select(F.explode(X.tag_words(X.tokens(F.col("text")))).alias("token"))
    return tokens.where(F.startswith("token", F.lit("<"))).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


@query("SELECT doc_id, CAST(i AS INT) AS place, coalesce(list_filter(string_split_regex(text, '[ \t]'), lambda x: x <> '')[i + 1], '') AS word FROM documents, range(12) t(i)")
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.pad(X.tokens(F.col("text")), 12)).alias("place", "word"))


@query("SELECT doc_id, base64(encode(trim(line, ' '))) AS coded, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)")
def base64_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    coded = lines.select("doc_id", X.encode_line(F.col("line")).alias("coded"))
    return coded.select("doc_id", "coded", X.decode_line(F.col("coded")).alias("line"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, '\"') OR contains(text, chr(10)) THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS field FROM conversations")
def quoted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.quote_field(F.col("text")).alias("field"))


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 20 AND len(string_split(line, ' ')) >= 3 AND NOT starts_with(line, ' ')")
def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(X.keep_line(F.col("line")))


@query()
def wiki_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(X.wiki_lines(F.col("html"))).alias("place", "sentence"))


@query()
def notag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", exact.notag_normalize(F.col("text")).alias("text"))


@query()
def tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", exact.tag_normalize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def unicode_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", exact.nfc(F.col("text")).alias("text"))


@query()
def leet_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.leet_spellings(distinct_words(spark, sf_dir))


@query()
def arabizi_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return morphology.arabizi_closure(distinct_words(spark, sf_dir))


# ---- filters, joins and set operations


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.keep_last(read(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("SELECT doc_id, source FROM documents WHERE NOT regexp_matches(text, '(licen[sc]e|password|the )')")
def keyword_anti_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = X.keyword_pattern(["licen[sc]e\n", "password\n", "the \n", "a\n"])
    return duplicates.without_keywords(read(spark, sf_dir, "documents"), "text", pattern).select("doc_id", "source")


@query("SELECT coalesce(a.source, b.source) AS source, docs_n, labels_n FROM (SELECT source, count(*) AS docs_n FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS labels_n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1) b ON a.source = b.source")
def full_outer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    a = docs.where(F.col("lang").isin("en", "fr")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    b = docs.join(labels.where("quality = 0"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return words.combine_files({"docs": a, "labels": b}, key="source")


@query(f"SELECT word, 'fr only' AS kind FROM (SELECT word FROM {WORDS} WHERE lang = 'fr' EXCEPT SELECT word FROM {WORDS} WHERE lang = 'es') UNION ALL SELECT word, 'either' FROM (SELECT word FROM {WORDS} WHERE lang = 'fr' UNION SELECT word FROM {WORDS} WHERE lang = 'es')")
def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = flat_text(spark, sf_dir).select("lang", F.explode(F.split("text", " +")).alias("word"))
    fr, es = (every.where(F.col("lang") == k).select("word") for k in ("fr", "es"))
    return duplicates.concat([duplicates.difference(fr, es).withColumn("kind", F.lit("fr only")), duplicates.union([fr, es]).withColumn("kind", F.lit("either"))])


@query("SELECT doc_id, CASE quality WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' ELSE 'unknown' END AS class FROM labels")
def sentiment_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", X.sentiment_label(F.col("quality")).alias("class"))


# ---- morphology


@query("SELECT p_name AS word, CAST(cluster AS INT) AS cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY o, p_name) - 1 AS INT) AS place FROM (SELECT DISTINCT p_type, p_name, 1 AS o, dense_rank() OVER (ORDER BY p_type) - 1 AS cluster FROM part UNION SELECT p_type, p_type, 0, dense_rank() OVER (ORDER BY p_type) - 1 FROM part)")
def cluster_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.long_clusters(morphology.clusters(read(spark, sf_dir, "part"), "p_type", "p_name"), least=2)


@query("SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS index FROM documents")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.label_index(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


@query("SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'assistant'), 'NA') AS assistant, coalesce(max_by(text, turn) FILTER (role = 'system'), 'NA') AS system, coalesce(max_by(text, turn) FILTER (role = 'user'), 'NA') AS \"user\" FROM conversations GROUP BY conv_id")
def feature_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("feature"), F.col("text").alias("value"))
    return morphology.feature_pivot(rows, ["user", "assistant", "system"], ["conv_id"])


@query("SELECT p_partkey, " + ", ".join(f"CAST(list_contains(string_split(p_name, ' '), '{w}') AS INT) AS {w}" for w in ("bolt", "cold", "small")) + " FROM part")
def affix_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("; ")).alias("p_name"))
    return morphology.affix_indicators(part, "p_name", ["bolt", "cold", "small"]).drop("p_name")


@query("SELECT affix, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS affix FROM part) GROUP BY 1 HAVING count(*) >= 20")
def affix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("affix"))
    return part.groupBy("affix").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("SELECT event_id, " + ", ".join(f"CAST(event_type = '{t}' AS INT) AS event_type_{t}" for t in ("error", "purchase", "signup")) + " FROM events")
def one_hot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.one_hot(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["error", "signup", "purchase"])


@query("SELECT feature, value, count(*) AS count FROM (SELECT 'lang' AS feature, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1, 2")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.value_counts(read(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT count(DISTINCT lang) AS lang, count(DISTINCT source) AS source FROM documents")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.distinct_values(read(spark, sf_dir, "documents"), ["lang", "source"])


def annotated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as annotated lines: a word a line, tagged by its first letter's case, a comment before each turn."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split("text", r"[ \n\t]+"), lambda x: x != "").alias("w"))
    tag = lambda x: F.when(x.rlike("^[A-Z]"), "UP").otherwise("LOW")
    body = F.transform("w", lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), x, F.lit("_"), tag(x)))
    long = rows.select("conv_id", "turn", F.posexplode(F.concat(F.array(F.lit("# turn")), body, F.array(F.lit("")))).alias("i", "value"))
    return long.select("value", F.col("conv_id").alias("file"), (F.col("turn") * 100_000 + F.col("i")).alias("pos"))


TURNS = r"(SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \n\t]+'), lambda x: x <> '') AS w FROM conversations)"


@query(f"SELECT len(w) AS length, count(*) AS sentences FROM {TURNS} WHERE len(w) > 0 GROUP BY 1")
def sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.sentence_lengths(morphology.sentences(annotated_turns(spark, sf_dir))).select(F.col("length").cast("long").alias("length"), "sentences")


@query(f"SELECT CASE WHEN regexp_matches(x, '^[A-Z]') THEN 'UP' ELSE 'LOW' END AS tag, count(*) AS count FROM (SELECT unnest(w) AS x FROM {TURNS}) GROUP BY 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.tag_counts(morphology.sentences(annotated_turns(spark, sf_dir)))


@query(f"SELECT count(*) AS sentences, CAST(sum(len(w)) AS BIGINT) AS words, round(avg(len(w)), 6) AS mean_words FROM {TURNS} WHERE len(w) > 0")
def tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.tag_summary(morphology.sentences(annotated_turns(spark, sf_dir))).withColumn("mean_words", F.round("mean_words", 6))


# ---- character ids


TABLE = CharTable().with_ranges(SAMPLE_RANGES)


def _id_sql() -> str:
    code = "ord(c)"
    cases = [f"WHEN c = {literal(c)} THEN {i}" for i, c in enumerate(SPECIAL)]
    cases += [f"WHEN {code} BETWEEN {a} AND {b} THEN {code} - {a} + {base}" for base, (a, b) in zip(TABLE.bases, TABLE.ranges, strict=True)]
    cases += [f"WHEN {code} = {ord(c)} THEN {TABLE.single_base + i}" for i, c in enumerate(TABLE.singles)]
    return f"CASE {' '.join(cases)} ELSE {UNKNOWN} END"


_IDS = f"list_concat([3], list_transform(string_split(word, '')[1:17], lambda c: {_id_sql()}), [2], list_transform(range(20), lambda x: 0))[1:20]"


@query(f"SELECT word, array_to_string(ids, ' ') AS ids, CAST(len(list_filter(ids, lambda x: x <> 0)) AS INT) AS n FROM (SELECT word, {_IDS} AS ids FROM {DISTINCT} WHERE word <> '')")
def encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distinct_words(spark, sf_dir).where("word <> ''").select("word", TABLE.encode_word(F.col("word")).alias("ids"))
    return rows.select("word", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), F.aggregate(CharTable.attention(F.col("ids")), F.lit(0), lambda a, x: a + x).alias("n"))


def _decoded_sql() -> str:
    """A character as it comes back: the unknown mark without an id, a single character where it shares the id."""
    singles = " ".join(f"WHEN {TABLE.single_base + i} THEN {literal(c)}" for i, c in enumerate(TABLE.singles))
    return f"CASE {_id_sql()} WHEN {UNKNOWN} THEN {literal(SPECIAL[UNKNOWN])} {singles} ELSE c END"


@query(f"SELECT word, array_to_string(list_transform(string_split(word, '')[1:17], lambda c: {_decoded_sql()}), '') AS decoded FROM {DISTINCT} WHERE word <> ''")
def decode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = distinct_words(spark, sf_dir).where("word <> ''")
    return plain.select("word", TABLE.decode_word(TABLE.encode_word(F.col("word")), F.least(F.lit(17), F.char_length("word"))).alias("decoded"))


@query()
def masked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distinct_words(spark, sf_dir).select("word", TABLE.encode_word(F.col("word")).alias("ids"))
    return rows.select("word", TABLE.mask_ids(F.col("ids"), F.col("word"), 0.2).alias("m")).select("word", "m.ids", "m.labels")


# ---- vectors and metrics

_PAIR = "(SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y, a.label AS lx, b.label AS ly FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_EUC = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "embeddings")
    return a.select("vec_id", F.col("embedding").alias("x"), F.col("label").alias("lx")).join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"), F.col("label").alias("ly")), "vec_id")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


@query(f"SELECT round(avg({_COS.format('x', 'y')}), 6) AS mean_cosine, round(avg({_EUC.format('x', 'y')}), 6) AS mean_euclid FROM {_PAIR}")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.mean_similarity(_pairs(spark, sf_dir)))


_HEADS = """(SELECT vec_id, label, embedding::DOUBLE[] AS v, first_value(embedding::DOUBLE[]) OVER (PARTITION BY run ORDER BY vec_id) AS h, row_number() OVER (PARTITION BY run ORDER BY vec_id) AS r
 FROM (SELECT *, sum(CASE WHEN label IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (ORDER BY vec_id) AS run FROM (SELECT *, lag(label) OVER (ORDER BY vec_id) AS prev FROM embeddings)))"""


@query(f"SELECT round(sum({_COS.format('v', 'h')}) / (SELECT count(*) - count(DISTINCT label) FROM embeddings), 6) AS mean_cosine, round(sum({_EUC.format('v', 'h')}) / (SELECT count(*) - count(DISTINCT label) FROM embeddings), 6) AS mean_euclid FROM {_HEADS} WHERE r > 1")
def to_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.to_representative(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (SELECT l_quantity, l_extendedprice, {_RANK.format('l_quantity')} AS rx, {_RANK.format('l_extendedprice')} AS ry FROM lineitem)")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    both = metrics.pearson(rows, "l_quantity", "l_extendedprice").crossJoin(metrics.spearman(rows, "l_quantity", "l_extendedprice"))  # one row each
    return rounded(both)


_CELLS = "(SELECT l_quantity AS x, l_discount AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2)"


@query(f"""SELECT round(s / sqrt((m * (m - 1) / 2 - tx) * (m * (m - 1) / 2 - ty)), 6) AS kendall FROM
    (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM {_CELLS} a JOIN {_CELLS} b ON a.x < b.x), (SELECT sum(n) AS m FROM {_CELLS}),
    (SELECT sum(n * (n - 1) / 2) AS tx FROM (SELECT sum(n) AS n FROM {_CELLS} GROUP BY x)), (SELECT sum(n * (n - 1) / 2) AS ty FROM (SELECT sum(n) AS n FROM {_CELLS} GROUP BY y))""")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.kendall(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount"))


_TWO = "{0} * ({0} - 1) / 2.0"


@query(f"""SELECT round((s - a * b / p) / ((a + b) / 2 - a * b / p), 6) AS ari FROM
    (SELECT sum({_TWO.format('n')}) AS s, {_TWO.format('sum(n)')} AS p FROM (SELECT count(*) AS n FROM labels GROUP BY quality, toxic)),
    (SELECT sum({_TWO.format('n')}) AS a FROM (SELECT count(*) AS n FROM labels GROUP BY quality)), (SELECT sum({_TWO.format('n')}) AS b FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))""")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.adjusted_rand(read(spark, sf_dir, "labels"), "quality", "toxic"))


_REPORT = """(SELECT class, sum(s) AS support, sum(p) AS said, sum(h) AS hit FROM (SELECT quality AS class, 1 AS s, 0 AS p, 0 AS h FROM labels UNION ALL SELECT toxic, 0, 1, CASE WHEN quality = toxic THEN 1 ELSE 0 END FROM labels) GROUP BY class)"""
_SCORES = f"(SELECT CAST(class AS VARCHAR) AS class, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support, hit FROM (SELECT *, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall FROM {_REPORT}))"


@query(f"""SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM (SELECT class, precision, recall, f1, support FROM {_SCORES}
    UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM {_SCORES}
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM {_SCORES}
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM {_SCORES})""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_report(read(spark, sf_dir, "labels"), "quality", "toxic"), 4)


@query(f"""SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (SELECT k, max(CASE WHEN l = l2 THEN d / n END) AS a, min(CASE WHEN l <> l2 THEN d / n END) AS b FROM
    (SELECT p.vec_id AS k, p.label AS l, q.label AS l2, sum({_EUC.format('p.v', 'q.v')}) AS d, count(*) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) p
    JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) q ON p.vec_id <> q.vec_id GROUP BY 1, 2, 3) GROUP BY k)""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.silhouette(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))


@query("""SELECT CAST(i AS INT) AS part, round(CASE i WHEN 0 THEN xz * yy - yz * xy ELSE yz * xx - xz * xy END / (xx * yy - xy * xy), 6) AS weight FROM range(2) t(i), (SELECT sum(list_dot_product(x, x)) AS xx, sum(list_dot_product(y, y)) AS yy,
    sum(list_dot_product(x, y)) AS xy, sum(list_dot_product(x, z)) AS xz, sum(list_dot_product(y, z)) AS yz FROM (SELECT a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y, c.embedding::DOUBLE[] AS z
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2))""")
def ols_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights with which two vectors make the third."""
    third = read(spark, sf_dir, "embeddings").select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("z"))
    weights = models.fit_weights(_pairs(spark, sf_dir).join(third, "vec_id"), "z", ["x", "y"])
    return spark.createDataFrame([(i, round(float(w), 6)) for i, w in enumerate(weights)], "part int, weight double")


@query("SELECT label, round(sqrt(sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS norm FROM embeddings GROUP BY label")
def frobenius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.frobenius(read(spark, sf_dir, "embeddings"), "label", "embedding"), 5)


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best, CAST(embedding[1] > 0 AS INT) AS first_positive FROM embeddings")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", V.argmax(F.col("embedding")).alias("best"), V.binary_decision(F.col("embedding")[0]).alias("first_positive"))


@query("SELECT round(avg(top + ln(list_sum(list_transform(v, lambda x: exp(x - top)))) - v[label + 1]), 6) AS loss FROM (SELECT embedding::DOUBLE[] AS v, list_max(embedding)::DOUBLE AS top, label FROM embeddings)")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cross_entropy(read(spark, sf_dir, "embeddings"), "embedding", "label"))


@query("SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss FROM lineitem")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.weighted_loss(read(spark, sf_dir, "lineitem"), "l_discount", "l_quantity"))


@query("SELECT vec_id, CAST(j AS INT) AS place, round(ln(v[j + 1] - low + 1e-6), 5) AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), (SELECT min(list_min(embedding))::DOUBLE AS low FROM embeddings), range(64) t(j)")
def log_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = models.log_scale(read(spark, sf_dir, "embeddings"), "embedding")
    return rounded(scaled.select("vec_id", F.posexplode("embedding").alias("place", "value")), 5)


@query()
def kmeans_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    found = models.kmeans(rows, "embedding", rows.select("label").distinct().count())
    return metrics.adjusted_rand(found, "label", "found")


# ---- splits, chunks and streams


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS INT) AS chunk FROM orders")
def chunk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chunks(read(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey", None)


@query()
def shuffled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chunks(read(spark, sf_dir, "orders").select("o_orderkey"), 1000, "o_orderkey")


@query()
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(read(spark, sf_dir, "labels"), ["quality", "toxic"], "doc_id")


@query(f"SELECT word, lang AS label, count(*) AS freq FROM (SELECT lang, unnest(string_split_regex(text, ' +')) AS word FROM documents) WHERE length(word) <= 30 GROUP BY 1, 2")
def stream_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running word counts over the documents as a stream of files, kept as a table in the shared folder."""
    schema = read(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents.parquet*")
    counts = stateful.MergedCounts(spark, ["word", "label"], "freq")
    counts.start(streams.running_counts(stream, label="lang"), f"{counts.path}-checkpoint").awaitTermination()
    return counts.read()
