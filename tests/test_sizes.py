"""What shows only on larger tables: folders of part files, work that repeats itself, copies of rows, batches."""

from pyspark.sql import functions as F

from wordloom.functions import exact, wikitext
from wordloom.operators import metrics, morphology, sentences
from wordloom.plans import analysis, catalogue, coverage, roundtrips  # noqa: F401  (they add their queries to the catalogue)

QUERIES = catalogue.QUERIES


def test_a_folder_of_parts_is_one_file(spark, tmp_path):
    spark.range(10, numPartitions=3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.range(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = [[tuple(r) for r in QUERIES["file_rows"](spark, f"{tmp_path}/{x}").collect()] for x in "ab"]
    assert got == [[("documents.parquet", 10)], [("documents.parquet", 0)]]


def test_tokens_are_looked_at_once(spark, tmp_path, monkeypatch):
    """the kind of a token is found from the counts of different tokens, so texts are read for counting once."""
    made = []
    monkeypatch.setattr(sentences, "stored", lambda df, name: made.append(df.count()) or df)
    texts = spark.createDataFrame([("Dr. Dr. end. " * 500,)] * 3, "text string")
    assert {tuple(r) for r in sentences.stop_counts(texts).collect()} == {("dr", 3000, 0), ("end", 1500, 0)}
    sentences.learn(texts)
    assert made == [2, 2]


def test_starts_without_cells(spark):
    """only what may be an end and a name is paired, and the counts are those of all pairs."""
    texts = spark.createDataFrame([("(He came.) The end; the End? The 3. Day. the",), ("The",), (None,), ("",)], "text string")
    short = spark.createDataFrame([("none",)], "word string")
    got = {r.word: (r.at_start, r.anywhere) for r in sentences.starter_scores(texts, short).collect()}
    assert got == {"the": (2, 5)}


def test_balanced_markup_is_one_step():
    """what is closed as it was opened takes one match, however its parts are nested."""
    for source in ("{{box|{{inner|x}}|{{{1|y}}}}}", "<ref>see {{cite|[[z]]}}</ref>", "[[File:p.jpg|thumb|A [[q|caption]]]]", "{|\n| {{t}}\n{|\n|}\n|}", "[[a|b]]"):
        assert [m.span() for m in wikitext.MARKS.finditer(source)] == [(0, len(source))]
    assert wikitext.plain("{{a}}}b {{{c}}}}d {|{{e}}}|}f [[g|{{h}}|}i]]") == "b d f }i"


def test_silhouette_copies(spark):
    """a row goes to as many tasks as there are blocks of 2^16, not of 2048."""
    assert metrics.BLOCK >= 1 << 16
    rows = spark.range(3000).select(F.col("id").alias("k"), F.array(F.col("id").cast("float"), (F.col("id") % 7).cast("float")).alias("v"), (F.col("id") % 3).alias("l"))
    a, b = (metrics.silhouette(rows, "k", "v", "l", block=x).first()[0] for x in (500, 1 << 16))
    assert abs(a - b) < 1e-9


def test_small_batches(spark, sf_dir):
    """whole texts go to Python in batches of 4 MB, and ASCII ones not at all."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        catalogue.read(spark, sf_dir, "documents")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    texts = spark.createDataFrame([("plain",), ("é",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(exact.nfc(F.col("t"))).collect()] == ["plain", "é", None, ""]


def test_spellings_in_lists():
    """spellings come in lists, made of beginnings and endings."""
    made = list(morphology.leet_of("associatesassociates"))
    assert max(map(len, made)) == morphology.ENDINGS
    assert sum(map(len, made)) == len({x for y in made for x in y}) > 50 * len(made)
    assert list(morphology.leet_of("xyz")) == []


def test_closure_word_by_word(spark, monkeypatch):
    """F8: small closures need no rounds of joins; large ones still go through them, with the same results."""
    rows = spark.createDataFrame([("shsty",), (None,), ("x",), ("choukh",)], "word string")
    want = sorted(tuple(r) for r in morphology.arabizi_closure(rows).collect())
    assert want
    monkeypatch.setattr(morphology, "closure_of", lambda word, rounds: None)
    assert sorted(tuple(r) for r in morphology.arabizi_closure(rows).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(morphology.X, "arabizi_variants", None)
    assert sorted(tuple(r) for r in morphology.arabizi_closure(rows).collect()) == want
    assert morphology.closure_of("tststy", 1000, most=3) is None


def test_vocabulary_of_different_words(spark, tmp_path):
    """the table function sees each word of a language once."""
    rows = [(1, "the the walking the", "en", "s"), (2, "the", "de", "s"), (3, None, "de", "s"), (4, "the\n the\tre" + "x" * 31, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    done = QUERIES["vocab_udtf_by_lang"](spark, str(tmp_path))
    assert {(r.lang, r.kind, r.token): r.freq for r in done.collect()} == {("en", "prefix", "th"): 3, ("en", "root", "e"): 3, ("en", "root", "walk"): 1, ("en", "suffix", "ing"): 1, ("de", "prefix", "th"): 1, ("de", "root", "e"): 1, (None, "prefix", "th"): 2, (None, "root", "e"): 2}
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("vocab_words"):]
    assert "Aggregate" in below


def test_spellings_are_spread(spark):
    """F3, F8: few bytes of words are many spellings, so they go to more than one task."""
    rows = spark.range(400).select(F.concat(F.lit("state"), F.col("id").cast("string")).alias("word")).distinct()
    assert morphology.leet_spellings(rows).select(F.spark_partition_id()).distinct().count() > 4
