"""Sources, sinks and operators on small invented tables."""

import base64
import json
import math
import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom import cli
from wordloom.functions import vectors as V
from wordloom.operators import duplicates, metrics, models, morphology, splits, words
from wordloom.sources import readers, writers
from wordloom.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def at(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def test_tables(spark, at, tmp_path):
    p = at("a.csv", 'word\tcluster\nNA\t1\n"say ""x"""\t2\n\t3\n')
    assert rows(readers.cluster_table(spark, p)) == [("", 3), ("NA", 1), ('say "x"', 2)]
    assert rows(readers.string_table(spark, p, ["w", "c"])) == [("", "3"), ("NA", "1"), ('say "x"', "2")]
    assert rows(readers.table(spark, at("s.csv", "a;b;0.5\n"), "x string, y string, s double", ";", False)) == [("a", "b", 0.5)]
    out = str(tmp_path / "out")
    writers.write_table(readers.cluster_table(spark, p), out)
    assert rows(readers.cluster_table(spark, out)) == [("", 3), ("NA", 1), ('say "x"', 2)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.lines(spark, str(tmp_path / "none")).collect()


def test_noise_tagging_and_lists(spark, at):
    assert rows(readers.noise_table(spark, at("n.csv", "word\tobfus1fix\tobfus1var\na\tb\tc\n"))) == [("a", "b", "c")]
    p = at("t.txt", "a b\tX Y\n\nbroken\na b\tX\n c  d e \t P Q R \n")
    assert sorted((r.words, r.tags) for r in readers.tagged_sentences(spark, p).collect()) == [(["a", "b"], ["X", "Y"]), (["c", "d", "e"], ["P", "Q", "R"])]
    assert sorted((r.words, r.tags) for r in readers.tagged_sentences(spark, p, 2).collect()) == [(["a", "b"], ["X", "Y"]), (["c", "d"], ["P", "Q"])]
    assert readers.tagged_sentences(spark, p, 4).where("words[0] = 'a'").first().tags == ["X", "Y", "<PAD>", "<PAD>"]
    assert rows(readers.affix_file(spark, at("p.txt", "# no\nre\n\nun\nre\n"))) == [("re",), ("un",)]
    assert rows(readers.word_list(spark, at("w.txt", " a \n\nb\n"))) == [("a",), ("b",)]
    assert readers.keyword_file(spark, at("k.txt", "ab\nc\nd.\n")) == "(ab|d.)"
    assert readers.config(spark, at("c.json", '{"a": [1, 2]}')) == {"a": [1, 2]}


def test_files_and_folders(spark, at, tmp_path):
    at("x.csv", "h\n1\n2\n")
    at("y.txt", "z")
    (tmp_path / "sub").mkdir()
    assert [r.path.rsplit("/", 1)[1] for r in readers.files(spark, str(tmp_path), ".csv").collect()] == ["x.csv"]
    assert readers.subfolders(spark, str(tmp_path)) == ["sub"]
    assert rows(words.rows_per_file(readers.table(spark, str(tmp_path / "x.csv"), "h int"))) == [("x.csv", 2)]


def test_sqlite(spark, tmp_path):
    p = str(tmp_path / "d.db")
    with sqlite3.connect(p) as db:
        db.execute("CREATE TABLE verbs (root TEXT, n INTEGER)")
        db.executemany("INSERT INTO verbs VALUES (?, ?)", [(f"r{i}", i) for i in range(50)])
    assert rows(readers.sqlite_table(spark, p, "verbs", 7)) == sorted([(f"r{i}", i) for i in range(50)], key=str)
    with pytest.raises(Exception, match="not a table name"):
        readers.sqlite_table(spark, p, "verbs; drop").collect()


def test_line_formats(spark, at, tmp_path):
    p = at("j.jsonl", json.dumps({"text": "a", "label": 2}) + "\n" + json.dumps({"label": 7}) + "\nbroken\n")
    assert rows(readers.json_lines(spark, p)) == [("", "unknown"), ("", "unknown"), ("a", "positive")]
    assert rows(readers.tatoeba(spark, at("o.tsv", "1\tfra\tsalut\n2\tdeu\tja\n3\tfra\n"), ["fra"])) == [("1", "fra", "salut")]
    assert readers.unimorph(spark, at("u.tsv", "go\twent\tV;PST\n")).first().tags == ["V", "PST"]
    assert [(r.ids, r.mask, r.labels) for r in readers.encoded_words(spark, at("e.csv", "3,2,1,1,0\n"), 2, 1).collect()] == [([3, 2], [1, 1], [0])]
    coded = str(tmp_path / "coded")
    writers.write_encoded_lines(readers.lines(spark, at("l.txt", " a\tb \n" + "é" * 90 + "\n")), coded)
    assert base64.b64decode(spark.read.text(coded).where("length(value) < 20").first().value) == b"a\tb"
    assert rows(readers.decoded_lines(spark, coded)) == [("a\tb",), ("é" * 90,)]
    xml = at("w.xml", "<m><page><title>T</title><revision><text>body</text></revision></page></m>")
    assert rows(readers.pages(spark, xml)) == [("T", "body")]
    assert rows(writers.labelled(readers.lines(spark, at("q.txt", "a\tb\n")), "value", "fr")) == [("a b", "fr")]


def test_hub_path_and_columns(spark):
    assert [readers.hub_path(x) for x in ("hf:m:v", "hf:m", "m/n")] == [("hf", "m", "v"), ("hf", "m", None), ("local", "m/n", None)]
    df = spark.createDataFrame([("a", 1, 0)], "w string, x int, y int")
    assert tuple(readers.labelled_columns(df).first()) == ("a", [1.0, 0.0])


def test_words(spark):
    docs = spark.createDataFrame([("a b  a", "x"), ("b " + "c" * 31, "y"), (None, "x")], "text string, label string")
    assert rows(words.frequency(docs)) == [("a", 2, 0), ("b", 1, 1)]
    assert rows(words.presence(docs)) == [("a", 1, 0), ("b", 1, 1)]
    assert rows(words.combinations(words.presence(docs), ["x", "y"])) == [("x", 1, 1), ("x+y", 3, 1)]
    assert len(rows(words.all_combinations(docs, ["p", "q", "r"]))) == 8
    stems = spark.createDataFrame([("re", "do", ""), ("", "<nbr>", "s")], "prefix string, root string, suffix string")
    assert rows(words.affix_frequency(stems)) == [("prefix", "re", 1), ("root", "<nbr>", 1), ("root", "do", 1), ("suffix", "s", 1)]
    assert ("root", "<nbr>", 2) in rows(words.affix_frequency(stems, True))


def test_clusters(spark):
    pairs = spark.createDataFrame([("b", "bs"), ("b", "b"), ("a", "a"), ("b", "ba"), ("", "x")], "root string, word string")
    grouped = morphology.clusters(pairs)
    assert {r.root: r.forms for r in grouped.collect()} == {"a": [], "b": ["ba", "bs"], "": ["x"]}
    assert rows(morphology.long_clusters(grouped)) == [("a", 0, 0), ("b", 1, 0), ("ba", 1, 1), ("bs", 1, 2)]
    assert rows(morphology.long_clusters(grouped, 3)) == [("b", 0, 0), ("ba", 0, 1), ("bs", 0, 2)]
    typed = spark.createDataFrame([("n", "b"), ("n", "a")], "wordtype string, word string")
    assert rows(morphology.typed_clusters(typed)) == [("n", ["a", "b"])]
    df = spark.createDataFrame([("é",), (None,), ("a",), ("a",), ("zz",), ("zy",)], "k string")
    assert sorted((r.k, r["index"]) for r in morphology.dense_index(df.where("k is not null"), "k").collect()) == [("a", 0), ("a", 0), ("zy", 1), ("zz", 2), ("é", 3)]


def test_inflections(spark):
    forms = spark.createDataFrame([("go", "went", ["V", "PST", "X1"]), ("go", "going", ["V.PTCP", "PRS"]), ("ox", "oxen", ["N", "PL"])], "lemma string, form string, tags array<string>")
    dim = spark.createDataFrame([("V", "pos", "V"), ("N", "pos", "N"), ("PST", "tense", "past"), ("X1", "tense", "last"), ("PL", "number", "pl")], "tag string, feature string, value string")
    out = morphology.inflections(forms, dim, ["tense", "number"], True)
    assert [r.asDict() for r in out.collect()] == [{"lemma": "go", "word": "went", "number": "NA", "tense": "last"}]
    assert rows(morphology.inflections(forms, dim, ["number"], False).select("word", "number")) == [("oxen", "pl")]
    with pytest.raises(Exception, match="unknown tag PRS"):
        morphology.lookup(forms.select(F.explode("tags").alias("key")), "key", dim).collect()


def test_affixes(spark):
    df = spark.createDataFrame([(1, "-s; -ship"), (2, "-ship"), (3, None)], "i int, a string")
    assert rows(morphology.distinct_affixes(df, "a")) == [("-s",), ("-ship",)]
    assert morphology.frequent_affixes(df, "a", 2) == ["-ship"]
    assert rows(morphology.affix_indicators(df, "a", ["-s"]).select("i", "-s")) == [(1, 1), (2, 0), (3, 0)]
    assert rows(morphology.affix_indicators(df, "a", ["-s"], True).select("i", "-s")) == [(1, 1), (2, 1), (3, 0)]
    assert morphology.one_hot(df, "a", ["x", "y"]).columns == ["i", "a"]


def test_stemming(spark):
    df = spark.createDataFrame([("unredoings",), ("re",), ("word",), ("",), ("ings",)], "word string")
    want = [("", "", "", ""), ("ings", "", "", "ings"), ("re", "re", "", ""), ("unredoings", "un", "redo", "ings"), ("word", "", "word", "")]
    assert rows(morphology.stem(df, ["un", "u", "re"], ["s", "ings", "ing"]).select("word", "prefix", "root", "suffix")) == want
    tables = [spark.createDataFrame([(a,) for a in x], "affix string") for x in (["un", "u", "re"], ["s", "ings", "ing"])]
    assert rows(morphology.stem_join(df, *tables).select("word", "prefix", "root", "suffix")) == want


def test_sentences(spark, at):
    p = at("c.conllu", "# id\n1\tLe\tle\tDET\n2-3\tdu\t_\t_\n\n# x\n1\tchat\tchat\tNOUN")
    out = morphology.sentences(readers.conllu_lines(spark, p))
    assert rows(out.select("words", "tags")) == [(["Le", "du"], ["DET", "_"]), (["chat"], ["NOUN"])]
    assert tuple(morphology.tag_summary(out).first()) == (2, 3, 1.5)
    assert rows(morphology.tag_counts(out)) == [("DET", 1), ("NOUN", 1), ("_", 1)]
    assert rows(morphology.sentence_lengths(out)) == [(1, 1), (2, 1)]


def test_closure(spark):
    df = spark.createDataFrame([("choux",), ("x",)], "word string")
    assert {r.variant for r in morphology.arabizi_closure(df).collect()} == {"shoux", "9houx", "chox", "choox", "shox", "shoox", "9hox", "9hoox"}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 3), (3, "b", 2), (4, None, 1), (5, None, 2)], "i int, t string, o int")
    assert rows(duplicates.keep_last(df, ["t"], "o").select("i")) == [(2,), (3,), (5,)]
    assert rows(duplicates.without_keywords(df, "t", "(a)").select("i")) == [(3,), (4,), (5,)]
    assert duplicates.without_keywords(df, "t", None).count() == 5
    other = spark.createDataFrame([("v", "u", "T")], "vid string, url string, title string")
    assert duplicates.index_videos(spark.createDataFrame([("v", "c")], "vid string, text string"), other).columns == ["text", "link", "title"]


def test_splits(spark, tmp_path):
    df = spark.range(1003).withColumn("k", F.col("id") % 3)
    chunked = splits.chunks(df, 100, "id")
    assert sorted(Counter(r.chunk for r in chunked.collect()).values()) == [3] + [100] * 10
    assert rows(chunked) == rows(splits.chunks(df.repartition(7), 100, "id"))
    assert {r.id: r.chunk for r in splits.chunks(df, 100, "id", None).collect()} == {i: i // 100 for i in range(1003)}
    assert [r.id for r in splits.shuffle(df, "id").collect()] != list(range(1003))
    parts = Counter((r.k, r.split) for r in splits.stratified(df, ["k"], "id").collect())
    assert all(abs(parts[k, "train"] - 0.6 * (parts[k, "train"] + parts[k, "test"])) <= 1 for k in range(3))
    assert abs(splits.hashed_split(df, "id").where("split = 'train'").count() / 1003 - 0.6) < 0.06
    writers.write_chunks(chunked, str(tmp_path / "chunks"), 100)
    assert len(list((tmp_path / "chunks").glob("chunk=*/*.csv"))) == 11


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0], [0.0, 0.0, 0.0], [[9.0, 9.0], [1.0, 3.0], [3.0, 5.0], [8.0, 8.0]])], "a array<float>, b array<float>, z array<float>, t array<array<float>>")
    r = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine(F.col("a"), F.col("z")).alias("n"), V.cosine(F.col("a"), F.col("z"), 1e-6).alias("f"), V.euclid(F.col("a"), F.col("b")).alias("e"), V.softmax(F.col("a")).alias("s"), V.mean_tokens(F.col("t")).alias("m"), V.mean_tokens(F.col("t"), 1, False).alias("m2"), V.argmax(F.col("a")).alias("x"), V.sigmoid(F.lit(0.0)).alias("g"), V.power(F.col("a"), 2.0).alias("p")).first()
    assert math.isclose(r.c, 4 / (3 * math.sqrt(5)))
    assert (r.n, r.f) == (None, 0.0)
    assert math.isclose(r.e, math.sqrt(6))
    assert math.isclose(sum(r.s), 1)
    assert (r.m, r.m2) == ([2.0, 4.0], [4.0, 16 / 3])
    assert (r.x, r.g, r.p) == (1, 0.5, [1.0, 4.0, 4.0])
    pieces = spark.createDataFrame([(["[CLS]", "un", "##do", "it", "[SEP]"], ["<s>", "▁un", "do", "</s>"], ["<s>", "un", "do</w>", "it</w>"])], "a array<string>, b array<string>, c array<string>")
    r = pieces.select(V.word_starts(F.col("a")).alias("a"), V.word_starts(F.col("b"), "space").alias("b"), V.word_starts(F.col("c"), "</w>").alias("c")).first()
    assert (r.a, r.b, r.c) == ([False, True, False, True, False], [False, True, False, False], [False, True, False, True])


def test_metrics(spark):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (2, 2), (2, 3), (4, 3), (5, 1)])], "i int, x double, y double")
    assert math.isclose(metrics.kendall(df, "x", "y").first()[0], 1 / math.sqrt(72))
    rx, ry = [1, 2.5, 2.5, 4, 5], [1.5, 3, 4.5, 4.5, 1.5]
    assert math.isclose(metrics.spearman(df, "x", "y").first()[0], np.corrcoef(rx, ry)[0, 1])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 3), (2, 2)], "t int, f int")
    assert math.isclose(metrics.adjusted_rand(labels, "t", "f").first()[0], (1 - 2 * 1 / 6) / (1.5 - 2 * 1 / 6))
    assert metrics.adjusted_rand(labels, "t", "t").first()[0] == 1.0
    report = {r["class"]: r for r in metrics.classification_report(labels, "t", "f").collect()}
    assert (report["2"].precision, report["2"].recall, report["3"].f1, report["accuracy"].f1) == (1.0, 0.5, 0.0, 0.75)
    losses = spark.createDataFrame([(1.0, 1), (4.0, 3)], "loss double, n int")
    assert metrics.weighted_loss(losses).first()[0] == 3.25
    logits = spark.createDataFrame([([0.0, 100.0], [1.0, 1.0], 1)], "z array<double>, y array<double>, l int")
    assert math.isclose(metrics.binary_cross_entropy(logits, "z", "y").first()[0], math.log(2) / 2)
    assert metrics.cross_entropy(logits, "z", "l").first()[0] == 0.0
    assert set(metrics.evaluate(labels, "t", "f", {"ari": metrics.adjusted_rand})) == {"ari"}
    assert rows(metrics.confusion(labels, "t", "f")) == [(1, 1, 2), (2, 2, 1), (2, 3, 1)]


def test_models(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(200, 4)), rng.normal(size=(4, 3))
    y = x @ w
    df = spark.createDataFrame([(i, a.tolist(), b.tolist(), (a * 2).tolist(), int(a[0] > 0)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x array<double>, y array<double>, t array<double>, l int")
    assert np.allclose(models.fit_weights(df.withColumn("t", V.add(V.scale(F.col("x"), 2.0), V.scale(F.reverse("x"), -0.5))).withColumn("r", F.reverse("x")), "t", ["x", "r"]), [2.0, -0.5])
    matrix, alpha = models.fit_ridge(df, "x", "y", "i")
    assert alpha == 1e-6
    assert np.allclose(matrix, w, atol=1e-6)
    mapped = models.apply_map(df, "x", matrix).first()
    assert np.allclose(mapped.mapped, mapped.y, atol=1e-6)
    assert np.allclose(models.apply_weights(df, ["x", "t"], np.array([1.0, 0.5])).first().composed, 2 * x[0])
    assert np.allclose(models.compose_product(df, ["x", "t"]).first().composed, 2 * x[0] ** 2)
    assert len(models.pca(df, "x", 2).first().reduced) == 2
    found = models.probe(df.where("i < 150"), df.where("i >= 150"), "x", "l", 50)
    assert found.where("l = found").count() >= 45
    three = df.withColumn("l", F.pmod("i", F.lit(3)))
    assert models.probe(three, three, "x", "l", 5).count() == 200
    assert models.kmeans(df, "x", 2).select("found").distinct().count() == 2
    assert (models.heads(2), models.heads(3)) == ("binary", "multiclass")
    encoded = models.encode(df.select("i"), "i", lambda: lambda values: np.array([[v, v + 1] for v in values]), batch=7)
    assert {r.i: list(r.embedding) for r in encoded.collect()} == {i: [float(i), i + 1.0] for i in range(200)}
    assert math.isclose(models.frobenius(df, "l", "x").agg(F.sum(F.col("norm") * F.col("norm"))).first()[0], (x * x).sum())


def test_streams(spark, at, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text("text\tlabel\na b\tx\nb\ty\n")
    stream = streams.files_stream(spark, str(tmp_path / "in"), "text string, label string")
    streams.start_memory(streams.running_counts(stream), "counts").awaitTermination()
    assert rows(spark.table("counts")) == [("a", "x", 3), ("b", "x", 3), ("b", "y", 3)]
    query = streams.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "check"), lambda b: b.withColumn("n", F.length("text")))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert sum(df.count() for df in streams.epochs(spark, [str(tmp_path / "in" / f"{k}.csv") for k in range(3)], lambda p: readers.table(spark, p, "text string, label string"))) == 6
    (tmp_path / "events").mkdir()
    at("events/e.csv", "ts\tk\n2024-01-01 00:00:10\ta\n2024-01-01 00:00:20\ta\n2024-01-01 00:05:00\tb\n")
    events = spark.readStream.schema("ts timestamp, k string").option("sep", "\t").option("header", True).csv(str(tmp_path / "events"))
    streams.start_memory(streams.windowed_counts(events, "ts", "k", "1 minute", "1 hour"), "windows").awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]


def test_command_line(spark, at, tmp_path):
    out = lambda name: str(tmp_path / name)
    corpus = at("c.csv", "text\tlabel\nrun runs :)\tx\nruns 12\ty\n")
    cli.main(["words", "extract", corpus, out("freq"), "--freq"])
    assert rows(readers.string_table(spark, out("freq"), ["word", "x", "y"])) == [("12", "0", "1"), (":)", "1", "0"), ("run", "1", "0"), ("runs", "1", "1")]
    cli.main(["words", "info", out("freq"), out("info"), "--columns", "word,x,y"])
    assert rows(readers.string_table(spark, out("info"), ["combination", "count"])) == [("x", "2"), ("x+y", "1"), ("y", "1")]
    cli.main(["words", "split", out("freq"), out("split"), "--rows", "2", "--shuffle", "--columns", "word,x,y"])
    cli.main(["vocab", "freq", corpus, out("vf"), "--prefixes", at("p.txt", "re\n"), "--suffixes", at("s.txt", "s\n"), "--norm"])
    assert rows(readers.string_table(spark, out("vf/root"), ["token", "freq"])) == [(":)", "1"), ("<nbr>", "1"), ("run", "3")]
    cli.main(["vocab", "combine", f"{out('vf/root')},{out('vf/suffix')}", out("vc")])
    cli.main(["vocab", "reduce", out("vc"), out("vr"), "--least", "2"])
    cli.main(["vocab", "vocab", out("vr"), out("vv")])
    assert rows(spark.read.text(out("vv"))) == [("run",), ("s",)]
    cli.main(["vocab", "affix", at("p2.txt", "un\nre\n"), out("va")])
    comments = at("v.csv", "vid\ttext\n1\thi\n2\tbad word\n1\thi\n")
    cli.main(["comments", "nodup", comments, out("nd"), "--columns", "vid,text", "--subset", "vid,text"])
    assert len(rows(spark.read.text(out("nd")))) >= 3
    cli.main(["comments", "kwfilter", comments, out("kw"), "--columns", "vid,text", "--keywords", at("k.txt", "bad\n")])
    cli.main(["comments", "idxjoin", comments, out("ij"), "--columns", "vid,text", "--index", at("i.csv", "vid\turl\n1\tu\n"), "--index-columns", "vid,url"])
    cli.main(["comments", "normalize", comments, out("cn"), "--columns", "vid,text", "--tags"])
    cli.main(["comments", "combine", comments, out("cc"), "--columns", "vid,text", "--label", "fr"])
    cli.main(["wiki", "prepare", at("w.xml", "<m><page><title>T</title><revision><text>A sentence that is long enough to stay. No.</text></revision></page></m>"), out("wp")])
    assert rows(spark.read.text(out("wp"))) == [("A sentence that is long enough to stay.",)]
    cli.main(["wiki", "normalize", out("wp"), out("wn")])
    cli.main(["wiki", "combine", out("wn"), out("wc"), "--label", "en"])
    cli.main(["tatoeba", "extract", at("o.tsv", "1\tfra\tsalut :)\n"), out("to"), "--langs", "fra"])
    assert rows(readers.string_table(spark, out("to"), ["text", "label"])) == [("salut 🙂", "fra")]
    cli.main(["forms", "extract", at("f.tsv", "go\twent\ngo\tgoing\n"), out("fo")])
    assert rows(readers.cluster_table(spark, out("fo"))) == [("go", 0), ("going", 0), ("went", 0)]
    cli.main(["taboo", "extract", at("b.txt", "ch\n"), out("tb")])
    assert ("sh", 0) in rows(readers.cluster_table(spark, out("tb")))
    cli.main(["taboo", "protect", at("b.txt", "ch\n"), out("tp")])
    assert rows(readers.decoded_lines(spark, out("tp"))) == [("ch",)]
