"""Streams with state: sentences over several batches, merged counts, recorded losses."""

from collections import Counter

from pyspark.sql import functions as F

from wordloom.streaming import recorders, stateful, streams

LINES = "value string, file string, pos long"


def lines(*words):
    return [f"1\t{w}\t_\tT{w}" if w else "" for w in words]


def put(spark, path, rows):
    spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(path)


def test_sentences_over_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run():
        stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(source)
        with stateful.state_store(spark):
            streams.write_batches(stateful.sentence_stream(stream), out, checkpoint, lambda x: x).awaitTermination()

    file = lambda name, at, *words: [(v, name, at + i) for i, v in enumerate(lines(*words))]
    put(spark, source, file("a", 0, "x", "y") + file("b", 0, "", "p", "", "q"))
    put(spark, source, file("a", 2, "z"))  # the sentence goes on in a third file
    run()
    put(spark, source, [("# note", "a", 3)] + file("a", 4, "u") + file("c", 0, "only"))  # and ends in another run
    put(spark, source, file("b", 4, ""))
    run()
    done = Counter((r.file, tuple(r.words), tuple(r.tags)) for r in spark.read.parquet(out).collect())
    assert done == Counter([("a", ("x", "y", "z"), ("Tx", "Ty", "Tz")), ("b", ("p",), ("Tp",)), ("b", ("q",), ("Tq",))])
    left = Counter((r.file, tuple(r.words)) for r in stateful.open_sentences(spark, checkpoint).collect())
    assert left == Counter([("a", ("u",)), ("c", ("only",))])
    assert "RocksDB" not in spark.conf.get(stateful.PROVIDER)


def test_merged_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    every = []
    for i in range(7):
        rows = [(f"w{i % 3} all  w{i}", "l")] * (i + 1)
        every += rows
        spark.createDataFrame(rows, "text string, label string").coalesce(1).write.mode("append").parquet(source)
    table = stateful.MergedCounts(spark, ["word", "label"], "freq", str(tmp_path / "counts"), every=2)
    stream = spark.readStream.schema("text string, label string").option("maxFilesPerTrigger", 1).parquet(source)
    table.start(streams.running_counts(stream), str(tmp_path / "check")).awaitTermination()
    want = Counter(w for t, _ in every for w in t.replace("  ", " ").split(" "))
    assert {r.word: r.freq for r in table.read().collect()} == dict(want)
    folders = table._folders()
    assert len(folders) <= 3 and "base=" in folders[0][1]
    batch = spark.createDataFrame([("all", "l", 99)], "word string, label string, freq long")
    for _ in range(2):  # a batch that runs again replaces itself
        table.write(batch, 100)
    assert {r.word: r.freq for r in table.read().collect()} == {**want, "all": 99}


def test_recorded_losses(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(float(i), 2.0 * i, 1), (float(i) + 3, 0.0, 2)], "a double, b double, n long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("a double, b double, n long").option("maxFilesPerTrigger", 1).parquet(source)
    with recorders.Recorder(spark, str(tmp_path / "losses"), ["training"]) as recorder:
        seen = recorders.feature_losses(stream, "training", {"cls": "a", "tok": "b"})
        streams.write_batches(streams.loss_observer(seen, "other", "a", "n"), str(tmp_path / "out"), str(tmp_path / "check"), lambda x: x).awaitTermination()
    got = {(r.batch, r.metric): r.value for r in recorder.table().collect()}
    for i in range(3):
        cls, tok = (i + 2 * (i + 3)) / 3, 2 * i / 3
        assert abs(got[i, "cls loss"] - cls) + abs(got[i, "tok loss"] - tok) + abs(got[i, "total loss"] - cls - tok) < 1e-9
        assert got[i, "rows"] == 3
    assert {r.name for r in recorder.table().collect()} == {"training"}
    with recorders.Recorder(spark, str(tmp_path / "none")) as idle:
        pass
    assert idle.table().collect() == []
