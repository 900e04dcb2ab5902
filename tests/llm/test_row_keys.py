"""Rows without a doc_id, or with another row's, get a verdict of their own."""

import corpus_pipeline

BENCH = " ".join(f"bench{i}" for i in range(12))
LONG = " ".join(f"w{i}" for i in range(60))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_decontamination(spark, tmp_path):
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [(None, f"see {BENCH} here"), (None, "clean words"), (5, f"see {BENCH} there"), (5, "clean namesake"), (6, "clean")])
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("5", "clean namesake"), ("6", "clean"), ("None", "clean words")]


def test_near_duplicates(spark, tmp_path):
    other = LONG.replace("w", "v")
    docs = frame(spark, [(None, LONG), (3, LONG), (2, LONG + " end"), (2, LONG + " fin"), (None, other), (None, other), (7, "a b c d e f"), (7, "of another text with that id"), (8, ""), (8, "")])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    rest = sorted((str(i), t) for i, t in got if not t.startswith("w0 "))
    assert [i for i, t in got if t.startswith("w0 ")] == [2]
    assert rest == sorted([("None", other), ("7", "a b c d e f"), ("7", "of another text with that id"), ("8", ""), ("8", "")])
