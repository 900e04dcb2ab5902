"""Training samples are of different rows: repeating rows, even very often, changes nothing."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import wordloom.llm.common as C
from tests.llm.test_language import language_rows
from wordloom.llm.common import bounded_sample
from wordloom.llm.language import identify, train
from wordloom.llm.licenses import license_scan
from wordloom.llm.quality import sample as quality_sample
from wordloom.llm.secrets import sample_findings

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def repeated(df, times):
    return df.withColumn("__r", F.explode(F.sequence(F.lit(1), times))).drop("__r")


@pytest.mark.parametrize("salt", ["a", "b", "c"])
@pytest.mark.parametrize("groups", [4096, 1])
def test_sample_of_repeated_rows(spark, monkeypatch, salt, groups):
    monkeypatch.setattr(C, "MOST_GROUPS", groups)
    once = spark.createDataFrame([(k, f"text {k} {i}") for k in "xy" for i in range(20)], "k string, t string")
    want = sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, bounded_sample(repeated(once, F.lit(5000)), "k", "t", salt, 30, 1 << 20).collect())) == want
    some = sorted(map(tuple, bounded_sample(once, "k", "t", salt, 8, 1 << 20).collect()))
    assert len(some) == 16
    assert sorted(map(tuple, bounded_sample(repeated(once, F.lit(300)), "k", "t", salt, 8, 1 << 20).collect())) == some


def test_sample_of_many_rows_is_bounded(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("k"), F.concat(F.lit("t"), "id").alias("t"))
    got = bounded_sample(rows, "k", "t", "s", 100, 1 << 20).groupBy("k").count().collect()
    assert sorted((r.k, r["count"]) for r in got) == [(0, 100), (1, 100)]
    assert bounded_sample(rows.limit(0), "k", "t", "s", 100, 1 << 20).collect() == []


def test_language_of_repeated_rows(spark):
    rows = spark.createDataFrame([r[:3] for r in language_rows(40)], "doc_id long, text string, lang string")
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    uneven = repeated(rows, F.when(F.col("lang") == langs[0], 1).otherwise(20_000 // 40))
    model = train(uneven, MODEL)
    assert sorted(model.langs) == langs
    got = {r.doc_id: r.lang_pred for r in identify(rows, model).collect()}
    assert got == {r.doc_id: r.lang for r in rows.collect()}


def test_quality_sample_of_repeated_rows(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    both = [sorted(y for y, _, _ in quality_sample(d, labels)) for d in (docs, repeated(docs, F.when(F.col("doc_id") % 2 == 0, 1).otherwise(5000)))]
    assert both[0] == both[1] == [0] * 20 + [1] * 20


def test_findings_of_repeated_rows(spark):
    docs = spark.createDataFrame([(i, f"see password = 'Tr0ub4dor{i}x3' and some/path_{i} here") for i in range(30)], "doc_id long, text string")
    once, often = (sorted(map(str, sample_findings(d))) for d in (docs, repeated(docs, F.lit(2000))))
    assert once == often
    assert once


def test_a_licence_header_scores_the_same_however_often_it_is_repeated(spark):
    header = "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License. */\nint x;\n"
    file = spark.createDataFrame([(1, "a/x.c", header)], "doc_id long, path string, text string")
    scores = [{(r.licence, r.score) for r in license_scan(repeated(file, F.lit(n))).collect()} for n in (1, 3, 50)]
    assert scores[0] == scores[1] == scores[2]
    assert len(scores[0]) == 1
    assert license_scan(repeated(file, F.lit(3))).count() == 3
