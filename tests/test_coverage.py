"""Smaller parts of the library: tag dimensions, words compared with pieces, word-wise inference, character tables in files, ties of the last row, spelled-out results."""

import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import exact
from wordloom.functions.charset import SAMPLE_RANGES, CharTable
from wordloom.operators import duplicates, models, morphology
from wordloom.sources import readers


def test_possession_tags():
    tags = morphology.possession_tags()
    assert len(tags) == len(set(tags)) == 28
    assert {"PSS1S", "PSS1DE", "PSS1PI", "PSS2SFORM", "PSS2SINFM", "PSS3PM", "PSSD", "PSS2DF"} <= set(tags)
    assert not {"PSS1SF", "PSS1PF", "PSS3PE"} & set(tags)


def test_tag_dimension(spark):
    lines = spark.createDataFrame([("tense: PST PRS  FUT",), ("number: SG PL",), ("possession: *",), ("case:",), ("no feature",), ("mood:PRS",)], "value string").coalesce(1)
    got = {r.tag: (r.feature, r.value) for r in morphology.tag_dimension(lines).collect()}
    assert got["PST"] == ("tense", "PST")
    assert got["PRS"] == ("mood", "PRS")  # the last line's
    assert got["PSS1PI"] == ("possession", "PSS1PI")
    assert len(got) == 5 + 28
    forms = spark.createDataFrame([("go", "went", ["V", "PST", "SG"]), ("go", "goes", ["V", "PRS"])], "lemma string, form string, tags array<string>")
    pos = spark.createDataFrame([("V", "pos", "V")], "tag string, feature string, value string")
    wide = morphology.inflections(forms, morphology.tag_dimension(lines).unionByName(pos), ["tense", "mood", "number"], True)
    assert {(r.word, r.tense, r.mood, r.number) for r in wide.collect()} == {("went", "PST", "NA", "SG"), ("goes", "NA", "PRS", "NA")}


def test_compared_starts(spark):
    rows = [(1, ["<s>", "un", "happy</w>", "ca", "t</w>", "</s>"], ["Unhappy", "cat"]), (2, ["<unk>", "x"], ["é", "y"]), (3, [], ["a"]), (4, None, ["a"]), (5, ["a", "a"], [])]
    df = spark.createDataFrame(rows, "i int, p array<string>, w array<string>")
    got = {r.i: r.s for r in df.select("i", exact.compared_starts(F.col("p"), F.col("w")).alias("s")).collect()}
    assert got == {1: [False, True, False, True, False, False], 2: [True, False], 3: [], 4: None, 5: [False, False]}


def test_word_sequences(spark):
    calls = []

    def load():
        def model(words):
            assert len(set(words)) == len(words)
            return np.array([[len(w), ord(w[0])] for w in words], np.float32)

        return model

    df = spark.createDataFrame([(1, ["ab", "c", "ab", "dddd"]), (2, []), (3, None), (4, ["z", None])], "i int, w array<string>")
    got = {r.i: (r.e, r.e_mask) for r in models.encode_sequences(df, "w", load, 3, "e").collect()}
    assert got[1] == ([[2.0, 97.0], [1.0, 99.0], [2.0, 97.0]], [1, 1, 1])
    assert [len(got[i][0]) for i in (2, 3, 4)] == [3, 3, 3]
    assert [got[i][1] for i in (2, 3, 4)] == [[0, 0, 0], [0, 0, 0], [1, 1, 0]]
    assert not calls


def test_character_table_in_a_file(spark, tmp_path):
    table = CharTable(width=30).with_ranges(SAMPLE_RANGES)
    table.save(spark, str(tmp_path / "t"))
    assert CharTable.load(spark, str(tmp_path / "t")) == table


def test_last_row_of_equal_order(spark):
    rows = [("a", 1, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "q"), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    for part in (1, 3, 5):
        got = sorted(map(tuple, duplicates.keep_last(df.repartition(part), ["k"], "o").collect()))
        assert got == [("a", 1, "z"), ("b", None, "q")]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "w.db")
    rows = [(i * 3, f"w{i}", i / 4) for i in range(50)] + [(999, None, None)]
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE words (id INTEGER PRIMARY KEY, word TEXT, score REAL)")
        db.executemany("INSERT INTO words VALUES (?, ?, ?)", rows)
        db.execute("CREATE TABLE empty_one (id INTEGER)")
    got = readers.sqlite_table(spark, path, "words", 7)
    assert dict(got.dtypes) == {"id": "bigint", "word": "string", "score": "double"}
    assert Counter(map(tuple, got.collect())) == Counter(rows)
    assert readers.sqlite_table(spark, path, "empty_one").collect() == []


#: Worked out by hand, stage by stage: emoticons, similar characters, repeats, spacing, blanks, repeated words; then marks, case and entities.
NORMALISED = [
    ("Helloooo worlddd", "Helloo worldd", "helloo worldd"),
    ("no no no no way", "no no way", "no no way"),
    ("1111 22", "1111 22", "<nbr> <nbr>"),
    ("Nice :-) day", "Nice 🙂 day", "nice 🙂 day"),
    ("“quoted” it’s", '" quoted " it \' s', '" quoted " it \' s'),
    ("سَلام", "سَلام", "سلام"),
    ("a  b", "a b", "a b"),
    ("", "", ""),
]


@pytest.mark.parametrize("text,plain,tagged", NORMALISED)
def test_normalised_by_hand(text, plain, tagged):
    assert (exact.notag(text), exact.tagged(text)) == (plain, tagged)
