"""Composed stages against hand traces, and table functions in SQL."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions import exact, stages, tables
from wordloom.functions.stages import Drop, Each, Fill, Gather, Squeeze, Stage, Until, composed, run_stages


class Log(Stage):
    """Writes down what happens, holds every second element."""

    def __init__(self, name, log):
        self.name, self.log = name, log

    def init(self):
        self.held = []
        self.log.append(f"{self.name} init")

    def next(self, element):
        self.log.append(f"{self.name} next {element}")
        self.held.append(element)
        if len(self.held) < 2:
            return []
        out, self.held = ["".join(self.held)], []
        return out

    def stop(self):
        self.log.append(f"{self.name} stop")
        return ["".join(self.held) + "."] if self.held else []


def test_flush_order():
    """Traced by hand: a's rest 'e.' goes through b, fills it and goes to c, before b and c end."""
    log = []
    assert run_stages([Log(x, log) for x in "abc"], "abcdefg") == ["abcdefg."]
    assert log == [
        "a init", "b init", "c init",
        "a next a", "a next b", "b next ab", "a next c", "a next d", "b next cd", "c next abcd", "a next e", "a next f", "b next ef", "a next g",
        "a stop", "b next g.", "c next efg.", "b stop", "c stop",
    ]


def test_rests_of_several_stages():
    made = lambda: [Fill(2, ""), Fill(2, "-"), Fill(2, "|")]
    assert run_stages(made(), "abcde") == ["ab-cd|e"]
    assert run_stages(made(), "abcdefg") == ["ab-cd|ef-g"]
    assert run_stages(made(), "") == []
    assert run_stages([], "ab") == ["a", "b"]


def test_stages():
    assert run_stages([Squeeze(2)], ["a", "a", "a", None, None, None, "a"]) == ["a", "a", None, None, "a"]
    assert run_stages([Each(str.split), Drop(["b"]), Until("[.!]$")], ["a b c. d", "e f! g"]) == ["a c.", "d e f!", "g"]
    assert run_stages([Each(lambda x: [x, x]), Fill(3)], "ab") == ["a a b", "b"]


def test_exact_operators_as_stages():
    """The library's own state machines, composed with stages, are its preprocessing."""
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choices([*"ab :)('.,1", "<3", ":-)", "é", "http://x", "😀"], k=rng.randrange(25)))
        got = run_stages([Gather(exact.emoticons), Gather(exact.space), Gather(exact.squeeze)], text)
        assert got == exact.squeeze(exact.space(exact.emoticons(text)))


def test_operator_on_columns(spark):
    class Shout(Stage):
        def next(self, element):
            return [element.upper()]

        def stop(self):
            return ["!"]

    run = composed(lambda: Each(str.split), Shout, lambda: Fill(2))
    rows = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "d")], "i int, t string")
    assert {r.i: r.x for r in rows.select("i", run(F.col("t")).alias("x")).collect()} == {1: ["A B", "C !"], 2: None, 3: ["!"], 4: ["D !"]}
    arrays = rows.select("i", composed(lambda: Fill(2, "+"))(F.split("t", " ")).alias("x"))
    assert {r.i: r.x for r in arrays.collect()} == {1: ["a+b", "c"], 2: None, 3: [""], 4: ["d"]}


def test_stemmer():
    s = tables.Stemmer(["re", "r", ""], ["ing", "g", None])
    assert [s.stem(w) for w in ("rerunning", "ing", "go", "", "reg")] == [("re", "runn", "ing"), ("", "", "ing"), ("", "go", ""), ("", "", ""), ("re", "", "g")]


@pytest.mark.parametrize("double", [False, True])
def test_vocabulary_in_sql(spark, double, monkeypatch):
    tables.register(spark)
    spark.createDataFrame([("reading <url> read",), (None,), ("<url>\tlook " + "x" * 31,)], "text string").createOrReplaceTempView("some_texts")
    lists = "array('re'), array('ing')"
    words = spark.sql(f"SELECT v.* FROM some_texts, LATERAL vocab_words(text, {lists}, {str(double).lower()}) v").collect()
    tags = [("", "<url>", "")] * (4 if double else 2)
    assert sorted(map(tuple, words)) == sorted([("re", "ad", "ing"), ("re", "ad", ""), ("", "look", ""), ("", "", ""), *tags])
    counts = spark.sql(f"SELECT kind, token, sum(freq) AS n FROM vocab_counts(TABLE(some_texts), {lists}, {str(double).lower()}) GROUP BY 1, 2").collect()
    assert {(r.kind, r.token): r.n for r in counts} == {("prefix", "re"): 2, ("root", "ad"): 2, ("suffix", "ing"): 1, ("root", "look"): 1, ("root", "<url>"): 4 if double else 2}


def test_counts_are_handed_on(monkeypatch):
    """The counts of a task never grow beyond HELD, and their sums are whole."""
    monkeypatch.setattr(tables, "HELD", 5)
    f = tables.VocabCounts.func()
    got, most = {}, 0
    for i in range(40):
        for kind, token, n in f.eval({"text": f"w{i % 9} again"}, [], []):
            got[kind, token] = got.get((kind, token), 0) + n
        most = max(most, len(f.counts))
    for kind, token, n in f.terminate():
        got[kind, token] = got.get((kind, token), 0) + n
    assert most < 5
    assert got == {("root", "again"): 40, **{("root", f"w{k}"): len(range(k, 40, 9)) for k in range(9)}}


def test_turns(spark):
    tables.register(spark)
    spark.createDataFrame([(1, 2, "a", "x y"), (1, 1, "u", "x"), (2, 1, "u", None)], "conv_id long, turn int, role string, text string").createOrReplaceTempView("talk")
    got = spark.sql("SELECT * FROM turns(TABLE(talk) PARTITION BY conv_id ORDER BY turn)").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "u", 1, 1, None), (1, 2, "a", 2, 3, "u"), (2, 1, "u", 1, 1, None)]
