"""Learned sentence cutting, and plain text of wiki mark-up."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions.wikitext import plain, plain_text
from wordloom.operators import sentences as S

NAMES = "Adler Becker Conrad Dorn Engel Falk Graf Huber".split()
VERBS = "went came saw took read wrote sang slept".split()
THINGS = "house garden letter river story evening answer window".split()


def corpus(n=1500, seed=1):
    """Texts with abbreviations (Dr., etc., approx.), initials and ordinals in the midst of sentences; sentences often begin with The and She."""
    rng = random.Random(seed)
    every = []
    for _ in range(n):
        name, verb, thing = rng.choice(NAMES), rng.choice(VERBS), rng.choice(THINGS)
        every.append(rng.choice([f"The {thing} {verb} and {verb}.", f"She {verb} with Dr. {name} to a {thing}.", f"{name} {verb} approx. {rng.randrange(50)} {thing}s, {thing} etc. in a {thing}!", f"Then J. {name} {verb}.", f"On day {rng.randrange(9)}. May {name} {verb}.", f"{name} and Dr. {rng.choice(NAMES)} {verb} a {thing}."]))
    return every


@pytest.fixture(scope="module")
def rules(spark):
    every = corpus()
    texts = [" ".join(every[i : i + 5]) for i in range(0, len(every), 5)]
    return S.learn(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_learned_rules(rules):
    assert {"dr", "etc", "approx"} <= rules.abbreviations
    assert not {w.rstrip("s") for w in (*THINGS, *VERBS)} & rules.abbreviations
    assert {"the", "she", "then"} <= rules.starters
    assert "may" not in rules.starters


def test_sentences_stay_whole(rules):
    every = corpus(200, 9)
    assert S.cut("  \n".join(every), rules) == every
    assert S.cut("Dr. Adler came. z. B. Falk sang.", rules) == ["Dr. Adler came.", "z. B. Falk sang."]
    assert S.cut("It was the 3. May when she saw approx. 4. The river sang.", rules) == ["It was the 3. May when she saw approx. 4.", "The river sang."]
    assert S.cut('"Who sang?" She asked (quietly.) "The end!"', rules) == ['"Who sang?"', "She asked (quietly.)", '"The end!"']
    assert S.cut("Well... maybe. Wait... The end.", rules) == ["Well... maybe.", "Wait...", "The end."]


def test_arabic_is_cut_at_its_question_mark(rules):
    assert S.cut("كيف الحال؟ أنا بخير. شكرا", S.Rules(), "arabic") == ["كيف الحال؟", "أنا بخير.", "شكرا"]
    assert S.cut("من؟متى؟ الآن.", S.Rules(), "arabic") == ["من؟", "متى؟", "الآن."]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB1 .?!\n…\"(),"), max_size=60))
def test_nothing_is_lost(text):
    rules = S.Rules(frozenset({"a"}), frozenset({"b"}))
    assert "".join("".join(S.cut(text, rules)).split()) == "".join(text.split())


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB1.,;:([{\"'«”?!…"), min_size=1, max_size=8))
def test_kinds_in_python(token):
    """Brackets and commas around a word don't change its kind."""
    assert S.word_kind(f"({token}),") == S.word_kind(token)


def test_kinds_agree_with_counting(spark):
    tokens = ["Dr.", "(Dr.,", "z.B.", "3.", "1,000.5", "Who?!", "...", "end...", "[see", "x],", "“A.”", "-5.", "a.b", "St.;"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", S._kind(S._bare(F.col("t"))).alias("k")).collect()
    assert {r.t: r.k for r in rows} == {t: S.word_kind(t) for t in tokens}


def test_scores(spark):
    counts = spark.createDataFrame([("dr", 20, 1), ("house", 30, 300), ("z.b", 5, 0), ("##", 9, 9), ("never", 0, 50)], "word string, with_stop long, without long")
    got = {r.word: r.score for r in S.abbreviation_scores(counts).collect()}
    p = 64 / 424
    k, n = 20, 21
    ratio = -2 * (k * math.log(p) + (n - k) * math.log(1 - p) - k * math.log(0.99) - (n - k) * math.log(0.01))
    assert got["dr"] == pytest.approx(ratio * math.exp(-2) * 2**-1)
    assert got["z.b"] == pytest.approx(-2 * (5 * math.log(p) - 5 * math.log(0.99)) * math.exp(-2) * 2)
    assert set(got) == {"dr", "house", "z.b"}


def test_learning_from_nothing(spark):
    assert S.learn(spark.createDataFrame([], "text string")) == S.Rules()
    assert S.learn(spark.createDataFrame([(None,), ("",)], "text string"), known=["bzw"]) == S.Rules(frozenset({"bzw"}))
    got = spark.createDataFrame([(None,), ("",), ("A bb. C dd.",)], "text string").select(S.cut_sentences(F.col("text"), S.Rules()).alias("s")).collect()
    assert [r.s for r in got] == [None, [], ["A bb.", "C dd."]]


MARKUP = [
    ("a {{b|{{c|d}}|e}} f", "a  f"),
    ("{{a|{{{1|x}}}}}b", "b"),
    ("{{{x|{{y}}}}}b", "b"),
    ("x {| class=a\n| c || {{d|}} \n|- \n{|\n| inner\n|}\n|} y", "x  y"),
    ("{{t|\n{|\n|a|}}}z", "z"),
    ("[[Page|the label]] and [[Page]] and [[:Category:X|c]]", "the label and Page and c"),
    ("[[File:a.jpg|thumb|A [[b|caption]] here]]text[[Category:Y]]", "text"),
    ("[http://x.y the site] [https://x.y] [//z w]", "the site  w"),
    ("'''bold''' and ''it'' d'un", "bold and it d'un"),
    ("== Head ==\n* one\n## two\n:;three", "Head\none\ntwo\nthree"),
    ("a<ref name=x>gone {{c}}</ref>b<ref name=x/>c<!-- no -->d<br>e", "abcd\ne"),
    ("<b>x</b> &amp; <nowiki>[[y]] {{z}}</nowiki> 5 < 6", "x & [[y]] {{z}} 5 < 6"),
    ("open {{never closed [[a|b", "open never closed a|b"),
    ("closed }} only ]] here |} too", "closed  only  here |} too"),
    ("[[a|{{b]] c", "b c"),
    ("__TOC__a | b", "a | b"),
    ("", ""),
]


@pytest.mark.parametrize("source,want", MARKUP)
def test_markup(source, want):
    assert plain(source) == want


def balanced(depth):
    text = st.text(st.sampled_from("ab é\n"), max_size=6)
    if not depth:
        return text.map(lambda t: (t, t))
    inner = balanced(depth - 1)
    gone = lambda a, b: inner.map(lambda x: (a + x[0] + b, ""))
    part = st.one_of(text.map(lambda t: (t, t)), gone("{{t|", "}}"), gone("{{{p|", " }}}"), gone("{|\n|", " |} "), gone("<ref>", "</ref>"), gone("[[File:x|", "]]"), inner.map(lambda x: (f"[[page|{x[0]}]]", x[1])))
    return st.lists(part, max_size=4).map(lambda p: ("".join(a for a, _ in p), "".join(b for _, b in p)))


@settings(max_examples=400, deadline=None)
@given(balanced(4))
def test_balanced_markup(case):
    """However nested, what goes goes and labels stay (white space aside)."""
    source, want = case
    assert re.sub(r"\s", "", plain(source)) == re.sub(r"\s", "", want)


def test_deep_and_long_markup(spark):
    assert plain("{{" * 30_000 + "x" + "}}" * 30_000 + "y") == "y"
    assert plain("[[a|" * 3000 + "x" + "]]" * 3000) == "x"
    got = spark.createDataFrame([(None,), ("{{a}}b",)], "t string").select(plain_text(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [None, "b"]
