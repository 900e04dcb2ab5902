"""Text operators against hand-derived pairs and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions import exact
from wordloom.functions import text as X


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string" if not isinstance(values[0], list) else "i int, v array<string>")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = [
    (X.chars, "aé😀", ["a", "é", "😀"]),
    (X.normalize_similar, "‘a’ “b” – ― x y", "'a' \"b\" ‒ ― x y"),
    (X.squeeze_repeats, "heeeey 1111 \n\n\n", "heey 1111 \n\n"),
    (X.tokens, " a  b\tc\nd ", ["a", "b", "c\nd"]),
    (X.split_keep, "a  b ", ["a", "", "b", ""]),
    (X.drop_marks, "بِـسٞ", "بس"),
    (X.tag_word, "https://a.org/x", "<url>"),
    (X.tag_word, "1.5", "<nbr>"),
    (X.tag_word, "#a@b.c", "<hash>"),
    (X.tag_word, "a@b.c", "<mail>"),
    (X.tag_word, "@ab", "<tag>"),
    (X.tag_word, "\n", "<break>"),
    (X.tag_word, "word", "word"),
    (X.tag_sentence, "see https://a.org/x and 5% of -3.2", "see <url> and <nbr>% of <nbr>"),
    (X.tag_split, "Le 12  mai", ["le", "<nbr>", "", "mai"]),
    (X.underscores, "a__b_c", "a b c"),
    (X.sentences, "One. Two! Three? شكرا؟ four", ["One.", "Two!", "Three?", "شكرا؟", "four"]),
    (X.clean_tweet, " @me look  http://x.y\nnow ", "look now"),
    (X.deobfuscate, " B4d$1 ", "badsi"),
    (X.leet_variants, "at", ["4+", "47", "4t", "@+", "@7", "@t", "a+", "a7"]),
    (X.arabizi_variants, "khou", ["5ou", "7'ou", "kho", "khoo"]),
    (X.chomp, "a\tb\n", "a b "),
    (X.quote_field, 'a"b', '"a""b"'),
    (X.quote_field, "ab", "ab"),
    (X.affix_parts, "-s; -ed;;", ["-s", "-ed"]),
    (X.affix, "-ed", "ed"),
    (X.swap_mask, "f**k", "f##k"),
    (X.moses_french, "``A''，", '"a",'),
    (X.strip_web_tags, "==T== [[a|b]] <br/>x", "T== a x"),
    (lambda c: X.strip_web_tags(c, True), "a &lt;b&gt; &amp;lt;", "a <b> &lt;"),
    (lambda c: X.decode_line(X.encode_line(c)), "é" * 100, "é" * 100),
]


@pytest.mark.parametrize(("f", "given_", "want"), CASES)
def test_pairs(f, given_, want, spark):
    assert one(spark, f, given_) == [want]
    assert one(spark, f, given_, None)[1] is None or f in (X.sentences,)


def test_array_operators(spark):
    assert one(spark, X.join, ["", "a", "", "b"], [], ["", ""]) == ["a  b", "", ""]
    assert one(spark, lambda c: X.pad(c, 3), ["a"], ["a", "b", "c", "d"]) == [["a", "", ""], ["a", "b", "c"]]
    assert one(spark, X.squeeze_tokens, ["a", "a", "a", "12", "12", "12", "21", "21", "21", "a"]) == [["a", "a", "12", "12", "12", "21", "21", "a"]]
    assert one(spark, lambda c: X.drop_words(c, ["a"]), ["a", "ab"]) == [["ab"]]


def test_keep_line(spark):
    assert one(spark, X.keep_line, "a b cdefghijklmnopqrst", " a b cdefghijklmnopqrst", "a b c", "ab cdefghijklmnopqrstuvw") == [True, False, False, False]


def test_keywords():
    assert X.keyword_pattern(["a\n", "bc\n", "d.e\n", "\n"]) == "(bc|d.e)"
    assert X.keyword_pattern(["a\n"]) is None


SPACING = [
    ("hello,world", ["hello", ",", "world"]),
    ("a.b", ["a.b"]),
    ("end.", ["end", "."]),
    ("wait...", ["wait", "..", "."]),
    ("3.14 1,000", ["3.14", "1,000"]),
    ("5,", ["5", ","]),
    ("3lach", ["3lach"]),
    ("2003alg", ["2003", "alg"]),
    ("ab12", ["ab12"]),
    (".5x", [".5", "x"]),
    ("http://a.b/c?d=1,2 x", ["http://a.b/c?d=1,2", "x"]),
    ("a!b", ["a", "!", "b"]),
    ("ok😀😀", ["ok", "😀", "😀"]),
    ("👍🏽x", ["👍🏽", "x"]),
    ("x🏽", ["x"]),
    ("👩‍💻", ["👩‍💻"]),
    ("🇩🇿🇫🇷", ["🇩🇿", "🇫🇷"]),
    ("a\nb", ["a", "\n", "b"]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), SPACING)
def test_spacing(text, want):
    assert exact.blank_split(exact.space(text)) == want


def test_emoticons():
    assert "".join(exact.emoticons("hi :) there <3 x")) == "hi 🙂there ❤️x"
    assert "".join(exact.emoticons("(XD ")) == "(XD "
    assert "".join(exact.emoticons("at the end :)")) == "at the end :)"


def test_pipelines(spark):
    texts = ["Heyyyy :) c'est  ‘bon’ 12,5 !!!!", None]
    assert one(spark, exact.notag_normalize, *texts) == ["Heyy 🙂 c ' est ' bon ' 12,5 ! !", None]
    assert one(spark, exact.tag_normalize, "MAIL a@b.c 12,5 بِس") == ["mail <mail> <nbr> بس"]
    assert one(spark, lambda c: exact.preprocess_tokens(c, spacing=False, emoticon=False, word_dup=0), "a,b  cccc") == [["a,b", "cc"]]
    assert one(spark, exact.user_operator(lambda x: x.split(",")), "a,b") == [["a", "b"]]
    assert one(spark, exact.nfc, "é") == ["é"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.,:) \nh!tp😀é", max_size=40))
def test_spacing_keeps_characters(text):
    """Spacing only moves blanks about."""
    assert "".join(exact.space(text)).replace("\n", "") == "".join(c for c in text if c not in " \n")
    twice = exact.squeeze(exact.squeeze(text))
    assert twice == exact.squeeze(text)


def test_normalising_by_parts_equals_the_state_machine():
    """The short ways (plain words, parts kept by a worker, no emoticon) give what the stages one by one give."""
    import random

    from wordloom.functions import exact

    def slowly(t):
        elements = exact.squeeze([e.translate(exact._SIMILAR) if len(e) == 1 else e for e in exact.emoticons(t)])
        unmarked = [y for k in exact.space(elements) if (y := "".join(c for c in k if c not in exact._MARKS))]
        return " ".join(exact.tag(k.lower()) for k in exact.squeeze(exact.blank_split(unmarked)))

    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choices("aAbxhttp:)D(-.,0123 \n\t😀👍🏽\u200d\ufe0fé٣\u064bـ@#h/t&;;<>_", k=rng.randint(0, 25)))
        assert exact.notag(t) == " ".join(exact.preprocess(t))
        assert exact.tagged(t) == slowly(t)


def test_normalising_by_hand():
    from wordloom.functions import exact

    for text, tokens, tags in [
        ("Hello, world.", "Hello , world .", "hello , world ."),
        ("soooo goood!!!!", "soo good ! !", "soo good ! !"),
        ("3.14 and 1,000", "3.14 and 1,000", "<nbr> and <nbr>"),
        ("see http://a.example.com/x now", "see http://a.example.com/x now", "see <url> now"),
        ("", "", ""),
        ("no no no no", "no no", "no no"),
        ("fun :) ", "fun 🙂", "fun 🙂"),
    ]:
        assert (exact.notag(text), exact.tagged(text)) == (tokens, tags), text
