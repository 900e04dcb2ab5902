"""Ropes against plain strings, and the operator against slices of the list of units."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import make
from wordloom.llm.fill_middle import build, fill_in_middle, flat, restore, restored, split_chars, split_units, transform

LETTERS = st.text(st.sampled_from("abZ é\n<>PSM1😀"), max_size=60)


def units(text):
    return re.findall("[A-Za-z]+|[^A-Za-z]", text)


def brute(name, text):
    t = text or ""
    u = units(t)
    h = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return len(u), "plain", None, None, t
    low, high = sorted((a % (len(u) + 1), b % (len(u) + 1)))
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.integers(1, 7), st.data())
def test_splits(text, size, data):
    rope, u = build(text, size), units(text)
    assert flat(rope) == text
    assert (rope.units if rope else 0) == len(u)
    rank, at = data.draw(st.integers(0, len(u))), data.draw(st.integers(0, len(text)))
    a, b = split_units(rope, rank)
    assert (flat(a), flat(b)) == ("".join(u[:rank]), "".join(u[rank:]))
    assert (a.units if a else 0) == rank and (b.units if b else 0) == len(u) - rank
    a, b = split_chars(rope, at)
    assert (flat(a), flat(b)) == (text[:at], text[at:])


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.integers(0, 10**6))
def test_round_trip(text, name):
    got = transform(text, str(name), 1, 10, 20)
    assert got == brute(name, text)
    assert restore(got[4], got[1]) == text


def test_sentinel_halves_at_the_cuts():
    for text in ("<<P<S<M", "P>S>M>", "<S" * 30 + ">", "a<" * 40):
        for name in range(60):
            _, form, _, _, out = transform(text, str(name), 1, 0, 50)
            assert restore(out, form) == text


def test_long_runs_and_texts():
    rng = random.Random(1)
    for text in ("x" * 50_000, "".join(rng.choices("ab c", k=300_000)), "é" * 9000):
        for name in range(5):
            assert transform(text, str(name), 1, 10, 20) == brute(name, text)


def rows(df):
    return sorted(tuple(map(str, (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in df.collect())


def test_tables(spark, edge, corpus, empty):
    for docs in (edge, corpus, empty):
        done = restored(fill_in_middle(docs))
        want = sorted(tuple(map(str, (r.doc_id, *brute("" if r.doc_id is None else r.doc_id, r.text)))) for r in docs.collect())
        assert rows(done) == want
        assert sorted(str((r.doc_id, r.restored)) for r in done.collect()) == sorted(str((r.doc_id, r.text or "")) for r in docs.collect())


def test_ids_and_forms(spark):
    docs = make(spark, [(i, f"some words {i}, more") for i in range(2000)])
    forms = [r.form for r in fill_in_middle(docs).collect()]
    assert abs(forms.count("plain") / 2000 - 0.1) < 0.03
    assert abs(forms.count("spm") / 2000 - 0.18) < 0.03
    named = docs.selectExpr("concat('id', doc_id) AS name", "text")
    assert fill_in_middle(named, id_col="name").schema["doc_id"].dataType.simpleString() == "string"
