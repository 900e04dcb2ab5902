import random

import public_tokenizers
import pytest

from wordloom.llm.token_counts import counter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "\n", "▁", "a", "the", "é", "é", "Ａ", "\t", "\r", "\x00", "<s>", "</s>", "<0x0A>", "  ", "漢", "😀", "!!", "ion", "\xa0", "ﬁ", "<unk>", "﻿", "​"]


def test_agrees_with_the_library_on_odd_strings():
    c, rng = counter(MODEL), random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(20_000)]
    assert c.counts(texts) == [len(x) for x in c.sp.encode(texts)]


def test_proven_words_are_one_token():
    c = counter(MODEL)
    assert c.apart
    assert len(c.whole) > 10_000
    assert all(len(x) == 1 for x in c.sp.encode(list(c.whole)))


@pytest.mark.parametrize("name", ["edge", "corpus"])
def test_documents(name, request):
    docs = request.getfixturevalue(name)
    c = counter(MODEL)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(c.sp.encode(r.text or "")), n > 100) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, MODEL, 100).collect()) == want


def test_empty_table(empty):
    assert token_counts(empty, MODEL).collect() == []
