import random

import pytest
from pyspark.sql import types as T

CLASH = ["n_tokens", "size", "bucket", "grp", "key", "node", "component", "component_id", "h", "line", "n_lines", "n_removed", "lang_pred", "score", "quality", "taken", "target", "n_words", "kept", "path", "licence", "spans", "words", "keep_0", "rows"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]])


def invented_texts(seed=1, n=60):
    """Random texts with exact and near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    lines = [" ".join(rng.choices(vocab, k=rng.randint(1, 25))) for _ in range(15)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(rng.choice(out))
        elif kind < 0.5 and out:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        else:
            out.append("\n".join([" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(rng.randint(1, 4))] + rng.sample(lines, rng.randint(0, 3))))
    return out


def make(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); the other columns have names that operators use inside."""
    full = [(*r, *[None] * (5 - len(r)), *["x"] * len(CLASH)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "one two"), (6, "one two"), (7, "one two"), (None, "no id here at all"), (8, "x" * 5000), (9, "a b c\na b c\n\nfin"), (10, "日本語 テキスト é́ 😀")]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return make(spark, edge_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def corpus(spark):
    return make(spark, [(i, t, "ab"[i % 2], f"s{i % 3}") for i, t in enumerate(invented_texts())])
