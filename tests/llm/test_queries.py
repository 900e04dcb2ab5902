"""The registered queries over the test tables: contracts, SQL, and the pipeline's stages."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tests.llm.conftest import make
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_join
from wordloom.llm.oracles import SQL
from wordloom.llm.queries import queries

COLUMNS = {
    "op1_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op2_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items", "near_sha256"],
    "op4_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_line_dedup": ["doc_id", "n_lines", "n_removed", "text_sha256"],
    "op8_license_scan": ["doc_id", "path", "licence", "how", "score", "from_dir"],
    "op9_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"],
    "op10_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op11_html_text": ["page_id", "url", "text", "n_chars"],
    "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(name, spark, sf_dir):
    df = queries()[name](spark, sf_dir)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    table, key = {"op11_html_text": ("pages", "page_id"), "op12_hard_negatives": (None, None)}.get(name, ("documents", "doc_id"))
    if table:
        assert Counter(r[key] for r in rows) == Counter(r[key] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect())
    if name in SQL:
        db = duckdb.connect()
        for t in ("documents", "labels", "benchmark", "embeddings"):
            p = f"{sf_dir}/{t}.parquet"
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
        want = db.execute(SQL[name])
        assert [d[0] for d in want.description] == df.columns
        assert sorted(map(tuple, rows), key=str) == sorted(want.fetchall(), key=str)


def test_language_of_held_out_documents(spark, sf_dir):
    rows = {r.doc_id: r for r in queries()["op6_language"](spark, sf_dir).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in rows.values() if r.held_out]
    assert held
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95


STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with benchmark and labels for the stages."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10 b11")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stage_edges(name, spark, edge, empty, tables):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge.select(columns), empty.select(columns), edge):
        out = STAGES[name](spark, docs, tables)
        assert set(docs.columns) <= set(out.columns) or name == "mix_sources"
        if name != "mix_sources":
            assert out.columns == docs.columns
        assert out.count() <= docs.count()


def test_language_stage_keeps_clear_documents(spark, tables):
    from tests.llm.test_language import language_rows

    docs = make(spark, [*language_rows(), (900, "123 456", "xx"), (901, None, "xx")])
    kept = {r.doc_id for r in STAGES["language_id"](spark, docs, tables).collect()}
    assert kept == {r[0] for r in language_rows()}


def test_line_stage(spark, corpus, tables):
    want = {(d, t) for d, t, n, gone in brute_lines([(r.doc_id, r.text) for r in corpus.collect()]) if n > gone or n == 0}
    out = STAGES["line_dedup"](spark, corpus, tables).collect()
    assert {(str(r.doc_id), r.text) for r in out} == want
    assert all(r.n_chars == len(r.text) for r in out)


def test_near_duplicate_stage(spark, corpus, tables):
    want = {d for d, _, c in brute_join([(r.doc_id, r.text) for r in corpus.collect()], 5, 80) if d == c}
    assert {str(r.doc_id) for r in STAGES["ngram_jaccard"](spark, corpus, tables).collect()} == want


def test_decontamination_stage(spark, tables):
    docs = make(spark, [(1, "x B1 b2 b3, b4 b5 b6 b7 b8 b9 b10 y"), (2, "b1 b2 b3 b4 b5 b6 b7 b8 b9"), (3, "clean")])
    assert {r.doc_id for r in STAGES["decontaminate"](spark, docs, tables).collect()} == {2, 3}


def test_mixing_stage(spark, corpus, tables):
    out = STAGES["mix_sources"](spark, corpus, tables).collect()
    assert all(r.taken > 0 for r in out)
    whole = {r.doc_id: r.source for r in corpus.collect()}
    assert {r.doc_id for r in out} <= set(whole)
    assert abs(sum(r.taken for r in out) - sum(len((r.text or "").split()) for r in corpus.collect())) <= 4


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out
    assert len({r.doc_id for r in out}) == len(out)
