"""The driver's queries op1 to op13 over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .fill_middle import fill_in_middle, restored
from .hard_negatives import hard_negatives
from .html_text import main_text
from .language import identify, train
from .licenses import NOTICE, license_scan
from .line_dedup import line_dedup
from .mixing import label_quality, mix_sources
from .ngram_join import ngram_jaccard
from .oracles import SQL
from .quality import quality_rules
from .secrets import secret_scan
from .substring_dedup import substring_dedup
from .token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir), label_quality(_table(spark, sf_dir, "labels")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), width=10, slop=2)
    ids = lambda c: F.sha2(F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",").cast("binary"), 256)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        ids("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
        ids("near_items").alias("near_sha256"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(_documents(spark, sf_dir), width=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _held_out() -> Column:
    """Documents that nothing may be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir)
    model = train(docs.where(~_held_out()).select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(_documents(spark, sf_dir), num=80, den=100)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def with_paths(docs: DataFrame) -> DataFrame:
    """The test documents as files: source/lang/thousand/hundred/doc.id; a document that opens with a notice is source/lang/thousand/LICENSE.id."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("none"))
    opens = F.coalesce(F.substring_index("text", "\n", 1).rlike(NOTICE), F.lit(False))
    folder = F.concat_ws("/", text(F.col("source")), text(F.col("lang")), text(F.expr("doc_id div 1000")))
    inner = F.concat_ws("/", folder, text(F.expr("doc_id div 100")), F.concat(F.lit("doc."), text(F.col("doc_id"))))
    return docs.select("doc_id", "text", F.when(opens, F.concat(folder, F.lit("/LICENSE."), text(F.col("doc_id")))).otherwise(inner).alias("path"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(with_paths(_documents(spark, sf_dir)))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_documents(spark, sf_dir))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_documents(spark, sf_dir), width=3, num=90, den=100)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    done = restored(fill_in_middle(_documents(spark, sf_dir)))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_mix_sources, op3_decontaminate, op4_substring_dedup, op5_quality_rules, op6_language, op7_line_dedup, op8_license_scan, op9_secret_scan, op10_ngram_jaccard, op11_html_text, op12_hard_negatives, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
