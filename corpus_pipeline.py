"""The corpus pipeline: language ID, line deduplication, n-gram Jaccard join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on everything the stage before has kept and returns the columns of its input with its decisions
applied; the last returns what the mix takes. The driver writes each stage's rows and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import delete, fresh, materialise, settled, small_join
from wordloom.llm.decontaminate import decontaminate
from wordloom.llm.language import identify, train
from wordloom.llm.line_dedup import line_dedup
from wordloom.llm.mixing import label_quality, mix_sources
from wordloom.llm.ngram_join import ngram_jaccard

#: A prediction below this posterior counts as rejected, as does a text without letters.
LANGUAGE_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with letters whose language is clear. The declared language is learned from, never an input of the decision."""
    model = train(docs.select("doc_id", "text", "lang"), public_tokenizers.path("piece_bpe_32k.model"))
    lang, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = identify(docs, model, keep=tuple(docs.columns), names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LANGUAGE_SCORE)).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document goes when none of its lines is left. n_chars follows the text."""
    lines, gone = fresh("n_lines", docs.columns), fresh("n_removed", docs.columns)
    done = line_dedup(docs, num=80, den=100, names=(lines, gone))
    left = done.where((F.col(lines) > F.col(gone)) | (F.col(lines) == 0))
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of the whole row, and its column's name: rows of one or no doc_id are told apart, only equal rows share a key."""
    key = fresh("row_key", docs.columns)
    return docs.withColumn(key, F.xxhash64(*docs.columns)), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the smallest doc_id (null comes last), of rows with that doc_id the one of the smallest hash. Five words,
    similarity 0.8. Documents without words stay."""
    rows, key = keyed(docs)
    found = ngram_jaccard(rows, width=5, num=80, den=100, id_col=key).where("n_shingles > 0").groupBy(F.col("doc_id").alias(key), "component_id").agg(F.count(F.lit(1)).alias("times"))
    found = materialise(found, "found")
    linked = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("component_id")
    parts = small_join(found, linked, "component_id").select(F.col(key).alias("k"), "component_id")
    ids = rows.select(F.col(key).alias("k"), F.col("doc_id").alias("id")).distinct()
    parts = materialise(parts.join(ids, "k"), "linked")
    first = parts.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("first")).select("component_id", F.col("first.k").alias("first"))
    gone = small_join(parts, first, "component_id").where("k <> first").select(F.col("k").alias(key)).distinct()
    left = rows.join(gone, key, "left_anti")
    equal = found.where("times > 1").select(key)
    once, more = left.join(equal, key, "left_anti"), left.join(equal, key, "left_semi")
    return once.select(*docs.columns).unionByName(more.select(*docs.columns).distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark window go, whatever their doc_id."""
    rows, key = keyed(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, slop=0, id_col=key)
    hit = materialise(found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct(), "hit")
    return rows.join(hit, key, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that are taken, with the words taken (repeats counted), their source's size and target."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix_sources(docs, label_quality(labels), keep=tuple(docs.columns)).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", decontamination),
    ("mix_sources", mixing),
]

#: Stages that learn, hash and join by similarity have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's table goes when the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = settled(spark, name, partial(stage, spark, docs, sf_dir))
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
