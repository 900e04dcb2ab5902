"""Sinks: tables, lines, chunks of rows, encoded lines and labelled files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as X

__all__ = ["labelled", "write_chunks", "write_encoded_lines", "write_lines", "write_report", "write_table"]


def write_table(df: DataFrame, path: str, sep: str = "\t", mode: str = "error") -> None:
    """A delimited table with a header, quotes doubled where needed."""
    df.write.mode(mode).csv(path, sep=sep, header=True, quote='"', escape='"', emptyValue="")


def write_lines(df: DataFrame, path: str, column: str = "value", mode: str = "error") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_encoded_lines(df: DataFrame, path: str, column: str = "value", mode: str = "error") -> None:
    """Each trimmed line in Base64."""
    df.select(X.encode_line(F.col(column)).alias("value")).write.mode(mode).text(path)


def write_chunks(df: DataFrame, path: str, rows: int, mode: str = "error") -> None:
    """Folders chunk=0, 1, ... of the rows of a table with a `chunk` column (operators.splits.chunks), one file of at most rows each."""
    df.repartition("chunk").write.mode(mode).option("maxRecordsPerFile", rows).partitionBy("chunk").csv(path, sep="\t", header=True, escape='"')


def labelled(df: DataFrame, text: str, label: str | Column) -> DataFrame:
    """text without line feed and tabs, and a label."""
    clean = F.replace(F.regexp_replace(text, r"\n\z", ""), F.lit("\t"), F.lit(" "))
    return df.select(clean.alias("text"), (F.lit(label) if isinstance(label, str) else label).alias("label"))


def write_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """A report or a table of losses as JSON lines."""
    df.write.mode(mode).json(path)
