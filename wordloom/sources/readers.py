"""Sources. Schemas are always given, never inferred; NA and nan are ordinary strings; empty fields are empty strings."""

from __future__ import annotations

import json
import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wordloom.functions import text as X

__all__ = ["affix_file", "cluster_table", "config", "conllu_lines", "decoded_lines", "encoded_words", "files", "hub_path", "json_lines", "keyword_file", "labelled_columns", "lines", "noise_table", "numbered", "pages", "sqlite_table", "string_table", "subfolders", "table", "tagged_sentences", "tatoeba", "unimorph", "word_list"]


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value: each line without its line feed, lazily; a missing path is an error."""
    return spark.read.text(path)


def files(spark: SparkSession, path: str, suffix: str | None = None, recursive: bool = False) -> DataFrame:
    """path, length and time of the files of a folder whose names end with suffix."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(path).select("path", "length", "modificationTime")


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below path, sorted, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(x.getPath().getName() for x in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if x.isDirectory())


def table(spark: SparkSession, path: str | list[str], schema: str | T.StructType, sep: str = "\t", header: bool = True) -> DataFrame:
    """A delimited table; doubled quotes are quotes; empty strings stay empty strings."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, escape='"', multiLine=False, enforceSchema=True)
    return df.na.fill("", [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])


def string_table(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", header: bool = True) -> DataFrame:
    """All columns as strings."""
    return table(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]), sep, header)


def cluster_table(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "word string, cluster int")


def noise_table(spark: SparkSession, path: str) -> DataFrame:
    """A word, its masked spelling and its varied spelling, aligned in one row."""
    return string_table(spark, path, ["word", "obfus1fix", "obfus1var"])


def tagged_sentences(spark: SparkSession, path: str, max_words: int | None = None) -> DataFrame:
    """words and tags of each line of two tab-separated parts; lines of other shapes or unequal lengths are left out."""
    parts = F.split(F.trim(F.col("value")), "\t")
    blank = r"\s+"
    df = lines(spark, path).where((F.trim(F.col("value")) != "") & (F.size(parts) == 2))
    df = df.select(F.split(F.trim(parts[0]), blank).alias("words"), F.split(F.trim(parts[1]), blank).alias("tags")).where(F.size("words") == F.size("tags"))
    if max_words is not None:
        df = df.select(X.pad(F.col("words"), max_words).alias("words"), X.pad(F.col("tags"), max_words, "<PAD>").alias("tags"))
    return df


class SqliteSource(DataSource):
    """Python data source `sqlite`: options path, table and partitions (ranges of rowid)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            rows = db.execute(f'PRAGMA table_info("{_name(self.options["table"])}")').fetchall()
        kinds = {"INT": T.LongType(), "REA": T.DoubleType(), "FLO": T.DoubleType(), "DOU": T.DoubleType(), "BLO": T.BinaryType()}
        return T.StructType([T.StructField(r[1], kinds.get(r[2][:3].upper(), T.StringType())) for r in rows])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.parts = options["path"], _name(options["table"]), int(options.get("partitions", 4))
        self.columns = ", ".join(f'"{f.name}"' for f in schema)

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [InputPartition((0, -1))]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((a, min(high, a + step - 1))) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'SELECT {self.columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', partition.value)


def _name(table_name: str) -> str:
    if not re.fullmatch(r"\w+", table_name):
        raise ValueError(f"not a table name: {table_name!r}")
    return table_name


def sqlite_table(spark: SparkSession, path: str, table_name: str, partitions: int = 4) -> DataFrame:
    """A table of a SQLite file (on a path that the executors have)."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").options(path=path, table=table_name, partitions=partitions).load()


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """text and its sentiment as a word; broken lines and missing fields give '' and unknown."""
    row = F.from_json("value", "text string, label int")
    return lines(spark, path).select(F.coalesce(row["text"], F.lit("")).alias("text"), X.sentiment_label(row["label"]).alias("class"))


def unimorph(spark: SparkSession, path: str) -> DataFrame:
    """lemma, form and tags (an array) of a headerless file."""
    return table(spark, path, "lemma string, form string, tag string", header=False).select("lemma", "form", F.split("tag", ";").alias("tags"))


def numbered(df: DataFrame) -> DataFrame:
    """file and a position that grows with the lines of a file (partition offset and row in it); splits of one file keep their order."""
    return df.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"))


def conllu_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, pos: to be assembled by operators.morphology.sentences. Files are read whole, one split each, so that positions hold."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n"))).select(F.col("col").alias("value"), "file", "pos")


def tatoeba(spark: SparkSession, path: str, langs: list[str]) -> DataFrame:
    """id, lang and text of lines with exactly two tabs in one of the languages."""
    parts = F.split("value", "\t")
    df = lines(spark, path).where(F.size(parts) == 3)
    return df.select(parts[0].alias("id"), parts[1].alias("lang"), parts[2].alias("text")).where(F.col("lang").isin(langs))


def pages(spark: SparkSession, path: str, row_tag: str = "page") -> DataFrame:
    """An XML dump: title and text of its pages."""
    return spark.read.format("xml").option("rowTag", row_tag).schema("title string, revision struct<text: string>").load(path).select("title", F.col("revision.text").alias("text"))


def keyword_file(spark: SparkSession, path: str) -> str | None:
    """The pattern of a keyword file; keyword lists are short and become a literal of the plan."""
    return X.keyword_pattern([r.value for r in lines(spark, path).collect()])


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.trim("value").alias("word")).where("word <> ''")


def affix_file(spark: SparkSession, path: str) -> DataFrame:
    """Distinct affixes without blank lines and # comments."""
    return word_list(spark, path).where(~F.startswith("word", F.lit("#"))).select(F.col("word").alias("affix")).distinct()


def labelled_columns(df: DataFrame, word: int = 0, labels: slice = slice(1, None)) -> DataFrame:
    """The word column by position and the label columns of a range as one array of floats."""
    names = df.columns[labels]
    return df.select(F.col(df.columns[word]).alias("word"), F.array(*[F.col(c).cast("float") for c in names]).alias("labels"))


def encoded_words(spark: SparkSession, path: str, width: int, labels: int) -> DataFrame:
    """ids, mask and labels of headerless numeric rows: width, width and labels columns."""
    schema = T.StructType([T.StructField(f"c{i}", T.IntegerType()) for i in range(2 * width + labels)])
    row = F.array(*[f.name for f in schema])
    return spark.read.csv(path, schema=schema).select(F.slice(row, 1, width).alias("ids"), F.slice(row, width + 1, width).alias("mask"), F.slice(row, 2 * width + 1, labels).alias("labels"))


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file of Base64 lines."""
    return lines(spark, path).where("value <> ''").select(X.decode_line(F.col("value")).alias("value"))


def config(spark: SparkSession, path: str) -> dict:
    """A JSON configuration, small, on the driver."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def hub_path(path: str) -> tuple[str, str, str | None]:
    """provider, model and variant of `provider:model[:variant]`; without a provider it is local."""
    m = re.fullmatch(r"(?:(\w+):)?([^:]+)(?::([^:]+))?", path)
    if not m:
        raise ValueError(f"not a model path: {path!r}")
    return m[1] or "local", m[2], m[3]
