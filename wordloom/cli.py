"""Command line: python -m wordloom.cli GROUP COMMAND ...

words extract|split|info, vocab affix|freq|combine|reduce|vocab, comments nodup|idxjoin|kwfilter|normalize|combine,
wiki prepare|normalize|combine, tatoeba, forms, taboo extract|protect, query. Inputs and outputs are paths that Spark reads and writes.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import exact
from wordloom.functions import text as X
from wordloom.operators import duplicates, morphology, splits, words
from wordloom.session import ensure_checkpoint_dir, session
from wordloom.sources import readers, writers

Command = Callable[[SparkSession, argparse.Namespace], None]
COMMANDS: dict[tuple[str, str], tuple[list[tuple[str, dict]], Command]] = {}


def command(group: str, name: str, *options: tuple[str, dict]) -> Callable[[Command], Command]:
    def register(f: Command) -> Command:
        COMMANDS[group, name] = (list(options), f)
        return f

    return register


def corpus(spark: SparkSession, args: argparse.Namespace, extra: str = "") -> DataFrame:
    return readers.table(spark, args.input, f"text string, label string{extra}")


INT = {"type": int}


@command("words", "extract", ("--freq", {"action": "store_true"}))
def words_extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """Word by label matrix of a text, label table."""
    docs = corpus(spark, args)
    writers.write_table((words.frequency if args.freq else words.presence)(docs), args.output)


@command("words", "split", ("--rows", INT | {"default": 300_000}), ("--shuffle", {"action": "store_true"}), ("--columns", {"required": True}))
def words_split(spark: SparkSession, args: argparse.Namespace) -> None:
    """Numbered chunks of rows, by word or shuffled."""
    table = readers.string_table(spark, args.input, args.columns.split(","))
    first = table.columns[0]
    keyed = table if args.shuffle else table.withColumn("__n", F.monotonically_increasing_id())
    chunked = splits.chunks(keyed, args.rows, first) if args.shuffle else splits.chunks(keyed, args.rows, "__n", None).drop("__n")
    writers.write_chunks(chunked, args.output, args.rows)


@command("words", "info", ("--columns", {"required": True}))
def words_info(spark: SparkSession, args: argparse.Namespace) -> None:
    """Counts of label combinations of a matrix whose columns are word and labels."""
    labels = args.columns.split(",")[1:]
    matrix = readers.table(spark, args.input, ", ".join([f"`{args.columns.split(',')[0]}` string", *[f"`{x}` int" for x in labels]]))
    writers.write_table(words.combinations(matrix, labels).select("combination", "count"), args.output)


@command("vocab", "affix")
def vocab_affix(spark: SparkSession, args: argparse.Namespace) -> None:
    """One sorted list of the affixes of several files."""
    writers.write_lines(readers.affix_file(spark, args.input.split(",")).orderBy("affix"), args.output, "affix")


@command("vocab", "freq", ("--prefixes", {"required": True}), ("--suffixes", {"required": True}), ("--norm", {"action": "store_true"}), ("--compat", {"action": "store_true"}))
def vocab_freq(spark: SparkSession, args: argparse.Namespace) -> None:
    """Frequencies of prefixes, roots and suffixes. --compat counts entity tags twice."""
    text = F.col("text")
    tokens = corpus(spark, args).select(F.explode(X.tag_split(text) if args.norm else F.split(text, "[ \t]+")).alias("word")).where(F.char_length("word") <= X.MAX_WORD_SIZE)
    stems = morphology.stem_join(tokens, readers.affix_file(spark, args.prefixes), readers.affix_file(spark, args.suffixes))
    for kind in ("prefix", "root", "suffix"):
        counted = words.affix_frequency(stems, args.compat).where(F.col("kind") == kind)
        writers.write_table(counted.select("token", "freq").orderBy("token"), f"{args.output}/{kind}")


@command("vocab", "combine")
def vocab_combine(spark: SparkSession, args: argparse.Namespace) -> None:
    writers.write_table(words.merge_frequencies([readers.table(spark, p, "token string, freq long") for p in args.input.split(",")]), args.output)


@command("vocab", "reduce", ("--least", INT | {"required": True}))
def vocab_reduce(spark: SparkSession, args: argparse.Namespace) -> None:
    writers.write_table(words.frequent(readers.table(spark, args.input, "token string, freq long"), args.least), args.output)


@command("vocab", "vocab")
def vocab_vocab(spark: SparkSession, args: argparse.Namespace) -> None:
    writers.write_lines(readers.table(spark, args.input, "token string, freq long").select("token"), args.output, "token")


@command("comments", "nodup", ("--columns", {"required": True}), ("--subset", {"default": "text"}))
def comments_nodup(spark: SparkSession, args: argparse.Namespace) -> None:
    """The last of equal rows stays."""
    df = readers.numbered(readers.string_table(spark, args.input, args.columns.split(",")))
    last = duplicates.keep_last(df, args.subset.split(","), F.struct("file", "pos")).orderBy("file", "pos")
    writers.write_table(last.drop("file", "pos"), args.output)


@command("comments", "idxjoin", ("--columns", {"required": True}), ("--index", {"required": True}), ("--index-columns", {"required": True}))
def comments_idxjoin(spark: SparkSession, args: argparse.Namespace) -> None:
    index = readers.string_table(spark, args.index, args.index_columns.split(","))
    writers.write_table(duplicates.index_videos(readers.string_table(spark, args.input, args.columns.split(",")), index), args.output)


@command("comments", "kwfilter", ("--columns", {"required": True}), ("--keywords", {"required": True}))
def comments_kwfilter(spark: SparkSession, args: argparse.Namespace) -> None:
    df = readers.string_table(spark, args.input, args.columns.split(","))
    writers.write_table(duplicates.without_keywords(df, "text", readers.keyword_file(spark, args.keywords)), args.output)


def _normal(tags: bool) -> Callable:
    return exact.tag_normalize if tags else exact.notag_normalize


@command("comments", "normalize", ("--columns", {"required": True}), ("--tags", {"action": "store_true"}))
def comments_normalize(spark: SparkSession, args: argparse.Namespace) -> None:
    df = readers.string_table(spark, args.input, args.columns.split(","))
    writers.write_table(df.withColumn("text", _normal(args.tags)(F.col("text"))), args.output)


@command("comments", "combine", ("--columns", {"required": True}), ("--label", {"required": True}))
def comments_combine(spark: SparkSession, args: argparse.Namespace) -> None:
    """All files as one labelled corpus."""
    parts = [readers.string_table(spark, p, args.columns.split(",")) for p in args.input.split(",")]
    writers.write_table(writers.labelled(duplicates.concat(parts), "text", args.label), args.output)


@command("wiki", "prepare")
def wiki_prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    """Sentences of an XML dump's pages that pass the line filter."""
    pages = readers.pages(spark, args.input).withColumn("text", exact.nfc(F.col("text")))
    writers.write_lines(pages.select(F.explode(X.wiki_lines(F.col("text"))).alias("value")), args.output)


@command("wiki", "normalize", ("--tags", {"action": "store_true"}))
def wiki_normalize(spark: SparkSession, args: argparse.Namespace) -> None:
    writers.write_lines(readers.lines(spark, args.input).select(_normal(args.tags)(X.chomp(F.col("value"))).alias("value")), args.output)


@command("wiki", "combine", ("--label", {"required": True}))
def wiki_combine(spark: SparkSession, args: argparse.Namespace) -> None:
    writers.write_table(writers.labelled(readers.lines(spark, args.input.split(",")), "value", args.label), args.output)


@command("tatoeba", "extract", ("--langs", {"required": True}), ("--tags", {"action": "store_true"}))
def tatoeba_extract(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = readers.tatoeba(spark, args.input, args.langs.split(","))
    writers.write_table(rows.select(_normal(args.tags)(X.chomp(F.col("text"))).alias("text"), F.col("lang").alias("label")), args.output)


@command("forms", "extract", ("--least", INT | {"default": 2}), ("--table", {}))
def forms_extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """Word clusters from root, word pairs: a headerless table, or a table of a SQLite file."""
    pairs = readers.sqlite_table(spark, args.input, args.table) if args.table else readers.table(spark, args.input, "root string, word string", header=False)
    writers.write_table(morphology.long_clusters(morphology.clusters(pairs), args.least).orderBy("cluster", "place").select("word", "cluster"), args.output)


@command("taboo", "extract", ("--depth", INT | {"default": 1000}))
def taboo_extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """Clusters of words and their spelling variants."""
    ensure_checkpoint_dir(spark)
    listed = readers.word_list(spark, args.input).select(X.deobfuscate(F.col("word")).alias("word")).distinct()
    leet = listed.select("word", F.explode(X.leet_variants(F.col("word"))).alias("variant"))
    pairs = duplicates.union([leet, morphology.arabizi_closure(listed, args.depth), listed.select("word", F.col("word").alias("variant"))])
    grouped = morphology.clusters(pairs.select(F.col("word").alias("root"), F.col("variant").alias("word")))
    writers.write_table(morphology.long_clusters(grouped).orderBy("cluster", "place").select("word", "cluster"), args.output)


@command("taboo", "protect")
def taboo_protect(spark: SparkSession, args: argparse.Namespace) -> None:
    """Each line in Base64."""
    writers.write_encoded_lines(readers.lines(spark, args.input), args.output)


@command("query", "run", ("--name", {"required": True}))
def query_run(spark: SparkSession, args: argparse.Namespace) -> None:
    """A catalogue query over a folder of tables, as Parquet."""
    from wordloom.plans.catalogue import QUERIES

    QUERIES[args.name](spark, args.input).write.parquet(args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wordloom", description=__doc__)
    groups = top.add_subparsers(dest="group", required=True)
    made: dict[str, argparse._SubParsersAction] = {}
    for (group, name), (options, f) in COMMANDS.items():
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(dest="command", required=True)
        one = made[group].add_parser(name, help=f.__doc__)
        one.add_argument("input")
        one.add_argument("output")
        for flag, settings in options:
            one.add_argument(flag, **settings)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.group, args.command][1](session(), args)


if __name__ == "__main__":
    main()
