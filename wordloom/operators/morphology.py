"""Morphology: word clusters, feature pivots, affix indicators, stemming and annotated sentences."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import text as X
from wordloom.session import stored


def clusters(pairs: DataFrame, root: str = "root", word: str = "word") -> DataFrame:
    """root and its distinct other forms, sorted; a root without other forms has an empty array."""
    forms = F.array_sort(F.collect_set(F.when(F.col(word) != F.col(root), F.col(word))))
    return pairs.groupBy(F.col(root).alias("root")).agg(forms.alias("forms"))


def typed_clusters(pairs: DataFrame, kind: str = "wordtype", word: str = "word") -> DataFrame:
    """The variant keyed by a word type: all forms, the key is not one of them."""
    return pairs.groupBy(F.col(kind).alias("root")).agg(F.array_sort(F.collect_set(word)).alias("forms"))


def long_clusters(grouped: DataFrame, least: int = 1, with_root: bool = True) -> DataFrame:
    """word, cluster and place: the root first, then its forms. Clusters are numbered from 0 by root; those with an empty root or fewer
    words than least are left out. Roots are numbered by partition offsets, so no task sorts all of them."""
    kept = grouped.where((F.coalesce("root", F.lit("")) != "") & (F.size("forms") + (1 if with_root else 0) >= least))
    words = F.concat(F.array("root"), F.col("forms")) if with_root else F.col("forms")
    return dense_index(kept, "root").select(F.posexplode(words).alias("place", "word"), F.col("index").cast("int").alias("cluster")).select("word", "cluster", "place")


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """df with index: the place, from 0, of a row's key among the sorted distinct keys. Keys are cut into ranges by value; a range's offset is
    the number of keys before it (one row a range), so the numbering is distributed. Null comes first."""
    keys = df.select(key).distinct()
    if isinstance(df.schema[key].dataType, T.StringType):
        head = F.coalesce(F.substring(F.col(key), 1, 2), F.lit(""))
    else:  # ranges of the value, as text would sort 10 before 2
        number = F.unix_micros(F.col(key).cast("timestamp")) if isinstance(df.schema[key].dataType, (T.DateType, T.TimestampType)) else F.col(key).cast("double")
        bounds = keys.select(F.percentile_approx(number.cast("double"), [i / 64 for i in range(1, 64)])).first()[0] or []
        below = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < number)) if bounds else F.lit(0)
        head = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(below)
    sizes = keys.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("before"))
    inner = keys.withColumn("head", head).withColumn("at", F.row_number().over(Window.partitionBy("head").orderBy(key)) - 1)
    numbered = inner.join(before, "head").select(F.col(key).alias("__key"), (F.col("at") + F.col("before")).alias("index"))
    return df.join(numbered, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """df with index: the label's place in sorted order, from 0."""
    return dense_index(df, label)


def lookup(df: DataFrame, key: str, dimension: DataFrame, strict: bool = True) -> DataFrame:
    """Join a dimension (tag, feature, value) on key = tag; with strict an unknown tag is an error."""
    joined = df.join(dimension, df[key] == dimension["tag"], "left").drop(dimension["tag"])
    if strict:
        joined = joined.withColumn("feature", F.when(F.col("feature").isNull() & F.col(key).isNotNull(), F.raise_error(F.concat(F.lit("unknown tag "), F.col(key)))).otherwise(F.col("feature")))
    return joined


def possession_tags() -> list[str]:
    """Tags of possession by person, number and kind, as the schema builds them."""
    kinds = {"1S": "", "1D": "EI", "1P": "EI", "2S": "FM", "2D": "FM", "2P": "FM", "3S": "FM", "3D": "FM", "3P": "FM"}
    return ["PSSD", "PSS2SFORM", "PSS2SINFM", *[f"PSS{k}{x}" for k, more in kinds.items() for x in ("", *more)]]


def tag_dimension(lines: DataFrame, column: str = "value") -> DataFrame:
    """The dimension (tag, feature, value) of lines `feature: TAG TAG ...`, for lookup and inflections: the schema of a treebank, kept in a file of
    its own. `possession: *` stands for possession_tags(). Where a tag has several features, the last line's holds; a value is its tag."""
    parts = F.split(F.col(column), ":", 2)
    listed = F.filter(F.split(F.trim(parts[1]), r"\s+"), lambda x: x != "")
    tags = F.when((F.trim(parts[0]) == "possession") & (F.trim(parts[1]) == "*"), F.array(*map(F.lit, possession_tags()))).otherwise(listed)
    rows = lines.where(F.size(parts) == 2).select(F.monotonically_increasing_id().alias("at"), F.trim(parts[0]).alias("feature"), F.explode(tags).alias("tag"))
    return rows.groupBy("tag").agg(F.max_by("feature", "at").alias("feature")).withColumn("value", F.col("tag"))


def feature_pivot(rows: DataFrame, features: list[str], keys: list[str], missing: str = "NA") -> DataFrame:
    """Long (keys, pos, feature, value) to one column a feature; of several values the last by pos holds; `missing` elsewhere."""
    wide = rows.groupBy(*keys).pivot("feature", sorted(features)).agg(F.max_by("value", "pos"))
    return wide.na.fill(missing, sorted(features))


def inflections(forms: DataFrame, dimension: DataFrame, features: list[str], verbs: bool) -> DataFrame:
    """word, lemma and features of (lemma, form, tags): verbs (V), or adjectives and nouns; the first tag has to be exactly that."""
    first = F.element_at("tags", 1)
    rows = forms.where(first == "V" if verbs else first.isin("ADJ", "N")).withColumn("row", F.monotonically_increasing_id())
    long = lookup(rows.select("row", "lemma", "form", F.posexplode("tags").alias("pos", "key")), "key", dimension)
    return feature_pivot(long, features, ["row", "lemma", "form"]).drop("row").withColumnRenamed("form", "word")


def distinct_affixes(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(X.affix_parts(F.col(column))).alias("affix")).distinct()


def frequent_affixes(df: DataFrame, column: str, least: int = 200) -> list[str]:
    """Affixes of at least `least` rows, sorted: columns of the next step, so few."""
    counted = df.select(F.explode(F.array_distinct(X.affix_parts(F.col(column)))).alias("affix")).groupBy("affix").count()
    return [r.affix for r in counted.where(F.col("count") >= least).orderBy("affix").collect()]


def affix_indicators(df: DataFrame, column: str, affixes: list[str], contained: bool = False) -> DataFrame:
    """A 0/1 column for each affix: exactly one of the listed parts, or with `contained` anywhere in the text (so -s is also in -ship)."""
    has = (lambda a: F.contains(F.col(column), F.lit(a))) if contained else (lambda a: F.array_contains(X.affix_parts(F.col(column)), a))
    return df.select("*", *[F.coalesce(has(a).cast("int"), F.lit(0)).alias(a) for a in affixes])


def distinct_values(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row: the number of distinct values of each column."""
    f = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[f(c).alias(c) for c in columns])


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """column_value 0/1 columns in place of the column; a column of two values stays."""
    if len(values) == 2:
        return df
    return df.select(*[c for c in df.columns if c != column], *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in sorted(values)])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, value, count over several columns."""
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("feature", "value"))
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))


def longest_affix(word: Column, affixes: list[str], at_end: bool) -> Column:
    """The longest of the given affixes at the end (or start) of the word, '' without one; the list becomes a literal of the plan."""
    by_length = F.array(*[F.lit(a) for a in sorted({a for a in affixes if a}, key=lambda a: (-len(a), a))]).cast("array<string>")
    fits = (lambda a: F.endswith(word, a)) if at_end else (lambda a: F.startswith(word, a))
    return F.coalesce(F.try_element_at(F.filter(by_length, fits), F.lit(1)), F.lit(""))


def stem(df: DataFrame, prefixes: list[str], suffixes: list[str], word: str = "word") -> DataFrame:
    """df with prefix, root and suffix: the longest suffix goes first, then the longest prefix of what is left; the root may be empty."""
    with_suffix = df.withColumn("suffix", longest_affix(F.col(word), suffixes, True))
    rest = with_suffix.withColumn("root", F.expr(f"left(`{word}`, char_length(`{word}`) - char_length(suffix))"))
    cut = rest.withColumn("prefix", longest_affix(F.col("root"), prefixes, False))
    return cut.withColumn("root", F.expr("substring(root, char_length(prefix) + 1)"))


def stem_join(df: DataFrame, prefixes: DataFrame, suffixes: DataFrame, word: str = "word") -> DataFrame:
    """The same for affix tables (column affix) of any size: candidate lengths, up to the longest affix, become rows, equal strings join, the longest
    match stays."""
    words = df.select(word).distinct()

    def best(rows: DataFrame, column: str, affixes: DataFrame, at_end: bool) -> DataFrame:
        longest = affixes.agg(F.max(F.char_length("affix"))).first()[0] or 1
        n = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.char_length(column), F.lit(longest))))).alias("n")
        part = F.expr(f"right(`{column}`, n)" if at_end else f"left(`{column}`, n)")
        found = rows.select(column, n).withColumn("affix", part).join(affixes.select("affix").distinct(), "affix")
        return found.groupBy(column).agg(F.max_by("affix", "n").alias("found"))

    ends = words.join(best(words, word, suffixes, True), word, "left").select(word, F.coalesce("found", F.lit("")).alias("suffix"))
    ends = ends.withColumn("rest", F.expr(f"left(`{word}`, char_length(`{word}`) - char_length(suffix))"))
    starts = best(ends.select("rest").distinct(), "rest", prefixes, False)
    parts = ends.join(starts, "rest", "left").withColumn("prefix", F.coalesce("found", F.lit("")))
    return df.join(parts.select(word, "prefix", F.expr("substring(rest, char_length(prefix) + 1)").alias("root"), "suffix"), word)


def sentences(lines: DataFrame) -> DataFrame:
    """words and tags of each sentence of annotated lines (value, file, pos): blank and comment lines end a sentence, columns 2 and 4 are
    taken, multi-word lines stay. Files are the unit of order, so sentences of different files are put together in parallel."""
    breaks = (F.trim("value") == "") | F.startswith("value", F.lit("#"))
    marked = lines.withColumn("is_break", breaks.cast("int"))
    marked = marked.withColumn("sentence", F.sum("is_break").over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    cols = F.split("value", "\t")
    kept = marked.where("is_break = 0").select("file", "sentence", "pos", F.try_element_at(cols, F.lit(2)).alias("word"), F.try_element_at(cols, F.lit(4)).alias("tag"))
    grouped = kept.groupBy("file", "sentence").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "tag"))).alias("rows"))
    return grouped.select("file", "sentence", F.col("rows.word").alias("words"), F.col("rows.tag").alias("tags"))


def tag_summary(tagged: DataFrame) -> DataFrame:
    """One row: sentences, words and mean words a sentence."""
    return tagged.agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.size("words")).cast("long").alias("words"), F.avg(F.size("words")).alias("mean_words"))


def tag_counts(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def sentence_lengths(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(F.size("words").alias("length")).agg(F.count(F.lit(1)).alias("sentences"))


def spread(words: DataFrame) -> DataFrame:
    """word, dealt to several tasks a core: a word is short but can have very many spellings, so sizes in bytes say nothing about the work."""
    return words.repartition(4 * words.sparkSession.sparkContext.defaultParallelism, "word")


#: Endings of a word that are made once and put after each beginning.
ENDINGS = 1 << 12


def leet_of(word: str) -> Iterator[list[str]]:
    """The strings of functions.text.leet_variants, each once, in lists of up to ENDINGS."""
    signs = []  # of each letter with a choice of two: (letter, sign, whether the sign has to occur, as the other one makes the rest)
    for letter, pair in X.LEET.items():
        if len(pair) > 1:
            have = [y for y in pair if y in word]
            if len(have) > 1:
                return
            free = have or list(pair)
            signs.append([(letter, y, k > 0) for k, y in enumerate(free if letter in word else free[:1])])
    plain = {letter: y for letter, y in X.LEET.items() if len(y) == 1}
    for taken in itertools.product(*signs):
        sign = plain | {letter: y for letter, y, _ in taken}
        need = [y for _, y, must in taken if must]
        cut = next(i for i in range(len(word) + 1) if 1 << sum(c in sign for c in word[i:]) <= ENDINGS)
        heads, tails = (map("".join, itertools.product(*[[c, sign[c]] if c in sign else [c] for c in part])) for part in (word[:cut], word[cut:]))
        fitting: dict[tuple[str, ...], list[str]] = {(): list(tails)}  # endings with the signs that a beginning lacks
        for head in heads:
            lack = tuple(y for y in need if y not in head)
            if lack not in fitting:
                fitting[lack] = [x for x in fitting[()] if all(y in x for y in lack)]
            made = [head + x for x in fitting[lack]]
            if head == word[:cut] and not lack:
                made.remove(word)
            if made:
                yield made


def leet_spellings(words: DataFrame, batch: int = 1 << 14) -> DataFrame:
    """word and variant: all spellings of the word in lower case with signs for letters, a row each. Variants are made as they are written, so a
    long word costs rows, not memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, times, made = [], [], []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(source, pa.string()).take(pa.array(np.repeat(np.arange(len(times)), times))), pa.array(made, pa.string())], ["word", "variant"])

        for rows in batches:
            for word, low in zip(rows.column("word").to_pylist(), rows.column("low").to_pylist(), strict=True):
                for variants in leet_of(low):
                    source.append(word)
                    times.append(len(variants))
                    made += variants
                    if len(made) >= batch:
                        yield full()
                        source, times, made = [], [], []
        if made:
            yield full()

    return spread(words.where("word is not null").select("word", F.lower("word").alias("low"))).mapInArrow(run, "word string, variant string")


#: Variants of a word that one task holds.
HELD = 1 << 12


def closure_of(word: str, rounds: int, most: int = HELD) -> set[str] | None:
    """All that replacing leads to in fewer rounds, with the word itself; None beyond so many rounds or variants."""
    found, new = {word}, {word}
    for _ in range(rounds):
        new = {x.replace(old, y, 1) for x in new for old, to in X.ARABIZI.items() if old in x for y in to} - found
        if not new:
            return found
        found |= new
        if len(found) > most:
            break
    return None


def arabizi_closure(words: DataFrame, rounds: int = 1000) -> DataFrame:
    """word and variant: everything that replacing digraphs again and again leads to, each variant once, without the word itself.
    Where that is little, a task finds it word by word; words with more go through rounds of joins, in which new variants are only looked for from
    those that are new, until there are none. If they don't end within `rounds`, that is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            word, variant, whole = [], [], []
            for w in rows.column("word").to_pylist():
                found = closure_of(w, rounds)
                made = [w] if found is None else sorted(found - {w})
                word += [w] * len(made)
                variant += made
                whole += [found is not None] * len(made)
                if len(word) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(variant, pa.string()), pa.array(whole, pa.bool_())], ["word", "variant", "whole"])
                    word, variant, whole = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(variant, pa.string()), pa.array(whole, pa.bool_())], ["word", "variant", "whole"])

    tried = stored(spread(words.select("word").where("word IS NOT NULL").distinct()).mapInArrow(run, "word string, variant string, whole boolean"), "variants")
    done = tried.where("whole").select("word", "variant")
    found = tried.where("NOT whole").select("word", "variant")
    if found.isEmpty():
        return done
    found = new = found.checkpoint()
    for _ in range(rounds):
        grown = new.select("word", F.explode(X.arabizi_variants(F.col("variant"))).alias("variant")).distinct()
        new = grown.join(found, ["word", "variant"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        found = found.union(new)
    else:
        raise RuntimeError(f"variants did not end in {rounds} rounds")
    return done.union(found.where("word <> variant"))
