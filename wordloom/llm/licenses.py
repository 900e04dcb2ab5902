"""License scans, in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

1. Notice lines (those that name a licence, copyright, rights or a warranty) of every file are cut into terms. Term weights are
   ``(1 + ln tf) * idf``; idf is taken over all notice lines of the corpus.
2. A line's cosine to each template comes from one join on terms. Terms that no template has count in the line's length only, with the
   idf of a term seen once. A file's licence is that of its best line, from ``least`` on; equal scores go by the licence's name.
3. Texts are compared too: the whole file, and each run of neighbouring paragraphs that have notice lines (so a header without the code below
   it), as one vector each against the headers and whole licences of ``license_texts``; the weights are those of these fixed texts. The best
   of lines and texts decides. 'All rights reserved' decides only where nothing else matches, in a file and in a directory.
4. A file named as a licence file gives its licence to its directory (the best score, then the name, where a directory has several).
   A file without a licence of its own takes that of the nearest ancestor directory that has one, found by joining all ancestors of
   all directories with the licensed directories.

Files with a null or empty text have no licence of their own; a null path inherits nothing. Very long texts are read whole. Of equal scores the first
licence by name holds. An empty table gives an empty result. Repeated rows give the
same row each. Only the id column is carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

# Licences and short forms of the notices that name them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Released under CC0 1.0", "This work has been dedicated to the public domain under CC0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved"],
}
NOTICE = r"(?i)licen[sc]|copyright|rights reserved|warrant|redistribut|public domain|spdx"
TERM = r"[a-z]+|[0-9]+"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
LEAST = 0.6
#: Only where no other licence matches.
LAST = "proprietary"
#: Starts of comment lines.
COMMENT = r"^\s*(//|/\*|\*|#|--|;|%|\.\.|<!--|dnl |REM )"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def directory(path: Column) -> Column:
    """The path up to its last slash, '' at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def first_choice(licence: str, score: Column) -> Column:
    """The struct whose minimum decides: LAST only after the others, then the best score, then the name."""
    return F.struct((F.col(licence) == LAST).alias("l"), (-score).alias("s"), F.col(licence).alias("licence"))


def text_vectors() -> tuple[list[tuple[str, str, str, float]], list[tuple[str, float]], float]:
    """(licence, template, term, weight) of license_texts at length 1, (term, idf), and the idf of a term that no text has."""
    found = sorted((x.name.removesuffix(".txt"), x.read_text("utf-8")) for x in (resources.files(__package__) / "license_texts").iterdir() if x.name.endswith(".txt"))
    counts = {name: Counter(re.findall(TERM, text.lower())) for name, text in found}
    df = Counter(term for c in counts.values() for term in c)
    idf = {term: 1 + math.log((1 + len(found)) / (1 + n)) for term, n in df.items()}
    out = []
    for name, c in counts.items():
        w = {term: (1 + math.log(n)) * idf[term] for term, n in c.items()}
        norm = math.sqrt(math.fsum(x * x for x in w.values()))
        out += [(name.split(".header")[0], name, term, x / norm) for term, x in w.items()]
    return out, list(idf.items()), 1 + math.log((1 + len(found)) / 2)


def units(files: DataFrame) -> DataFrame:
    """key and unit: the texts of files (key, text) with a notice, and of each the runs of neighbouring paragraphs with one. A paragraph ends at a
    line without letters or digits and where comment lines begin or end."""
    held = files.where(F.col("text").rlike(NOTICE)).groupBy("key").agg(F.first("text").alias("text"))  # a repeated row's lines count once
    lines = held.select("key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("kind", F.when(F.col("line").rlike("[A-Za-z0-9]"), F.col("line").rlike(COMMENT)))
    by_pos = Window.partitionBy("key").orderBy("pos")
    opens = F.col("kind").isNotNull() & ~F.lag("kind").over(by_pos).eqNullSafe(F.col("kind"))
    marked = lines.withColumn("opens", opens.cast("int")).withColumn("para", F.sum("opens").over(by_pos)).where("kind is not null")
    paras = marked.groupBy("key", "para").agg(F.max(F.col("line").rlike(NOTICE)).alias("notice"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows")).where("notice")
    island = F.col("para") - F.row_number().over(Window.partitionBy("key").orderBy("para"))
    runs = paras.withColumn("island", island).groupBy("key", "island").agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"))
    return held.select("key", F.col("text").alias("unit")).union(runs.select("key", F.array_join("rows.line", "\n").alias("unit"))).distinct()


def text_licences(files: DataFrame, least: float) -> DataFrame:
    """key and b (see first_choice) of the files (key, text) with a unit like a header or a whole licence."""
    spark = files.sparkSession
    vectors, idf, rare = text_vectors()
    shaped = F.broadcast(spark.createDataFrame(vectors, "licence string, template string, term string, tw double"))
    known = F.broadcast(spark.createDataFrame(idf, "term string, idf double"))
    found = materialise(units(files).withColumn("uid", F.xxhash64("unit")), "units")
    listed = found.groupBy("uid").agg(F.first("unit").alias("unit")).select("uid", F.explode(terms(F.col("unit"))).alias("term")).groupBy("uid", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = materialise(listed.join(known, "term", "left").select("uid", "term", ((1 + F.ln("tf")) * F.coalesce("idf", F.lit(rare))).alias("w")), "unit-terms")
    norms = weighed.groupBy("uid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(shaped, "term").groupBy("uid", "licence", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "uid").select("uid", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("uid").agg(F.min(first_choice("licence", F.col("score"))).alias("b"))
    return found.select("key", "uid").join(best, "uid").select("key", "b")


def own_licences(files: DataFrame, least: float = LEAST) -> DataFrame:
    """key, licence, score of the files (key, text) with a notice that matches a template, or a text that matches a licence's."""
    spark = files.sparkSession
    lines = files.select("key", F.explode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(NOTICE))).alias("line"))
    lines = materialise(lines.groupBy("key", "line").agg(F.count(F.lit(1)).alias("times")).withColumn("lid", F.xxhash64("line")), "notices")
    distinct = lines.groupBy("lid").agg(F.first("line").alias("line"), F.sum("times").alias("times"))
    listed = distinct.select("lid", "times", F.explode(terms(F.col("line"))).alias("term")).groupBy("lid", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("times").alias("times"))
    listed = materialise(listed, "terms")
    total = lines.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("total"))  # one row
    shapes = spark.createDataFrame([(k, f"{k}:{i}", t) for k, v in TEMPLATES.items() for i, t in enumerate(v)], "licence string, template string, notice string")
    parts = shapes.select("licence", "template", F.explode(terms(F.col("notice"))).alias("term")).groupBy("licence", "template", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = parts.select("term").distinct()  # the fixed templates' terms, some fifty
    df = listed.join(F.broadcast(known), "term", "left_semi").groupBy("term").agg(F.sum("times").alias("df"))
    idf = F.broadcast(known.join(df, "term", "left").crossJoin(total).select("term", (1 + F.ln((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0))))).alias("idf")))
    rare = F.broadcast(total.select((1 + F.ln((1 + F.col("total")) / 2)).alias("rare")))
    weight = (1 + F.ln("tf")) * F.col("idf")
    shaped = parts.join(idf, "term").withColumn("w", weight)
    shaped = F.broadcast(shaped.join(shaped.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "template").select("licence", "template", "term", (F.col("w") / F.col("norm")).alias("tw")))
    weighed = listed.join(idf, "term", "left").crossJoin(rare).select("lid", "term", ((1 + F.ln("tf")) * F.coalesce("idf", "rare")).alias("w"))
    norms = weighed.groupBy("lid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(shaped, "term").groupBy("lid", "licence", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "lid").select("lid", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("lid").agg(F.min(first_choice("licence", F.col("score"))).alias("b"))
    return lines.join(best, "lid").select("key", "b").union(text_licences(files, least)).groupBy("key").agg(F.min("b").alias("b")).select("key", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """id, path, licence (null: none), how ('own', 'inherited' or null), score and from_dir (where it is inherited from) of every row."""
    source = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    # a row is known by its id, path and text
    source = source.withColumn("key", F.concat_ws("\x01", F.xxhash64("id", "path", "text").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    own = materialise(own_licences(source.select("key", "text"), least), "own")
    rows = source.select("id", "path", "key").join(own, "key", "left").withColumn("dir", directory(F.col("path")))
    rows = materialise(rows.select("id", "path", "dir", "licence", "score"), "files")
    given = rows.where(F.col("licence").isNotNull() & F.col("path").rlike(LICENSE_FILE)).groupBy("dir").agg(F.min(first_choice("licence", F.col("score"))).alias("b"))
    given = given.select(F.col("dir").alias("from_dir"), F.col("b.licence").alias("given"))
    dirs = rows.where("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    above = dirs.select("dir", F.posexplode(chain).alias("depth", "from_dir"))
    nearest = above.join(given, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "given")).alias("n"))
    out = rows.join(nearest, "dir", "left")
    has = F.col("licence").isNotNull()
    takes = F.col("n").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("licence", F.col("n.given")).alias("licence"),
        F.when(has, "own").when(takes, "inherited").alias("how"),
        "score",
        F.when(~has, F.col("n.from_dir")).alias("from_dir"),
    )
