import math
import re
from collections import Counter
from importlib import resources

import pytest

from wordloom.llm.licenses import LEAST, NOTICE, TEMPLATES, license_scan

MIT, GPL, CC = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."
FILES = [
    (1, "a/LICENSE", MIT),
    (2, "a/b/c/x.txt", "plain words"),
    (3, "a/b/COPYING.md", f"some head\n{GPL}\nmore"),
    (4, "a/b/own.txt", f"words\n{CC}"),
    (5, "z/x.txt", "no licence in any directory above"),
    (6, "LICENSE", "Licensed under the Apache License, Version 2.0."),
    (7, "top.txt", None),
    (8, None, "words"),
    (9, "ab/x.txt", ""),
    (10, "a/x.txt", "copyright of nobody that any template knows, with many other words around"),
    (10, "a/x.txt", "copyright of nobody that any template knows, with many other words around"),
    (11, None, MIT),
]


def terms(text):
    return Counter(re.findall("[a-z]+|[0-9]+", text.lower()))


def brute_best(files):
    lines = [x for _, _, t in files for x in sorted(set((t or "").split("\n"))) if re.search(NOTICE, x)]
    known = {w for v in TEMPLATES.values() for t in v for w in terms(t)}
    total = len(lines)
    df = Counter(w for x in lines for w in terms(x))
    idf = lambda w: 1 + math.log((1 + total) / (1 + (df[w] if w in known else 1)))
    vector = lambda x: {w: (1 + math.log(n)) * idf(w) for w, n in terms(x).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for x in set(lines):
        v, best = vector(x), []
        for licence, notices in TEMPLATES.items():
            for t in notices:
                u = vector(t)
                best.append((-round(sum(v.get(w, 0) * y for w, y in u.items()) / norm(u) / norm(v), 9), licence))
        if best and -min(best)[0] >= LEAST:
            out[x] = min(best)
    return out


@pytest.fixture(scope="module")
def result(spark):
    files = spark.createDataFrame([(*f, "x", 1) for f in FILES], "doc_id long, path string, text string, licence string, score int")
    return license_scan(files).collect()


def test_inheritance(result):
    got = sorted((r.doc_id, r.licence, r.how, r.from_dir) for r in result)
    want = [
        (1, "MIT", "own", None),
        (2, "GPL-3.0", "inherited", "a/b"),
        (3, "GPL-3.0", "own", None),
        (4, "CC-BY-NC-4.0", "own", None),
        (5, "Apache-2.0", "inherited", ""),
        (6, "Apache-2.0", "own", None),
        (7, "Apache-2.0", "inherited", ""),
        (8, None, None, None),
        (9, "Apache-2.0", "inherited", ""),
        (10, "MIT", "inherited", "a"),
        (10, "MIT", "inherited", "a"),
        (11, "MIT", "own", None),
    ]
    assert got == want


def test_scores(result):
    best = brute_best(FILES)
    for r, f in ((r, f) for r in result for f in FILES if f[0] == r.doc_id and f[0] != 10):
        lines = [best[x] for x in (f[2] or "").split("\n") if x in best]
        assert (r.how == "own") == bool(lines)
        if lines:
            assert math.isclose(r.score, -min(lines)[0], abs_tol=1e-6)


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, path string, text string")).collect() == []


GPL_HEADER = """/* tool.c - a tool of many uses
 *
 * Copyright (C) 2019 Some Body <some@body.example>
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */
"""
MPL_HEADER = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
CODE = "int main(void) {\n    return step(argument) + other_step(more, arguments);\n}\n" * 40


def test_headers_and_whole_licences(spark):
    body = {p.name.removesuffix(".txt"): p.read_text() for p in (resources.files("wordloom.llm") / "license_texts").iterdir() if ".header" not in p.name}
    texts = {f"{k}/LICENSE": ("Copyright 2021 Some Body\n" + v, k) for k, v in body.items()}
    texts |= {"gpl.c": (GPL_HEADER + CODE, "GPL-3.0"), "gpl2.c": (GPL_HEADER.replace("version 3", "version 2") + CODE, "GPL-2.0"), "mpl.py": (MPL_HEADER + CODE, "MPL-2.0")}
    bsd = "\n".join(f"// {x}" for x in body["BSD-3-Clause"].splitlines())
    texts |= {"bsd.js": (bsd + "\n" + CODE, "BSD-3-Clause"), "own.c": ("// Copyright Some Body.\n// All rights reserved.\n" + CODE, "proprietary")}
    files = spark.createDataFrame([(i, "r/" + p, t) for i, (p, (t, _)) in enumerate(texts.items())], "doc_id long, path string, text string")
    got = {r.path: (r.licence, r.how) for r in license_scan(files).collect()}
    assert got == {"r/" + p: (k, "own") for p, (_, k) in texts.items()}


def test_rights_reserved_is_last_in_a_directory(spark):
    files = spark.createDataFrame([(1, "a/NOTICE", "All rights reserved."), (2, "a/LICENSE", "Released under the MIT License, by us."), (3, "a/x", "words")], "doc_id long, path string, text string")
    assert {r.doc_id: r.licence for r in license_scan(files).collect()} == {1: "proprietary", 2: "MIT", 3: "MIT"}
