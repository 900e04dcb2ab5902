import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import make
from wordloom.llm.line_dedup import BANDS, PARITY_WORDS, common_shingles, distinct_shingles, line_dedup, lines_of, linked, shingle_set, signatures, sketches


def row_key(d, t):
    """As Spark's xxhash64(doc_id, text)."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", d), 42)
    h = xxhash.xxh64_intdigest(t.encode(), h) if t is not None else h
    return (h ^ (1 << 63)) - (1 << 63)


def brute(rows, num=80):
    first = {}
    for d, t in rows:
        if d is not None:
            for k, x in lines_of((t or "").encode()):
                first[x] = min(first.get(x, (d, k, row_key(d, t))), (d, k, row_key(d, t)))
    lines = list(first)
    sets = [shingle_set(x.decode()) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for a, s in enumerate(sets):
        common = Counter(b for g in s for b in by[g])
        for g in s:
            by[g].append(a)
        for b, n in common.items():
            if 100 * n >= num * (len(s) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    keeper = {}
    for k, x in enumerate(lines):
        keeper[find(k)] = min(keeper.get(find(k), first[x]), first[x])
    number = {x: k for k, x in enumerate(lines)}
    out = []
    for d, t in rows:
        own = lines_of((t or "").encode())
        gone = {k for k, x in own if d is not None and keeper[find(number[x])] != (d, k, row_key(d, t))}
        out.append((str(d), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(own), len(gone)))
    return sorted(out, key=str)


def got(docs):
    return sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in line_dedup(docs).collect()), key=str)


@pytest.mark.parametrize("name", ["corpus", "edge", "empty"])
def test_brute_force(name, request):
    docs = request.getfixturevalue(name)
    done = line_dedup(docs)
    assert [c for c in done.columns if c not in ("n_lines", "n_removed")] == [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_lines_inside_a_document_and_near_copies(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from the farm at night"
    rows = [(2, f"{long}!\n\nshort\nshort"), (1, f"x\n {long} \nshort "), (3, "  \n\n")]
    assert got(make(spark, rows)) == brute(rows)


def test_rows_of_one_doc_id(spark):
    """Rows of one doc_id with different texts lose only their own repeated lines, repeated rows the same ones."""
    one, two = "a line that both of the two rows of number one have", "a line of its own that occurs nowhere else at all"
    rows = [(0, one), (1, one), (1, two), (1, two), (2, f"{one}\n{two}"), (None, one), (None, two)]
    done = got(make(spark, rows))
    assert done == brute(rows)
    assert ("1", two, 1, 0) in done and ("1", "", 1, 1) in done


def test_many_blocks(spark, monkeypatch):
    """Copies and similar lines across blocks, tasks and buckets; bands that a block shares within."""
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(30, 90))) for _ in range(60)]
    rows = []
    for i in range(300):
        x = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 3))):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        rows.append((i, "".join(x) + "\n" + rng.choice(base)))
    monkeypatch.setattr("wordloom.llm.line_dedup.LINE_BUCKET", 4_000)
    monkeypatch.setattr("wordloom.llm.line_dedup.BAND_BUCKET", 2_000)
    monkeypatch.setattr("wordloom.llm.line_dedup.BROADCAST_LINES", 0)
    assert got(make(spark, rows).repartition(7)) == brute(rows)


def test_recall_of_bands():
    """Pairs of similarity 0.8 to 0.86 share a band."""
    rng = random.Random(5)
    pairs = []
    while len(pairs) < 1500:
        a = rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=rng.randint(40, 400))
        b = list(a)
        for at in rng.sample(range(len(a)), rng.randint(1, 1 + len(a) // 60)):
            b[at] = "#"
        x, y = "".join(a).strip(), "".join(b).strip()
        s, t = shingle_set(x), shingle_set(y)
        if 0.8 <= len(s & t) / len(s | t) <= 0.86:
            pairs.append((x, y))
    bands = [signatures([x.encode() for x in side])[1] for side in zip(*pairs, strict=True)]
    assert (bands[0] == bands[1]).any(axis=1).mean() >= 0.98


def test_signatures_and_sketches():
    rng = np.random.default_rng(1)
    chars = rng.integers(97, 123, 400)
    lines = []
    for changed in (0, 3, 60):
        x = chars.copy()
        x[rng.choice(400, changed, replace=False)] = 48
        lines.append(bytes(x.astype(np.uint8)))
    lines += [b"short", b"short", "é".encode() * 9]
    has, bands = signatures(lines)
    assert has.tolist() == [0, 1, 2, 5]
    same = lambda a, b: int((bands[a] == bands[b]).sum())
    assert bands.shape[1] == BANDS and same(0, 1) >= 3 and same(0, 2) == 0
    sets = [shingle_set(x.decode()) for x in lines]
    owner, value = distinct_shingles(lines)
    assert np.bincount(owner, minlength=6).tolist() == [len(x) for x in sets]
    sketch = sketches(owner, value, 6, 8)
    common, total = common_shingles([lines[a] for a in range(6) for _ in range(6)], lines * 6)
    for a in range(6):
        for b in range(6):
            assert sum(bin(int(x) & (2**64 - 1)).count("1") for x in sketch[a] ^ sketch[b]) <= len(sets[a] ^ sets[b])
            assert (common[6 * a + b], total[6 * a + b]) == (len(sets[a] & sets[b]), len(sets[a]) + len(sets[b]))


@pytest.mark.parametrize("few", [8, 60])
def test_links_of_a_frequent_band(spark, monkeypatch, few):
    """Near copies that share two bands: the components of all pairs, from no more links than the groups have lines."""
    monkeypatch.setattr("wordloom.llm.line_dedup.SLICE", 20 if few == 8 else 512)
    monkeypatch.setattr("wordloom.llm.line_dedup.FEW", few)
    rng = random.Random(11)
    base = "".join(rng.choices("abcdefghijklmnop ", k=160))
    lines = set()
    while len(lines) < 60:
        x = list(base)
        for at in rng.sample(range(len(x)), rng.randint(1, 4)):
            x[at] = rng.choice("XYZ")
        lines.add("".join(x).strip())
    lines = sorted(lines)
    sets = [shingle_set(x) for x in lines]
    near = [(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    owner, value = distinct_shingles([x.encode() for x in lines])
    sketch = sketches(owner, value, 60, PARITY_WORDS).reshape(60, -1).tolist()
    records = spark.createDataFrame([(i, len(s), k, x.encode()) for i, (s, k, x) in enumerate(zip(sets, sketch, lines, strict=True))], "node long, n long, sketch array<long>, text binary")
    members = spark.createDataFrame([(key, i) for key in (5, -3) for i in range(60)], "key long, node long")
    found = [(r.u, r.v) for r in linked(members, records, 80, 100).collect()]

    def parts(edges):
        label = list(range(60))
        for a, b in edges:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        return label

    assert parts(found) == parts(near) and len(set(parts(near))) > 1
    assert len(found) <= (len(near) if few == 60 else 2 * 60)
    if few == 8:
        assert len(near) > 120
