"""Every query against its SQL on DuckDB: column names, row counts and values."""

import datetime
import math
import os

import duckdb
import pytest

from wordloom.plans import analysis, coverage, roundtrips  # noqa: F401  (they add their queries)
from wordloom.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def compare(df, db, sql):
    cols = sorted(df.columns)
    want = db.execute(sql)
    assert sorted(d[0] for d in want.description) == cols
    at = [next(i for i, d in enumerate(want.description) if d[0] == c) for c in cols]
    expected = sorted([plain(r[i]) for i in at] for r in want.fetchall())
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf_dir, duck):
    compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(name, spark, sf_dir):
    one, two = (sorted(map(str, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert one
    assert one == two
