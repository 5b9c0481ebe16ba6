from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (round(float(v), 9) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want


def test_split_over_selected_enzymes_is_registered():
    assert "em_enzyme_restricted" in SQL


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_the_subpackage_imports_it():
    root = Path(entry.__file__).parent
    for f in [*root.glob("tagforge/**/*.py"), root / "bench.py"]:
        if "tagforge/llm" not in f.as_posix():
            assert "tagforge.llm" not in f.read_text(), f
