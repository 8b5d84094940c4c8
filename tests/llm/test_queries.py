"""Registered queries against their SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from check import plain
from clipspark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    assert got == Counter(tuple(plain(r[have.index(c)]) for c in cols) for r in cur.fetchall()) and got


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
