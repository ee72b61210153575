"""Every corpus query that has SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from noticeworks.llm import queries as corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(table):
    return sorted([tuple("" if v is None else str(v) for v in r) for r in table], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(corpus.ORACLES))
def test_corpus_matches_duckdb(spark, duck, name):
    df = corpus.QUERIES[name](spark, SF)
    want = duck.sql(corpus.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    at = [want.columns.index(c) for c in cols]
    assert rows(got) == rows([tuple(r[i] for i in at) for r in want.fetchall()])
