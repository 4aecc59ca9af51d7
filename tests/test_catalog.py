"""Every registered query against its DuckDB oracle (sf0.001), and the entry point."""
import math

import duckdb
import pytest

from helpers import SF_SMALL
import __spark_entry__ as entry_mod

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES = entry_mod.queries()
ORACLE = entry_mod.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(ORACLE[key])
    ocols = [d[0] for d in res.description]
    order = sorted(range(len(ocols)), key=lambda i: ocols[i])
    want = sorted(tuple(_norm(r[i]) for i in order) for r in res.fetchall())
    assert cols == sorted(ocols)
    assert got == want


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    assert df.count() > 0


def test_entry(spark):
    out = entry_mod.entry(spark)
    assert out.columns == ["event_id", "x1", "x2"]
    assert out.count() == 76
