"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
ORACLES = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        v = round(v, 6)
        return 0.0 if v == 0 else v
    return v


def _rows(tbl):
    cols = sorted(tbl.column_names)
    data = [tbl.column(c).to_pylist() for c in cols]
    return cols, sorted((tuple(_norm(x) for x in r) for r in zip(*data)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["post_type", "n_posts", "n_above", "mean_score"]
    assert len(rows) >= 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF001).toArrow()
    exp = con.sql(ORACLES[name]).to_arrow_table()
    c1, r1 = _rows(got)
    c2, r2 = _rows(exp)
    assert c1 == c2
    assert [str(got.schema.field(c).type) for c in c1] == [str(exp.schema.field(c).type) for c in c2]
    assert r1 == r2


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF001)
    assert df.count() >= 1
