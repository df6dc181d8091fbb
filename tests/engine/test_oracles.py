"""Every query with a SQL twin returns the same rows as the twin on the small tables."""

import math

import duckdb
import pytest

from sensorspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def tidy(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f"{float(x):.5f}".replace("-0.00000", "0.00000")
        return str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, tiny, oracle, name):
    df = catalog.queries()[name](spark, tiny)
    cur = oracle.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert tidy(df.collect(), df.columns) == tidy(cur.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, tiny, name):
    assert catalog.queries()[name](spark, tiny).count() >= 0
