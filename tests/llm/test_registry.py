import duckdb
import pytest

import __spark_entry__
from sensorspark.llm import registry


def test_one_query_for_each_operator_and_the_pipeline():
    names = set(registry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert names <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = registry.queries()[name](spark, tiny)
    assert sorted(columns) == sorted(df.columns)
    text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert text(df.select(*columns).collect()) == text(cur.fetchall())
