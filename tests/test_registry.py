"""Every registered query with SQL gives DuckDB's rows."""

from __future__ import annotations

import duckdb
import pytest

from newsloom.plans import link_queries, news_queries, registry, relevance_queries, request_queries, score_queries, selection_queries, stream_queries  # noqa: F401  (they register their queries)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df, columns):
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
