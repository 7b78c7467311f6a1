"""Every registered query against its DuckDB statement on the smallest data set."""

import duckdb
import pytest

from signalspark.plans import ORACLE, QUERIES
from tools.compare import TABLES, plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    df, rel = QUERIES[name](spark, FOLDER), con.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    order = [rel.columns.index(c) for c in cols]
    assert ours == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def test_queries_without_sql_are_few():
    assert {n for n in QUERIES if n not in ORACLE} == {"f3_build_ivf", "f4_ivf_search", "f5_encode_pq", "f6_pq_search", "f7_rerank_quantized", "f8_recall_of_ivf", "f14_publish_index", "g12_train_factors"}


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["user_id", "items"] and out.count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
