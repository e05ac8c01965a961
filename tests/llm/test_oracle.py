"""Queries of the operators against their SQL."""

import duckdb
import pytest

from tideline.llm import registry

SF = "/root/testdata/sf0.01"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(sql.columns, map(str, sql.types), strict=True))
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(sql.select(*cols).fetchall(), key=repr)
