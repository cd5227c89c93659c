"""Queries of this package that SQL can express, against DuckDB."""

import duckdb

from noteloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_chat_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = c.execute(queries.CHAT_SQL)
    names = [d[0] for d in want.description]
    got = [tuple(r) for r in queries.op3_chat_format(spark, SF).select(*names).collect()]
    assert sorted(got) == sorted(want.fetchall())
