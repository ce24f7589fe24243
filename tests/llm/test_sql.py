import hashlib

import duckdb
import pytest

from handprint.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    frame = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(frame.columns)

    def digest(rows):
        return sorted(hashlib.md5(repr([round(v, 6) if isinstance(v, float) else v
                                        for v in r]).encode()).hexdigest() for r in rows)
    assert digest(tuple(r) for r in frame.select(*columns).collect()) == digest(result.fetchall())
