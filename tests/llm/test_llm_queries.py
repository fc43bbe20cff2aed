"""Every query of the subpackage on the smallest tables, against SQL where there is some."""

import duckdb
import pytest

from surgelight.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in queries.ORACLES:
        return
    con = duckdb.connect()
    con.execute(f"CREATE VIEW tweets AS SELECT * FROM '{data}/tweets.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    order = [d[0] for d in cursor.description]
    assert got == sorted((tuple(r[order.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)


def test_columns_of_the_fixed_results(spark, data):
    want = {
        "p1_found": [("seq", "bigint"), ("kind", "string")],
        "p2_found": [("seq", "bigint"), ("field", "string")],
        "p3_found": [("token", "string"), ("mark", "string")],
        "p4_found": [("id_a", "bigint"), ("id_b", "bigint")],
        "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p9_found": [("doc_id", "bigint")],
    }
    assert {n: queries.QUERIES[n](spark, data).dtypes for n in want} == want
