"""Every query with a DuckDB equivalent gives its rows, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import assert_same, session

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(name):
    assert_same(session(), entry.queries()[name], entry.oracle_sql()[name], SF)


def test_entry_has_columns():
    assert entry.entry(session()).columns == ["query_id", "chunk_id", "rank", "score"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize(("name", "table", "key"), [("vector_topk", "embeddings", "vec_id"), ("fts_topk", "benchmark", "item_id"), ("search_batch", "benchmark", "item_id")])
def test_searches_take_every_row_divisible_by_50(name, table, key):
    spark = session()
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect() if r[0] % 50 == 0}
    assert {r.query_id for r in entry.queries()[name](spark, SF).collect()} == want
