import os

import pytest

from pictorium.llm.registry import ORACLES, QUERIES

DATA = os.environ.get("PICTORIUM_TESTDATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": {"table_name", "record_key"}, "p2_found": {"vector_field", "artwork_id_a", "artwork_id_b"}, "p3_found": {"result_id"}, "p5_found": {"artwork_id_a", "artwork_id_b"},
    "p7_found": {"doc_id", "item_id"}, "p8_mixture": {"mix_id", "source", "doc_id", "tokens", "copies"}, "p9_found": {"doc_id"},
}


def test_names():
    assert set(ORACLES) <= set(QUERIES) and set(COLUMNS) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert set(df.columns) == COLUMNS[name] and len({tuple(r) for r in rows}) == len(rows)
    if {"artwork_id_a", "artwork_id_b"} <= set(df.columns):
        assert all(r.artwork_id_a < r.artwork_id_b for r in rows)
