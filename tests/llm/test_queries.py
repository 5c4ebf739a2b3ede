import pytest

from vellumflow.llm import queries

from ..compare import connect, same

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"item_kind", "item_id", "canon_id"}, "p2_found": {"record_kind", "record_id", "defect"}, "p3_found": {"item_kind", "id_a", "id_b"}, "p4_found": {"item_kind", "item_id"},
    "p5_found": {"item_kind", "item_id", "noise_kind"}, "p6_ids": {"doc_id", "ids"}, "p8_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name]
        assert len(rows) == len(set(map(str, rows)))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name])


def test_pairs_are_ordered(spark):
    assert queries.p3_found(spark, FOLDER).filter("id_a >= id_b").count() == 0
