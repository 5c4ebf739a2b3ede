import duckdb
import pytest
from pyspark.sql import functions as F

from vellumflow import plans

from .compare import connect, same

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = plans.all_queries(), plans.all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, FOLDER), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_index_store_answers_every_question(spark, tmp_path):
    """Also one without an id, which is a question like the others."""
    chunks, rows = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("chunks", "query_results"))
    text = chunks.filter("length(content) > 30").orderBy("chunk_seq").first()["content"][:30]
    rows = rows.unionByName(rows.limit(1).withColumns({"result_id": F.lit(None).cast("bigint"), "query": F.lit(text)}))
    asked = {r[0] for r in rows.select("result_id").collect()}
    con = duckdb.connect()
    for name, df in (("chunks", chunks), ("query_results", rows)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = QUERIES["s06_index_store"](spark, str(tmp_path))
    same(found, con, SQL["s06_index_store"])
    assert {r["qid"] for r in found.select("qid").collect()} == asked
