"""Queries of the package that SQL can express give what DuckDB gives."""

import pytest

from sievelake.llm import registry
from tests.oracle import connection, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, registry.QUERIES[name], registry.ORACLE[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_chat_sql_on_other_roles(spark, tmp_path):
    """The test tables hold three roles only; the SQL must agree on others too."""
    turns = [(1, 0, "human", "q\n"), (1, 1, "gpt", "a <s>"), (2, 0, "model", None), (2, 1, "assistant", "b"), (3, 0, None, "c"), (5, 0, "bot", "d")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = connection("/nowhere")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("op3_chat_format", "chat_layouts"):
        assert differences(spark, con, registry.QUERIES[name], registry.ORACLE[name], str(tmp_path)) == []
