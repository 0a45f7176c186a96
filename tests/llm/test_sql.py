from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import assert_same, connect, rows  # noqa: E402

from stintflow.llm import queries, quotes, sql  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])


def test_quotes_agree_on_nested_ones(spark):
    m = [(1, 0, "user", "Hello there, my friend.\nHow are you?\n\nBye"), (1, 1, "assistant", "> Hello there,  my FRIEND\n> How are you\n\nI am fine."), (1, 2, "user", "On Monday A wrote:\n\n>> Hello there, my friend.\n> I am fine.\n\n> Bye\nGood!\r\nYes"), (1, 3, None, "> Good\n> Yes\n> > Bye\nno"), (2, 0, "user", "> I am fine.\nx"), (2, 1, "user", None), (2, 2, "user", "\n\n")]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    want = con.sql(sql.QUOTES)
    got = quotes.link_quotes(spark, df).withColumnRenamed("conv", "conv_id")
    columns = sorted(got.columns)
    assert rows(got.toArrow().to_pylist(), columns) == rows(want.to_arrow_table().to_pylist(), columns)
