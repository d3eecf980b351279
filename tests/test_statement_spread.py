"""The statement answers are parsed where a shuffle puts them, not on the splits of the orders file."""

import datetime
import re
import tempfile

import pytest

from pagelane.plans import catalog

DAY = datetime.date(1995, 3, 1)


@pytest.fixture(scope="module")
def folder(spark):
    path = tempfile.mkdtemp(prefix="pagelane-test-")
    orders = [(k, 7, 5.25, DAY, "1-URGENT") for k in (1, 2, 2, 3, None)]
    lines = [(k, 40 + n, n, 2.0, 9.5, "R" if n == 1 else "N", DAY) for k, n in ((1, 1), (1, 2), (2, 1), (None, 1))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date, o_orderpriority string") \
        .coalesce(1).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_returnflag string, l_shipdate date").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["statement_pages", "statement_transactions"])
def test_small_lines_are_not_sent_to_the_splits_of_the_orders(spark, folder, name):
    plan = catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and len(re.findall(r"Exchange hashpartitioning\((?:o|l)_orderkey", plan)) == 2


def test_repeated_and_null_order_keys_keep_their_rows(spark, folder):
    rows = catalog.QUERIES["statement_pages"](spark, folder).select("o_orderkey", "n_transactions").collect()
    assert sorted(tuple(r) for r in rows if r["o_orderkey"]) == [(1, 2), (2, 1), (2, 1), (3, 0)]
    assert sum(r["o_orderkey"] is None for r in rows) == 1
