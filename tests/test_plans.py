"""Plan properties of the registered queries (what PLANS.md states)."""

import contextlib
import io
import os
import re

import pytest

from pagelane.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

# Windows allowed only over already-aggregated rows.
SMALL_WINDOW_QUERIES = {"bottlenecks", "document_sizes"}
# Windows over one split of a file (what one task reads) and over one row per split.
SPLIT_WINDOW_QUERIES = {"log_records_by_day"}


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: formatted(fn(spark, SF)) for name, fn in catalog.queries().items()}


def test_no_python_in_registered_queries(plans):
    for name, plan in plans.items():
        assert not re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", plan), name


def test_windows_only_over_aggregates(plans):
    for name, plan in plans.items():
        if re.search(r"^\(\d+\) Window", plan, re.M):
            assert name in SMALL_WINDOW_QUERIES | SPLIT_WINDOW_QUERIES, name


def test_scans_are_pruned(plans):
    # orders has 6 columns; the flows that read it use a subset or exactly what they need.
    schema = re.findall(r"orders\.parquet\]\n(?:[^\n]*\n)*?ReadSchema: (struct<[^\n]*>)", plans["class_labels"])
    assert schema and schema[0] == "struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>"
    docs = re.findall(r"documents\.parquet\]\n(?:[^\n]*\n)*?ReadSchema: (struct<[^\n]*>)", plans["text_sanitize"])
    assert docs and docs[0] == "struct<doc_id:bigint,text:string>"


def test_no_forced_broadcast_of_data_sized_tables(plans):
    # Explicit broadcast hints only on fixed-size tables (nation): the invoice flow
    # joins customer through Spark's own size check, not a hint.
    from pagelane.plans import responders
    import inspect
    assert "broadcast" not in inspect.getsource(responders.invoice_answers)


@pytest.mark.parametrize("name", ["statement_pages", "statement_transactions", "invoice_records_json", "page_outcomes", "record_union"])
def test_the_answer_is_parsed_once(spark, name):
    """The strict parse is three parser calls, and the plan holds it once."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"parse_json\(", plan)) <= 3, name


def test_assembly_has_one_exchange_on_the_document(plans):
    assert len(re.findall(r"^\(\d+\) Exchange", plans["conversation_documents"], re.M)) == 1
    assert len(re.findall(r"^\(\d+\) Exchange", plans["batch_report"], re.M)) == 2
