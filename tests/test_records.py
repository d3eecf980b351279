"""F/G semantics on fixture answers (FIXTURES.md section 5)."""

import json

import pytest
from pyspark.sql import functions as F

from pagelane.operators.records import parse_responses, union_records, explode_transactions, record_json
from pagelane.operators.render import render_markdown

STATEMENT = {
    "document_type": "bank_statement", "account_holder": "Jane Doe", "account_number": "12-34",
    "bank_name": "First Bank", "statement_period": "Jan 2024", "opening_balance": 1000, "closing_balance": 3850.0,
    "transactions": [
        {"date": "2024-01-02", "description": "Salary", "amount": 3000.00, "balance": 4000.0, "transaction_type": "credit"},
        {"date": "2024-01-05", "description": "Groceries", "amount": -150.00, "balance": 3850.0, "transaction_type": "debit"},
    ],
}
STATEMENT_MD = (
    "# Bank Statement\n\n**Account Holder:** Jane Doe\n**Account Number:** 12-34\n**Bank:** First Bank\n"
    "**Period:** Jan 2024\n\n**Opening Balance:** $1000.00\n**Closing Balance:** $3850.00\n\n"
    "## Transactions\n\n| Date | Description | Amount | Balance |\n|------|-------------|--------|----------|\n"
    "| 2024-01-02 | Salary | $3000.00 | $4000.00 |\n| 2024-01-05 | Groceries | $-150.00 | $3850.00 |\n")

INV = '{"invoice_number": "A1", "invoice_date": "2024-01-01", "vendor_name": "V", "customer_name": "C", "total_amount": 12.5}'
INV_MD = ("# Invoice\n\n**Invoice Number:** A1\n**Date:** 2024-01-01\n**Vendor:** V\n**Customer:** C\n"
          "**Total Amount:** $12.50\n\n")

CASES = [
    # (label, response, expected status, expected markdown or None for "original text")
    ("bank_statement", json.dumps(STATEMENT), "ok", STATEMENT_MD),
    ("bank_statement", "```json\n" + json.dumps(STATEMENT) + "\n```", "ok", STATEMENT_MD),
    ("bank_statement", "```\n" + json.dumps(STATEMENT) + "\n```", "bad_json", None),
    ("invoice", INV, "ok", INV_MD),
    ("invoice", INV + " thanks", "bad_json", None),
    ("invoice", INV + "] x", "bad_json", None),
    ("invoice", INV + "} x", "bad_json", None),
    ("invoice", INV + ", " + INV, "bad_json", None),
    ("invoice", "{'a': 1}", "bad_json", None),
    ("invoice", "[" + INV + "]", "bad_schema", None),
    ("invoice", "5", "bad_schema", None),
    ("other", '{"title": "a", "title": "b"}', "ok", "# Document\n\n**Title:** b\n**Date:** N/A\n\n"),
    ("bank_statement", '{"account_number": 123}', "bad_schema", None),
    ("invoice", '{"total_amount": "12.50"}', "ok",
     "# Invoice\n\n**Invoice Number:** N/A\n**Date:** N/A\n**Vendor:** N/A\n**Customer:** N/A\n**Total Amount:** $12.50\n\n"),
    ("invoice", '{"total_amount": " 1_000 "}', "ok",
     "# Invoice\n\n**Invoice Number:** N/A\n**Date:** N/A\n**Vendor:** N/A\n**Customer:** N/A\n**Total Amount:** $1000.00\n\n"),
    ("invoice", '{"total_amount": "1,000"}', "bad_schema", None),
    ("invoice", '{"total_amount": "$5"}', "bad_schema", None),
    ("invoice", '{"total_amount": ""}', "bad_schema", None),
    ("invoice", '{"total_amount": "7D"}', "bad_schema", None),
    ("invoice", '{"total_amount": true}', "ok",
     "# Invoice\n\n**Invoice Number:** N/A\n**Date:** N/A\n**Vendor:** N/A\n**Customer:** N/A\n**Total Amount:** $1.00\n\n"),
    ("bank_statement", '{"transactions": null}', "bad_schema", None),
    ("accident_claim", '{"witnesses": null}', "ok", None),
    ("accident_claim", '{"witnesses": ["a", null]}', "bad_schema", None),
    ("bank_statement", '{"transactions": [{"transaction_type": "refund"}]}', "bad_schema", None),
    ("bank_statement", '{"transactions": [5]}', "bad_schema", None),
    ("invoice", '{"document_type": null}', "bad_schema", None),
    ("invoice", '{"document_type": "Invoice"}', "bad_schema", None),
    ("other", '{"zz": 1}', "ok", "# Document\n\n**Title:** N/A\n**Date:** N/A\n\n"),
    ("invoice", '{"document_type": "bank_statement"}', "ok", ""),
    ("other", '{"document_type": "receipt"}', "ok", "# Document\n\n**Title:** N/A\n**Date:** N/A\n\n"),
    ("invoice", "", "empty", ""),
    ("invoice", '{"vendor_name": ""}', "ok",
     "# Invoice\n\n**Invoice Number:** N/A\n**Date:** N/A\n**Vendor:** N/A\n**Customer:** N/A\n**Total Amount:** $0.00\n\n"),
    ("other", '{"parties": ["A", "B"], "amounts": [0.125, 2.675, 1.005, -150, 0]}', "ok",
     "# Document\n\n**Title:** N/A\n**Date:** N/A\n\n**Parties:** A, B\n**Amounts:** $0.12, $2.67, $1.00, $-150.00, $0.00\n"),
    ("other", '{"key_information": [1]}', "bad_schema", None),
    ("insurance_form", '{"incident_description": "hit", "claim_amount": null}', "ok",
     "# Insurance Form\n\n**Policy Number:** N/A\n**Claim Number:** N/A\n**Insured Name:** N/A\n"
     "**Incident Date:** N/A\n**Claim Amount:** $0.00\n\n**Incident Description:**\nhit\n\n"),
    ("receipt", '{"title": "r"}', "ok", "# Document\n\n**Title:** r\n**Date:** N/A\n\n"),
    ("invoice", "   ", "bad_json", None),
]


@pytest.fixture(scope="module")
def rendered(spark):
    rows = [(i, label, resp) for i, (label, resp, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "page_no int, document_type string, response string")
    out = render_markdown(parse_responses(df)).orderBy("page_no").collect()
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(rendered, i):
    label, resp, status, md = CASES[i]
    row = rendered[i]
    assert row["parse_status"] == status, (resp, row["parse_status"])
    expected = resp if md is None and status != "ok" else md
    if expected is not None:
        assert row["markdown"] == expected


def test_with_markdown_matches_two_step(spark):
    from pagelane.plans.flows import classified_pages
    rows = [(i, "invoice" if lbl == "invoice" else lbl, resp) for i, (lbl, resp, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "page_no int, class_response string, response string")
    one = {r["page_no"]: (r["parse_status"], r["markdown"]) for r in classified_pages(df).collect()}
    from pagelane.operators.routing import normalize_label
    two_df = df.withColumn("document_type", normalize_label("class_response"))
    two = {r["page_no"]: (r["parse_status"], r["markdown"])
           for r in render_markdown(parse_responses(two_df)).collect()}
    assert one == two


def test_union_and_transactions(spark):
    df = spark.createDataFrame([(1, "bank_statement", json.dumps(STATEMENT)), (2, "invoice", INV)],
                               "page_no int, document_type string, response string")
    parsed = parse_responses(df)
    u = union_records(parsed, ["page_no"])
    assert sorted(r["schema_type"] for r in u.collect()) == ["bank_statement", "invoice"]
    tx = explode_transactions(parsed, ["page_no"]).orderBy("txn_no").collect()
    assert [t["amount"] for t in tx] == [3000.0, -150.0]
    js = parsed.filter("page_no = 1").select(record_json(F.col("bank_statement")).alias("j")).first()["j"]
    back = json.loads(js)
    assert list(back)[:3] == ["document_type", "account_holder", "account_number"]
    assert back["address"] is None and back["transactions"][1]["reference"] is None


def test_filter_on_parsed_column_stays_small(spark):
    df = spark.createDataFrame([(i, "invoice", INV) for i in range(50)], "page_no int, document_type string, response string")
    parsed = parse_responses(df, with_markdown=True)
    plan = parsed.filter(F.col("markdown") != "").select("page_no")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000
    assert parsed.filter(F.col("parse_status") == "ok").count() == 50


def test_format_output_forms(spark):
    from pagelane.operators.render import format_output
    df = spark.createDataFrame([(1, "invoice", INV), (2, "invoice", "not json")],
                               "page_no int, document_type string, response string")
    parsed = parse_responses(df)
    js = {r["page_no"]: r["output"] for r in format_output(parsed, "json").collect()}
    rec = json.loads(js[1])
    assert rec["invoice_number"] == "A1" and rec["total_amount"] == 12.5 and rec["due_date"] is None
    assert js[2] == "not json"
    txt = {r["page_no"]: r["output"] for r in format_output(parsed, "text").collect()}
    assert txt[1] == ("document_type=<DocumentType.INVOICE: 'invoice'> invoice_number='A1' invoice_date='2024-01-01' due_date=None "
                      "vendor_name='V' customer_name='C' total_amount=12.5 tax_amount=None subtotal=None items=[] "
                      "vendor_address=None customer_address=None") and txt[2] == "not json"
    assert js[1].startswith('{\n  "document_type": "invoice",\n  "invoice_number": "A1",') and '"items": [],' in js[1]
    md = {r["page_no"]: r["output"] for r in format_output(parsed, "markdown").collect()}
    assert md[1] == INV_MD
