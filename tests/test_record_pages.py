"""Hand-written answers and the pages they must give, one block per record kind."""

import pytest

from pagelane.operators.records import parse_responses

PAGES = [
    ("bank_statement", '{"account_holder": "Ann", "opening_balance": "10.5", "closing_balance": null, "transactions": []}', "ok",
     "# Bank Statement\n\n**Account Holder:** Ann\n**Account Number:** N/A\n**Bank:** N/A\n**Period:** N/A\n\n"
     "**Opening Balance:** $10.50\n**Closing Balance:** $0.00\n\n"),
    ("bank_statement", '{"transactions": [{"date": "d", "amount": 1.005, "transaction_type": "fee"}, {"description": "x|y", "balance": true}]}', "ok",
     "# Bank Statement\n\n**Account Holder:** N/A\n**Account Number:** N/A\n**Bank:** N/A\n**Period:** N/A\n\n"
     "**Opening Balance:** $0.00\n**Closing Balance:** $0.00\n\n## Transactions\n\n| Date | Description | Amount | Balance |\n"
     "|------|-------------|--------|----------|\n| d | N/A | $1.00 | $0.00 |\n| N/A | x|y | $0.00 | $1.00 |\n"),
    ("insurance_form", '{"policy_number": "P", "claim_amount": 2.675, "incident_description": ""}', "ok",
     "# Insurance Form\n\n**Policy Number:** P\n**Claim Number:** N/A\n**Insured Name:** N/A\n**Incident Date:** N/A\n**Claim Amount:** $2.67\n\n"),
    ("insurance_form", '{"incident_description": "Fire"}', "ok",
     "# Insurance Form\n\n**Policy Number:** N/A\n**Claim Number:** N/A\n**Insured Name:** N/A\n**Incident Date:** N/A\n**Claim Amount:** $0.00\n\n"
     "**Incident Description:**\nFire\n\n"),
    ("accident_claim", '{"claimant_name": "Bo", "damage_amount": 0.125, "accident_description": "Hail", "witnesses": ["a", "b"]}', "ok",
     "# Accident Claim\n\n**Claim Number:** N/A\n**Claimant:** Bo\n**Accident Date:** N/A\n**Location:** N/A\n**Damage Amount:** $0.12\n\n"
     "**Description:**\nHail\n\n"),
    ("invoice", '```json\n{"document_type": "invoice", "total_amount": " 7 ", "extra": [1]}\n```', "ok",
     "# Invoice\n\n**Invoice Number:** N/A\n**Date:** N/A\n**Vendor:** N/A\n**Customer:** N/A\n**Total Amount:** $7.00\n\n"),
    ("contract", '{"title": "T", "parties": ["A", "B"], "amounts": [1, "2.5", -0.5]}', "ok",
     "# Document\n\n**Title:** T\n**Date:** N/A\n\n**Parties:** A, B\n**Amounts:** $1.00, $2.50, $-0.50\n"),
    ("other", '{"parties": null, "amounts": [], "key_information": {"k": [1, 2]}}', "ok", "# Document\n\n**Title:** N/A\n**Date:** N/A\n\n"),
    ("invoice", '{"document_type": "receipt"}', "ok", ""),
    ("other", '{"document_type": "invoice"}', "ok", ""),
    ("other", "", "empty", ""),
    ("invoice", '{"items": "single"}', "bad_schema", None),
    ("invoice", '{"invoice_number": true}', "bad_schema", None),
    ("other", '{"key_information": [1]}', "bad_schema", None),
    ("other", '{"amounts": [null]}', "bad_schema", None),
    ("bank_statement", '{"transactions": {"date": "x"}}', "bad_schema", None),
    ("bank_statement", '{"transactions": [{"amount": "abc"}]}', "bad_schema", None),
    ("insurance_form", '{"claim_amount": [1]}', "bad_schema", None),
    ("other", '"text"', "bad_schema", None),
    ("other", '```\n{"title": "T"}\n```', "bad_json", None),
    ("other", '{"title": "T"', "bad_json", None),
    ("other", '{"title": "T"}, {}', "bad_json", None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, label, answer) for i, (label, answer, _, _) in enumerate(PAGES)],
                               "page_no int, document_type string, response string")
    return {r["page_no"]: r for r in parse_responses(df, with_markdown=True).collect()}


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_page(parsed, number):
    label, answer, status, markdown = PAGES[number]
    assert parsed[number]["parse_status"] == status
    assert parsed[number]["markdown"] == (answer if markdown is None else markdown)


def test_generated_answers_never_lose_a_page(spark):
    """Cut, doubled and wrapped forms of every answer give a page or the answer itself."""
    forms = [a for _, a, _, _ in PAGES for a in (a, a[:-1], a + a, f"[{a}]", f" {a}\n", a + " ok?")]
    df = spark.createDataFrame([(i, "other", a) for i, a in enumerate(forms)], "page_no int, document_type string, response string")
    rows = {r["page_no"]: r for r in parse_responses(df, with_markdown=True).collect()}
    assert len(rows) == len(forms)
    for i, answer in enumerate(forms):
        if rows[i]["parse_status"] in ("bad_json", "bad_schema"):
            assert rows[i]["markdown"] == answer
