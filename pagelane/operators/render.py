"""Typed record -> markdown (G1-G9), as string expressions on struct columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelane.functions.text import fmt2, money, or_na, python_text
from pagelane.operators.records import RECORD_COLUMNS, SCHEMAS, TRANSACTION_FIELDS, bare_words_back

NL = "\n"


def _line(label: str, value: Column) -> list:
    return [F.lit(f"**{label}:** "), value, F.lit(NL)]


def _nonempty(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def render_bank_statement(r: Column) -> Column:
    """G2."""
    txn_row = lambda t: F.concat(
        F.lit("| "), or_na(t["date"]), F.lit(" | "), or_na(t["description"]), F.lit(" | "),
        money(t["amount"]), F.lit(" | "), money(t["balance"]), F.lit(" |\n"))
    table = F.concat(
        F.lit("## Transactions\n\n| Date | Description | Amount | Balance |\n"
              "|------|-------------|--------|----------|\n"),
        F.array_join(F.transform(r["transactions"], txn_row), ""))
    return F.concat(
        F.lit("# Bank Statement\n\n"),
        *_line("Account Holder", or_na(r["account_holder"])),
        *_line("Account Number", or_na(r["account_number"])),
        *_line("Bank", or_na(r["bank_name"])),
        *_line("Period", or_na(r["statement_period"])), F.lit(NL),
        *_line("Opening Balance", money(r["opening_balance"])),
        *_line("Closing Balance", money(r["closing_balance"])), F.lit(NL),
        F.when(F.size(r["transactions"]) > 0, table).otherwise(F.lit("")))


def render_insurance_form(r: Column) -> Column:
    """G3."""
    desc = r["incident_description"]
    return F.concat(
        F.lit("# Insurance Form\n\n"),
        *_line("Policy Number", or_na(r["policy_number"])),
        *_line("Claim Number", or_na(r["claim_number"])),
        *_line("Insured Name", or_na(r["insured_name"])),
        *_line("Incident Date", or_na(r["incident_date"])),
        *_line("Claim Amount", money(r["claim_amount"])), F.lit(NL),
        F.when(_nonempty(desc), F.concat(F.lit("**Incident Description:**\n"), desc, F.lit("\n\n")))
        .otherwise(F.lit("")))


def render_accident_claim(r: Column) -> Column:
    """G4."""
    desc = r["accident_description"]
    return F.concat(
        F.lit("# Accident Claim\n\n"),
        *_line("Claim Number", or_na(r["claim_number"])),
        *_line("Claimant", or_na(r["claimant_name"])),
        *_line("Accident Date", or_na(r["accident_date"])),
        *_line("Location", or_na(r["accident_location"])),
        *_line("Damage Amount", money(r["damage_amount"])), F.lit(NL),
        F.when(_nonempty(desc), F.concat(F.lit("**Description:**\n"), desc, F.lit("\n\n")))
        .otherwise(F.lit("")))


def render_invoice(r: Column) -> Column:
    """G5."""
    return F.concat(
        F.lit("# Invoice\n\n"),
        *_line("Invoice Number", or_na(r["invoice_number"])),
        *_line("Date", or_na(r["invoice_date"])),
        *_line("Vendor", or_na(r["vendor_name"])),
        *_line("Customer", or_na(r["customer_name"])),
        *_line("Total Amount", money(r["total_amount"])), F.lit(NL))


def render_general(r: Column) -> Column:
    """Amounts carry no zero guard."""
    parties = r["parties"]
    amounts = r["amounts"]
    return F.concat(
        F.lit("# Document\n\n"),
        *_line("Title", or_na(r["title"])),
        *_line("Date", or_na(r["date"])), F.lit(NL),
        F.when(F.coalesce(F.size(parties) > 0, F.lit(False)),
               F.concat(F.lit("**Parties:** "), F.array_join(parties, ", "), F.lit(NL))).otherwise(F.lit("")),
        F.when(F.coalesce(F.size(amounts) > 0, F.lit(False)),
               F.concat(F.lit("**Amounts:** "),
                        F.array_join(F.transform(amounts, lambda a: F.concat(F.lit("$"), fmt2(a))), ", "),
                        F.lit(NL))).otherwise(F.lit("")))


RENDERERS = {
    "bank_statement": render_bank_statement,
    "insurance_form": render_insurance_form,
    "accident_claim": render_accident_claim,
    "invoice": render_invoice,
    "other": render_general,
}

GENERAL_RECORD_TYPES = ["other", "receipt", "contract"]


def renders(schema_type: Column, record_type: Column) -> Column:
    """G1: the renderer picked by the record's own type only works on a
    record of the same schema; otherwise the page becomes ``''``."""
    specific = schema_type.isin("bank_statement", "insurance_form", "accident_claim", "invoice")
    return ((specific & (record_type == schema_type))
            | ((schema_type == "other") & record_type.isin(*GENERAL_RECORD_TYPES)))


def with_page_status(parsed: DataFrame) -> DataFrame:
    """``page_status`` alone: ``parse_status``, or ``type_mismatch`` for a valid
    record whose own type no renderer of its schema takes."""
    mismatch = (F.col("parse_status") == "ok") & ~F.coalesce(renders(F.col("schema_type"), F.col("record_type")), F.lit(False))
    return parsed.withColumn("page_status", F.when(mismatch, F.lit("type_mismatch")).otherwise(F.col("parse_status")))


def render_markdown(parsed: DataFrame, response_col: str = "response",
                    out_col: str = "markdown") -> DataFrame:
    """G1 + F12 on a frame produced by ``parse_responses``; adds ``out_col`` and
    ``page_status``: markdown for valid records of the matching type, ``''`` on
    type mismatch or empty answers, the original answer on every parse failure."""
    staged = with_page_status(parsed)
    rendered = F.lit(None).cast("string")
    for t, fn in RENDERERS.items():
        rendered = F.when(F.col("schema_type") == t, fn(F.col(RECORD_COLUMNS[t]))).otherwise(rendered)
    markdown = (F.when(F.col("page_status").isin("empty", "type_mismatch"), F.lit(""))
                .when(F.col("page_status") == "ok", rendered)
                .otherwise(F.col(response_col)))
    return staged.withColumn(out_col, markdown)


def json_number(x: Column) -> Column:
    """A float as the record models write it to JSON: an exponent below 1e-5 and from 1e16 on (``1e16``, ``1.5e-7``), null for no finite number."""
    finite = (F.abs(x) < float("inf")) & ~F.isnan(x)
    return F.when(finite, F.regexp_replace(number_text(x, 1e-5), r"e(-?)\+?0*", "e$1"))


def number_text(x: Column, plain_from: float = 1e-4) -> Column:
    """A float as Python prints it: the fewest digits that read back as the same number, with an exponent below 1e-4 and from 1e16 on.

    Fifteen digits are tried first (trailing zeros go, so shorter numbers come out
    short), then sixteen, then seventeen, which always read back."""
    fifteen, sixteen, seventeen = (F.format_string(f"%.{n}e", x) for n in (14, 15, 16))
    digits = F.when(fifteen.try_cast("double") == x, fifteen).when(sixteen.try_cast("double") == x, sixteen).otherwise(seventeen)
    size = F.abs(x)
    plain = F.regexp_replace(F.regexp_replace(digits.try_cast("decimal(38,21)").cast("string"), r"0+$", ""), r"\.$", ".0")
    return (F.when(F.isnan(x), F.lit("nan")).when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when(x == 0, F.when(x.cast("string").startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
            .when((size >= plain_from) & (size < 1e16), plain)
            .when(x.isNotNull(), F.regexp_replace(digits, r"\.?0*e", "e")))


def _enum_text(enum: str, x: Column) -> Column:
    return F.concat(F.lit(f"<{enum}."), F.upper(x), F.lit(": '"), x, F.lit("'>"))


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def _field_text(x: Column, kind: str) -> Column:
    """A field's value as the record's ``str()`` shows it."""
    if kind == "str":
        text = python_text(x, "string")
    elif kind == "float":
        text = number_text(x)
    elif kind == "doctype":
        text = _enum_text("DocumentType", x)
    elif kind == "txtype":
        text = _enum_text("TransactionType", x)
    elif kind == "strlist":
        text = _listed(F.transform(x, lambda e: python_text(e, "string")))
    elif kind == "floatlist":
        text = _listed(F.transform(x, lambda e: number_text(e)))
    elif kind == "txlist":
        text = _listed(F.transform(x, lambda t: F.concat(
            F.lit("Transaction("), _fields_text(t, TRANSACTION_FIELDS, ", "), F.lit(")"))))
    else:
        text = bare_words_back(F.to_json(x))
    return F.coalesce(text, F.lit("None"))


def _fields_text(record: Column, fields, separator: str) -> Column:
    return F.concat_ws(separator, *[F.concat(F.lit(f"{name}="), _field_text(record[name], kind)) for name, kind in fields])


def _json_text(x: Column, kind: str, indent: int) -> Column:
    """A field's value as JSON, nested values indented by two."""
    inner, close = "\n" + " " * (indent + 2), "\n" + " " * indent

    def block(items, brackets):
        return F.when(F.size(items) == 0, F.lit(brackets)).otherwise(
            F.concat(F.lit(brackets[0] + inner), F.array_join(items, "," + inner), F.lit(close + brackets[1])))

    def quoted(e):
        return F.regexp_replace(F.to_json(F.array(e)), r"(?s)^\[|\]$", "")
    if kind == "float":
        text = json_number(x)
    elif kind == "strlist":
        text = block(F.transform(x, quoted), "[]")
    elif kind == "floatlist":
        text = block(F.transform(x, lambda e: F.coalesce(json_number(e), F.lit("null"))), "[]")
    elif kind == "txlist":
        text = block(F.transform(x, lambda t: _json_object(t, TRANSACTION_FIELDS, indent + 2)), "[]")
    elif kind == "dict":
        text = bare_words_back(F.to_json(x), "null")
    else:
        text = F.when(x.isNotNull(), quoted(x))
    return F.coalesce(text, F.lit("null"))


def _json_object(record: Column, fields, indent: int = 0) -> Column:
    inner, close = "\n" + " " * (indent + 2), "\n" + " " * indent
    body = [F.concat(F.lit(f'"{name}": '), _json_text(record[name], kind, indent + 2)) for name, kind in fields]
    return F.concat(F.lit("{" + inner), F.concat_ws("," + inner, *body), F.lit(close + "}"))


def format_output(parsed: DataFrame, output_format: str = "markdown", response_col: str = "response",
                  out_col: str = "output") -> DataFrame:
    """Raw text passes through; ``json`` gives the record as JSON indented
    by two; ``markdown`` the rendering; anything else ``field=value`` text.
    (The free-form ``key_information`` object is compact JSON in both.)"""
    if output_format == "markdown":
        return render_markdown(parsed, response_col, out_col)
    body = F.lit(None).cast("string")
    for st, col in RECORD_COLUMNS.items():
        rec = F.col(col)
        text = _json_object(rec, SCHEMAS[st]) if output_format == "json" else _fields_text(rec, SCHEMAS[st], " ")
        body = F.when(F.col("schema_type") == st, text).otherwise(body)
    return parsed.withColumn(out_col, F.when(F.col("parse_status") == "ok", body).when(F.col("parse_status") == "empty", F.lit(""))
                             .otherwise(F.col(response_col)))
