"""DuckDB oracle SQL for the registered queries.

Each oracle computes the expected result directly from the driver tables
by string building and plain aggregates. None of them parses JSON: the
expected page text follows from the damage rule of the responder, so the
oracle is independent of the parser and renderer it checks.
"""

from __future__ import annotations

from pagelane.functions import fixed
from pagelane.functions.text import sql_quote as q
from pagelane.plans.responders import INVOICE_CLASS_ANSWERS

NL = "chr(10)"
SEP = q(fixed.PAGE_SEPARATOR)
HEADER = q(fixed.DOC_HEADER)


def _money(x: str) -> str:
    return f"'$' || printf('%.2f', CASE WHEN {x} IS NULL OR {x} = 0 THEN 0.0 ELSE {x} END)"


def _or_na(x: str) -> str:
    return f"coalesce(nullif({x}, ''), 'N/A')"


def invoice_documents() -> str:
    answers = ", ".join(q(a) for a in INVOICE_CLASS_ANSWERS)
    return f"""
WITH base AS (
  SELECT o.o_orderkey, o.o_totalprice, o.o_orderdate, o.o_orderstatus, o.o_orderpriority,
         c.c_custkey, c.c_name, c.c_mktsegment,
         o.o_orderkey % 10 AS r,
         list_extract([{answers}], (o.o_orderkey % 7 + 1)::INTEGER) AS class_answer,
         CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amt,
         CASE WHEN o.o_orderstatus = 'P' THEN '' ELSE c.c_mktsegment END AS vendor
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
), js AS (
  SELECT *,
    '{{"document_type": "' || CASE WHEN r = 9 THEN 'receipt' ELSE 'invoice' END ||
    '", "invoice_number": ' || CASE WHEN r = 8 THEN CAST(o_orderkey AS VARCHAR) ELSE '"INV-' || CAST(o_orderkey AS VARCHAR) || '"' END ||
    ', "invoice_date": "' || strftime(o_orderdate, '%Y-%m-%d') ||
    '", "due_date": null, "vendor_name": "' || vendor ||
    '", "customer_name": "' || c_name ||
    '", "total_amount": ' || CASE WHEN r = 7 THEN '"' || amt || '"' ELSE amt END ||
    ', "tax_amount": null, "items": ["' || o_orderpriority || '"]}}' AS body
  FROM base
), resp AS (
  SELECT *,
    CASE WHEN r = 6 THEN body || ' Thanks!'
         WHEN r % 2 = 0 THEN '```json' || {NL} || body || {NL} || '```'
         ELSE body END AS response,
    CASE WHEN lower(trim(class_answer, ' ' || chr(9) || chr(10))) IN ('invoice', 'receipt', 'bill')
         THEN 'invoice' ELSE 'other' END AS label
  FROM js
), md AS (
  SELECT c_custkey, o_orderkey,
    CASE WHEN r = 6 THEN response
         WHEN label = 'other' THEN CASE WHEN r = 9
              THEN '# Document' || {NL} || {NL} || '**Title:** N/A' || {NL} || '**Date:** N/A' || {NL} || {NL}
              ELSE '' END
         WHEN r = 8 THEN response
         WHEN r = 9 THEN ''
         ELSE '# Invoice' || {NL} || {NL}
              || '**Invoice Number:** INV-' || CAST(o_orderkey AS VARCHAR) || {NL}
              || '**Date:** ' || strftime(o_orderdate, '%Y-%m-%d') || {NL}
              || '**Vendor:** ' || {_or_na('vendor')} || {NL}
              || '**Customer:** ' || {_or_na('c_name')} || {NL}
              || '**Total Amount:** ' || {_money('CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)')} || {NL} || {NL}
    END AS page_md
  FROM resp
), pos AS (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS k FROM md
)
SELECT c_custkey, CAST(count(*) AS BIGINT) AS n_pages,
       {HEADER} || string_agg('# Page ' || CAST(k AS VARCHAR) || {NL} || {NL} || page_md || {SEP}, '' ORDER BY k) AS markdown
FROM pos GROUP BY c_custkey
"""
