"""Deterministic model answers derived from the driver tables.

The hosted model is not part of the library; these responders stand in
for it so that every stage after the model call runs on data that grows
with the tables. Each one builds, per row, the classification answer and
the JSON answer a model would give, and damages a share of answers by a
rule on the row key (trailing text, wrong field types, conflicting
``document_type``) so the fallback paths are exercised on every run.

Numbers are written as ``CAST(CAST(x AS DECIMAL(18,2)) AS STRING)`` and
dates as ``yyyy-MM-dd`` so that an independent SQL engine can rebuild the
same answer text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelane.operators.balance import spread
from pagelane.sources.tables import read_table


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def dec2(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("decimal(18,2)").cast("string")


def _fence(json_text: Column, fenced: Column) -> Column:
    return F.when(fenced, F.concat(F.lit("```json\n"), json_text, F.lit("\n```"))).otherwise(json_text)


# FIXED VALUES: classification answers cycled by key (index = key % 7).
INVOICE_CLASS_ANSWERS = ["invoice", "Invoice", " receipt\n", "BILL", "Bill", "invoice document", "\tINVOICE "]


def invoice_answers(spark, sf_dir: str) -> DataFrame:
    """orders x customer -> one invoice page per order; customer = document.

    Damage by ``r = o_orderkey % 10``: 6 trailing text, 7 amount as a
    string (still valid), 8 invoice number as a number (bad schema),
    9 ``document_type`` "receipt" (type mismatch); even ``r`` is fenced.
    """
    orders = spread(read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    base = orders.join(customer, orders.o_custkey == customer.c_custkey)
    r = F.col("o_orderkey") % 10
    amount = dec2("o_totalprice")
    invoice_no = F.when(r == 8, F.col("o_orderkey").cast("string")).otherwise(
        _q(F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string"))))
    vendor = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("c_mktsegment"))
    body = F.concat(
        F.lit('{"document_type": '), _q(F.when(r == 9, F.lit("receipt")).otherwise(F.lit("invoice"))),
        F.lit(', "invoice_number": '), invoice_no,
        F.lit(', "invoice_date": '), _q(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.lit(', "due_date": null, "vendor_name": '), _q(vendor),
        F.lit(', "customer_name": '), _q(F.col("c_name")),
        F.lit(', "total_amount": '), F.when(r == 7, _q(amount)).otherwise(amount),
        F.lit(', "tax_amount": null, "items": ['), _q(F.col("o_orderpriority")), F.lit("]}"))
    response = F.when(r == 6, F.concat(body, F.lit(" Thanks!"))).otherwise(_fence(body, r % 2 == 0))
    class_answer = F.element_at(F.array(*[F.lit(a) for a in INVOICE_CLASS_ANSWERS]),
                                (F.col("o_orderkey") % 7 + 1).cast("int"))
    return base.select(
        F.col("c_custkey").alias("doc_id"), "o_orderkey",
        class_answer.alias("class_response"), response.alias("response"))
