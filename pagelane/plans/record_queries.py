"""Registered record flows: answers for statements, claims and general
documents derived from the driver tables, parsed, validated and rendered;
each with an oracle that rebuilds the expected text without parsing JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelane.functions.text import sql_quote as q
from pagelane.operators.assemble import ordered_page_texts
from pagelane.operators.balance import spread
from pagelane.operators.records import explode_transactions, union_records
from pagelane.operators.render import format_output, with_page_status
from pagelane.plans.flows import classified_pages, parsed_pages
from pagelane.plans.oracles import _money, _or_na
from pagelane.plans.responders import _fence, _q, dec2
from pagelane.sources.tables import read_table

NL = "chr(10)"


def _pick(key: Column, answers) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in answers]), (key % len(answers) + 1).cast("int"))


def _pick_sql(key: str, answers) -> str:
    return f"list_extract([{', '.join(q(a) for a in answers)}], ({key} % {len(answers)} + 1)::INTEGER)"


# ------------------------------------------------------------ statements
# FIXED VALUES: classification answers for statements (index = key % 3).
STATEMENT_ANSWERS = ["statement", "Bank Statement", "bank_statement"]


def statement_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement page per order; its lines are the transactions, in
    ``(l_linenumber, text)`` order. Damage by ``k = o_orderkey % 9``:
    4 gives line 1 the type "refund", 5 sends ``"transactions": null``.

    Both sides meet by shuffle: the orders of a file may be one split, and the
    costly parse that follows runs where the join puts its rows."""
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"),
        ["l_orderkey", "l_linenumber"])
    credit = F.col("l_returnflag") == "R"
    ttype = (F.when(((F.col("l_orderkey") % 9) == 4) & (F.col("l_linenumber") == 1), F.lit("refund"))
             .when(credit, F.lit("credit")).otherwise(F.lit("debit")))
    amount = F.when(credit, dec2("l_extendedprice")).otherwise(dec2(-F.col("l_extendedprice")))
    txn = F.concat(
        F.lit('{"date": '), _q(F.date_format("l_shipdate", "yyyy-MM-dd")),
        F.lit(', "description": '), _q(F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" x "),
                                                  dec2("l_quantity"))),
        F.lit(', "amount": '), amount, F.lit(', "balance": null, "transaction_type": '), _q(ttype),
        F.lit(', "reference": '), _q(F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))), F.lit("}"))
    lines = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", txn.alias("txn"))
    per_order = ordered_page_texts(lines, "o_orderkey", "l_linenumber", "txn").select(
        "o_orderkey", F.array_join("pages", ", ").alias("txns"))
    orders = spread(read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"), ["o_orderkey"])
    k = F.col("o_orderkey") % 9
    body = F.concat(
        F.lit('{"document_type": "bank_statement", "account_holder": '),
        _q(F.concat(F.lit("ACCT-"), F.col("o_custkey").cast("string"))),
        F.lit(', "account_number": '), _q(F.col("o_orderkey").cast("string")),
        F.lit(', "bank_name": '), _q(F.col("o_orderpriority")),
        F.lit(', "statement_period": '), _q(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.lit(', "opening_balance": 0, "closing_balance": '), dec2("o_totalprice"),
        F.lit(', "transactions": '),
        F.when(k == 5, F.lit("null")).otherwise(F.concat(F.lit("["), F.coalesce("txns", F.lit("")), F.lit("]"))),
        F.lit("}"))
    return (orders.join(per_order.hint("merge"), "o_orderkey", "left")
            .select(F.col("o_custkey").alias("doc_id"), "o_orderkey",
                    _pick(F.col("o_orderkey"), STATEMENT_ANSWERS).alias("class_response"),
                    _fence(body, (F.col("o_orderkey") % 2) == 0).alias("response")))


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 + F14 + G2 + I2: per statement, status, transaction count, markdown."""
    pages = classified_pages(statement_answers(spark, sf_dir))
    return pages.select("o_orderkey", "parse_status",
                        F.when(F.col("bank_statement").isNotNull(), F.size("bank_statement.transactions")).alias("n_transactions"), "markdown")


def _statement_oracle_ctes() -> str:
    return f"""
lines AS (
  SELECT l_orderkey, l_linenumber,
    '{{"date": "' || strftime(l_shipdate, '%Y-%m-%d') || '", "description": "part ' || CAST(l_partkey AS VARCHAR)
    || ' x ' || CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) || '", "amount": '
    || CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
            ELSE CAST(CAST(-l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END
    || ', "balance": null, "transaction_type": "'
    || CASE WHEN l_orderkey % 9 = 4 AND l_linenumber = 1 THEN 'refund'
            WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END
    || '", "reference": "L' || CAST(l_linenumber AS VARCHAR) || '"}}' AS txn,
    '| ' || strftime(l_shipdate, '%Y-%m-%d') || ' | part ' || CAST(l_partkey AS VARCHAR) || ' x '
    || CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) || ' | '
    || {_money("CAST(CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(18,2)) AS DOUBLE)")}
    || ' | $0.00 |' || {NL} AS row_md,
    strftime(l_shipdate, '%Y-%m-%d') AS d,
    CAST(CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(18,2)) AS DOUBLE) AS amt,
    CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS ttype
  FROM lineitem
), per AS (
  SELECT l_orderkey, string_agg(txn, ', ' ORDER BY l_linenumber, txn) AS txns,
         string_agg(row_md, '' ORDER BY l_linenumber, txn) AS rows_md, count(*) AS n,
         bool_or(l_orderkey % 9 = 4 AND l_linenumber = 1) AS refund
  FROM lines GROUP BY l_orderkey
), st AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
    coalesce(p.n, 0) AS n, coalesce(p.refund, false) AS refund, p.rows_md,
    '{{"document_type": "bank_statement", "account_holder": "ACCT-' || CAST(o.o_custkey AS VARCHAR)
    || '", "account_number": "' || CAST(o.o_orderkey AS VARCHAR) || '", "bank_name": "' || o.o_orderpriority
    || '", "statement_period": "' || strftime(o.o_orderdate, '%Y-%m-%d')
    || '", "opening_balance": 0, "closing_balance": ' || CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
    || ', "transactions": ' || CASE WHEN o.o_orderkey % 9 = 5 THEN 'null' ELSE '[' || coalesce(p.txns, '') || ']' END
    || '}}' AS body
  FROM orders o LEFT JOIN per p ON p.l_orderkey = o.o_orderkey
), resp AS (
  SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN '```json' || {NL} || body || {NL} || '```' ELSE body END AS response,
         CASE WHEN o_orderkey % 9 = 5 OR refund THEN 'bad_schema' ELSE 'ok' END AS parse_status
  FROM st
)"""


def statement_pages_sql() -> str:
    return f"""
WITH {_statement_oracle_ctes()}
SELECT o_orderkey, parse_status,
  CASE WHEN parse_status = 'ok' THEN CAST(n AS INTEGER) END AS n_transactions,
  CASE WHEN parse_status <> 'ok' THEN response ELSE
    '# Bank Statement' || {NL} || {NL}
    || '**Account Holder:** ACCT-' || CAST(o_custkey AS VARCHAR) || {NL}
    || '**Account Number:** ' || CAST(o_orderkey AS VARCHAR) || {NL}
    || '**Bank:** ' || o_orderpriority || {NL}
    || '**Period:** ' || strftime(o_orderdate, '%Y-%m-%d') || {NL} || {NL}
    || '**Opening Balance:** $0.00' || {NL}
    || '**Closing Balance:** ' || {_money('CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)')} || {NL} || {NL}
    || CASE WHEN n > 0 THEN '## Transactions' || {NL} || {NL} || '| Date | Description | Amount | Balance |' || {NL}
         || '|------|-------------|--------|----------|' || {NL} || rows_md ELSE '' END
  END AS markdown
FROM resp"""


def statement_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per transaction of each valid statement, in order."""
    pages = parsed_pages(statement_answers(spark, sf_dir))
    return explode_transactions(pages, ["o_orderkey"]).select(
        "o_orderkey", F.col("txn_no").cast("int").alias("txn_no"), "date", "amount", "transaction_type", "reference")


def statement_transactions_sql() -> str:
    return f"""
WITH {_statement_oracle_ctes()}
SELECT l.l_orderkey AS o_orderkey,
       CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.txn) - 1 AS INTEGER) AS txn_no,
       l.d AS date, l.amt AS amount, l.ttype AS transaction_type, 'L' || CAST(l.l_linenumber AS VARCHAR) AS reference
FROM lines l
JOIN resp r ON r.o_orderkey = l.l_orderkey AND r.parse_status = 'ok'"""


# ------------------------------------------------------------- claims
# FIXED VALUES: classification answers (index = key % 2).
INSURANCE_ANSWERS = ["insurance", "Insurance Form"]
ACCIDENT_ANSWERS = ["claim", "accident claim"]


def claim_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent and high-priority orders are insurance forms, the rest accident
    claims. Damage by ``m = o_orderkey % 11``: insurance 3 -> amount "$x"
    (bad schema); accident 5 -> a null witness (bad schema), 6 -> witnesses
    null (valid), 7 -> damage ``true`` (1.0). ``o_orderkey % 4 = 0`` has an
    empty description (no description block)."""
    o = spread(read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    m = key % 11
    insurance = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    date = _q(F.date_format("o_orderdate", "yyyy-MM-dd"))
    desc = _q(F.when(key % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Order status "), F.col("o_orderstatus"))))
    amount = dec2("o_totalprice")
    ins = F.concat(
        F.lit('{"document_type": "insurance_form", "policy_number": '),
        _q(F.concat(F.lit("POL-"), F.col("o_custkey").cast("string"))),
        F.lit(', "claim_number": '), _q(F.concat(F.lit("CLM-"), key.cast("string"))),
        F.lit(', "insured_name": '), _q(F.col("c_name")), F.lit(', "incident_date": '), date,
        F.lit(', "incident_description": '), desc,
        F.lit(', "claim_amount": '), F.when(m == 3, _q(F.concat(F.lit("$"), amount))).otherwise(amount),
        F.lit(', "policy_type": '), _q(F.col("c_mktsegment")), F.lit(', "address": '), _q(F.col("n_name")),
        F.lit(', "phone": null, "email": null}'))
    witnesses = (F.when(m == 5, F.concat(F.lit("["), _q(F.col("c_name")), F.lit(", null]")))
                 .when(m == 6, F.lit("null")).otherwise(F.concat(F.lit("["), _q(F.col("c_name")), F.lit("]"))))
    acc = F.concat(
        F.lit('{"document_type": "accident_claim", "claim_number": '), _q(F.concat(F.lit("ACC-"), key.cast("string"))),
        F.lit(', "claimant_name": '), _q(F.col("c_name")), F.lit(', "accident_date": '), date,
        F.lit(', "accident_location": '), _q(F.col("n_name")), F.lit(', "accident_description": '), desc,
        F.lit(', "vehicle_details": null, "damage_amount": '), F.when(m == 7, F.lit("true")).otherwise(amount),
        F.lit(', "police_report": null, "witnesses": '), witnesses, F.lit("}"))
    return base.select(
        F.col("o_custkey").alias("doc_id"), "o_orderkey",
        F.when(insurance, _pick(key, INSURANCE_ANSWERS)).otherwise(_pick(key, ACCIDENT_ANSWERS)).alias("class_response"),
        F.when(insurance, ins).otherwise(acc).alias("response"))


def claim_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 + F8 + G3 + G4."""
    pages = classified_pages(claim_answers(spark, sf_dir))
    return pages.select("o_orderkey", "document_type", "parse_status", "markdown",
                        F.when(F.col("accident_claim.witnesses").isNotNull(), F.size("accident_claim.witnesses")).alias("n_witnesses"))


def claim_pages_sql() -> str:
    return f"""
WITH b AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate, o.o_orderstatus, o.o_orderpriority,
         c.c_name, c.c_mktsegment, n.n_name, o.o_orderkey % 11 AS m,
         o.o_orderpriority IN ('1-URGENT', '2-HIGH') AS ins,
         strftime(o.o_orderdate, '%Y-%m-%d') AS d,
         CASE WHEN o.o_orderkey % 4 = 0 THEN '' ELSE 'Order status ' || o.o_orderstatus END AS descr,
         CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amt
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
), r AS (
  SELECT *,
    CASE WHEN ins THEN
      '{{"document_type": "insurance_form", "policy_number": "POL-' || CAST(o_custkey AS VARCHAR)
      || '", "claim_number": "CLM-' || CAST(o_orderkey AS VARCHAR) || '", "insured_name": "' || c_name
      || '", "incident_date": "' || d || '", "incident_description": "' || descr || '", "claim_amount": '
      || CASE WHEN m = 3 THEN '"$' || amt || '"' ELSE amt END
      || ', "policy_type": "' || c_mktsegment || '", "address": "' || n_name || '", "phone": null, "email": null}}'
    ELSE
      '{{"document_type": "accident_claim", "claim_number": "ACC-' || CAST(o_orderkey AS VARCHAR)
      || '", "claimant_name": "' || c_name || '", "accident_date": "' || d || '", "accident_location": "' || n_name
      || '", "accident_description": "' || descr || '", "vehicle_details": null, "damage_amount": '
      || CASE WHEN m = 7 THEN 'true' ELSE amt END || ', "police_report": null, "witnesses": '
      || CASE WHEN m = 5 THEN '["' || c_name || '", null]' WHEN m = 6 THEN 'null' ELSE '["' || c_name || '"]' END
      || '}}'
    END AS response,
    CASE WHEN ins AND m = 3 THEN 'bad_schema' WHEN NOT ins AND m = 5 THEN 'bad_schema' ELSE 'ok' END AS parse_status
  FROM b
)
SELECT o_orderkey, CASE WHEN ins THEN 'insurance_form' ELSE 'accident_claim' END AS document_type, parse_status,
  CASE WHEN parse_status <> 'ok' THEN response
       WHEN ins THEN '# Insurance Form' || {NL} || {NL}
         || '**Policy Number:** POL-' || CAST(o_custkey AS VARCHAR) || {NL}
         || '**Claim Number:** CLM-' || CAST(o_orderkey AS VARCHAR) || {NL}
         || '**Insured Name:** ' || {_or_na('c_name')} || {NL}
         || '**Incident Date:** ' || d || {NL}
         || '**Claim Amount:** ' || {_money('CAST(amt AS DOUBLE)')} || {NL} || {NL}
         || CASE WHEN descr <> '' THEN '**Incident Description:**' || {NL} || descr || {NL} || {NL} ELSE '' END
       ELSE '# Accident Claim' || {NL} || {NL}
         || '**Claim Number:** ACC-' || CAST(o_orderkey AS VARCHAR) || {NL}
         || '**Claimant:** ' || {_or_na('c_name')} || {NL}
         || '**Accident Date:** ' || d || {NL}
         || '**Location:** ' || {_or_na('n_name')} || {NL}
         || '**Damage Amount:** ' || {_money("CASE WHEN m = 7 THEN 1.0 ELSE CAST(amt AS DOUBLE) END")} || {NL} || {NL}
         || CASE WHEN descr <> '' THEN '**Description:**' || {NL} || descr || {NL} || {NL} ELSE '' END
  END AS markdown,
  CASE WHEN NOT ins AND parse_status = 'ok' THEN CASE WHEN m = 6 THEN NULL ELSE 1 END END AS n_witnesses
FROM r"""


# ------------------------------------------------------------ general
# FIXED VALUES: classification answers that all mean "other" (index = key % 3).
GENERAL_ANSWERS = ["Other", "contract", "unknown document"]


def general_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as general documents. ``g = p_partkey % 7``: 4 -> a number among
    the parties (bad schema), 5 -> ``document_type`` "contract" (renders as
    general), 6 -> the object wrapped in an array (bad schema)."""
    p = spread(read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), ["p_partkey"])
    g = F.col("p_partkey") % 7
    parties = F.when(g == 4, F.concat(F.lit("["), _q(F.col("p_brand")), F.lit(", 5]"))) \
        .otherwise(F.concat(F.lit("["), _q(F.col("p_brand")), F.lit("]")))
    body = F.concat(
        F.lit('{"document_type": '), _q(F.when(g == 5, F.lit("contract")).otherwise(F.lit("other"))),
        F.lit(', "title": '), _q(F.col("p_name")), F.lit(', "date": null, "parties": '), parties,
        F.lit(', "amounts": ['), dec2("p_retailprice"), F.lit(", "), F.col("p_size").cast("string"),
        F.lit('], "key_information": {"brand": '), _q(F.col("p_brand")), F.lit(', "type": '), _q(F.col("p_type")),
        F.lit("}}"))
    response = F.when(g == 6, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return p.select(F.col("p_partkey").alias("doc_id"), "p_partkey",
                    _pick(F.col("p_partkey"), GENERAL_ANSWERS).alias("class_response"), response.alias("response"))


def general_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 + F11 (dict field) + G6."""
    pages = classified_pages(general_answers(spark, sf_dir))
    return pages.select("p_partkey", "parse_status", "markdown",
                        F.try_variant_get("general.key_information", "$.brand", "string").alias("brand"))


def general_pages_sql() -> str:
    return f"""
WITH b AS (
  SELECT *, p_partkey % 7 AS g,
    '{{"document_type": "' || CASE WHEN p_partkey % 7 = 5 THEN 'contract' ELSE 'other' END || '", "title": "' || p_name
    || '", "date": null, "parties": ' || CASE WHEN p_partkey % 7 = 4 THEN '["' || p_brand || '", 5]' ELSE '["' || p_brand || '"]' END
    || ', "amounts": [' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) || ', ' || CAST(p_size AS VARCHAR)
    || '], "key_information": {{"brand": "' || p_brand || '", "type": "' || p_type || '"}}}}' AS body
  FROM part
)
SELECT p_partkey,
  CASE WHEN g IN (4, 6) THEN 'bad_schema' ELSE 'ok' END AS parse_status,
  CASE WHEN g = 6 THEN '[' || body || ']' WHEN g = 4 THEN body ELSE
    '# Document' || {NL} || {NL} || '**Title:** ' || {_or_na('p_name')} || {NL} || '**Date:** N/A' || {NL} || {NL}
    || '**Parties:** ' || p_brand || {NL}
    || '**Amounts:** $' || printf('%.2f', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE)) || ', $'
    || printf('%.2f', CAST(p_size AS DOUBLE)) || {NL}
  END AS markdown,
  CASE WHEN g IN (4, 6) THEN NULL ELSE p_brand END AS brand
FROM b"""


# --------------------------------------------------------------------- I1
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice pages by classified type and outcome."""
    from pagelane.plans import responders
    pages = with_page_status(parsed_pages(responders.invoice_answers(spark, sf_dir)))
    return pages.groupBy("document_type", "page_status").agg(F.count(F.lit(1)).alias("pages"))


def page_outcomes_sql() -> str:
    from pagelane.plans.responders import INVOICE_CLASS_ANSWERS
    return f"""
WITH b AS (
  SELECT o_orderkey % 10 AS r,
         CASE WHEN lower(trim({_pick_sql('o_orderkey', INVOICE_CLASS_ANSWERS)}, ' ' || chr(9) || chr(10)))
              IN ('invoice', 'receipt', 'bill') THEN 'invoice' ELSE 'other' END AS document_type
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)
SELECT document_type,
  CASE WHEN r = 6 THEN 'bad_json'
       WHEN document_type = 'other' THEN CASE WHEN r = 9 THEN 'ok' ELSE 'type_mismatch' END
       WHEN r = 8 THEN 'bad_schema' WHEN r = 9 THEN 'type_mismatch' ELSE 'ok' END AS page_status,
  count(*) AS pages
FROM b GROUP BY ALL"""


# --------------------------------------------------------------------- A7
def invoice_records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid invoice record as JSON text (nulls kept, declared order)."""
    from pagelane.operators.records import record_json
    from pagelane.plans import responders
    pages = parsed_pages(responders.invoice_answers(spark, sf_dir))
    return (pages.filter(F.col("invoice").isNotNull())
            .select("o_orderkey", record_json("invoice").alias("record_json")))


def invoice_records_json_sql() -> str:
    from pagelane.plans.responders import INVOICE_CLASS_ANSWERS
    return f"""
WITH b AS (
  SELECT o.o_orderkey, o.o_totalprice, o.o_orderdate, o.o_orderstatus, o.o_orderpriority, c.c_name, c.c_mktsegment,
         o.o_orderkey % 10 AS r,
         lower(trim({_pick_sql('o.o_orderkey', INVOICE_CLASS_ANSWERS)}, ' ' || chr(9) || chr(10))) IN ('invoice', 'receipt', 'bill') AS is_invoice
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)
SELECT o_orderkey,
  '{{"document_type":"' || CASE WHEN r = 9 THEN 'receipt' ELSE 'invoice' END
  || '","invoice_number":"INV-' || CAST(o_orderkey AS VARCHAR)
  || '","invoice_date":"' || strftime(o_orderdate, '%Y-%m-%d')
  || '","due_date":null,"vendor_name":"' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE c_mktsegment END
  || '","customer_name":"' || c_name
  || '","total_amount":' || CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS VARCHAR)
  || ',"tax_amount":null,"subtotal":null,"items":["' || o_orderpriority
  || '"],"vendor_address":null,"customer_address":null}}' AS record_json
FROM b WHERE is_invoice AND r NOT IN (6, 8)"""


# -------------------------------------------------------------------- F13
def record_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """insurance forms, accident claims and general documents as one relation."""
    claims = claim_answers(spark, sf_dir).select(F.lit("claim").alias("source"), F.col("o_orderkey").alias("key"), "class_response", "response")
    general = general_answers(spark, sf_dir).select(F.lit("general").alias("source"), F.col("p_partkey").alias("key"), "class_response", "response")
    pages = parsed_pages(claims.unionByName(general))
    return union_records(pages, ["source", "key"]).select("source", "key", "schema_type", "document_type", "claim_number", "policy_number",
                                                          "insured_name", "claimant_name", "claim_amount", "damage_amount", "title", "address")


def record_union_sql() -> str:
    return """
WITH c AS (
  SELECT o.*, c.c_name, n.n_name, o_orderkey % 11 AS m, o_orderpriority IN ('1-URGENT', '2-HIGH') AS ins,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amt
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
)
SELECT 'claim' AS source, o_orderkey AS key, CASE WHEN ins THEN 'insurance_form' ELSE 'accident_claim' END AS schema_type,
       CASE WHEN ins THEN 'insurance_form' ELSE 'accident_claim' END AS document_type,
       CASE WHEN ins THEN 'CLM-' ELSE 'ACC-' END || o_orderkey AS claim_number, CASE WHEN ins THEN 'POL-' || o_custkey END AS policy_number,
       CASE WHEN ins THEN c_name END AS insured_name, CASE WHEN NOT ins THEN c_name END AS claimant_name,
       CASE WHEN ins THEN amt END AS claim_amount, CASE WHEN NOT ins THEN CASE WHEN m = 7 THEN 1.0 ELSE amt END END AS damage_amount,
       NULL AS title, CASE WHEN ins THEN n_name END AS address
FROM c WHERE NOT (ins AND m = 3) AND NOT (NOT ins AND m = 5)
UNION ALL
SELECT 'general', p_partkey, 'other', CASE WHEN p_partkey % 7 = 5 THEN 'contract' ELSE 'other' END, NULL, NULL, NULL, NULL, NULL, NULL, p_name, NULL
FROM part WHERE p_partkey % 7 NOT IN (4, 6)"""


# --------------------------------------------------------------------- G9
def record_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements and invoices as indented JSON and as ``field=value`` text."""
    from pagelane.plans import responders
    pages = parsed_pages(responders.invoice_answers(spark, sf_dir)).filter((F.col("document_type") == "invoice") & (F.col("parse_status") == "ok"))
    both = format_output(format_output(pages, "json", out_col="as_json"), "text", out_col="as_text")
    return both.select("o_orderkey", "as_json", "as_text")


def record_formats_sql() -> str:
    from pagelane.plans.responders import INVOICE_CLASS_ANSWERS
    return f"""
WITH b AS (
  SELECT o.o_orderkey, o.o_orderpriority AS pr, c.c_name, CASE WHEN o.o_orderstatus = 'P' THEN '' ELSE c.c_mktsegment END AS vendor,
         strftime(o.o_orderdate, '%Y-%m-%d') AS d, o.o_orderkey % 10 AS r,
         CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS VARCHAR) AS amt,
         CASE WHEN o.o_orderkey % 10 = 9 THEN 'receipt' ELSE 'invoice' END AS t,
         lower(trim({_pick_sql('o.o_orderkey', INVOICE_CLASS_ANSWERS)}, ' ' || chr(9) || chr(10))) IN ('invoice', 'receipt', 'bill') AS is_invoice
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)
SELECT o_orderkey,
  replace('{{|  "document_type": "' || t || '",|  "invoice_number": "INV-' || o_orderkey || '",|  "invoice_date": "' || d
  || '",|  "due_date": null,|  "vendor_name": "' || vendor || '",|  "customer_name": "' || c_name || '",|  "total_amount": ' || amt
  || ',|  "tax_amount": null,|  "subtotal": null,|  "items": [|    "' || pr || '"|  ],|  "vendor_address": null,|  "customer_address": null|}}', '|', {NL}) AS as_json,
  replace('document_type=<DocumentType.' || upper(t) || ': ~' || t || '~> invoice_number=~INV-' || o_orderkey || '~ invoice_date=~' || d
  || '~ due_date=None vendor_name=~' || vendor || '~ customer_name=~' || c_name || '~ total_amount=' || amt
  || ' tax_amount=None subtotal=None items=[~' || pr || '~] vendor_address=None customer_address=None', '~', chr(39)) AS as_text
FROM b WHERE is_invoice AND r NOT IN (6, 8)"""


QUERIES = {
    "record_union": (record_union, record_union_sql),
    "record_formats": (record_formats, record_formats_sql),
    "invoice_records_json": (invoice_records_json, invoice_records_json_sql),
    "statement_pages": (statement_pages, statement_pages_sql),
    "statement_transactions": (statement_transactions, statement_transactions_sql),
    "claim_pages": (claim_pages, claim_pages_sql),
    "general_pages": (general_pages, general_pages_sql),
    "page_outcomes": (page_outcomes, page_outcomes_sql),
}
