"""Bare number words in answers (F3): what ``json.loads`` takes is taken."""

import json

from pyspark.sql import functions as F

from pagelane.operators.records import BARE, bare_words, is_whole_json, parse_responses

TEXTS = ['NaN', 'Infinity', '-Infinity', '+Infinity', '-NaN', 'nan', 'infinity', 'NaN5', 'Infinity1', '1NaN', '[NaN]', '[NaN,Infinity, -Infinity]', '{"a": NaN}',
         '{"a":-Infinity}', '{"a": - Infinity}', '{"NaN": 1}', '{NaN: 1}', '{"a": "NaN"}', '{"a": "x NaN y", "b": NaN}', r'{"a": "quote \" NaN", "b": Infinity}',
         r'{"a": "slash \\", "b": NaN}', r'{"a": "slash \\\" NaN", "b": 2}', '{"a": NaN', '{"a": NaN} x', '{"a": "NaN}', '{"a": [1, {"b": -Infinity}]}', 'NaNNaN',
         '[NaN NaN]', '{"a": Infinity, "a": 1}', '  NaN\n', '{"a": "\\u004eaN"}', '[1.5, -2, true, null]', '[.NaN]', '["a",NaN,"b"]', '""NaN', '{"a": "' + 'x' * 20000 + r'\n' * 8000 + '", "b": NaN}']


def accepted(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def test_acceptance_is_that_of_json_loads(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", is_whole_json(bare_words(F.col("t"))).alias("ok")).collect()
    got = {r.i: r.ok for r in rows}
    assert {TEXTS[i][:80]: ok for i, ok in got.items()} == {t[:80]: accepted(t) for t in TEXTS}
    assert len(TEXTS) >= 30 and 10 < sum(map(accepted, TEXTS)) < len(TEXTS) - 10


def test_texts_without_the_words_stay(spark):
    texts = ['{"a": "b"}', 'plain', '', '"NaN"', '["x", "Infinity is \\" NaN"]']
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(bare_words(F.col("t"))).collect()] == texts


def test_records_hold_the_numbers(spark):
    answers = [("invoice", '{"invoice_number": "A NaN", "total_amount": NaN, "tax_amount": -Infinity, "subtotal": "nan"}'),
               ("invoice", '{"invoice_number": NaN}'), ("invoice", '{"items": ["a", Infinity]}'), ("accident_claim", '{"damage_amount": Infinity}'),
               ("other", '{"title": "t", "key_information": {"x": NaN}}')]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(answers)], "i int, document_type string, response string")
    rows = {r.i: r for r in parse_responses(df, with_markdown=True).orderBy("i").collect()}
    assert [rows[i].parse_status for i in range(5)] == ["ok", "bad_schema", "bad_schema", "ok", "ok"]
    invoice = rows[0].invoice
    assert str(invoice.total_amount) == "nan" and invoice.tax_amount == float("-inf") and str(invoice.subtotal) == "nan"
    assert invoice.invoice_number == "A NaN" and "**Total Amount:** $nan" in rows[0].markdown
    assert all(BARE not in (r.markdown or "") for r in rows.values() if r.i != 4)
