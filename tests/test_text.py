"""Text hygiene, names, hash and money."""

import pytest
from pyspark.sql import functions as F

from pagelane.functions import text as T
from pagelane.operators.routing import normalize_label


def one(spark, col, value, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("name,expected", [("a b$é.pdf", "abé.pdf"), ("A.PDF", "A.PDF.pdf"), ("report", "report.pdf")])
def test_sanitize_name(spark, name, expected):
    assert one(spark, T.sanitize_name, name) == expected


@pytest.mark.parametrize("value,n,expected", [
    ("Hello\x00World", 1000, "HelloWorld"), ("Normal\tTab", 1000, "NormalTab"), ("Line\nBreak", 1000, "LineBreak"),
    ("café", 1000, "caf"), ("🚀 rocket", 1000, " rocket"), ("naïve", 1000, "nave"),
    ("a" * 1001, 1000, "a" * 1000), ("abcdefgh", 5, "abcde"), ("abc", 0, ""), (None, 1000, None), ("é1234", 3, "12"),
    ("test", -1, ""),
])
def test_sanitize_text(spark, value, n, expected):
    assert one(spark, lambda c: T.sanitize_text(c, n), value) == expected


@pytest.mark.parametrize("name,expected", [("a.b.pdf", "a.b.md"), ("out", "out.md"), (".pdf", ".pdf.md"),
                                           ("x.pdf.pdf", "x.pdf.md")])
def test_output_name(spark, name, expected):
    assert one(spark, T.output_name, name) == expected


def test_requested_output_name(spark):
    df = spark.createDataFrame([("a.pdf", "out"), ("a.pdf", "out.md"), ("a.pdf", None)], "n string, r string")
    got = [r[0] for r in df.select(T.output_name(F.col("n"), F.col("r"))).collect()]
    assert got == ["out.md", "out.md", "a.md"]


@pytest.mark.parametrize("path,expected", [("/safe/x", True), ("/safe/../r/x", False), ("/safe2/x", False),
                                           ("/safe", True), ("/safe/./a/../b", True)])
def test_path_contained(spark, path, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(T.path_contained(F.col("p"), F.lit("/safe"))).first()[0] is expected


@pytest.mark.parametrize("name,bad", [("../malicious", True), ("/absolute/path", True), ("", True),
                                      ("folder/with/slash", True), ("Data", False)])
def test_unsafe_folder(spark, name, bad):
    assert one(spark, T.unsafe_folder, name) is bad


def test_hash_golden(spark):
    assert one(spark, T.content_hash, "hello world") == \
        "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert one(spark, T.content_hash, "") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert one(spark, T.content_hash, bytearray(b"hello world"), "binary") == \
        "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"


def test_strip_matches_python(spark):
    every_space = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    vals = [every_space + "x y" + every_space, "", "   ", "a​b"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    assert [r[0] for r in df.select(T.py_strip("t")).collect()] == [v.strip() for v in vals]
    assert [r[0] for r in df.select(T.normalize_prompt("t")).collect()] == [v.strip() or None for v in vals]


def test_money(spark):
    vals = [0.125, 2.675, 1.005, -150.0, 0.0, -0.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(T.money("x")).collect()]
    assert got == ["$0.12", "$2.67", "$1.00", "$-150.00", "$0.00", "$0.00", "$0.00", "$nan"]


@pytest.mark.parametrize("answer,label", [
    ("bank_statement", "bank_statement"), ("Bank Statement", "bank_statement"), (" statement\n", "bank_statement"),
    ("insurance form", "insurance_form"), ("insurance", "insurance_form"), ("accident claim", "accident_claim"),
    ("claim", "accident_claim"), ("invoice", "invoice"), ("receipt", "invoice"), ("bill", "invoice"),
    ("contract", "other"), ("unknown document", "other"), ("it is an invoice", "other"), ("", "other"), (None, "other"),
])
def test_labels(spark, answer, label):
    assert one(spark, normalize_label, answer) == label


def test_extractors(spark):
    text = "Mail x.19@mail5.example.com or call +1 (771) 555-1655; paid $1,250.50 and $3 on 2024-01-31 or 1/2/2024."
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(T.extract_emails("t").alias("e"), T.extract_phones("t").alias("p"),
                  T.extract_amounts("t").alias("a"), T.extract_dates("t").alias("d")).first()
    assert r["e"] == ["x.19@mail5.example.com"]
    assert r["p"] == ["+1 (771) 555-1655"]
    assert r["a"] == [1250.5, 3.0]
    assert r["d"] == ["2024-01-31", "1/2/2024"]


def test_prompt_lengths_and_run_id(spark):
    from pagelane.functions import fixed
    from pagelane.operators.routing import prompt_lengths, run_id, schema_catalog
    got = {r["document_type"]: r["prompt_chars"] for r in prompt_lengths(spark).collect()}
    assert got["invoice"] == len(fixed.INVOICE_PROMPT)
    assert got["receipt"] == got["contract"] == len(fixed.GENERAL_DOCUMENT_PROMPT)
    assert len(got) == 7
    rid = spark.range(1).select(run_id().alias("r")).first()["r"]
    assert len(rid) == 8 and int(rid, 16) >= 0
    cat = schema_catalog(spark)
    assert cat.filter("schema_type = 'invoice'").count() == 12
