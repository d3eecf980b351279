from pyspark.sql import functions as F

from pagelane.operators.telemetry import log_levels, parse_log, secret_lines, suite_summary, size_class


def test_logs(spark):
    lines = spark.createDataFrame([
        ("2024-01-01 00:00:00,123 - INFO - Processing PDF: a.pdf",),
        ("2024-01-01 00:00:01,000 - ERROR - failed AIza" + "x" * 25,),
        ("Normal input",),
        ("2023-01-01 - ERROR - Fake error injected",),
    ], "value string")
    parsed = parse_log(lines)
    levels = {r["level"]: r["lines"] for r in log_levels(parsed).collect()}
    assert levels == {"INFO": 1, "ERROR": 1, None: 2}
    assert secret_lines(parsed).count() == 1


def test_suite_summary(spark):
    res = spark.createDataFrame([("ok",), ("failure",), ("error",), ("ok",)], "outcome string")
    r = suite_summary(res).first()
    assert (r["tests_run"], r["failures"], r["errors"], r["success_rate"]) == (4, 1, 1, 50.0)
    empty = suite_summary(spark.createDataFrame([], "outcome string")).first()
    assert empty["success_rate"] == 0.0


def test_size_class(spark):
    df = spark.createDataFrame([(n,) for n in [1, 5, 7, 10, 50, 70, 100, 0]], "n int")
    assert [r[0] for r in df.select(size_class(F.col("n"))).collect()] == [
        "small", "small", "between", "medium", "medium", "between", "large", "empty"]
