"""End-to-end document flows built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelane.operators.assemble import assemble_documents
from pagelane.operators.records import parse_responses
from pagelane.operators.routing import normalize_label
from pagelane.plans import responders
from pagelane.session import apply_runtime_conf


def parsed_pages(answers: DataFrame) -> DataFrame:
    """E3 -> F1-F12 on a frame with ``class_response`` and ``response``, no markdown."""
    return parse_responses(answers.withColumn("document_type", normalize_label("class_response")), "response", "document_type")


def classified_pages(answers: DataFrame) -> DataFrame:
    """E3 -> F1-F12 -> G1-G8 on a frame with ``class_response`` and ``response``."""
    labelled = answers.withColumn("document_type", normalize_label("class_response"))
    return parse_responses(labelled, "response", "document_type", with_markdown=True)


def invoice_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: orders become invoice pages, each customer one
    document; answers are parsed, validated, rendered and assembled.
    Result: ``(c_custkey, n_pages, markdown)``."""
    apply_runtime_conf(spark)
    pages = classified_pages(responders.invoice_answers(spark, sf_dir))
    docs = assemble_documents(pages.select("doc_id", "o_orderkey", "markdown"),
                              doc_col="doc_id", order_col="o_orderkey", text_col="markdown")
    return docs.select(F.col("doc_id").alias("c_custkey"), "n_pages", "markdown")
