"""H3/H4 on real files: admitted documents -> rendered pages -> model
(classification + extraction) -> parse/validate/render -> assembled
markdown, one output per document, plus one result row per input.

The renderer (PDF -> page images) and the model provider are supplied by
the caller; everything between them is the table operators of this
library. Rendering and both model calls are one Python stage whose text
rows are written to the shared folder, so nothing after it calls the model
again and no image leaves its task.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelane.functions.text import output_name
from pagelane.operators.admission import quarantine
from pagelane.operators.answer_store import AnswerStore, answer_document_ranges
from pagelane.operators.assemble import assemble_documents, status_message
from pagelane.operators.provider import CONCURRENCY, answer_documents, answer_ranges, provider_options
from pagelane.operators.ranges import PAGES_PER_RANGE, count_document_pages, deal_ranges, plan_ranges, whole_documents
from pagelane.operators.records import parse_responses
from pagelane.operators.routing import choose_output
from pagelane.session import stage_table


def process_documents(admitted: DataFrame, renderer, model_factory, custom_prompt: str | None = None,
                      call_structured: bool = True, manager_structured: bool = True, classification: bool = True,
                      partitions: int | None = None, pass_options: bool = False, concurrency: int = CONCURRENCY,
                      counter=None, pages_per_range: int = PAGES_PER_RANGE, store: AnswerStore | None = None, run: str | None = None):
    """Return ``(results, documents)``.

    ``admitted``: ``binaryFile`` rows with ``is_valid`` and ``reason`` (see
    ``operators.admission``). ``results`` has one row per input, rejects
    included: ``(path, is_valid, reason, n_pages, n_failed_pages, error,
    status)`` with the status line H7 and, if a page or the rendering failed,
    the first error. ``documents`` has ``(path, output_name, n_pages,
    markdown)`` only for documents with pages (no output otherwise, H3).

    ``classification`` and ``manager_structured`` are the manager's flags,
    ``call_structured`` the call's (see ``routing.page_prompts``). With
    ``pass_options`` the factory is called as
    ``model_factory(system_instruction=..., generation=...)``.

    With ``counter(bytes) -> int`` documents are planned as page ranges
    (``operators.ranges``): ``renderer(bytes, first, end)`` is called per range,
    files are read in the tasks by path, and long documents are spread. With a
    ``store`` (``operators.answer_store``, needs ``counter``) answers outlive the
    run: identical pages are asked once and a re-run makes only missing calls.
    """
    options = provider_options() if pass_options else None
    accepted, _ = quarantine(admitted)
    flags = dict(custom_prompt=custom_prompt, classification=classification, manager_structured=manager_structured,
                 call_structured=call_structured, options=options, concurrency=concurrency)
    if counter is None:
        if store is not None:
            raise ValueError("stored answers need a page counter")
        docs = accepted.select(F.col("path").alias("doc_id"), "content")
        answers = stage_table(answer_documents(docs, renderer, model_factory, partitions=partitions, **flags), "answers")
    else:
        counts = stage_table(count_document_pages(accepted.select(F.col("path").alias("doc_id")), counter), "page-counts")
        ranges = plan_ranges(counts, pages_per_range)
        if store is None:
            found = answer_ranges(deal_ranges(ranges, partitions), renderer, model_factory, **flags)
        else:
            found = answer_document_ranges(ranges, renderer, model_factory, store, run or uuid4().hex, partitions=partitions, **flags)
        answers = stage_table(whole_documents(stage_table(found, "range-answers"), counts), "answers")
    pages = answers.filter("page_no >= 0")
    parsed = parse_responses(pages, "response", "document_type", structured=manager_structured, with_markdown=True)
    page_text = choose_output(F.lit(bool(call_structured)), F.lit(custom_prompt).cast("string"), F.col("markdown"), F.col("response"))
    documents = _named(assemble_documents(parsed.select("doc_id", "page_no", page_text.alias("page_markdown")),
                                          "doc_id", "page_no", "page_markdown"), pages.select("doc_id").distinct())
    return _results(admitted, answers), documents


def numbered_names(documents: DataFrame) -> DataFrame:
    """``(path, output_name)`` for the paths of ``documents``; of inputs that would write one file, all but the first by path get a number.

    Paths are dealt out by ranges of (name, path), so one name in every folder is
    many ranges: rows are numbered inside a range, and a range starts behind the
    rows of the name in the ranges before it (one row a range and name)."""
    wanted = documents.select(F.col("doc_id").alias("path"), output_name(F.col("doc_id")).alias("wanted"))
    ranged = stage_table(wanted.repartitionByRange("wanted", "path").withColumn("part", F.spark_partition_id()), "output-names")
    inside = ranged.withColumn("at", F.row_number().over(Window.partitionBy("wanted", "part").orderBy("path")))
    sizes = ranged.groupBy(F.col("wanted").alias("_wanted"), F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("_wanted").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    number = F.col("before") + F.col("at")
    numbered = F.concat(F.regexp_replace("wanted", r"\.md$", ""), F.lit("-"), number.cast("string"), F.lit(".md"))
    joined = inside.join(offsets, (F.col("wanted") == F.col("_wanted")) & (F.col("part") == F.col("_part")))
    return joined.select("path", F.when(number > 1, numbered).otherwise(F.col("wanted")).alias("output_name"))


def _named(documents: DataFrame, paged: DataFrame) -> DataFrame:
    """Documents with their output names, which come from ``paged`` (doc_id of every document with pages), not from the parsed pages."""
    names = numbered_names(paged).withColumnRenamed("path", "_path")
    return documents.join(names, F.col("doc_id") == F.col("_path")).select(F.col("doc_id").alias("path"), "output_name", "n_pages", "markdown")


def _results(admitted: DataFrame, answers: DataFrame) -> DataFrame:
    page = F.col("page_no") >= 0
    failed = F.col("error").isNotNull()
    counts = answers.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.count(F.when(page, 1)).alias("n"), F.count(F.when(page & failed, 1)).alias("bad"),
        F.min(F.when(failed, F.struct("page_no", "error"))).alias("first"))
    joined = admitted.select("path", "is_valid", "reason").join(counts, F.col("path") == F.col("_doc"), "left")
    n = F.coalesce("n", F.lit(0))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    unrendered = F.when(F.col("first.page_no") < 0, F.col("first.error"))
    status = status_message(F.col("is_valid"), F.col("reason"), n, name, n > 0, unrendered)
    return joined.select("path", "is_valid", "reason", n.alias("n_pages"), F.coalesce("bad", F.lit(0)).alias("n_failed_pages"),
                         F.col("first.error").alias("error"), status.alias("status"))
