"""Pages -> documents, batch results and status (H1-H7).

Assembly has one exchange, on the document; ordering always comes from ``array_sort`` over ``(page_no, text)`` structs, never
from ``collect_list`` arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelane.functions import fixed


def page_block(page_no: Column, text: Column) -> Column:
    """H2 block of one page: heading with 1-based number, text, separator."""
    return F.concat(F.lit("# Page "), (page_no + 1).cast("string"), F.lit("\n\n"),
                    F.coalesce(text, F.lit("")), F.lit(fixed.PAGE_SEPARATOR))


def ordered_page_texts(pages: DataFrame, doc_col: str = "doc_id", order_col: str = "page_no",
                       text_col: str = "markdown") -> DataFrame:
    """H1: ``(doc_id, pages ARRAY<STRING>)`` in ``order_col`` order: one
    exchange on the document, one row per document. For documents that no row
    can hold, see ``document_parts``."""
    page = F.struct(F.col(order_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return (pages.groupBy(doc_col).agg(F.array_sort(F.collect_list(page)).alias("_sorted"))
            .select(doc_col, F.transform("_sorted", lambda s: s["t"]).alias("pages")))


def document_parts(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                   text_col: str = "markdown", pages_per_part: int = 1000) -> DataFrame:
    """H2 in parts: ``(doc_id, part_no, markdown)``, a row per run of page
    numbers. Parts in order are the document's text; a document of any size
    is spread over tasks and never becomes one row."""
    part = F.floor(F.col(page_col) / F.lit(pages_per_part)).cast("long")
    page = F.struct(F.col(page_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    grouped = pages.groupBy(F.col(doc_col), part.alias("part_no")).agg(F.array_sort(F.collect_list(page)).alias("_sorted"))
    text = F.array_join(F.transform("_sorted", lambda s: page_block(s["k"], s["t"])), "")
    header = F.when(F.col("part_no") == 0, F.lit(fixed.DOC_HEADER)).otherwise(F.lit(""))
    return grouped.select(doc_col, "part_no", F.concat(header, text).alias("markdown"))


def render_document(texts: Column) -> Column:
    """H2: header, then per page ``# Page k``, text and separator (also after
    the last page); empty pages are kept."""
    blocks = F.transform(texts, lambda t, i: page_block(i, t))
    return F.concat(F.lit(fixed.DOC_HEADER), F.array_join(blocks, ""))


def assemble_documents(pages: DataFrame, doc_col: str = "doc_id", order_col: str = "page_no",
                       text_col: str = "markdown") -> DataFrame:
    """H1 + H2: ``(doc_id, n_pages, markdown)``, one row per document with
    pages. Heading numbers are positions in ``order_col`` order, so any
    numeric ordering key works (page numbers, order keys, turns)."""
    ordered = ordered_page_texts(pages, doc_col, order_col, text_col)
    return ordered.select(doc_col, F.size("pages").cast("long").alias("n_pages"),
                          render_document(F.col("pages")).alias("markdown"))


def batch_results(inputs: DataFrame, pages: DataFrame, doc_col: str = "doc_id",
                  page_col: str = "page_no", text_col: str = "markdown") -> DataFrame:
    """H4: every input document gets a row; documents without pages get
    an empty array (the batch goes on)."""
    ordered = ordered_page_texts(pages, doc_col, page_col, text_col)
    return (inputs.select(doc_col).join(ordered, doc_col, "left")
            .withColumn("pages", F.coalesce(F.col("pages"), F.array().cast("array<string>"))))


def page_totals(pages: DataFrame, doc_col: str = "doc_id", ok_col: str = "ok") -> DataFrame:
    """D2 + D3 + H4 counts in one pass: ``(doc_id, n_pages)`` for every
    document with rows; 0 if one of its pages failed."""
    whole = F.bool_and(F.coalesce(F.col(ok_col), F.lit(False)))
    return pages.groupBy(doc_col).agg(F.when(whole, F.count(F.lit(1))).otherwise(F.lit(0)).cast("long").alias("n_pages"))


def batch_summary(results: DataFrame, doc_col: str = "doc_id", count: Column | None = None) -> DataFrame:
    """H5: per-document line plus a total row (``doc_id`` NULL) via rollup.
    ``count`` is the number of pages (default: the size of ``pages``)."""
    per_doc = results.select(doc_col, (F.size("pages") if count is None else count).alias("_n"))
    return (per_doc.rollup(doc_col)
            .agg(F.sum("_n").cast("long").alias("pages"),
                 F.count(F.lit(1)).alias("documents"),
                 F.sum(F.when(F.col("_n") == 0, 1).otherwise(0)).cast("long").alias("failed"),
                 F.grouping_id().alias("_total"))
            .withColumn("summary",
                        F.when(F.col("_total") > 0,
                               F.format_string("%d documents, %d pages, %d failed",
                                               F.col("documents"), F.col("pages"), F.col("failed")))
                        .when(F.col("pages") == 0, F.lit(fixed.BATCH_FAILED))
                        .otherwise(F.format_string("%d pages extracted", F.col("pages"))))
            .drop("_total"))


def first_document(inputs: DataFrame, name_col: str = "name") -> DataFrame:
    """H6: the first input by name (deterministic form of "first listed")."""
    return inputs.orderBy(F.col(name_col).asc_nulls_last()).limit(1)


def status_message(valid: Column, reason: Column, n_pages: Column, name: Column,
                   has_output: Column, error: Column | None = None) -> Column:
    """H7: the user-facing status line of one upload."""
    ok_text = F.concat(F.lit("✅ Successfully processed "), n_pages.cast("string"),
                       F.lit(" pages from "), name)
    out = (F.when(~valid, F.concat(F.lit(fixed.STATUS_REJECTED_PREFIX), reason))
           .when(F.coalesce(n_pages, F.lit(0)) == 0, F.lit(fixed.STATUS_NO_PAGES))
           .when(~has_output, F.lit(fixed.STATUS_NO_OUTPUT))
           .otherwise(ok_text))
    if error is not None:
        out = F.when(valid & error.isNotNull(), F.concat(F.lit(fixed.STATUS_ERROR), error)).otherwise(out)
    return out
