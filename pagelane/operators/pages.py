"""Document -> pages.

Pages live as rows ``(doc_id, page_no, ...)``; order is a column, never
partition order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelane.functions import fixed


def page_image_name(page_no) -> Column:
    """``page_0000.png`` style name of a 0-based page number."""
    col = F.col(page_no) if isinstance(page_no, str) else page_no
    return F.format_string(fixed.PAGE_IMAGE_NAME, col)


def explode_text_pages(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
                       page_break: str = "\n") -> DataFrame:
    """D1 for text payloads: one row per page, ``page_no`` from 0."""
    return (docs.select(doc_col, F.posexplode(F.split(F.col(text_col), page_break, -1)).alias("page_no", "page_text"))
            .withColumn("page_name", page_image_name("page_no")))


def explode_rendered_pages(docs: DataFrame, renderer, doc_col: str = "doc_id",
                           content_col: str = "content") -> DataFrame:
    """D1 for binary payloads: ``renderer(bytes) -> list[bytes]`` runs inside
    ``mapInPandas``; a document whose rendering fails yields zero pages (D2)
    and one row in ``page_no = -1`` carrying the error, so it is never lost."""
    import pandas as pd

    def fn(batches):
        for pdf in batches:
            for doc, content in zip(pdf[doc_col], pdf[content_col]):  # one document's images at a time
                try:
                    rows = [(doc, i, img, None) for i, img in enumerate(renderer(content))]
                except Exception as exc:  # one document fails, the batch goes on
                    rows = [(doc, -1, None, f"{type(exc).__name__}: {exc}")]
                yield pd.DataFrame(rows, columns=[doc_col, "page_no", "payload", "error"])

    doc_type = docs.schema[doc_col].dataType.simpleString()
    schema = f"{doc_col} {doc_type}, page_no int, payload binary, error string"
    return docs.select(doc_col, content_col).mapInPandas(fn, schema)


def require_all_pages(pages: DataFrame, doc_col: str = "doc_id", ok_col: str = "ok") -> DataFrame:
    """A document keeps its pages only if every page is ok.

    The verdict is a partial aggregate (skew-safe), joined back as a
    left-semi join that AQE may split on a hot document.
    """
    good = (pages.groupBy(doc_col).agg(F.bool_and(F.coalesce(F.col(ok_col), F.lit(False))).alias("_all_ok"))
            .filter("_all_ok").select(doc_col))
    return pages.join(good, doc_col, "left_semi")


def page_counts(pages: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """D3."""
    return pages.groupBy(doc_col).agg(F.count(F.lit(1)).alias("page_count"))
