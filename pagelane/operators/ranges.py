"""Documents -> page ranges -> pages (D1), in two steps.

A counting pass opens every document once and tells its number of pages. Each
document then becomes rows of (document, first page, end page), which are dealt
out by hash, so the pages of one long document are rendered by many tasks; the
renderer is called once per range and no task holds more than its range.

Only keys travel with a range. A task gets the bytes through ``fetch(doc_id)``
(``read_document`` for paths and URIs of any file system) and keeps those of one
document, as its ranges come sorted by document. Contents that are in a table go
with their ranges through a join, if ``contents`` names that table.

A document is all or nothing (D2): one that cannot be counted, or one range of
which fails or gives too few pages, has no page and one row with ``page_no = -1``
and the error (``whole_documents``).
"""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelane.sources.files import read_document

PAGES_PER_RANGE = 32
UNRENDERED = -1  # page number of a row that carries a document's error


def count_document_pages(docs: DataFrame, counter: Callable[[bytes], int], doc_col: str = "doc_id",
                         content_col: str | None = None, fetch: Callable = read_document) -> DataFrame:
    """``(doc_id, n_pages, error)`` of every document: the counting pass.

    Reads ``content_col`` if given, else ``fetch(doc_id)`` in the task."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            contents = pdf[content_col] if content_col else [None] * len(pdf)
            for doc, content in zip(pdf[doc_col], contents):
                try:
                    rows.append((doc, int(counter(content if content_col else fetch(doc))), None))
                except Exception as exc:  # one document fails, the batch goes on
                    rows.append((doc, 0, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=[doc_col, "n_pages", "error"])

    doc_type = docs.schema[doc_col].dataType.simpleString()
    source = docs.select(doc_col, content_col) if content_col else docs.select(doc_col)
    return source.mapInPandas(run, f"{doc_col} {doc_type}, n_pages int, error string")


def plan_ranges(counts: DataFrame, pages_per_range: int = PAGES_PER_RANGE, doc_col: str = "doc_id",
                count_col: str = "n_pages", keep: tuple = ()) -> DataFrame:
    """``(doc_id, n_pages, first_page, end_page)``: the ranges of every document with pages, ``end_page`` excluded; ``keep``: columns that go along."""
    n = F.col(count_col).cast("int")
    starts = F.explode(F.sequence(F.lit(0), n - 1, F.lit(int(pages_per_range)))).alias("first_page")
    return (counts.filter(F.col(count_col) > 0).select(doc_col, *keep, n.alias("n_pages"), starts)
            .withColumn("end_page", F.least(F.col("first_page") + int(pages_per_range), "n_pages")))


def text_ranges(docs: DataFrame, pages_per_range: int = PAGES_PER_RANGE, doc_col: str = "doc_id", text_col: str = "text",
                page_break: str = "\n") -> DataFrame:
    """Ranges of text documents with their own lines only: ``(doc_id, n_pages, first_page, end_page, range_text)``.

    ``deal_ranges`` spreads them and ``range_text_pages`` explodes their pages."""
    split = docs.filter(F.col(text_col).isNotNull()).select(doc_col, F.split(F.col(text_col), page_break, -1).alias("_lines"))
    planned = plan_ranges(split.select(doc_col, "_lines", F.size("_lines").alias("n_pages")), pages_per_range, doc_col, keep=("_lines",))
    text = F.array_join(F.slice("_lines", F.col("first_page") + 1, F.col("end_page") - F.col("first_page")), page_break)
    return planned.select(doc_col, "n_pages", "first_page", "end_page", text.alias("range_text"))


def range_text_pages(ranges: DataFrame, doc_col: str = "doc_id", page_break: str = "\n") -> DataFrame:
    """``(doc_id, page_no, page_text)`` of text ranges."""
    pages = ranges.select(doc_col, "first_page", F.posexplode(F.split("range_text", page_break, -1)).alias("_at", "page_text"))
    return pages.select(doc_col, (F.col("first_page") + F.col("_at")).alias("page_no"), "page_text")


def deal_ranges(ranges: DataFrame, partitions: int | None = None, doc_col: str = "doc_id") -> DataFrame:
    """Ranges spread over tasks by (document, first page), in document order inside a task."""
    dealt = ranges.repartition(int(partitions), doc_col, "first_page") if partitions else ranges.repartition(doc_col, "first_page")
    return dealt.sortWithinPartitions(doc_col, "first_page")


def with_contents(ranges: DataFrame, contents: DataFrame, doc_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """Ranges with their document's bytes, for documents held in a table."""
    table = contents.select(F.col(doc_col).alias("_doc"), F.col(content_col).alias("_content"))
    return ranges.join(table, F.col(doc_col) == F.col("_doc")).drop("_doc")


class RangeReader:
    """Pages of ranges, as a task goes through them; keeps the bytes of one document."""

    def __init__(self, renderer: Callable[[bytes, int, int], Iterable], fetch: Callable = read_document):
        self.renderer, self.fetch, self.doc, self.bytes = renderer, fetch, None, None

    def content(self, doc, given=None):
        if given is not None:
            return given
        if self.bytes is None or self.doc != doc:
            self.bytes = None  # before the next one is read
            self.doc, self.bytes = doc, self.fetch(doc)
        return self.bytes

    def pages(self, doc, first: int, end: int, given=None):
        """``(page number, payload)`` of the range; an error if the renderer gives more or fewer pages."""
        number = first
        for payload in self.renderer(self.content(doc, given), first, end):
            if number >= end:
                raise ValueError(f"more than {end - first} pages from page {first}")
            yield number, payload
            number += 1
        if number < end:
            raise ValueError(f"{number - first} of {end - first} pages from page {first}")


def _range_columns(ranges: DataFrame, doc_col: str) -> tuple[DataFrame, str]:
    columns = [doc_col, "first_page", "end_page", *[c for c in ("_content",) if c in ranges.columns]]
    return ranges.select(*columns), ranges.schema[doc_col].dataType.simpleString()


def range_rows(pdf, doc_col: str):
    """``(doc, first, end, bytes or None)`` of a pandas batch of ranges."""
    given = pdf["_content"] if "_content" in pdf else [None] * len(pdf)
    return zip(pdf[doc_col], map(int, pdf["first_page"]), map(int, pdf["end_page"]), given)


def render_ranges(ranges: DataFrame, renderer: Callable[[bytes, int, int], Iterable], fetch: Callable = read_document,
                  doc_col: str = "doc_id", pages_per_batch: int = 8) -> DataFrame:
    """``(doc_id, page_no, payload, error)``: ``renderer(bytes, first, end)`` gives the pages of a range in order.

    A range that fails keeps the pages before the failure and adds a row with
    ``page_no = -1``; ``whole_documents`` makes that the document's only row."""
    import pandas as pd

    def run(batches):
        reader = RangeReader(renderer, fetch)
        names = [doc_col, "page_no", "payload", "error"]
        for pdf in batches:
            for doc, first, end, given in range_rows(pdf, doc_col):
                rows = []
                try:
                    for number, payload in reader.pages(doc, first, end, given):
                        rows.append((doc, number, payload, None))
                        if len(rows) >= pages_per_batch:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except Exception as exc:  # one range fails, the others go on
                    rows.append((doc, UNRENDERED, None, f"{type(exc).__name__}: {exc}"))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    source, doc_type = _range_columns(ranges, doc_col)
    return source.mapInPandas(run, f"{doc_col} {doc_type}, page_no int, payload binary, error string")


def whole_documents(pages: DataFrame, counts: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                    error_col: str = "error") -> DataFrame:
    """D2 over ranges: pages of documents without a failed range; every other document has one row with its first error.

    ``counts`` gives the documents that could not be opened. The failed documents
    are a partial aggregate; pages meet them in an anti join (AQE may split a hot
    document)."""
    failed = pages.filter(F.col(page_col) == UNRENDERED).select(F.col(doc_col).alias("_doc"), F.col(error_col).alias("_error"))
    unopened = counts.filter(F.col("error").isNotNull()).select(F.col(doc_col).alias("_doc"), F.col("error").alias("_error"))
    failed = failed.unionByName(unopened).groupBy("_doc").agg(F.min("_error").alias("_error"))
    good = pages.join(failed, F.col(doc_col).eqNullSafe(F.col("_doc")), "left_anti")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in pages.schema if f.name not in (doc_col, page_col, error_col)]
    bad = failed.select(F.col("_doc").alias(doc_col), F.lit(UNRENDERED).alias(page_col), F.col("_error").alias(error_col), *rest)
    return good.unionByName(bad.select(*pages.columns))
