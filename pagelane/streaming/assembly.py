"""Documents from a stream of pages.

Pages of a document come in any order and over any number of micro-batches; each
row knows how many pages its document has (D3, from the counting pass). Per
document the state holds its pages by number, so a replayed page counts once, and
how far it is. When the last page is in, one row goes out: the assembled document,
or, if one of its pages failed, the failure (all or nothing). A row with page number -1
and an error fails its document at once. A document that is not whole when the watermark has passed ``timeout`` beyond its newest page is
reported as failed.

A finished document keeps a mark without its pages for ``retention`` more of event
time: replays of its pages are ignored, and pages that come after its failure are
reported as late, one row each. The time column should be the time of arrival (for
instance the source file's modification time): rows behind the watermark never
reach the state, Spark drops and counts them.

State is in RocksDB (``use_rocksdb``), partitioned by document; a page map entry is
read once, when the document goes out.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pagelane.functions import fixed
from pagelane.operators.ranges import UNRENDERED
from pagelane.session import ensure_checkpoint_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN, COMPLETE, FAILED = "open", "complete", "failed"
LATE = "late"
_OUTPUT = "status string, n_pages long, page_no int, markdown string, error string"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed map state and timers need."""
    spark.conf.set(_PROVIDER, ROCKSDB)


def document_text(pages: list[tuple[int, str]]) -> str:
    """H2 of pages in order, as ``assemble.render_document`` writes it."""
    blocks = [f"# Page {at}\n\n{text or ''}{fixed.PAGE_SEPARATOR}" for at, (_, text) in enumerate(pages, 1)]
    return fixed.DOC_HEADER + "".join(blocks)


class DocumentAssembler(StatefulProcessor):
    def __init__(self, doc_col: str, timeout_ms: int, retention_ms: int):
        self.doc_col, self.timeout_ms, self.retention_ms = doc_col, timeout_ms, retention_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_no int", "text string, error string")
        self.progress = handle.getValueState("progress", "status string, n_pages int, seen int, timer long")

    def handleInputRows(self, key, rows, timerValues):
        status, n_pages, seen, timer = self.progress.get() if self.progress.exists() else (OPEN, None, 0, None)
        newest = None
        for row in rows:
            if row.ts_ms is not None:
                newest = max(newest or row.ts_ms, row.ts_ms)
            if n_pages is None and row.n_pages is not None:
                n_pages = row.n_pages
            if status == OPEN and row.page_no == UNRENDERED and row.error is not None:  # the whole document failed
                status = FAILED
                self.pages.clear()
                yield self._row(key, FAILED, 0, None, None, row.error)
                continue
            outside = row.page_no is None or row.page_no < 0 or (n_pages is not None and row.page_no >= n_pages)
            if status == COMPLETE or (status == OPEN and (outside or self.pages.containsKey((row.page_no,)))):
                if outside:
                    yield self._row(key, LATE, n_pages, row.page_no, None, "page outside its document")
                continue  # a replay
            if status == FAILED:
                yield self._row(key, LATE, n_pages, row.page_no, None, "page of a failed document")
                continue
            self.pages.updateValue((row.page_no,), (row.text, row.error))
            seen += 1
        if status == OPEN and n_pages is not None and seen >= n_pages:
            status, found = self._whole(n_pages)
            yield self._row(key, status, n_pages if status == COMPLETE else 0, None, *found)
            self.pages.clear()
        timer = self._later(timer, status, newest, timerValues)
        self.progress.update((status, n_pages, seen, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.progress.exists():
            return
        status, n_pages, seen, timer = self.progress.get()
        if status == OPEN:
            yield self._row(key, FAILED, 0, None, None, f"{seen} of {'?' if n_pages is None else n_pages} pages came in time")
            self.pages.clear()
            until = expiredTimerInfo.getExpiryTimeInMs() + self.retention_ms
            self.handle.registerTimer(until)
            self.progress.update((FAILED, n_pages, seen, until))
        else:  # nobody asks for it any more
            self.progress.clear()

    def close(self) -> None:
        pass

    def _whole(self, n_pages: int):
        """Status and ``(markdown, error)`` of a document with all its pages."""
        pages = sorted((number[0], text, error) for number, (text, error) in self.pages.iterator())
        bad = next(((number, error) for number, _, error in pages if error is not None), None)
        if bad:
            return FAILED, (None, f"page {bad[0] + 1}: {bad[1]}")
        return COMPLETE, (document_text([(number, text) for number, text, _ in pages]), None)

    def _later(self, timer, status, newest, timer_values):
        """Move the document's one timer behind its newest page."""
        base = newest if newest is not None else timer_values.getCurrentWatermarkInMs()
        wanted = max(timer or 0, base + (self.timeout_ms if status == OPEN else self.retention_ms))
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        return wanted

    def _row(self, key, status, n_pages, page_no, markdown, error) -> Row:
        return Row(**{self.doc_col: key[0], "status": status, "n_pages": n_pages, "page_no": page_no, "markdown": markdown, "error": error})


def assemble_stream(pages: DataFrame, ts_col: str = "ts", doc_col: str = "doc_id", page_col: str = "page_no", count_col: str = "n_pages",
                    text_col: str = "markdown", error_col: str = "error", watermark: str = "10 minutes", timeout_seconds: int = 3600,
                    retention_seconds: int = 86400) -> DataFrame:
    """Stream of ``(doc_id, status, n_pages, page_no, markdown, error)``.

    ``status``: ``complete`` (one row per document, with its markdown), ``failed``
    (one row, with the first failed page's error or the number of pages that came)
    or ``late`` (a row per page). Rows without a document are ignored."""
    doc_type = pages.schema[doc_col].dataType.simpleString()
    timed = pages.filter(F.col(doc_col).isNotNull()).withColumn("_at", F.col(ts_col).cast("timestamp")).withWatermark("_at", watermark)
    rows = timed.select(doc_col, "_at", F.unix_millis("_at").alias("ts_ms"), F.col(page_col).cast("int").alias("page_no"),
                        F.col(count_col).cast("int").alias("n_pages"), F.col(text_col).alias("text"), F.col(error_col).alias("error"))
    assembler = DocumentAssembler(doc_col, timeout_seconds * 1000, retention_seconds * 1000)
    return rows.groupBy(doc_col).transformWithState(assembler, f"{doc_col} {doc_type}, {_OUTPUT}", "append", "EventTime")


def run_assembly(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Take all that has arrived, write the rows as Parquet and read them back; the next run goes on from the checkpoint.

    Without paths a new folder of the shared checkpoint folder is used. The session's
    state store is RocksDB while the query runs."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/assembled-{uuid4().hex}"
    path, checkpoint = path or f"{base}/rows", checkpoint or f"{base}/checkpoint"
    before = spark.conf.get(_PROVIDER, None)
    use_rocksdb(spark)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(path)
