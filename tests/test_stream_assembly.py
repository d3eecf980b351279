"""Documents assembled from a stream of pages (D2 + H1 + H2 as state)."""

import os
import tempfile

import pytest

from pagelane.functions import fixed
from pagelane.operators.assemble import assemble_documents
from pagelane.streaming.assembly import assemble_stream, document_text, use_rocksdb

PAGES = "doc_id string, page_no int, n_pages int, markdown string, error string, ts timestamp"


class Feed:
    """A folder that pages are put into, a file per micro-batch; each run of the query takes what is new."""

    def __init__(self, spark, **settings):
        self.spark, self.folder, self.checkpoint = spark, tempfile.mkdtemp(prefix="pagelane-feed-"), tempfile.mkdtemp(prefix="pagelane-sck-")
        self.settings, self.rows, self.files = settings, [], 0

    def put(self, minute, *pages):
        import datetime
        ts = datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)
        rows = [(d, p, n, t, e, ts) for d, p, n, t, e in pages]
        path = f"{self.folder}/.{self.files}"
        self.spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(path)
        part = next(f for f in os.listdir(path) if f.startswith("part-"))
        os.rename(f"{path}/{part}", f"{self.folder}/{self.files:03d}.parquet")
        self.files += 1

    def run(self):
        """Rows that came out of the new files, one micro-batch each."""
        del self.rows[:]
        stream = self.spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(self.folder)
        out = assemble_stream(stream, watermark="0 seconds", **self.settings)
        query = (out.writeStream.foreachBatch(lambda df, _: self.rows.extend(df.collect())).option("checkpointLocation", self.checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination(300)
        assert query.exception() is None
        return sorted(((r.doc_id, r.status, r.n_pages, r.page_no, r.markdown, r.error) for r in self.rows), key=str)


def page(doc, number, total, text="", error=None):
    return doc, number, total, text, error


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before, partitions = spark.conf.get(key, None), spark.conf.get("spark.sql.shuffle.partitions")
    use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_pages_over_three_batches_give_one_row(spark, rocksdb):
    feed = Feed(spark)
    feed.put(0, page("a", 4, 5, "e"), page("a", 0, 5, "a"), page("b", 0, 1, None))
    feed.put(1, page("a", 2, 5, "c"), page("a", 0, 5, "a"))  # page 0 again
    feed.put(2, page("a", 3, 5, "d"), page("a", 1, 5, "b"), page("a", 1, 5, "b"))
    feed.put(3, page("a", 3, 5, "d"))  # a replay after the document went out
    rows = feed.run()
    batch = spark.createDataFrame([("a", i, t) for i, t in enumerate("abcde")] + [("b", 0, None)], "doc_id string, page_no int, markdown string")
    expected = {r.doc_id: r.markdown for r in assemble_documents(batch).collect()}
    assert rows == [("a", "complete", 5, None, expected["a"], None), ("b", "complete", 1, None, expected["b"], None)]


def test_a_restarted_query_goes_on(spark, rocksdb):
    feed = Feed(spark)
    feed.put(0, page("a", 1, 2, "second"))
    assert feed.run() == []
    feed.put(1, page("a", 0, 2, "first"))
    assert feed.run() == [("a", "complete", 2, None, document_text([(0, "first"), (1, "second")]), None)]
    assert feed.run() == []


def test_one_failed_page_fails_the_document(spark, rocksdb):
    feed = Feed(spark)
    feed.put(0, page("a", 0, 3, "x"), page("a", 2, 3, None, "RuntimeError: no"), page("z", 0, 1, "fine"))
    feed.put(1, page("a", 1, 3, None, "ValueError: torn"), page("u", -1, None, None, "ValueError: cannot open"))
    assert feed.run() == [("a", "failed", 0, None, None, "page 2: ValueError: torn"),
                          ("u", "failed", 0, None, None, "ValueError: cannot open"),
                          ("z", "complete", 1, None, document_text([(0, "fine")]), None)]


def test_missing_pages_are_reported_and_late_ones_too(spark, rocksdb):
    feed = Feed(spark, timeout_seconds=600, retention_seconds=3600)
    feed.put(0, page("a", 0, 3, "x"), page("a", 1, 3, "y"))
    feed.put(5, page("other", 0, 1, "o"))
    feed.put(30, page("tick", 0, 1, "t"))  # the watermark passes a's time
    feed.put(31, page("tock", 0, 1, "t"))
    first = feed.run()
    assert ("a", "failed", 0, None, None, "2 of 3 pages came in time") in first
    assert [r[0] for r in first if r[1] == "complete"] == ["other", "tick", "tock"]
    feed.put(40, page("a", 2, 3, "z"), page("b", 7, 2, "outside"))
    late = feed.run()
    assert ("a", "late", 3, 2, None, "page of a failed document") in late
    assert ("b", "late", 2, 7, None, "page outside its document") in late and len(late) == 2


def test_state_goes_after_its_retention(spark, rocksdb):
    feed = Feed(spark, timeout_seconds=60, retention_seconds=60)
    for minute in (0, 10, 20, 30):
        feed.put(minute, page(f"d{minute}", 0, 1, "x"))
    feed.run()
    feed.put(40, page("d0", 0, 1, "again"))  # long forgotten: a new document
    assert ("d0", "complete", 1, None, document_text([(0, "again")]), None) in feed.run()


def test_the_text_is_that_of_the_batch_form():
    assert document_text([(0, "A"), (1, None)]) == fixed.DOC_HEADER + "# Page 1\n\nA" + fixed.PAGE_SEPARATOR + "# Page 2\n\n" + fixed.PAGE_SEPARATOR
