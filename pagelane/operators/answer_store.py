"""Model answers that outlive a run.

A call takes seconds and costs money, so its answer is stored under a key of what
was asked: the page's content hash (C1), the prompt's hash and the provider's
options. A run first takes an anti join of the keys it needs with the stored ones
and calls the model for the rest only, identical pages once. Calls are made in
batches, each appended to the store when it ends, so a run that dies loses one
batch at most and the next run makes only the calls that are missing. Failed calls
are kept with their error for the run's report, but they are no answers: the next
run makes them again.

The store is a folder of Parquet, one ``batch=<id>`` folder per batch, written with
overwrite, so a replayed batch adds nothing. Of two runs that stored one key, the
answer of the batch with the smaller id counts everywhere.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelane.functions.text import content_hash
from pagelane.session import stage_table
from pagelane.sources.files import folder_exists, read_document

BATCHES = 16
_ROWS = "key string, response string, error string"


def answer_key(page_hash: Column, prompt: Column, options: dict | None = None) -> Column:
    """Key of a call; NULL without a prompt (no call)."""
    settings = json.dumps(options or {}, sort_keys=True)
    return F.when(prompt.isNotNull(), F.sha2(F.concat_ws("|", F.coalesce(page_hash, F.lit("")), F.sha2(prompt, 256), F.lit(settings)), 256))


def payload_hash(payload_col: str = "payload") -> Column:
    """C1 of a page's payload; a missing payload is asked as an empty one."""
    return F.coalesce(content_hash(payload_col), F.sha2(F.lit(""), 256))


class AnswerStore:
    """Answers by key in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def calls(self, run: str | None = None) -> DataFrame:
        """``(key, response, error, batch)`` of all stored calls, or of one run's."""
        if not folder_exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"{_ROWS}, batch string")
        rows = self.spark.read.schema(f"{_ROWS}, batch string").parquet(self.path)
        return rows.filter(F.substring_index("batch", ".", 1) == run) if run else rows

    def answers(self) -> DataFrame:
        """``(key, response)``, one row per answered key."""
        good = self.calls().filter(F.col("error").isNull())
        return good.groupBy("key").agg(F.min(F.struct("batch", "response")).alias("_kept")).select("key", "_kept.response")

    def errors(self, run: str) -> DataFrame:
        """``(key, error)`` of the run's failed calls."""
        return self.calls(run).filter(F.col("error").isNotNull()).groupBy("key").agg(F.min("error").alias("error"))

    def missing(self, keyed: DataFrame) -> DataFrame:
        """Rows of ``keyed`` whose ``key`` has no answer."""
        return keyed.join(self.answers().select("key"), "key", "left_anti")

    def append(self, answered: DataFrame, run: str, batch: int) -> None:
        """Store a batch of ``(key, response, error)`` rows."""
        answered.select("key", "response", "error").write.mode("overwrite").parquet(f"{self.path}/batch={run}.{batch:05d}")


def in_batches(todo: DataFrame, batches: int, by: Column):
    """``todo`` written once, in folders of a batch each, and read batch by batch (others are pruned)."""
    table = _partitioned(todo.withColumn("_batch", F.pmod(F.xxhash64(by), F.lit(int(batches))).cast("int")))
    for number in sorted(r["_batch"] for r in table.select("_batch").distinct().collect()):  # at most ``batches`` numbers
        yield number, table.filter(F.col("_batch") == number).drop("_batch")


def _partitioned(df: DataFrame) -> DataFrame:
    from uuid import uuid4

    from pagelane.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/calls-{uuid4().hex}"
    df.write.partitionBy("_batch").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def answer_requests(requests: DataFrame, store: AnswerStore, call: Callable[[DataFrame], DataFrame], run: str,
                    payload_col: str = "payload", prompt_col: str = "prompt", options: dict | None = None,
                    batches: int = BATCHES) -> DataFrame:
    """``requests`` without the payload, with ``response`` and ``error``: stored answers, and calls for the missing ones.

    ``call`` takes ``(key, payload, prompt)`` rows of one batch and adds
    ``response`` and ``response_error`` (``provider.call_provider`` with the key
    as key column does). ``run`` names this run's batches (letters, digits, -).
    A request without prompt has no call and no response."""
    keyed = requests.withColumn("key", answer_key(payload_hash(payload_col), F.col(prompt_col), options))
    asked = keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.first(payload_col).alias("payload"), F.first(prompt_col).alias("prompt"))
    for number, rows in in_batches(store.missing(asked), batches, F.col("key")):
        answered = call(rows).select("key", F.when(F.col("response_error").isNull(), F.coalesce("response", F.lit(""))).alias("response"),
                                     F.col("response_error").alias("error"))
        store.append(answered, run, number)
    kept = keyed.drop(payload_col).join(store.answers(), "key", "left")
    return kept.join(store.errors(run), "key", "left").drop("key")


def answer_document_ranges(ranges: DataFrame, renderer, factory, store: AnswerStore, run: str, custom_prompt: str | None = None,
                           classification: bool = True, manager_structured: bool = True, call_structured: bool = True,
                           options: dict | None = None, partitions: int | None = None, concurrency: int = 4,
                           doc_col: str = "doc_id", batches: int = BATCHES, fetch: Callable = read_document) -> DataFrame:
    """E2 + E7 over page ranges with stored answers: ``(doc_id, page_no, document_type, response, error)``.

    The first pass renders and hashes pages; images never leave their task. Of
    pages with one hash, that of the smallest (document, page) is asked: ranges
    that hold such pages are rendered again, and the model is called for these
    pages only, for the answers that are not stored. A failed classification
    counts as ``other`` and is asked again by the next run."""
    from pagelane.operators import provider
    from pagelane.operators.ranges import deal_ranges

    keys = provider.PageKeys(custom_prompt, classification, manager_structured, call_structured, options)
    dealt = deal_ranges(ranges, partitions, doc_col)
    hashes = stage_table(provider.hash_ranges(dealt, renderer, doc_col, fetch), "page-hashes")
    pages = hashes.filter("page_no >= 0").drop("error")
    asked = pages.groupBy("page_hash").agg(F.min(F.struct(F.col(doc_col), "page_no", "first_page", "end_page")).alias("at"))
    todo = _unanswered(asked, store, keys).select(f"at.{doc_col}", "at.page_no", "at.first_page", "at.end_page", "page_hash", "class_response")
    for number, rows in in_batches(todo, batches, F.col("page_hash")):
        wanted = rows.groupBy(doc_col, "first_page", "end_page").agg(  # no more pages than a range has
            F.collect_list(F.struct("page_no", "page_hash", "class_response")).alias("wanted"))
        if "_content" in ranges.columns:
            wanted = wanted.join(ranges.select(doc_col, "first_page", "_content"), [doc_col, "first_page"])
        called = provider.answer_wanted_pages(deal_ranges(wanted, partitions, doc_col), renderer, factory, keys, concurrency, doc_col, fetch)
        store.append(called, run, number)
    known = store.answers()
    labelled = _labelled(pages, known, keys)
    answered = (labelled.join(known.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
                .join(store.errors(run), "key", "left"))
    answered = answered.select(doc_col, "page_no", "document_type", F.coalesce("response", F.lit("")).alias("response"), "error")
    failed = hashes.filter("page_no < 0").select(doc_col, "page_no", F.lit(None).cast("string").alias("document_type"),
                                                 F.lit(None).cast("string").alias("response"), "error")
    return answered.unionByName(failed)


def _labelled(pages: DataFrame, known: DataFrame, keys) -> DataFrame:
    """Pages with class_response (stored), document_type and the key of their extraction."""
    with_key = pages.withColumn("class_key", keys.classification(F.col("page_hash")))
    labelled = with_key.join(known.select(F.col("key").alias("class_key"), F.col("response").alias("class_response")), "class_key", "left")
    labelled = labelled.withColumn("document_type", keys.label_of(F.col("class_response")))
    return labelled.withColumn("key", keys.extraction(F.col("page_hash"), F.col("document_type")))


def _unanswered(asked: DataFrame, store: AnswerStore, keys) -> DataFrame:
    """Distinct pages that lack their classification (if one is asked) or their extraction."""
    known = store.answers()
    rows = _labelled(asked, known, keys).join(known.select(F.col("key").alias("_key"), F.lit(True).alias("_known")),
                                              F.col("key") == F.col("_key"), "left")
    return rows.filter(F.col("_known").isNull() | (F.col("class_key").isNotNull() & F.col("class_response").isNull()))
