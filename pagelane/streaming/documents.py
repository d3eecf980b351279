"""Incremental forms (A9, J8): new PDFs as a stream, load windows as a
watermarked streaming aggregate.

A document is complete only when all its pages are, so streamed files are
admitted whole and each micro-batch is processed by the batch operators
inside ``foreachBatch``: no unbounded state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelane.operators.admission import admit
from pagelane.operators.telemetry import load_windows
from pagelane.sources.files import BINARY_FILE_SCHEMA


def stream_documents(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """``*.pdf`` files arriving in ``folder``, admitted (B1-B5). The file
    source checkpoint records which files were seen."""
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("pathGlobFilter", "*.pdf"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return admit(reader.load(folder))


def process_stream(stream: DataFrame, handle_batch, checkpoint: str, trigger_once: bool = True):
    """Run ``handle_batch(batch_df, epoch_id)`` for each micro-batch (e.g.
    pages -> model -> parse -> assemble -> write). A batch may be replayed
    after a failure, so the handler's sinks must overwrite."""
    writer = stream.writeStream.foreachBatch(handle_batch).option("checkpointLocation", checkpoint)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def streaming_load_windows(events: DataFrame, ts_col: str = "ts", value_col: str = "value",
                           width: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """J8 on a stream: the batch aggregate after a watermark (append mode
    emits each window once it is closed). ``TIMESTAMP_NTZ`` is cast to
    ``TIMESTAMP`` because watermarks need the latter."""
    ts = F.col(ts_col).cast("timestamp")
    prepared = events.withColumn(ts_col, ts).withWatermark(ts_col, watermark)
    return load_windows(prepared, ts_col, value_col, F.col("event_type") == "error", width)


def streaming_run_sessions(samples: DataFrame, key_cols: list[str], ts_col: str, value_col: str, error, gap_seconds: int,
                           watermark: str = "10 minutes") -> DataFrame:
    """J1 on a stream: runs without a run id, emitted (append mode) once the
    watermark has passed a run's last sample by the gap."""
    timed = samples.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    runs = timed.groupBy(*key_cols, F.session_window(ts_col, f"{int(gap_seconds)} seconds").alias("_run")).agg(
        F.min(ts_col).alias("run_start"), F.max(ts_col).alias("run_end"), F.max(value_col).alias("peak"), F.avg(value_col).alias("mean"),
        F.count(F.lit(1)).alias("samples"), F.count(F.when(error, 1)).alias("errors"))
    return runs.select(*key_cols, "run_start", "run_end", ((F.unix_micros("run_end") - F.unix_micros("run_start")) / 1e6).alias("elapsed_secs"),
                       F.coalesce("peak", F.lit(0.0)).alias("peak"), F.coalesce("mean", F.lit(0.0)).alias("mean"), "samples", "errors")


def document_batch_handler(renderer, model_factory, output_folder: str, results_path: str | None = None,
                           custom_prompt: str | None = None, **options):
    """``foreachBatch`` handler: each micro-batch of judged files is turned
    into markdown files (one per document, A6) and, optionally, its results
    (one row per input, rejects included) are written to
    ``results_path/epoch=<id>``. Both sinks overwrite, so a replayed batch adds
    nothing. ``options`` go to ``process_documents``."""
    from pagelane.plans.documents import process_documents
    from pagelane.sources.files import write_markdown

    def handle(batch: DataFrame, epoch_id: int) -> None:
        results, documents = process_documents(batch, renderer, model_factory, custom_prompt, **options)
        write_markdown(documents, output_folder)
        if results_path:
            results.write.mode("overwrite").parquet(f"{results_path}/epoch={epoch_id}")

    return handle
