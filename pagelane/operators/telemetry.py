"""Run telemetry (J1-J11): metrics, throughput, reports, load windows, logs.

All aggregates are partial (map-side combined) except exact percentiles,
whose buffer is a value->count map per group, bounded by distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelane.functions import fixed


def epoch_seconds(ts) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp")) / F.lit(1_000_000.0)


def run_metrics(samples: DataFrame, run_col: str, ts_col: str, value_col: str,
                error: Column) -> DataFrame:
    """Per run elapsed seconds, peak and mean sample (0 when none), errors."""
    t = epoch_seconds(ts_col)
    return (samples.groupBy(run_col)
            .agg((F.max(t) - F.min(t)).alias("elapsed_secs"),
                 F.coalesce(F.max(value_col), F.lit(0.0)).alias("peak"),
                 F.coalesce(F.avg(value_col), F.lit(0.0)).alias("mean"),
                 F.count(F.lit(1)).alias("samples"),
                 F.sum(F.when(error, 1).otherwise(0)).cast("long").alias("errors")))


def run_sessions(samples: DataFrame, key_cols: list[str], ts_col: str, value_col: str, error: Column, gap_seconds: int,
                 bucket: str = "day") -> DataFrame:
    """J1 without a run id: a run is a stretch of one key's samples with no gap over ``gap_seconds``.

    Two steps, so that a key with very many samples is many groups: sessions inside
    each ``bucket`` of time first, then these, each as long as it is, merged over
    the buckets (a handful of rows a bucket). Samples without time are ignored."""
    gap, t = f"{int(gap_seconds)} seconds", F.col(ts_col).cast("timestamp")
    timed = samples.filter(F.col(ts_col).isNotNull()).select(*key_cols, t.alias("_t"), F.col(value_col).alias("_v"), error.alias("_e"))
    partly = timed.groupBy(*key_cols, F.date_trunc(bucket, "_t").alias("_bucket"), F.session_window("_t", gap)).agg(
        F.min("_t").alias("first"), F.max("_t").alias("last"), F.max("_v").alias("peak"), F.sum("_v").alias("sum"), F.count("_v").alias("values"),
        F.count(F.lit(1)).alias("samples"), F.count(F.when(F.col("_e"), 1)).alias("errors"))
    micros = F.unix_micros("last") - F.unix_micros("first") + F.lit(int(gap_seconds) * 1_000_000)
    length = F.concat(micros.cast("string"), F.lit(" microseconds"))
    merged = partly.groupBy(*key_cols, F.session_window("first", length).alias("_run")).agg(
        F.min("first").alias("run_start"), F.max("last").alias("run_end"), F.max("peak").alias("peak"), F.sum("sum").alias("sum"),
        F.sum("values").alias("values"), F.sum("samples").alias("samples"), F.sum("errors").alias("errors"))
    return merged.select(*key_cols, "run_start", "run_end", ((F.unix_micros("run_end") - F.unix_micros("run_start")) / 1e6).alias("elapsed_secs"),
                         F.coalesce("peak", F.lit(0.0)).alias("peak"),
                         F.when(F.col("values") > 0, F.col("sum") / F.col("values")).otherwise(0.0).alias("mean"), "samples", "errors")


def throughput(df: DataFrame, group_col: str, secs_col: str) -> DataFrame:
    """Items per second with a zero guard."""
    return (df.groupBy(group_col)
            .agg(F.count(F.lit(1)).alias("items"), F.sum(secs_col).alias("secs"))
            .withColumn("per_sec", F.when(F.col("secs") > 0, F.col("items") / F.col("secs")).otherwise(F.lit(0.0))))


def metrics_report(metrics: DataFrame, peak_col: str = "peak", elapsed_col: str = "elapsed_secs",
                   memory_alert: float = fixed.MEMORY_ALERT_MB, time_alert: float = fixed.TIME_ALERT_SECS) -> DataFrame:
    """One row: max peak over runs, mean elapsed, alert flags."""
    return (metrics.agg(F.max(peak_col).alias("max_peak"), F.avg(elapsed_col).alias("mean_elapsed"),
                        F.count(F.lit(1)).alias("runs"))
            .withColumn("memory_alert", F.coalesce(F.col("max_peak") > memory_alert, F.lit(False)))
            .withColumn("time_alert", F.coalesce(F.col("mean_elapsed") > time_alert, F.lit(False))))


def rank_bottlenecks(df: DataFrame, component_col: str, secs_col: str) -> DataFrame:
    """Components by total time, descending, with rank and top flag.
    The window runs over the aggregated components (one row each)."""
    totals = df.groupBy(component_col).agg(F.sum(secs_col).alias("secs"))
    w = Window.orderBy(F.col("secs").desc(), F.col(component_col).asc())
    return (totals.withColumn("rank", F.row_number().over(w))
            .withColumn("is_top", F.col("rank") == 1))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Zero-guarded ratio of two conditional aggregates."""
    return F.when(denominator != 0, numerator / denominator)


def io_throughput(df: DataFrame, group_col: str, bytes_col: Column, secs_col: str) -> DataFrame:
    """MB/s per access pattern."""
    return (df.groupBy(group_col)
            .agg(F.sum(bytes_col).alias("bytes"), F.sum(secs_col).alias("secs"))
            .withColumn("mb_per_sec", F.when(F.col("secs") > 0, F.col("bytes") / 1048576.0 / F.col("secs"))))


def size_class(pages: Column) -> Column:
    """J7 bucket: small 1-5, medium 10-50, large 100+, ``between`` for the gaps."""
    out = F.lit("between")
    for name, lo, hi in reversed(fixed.SIZE_CLASSES):
        cond = pages >= lo if hi is None else pages.between(lo, hi)
        out = F.when(cond, F.lit(name)).otherwise(out)
    return F.when(pages < 1, F.lit("empty")).otherwise(out)


def size_classes(page_counts: DataFrame, count_col: str = "page_count") -> DataFrame:
    """Documents per size class and their share."""
    by_class = page_counts.groupBy(size_class(F.col(count_col)).alias("size_class")).agg(
        F.count(F.lit(1)).alias("documents"))
    return by_class.withColumn("share", F.col("documents") / F.sum("documents").over(Window.partitionBy()))


def load_windows(events: DataFrame, ts_col: str, value_col: str, error: Column,
                 width: str = "1 minute", exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Per time window: count, P50/P95/P99 of ``value_col``, error rate.

    By default the percentiles come from one sketch per window of bounded
    size (rank error at most 1 / ``accuracy``); ``exact`` keeps every distinct
    value of a window and is meant for windows that fit a task."""
    points = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    found = F.percentile(value_col, points) if exact else F.percentile_approx(value_col, [0.5, 0.95, 0.99], accuracy)
    return (events.groupBy(F.window(F.col(ts_col), width).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"),
                 found.alias("p"),
                 F.avg(F.when(error, 1.0).otherwise(0.0)).alias("error_rate"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "events", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "error_rate"))


#: Values a sketch holds before it starts to thin them out: up to so many in a window its percentiles are exact.
SKETCH_VALUES = 4096
LOAD_POINTS = (0.5, 0.95, 0.99)


def load_sketches(events: DataFrame, ts_col: str, value_col: str, error: Column, width: str = "1 minute",
                  k: int = SKETCH_VALUES) -> DataFrame:
    """J8 as rows to store: per window the number of events and errors and a KLL sketch of ``value_col``.

    The rows are small whatever the load, and ``merge_load`` makes windows of any
    multiple of the width from them without the events."""
    return (events.groupBy(F.window(F.col(ts_col), width).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), F.count(F.when(error, 1)).alias("errors"),
                 F.kll_sketch_agg_double(F.col(value_col).cast("double"), F.lit(int(k))).alias("sketch"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "errors", "sketch"))


def merge_load(sketches: DataFrame, width: str, k: int = SKETCH_VALUES) -> DataFrame:
    """Stored load rows merged into windows of ``width``; the result is of the same form and merges again."""
    return (sketches.groupBy(F.window("window_start", width).alias("w"))
            .agg(F.sum("events").alias("events"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("sketch", F.lit(int(k))).alias("sketch"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "errors", "sketch"))


def load_percentiles(sketches: DataFrame) -> DataFrame:
    """P50, P95, P99 (values that occurred; NULL without any) and the error rate of load rows."""
    any_value = F.kll_sketch_get_n_double("sketch") > 0
    found = F.when(any_value, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in LOAD_POINTS]))).alias("p")
    return (sketches.select("*", found)
            .select("window_start", "window_end", "events", *[F.get("p", F.lit(i)).alias(f"p{round(100 * p)}") for i, p in enumerate(LOAD_POINTS)],
                    (F.col("errors") / F.col("events")).alias("error_rate")))


LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - ([A-Z]+) - (.*)$"


def parse_log(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """``asctime - level - message`` lines; other lines keep level NULL."""
    c = F.col(text_col)
    matched = c.rlike(LOG_LINE)
    return lines.select(
        F.when(matched, F.to_timestamp(F.regexp_extract(c, LOG_LINE, 1), "yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
        F.when(matched, F.regexp_extract(c, LOG_LINE, 2)).alias("level"),
        F.when(matched, F.regexp_extract(c, LOG_LINE, 3)).otherwise(c).alias("message"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: ``(file, split, line, value)``; ``split`` is the byte at which the task's part of the file starts."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return lines.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("split"),
                        F.monotonically_increasing_id().alias("line"), "value")


def log_records(lines: DataFrame, file_col: str = "file", split_col: str = "split", line_col: str = "line",
                text_col: str = "value") -> DataFrame:
    """J9 over several lines: each line with ``ts`` and ``level`` of the record it belongs to.

    A record is a log line and the lines after it up to the next log line, so a
    traceback has its error's level. Three steps: inside a split the last log line is
    carried on (a window over one split, which is one task's part of a file); per
    split its last log line is one row, and these rows are scanned in file order;
    lines before a split's first log line take what the scan says. ``record_split``
    and ``record_line`` name the record's log line, NULL before a file's first one."""
    parsed = F.regexp_extract(text_col, LOG_LINE, 1)
    head = F.struct(F.col(split_col).alias("split"), F.col(line_col).alias("line"),
                    F.to_timestamp(parsed, "yyyy-MM-dd HH:mm:ss,SSS").alias("ts"), F.regexp_extract(text_col, LOG_LINE, 2).alias("level"))
    rows = lines.withColumn("is_head", F.coalesce(F.col(text_col).rlike(LOG_LINE), F.lit(False)))
    rows = rows.withColumn("_head", F.when(F.col("is_head"), head))
    so_far = Window.partitionBy(file_col, split_col).orderBy(line_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("_inside", F.last("_head", ignorenulls=True).over(so_far)).drop("_head")

    lasts = rows.groupBy(F.col(file_col).alias("_file"), F.col(split_col).alias("_split")).agg(
        F.max(F.struct(F.col("_head.line").alias("at"), F.col("_head").alias("head"))).alias("_last"))
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_file", "_split", F.last(F.col("_last.head"), ignorenulls=True).over(earlier).alias("_carried"))
    filled = inside.join(carried, F.col(file_col).eqNullSafe(F.col("_file")) & F.col(split_col).eqNullSafe(F.col("_split")))
    own = F.coalesce("_inside", "_carried")
    return filled.select(*lines.columns, "is_head", own["ts"].alias("ts"), own["level"].alias("level"),
                         own["split"].alias("record_split"), own["line"].alias("record_line"))


def record_messages(records: DataFrame, file_col: str = "file", split_col: str = "split", line_col: str = "line",
                    text_col: str = "value") -> DataFrame:
    """One row per record of ``log_records``: ts, level, number of lines and the message with its further lines.

    One record (a traceback) is gathered into one row; lines before a file's first log line are one record without level."""
    text = F.when(F.col("is_head"), F.regexp_extract(text_col, LOG_LINE, 3)).otherwise(F.col(text_col))
    line = F.struct(F.col(split_col).alias("s"), F.col(line_col).alias("l"), F.coalesce(text, F.lit("")).alias("t"))
    return (records.groupBy(file_col, "record_split", "record_line", "ts", "level")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(line)).alias("_lines"))
            .withColumn("message", F.array_join(F.transform("_lines", lambda x: x["t"]), "\n")).drop("_lines"))


def log_levels(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("level").agg(F.count(F.lit(1)).alias("lines"))


def secret_lines(parsed: DataFrame, message_col: str = "message") -> DataFrame:
    """Lines in which a key-shaped string appears (expected none)."""
    return parsed.filter(F.col(message_col).rlike(fixed.API_KEY_PATTERN))


def suite_summary(results: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """Tests run, failures, errors, success rate % (0 when none run)."""
    o = F.col(outcome_col)
    return (results.agg(F.count(F.lit(1)).alias("tests_run"),
                        F.sum(F.when(o == "failure", 1).otherwise(0)).cast("long").alias("failures"),
                        F.sum(F.when(o == "error", 1).otherwise(0)).cast("long").alias("errors"))
            .withColumn("failures", F.coalesce("failures", F.lit(0)))
            .withColumn("errors", F.coalesce("errors", F.lit(0)))
            .withColumn("success_rate",
                        F.when(F.col("tests_run") > 0,
                               (F.col("tests_run") - F.col("failures") - F.col("errors")) * 100.0 / F.col("tests_run"))
                        .otherwise(F.lit(0.0))))
