"""Registered telemetry queries (J1-J8) on ``events`` and ``documents``.

``events`` plays the run log: ``user_id`` is the run, ``value`` the
response time (seconds) or memory sample, ``event_type = 'error'`` an
error, ``props`` a JSON payload (its length is the bytes moved).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelane.functions import fixed
from pagelane.operators.pages import explode_text_pages, page_counts
from pagelane.operators.records import parse_json_strict
from pagelane.operators.balance import spread
from pagelane.operators.telemetry import (io_throughput, load_percentiles, load_sketches, load_windows, log_records, merge_load,
                                          metrics_report, parse_log, rank_bottlenecks, ratio, record_messages, run_metrics, run_sessions,
                                          size_classes, suite_summary, throughput)
from pagelane.session import stage_table
from pagelane.sources.tables import read_table


def _events(spark, sf_dir, *cols) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(*cols)


def _is_error():
    return F.col("event_type") == "error"


# J1
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "user_id", "ts", "value", "event_type")
    return run_metrics(e, "user_id", "ts", "value", _is_error())


def run_stats_sql() -> str:
    return """
SELECT user_id, epoch(max(ts)) - epoch(min(ts)) AS elapsed_secs,
       coalesce(max(value), 0.0) AS peak, coalesce(avg(value), 0.0) AS mean,
       count(*) AS samples, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors
FROM events GROUP BY user_id"""


# J2
def event_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throughput(_events(spark, sf_dir, "event_type", "value"), "event_type", "value")


def event_throughput_sql() -> str:
    return """
SELECT event_type, count(*) AS items, sum(value) AS secs,
       CASE WHEN sum(value) > 0 THEN count(*) / sum(value) ELSE 0.0 END AS per_sec
FROM events GROUP BY event_type"""


# J3
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_report(run_stats(spark, sf_dir))


def run_report_sql() -> str:
    return f"""
WITH m AS ({run_stats_sql()})
SELECT max(peak) AS max_peak, avg(elapsed_secs) AS mean_elapsed, count(*) AS runs,
       coalesce(max(peak) > {fixed.MEMORY_ALERT_MB}, false) AS memory_alert,
       coalesce(avg(elapsed_secs) > {fixed.TIME_ALERT_SECS}, false) AS time_alert
FROM m"""


# J4
def bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bottlenecks(_events(spark, sf_dir, "event_type", "value"), "event_type", "value")


def bottlenecks_sql() -> str:
    return """
WITH t AS (SELECT event_type, sum(value) AS secs FROM events GROUP BY event_type)
SELECT event_type, secs, CAST(row_number() OVER (ORDER BY secs DESC, event_type ASC) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY secs DESC, event_type ASC) = 1 AS is_top
FROM t"""


# J5
def event_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "event_type", "value")
    is_err = _is_error()
    agg = e.agg(
        F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("purchases"),
        F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("views"),
        F.avg(F.when(is_err, F.col("value"))).alias("err_mean"),
        F.avg(F.when(~is_err, F.col("value"))).alias("ok_mean"),
        F.max("value").alias("max_value"), F.min("value").alias("min_value"))
    return agg.select(
        ratio(F.col("purchases").cast("double"), F.col("views").cast("double")).alias("purchase_per_view"),
        (ratio(F.col("err_mean") - F.col("ok_mean"), F.col("ok_mean")) * 100.0).alias("error_overhead_pct"),
        ratio(F.col("max_value"), F.col("min_value")).alias("spread_ratio"))


def event_ratios_sql() -> str:
    return """
WITH a AS (
  SELECT sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases,
         sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views,
         avg(CASE WHEN event_type = 'error' THEN value END) AS err_mean,
         avg(CASE WHEN event_type <> 'error' THEN value END) AS ok_mean,
         max(value) AS max_value, min(value) AS min_value
  FROM events)
SELECT CASE WHEN views <> 0 THEN CAST(purchases AS DOUBLE) / views END AS purchase_per_view,
       CASE WHEN ok_mean <> 0 THEN (err_mean - ok_mean) / ok_mean END * 100.0 AS error_overhead_pct,
       CASE WHEN min_value <> 0 THEN max_value / min_value END AS spread_ratio
FROM a"""


# J6
def payload_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "event_type", "value", "props")
    return io_throughput(e, "event_type", F.octet_length("props").cast("long"), "value")


def payload_io_sql() -> str:
    return """
SELECT event_type, CAST(sum(strlen(props)) AS BIGINT) AS bytes, sum(value) AS secs,
       CASE WHEN sum(value) > 0 THEN sum(strlen(props)) / 1048576.0 / sum(value) END AS mb_per_sec
FROM events GROUP BY event_type"""


# J7
def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return size_classes(page_counts(explode_text_pages(docs)), "page_count")


def document_sizes_sql() -> str:
    return """
WITH c AS (SELECT len(string_split(text, chr(10))) AS n FROM documents),
k AS (SELECT CASE WHEN n < 1 THEN 'empty' WHEN n BETWEEN 1 AND 5 THEN 'small' WHEN n BETWEEN 10 AND 50 THEN 'medium'
                  WHEN n >= 100 THEN 'large' ELSE 'between' END AS size_class FROM c)
SELECT size_class, count(*) AS documents, count(*) / sum(count(*)) OVER () AS share FROM k GROUP BY size_class"""


# J8
def minute_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "ts", "value", "event_type")
    return load_windows(e, "ts", "value", _is_error(), "1 minute", exact=True)


def minute_load_sql() -> str:
    return """
SELECT time_bucket(INTERVAL 1 minute, ts) AS window_start, time_bucket(INTERVAL 1 minute, ts) + INTERVAL 1 minute AS window_end,
       count(*) AS events, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95,
       quantile_cont(value, 0.99) AS p99, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate
FROM events GROUP BY 1, 2"""


# J8 from stored sketches
def load_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours and days from the minutes' stored sketches; the events are read once."""
    e = _events(spark, sf_dir, "ts", "value", "event_type")
    minutes = stage_table(load_sketches(e, "ts", "value", _is_error()), "load-minutes")
    hours = stage_table(merge_load(minutes, "1 hour"), "load-hours")
    rolled = [load_percentiles(rows).select(F.lit(name).alias("width"), "*") for name, rows in (("hour", hours), ("day", merge_load(hours, "1 day")))]
    return rolled[0].unionByName(rolled[1])


def load_rollup_sql() -> str:
    def rolled(name):
        return f"""
SELECT '{name}' AS width, time_bucket(INTERVAL 1 {name}, ts) AS window_start, time_bucket(INTERVAL 1 {name}, ts) + INTERVAL 1 {name} AS window_end,
       count(*) AS events, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99,
       avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate
FROM events GROUP BY 2, 3"""
    return rolled("hour") + " UNION ALL " + rolled("day")


# J1 without a run id
SESSION_GAP_SECONDS = 6 * 3600


def run_session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs found by gaps of more than six hours between a user's events."""
    e = _events(spark, sf_dir, "user_id", "ts", "value", "event_type")
    return run_sessions(e, ["user_id"], "ts", "value", _is_error(), SESSION_GAP_SECONDS)


def run_session_stats_sql() -> str:
    return f"""
WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL {SESSION_GAP_SECONDS} second
                          THEN 0 ELSE 1 END AS starts FROM events WHERE ts IS NOT NULL),
i AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_secs,
       coalesce(max(value), 0.0) AS peak, coalesce(avg(value), 0.0) AS mean, count(*) AS samples,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors
FROM i GROUP BY user_id, run"""


# F3 on a JSON column of the driver data
def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "event_id", "props")
    v = parse_json_strict(F.col("props"))
    return (e.select("event_id", v.alias("v"))
            .select("event_id", F.col("v").isNotNull().alias("json_ok"),
                    F.try_variant_get("v", "$.k", "bigint").alias("k")))


def event_payloads_sql() -> str:
    return """
SELECT event_id, coalesce(json_valid(props), false) AS json_ok,
       CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events"""


# Log lines built from the events
def _log_lines(spark, sf_dir) -> DataFrame:
    """One log line per event: errors are ERROR, views DEBUG, the rest INFO;
    every tenth is no log line, every 97th carries a key-shaped string."""
    e = _events(spark, sf_dir, "event_id", "ts", "event_type")
    level = F.when(F.col("event_type") == "error", F.lit("ERROR")).when(F.col("event_type") == "view", F.lit("DEBUG")).otherwise(F.lit("INFO"))
    message = F.concat(F.lit("event "), F.col("event_id").cast("string"),
                       F.when(F.col("event_id") % 97 == 0, F.concat(F.lit(" key AIza"), F.md5(F.col("event_id").cast("string")))).otherwise(F.lit("")))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 - "), level, F.lit(" - "), message)
    return e.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("  at frame "), message)).otherwise(line).alias("value"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_log(_log_lines(spark, sf_dir))
    return parsed.groupBy("level").agg(F.count(F.lit(1)).alias("lines"), F.count("ts").alias("timed"),
                                       F.count(F.when(F.col("message").rlike(fixed.API_KEY_PATTERN), 1)).alias("with_key"))


def log_records_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several lines: a log file a day, in parts of four hours; lines that are no log line belong to the one before."""
    e = _events(spark, sf_dir, "event_id", "ts", "event_type")
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 - "), F.upper("event_type"), F.lit(" - event "), F.col("event_id").cast("string"))
    more = F.concat(F.lit("  at step "), F.col("event_id").cast("string"))
    lines = e.select(F.to_date("ts").alias("file"), F.floor(F.hour("ts") / 4).alias("split"), F.struct("ts", "event_id").alias("line"),
                     F.when(F.col("event_type").isin("error", "purchase"), head).otherwise(more).alias("value"))
    return record_messages(log_records(lines)).select("file", F.col("record_line.event_id").alias("first_event"), "level", "n_lines", "message")


def log_records_by_day_sql() -> str:
    return """
WITH l AS (SELECT event_id, ts, CAST(ts AS DATE) AS file, event_type IN ('error', 'purchase') AS is_head, upper(event_type) AS level,
                  CASE WHEN event_type IN ('error', 'purchase') THEN 'event ' ELSE '  at step ' END || event_id AS text FROM events),
r AS (SELECT *, last_value(CASE WHEN is_head THEN event_id END IGNORE NULLS) OVER w AS first_event,
             last_value(CASE WHEN is_head THEN level END IGNORE NULLS) OVER w AS record_level
      FROM l WINDOW w AS (PARTITION BY file ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT file, first_event, record_level AS level, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY ts, event_id) AS message
FROM r GROUP BY file, first_event, record_level"""


def log_lines_sql() -> str:
    return """
SELECT CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
       count(*) AS lines, count(CASE WHEN event_id % 10 <> 0 THEN 1 END) AS timed, count(CASE WHEN event_id % 97 = 0 THEN 1 END) AS with_key
FROM events GROUP BY 1"""


# Events as test outcomes
def suite_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "event_id", "event_type")
    outcome = F.when(F.col("event_type") == "error", F.lit("error")).when(F.col("event_id") % 50 == 0, F.lit("failure")).otherwise(F.lit("pass"))
    return suite_summary(e.select(outcome.alias("outcome")))


def suite_results_sql() -> str:
    return """
WITH s AS (SELECT count(*) AS tests_run,
  CAST(sum(CASE WHEN event_type <> 'error' AND event_id % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events)
SELECT *, CASE WHEN tests_run > 0 THEN (tests_run - failures - errors) * 100.0::DOUBLE / tests_run ELSE 0.0 END AS success_rate FROM s"""


QUERIES = {
    "load_rollup": (load_rollup, load_rollup_sql),
    "run_session_stats": (run_session_stats, run_session_stats_sql),
    "log_records_by_day": (log_records_by_day, log_records_by_day_sql),
    "log_lines": (log_lines, log_lines_sql),
    "suite_results": (suite_results, suite_results_sql),
    "run_stats": (run_stats, run_stats_sql),
    "event_throughput": (event_throughput, event_throughput_sql),
    "run_report": (run_report, run_report_sql),
    "bottlenecks": (bottlenecks, bottlenecks_sql),
    "event_ratios": (event_ratios, event_ratios_sql),
    "payload_io": (payload_io, payload_io_sql),
    "document_sizes": (document_sizes, document_sizes_sql),
    "minute_load": (minute_load, minute_load_sql),
    "event_payloads": (event_payloads, event_payloads_sql),
}
