"""URL filters by a temporal list join.

A list is a log of dated entries (list, pattern, add or remove). Per list and
pattern, entries become disjoint validity intervals; each capture is evaluated
against the intervals that hold on its fetch day. A pattern is a domain (matching
the host and all hosts below it) or a host with a path prefix, so a capture has a
few keys (its host's suffixes and path prefixes, no longer than the list's longest
pattern, so a very long url takes linear time) and the as-of join is an equality
on key and period plus the interval condition. The period (``PERIOD_DAYS`` of the
fetch day) also splits a hot host's captures over time; a long interval has one
row per period that has captures. The join is left outer and one aggregate per
capture follows, so captures are read once.

Defined cases: a null or unparsable url has no keys and is not blocked; a null
fetch day is never inside an interval; of several entries of one day, a removal
wins; entries with a null list, pattern or day are ignored; repeated captures are
evaluated one by one; an empty list blocks nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pagelane.llm.common import table

PERIOD_DAYS = 30


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def path_of(url: str) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_keys(url: str, most_labels: int, most_parts: int) -> Column:
    """All patterns of at most so many host labels or path parts that match a url: host suffixes of two labels or more (or the host), and path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - (most_labels - 1)), F.greatest(n - 1, F.lit(1))),
                           lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    parts = F.slice(F.filter(F.split(path_of(url), "/"), lambda p: p != ""), 1, most_parts)
    prefixes = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (exclusive, null if open) from dated entries."""
    daily = (entries.filter("list IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL")
             .groupBy("list", "pattern", "day").agg(F.max("action").alias("action")))  # 'remove' is after 'add'
    until = F.lead("day").over(Window.partitionBy("list", "pattern").orderBy("day"))
    return daily.select("list", "pattern", "action", F.col("day").alias("valid_from"), until.alias("valid_to")).filter("action = 'add'").drop("action")


def evaluate(captures: DataFrame, entries: DataFrame, period_days: int = PERIOD_DAYS) -> DataFrame:
    """Per capture (page_id, url, fetch_day): page_id, fetch_day, blocked, n_active, lists."""
    span = captures.agg(F.min("fetch_day").alias("low"), F.max("fetch_day").alias("high")).first()
    low, high = (span["low"], span["high"]) if span["low"] is not None else (0, -1)
    start = F.greatest(F.col("valid_from"), F.lit(low))
    end = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(high)), F.lit(high))
    intervals = (validity_intervals(entries).select("list", "pattern", "valid_from", "valid_to", start.alias("start"), end.alias("end"))
                 .filter("start <= end")
                 .select("list", "pattern", "valid_from", "valid_to",
                         F.explode(F.sequence(F.floor(F.col("start") / period_days), F.floor(F.col("end") / period_days))).alias("span")))
    longest = entries.agg(F.max(F.size(F.split(F.substring_index("pattern", "/", 1), r"\."))).alias("labels"),
                          F.max(F.size(F.split("pattern", "/")) - 1).alias("parts")).first()
    keys = url_keys("url", max(2, longest["labels"] or 0), longest["parts"] or 0)
    numbered = captures.select("page_id", "fetch_day", keys.alias("keys"), F.monotonically_increasing_id().alias("uid"))
    keyed = numbered.select("page_id", "fetch_day", "uid", F.floor(F.col("fetch_day") / period_days).alias("period"),
                            F.explode_outer("keys").alias("key"))
    holds = ((F.col("key") == F.col("pattern")) & (F.col("period") == F.col("span")) & (F.col("fetch_day") >= F.col("valid_from"))
             & (F.col("valid_to").isNull() | (F.col("fetch_day") < F.col("valid_to"))))
    hits = keyed.join(intervals, holds, "left")
    return (hits.groupBy("uid").agg(F.first("page_id").alias("page_id"), F.first("fetch_day").alias("fetch_day"),
                                    F.count("list").alias("n_active"), F.array_sort(F.collect_set("list")).alias("names"))
            .select("page_id", "fetch_day", (F.col("n_active") > 0).alias("blocked"), "n_active", F.array_join("names", ",").alias("lists")))


def _number(column: Column) -> Column:
    return F.conv(F.substring(F.md5(column.cast("string")), 1, 6), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures from ``pages``; the table has no fetch time, so the id's hash gives a day of a year."""
    return pages.select("page_id", "url", (_number(F.col("page_id")) % 365).alias("fetch_day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries about the hosts, domains and sections of ``pages``, by hash rules."""
    parts = F.filter(F.split(path_of("url"), "/"), lambda p: p != "")
    seen = pages.select(host_of("url").alias("host"), F.get(parts, F.lit(0)).alias("section")).filter("host != ''").distinct()
    hosts = seen.select(F.col("host").alias("pattern")).distinct()
    domains = hosts.select(F.substring_index("pattern", ".", -2).alias("pattern")).distinct()
    sections = seen.filter("section IS NOT NULL").select(F.concat_ws("/", "host", "section").alias("pattern")).distinct()

    def listed(name, patterns, chosen, events):
        marked = patterns.select("pattern", _number(F.col("pattern")).alias("x")).filter(chosen)
        return marked.select(F.lit(name).alias("list"), "pattern", F.explode(F.array(*[
            F.struct(F.lit(action).alias("action"), F.expr(day).cast("int").alias("day")) for action, day in events])).alias("e")).select(
                "list", "pattern", "e.action", "e.day")
    return (listed("abuse", hosts, "x % 3 = 0", [("add", "x % 200"), ("remove", "x % 200 + 20 + x % 90"), ("add", "x % 200 + 150")])
            .unionByName(listed("spam", domains, "x % 2 = 0", [("add", "x % 250")]))
            .unionByName(listed("adult", sections, "x % 5 < 2", [("add", "x % 120"), ("remove", "60 + x % 200")])))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(captures_of(pages), entries_of(pages))


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS uid, page_id, ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::INT % 365 AS fetch_day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
k AS (
  SELECT uid, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
                                    lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS key FROM p WHERE host <> ''
  UNION
  SELECT uid, unnest(list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[:i], '/'))) FROM p WHERE host <> ''),
h AS (SELECT DISTINCT host AS pattern FROM p WHERE host <> ''),
d AS (SELECT DISTINCT array_to_string(string_split(pattern, '.')[-2:], '.') AS pattern FROM h),
s AS (SELECT DISTINCT host || '/' || parts[1] AS pattern FROM p WHERE host <> '' AND len(parts) > 0),
x AS (SELECT 'abuse' AS list, pattern, ('0x' || substr(md5(pattern), 1, 6))::INT AS x FROM h
      UNION ALL SELECT 'spam', pattern, ('0x' || substr(md5(pattern), 1, 6))::INT FROM d
      UNION ALL SELECT 'adult', pattern, ('0x' || substr(md5(pattern), 1, 6))::INT FROM s),
e AS (SELECT list, pattern, 'add' AS action, x % 200 AS day FROM x WHERE list = 'abuse' AND x % 3 = 0
      UNION ALL SELECT list, pattern, 'remove', x % 200 + 20 + x % 90 FROM x WHERE list = 'abuse' AND x % 3 = 0
      UNION ALL SELECT list, pattern, 'add', x % 200 + 150 FROM x WHERE list = 'abuse' AND x % 3 = 0
      UNION ALL SELECT list, pattern, 'add', x % 250 FROM x WHERE list = 'spam' AND x % 2 = 0
      UNION ALL SELECT list, pattern, 'add', x % 120 FROM x WHERE list = 'adult' AND x % 5 < 2
      UNION ALL SELECT list, pattern, 'remove', 60 + x % 200 FROM x WHERE list = 'adult' AND x % 5 < 2),
-- The state of a pattern on a day is its last entry up to that day.
hit AS (SELECT p.uid, e.list, e.pattern, arg_max(e.action, e.day * 2 + (e.action = 'remove')::INT) AS state
        FROM p JOIN k USING (uid) JOIN e ON e.pattern = k.key AND e.day <= p.fetch_day GROUP BY ALL),
a AS (SELECT uid, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hit WHERE state = 'add' GROUP BY uid)
SELECT page_id, fetch_day, coalesce(n, 0) > 0 AS blocked, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists
FROM p LEFT JOIN a USING (uid)
"""
