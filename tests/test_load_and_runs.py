"""Mergeable load windows (J8), runs without a run id (J1), log records over several lines."""

import datetime
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from pagelane.operators import telemetry as T
from pagelane.streaming.documents import streaming_run_sessions

START = datetime.datetime(2024, 3, 1)
EVENTS = "key int, ts timestamp, value double, bad boolean"


def rank_error(k):
    """Twice the sketch's normalised rank error for k, as its authors state it (a 99 % bound)."""
    return 2 * 2.446 / k ** 0.9433


@pytest.mark.parametrize("k", [200, 4096])
def test_hours_and_days_from_minutes(spark, k):
    rng = random.Random(k)
    rows = [(0, START + datetime.timedelta(seconds=rng.random() ** 2 * 2 * 86400), rng.lognormvariate(3, 1), rng.random() < 0.1) for _ in range(60_000)]
    events = spark.createDataFrame(rows, EVENTS)
    minutes = T.load_sketches(events, "ts", "value", F.col("bad"), k=k)
    assert minutes.count() <= 2 * 1440 and minutes.agg(F.max(F.octet_length("sketch"))).first()[0] < 24 * k + 500
    hours = T.merge_load(minutes, "1 hour", k)
    days = T.merge_load(hours, "1 day", k)
    for width, frame in ((3600, hours), (86400, days)):
        for r in T.load_percentiles(frame).collect():
            mine = sorted(v for _, t, v, _ in rows if r.window_start <= t < r.window_end)
            assert (r.window_end - r.window_start).total_seconds() == width and r.events == len(mine)
            assert abs(r.error_rate - sum(b for _, t, _, b in rows if r.window_start <= t < r.window_end) / len(mine)) < 1e-12
            for point, got in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
                below = sum(v < got for v in mine) / len(mine), sum(v <= got for v in mine) / len(mine)
                assert below[0] - rank_error(k) <= point <= below[1] + rank_error(k)
    assert sum(r.events for r in T.load_percentiles(days).collect()) == len(rows)


def test_small_windows_are_exact_and_empty_ones_have_no_percentile(spark):
    rows = [(0, START, float(v), False) for v in range(1, 101)] + [(0, START + datetime.timedelta(hours=1), None, True)]
    got = {r.window_start: r for r in T.load_percentiles(T.merge_load(T.load_sketches(
        spark.createDataFrame(rows, EVENTS), "ts", "value", F.col("bad")), "1 hour")).collect()}
    assert (got[START].p50, got[START].p95, got[START].p99) == (50.0, 95.0, 99.0)
    empty = got[START + datetime.timedelta(hours=1)]
    assert empty.events == 1 and empty.p50 is None and empty.error_rate == 1.0
    assert T.load_percentiles(T.load_sketches(spark.createDataFrame([], EVENTS), "ts", "value", F.col("bad"))).count() == 0


def brute_runs(rows, gap):
    out = []
    for key in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: r[1])
        run = []
        for r in mine + [None]:
            if run and (r is None or (r[1] - run[-1][1]).total_seconds() > gap):
                values = [v for _, _, v, _ in run if v is not None]
                out.append((key, run[0][1], run[-1][1], (run[-1][1] - run[0][1]).total_seconds(), max(values, default=0.0),
                            round(sum(values) / len(values), 9) if values else 0.0, len(run), sum(b for *_, b in run)))
                run = []
            if r is not None:
                run.append(r)
    return out


def session_rows():
    rng = random.Random(3)
    rows = []
    for key in range(4):
        at = START
        for _ in range(60):
            at += datetime.timedelta(seconds=rng.choice([1, 30, 599, 600, 601, 4000]))
            rows.append((key, at, rng.choice([None, 1.5, 2.25]), rng.random() < 0.3))
    rows += [(9, START + datetime.timedelta(seconds=500 * i), 1.0, False) for i in range(900)]  # one run over five days
    return rows


def tidy(df):
    return sorted((r.key, r.run_start, r.run_end, r.elapsed_secs, r.peak, round(r["mean"], 9), r.samples, r.errors) for r in df.collect())


@pytest.mark.parametrize("bucket", ["hour", "day"])
def test_runs_are_found_by_their_gaps(spark, bucket):
    rows = session_rows()
    frame = spark.createDataFrame(rows + [(1, None, 1.0, True)], EVENTS).repartition(5)
    assert tidy(T.run_sessions(frame, ["key"], "ts", "value", F.col("bad"), 600, bucket)) == brute_runs(rows, 600)
    assert T.run_sessions(frame.limit(0), ["key"], "ts", "value", F.col("bad"), 600).count() == 0


def test_streamed_runs_are_the_batch_runs(spark):
    rows = sorted(session_rows(), key=lambda r: r[1])
    folder = tempfile.mkdtemp(prefix="pagelane-runs-")
    rows += [(99, START + datetime.timedelta(days=30), 0.0, False)]  # closes all others
    for at in range(0, len(rows), 400):
        spark.createDataFrame(rows[at:at + 400], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(EVENTS).parquet(folder)
    out = streaming_run_sessions(stream, ["key"], "ts", "value", F.col("bad"), 600, watermark="1 minute")
    query = out.writeStream.outputMode("append").format("memory").queryName("streamed_runs").start()
    query.processAllAvailable()
    query.stop()
    assert tidy(spark.table("streamed_runs")) == [r for r in brute_runs(rows, 600) if r[0] != 99]


def log_files(folder):
    """Two files with long tracebacks; the second one begins inside a record."""
    rng, files = random.Random(8), {}
    for name, head_first in (("a.log", True), ("b.log", False)):
        lines = [] if head_first else ["  left over", "Traceback of before"]
        for i in range(120):
            ts = START + datetime.timedelta(seconds=i)
            lines.append(f"{ts:%Y-%m-%d %H:%M:%S},{i:03d} - {rng.choice(['INFO', 'ERROR', 'WARNING'])} - message {i}")
            lines += [f'  File "x.py", line {n}, in step {i}' for n in range(rng.choice([0, 0, 1, 3, 40]))]
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
        files[name] = lines
    return files


def test_a_traceback_cut_by_a_split_joins_its_header(spark, tmpdir_fresh):
    files = log_files(tmpdir_fresh)
    settings = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        lines = T.read_log_lines(spark, tmpdir_fresh)
        assert lines.select("file", "split").distinct().count() > 10
        records = T.log_records(lines)
        got = {}
        for r in records.orderBy("file", "split", "line").collect():
            got.setdefault(os.path.basename(r.file), []).append((r.value, r.level, r.ts, r.is_head))
        cut = records.filter("NOT is_head AND split != record_split").count()
        messages = T.record_messages(records).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert cut > 5  # lines whose header is in another split
    expected_messages = []
    for name, lines in files.items():
        level = ts = None
        expected = []
        for line in lines:
            parts = line.split(" - ", 2)
            head = len(parts) == 3 and line[:4] == "2024"
            if head:
                level, ts = parts[1], datetime.datetime.strptime(parts[0], "%Y-%m-%d %H:%M:%S,%f")
                expected_messages.append((name, level, parts[2]))
            elif level is None:
                if not expected:
                    expected_messages.append((name, None, line))
                else:
                    expected_messages[-1] = (name, None, expected_messages[-1][2] + "\n" + line)
            else:
                expected_messages[-1] = (*expected_messages[-1][:2], expected_messages[-1][2] + "\n" + line)
            expected.append((line, level, ts, head))
        assert got[name] == expected
    assert sorted((os.path.basename(m.file), m.level, m.message) for m in messages if m.level) == sorted(e for e in expected_messages if e[1])
    assert [(os.path.basename(m.file), m.n_lines, m.message) for m in messages if m.level is None] == [("b.log", 2, "  left over\nTraceback of before")]


def test_no_log_lines(spark, tmpdir_fresh):
    open(os.path.join(tmpdir_fresh, "empty.log"), "w").close()
    records = T.log_records(T.read_log_lines(spark, tmpdir_fresh))
    assert records.count() == 0 and T.record_messages(records).count() == 0
