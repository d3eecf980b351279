"""The committed markdown sink (A6): nothing half written under a final name."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pagelane.sources import markdown_sink as sink
from pagelane.sources.files import write_markdown


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="pagelane-sink-")


def documents(spark, n, partitions=4):
    return spark.range(n).repartition(partitions).select(F.format_string("d%03d.md", "id").alias("output_name"),
                                                         F.concat(F.lit("# é "), F.col("id").cast("string")).alias("markdown"))


def files(folder):
    return {name: open(os.path.join(folder, name), encoding="utf-8").read() for name in sorted(os.listdir(folder))}


def failing(df):
    """``df`` whose rows raise late: other tasks, and other rows of the task, are written by then."""
    return df.withColumn("markdown", F.when(F.col("output_name") == "d137.md", F.raise_error(F.lit("lost"))).otherwise(F.col("markdown")))


def test_every_row_is_a_file(spark, folder):
    report = write_markdown(documents(spark, 200), folder)
    assert report.count() == 200 and report.filter("ok").count() == 200
    assert files(folder) == {f"d{i:03d}.md": f"# é {i}" for i in range(200)}


def test_a_task_that_fails_leaves_no_file(spark, folder):
    write_markdown(documents(spark, 3), folder)
    before = files(folder)
    with pytest.raises(Exception, match="lost"):
        write_markdown(failing(documents(spark, 200)), folder)
    assert files(folder) == before  # neither new files nor changed ones, and the run's folder is gone
    write_markdown(documents(spark, 200), folder)
    assert len(files(folder)) == 200


def test_a_committed_run_is_finished_after_a_lost_driver(spark, folder, monkeypatch):
    write_markdown(documents(spark, 2).withColumn("markdown", F.lit("old")), folder)

    def lost(*args):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(sink, "publish", lost)
        with pytest.raises(KeyboardInterrupt):
            write_markdown(documents(spark, 20), folder)
    assert {k: v for k, v in files_only(folder).items()} == {"d000.md": "old", "d001.md": "old"}
    assert len(sink.recover_markdown(spark, folder)) == 1
    assert files(folder) == {f"d{i:03d}.md": f"# é {i}" for i in range(20)}
    assert sink.recover_markdown(spark, folder) == []


def files_only(folder):
    return {n: open(os.path.join(folder, n), encoding="utf-8").read() for n in sorted(os.listdir(folder)) if n != sink.RUNS}


def test_publishing_twice_renames_once(spark, folder, monkeypatch):
    """A publishing that died after some renames goes on where it stopped."""
    real, seen = sink._remove_run, []
    monkeypatch.setattr(sink, "_remove_run", lambda runs, run: seen.append(run))
    write_markdown(documents(spark, 9), folder)
    monkeypatch.setattr(sink, "_remove_run", real)
    assert [r.ok for r in sink.publish(spark, folder, seen[0]).collect()] == [True] * 9
    assert files(folder) == {f"d{i:03d}.md": f"# é {i}" for i in range(9)}


def test_an_uncommitted_run_stays_apart(spark, folder):
    left = os.path.join(folder, sink.RUNS, "dead", "000000.0")
    os.makedirs(left)
    open(os.path.join(left, "000000000"), "w").write("half")
    assert sink.recover_markdown(spark, folder) == [] and os.path.isdir(left)
    write_markdown(documents(spark, 1), folder)
    assert list(files_only(folder)) == ["d000.md"]
    sink.recover_markdown(spark, folder, remove_uncommitted=True)
    assert os.listdir(folder) == ["d000.md"]


def test_names_that_cannot_be_written(spark, folder):
    os.makedirs(os.path.join(folder, "taken.md"))
    rows = [("a.md", "A"), ("../b.md", "B"), (None, "C"), ("", "D"), ("taken.md", "E"), ("same.md", "F"), ("same.md", "F"), ("n.md", None), ("..", "x"),
            (sink.RUNS, "x"), ("x" * 300 + ".md", "too long")]
    report = write_markdown(spark.createDataFrame(rows, "output_name string, markdown string").repartition(3), folder).collect()
    assert len(report) == len(rows)
    assert sorted(r.name for r in report if r.ok) == ["a.md", "n.md", "same.md"]
    errors = [r for r in report if not r.ok]
    assert sum(r.error == sink.SAME_NAME for r in errors) == 1 and all(r.error for r in errors)
    assert {n: open(os.path.join(folder, n)).read() for n in os.listdir(folder) if n != "taken.md"} == {"a.md": "A", "n.md": "", "same.md": "F"}


def test_no_rows(spark, folder):
    assert write_markdown(documents(spark, 0), folder).count() == 0 and os.listdir(folder) == []
