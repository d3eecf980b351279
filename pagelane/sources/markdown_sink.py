"""A6 as a committed sink: one UTF-8 file per row, none of them half written.

Tasks write through a Python data source into a folder of their own attempt under
``<folder>/_pagelane/<run>``, files by number, and end it with a list of the names
they stand for. Spark commits the attempts that won; the commit writes their list,
and only then does a second job give the files their final names, replacing what
was there. So a lost, failed or speculative attempt never has a file under a final
name, and a failed write removes the run's folder. If the driver dies between the
two steps, ``recover_markdown`` finishes committed runs; renaming is repeatable.

Listings skip the run's folder as its name starts with ``_``.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pagelane.session import stage_table
from pagelane.sources.files import _REPORT, _fs_and_path

RUNS = "_pagelane"
_COMMITTED, _NAMES = "_committed", "_names"
SAME_NAME = "FileExistsError: another document of this run has the name"


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    rows: int


def unsafe_name(name: str | None) -> bool:
    return not name or "/" in name or "\x00" in name or name in (".", "..", RUNS)


class MarkdownSink(DataSource):
    """Options: ``path`` (the folder), ``run``, ``name`` and ``text`` (columns)."""

    @classmethod
    def name(cls) -> str:
        return "pagelane_markdown"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return MarkdownWriter(dict(self.options))


class MarkdownWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.run_folder = f"{options['path'].rstrip('/')}/{RUNS}/{options['run']}"
        self.columns = options["name"], options["text"]

    def write(self, iterator) -> Attempt:
        from pyspark import TaskContext
        task = TaskContext.get()
        attempt = f"{task.partitionId():06d}.{task.taskAttemptId()}"
        filesystem, folder = _fs_and_path(f"{self.run_folder}/{attempt}")
        filesystem.create_dir(folder, recursive=True)
        name_col, text_col = self.columns
        number = 0
        with filesystem.open_output_stream(f"{folder}/{_NAMES}") as names:
            for row in iterator:
                name, problem = row[name_col], None
                if unsafe_name(name):
                    problem = f"ValueError: unsafe output name: {name!r}"
                else:
                    with filesystem.open_output_stream(f"{folder}/{number:09d}") as out:
                        out.write((row[text_col] or "").encode("utf-8"))
                names.write(json.dumps([number, name, problem]).encode() + b"\n")
                number += 1
        return Attempt(attempt, number)

    def commit(self, messages) -> None:
        filesystem, folder = _fs_and_path(self.run_folder)
        filesystem.create_dir(folder, recursive=True)
        won = sorted(m.folder for m in messages if m is not None)  # one short name per task
        with filesystem.open_output_stream(f"{folder}/{_COMMITTED}.tmp") as out:
            out.write("\n".join(won).encode())
        filesystem.move(f"{folder}/{_COMMITTED}.tmp", f"{folder}/{_COMMITTED}")

    def abort(self, messages) -> None:
        _remove_run(*self.run_folder.rsplit("/", 1))


def _named_files(run_folder: str):
    """Lists of the committed attempts: ``(name, attempt, number, error)``."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for attempt in pdf["attempt"]:
                filesystem, path = _fs_and_path(f"{run_folder}/{attempt}/{_NAMES}")
                with filesystem.open_input_stream(path) as stream:
                    rows = [json.loads(line) for line in stream.read().splitlines()]
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame([(name, attempt, number, problem) for number, name, problem in rows[at:at + 10_000]],
                                       columns=["name", "attempt", "number", "error"])
    return run


def _rename(filesystem, source: str, target: str) -> None:
    from pyarrow import fs as pafs
    kinds = [i.type for i in filesystem.get_file_info([source, target])]
    if kinds[0] == pafs.FileType.NotFound and kinds[1] == pafs.FileType.File:
        return  # renamed by an earlier attempt of this task
    if kinds[1] == pafs.FileType.Directory:
        raise IsADirectoryError(f"a folder has the name: {target}")
    try:
        filesystem.move(source, target)
    except OSError:  # stores that do not replace
        if kinds[1] != pafs.FileType.File:
            raise
        filesystem.delete_file(target)
        filesystem.move(source, target)


def publish(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """Give the files of a committed run their final names: ``(name, ok, error)`` per row, then the run's folder goes."""
    import pandas as pd

    base = folder.rstrip("/")
    run_folder = f"{base}/{RUNS}/{run}"
    filesystem, path = _fs_and_path(f"{run_folder}/{_COMMITTED}")
    with filesystem.open_input_stream(path) as stream:
        attempts = stream.read().decode().splitlines()
    tasks = max(1, min(len(attempts), spark.sparkContext.defaultParallelism * 8))
    listed = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(tasks, "attempt")
    files = stage_table(listed.mapInPandas(_named_files(run_folder), "name string, attempt string, number long, error string"), "markdown-files")
    good = files.filter(F.col("error").isNull())
    first = good.groupBy("name").agg(F.min(F.struct("attempt", "number")).alias("_first"))
    chosen = first.select("name", "_first.attempt", "_first.number")
    others = good.join(first, "name").filter(F.struct("attempt", "number") != F.col("_first"))

    def rename(batches):
        fs, root = _fs_and_path(base)
        for pdf in batches:
            report = []
            for name, attempt, number in zip(pdf["name"], pdf["attempt"], pdf["number"]):
                try:
                    _rename(fs, f"{root}/{RUNS}/{run}/{attempt}/{int(number):09d}", f"{root}/{name}")
                    report.append((name, True, None))
                except Exception as exc:  # reported, the batch goes on
                    report.append((name, False, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(report, columns=["name", "ok", "error"])

    report = stage_table(chosen.mapInPandas(rename, _REPORT)
                         .unionByName(others.select("name", F.lit(False).alias("ok"), F.lit(SAME_NAME).alias("error")))
                         .unionByName(files.filter(F.col("error").isNotNull()).select("name", F.lit(False).alias("ok"), "error")), "written")
    _remove_run(f"{base}/{RUNS}", run)
    return report


def _remove_run(runs: str, run: str, tries: int = 20) -> None:
    """Remove a run's folder, and the folder of runs with the last one. Tasks of an
    aborted job may still be writing, so this is tried for a while; what is left
    then has no final name, and ``recover_markdown`` removes it."""
    from pyarrow import fs as pafs
    filesystem, path = _fs_and_path(runs)
    quiet = 0
    for _ in range(tries):
        try:
            if filesystem.get_file_info(f"{path}/{run}").type != pafs.FileType.NotFound:
                quiet = 0
                filesystem.delete_dir(f"{path}/{run}")
            there = filesystem.get_file_info(path).type == pafs.FileType.Directory
            if there and not filesystem.get_file_info(pafs.FileSelector(path)):
                filesystem.delete_dir(path)
            quiet += 1
            if quiet == 2:
                return
        except OSError:
            quiet = 0
        time.sleep(0.1)


def write_markdown(docs: DataFrame, folder: str, name_col: str = "output_name", text_col: str = "markdown") -> DataFrame:
    """One UTF-8 file per row, replaced if present; ``(name, ok, error)`` per row.

    Writes at once. An unsafe name, a name that is a folder, and all but one of the
    rows of one name are reported and do not stop the others."""
    spark, run = docs.sparkSession, uuid4().hex
    spark.dataSource.register(MarkdownSink)
    try:
        (docs.select(name_col, text_col).write.format(MarkdownSink.name()).mode("append")
         .options(run=run, name=name_col, text=text_col).save(folder))
    except Exception:
        _remove_run(f"{folder.rstrip('/')}/{RUNS}", run)  # what tasks wrote while the abort ran
        raise
    return publish(spark, folder, run)


def recover_markdown(spark: SparkSession, folder: str, remove_uncommitted: bool = False) -> list[str]:
    """Finish the committed runs that a lost driver left in ``folder``; returns their names.

    ``remove_uncommitted`` also removes the files of runs without a commit: only
    when no other run writes to the folder."""
    from pyarrow import fs as pafs
    runs_path = f"{folder.rstrip('/')}/{RUNS}"
    filesystem, path = _fs_and_path(runs_path)
    if filesystem.get_file_info(path).type != pafs.FileType.Directory:
        return []
    done = []
    for info in filesystem.get_file_info(pafs.FileSelector(path)):  # a folder per interrupted run
        committed = filesystem.get_file_info(f"{info.path}/{_COMMITTED}").type == pafs.FileType.File
        if committed:
            publish(spark, folder, info.base_name)
            done.append(info.base_name)
        elif remove_uncommitted:
            _remove_run(runs_path, info.base_name)
    return sorted(done)
