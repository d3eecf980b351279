"""Folder listings, file admission inputs and sinks.

Listings read the ``binaryFile`` source and never select ``content``, so
column pruning keeps them metadata-only; the admission size rule is a
plain ``length`` predicate the scan can push down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelane.session import stage_table

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _name(path_col: str = "path"):
    return F.regexp_extract(F.col(path_col), r"([^/]*)$", 1)


def read_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """All files of ``folder`` (not recursive) as the ``binaryFile`` frame."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A1: ``*.pdf`` files of the folder (case-sensitive, not recursive);
    ``(path, name, length, modificationTime)`` -- no content read."""
    return read_files(spark, folder, "*.pdf").select("path", _name().alias("name"), "length", "modificationTime")


def discover_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A2: files whose lower-cased name ends ``.pdf`` (finds ``X.PDF`` too)."""
    files = read_files(spark, folder).select("path", _name().alias("name"), "length")
    return files.filter(F.lower(F.col("name")).endswith(".pdf"))


def _hadoop(spark: SparkSession, folder: str):
    """The folder as a Hadoop path and its file system, whatever the scheme."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path, filesystem = _hadoop(spark, folder)
    return filesystem.exists(path) and filesystem.getFileStatus(path).isDirectory()


def folder_names(spark: SparkSession, folder: str) -> DataFrame:
    """A3: names of the folders directly inside ``folder``, listed in a task
    (whole trees: ``sources.tree``)."""
    from pagelane.sources.tree import list_tree

    return list_tree(spark, folder, max_depth=1).filter("is_folder").select("name")


def _listing(spark: SparkSession, folder: str, label: str) -> DataFrame:
    if not folder_exists(spark, folder):
        return spark.createDataFrame([], "folder string, name string, ext string, is_pdf boolean")
    files = read_files(spark, folder).select(_name().alias("name"))
    return files.select(F.lit(label).alias("folder"), "name",
                        F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("ext"),
                        F.lower(F.col("name")).endswith(".pdf").alias("is_pdf"))


def _all_listings(spark: SparkSession, folders: dict) -> DataFrame:
    parts = [_listing(spark, path, label) for label, path in folders.items()]
    allf = parts[0]
    for p in parts[1:]:
        allf = allf.unionByName(p)
    return allf


def file_inventory(spark: SparkSession, folders: dict) -> DataFrame:
    """A3: ``(folder, ext, files)`` per folder and extension; a missing folder
    contributes nothing. Counts are partial aggregates; names are never
    gathered into one row (see ``inventory_listing``)."""
    return _all_listings(spark, folders).groupBy("folder", "ext").agg(F.count(F.lit(1)).alias("files"))


def inventory_listing(spark: SparkSession, folders: dict) -> DataFrame:
    """A3/A4 names: ``(folder, name, is_pdf)`` sorted by folder and name with a
    distributed sort, so a folder of any size never lands in one row."""
    return _all_listings(spark, folders).select("folder", "name", "is_pdf").orderBy("folder", "name")


def inventory_report(spark: SparkSession, folders: dict) -> DataFrame:
    """A4: per expected folder: exists flag (the "folder doesn't exist"
    marker), file and PDF counts. Sorted names: ``inventory_listing``."""
    expected = spark.createDataFrame([(k, folder_exists(spark, v)) for k, v in folders.items()],
                                     "folder string, exists boolean")
    per = _all_listings(spark, folders).groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.when(F.col("is_pdf"), 1).otherwise(0)).cast("long").alias("pdfs"))
    return (expected.join(per, "folder", "left")
            .select("folder", "exists", F.coalesce("files", F.lit(0)).alias("files"),
                    F.coalesce("pdfs", F.lit(0)).alias("pdfs"))
            .orderBy("folder"))


def list_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """A5: ``*.md`` names of the output folder (count with ``.count()``)."""
    return read_files(spark, folder, "*.md").select(_name().alias("name"))


def write_markdown(docs: DataFrame, folder: str, name_col: str = "output_name",
                   text_col: str = "markdown") -> DataFrame:
    """One UTF-8 file per row, replaced if present; ``(name, ok, error)``
    per row. Committed: see ``sources.markdown_sink``."""
    from pagelane.sources import markdown_sink

    return markdown_sink.write_markdown(docs, folder, name_col, text_col)


def stage_plan(spark: SparkSession, working: str, input_folder: str) -> DataFrame:
    """A8 (plan): PDFs found in the working folder but outside the input
    folder, with the target path they should move to."""
    found = discover_documents(spark, working)
    return found.select("path", "name", F.concat(F.lit(input_folder.rstrip("/") + "/"), F.col("name")).alias("target"))


def _fs_and_path(uri: str):
    """``(pyarrow filesystem, path)`` for local paths, ``file:`` URIs and
    object-store / HDFS URIs alike. Spark's paths are not percent-encoded:
    what follows the scheme is the name as it is."""
    from pyarrow import fs as pafs
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        scheme, rest = uri.split("://", 1)
        authority, _, path = rest.partition("/")
        filesystem, root = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
        return filesystem, f"{root.rstrip('/')}/{path}"
    return pafs.LocalFileSystem(), uri


def read_document(path: str) -> bytes:
    """The bytes of one file, read in a task (local paths, ``file:`` and object-store / HDFS URIs)."""
    filesystem, name = _fs_and_path(path)
    with filesystem.open_input_stream(name, compression=None) as stream:
        return stream.read()


_REPORT = "name string, ok boolean, error string"


def stage_documents(plan: DataFrame) -> DataFrame:
    """A8 (apply): move each planned file, once; ``(name, ok, error)`` per
    file. A failing move does not stop the others, and a target that exists is
    not replaced. A retried task finds its files already at the target and
    reports them as moved (idempotent); the report is a written table, so
    reading it again moves nothing."""
    import pandas as pd

    def move_one(path, target):
        from pyarrow import fs as pafs
        filesystem, src = _fs_and_path(path)
        _, dst = _fs_and_path(target)
        gone = filesystem.get_file_info(src).type == pafs.FileType.NotFound
        there = filesystem.get_file_info(dst).type != pafs.FileType.NotFound
        if gone and there:
            return  # moved by an earlier attempt of this task
        if there:
            raise FileExistsError(f"target exists: {target}")
        filesystem.move(src, dst)

    def move(batches):
        for pdf in batches:
            report = []
            for path, name, target in zip(pdf["path"], pdf["name"], pdf["target"]):
                try:
                    move_one(path, target)
                    report.append((name, True, None))
                except Exception as exc:  # reported, the batch goes on
                    report.append((name, False, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(report, columns=["name", "ok", "error"])

    return stage_table(plan.select("path", "name", "target").mapInPandas(move, _REPORT), "moved")
