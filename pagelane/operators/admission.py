"""Admission of uploaded files.

Input is a ``binaryFile`` listing ``(path, modificationTime, length,
content)``. The rules are one ``CASE``: size is tested before the name and
the header, and ``length`` is a plain column predicate, so the scan can
push it down and never load the content of oversized files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelane.functions import fixed


def verdict(path: Column, length: Column, content: Column) -> Column:
    """``struct(is_valid, reason)``; first failing rule wins."""
    header_ok = F.hex(F.substring(content, 1, 4)) == fixed.PDF_MAGIC_HEX
    reason = (F.when(path.isNull() | (path == ""), F.lit(fixed.MSG_NOT_FOUND))
              .when(length > fixed.MAX_UPLOAD_BYTES, F.lit(fixed.MSG_TOO_LARGE))
              .when(~F.lower(path).endswith(".pdf"), F.lit(fixed.MSG_BAD_TYPE))
              .when(content.isNull(), F.concat(F.lit(fixed.MSG_VALIDATION_ERROR), F.lit("content unreadable")))
              .when(~header_ok, F.lit(fixed.MSG_BAD_MAGIC))
              .otherwise(F.lit(fixed.MSG_VALID)))
    return F.struct((reason == fixed.MSG_VALID).alias("is_valid"), reason.alias("reason"))


def admit(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds ``is_valid`` and ``reason`` to a file listing."""
    v = verdict(F.col(path_col), F.col("length"), F.col("content"))
    return files.withColumn("_v", v).select("*", "_v.is_valid", "_v.reason").drop("_v")


def admit_requested(requested: DataFrame, listing: DataFrame, name_col: str = "name",
                    path_col: str = "path") -> DataFrame:
    """B1 + B5 for requested names: a name missing from the listing is
    ``File not found``. Left join on the name. The join cannot push the size
    rule into the scan, so pass a listing already filtered on ``length``
    (or use ``admit_folder``) when the folder may hold oversized files."""
    files = listing.withColumn(name_col, F.regexp_extract(F.col(path_col), r"([^/]*)$", 1))
    joined = requested.join(files, name_col, "left")
    v = verdict(F.col(path_col), F.col("length"), F.col("content"))
    return joined.withColumn("_v", v).select(name_col, path_col, "length", "_v.is_valid", "_v.reason")


def quarantine(admitted: DataFrame):
    """``(accepted, rejected)``; rejects keep their reason, nothing is dropped."""
    return admitted.filter(F.col("is_valid")), admitted.filter(~F.col("is_valid"))


def admit_folder(spark, folder: str, glob: str | None = None, keep_content: bool = False) -> DataFrame:
    """B1-B6 over a folder without loading oversized files.

    Two scans of the same listing: files above the limit are judged from
    metadata alone (``content`` is pruned from that scan), and only files
    within the limit are read, behind a ``length`` filter that the
    ``binaryFile`` source applies before loading bytes. With
    ``keep_content`` the admitted rows carry their bytes for the next stage.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(folder)
    big = (files.filter(F.col("length") > fixed.MAX_UPLOAD_BYTES)
           .select("path", "modificationTime", "length",
                   F.lit(False).alias("is_valid"), F.lit(fixed.MSG_TOO_LARGE).alias("reason")))
    small = admit(files.filter(F.col("length") <= fixed.MAX_UPLOAD_BYTES))
    if not keep_content:
        return small.drop("content").unionByName(big)
    # ``content`` only for files within the limit (oversized ones get NULL).
    return small.unionByName(big.withColumn("content", F.lit(None).cast("binary")))
