"""Folder trees listed level by level.

The folders of one level are rows of a table; tasks list them through the file
system of the path, a share of the folders each, and write what they find. The
folders among the entries are the next level. So neither the driver nor one task
holds the listing, and a lost task lists its own folders again. A folder that has
been listed under its real path is not listed again, which ends symbolic links
that lead back; of several links to one folder on a level, the first path counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelane.session import stage_table
from pagelane.sources.files import _fs_and_path

MAX_DEPTH = 64
FOLDERS_PER_TASK = 64
_ENTRY = "folder string, folder_real string, name string, path string, real string, is_folder boolean, length long, modified timestamp"
_ROWS = 4_096


def _entries(folder: str):
    """``_ENTRY`` rows of one folder; one that is gone has none."""
    import os

    from pyarrow import fs as pafs
    filesystem, path = _fs_and_path(folder)
    local = isinstance(filesystem, pafs.LocalFileSystem)

    def real(p):
        return os.path.realpath(p) if local else p
    own = real(path)
    for info in filesystem.get_file_info(pafs.FileSelector(path, recursive=False, allow_not_found=True)):
        if info.type not in (pafs.FileType.File, pafs.FileType.Directory):
            continue  # a link that leads nowhere
        is_folder = info.type == pafs.FileType.Directory
        yield (folder, own, info.base_name, f"{folder.rstrip('/')}/{info.base_name}", real(info.path) if is_folder else None, is_folder,
               None if is_folder else info.size, info.mtime)


def _list_folders(batches):
    from itertools import islice

    import pandas as pd
    names = [c.strip().split(" ")[0] for c in _ENTRY.split(",")]
    for pdf in batches:
        rows = (entry for folder in pdf["path"] for entry in _entries(folder))
        while chunk := list(islice(rows, _ROWS)):
            frame = pd.DataFrame(chunk, columns=names)
            frame["length"] = frame["length"].astype("Int64")
            frame["modified"] = pd.to_datetime(frame["modified"], utc=True).dt.tz_localize(None)
            yield frame


def list_tree(spark: SparkSession, root: str, max_depth: int = MAX_DEPTH, folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """``(folder, name, path, is_folder, length, modified, depth)`` of all entries under ``root``, ``depth`` from 0.

    Folders at depth ``max_depth - 1`` are entries, but are not opened. A root that
    does not exist gives no rows."""
    frontier = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    levels, seen, size = [], [], 1
    for depth in range(max_depth):
        tasks = max(1, -(-size // folders_per_task))
        listed = stage_table(frontier.repartition(tasks, "path").mapInPandas(_list_folders, _ENTRY), f"tree-{depth}")
        levels.append(listed.withColumn("depth", F.lit(depth)))
        seen.append(listed.select(F.col("folder_real").alias("_seen")))
        known = seen[0]
        for part in seen[1:]:  # one table a level
            known = known.unionByName(part)
        found = listed.filter("is_folder").groupBy("real").agg(F.min("path").alias("path"))
        frontier = stage_table(found.join(known.distinct(), F.col("real") == F.col("_seen"), "left_anti").select("path"), f"folders-{depth}")
        size = frontier.count()
        if not size:
            break
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out.select("folder", "name", "path", "is_folder", "length", "modified", "depth")
