"""Folders listed by executors, level by level.

The frontier is a table of folders; each round its folders are dealt to tasks, which list them, and the
sub-folders found are the next frontier.  So the driver sees no names, only how many folders are left, and
a tree of any width takes as many rounds as it is deep.  Unlike Spark's file index this finds files without
bytes and folders without files.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import opened, stored

ENTRY = "path string, parent string, name string, is_folder boolean, length long, modified timestamp, level int"
#: Folders that one task lists, at most.
FOLDERS = 500


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the folders ``path``; one that does not exist has none."""
    from pyarrow import fs

    for batch in batches:
        for folder, level in zip(batch.column("path").to_pylist(), batch.column("level").to_pylist(), strict=True):
            store, at, before = opened(folder)
            found = [x for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type in (fs.FileType.File, fs.FileType.Directory)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([before + x.path for x in found], pa.string()),
                    pa.array([before + at] * len(found), pa.string()),
                    pa.array([x.base_name for x in found], pa.string()),
                    pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_()),
                    pa.array([x.size or 0 for x in found], pa.int64()),
                    pa.array([x.mtime_ns // 1000 for x in found], pa.timestamp("us", "UTC")),
                    pa.array([level + 1] * len(found), pa.int32()),
                ],
                ["path", "parent", "name", "is_folder", "length", "modified", "level"],
            )


def tree(spark: SparkSession, root: str, levels: int | None = None) -> DataFrame:
    """Files and folders below ``root``, of the first ``levels`` levels or of all; a missing root has none."""
    levels = levels if levels is None or levels > 0 else 0
    frontier, n, found, level = spark.createDataFrame([(root.rstrip("/") or "/", 0)], "path string, level int"), 1, [], 0
    while n and (levels is None or level < levels):
        rows = frontier.repartition(-(-n // FOLDERS), "path").mapInArrow(listed, ENTRY)
        rows = stored(rows, "folders")
        found.append(rows)
        frontier = rows.where("is_folder").select("path", "level")
        n, level = frontier.count(), level + 1
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], ENTRY)


def files_in(entries: DataFrame, pattern: str) -> DataFrame:
    """Files of a name that fits."""
    return entries.where(~F.col("is_folder") & F.rlike("name", F.lit(pattern)))


def sub_folders(entries: DataFrame, level: int = 1) -> DataFrame:
    """path, name of the folders of one level, whatever is in them."""
    return entries.where(F.col("is_folder") & (F.col("level") == level)).select("path", "name")
