"""Tables kept between jobs, in a folder that all executors reach, and files of a store as tasks see them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a counted table is broadcast.
FEW_ROWS = 200_000

_made: dict[str, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is set, one in the warehouse, which executors share as well."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidepool"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written now as Parquet in the shared folder, and read from there; ``cleared`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _made[path] = out
    return out


def cleared(spark: SparkSession) -> int:
    """Delete what ``stored`` has written in this process; nothing that reads it may run any more. How many tables went."""
    paths = list(_made)
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        del _made[path]
    return len(paths)


def is_small(df: DataFrame, most: int = FEW_ROWS) -> bool:
    """Whether ``df`` has at most so many rows; counts no further."""
    return df.limit(most + 1).count() <= most


def opened(uri: str):
    """(pyarrow file system, path in it, what stands before such paths in Spark's) of a path or URI as Spark writes it, not encoded."""
    from pyarrow import fs

    if local := re.match(r"(?:file:/*(?=/))?(/.*)$", uri):
        return fs.LocalFileSystem(), local[1], "file:"
    scheme, host, path = re.match(r"([\w+.-]+)://([^/]*)(.*)$", uri).groups()
    store, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    base = base.rstrip("/")
    return store, base + path, f"{scheme}://" + ("" if base else host)
