"""Folders that every executor sees, tables written there, and table reading."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few numbers each (about 50 MB); beyond, both sides are shuffled.
SMALL_ROWS = 1_000_000


#: Rows that go to Python at a time, unless the session has a number of its own: texts are long, and both sides hold a batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, one in the warehouse, under a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held.rsplit("/", 1)[0]
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidepool"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder: lineage ends here and lost executors cost nothing before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as zstd Parquet in the shared folder and read it back; for wide or long tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def freed(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote; nothing that reads them may run any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at the end, but for those handed to what this gives."""
    made: list[DataFrame] = []
    kept: list[str] = []
    _scratch.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._stored_at)
        return df

    try:
        yield keep
    finally:
        _scratch.remove(made)
        freed(*[df for df in made if df._stored_at not in kept])


def free_name(taken: list[str], name: str) -> str:
    """``name``, longer by as many underscores as it takes to differ from all names in ``taken``."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def small_or_joined(rows: DataFrame, side: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` (a stored table of narrow rows), which is broadcast only if counted small."""
    few = side.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return rows.join(F.broadcast(side) if few else side, on, how)


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the given internal names; extra or clashing columns of the caller go."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])
