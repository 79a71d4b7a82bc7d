"""New files only: a file stream that stops when it has caught up, and tables that take each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.photos import files, in_store

FILE = "path string, modificationTime timestamp, length long, content binary"


def process_new(spark: SparkSession, folder: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], glob: str = "*") -> None:
    """Files that no earlier call has seen, transformed and appended to ``out`` as Parquet, each exactly once."""
    stream = new_files(spark, folder, glob)
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def new_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


class Ledger:
    """A keyed table that grows by batches: ``rows/batch=<id>`` as Parquet, and an empty file ``ledger/<id>`` for each batch that counts.

    A batch is written to its own folder, over what an attempt before has left, and then entered; only
    entered batches are read.  A batch that is entered already is not taken again, so a replay changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[int]:
        """Ids of the batches that count; a number each."""
        at, store = in_store(self.spark, f"{self.path}/ledger")
        return sorted(int(x.getPath().getName()) for x in store.listStatus(at)) if store.exists(at) else []

    def rows(self) -> DataFrame | None:
        done = self.batches()
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/batch={k}" for k in done]) if done else None

    def take(self, batch: DataFrame, batch_id: int) -> bool:
        """Add a batch unless it is in already; whether it was added."""
        if batch_id in self.batches():
            return False
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        at, store = in_store(self.spark, f"{self.path}/ledger/{batch_id}")
        store.create(at, True).close()
        return True


def insert_new(spark: SparkSession, folder: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str, glob: str = "*", after_write: Callable[[int], None] | None = None) -> None:
    """Rows of new files whose ``key`` the ledger at ``out`` has not: what is there stays; of several rows of a key in one batch that of the least values stays.

    ``after_write`` is called with the id of each batch taken.
    """
    ledger = Ledger(spark, out)

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch)
        rest = Window.partitionBy(key).orderBy(*rows.columns)
        rows = rows.withColumn("_k", F.row_number().over(rest)).where(F.col("_k") == 1).drop("_k")
        known = ledger.rows()
        if known is not None:
            rows = rows.join(known.select(key), key, "left_anti")
        if ledger.take(rows, batch_id) and after_write:
            after_write(batch_id)

    _run(new_files(spark, folder, glob), take, checkpoint)


def follow_changes(spark: SparkSession, folder: str, out: str, transform: Callable[[DataFrame], DataFrame], glob: str = "*") -> bool:
    """Rows of files that are new or have another time than when they were taken, for ``latest`` to choose from; whether there were any.

    A file stream takes a path once, whatever becomes of it; so paths and times are compared with what the ledger at ``out`` has.
    ``transform`` must keep path and modificationTime.  A call that was broken off is made good by the next, under the same batch id.
    """
    ledger = Ledger(spark, out)
    found, known = files(spark, folder, glob, recursive=True), ledger.rows()
    if known is not None:
        found = found.join(known.select("path", "modificationTime"), ["path", "modificationTime"], "left_anti")
    if not found.select("path").limit(1).count():
        return False
    return ledger.take(transform(found), max(ledger.batches(), default=-1) + 1)


def latest(spark: SparkSession, out: str, key: str, time: str) -> DataFrame | None:
    """Of each ``key`` the row of the greatest ``time``, then of the last batch; None before the first batch."""
    rows = Ledger(spark, out).rows()
    if rows is None:
        return None
    newest = rows.groupBy(key).agg(F.max(F.struct(time, "batch", F.struct(*[c for c in rows.columns if c != "batch"]).alias("row"))).alias("m"))
    return newest.select("m.row.*")


def _run(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
