"""Rows by number: a dataset whose ``[i]`` and ``[i:j]`` open only the files that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

INDEX = "_ranges"


def write_numbered(rows: DataFrame, path: str, idx: str = "idx", files: int | None = None) -> None:
    """``rows`` as Parquet, clustered by their number, and beside it a row a file with the numbers that it holds."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(files, idx) if files else rows.repartitionByRange(idx)
    dealt.sortWithinPartitions(idx).write.mode("overwrite").parquet(path)
    spans = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col(idx).alias("i")).groupBy("file").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count(F.lit(1)).alias("n"))
    spans.coalesce(1).sortWithinPartitions("lo").write.mode("overwrite").parquet(f"{path}/{INDEX}")  # a row for each file


class Numbered:
    """``len``, ``[i]`` (a row; from the end if negative) and ``[i:j]`` (a DataFrame in order) of what ``write_numbered`` wrote."""

    def __init__(self, spark: SparkSession, path: str, idx: str = "idx"):
        self.spark, self.path, self.idx = spark, path.rstrip("/"), idx
        self.index = spark.read.parquet(f"{self.path}/{INDEX}")
        self.schema = spark.read.parquet(self.path).schema
        self.n = self.index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def __len__(self) -> int:
        return self.n

    def part(self, lo: int, hi: int) -> DataFrame:
        """Rows of the numbers from ``lo`` up to ``hi``, without it."""
        held = self.index.where((F.col("lo") < hi) & (F.col("hi") >= lo)).select("file").collect() if hi > lo else []
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r.file}" for r in held]).where((F.col(self.idx) >= lo) & (F.col(self.idx) < hi))

    def __getitem__(self, at: int | slice) -> Row | DataFrame:
        if isinstance(at, slice):
            lo, hi, step = at.indices(self.n)
            if step < 1:
                raise ValueError("a step must be at least 1")
            rows = self.part(lo, hi)
            return (rows.where((F.col(self.idx) - lo) % step == 0) if step > 1 else rows).orderBy(self.idx)
        if not -self.n <= at < self.n:
            raise IndexError(f"{at} of {self.n} rows")
        return self.part(at % self.n, at % self.n + 1).first()
