"""A file for each row, visible all at once: a data source writer with staging, manifest and commit.

Tasks write under ``_staging-<job>`` in the output folder, each attempt in a folder of its own, with a
list of what it wrote; an attempt that fails leaves nothing that anyone reads.  When all tasks are done
the driver writes one small file, ``commit``, with the names of the lists of the attempts that count.  Up to there no
file is visible; from there the job is decided, and ``publish`` has tasks move the files to their names.  A
move that was done before is not done again, so ``publish`` may be broken off and repeated (``recover`` does that for all
decided jobs of a folder, and deletes the staging of undecided ones).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .store import opened

FORMAT = "tidepool_files"


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class StagedWriter(DataSourceWriter):
    """Rows of name, content (binary); a null content writes nothing."""

    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def staging(self) -> str:
        return f"{self.folder}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        store, at, _ = opened(self.staging())
        attempt = uuid.uuid4().hex
        store.create_dir(f"{at}/{attempt}", recursive=True)
        names: list[str] = []
        for row in iterator:
            if row.content is None:
                continue
            with store.open_output_stream(f"{at}/{attempt}/{len(names)}") as out:
                out.write(bytes(row.content))
            names.append(row.name)
        with store.open_output_stream(f"{at}/{attempt}/names") as out:
            out.write(json.dumps(names).encode())
        return Written(attempt, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, at, _ = opened(self.staging())
        store.create_dir(at, recursive=True)
        done = [m.attempt for m in messages if m is not None and m.files]
        with store.open_output_stream(f"{at}/commit.part") as out:
            out.write(json.dumps(done).encode())
        store.move(f"{at}/commit.part", f"{at}/commit")

    def abort(self, messages: list[Written | None]) -> None:
        store, at, _ = opened(self.staging())
        store.delete_dir_contents(at, missing_dir_ok=True)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return StagedWriter(self.options["path"].rstrip("/"), self.options["job"])


def stage(rows: DataFrame, folder: str, content: str = "content") -> str:
    """Write ``rows`` (name and a binary or text column) to staging, and decide the job; its name."""
    job = uuid.uuid4().hex
    rows.sparkSession.dataSource.register(Files)
    body = F.col(content) if dict(rows.dtypes)[content] == "binary" else F.encode(content, "UTF-8")
    rows.select("name", body.alias("content")).write.format(FORMAT).option("path", folder).option("job", job).mode("append").save()
    return job


def publish(spark: SparkSession, folder: str, job: str, overwrite: bool = True) -> None:
    """Move a decided job's files to their names and delete its staging; without ``overwrite`` names that exist keep what they have."""
    from pyarrow import fs

    folder = folder.rstrip("/")
    store, at, _ = opened(f"{folder}/_staging-{job}")
    with store.open_input_stream(f"{at}/commit") as f:
        attempts = json.loads(f.read())  # one for each task

    def move(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at, _ = opened(f"{folder}/_staging-{job}")
        _, root, _ = opened(folder)
        for part in parts:
            for attempt in part["attempt"]:
                with store.open_input_stream(f"{at}/{attempt}/names") as f:
                    names = json.loads(f.read())
                n, made = 0, set()
                for k, name in enumerate(names):
                    staged, final = f"{at}/{attempt}/{k}", f"{root}/{name}"
                    if store.get_file_info(staged).type == fs.FileType.NotFound or not overwrite and store.get_file_info(final).type != fs.FileType.NotFound:
                        continue
                    if (above := final.rsplit("/", 1)[0]) not in made:
                        store.create_dir(above, recursive=True)
                        made.add(above)
                    store.move(staged, final)
                    n += 1
                yield pd.DataFrame({"n": [n]})

    if attempts:
        rows = spark.createDataFrame([(a,) for a in attempts], "attempt string")
        rows.repartition(len(attempts)).mapInPandas(move, "n long").agg(F.sum("n")).collect()
    store.delete_dir(at)


def write_committed(rows: DataFrame, folder: str, content: str = "content", overwrite: bool = True) -> None:
    """``rows`` as files named ``name`` below ``folder``, all or none of them; of rows of one name any one stays."""
    publish(rows.sparkSession, folder, stage(rows, folder, content), overwrite)


def recover(spark: SparkSession, folder: str, overwrite: bool = True) -> list[str]:
    """Finish jobs that were decided and broken off, and drop staging of those that never were; what was finished. Not while a job writes there."""
    from pyarrow import fs

    store, at, _ = opened(folder.rstrip("/"))
    left = [x for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.base_name.startswith("_staging-")]
    done = []
    for x in left:
        if store.get_file_info(f"{x.path}/commit").type == fs.FileType.File:
            done.append(x.base_name.removeprefix("_staging-"))
            publish(spark, folder, done[-1], overwrite)
        else:
            store.delete_dir(x.path)
    return done
