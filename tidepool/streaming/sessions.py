"""The fold of pointer events to point lists: over sorted rows, and as a stream that keeps its place over restarts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POINTS = "array<struct<x:double,y:double>>"


def step(state: tuple[list, int], event: tuple, reach: float, most: int | None) -> tuple[list, int]:
    """(points, the one held or -1) after one event (kind, x, y): as ``fold_points`` has it."""
    (points, held), (kind, x, y) = state, event
    if kind == "down":
        near = next((i for i, p in enumerate(points) if abs(p[0] - x) < reach and abs(p[1] - y) < reach), -1)
        if near >= 0:
            return points, near
        return ([*points, [x, y]], held) if most is None or len(points) < most else (points, held)
    if kind == "move" and held >= 0:
        return [[x, y] if i == held else p for i, p in enumerate(points)], held
    if kind == "up":
        return points, -1
    if kind == "reset":
        return [], -1
    return points, held


def fold_sorted(events: DataFrame, user: str, kind: str, x: str, y: str, *order: str, reach: float = 10.0, most: int | None = None) -> DataFrame:
    """user, points: what ``fold_points`` gives, for sessions of any length: events of a user pass a task in order, which holds nothing but the points.

    A fold is in order by its nature, so a user is one task's work, but never its memory. What comes before a user's last reset
    is not sent.
    """
    resets = events.where(F.col(kind) == "reset").groupBy(user).agg(F.max(F.struct(*order)).alias("_reset")).withColumnRenamed(user, "_user")
    own = events.join(resets, F.expr(f"`{user}` <=> _user"), "left").where(F.col("_reset").isNull() | (F.struct(*order) >= F.col("_reset")))
    rows = own.select(F.col(user).alias("_u"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(kind).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    keys = ["_u", *[f"_o{k}" for k in range(len(order))]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kind_of = None, None, None

        def folded() -> pa.RecordBatch:
            points = [{"x": a, "y": b} for a, b in state[0]]
            return pa.RecordBatch.from_arrays([pa.array([at], kind_of), pa.array([points], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], ["user", "points"])

        for part in parts:
            kind_of = part.schema.field("_u").type
            for u, *event in zip(*(part.column(c).to_pylist() for c in ("_u", "_k", "_x", "_y")), strict=True):
                if state is None or u != at:
                    if state is not None:
                        yield folded()
                    at, state = u, ([], -1)
                state = step(state, tuple(event), reach, most)
        if state is not None:
            yield folded()

    schema = f"user {rows.schema['_u'].dataType.simpleString()}, points {POINTS}"
    return rows.repartition("_u").sortWithinPartitions(*keys).mapInArrow(run, schema).withColumnRenamed("user", user)


class Fold(StatefulProcessor):
    """State of a user: points and hold up to the watermark, and the events after it, which may still be joined by earlier ones."""

    def __init__(self, reach: float, most: int | None):
        self.reach, self.most = reach, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", StructType([StructField("state", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        points, held, waiting = json.loads(self.state.get()[0]) if self.state.exists() else ([], -1, [])
        for part in rows:
            waiting += [[int(t), str(o), kind, x, y] for t, o, kind, x, y in zip(part["t"].astype("datetime64[us]").astype("int64"), part["tie"], part["kind"], part["x"].astype(float), part["y"].astype(float), strict=True)]
        waiting.sort(key=lambda e: (e[0], e[1]))
        sure = 1000 * timerValues.getCurrentWatermarkInMs()  # nothing before it comes any more
        now, done = (points, held), 0
        for e in waiting:
            now = step(now, e[2:], self.reach, self.most)
            if e[0] < sure:
                points, held, done = *now, done + 1
        self.state.update((json.dumps([points, held, waiting[done:]]),))
        yield pd.DataFrame({"user": [key[0]], "points": [[{"x": x, "y": y} for x, y in now[0]]]})

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, user: str, time: str, kind: str, x: str, y: str, tie: str | None = None, reach: float = 10.0, most: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """A streaming frame of user, points: of each user with new events, the list after all events so far in order of time, then of ``tie`` as text.

    Events may come in any order as long as they are not behind the watermark, the greatest time seen in earlier
    batches less ``delay``; what is behind it is late and does not count.  State of a user is its points and the
    events after the watermark.  Write it with ``update`` mode; the session needs the RocksDB state store (``PROVIDER``).
    """
    rows = events.select(F.col(user).alias("user"), F.col(time).cast("timestamp").alias("t"), (F.col(tie) if tie else F.lit("")).cast("string").alias("tie"), F.col(kind).alias("kind"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kind_of_user = rows.schema["user"].dataType.simpleString()
    return rows.withWatermark("t", delay).groupBy("user").transformWithStateInPandas(Fold(reach, most), f"user {kind_of_user}, points {POINTS}", "Update", "EventTime")
