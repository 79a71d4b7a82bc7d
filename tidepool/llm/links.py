"""Connected components of links, and groups dealt in blocks, for the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freed, stored

#: Links that a task shortens at a time (about 100 MB), and those of a task in the rounds after.
HELD, TASK_LINKS = 1_000_000, 200_000


def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links u, v (v the lesser) with the same components as those of ``batches`` (a, b): of each ``HELD``, every id's link with the least id that it reaches by them."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b"))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots(at[: len(a)], at[len(a) :], len(ids))
        own = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= HELD:
            yield stars()
            held = []
    if held:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. ``links``: a, b.

    Alternating large and small stars: every id's larger, then smaller, neighbours are
    hung on its least neighbour, until every id has one link, with its component's least. Tasks shorten the
    links that they read to stars before that, so that few rounds are left.
    Neighbours are reduced to their minimum before each shuffle; a hub's share of the joins is left to skew handling:
    a join's sides are shuffled for it alone, which lets Spark split a hub.
    Each step is stored, so lineage stays short, in as many files as its rows ask for, whatever the number of
    partitions of a shuffle, and deleted once the next ones have been made of it.
    """
    spark = links.sparkSession
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    links = stored(links.where("a != b").select("a", "b").mapInArrow(shortened, "u long, v long"), "links")
    now = state(links)
    while True:
        tasks = max(spark.sparkContext.defaultParallelism, -(-2 * now[0] // TASK_LINKS))
        put = lambda df, name: stored(df.coalesce(tasks), name)  # noqa: B023, E731
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = put(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "links-least")
        large = put(both.join(least, F.expr("u = w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct(), "links-large")
        freed(links, least)
        down = put(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"), "links-down")
        mark, now = now, state(large)
        if now == mark and down.count() == now[0]:
            freed(down)
            break
        small = large.join(down, F.expr("u = w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = put(small.where("u != v").coalesce(tasks).distinct(), "links")
        freed(large, down)
        now = state(links)
    least = large.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return large.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(least)


def in_blocks(rows: DataFrame, keys: list[str], by: str, n: str, most: int) -> DataFrame:
    """Deal the rows of each group so that any two meet in one block pair (b1, b2), b1 <= b2, of at most about 2 * ``most`` rows.

    Groups of up to ``most`` rows are one block.  A larger one is cut into blocks by hash
    of ``by``; each row goes to the pairs that its block is in.  ``half`` tells which side it is on.
    """
    k = F.ceil(F.col(n) / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64(by), k).cast("int")
    dealt = rows.withColumns({"_k": k}).withColumn("_own", own)
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    dealt = dealt.withColumns({"b1": F.least("_o", "_own"), "b2": F.greatest("_o", "_own"), "half": (F.col("_own") > F.col("_o")).cast("int")})
    out = dealt.drop("_k", "_o", "_own")
    order = [*keys, "b1", "b2"]
    return out.repartition(*order).sortWithinPartitions(*order)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches in order of the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(c[0].as_py() for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1].as_py() for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For ``n`` places, linked by the pairs a, b: the least place of each one's component."""
    r = np.arange(n)
    while True:
        low = np.minimum(r[a], r[b])
        new = r.copy()
        np.minimum.at(new, r[a], low)
        np.minimum.at(new, r[b], low)
        new = new[new]
        new = new[new]
        if (new == r).all():
            return r
        r = new
