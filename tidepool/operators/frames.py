"""Operators over keyed rows: cumulative history, pending work, variants, splits, batches, gaps, sessions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_dir, stored


def history_join(photos: DataFrame, notes: DataFrame, seq: str, n: str, value: str, out: str = "history") -> DataFrame:
    """Each photo with the values of all notes 1..n of its sequence, in order; frame 0 gives none. Quadratic; see history_window."""
    left, right = photos.select(F.col(seq).alias("_s"), F.col(n).alias("_n")), notes.where(F.col(n) >= 1).select(F.col(seq).alias("_s2"), F.col(n).alias("_m"), F.col(value).alias("_v"))
    both = left.join(right, F.expr("_s = _s2 and _m <= _n"), "left").groupBy("_s", "_n").agg(F.array_sort(F.collect_list(F.when(F.col("_m").isNotNull(), F.struct("_m", "_v")))).alias("_h"))
    return both.select(F.col("_s").alias(seq), F.col("_n").alias(n), F.transform("_h", lambda x: x["_v"]).alias(out))


def history_window(photos: DataFrame, notes: DataFrame, seq: str, n: str, value: str, out: str = "history") -> DataFrame:
    """The same, each note read once: one window per sequence."""
    side = lambda d, own: d.select(F.col(seq).alias("_s"), F.col(n).alias("_n"), (F.struct(F.col(n).alias("_m"), F.col(value).alias("_v")) if own else F.lit(None).cast(F"struct<_m:{dict(notes.dtypes)[n]},_v:{dict(notes.dtypes)[value]}>")).alias("_x"), F.lit(not own).alias("_photo"))
    w = Window.partitionBy("_s").orderBy("_n").rangeBetween(Window.unboundedPreceding, 0)
    both = side(notes.where(F.col(n) >= 1), True).unionByName(side(photos, False)).withColumn("_h", F.array_sort(F.collect_list("_x").over(w)))
    return both.where("_photo").select(F.col("_s").alias(seq), F.col("_n").alias(n), F.transform("_h", lambda x: x["_v"]).alias(out))


def history_offsets(photos: DataFrame, notes: DataFrame, seq: str, n: str) -> tuple[DataFrame, DataFrame]:
    """The cumulative history without copies: (photos with ``upto``, notes with ``place``), a photo's history being its sequence's notes of places 1 to ``upto``.

    A blocked prefix scan: rows are range-partitioned by sequence and number, counted within their partition, and the
    counts of a sequence's earlier partitions are added. So a sequence may be spread over many tasks, and no
    task holds one. Notes numbered under 1 count for nothing; those of one number stand in any order.
    """
    side = lambda d, own: d.select(F.col(seq).alias("_s"), F.col(n).alias("_n"), F.lit(int(own)).cast("long").alias("_own"), (F.struct(*d.columns) if own else F.lit(None).cast(notes.select(F.struct(*notes.columns)).schema[0].dataType)).alias("_row"))
    both = side(notes.where(F.col(n) >= 1), True).unionByName(side(photos, False))
    parted = kept(both.repartitionByRange("_s", "_n").withColumn("_part", F.spark_partition_id()))
    sums = parted.groupBy("_s", "_part").agg(F.sum("_own").alias("_k"))  # a row for each partition and sequence in it
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = sums.select(F.col("_s").alias("_s2"), F.col("_part").alias("_part2"), before.alias("_before"))
    here = Window.partitionBy("_part", "_s").orderBy("_n")
    local = parted.withColumns({"_upto": F.sum("_own").over(here.rangeBetween(Window.unboundedPreceding, 0)), "_place": F.sum("_own").over(here.rowsBetween(Window.unboundedPreceding, 0))})
    local = local.join(carry, F.expr("_s <=> _s2 and _part = _part2"))
    frames = local.where("_own = 0").select(F.col("_s").alias(seq), F.col("_n").alias(n), (F.col("_upto") + F.col("_before")).alias("upto"))
    return frames, local.where("_own = 1").select("_row.*", (F.col("_place") + F.col("_before")).alias("place"))


def matched(photos: DataFrame, notes: DataFrame, key: str, missing: str = "drop") -> DataFrame:
    """Rows with their note. ``missing``: drop, keep, or error (the plan then raises)."""
    if missing == "drop":
        return photos.join(notes, key)
    both = photos.join(notes.withColumn("_found", F.lit(True)), key, "left")
    if missing == "error":
        both = both.where(F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no note for "), F.col(key).cast("string")))).otherwise(F.lit(True)))
    return both.drop("_found")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def insert_missing(new: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What is present, and new rows of keys that are not."""
    return present.unionByName(new.join(present.select(key), key, "left_anti"))


def with_calibration(photos: DataFrame, calibration: DataFrame, key: str) -> DataFrame:
    """One calibration row for all photos of a folder; Spark broadcasts the calibrations while they are under its threshold."""
    return photos.join(calibration, key)


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, repeats and all, by column name."""
    return reduce(DataFrame.unionByName, parts)


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' text only; DuckDB can compute it too."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Ranges of brightness coefficients of the variants (fixed values).
BRIGHTNESS = [(500, 700), (700, 1300), (1300, 1500)]


def variants(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Three rows for each, with ``variant`` and a brightness ``coefficient`` in thousandths from its range."""
    out = rows.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(len(BRIGHTNESS) - 1))))
    u = unit_hash(F.col(key), F.col("variant"), F.lit(seed))
    coefficient = None
    for k, (lo, hi) in enumerate(BRIGHTNESS):
        value = (lo + F.floor(u * (hi - lo))) / 1000
        coefficient = F.when(F.col("variant") == k, value) if coefficient is None else coefficient.when(F.col("variant") == k, value)
    return out.withColumn("coefficient", coefficient)


def jitter(rows: DataFrame, key: str, epoch: int, seed: int = 42) -> DataFrame:
    """Training jitter per epoch: brightness in [0.7, 1.3) or 1, angle in [-30, 30) or 0, each for half of the rows."""
    u = lambda k: unit_hash(F.col(key), F.lit(epoch), F.lit(seed), F.lit(k))
    return rows.withColumns({"brightness": F.when(u(0) < 0.5, 0.7 + 0.6 * u(1)).otherwise(1.0), "angle": F.when(u(2) < 0.5, -30 + 60 * u(3)).otherwise(0.0)})


#: Rows that one task ranks at the border of a split.
RANKED_ROWS = 1_000_000


def exact_split(rows: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``split``: test for exactly ceil(share * n) rows, train for the others, by hash order.

    The order is total, but no task ranks all rows: hashes are counted by their first
    digits, which tells the one group of them that the border runs through; digits are added
    until that group is small, and only it is ranked.
    """
    h = rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))))
    edge, before, want, n = "", 0, None, 0
    while want is None or (n > RANKED_ROWS and len(edge) < 30):
        sizes = h.where(F.startswith("_h", F.lit(edge))).groupBy(F.substring("_h", 1, len(edge) + 3).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # at most 4096 rows
        want = math.ceil(share * sum(r.n for r in sizes) - 1e-9) if want is None else want
        for r in sizes:
            edge, n = r.p, r.n
            if before + n >= want:
                break
            before += n
    head = F.substring("_h", 1, len(edge))
    rank = F.row_number().over(Window.partitionBy(head).orderBy("_h", key))
    inner = h.where(head == F.lit(edge)).withColumn("split", F.when(rank <= want - before, "test").otherwise("train"))
    outer = h.where(head != F.lit(edge)).withColumn("split", F.when(head < F.lit(edge), "test").otherwise("train"))
    return outer.unionByName(inner).drop("_h")


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` written once, now, to the folder that executors share."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()


def numbered(rows: DataFrame, *order: str, out: str = "idx") -> DataFrame:
    """A dense number from 0 in total order, without ranking all rows in one task.

    Rows are range-partitioned and sorted; each partition's offset is the sum of the
    sizes before it. The ranked rows are checkpointed when this is called, so both passes read the same
    ones, also after the loss of an executor.  Rows that ``order`` does not tell apart are numbered in any order.
    """
    parted = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    local = kept(parted.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row per partition
    return local.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_rank") - 1).drop("_part", "_rank", "_start")


def first_successes(rows: DataFrame, judge: Callable[[DataFrame], DataFrame], n: int, idx: str = "idx", by: str | None = None, first: int | None = None) -> DataFrame:
    """The ``n`` successes of least ``idx``, of each ``by`` if given, without judging all rows.

    ``judge`` takes some of the rows and gives those that succeed.  It is tried on ranges of numbers, from the
    first on; each next range is as long as the rate of success so far asks for, at most four times the one before.  Groups
    that have their ``n`` are left out of later ranges.  Runs when called, a job a range; keep ``rows`` as a stored table.
    """
    top = rows.agg(F.max(idx)).first()[0]
    lo, size, found, done = 0, first or 2 * n, rows.limit(0), None
    while top is not None and lo <= top:
        part = rows.where((F.col(idx) >= lo) & (F.col(idx) < lo + size))
        if done is not None:
            part = part.join(done, by, "left_anti")
        found = found.unionByName(stored(judge(part), "successes"))
        lo += size
        if by is None:
            have = found.count()
            if have >= n:
                break
            size = min(max(math.ceil(1.25 * (n - have) * lo / max(have, 1)), size), 4 * size)
        else:
            done = stored(found.groupBy(by).count().where(F.col("count") >= n).select(by), "groups-done")
            if not rows.where(F.col(idx) >= lo).join(done, by, "left_anti").limit(1).count():
                break
            size = 4 * size
    if by is None:
        return found.orderBy(idx).limit(n)
    return found.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(idx))).where(F.col("_k") <= n).drop("_k")  # a group has what few ranges hold


def at_least_one(rows: DataFrame, what: str = "rows") -> DataFrame:
    """``rows``, or an error now if there are none."""
    if not rows.limit(1).count():
        raise RuntimeError(f"no {what}")
    return rows


def preview(rows: DataFrame, *order: str, n: int = 3) -> DataFrame:
    """The first ``n`` rows in an order; what it does not tell apart is ordered by all other columns."""
    return rows.orderBy(*order, *[c for c in rows.columns if c not in order]).limit(n)


def mean_of_batch_means(rows: DataFrame, error: Column, idx: str, batch: int) -> DataFrame:
    """loss: the unweighted mean of batch means; a short last batch weighs as much as a full one."""
    means = rows.groupBy(F.floor(F.col(idx) / batch).alias("_b")).agg(F.avg(error).alias("_m"))
    return means.agg(F.avg("_m").alias("loss"))


def progress(idx: Column, n: Column, step: int = 5) -> Column:
    """Percent reported after photo ``idx`` (from 0) of ``n``: rises by ``step`` at most once a photo."""
    return step * F.least(idx, F.floor(idx * (100 // step) / n)).cast("int")


def epoch_order(rows: DataFrame, key: str, epoch: int, seed: int = 42, out: str = "idx") -> DataFrame:
    """``rows`` numbered from 0 in a random order of their own for each epoch; the same for the same key, epoch and seed."""
    mixed = rows.withColumn("_o", F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(epoch), F.lit(seed))))
    return numbered(mixed, "_o", key, out=out).drop("_o")


def stack_batches(rows: DataFrame, idx: str, size: int, *columns: str) -> DataFrame:
    """A row for each ``size`` neighbours by ``idx``: ``batch``, and of each column an array in that order; arrays of unequal length in one batch raise."""
    item = F.struct(F.col(idx).alias("_i"), *[F.col(c) for c in columns])
    got = rows.groupBy(F.floor(F.col(idx) / size).alias("batch")).agg(F.array_sort(F.collect_list(item)).alias("_x"))  # at most ``size`` rows each
    out = []
    of = lambda c: F.transform("_x", lambda x: x[c])
    for c in columns:
        stacked = of(c)
        if dict(rows.dtypes)[c].startswith("array"):
            even = F.size(F.array_distinct(F.transform(stacked, lambda v: F.size(v)))) <= 1
            stacked = F.when(even, stacked).otherwise(F.raise_error(F.lit(f"{c}: unequal lengths in a batch")).cast(f"array<{dict(rows.dtypes)[c]}>"))
        out.append(stacked.alias(c))
    return got.select("batch", *out)


def collated(rows: DataFrame, idx: str, size: int, collate: Callable, schema: str) -> DataFrame:
    """``collate`` (pandas frame of one batch, in order, to pandas frame) over each ``size`` neighbours by ``idx``."""
    return rows.withColumn("_b", F.floor(F.col(idx) / size)).groupBy("_b").applyInPandas(lambda part: collate(part.sort_values(idx).drop(columns="_b")), schema)


def first_gap(ids: DataFrame, column: str) -> DataFrame:
    """gap: the least number from 0 that no row has."""
    own = ids.where(F.col(column) >= 0).select(F.col(column).cast("long").alias("_n")).distinct()
    after = own.select((F.col("_n") + 1).alias("_n")).unionByName(ids.sparkSession.createDataFrame([(0,)], "_n long"))
    return after.join(own, "_n", "left_anti").agg(F.min("_n").alias("gap"))


def fold_points(events: DataFrame, user: str, time: str, kind: str, x: str, y: str, reach: float = 10.0, most: int | None = None) -> DataFrame:
    """Last point list of each session: down near a point takes it up, else adds one (which is not taken up); move sets it; up lets go; reset clears.

    With ``most``, a down beyond so many points adds none.
    One session's events are folded in order of time; sessions are bounded by what one person clicks.
    """
    step = F.struct(F.col(time).alias("t"), F.col(kind).alias("kind"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    start = F.expr("named_struct('pts', cast(array() as array<struct<x:double,y:double>>), 'held', -1)")

    def fold(acc: Column, e: Column) -> Column:
        pts, held = acc["pts"], acc["held"]
        here = F.struct(e["x"].alias("x"), e["y"].alias("y"))
        near = F.coalesce(F.array_min(F.filter(F.transform(pts, lambda p, i: F.when((F.abs(p["x"] - e["x"]) < reach) & (F.abs(p["y"] - e["y"]) < reach), i)), lambda i: i.isNotNull())), F.lit(-1))
        state = lambda p, h: F.struct(p.alias("pts"), h.cast("int").alias("held"))
        room = F.size(pts) < most if most is not None else F.lit(True)
        return (
            F.when((e["kind"] == "down") & (near >= 0), state(pts, near))
            .when((e["kind"] == "down") & room, state(F.concat(pts, F.array(here)), held))
            .when((e["kind"] == "move") & (held >= 0), state(F.transform(pts, lambda p, i: F.when(i == held, here).otherwise(p)), held))
            .when(e["kind"] == "up", state(pts, F.lit(-1)))
            .when(e["kind"] == "reset", state(F.slice(pts, 1, 0), F.lit(-1)))
            .otherwise(state(pts, held))
        )

    done = events.groupBy(user).agg(F.array_sort(F.collect_list(step)).alias("_e"))
    return done.select(user, F.aggregate("_e", start, fold, lambda s: s["pts"]).alias("points"))


def history_of_losses(losses: DataFrame, epoch: str, split: str, loss: str) -> DataFrame:
    return losses.groupBy(epoch, split).agg(F.avg(loss).alias(loss))
