"""Joins of points by nearness, over a grid of cells as wide as the reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points about a cell that each click in it looks at first.
FIRST = 32


def cell(v: Column, reach: float) -> Column:
    return F.floor(v / F.lit(float(reach)))


def around(points: DataFrame, point: str, reach: float, group: tuple[str, ...], x: str, y: str) -> DataFrame:
    """Each point in the nine cells about its own."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    own = points.select(F.col(point).alias("_p"), F.col(x).alias("_px"), F.col(y).alias("_py"), *[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)])
    return own.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns({"_pi": cell(F.col("_px"), reach) + F.col("_i"), "_pj": cell(F.col("_py"), reach) + F.col("_j")}).drop("_i", "_j")


def inside(clicks: DataFrame, click: str, reach: float, group: tuple[str, ...], x: str, y: str) -> DataFrame:
    """Each click in its cell."""
    return clicks.select(F.col(click).alias("_c"), F.col(x).alias("_cx"), F.col(y).alias("_cy"), *[F.col(c).alias(f"_h{k}") for k, c in enumerate(group)]).withColumns({"_ci": cell(F.col("_cx"), reach), "_cj": cell(F.col("_cy"), reach)})


def within(reach: float, disc: bool, group: tuple[str, ...]) -> Column:
    dx, dy = F.col("_px") - F.col("_cx"), F.col("_py") - F.col("_cy")
    near = (dx * dx + dy * dy <= reach * reach) if disc else (F.abs(dx) < reach) & (F.abs(dy) < reach)
    same = (F.col("_ci") == F.col("_pi")) & (F.col("_cj") == F.col("_pj"))
    for k in range(len(group)):
        same &= F.col(f"_g{k}") == F.col(f"_h{k}")
    return same & near


def nearby(clicks: DataFrame, points: DataFrame, click: str, point: str, reach: float, disc: bool = False, group: tuple[str, ...] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (click, point) within reach: less than it in each axis, or with ``disc`` at most it as the crow flies; in one ``group``, if given.

    Each point stands in the nine cells about its own, so a click looks into one; the join is on the cell, which
    Spark shuffles and splits where it is skewed.  Null places are near nothing.
    """
    return inside(clicks, click, reach, group, x, y).join(around(points, point, reach, group, x, y), within(reach, disc, group)).select(F.col("_c").alias(click), F.col("_p").alias(point))


def hits(clicks: DataFrame, points: DataFrame, click: str, point: str, reach: float, disc: bool = False, group: tuple[str, ...] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Each click with the least ``point`` within reach, or null.

    A click first looks at the ``FIRST`` least points about its cell.  The least of those within reach is the least of all; only
    clicks that find none there look at the others, so that work does not grow with the number of points about a click.
    """
    own, asked = around(points, point, reach, group, x, y), inside(clicks, click, reach, group, x, y)
    place = ["_pi", "_pj", *[f"_g{k}" for k in range(len(group))]]
    ranked = own.where("_pi is not null and _pj is not null and _p is not null").withColumn("_rank", F.row_number().over(Window.partitionBy(*place).orderBy("_p")))
    near = within(reach, disc, group)
    first = asked.join(ranked.where(F.col("_rank") <= FIRST), near, "left").groupBy(*asked.columns).agg(F.min("_p").alias("_least"))
    full = ranked.where(F.col("_rank") == FIRST + 1).select(*[F.col(c).alias(f"_full{c}") for c in place])  # cells with more points
    more = (F.col("_ci") == F.col("_full_pi")) & (F.col("_cj") == F.col("_full_pj"))
    for k in range(len(group)):
        more &= F.col(f"_h{k}") == F.col(f"_full_g{k}")
    rest = first.where("_least is null").drop("_least").join(full, more, "left_semi").join(ranked.where(F.col("_rank") > FIRST), near).select("_c", F.col("_p").alias("_least"))
    found = first.where("_least is not null").select("_c", "_least").unionByName(rest).groupBy("_c").agg(F.min("_least").alias(point)).withColumnRenamed("_c", "_of")
    return clicks.join(found, F.col(click) == F.col("_of"), "left").drop("_of")
