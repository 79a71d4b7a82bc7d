"""The target as rows of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ring colours from the innermost pair out (fixed values).
COLOURS = ["yellow", "yellow", "red", "red", "blue", "blue", "black", "black", "white", "white"]
RINGS = 10


def _whole(v):
    """Cut toward 0; a column stays one."""
    return v.cast("int") if isinstance(v, Column) else int(v)


def ring_colour(x: Column, y: Column, size: int | Column = 600, border: int = 3) -> Column:
    """Colour of a pixel, a ring being (inner, outer] on the squared distance, its border over the ring inside it."""
    centre = _whole(size / 2)
    radius = centre - 2
    d = (x - centre) * (x - centre) + (y - centre) * (y - centre)
    step = radius / RINGS
    within = lambda lo, hi: (d > lo * lo) & (d <= hi * hi)
    out = F.lit("black")
    painted = F.lit(None).cast("string")
    for i in range(RINGS - 1, -1, -1):  # outermost first; what comes later covers
        inner, outer = _whole(i * step), _whole((i + 1) * step)
        painted = F.when(within(inner, outer), COLOURS[i]).otherwise(painted)
        if i and i != 6:
            edge = _whole(inner + border / 2)
            painted = F.when(within(inner, edge), "white" if i == 7 else "black").otherwise(painted)
    x_ring = (_whole(step / 2 - border / 2), _whole(step / 2 + border / 2))
    painted = F.when(within(*x_ring), "black").otherwise(painted)
    return F.coalesce(painted, out)


def targets(sizes: DataFrame, size: str = "size") -> DataFrame:
    """``sizes`` with a row for each pixel of a square of that side: x, y, colour."""
    rows = sizes.withColumn("x", F.explode(F.sequence(F.lit(0), F.col(size) - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col(size) - 1)))
    return rows.withColumn("colour", ring_colour(F.col("x"), F.col("y"), F.col(size)))


def spokes_of(sizes: DataFrame, size: str = "size", every: int = 30) -> DataFrame:
    """``sizes`` with the ends of a target's spokes: degrees, x, y."""
    centre = F.col(size) / 2
    radius = F.floor(centre) - 2
    rows = sizes.withColumn("degrees", F.explode(F.sequence(F.lit(0), F.lit(359), F.lit(every))))
    return rows.withColumns({"x": centre + radius * F.cos(F.radians("degrees")), "y": centre + radius * F.sin(F.radians("degrees"))})


def pixels(spark: SparkSession, size: int = 600) -> DataFrame:
    n = spark.range(size * size)
    return n.select((F.col("id") % size).cast("int").alias("x"), F.floor(F.col("id") / size).cast("int").alias("y"))


def target(spark: SparkSession, size: int = 600, border: int = 3) -> DataFrame:
    p = pixels(spark, size)
    return p.withColumn("colour", ring_colour(F.col("x"), F.col("y"), size, border))


def with_shots(raster: DataFrame, shots: DataFrame, size: int = 600, half: int = 3) -> DataFrame:
    """Green squares about shots (x, y) that lie on the canvas; those nearer than ``half`` to its left or top edge are not seen."""
    ok = shots.where(f"x >= {half} and y >= {half} and x < {size} and y < {size}")
    spots = ok.select(F.explode(F.sequence(F.col("x") - half, F.col("x") + half)).alias("x"), "y").select("x", F.explode(F.sequence(F.col("y") - half, F.col("y") + half)).alias("y")).distinct().withColumn("_shot", F.lit(True))
    return raster.join(spots, ["x", "y"], "left").withColumn("colour", F.when(F.col("_shot"), "green").otherwise(F.col("colour"))).drop("_shot")


def spokes(spark: SparkSession, size: int = 600, every: int = 30) -> DataFrame:
    radius, centre = size // 2 - 2, size / 2
    a = spark.range(0, 360, every).select(F.col("id").cast("int").alias("degrees"))
    return a.select("degrees", (centre + radius * F.cos(F.radians("degrees"))).alias("x"), (centre + radius * F.sin(F.radians("degrees"))).alias("y"))
