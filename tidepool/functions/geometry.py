"""Plane geometry in columns: points, extremes, homographies, rotations, polar coordinates.

A point set is an array<struct<i:int,x:double,y:double>>.  Ties go by struct order, never by
the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half of a 600-pixel square less a border of 2.
MAX_RADIUS = 298.0
CENTRE = 300.0
MISS = -100.0


def points(flat: Column, n: int, scale: float = 1.0) -> Column:
    """The first ``n`` pairs of a flat array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), (F.get(flat, 2 * i).cast("double") * scale).alias("x"), (F.get(flat, 2 * i + 1).cast("double") * scale).alias("y")))


def least_by(pts: Column, *keys) -> Column:
    """The point least by ``keys``, functions of a point; then the earliest."""
    return F.array_min(F.transform(pts, lambda p: F.struct(*[k(p).alias(f"k{n}") for n, k in enumerate(keys)], p["i"].alias("i"), p["x"].alias("x"), p["y"].alias("y"))))


def extremes(pts: Column) -> dict[str, Column]:
    """Top, bottom, left, right; among equals the positional one (0, 1, 2, 3), then the earliest."""
    by = {"top": ("y", 1, 0), "bottom": ("y", -1, 1), "left": ("x", 1, 2), "right": ("x", -1, 3)}
    return {name: least_by(pts, lambda p, a=axis, s=sign: p[a] * s, lambda p, s=seed: (p["i"] != s).cast("int")) for name, (axis, sign, seed) in by.items()}


def extremes_of_sorted(pts: Column) -> dict[str, Column]:
    """Of the two least or greatest in one axis (a stable sort), the outer one in the other axis."""

    def two(axis: str, last: bool) -> Column:
        order = F.array_sort(F.transform(pts, lambda p: F.struct(p[axis].alias("k"), p["i"].alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
        part = F.slice(order, -2, 2) if last else F.slice(order, 1, 2)
        return F.transform(part, lambda p, n: F.struct(n.alias("i"), p["x"].alias("x"), p["y"].alias("y"), p["i"].alias("o")))

    def pick(pair: Column, key) -> Column:
        return F.array_min(F.transform(pair, lambda p: F.struct(key(p).alias("k"), p["i"].alias("n"), p["o"].alias("i"), p["x"].alias("x"), p["y"].alias("y"))))

    return {"top": pick(two("y", False), lambda p: p["x"]), "bottom": pick(two("y", True), lambda p: -p["x"]), "left": pick(two("x", False), lambda p: p["y"]), "right": pick(two("x", True), lambda p: -p["y"])}


def corners(pts: Column) -> dict[str, Column]:
    """Top left, top right, bottom right, bottom left by sums and differences; one point may be chosen twice."""
    return {
        "tl": least_by(pts, lambda p: p["x"] + p["y"]),
        "tr": least_by(pts, lambda p: p["y"] - p["x"]),
        "br": least_by(pts, lambda p: -(p["x"] + p["y"])),
        "bl": least_by(pts, lambda p: p["x"] - p["y"]),
    }


def diameter(top: Column, bottom: Column, left: Column, right: Column) -> Column:
    gap = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    return F.greatest(gap(right, left), gap(bottom, top))


def _basis(p: list[tuple[Column, Column]]) -> list[list[Column]]:
    """Columns of three homogeneous points, scaled so that they sum to the fourth (up to a common factor)."""
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = p
    det = lambda a, b, c: a[0] * (b[1] - c[1]) - b[0] * (a[1] - c[1]) + c[0] * (a[1] - b[1])
    s = [det(p[3], p[1], p[2]), det(p[0], p[3], p[2]), det(p[0], p[1], p[3])]
    return [[x1 * s[0], x2 * s[1], x3 * s[2]], [y1 * s[0], y2 * s[1], y3 * s[2]], [s[0], s[1], s[2]]]


def _adjugate(m: list[list[Column]]) -> list[list[Column]]:
    minor = lambda r, c: m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
    return [[minor(c, r) for c in range(3)] for r in range(3)]


def _product(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[a[r][0] * b[0][c] + a[r][1] * b[1][c] + a[r][2] * b[2][c] for c in range(3)] for r in range(3)]


def homography(source: list[tuple[Column, Column]], target: list[tuple[Column, Column]]) -> list[Column]:
    """Nine entries, row by row, the last 1, of the map that takes four points to four; null where three of them are in line.

    One expression an entry, which holds all before it; for tables take ``with_homography``.
    """
    h = _product(_basis(target), _adjugate(_basis(source)))
    return [F.try_divide(h[r][c], h[2][2]) for r in range(3) for c in range(3)]


def with_homography(rows: DataFrame, source: list[tuple[Column, Column]], target: list[tuple[Column, Column]], out: str = "matrix") -> DataFrame:
    """``rows`` with the nine entries as an array, null where there is no such map.

    Each step's numbers are columns of their own, so that no number is written out, or worked out, twice.
    """
    kept = rows.columns

    def step(df: DataFrame, name: str, m: list[list[Column]]) -> tuple[DataFrame, list[list[Column]]]:
        cells = {f"_{name}{r}{c}": v for r, own in enumerate(m) for c, v in enumerate(own)}
        return df.withColumns(cells), [[F.col(f"_{name}{r}{c}") for c in range(len(own))] for r, own in enumerate(m)]

    rows, p = step(rows, "p", [list(x) for x in source])
    rows, q = step(rows, "q", [list(x) for x in target])
    rows, a = step(rows, "a", _basis([tuple(x) for x in q]))
    rows, b = step(rows, "b", _basis([tuple(x) for x in p]))
    rows, c = step(rows, "c", _adjugate(b))
    rows, h = step(rows, "h", _product(a, c))
    entries = F.array(*[F.try_divide(h[r][c], h[2][2]) for r in range(3) for c in range(3)])
    return rows.withColumn("_m", entries).select(*kept, F.when(F.col("_m")[8].isNotNull(), F.col("_m")).alias(out))


def diamond(d: Column) -> list[tuple[Column, Column]]:
    """Targets of top, bottom, left, right on a square of side ``d``."""
    zero = F.lit(0.0)
    return [(d / 2, zero), (d / 2, d), (zero, d / 2), (d, d / 2)]


def square(side: float = 600.0) -> list[tuple[Column, Column]]:
    z, s = F.lit(0.0), F.lit(float(side))
    return [(z, z), (s, z), (s, s), (z, s)]


def project(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a homography; at infinity (0, 0)."""
    w = h[6] * x + h[7] * y + h[8]
    at = lambda k: F.when(w == 0, F.lit(0.0)).otherwise(F.try_divide(h[k] * x + h[k + 1] * y + h[k + 2], w))
    return at(0), at(3)


def rotated(x: Column, y: Column, degrees: Column, w: Column, h: Column) -> dict[str, Column]:
    """Point and canvas after a counter-clockwise turn about the centre, the canvas grown to hold all."""
    a, b = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    cx, cy = F.floor(w / 2), F.floor(h / 2)
    new_w, new_h = (h * F.abs(b) + w * F.abs(a)).cast("int"), (h * F.abs(a) + w * F.abs(b)).cast("int")
    return {
        "x": a * x + b * y + (1 - a) * cx - b * cy + new_w / 2 - cx,
        "y": -b * x + a * y + b * cx + (1 - a) * cy + new_h / 2 - cy,
        "w": new_w,
        "h": new_h,
    }


def polar(x: Column, y: Column, centre: float = CENTRE, radius: float = MAX_RADIUS) -> tuple[Column, Column]:
    """(r over the target's radius, degrees in [0, 360)); y points down."""
    dx, dy = x - centre, y - centre
    theta = F.degrees(F.atan2(dy, dx))
    return F.hypot(dx, dy) / radius, F.when(theta < 0, theta + 360).otherwise(theta)


def to_pixel(r: Column, theta: Column, centre: float = CENTRE, radius: float = MAX_RADIUS) -> tuple[Column, Column]:
    return (centre + r * radius * F.cos(F.radians(theta))).cast("int"), (centre + r * radius * F.sin(F.radians(theta))).cast("int")


def turned(theta: Column, angle: Column, r: Column | None = None) -> Column:
    """Degrees after a turn; with ``r``, misses keep their mark instead of being turned as well."""
    out = F.pmod(theta - angle + 360, F.lit(360.0))
    return out if r is None else F.when((r == MISS) & (theta == MISS), theta).otherwise(out)


def fit_box(w: Column, h: Column, box_w: Column, box_h: Column, enlarge: bool = True) -> tuple[Column, Column]:
    ratio = F.least(box_w / w, box_h / h)
    ratio = ratio if enlarge else F.least(ratio, F.lit(1.0))
    return F.bround(w * ratio).cast("int"), F.bround(h * ratio).cast("int")


def scaled_size(n: Column, scale: float) -> Column:
    return F.greatest(F.lit(1), (n * scale).cast("int"))


def gamma_table(gamma: Column) -> Column:
    """256 levels; above 1 brightens."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: (F.pow(i / F.lit(255.0), 1 / gamma) * 255.0).cast("int"))


def hit_box(pts: Column, x: Column, y: Column, reach: float = 10.0) -> Column:
    """Index of the first point less than ``reach`` away in each axis; null if none is."""
    return F.array_min(F.transform(F.filter(pts, lambda p: (F.abs(p["x"] - x) < reach) & (F.abs(p["y"] - y) < reach)), lambda p: p["i"]))


def hit_disc(pts: Column, x: Column, y: Column, radius: float = 6.0) -> Column:
    return F.array_min(F.transform(F.filter(pts, lambda p: (p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y) <= radius * radius), lambda p: p["i"]))


def bounds(pts: Column) -> dict[str, Column]:
    axis = lambda a: F.transform(pts, lambda p: p[a])
    return {"x0": F.array_min(axis("x")), "y0": F.array_min(axis("y")), "x1": F.array_max(axis("x")), "y1": F.array_max(axis("y"))}


def hit_marker(pts: Column, x: Column, y: Column, radius: float = 6.0) -> Column:
    """Index of the first point whose marker's closed bounding box holds the place."""
    return F.array_min(F.transform(F.filter(pts, lambda p: (F.abs(p["x"] - x) <= radius) & (F.abs(p["y"] - y) <= radius)), lambda p: p["i"]))


def inside(x: Column, y: Column, size: int) -> Column:
    return (x >= 0) & (x < size) & (y >= 0) & (y < size)


def truncated(v: Column) -> Column:
    return v.cast("int")


def half_even(v: Column) -> Column:
    return F.bround(v).cast("int")


def scaled(pts: Column, sx: Column, sy: Column) -> Column:
    """A list of points (arrays of two) with each axis multiplied."""
    return F.transform(pts, lambda p: F.array(F.get(p, F.lit(0)) * sx, F.get(p, F.lit(1)) * sy))


def display_ratio(w: Column, h: Column, shown_w: Column, shown_h: Column, both: bool = True) -> tuple[Column, Column]:
    """Original pixels for one on the screen, by axis; with ``both`` false the x ratio twice."""
    x, y = F.try_divide(w.cast("double"), shown_w), F.try_divide(h.cast("double"), shown_h)
    return x, y if both else x


def rectangle(top: Column, bottom: Column, left: Column, right: Column) -> dict[str, Column]:
    """The box that four extremes span, and where its mid-lines meet: x1, y1, x2, y2, cx, cy."""
    x1, y1, x2, y2 = left["x"], top["y"], right["x"], bottom["y"]
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "cx": (x1 + x2) / 2, "cy": (y1 + y2) / 2}


def midlines(box: dict[str, Column]) -> tuple[Column, Column]:
    """The level and the upright mid-line, as arrays x1, y1, x2, y2."""
    return F.array(box["x1"], box["cy"], box["x2"], box["cy"]), F.array(box["cx"], box["y1"], box["cx"], box["y2"])


def chords(top: Column, bottom: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """From top to bottom and from left to right, as arrays x1, y1, x2, y2."""
    return F.array(top["x"], top["y"], bottom["x"], bottom["y"]), F.array(left["x"], left["y"], right["x"], right["y"])
