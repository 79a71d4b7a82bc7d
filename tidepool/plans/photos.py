"""Batch jobs over folders of photos: names, notes and parameters are joined first, then the photos needed are read.

Results are rows with ``name`` (a path below the output folder), ``content`` (PNG) and ``json``;
``write_files`` of the sources makes files of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import paths
from ..operators import frames, pixels
from ..sources import photos as src
from ..sources.store import is_small, stored

CALIBRATION = "folder string, keypoints array<array<double>>, scale_x double, scale_y double"


def cumulative_hits(spark: SparkSession, dataset: str) -> DataFrame:
    """photo (the path without extension), hits: points of all numbered annotations of the folder from 1 to the photo's own, which must exist."""
    notes = src.annotations(spark, dataset).select(paths.parent(F.col("path")).alias("seq"), paths.int_stem(F.col("path")).alias("n"), paths.base(F.col("path")).alias("file"), "path", src.impact_points(F.col("shapes")).alias("points"))
    own = notes.where("n is not null").select("seq", "n", F.regexp_replace("path", r"\.json$", "").alias("photo"))
    named = notes.where(F.col("file") == F.concat(paths.zero_padded(F.col("n")), F.lit(".json")))
    past = frames.history_window(own.select("seq", "n").distinct(), named.select("seq", "n", "points"), "seq", "n", "points", "past")
    return own.join(past, ["seq", "n"]).select("photo", F.flatten(F.filter("past", lambda p: p.isNotNull())).alias("hits"))


def solved(calibrations: DataFrame) -> DataFrame:
    """folder, matrix, side: the map of each calibration and the side of what it gives, worked out once for each, when called.

    ``calibrations``: folder, keypoints (array of arrays of two, the first four in the order top, bottom, left, right),
    scale_x, scale_y.  Those of which three extremes are in line go, as nothing can be mapped by them.
    """
    pts = F.transform("keypoints", lambda p, i: F.struct(i.alias("i"), F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y")))
    rows = calibrations.select("folder", "scale_x", "scale_y", pts.alias("pts"))
    rows = rows.select("folder", *[F.struct((c["x"] * F.col("scale_x")).alias("x"), (c["y"] * F.col("scale_y")).alias("y")).alias(k) for k, c in g.extremes(F.col("pts")).items()])
    four = [F.col(k) for k in ("top", "bottom", "left", "right")]
    rows = rows.withColumn("d", g.diameter(*four))
    rows = g.with_homography(rows, [(c["x"], c["y"]) for c in four], g.diamond(F.col("d")))
    rows = stored(rows.select("folder", "matrix", F.col("d").cast("int").alias("side")), "calibrations")  # else the filter would be pushed down, with the whole solution in it
    return rows.where("matrix is not null")


def ancestors(path: Column) -> Column:
    """All folders above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder as it stands in the paths of its files."""
    hadoop, store = src.in_store(spark, folder)
    return store.makeQualified(hadoop).toString().rstrip("/")


def in_calibrated(found: DataFrame, calibrations: DataFrame) -> DataFrame:
    """path, folder, matrix, side, idx, total: each photo with each calibration above it; ``idx`` counts the photos below the folder by path."""
    own = solved(calibrations)
    per = found.select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
    both = per.join(F.broadcast(own) if is_small(own) else own, "folder")
    both = frames.numbered(both, "folder", "path", out="at")
    first = both.groupBy("folder").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("total"))
    first = first.withColumnRenamed("folder", "f2")
    return both.join(first, F.expr("folder = f2")).select("path", "folder", "matrix", "side", (F.col("at") - F.col("first")).alias("idx"), "total")


def normalized(spark: SparkSession, dataset: str, keypoints, scale: tuple[float, float] = (1.0, 1.0), size: int = 600, count: int = -1) -> DataFrame:
    """idx, path, name, percent, content, json of each photo that can be read and has hits.

    ``keypoints``: one list for the whole dataset, with its ``scale``, or a table of calibrations (see ``solved``) whose folders
    lie in the dataset, each for the photos anywhere below it.  With a table, names begin with the folder's name.
    ``idx`` counts all photos below a calibrated folder by path, so failures leave gaps; a ``count`` over 0 keeps
    so many successes of each, and photos beyond them are not read but for the last range tried.  Photos are resized
    to a square of ``size`` first; keypoints and scale hold there.  Names, notes and hits are joined first; only photos
    with hits are opened.  Runs that first part when called.
    """
    table = isinstance(keypoints, DataFrame)
    if table:
        given = keypoints.withColumn("folder", F.regexp_replace("folder", "(?<=.)/+$", ""))
        home = qualified(spark, dataset)
        full = F.when(F.rlike("folder", F.lit("^(/|[A-Za-z][A-Za-z0-9+.-]*:)")), F.regexp_replace(F.regexp_replace("folder", "^/", "file:/"), "^file:/+", "file:/")).otherwise(F.concat(F.lit(f"{home}/"), "folder"))
        given = given.withColumn("folder", full)
    else:
        given = spark.createDataFrame([(qualified(spark, dataset), [[float(x), float(y)] for x, y in keypoints], float(scale[0]), float(scale[1]))], CALIBRATION)
    found = in_calibrated(src.photos(spark, dataset).select("path"), given)
    hits = cumulative_hits(spark, dataset).where(F.size("hits") > 0)
    rows = found.withColumn("photo", F.regexp_replace("path", paths.PHOTO, "")).join(hits, "photo")
    name = F.concat(*([paths.base(F.col("folder")), F.lit("/")] if table else []), F.col("idx").cast("string"), F.lit(".png"))
    rows = rows.select("idx", "path", "folder", name.alias("name"), frames.progress(F.col("idx"), F.col("total")).alias("percent"), "hits", "matrix", "side")
    if count > 0:
        readable = lambda part: src.with_images(part).select(*part.columns)
        rows = frames.first_successes(stored(rows, "to-normalise"), readable, count, by="folder", first=4 * count)
    read = src.with_images(rows)
    at = [F.get("matrix", F.lit(k)) for k in range(9)]

    def moved(p: Column) -> Column:
        w, t = F.col("image.width"), F.col("image.height")
        return F.array(*g.project(at, F.get(p, F.lit(0)) * size / w, F.get(p, F.lit(1)) * size / t))

    read = read.select("idx", "path", "name", "percent", src.arrows_document(F.transform("hits", moved)).alias("json"), "matrix", "side", "image")

    def straight(a, matrix, side):
        return pixels.warp(pixels.lanczos(a, size, size), list(matrix), side, side)

    return pixels.encoded(pixels.apply(pixels.from_spark_images(read), straight, "matrix", "side")).select("idx", "path", "name", "percent", "content", "json")


def points_of(spark: SparkSession, folder: str, custom: bool, key: str = "arrows") -> DataFrame:
    """photo (the path without extension), points: of the list under ``key``, or, unless ``custom``, of the original annotations so far."""
    if not custom:
        return cumulative_hits(spark, folder).withColumnRenamed("hits", "points")
    return src.files(spark, folder, "*.json", recursive=True).select(F.regexp_replace("path", r"\.json$", "").alias("photo"), src.point_list(F.decode("content", "UTF-8"), key).alias("points"))


def overlaid(spark: SparkSession, folder: str, custom: bool, radius: int = 5, colour: tuple[int, int, int] = (0, 255, 0)) -> DataFrame:
    """path, content: photos with a disc at each of their points; those without an annotation are left out, and not opened."""
    found = src.photos(spark, folder).select("path", F.regexp_replace("path", paths.PHOTO, "").alias("photo"))
    rows = found.join(points_of(spark, folder, custom), "photo").where("points is not null").select("path", "points")

    def dotted(a, points):
        return pixels.discs(a, [tuple(p) for p in points], radius, colour)

    return pixels.encoded(pixels.apply(pixels.from_spark_images(src.with_images(rows)), dotted, "points")).select("path", "content")


def _in_folders(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, seq, file, note (text of the JSON beside it) of photos right in the folders right below ``root``; photos without a note raise."""
    found = src.files(spark, root, recursive=True).select("path")
    found = found.where(F.rlike("path", F.lit(pattern)) & (paths.parent(paths.parent(F.col("path"))) == qualified(spark, root)))
    notes = src.files(spark, root, "*.json", recursive=True).select(F.regexp_replace("path", r"\.json$", "").alias("photo"), F.decode("content", "UTF-8").alias("note"))
    rows = found.select("path", paths.parent_name(F.col("path")).alias("seq"), paths.base(F.col("path")).alias("file"), F.regexp_replace("path", paths.PHOTO, "").alias("photo"))
    return frames.matched(rows, notes, "photo", "error").drop("photo")


def _read_all(rows: DataFrame) -> DataFrame:
    """``rows`` with images; one that cannot be read raises."""
    whole = F.when(F.col("image.height") > 0, F.col("image")).otherwise(F.raise_error(F.concat(F.lit("cannot read "), F.col("path"))))
    return src.with_images(rows, drop_unreadable=False).withColumn("image", whole)


def brightened(spark: SparkSession, root: str, seed: int = 42) -> DataFrame:
    """name, content, json, variant, coefficient: three brightness variants of each photo, with its note.

    Names are ``seq/<text before the first dot>_<variant>.png``.  Write contents over what is there, and
    notes with ``overwrite=False``, as a note that exists stays.
    """
    rows = frames.variants(_in_folders(spark, root, r"\.(jpg|png)$"), "path", seed)
    name = F.concat("seq", F.lit("/"), F.split_part("file", F.lit("."), F.lit(1)), F.lit("_"), F.col("variant").cast("string"), F.lit(".png"))
    rows = rows.select("path", name.alias("name"), F.col("note").alias("json"), "variant", "coefficient")
    return pixels.encoded(pixels.apply(pixels.from_spark_images(_read_all(rows)), pixels.gamma, "coefficient")).select("name", "content", "json", "variant", "coefficient")


def degraded(spark: SparkSession, root: str, scale: float = 0.5) -> DataFrame:
    """name, content, json: each PNG made smaller, its points rounded half to even and then scaled."""
    points = g.scaled(src.point_list(F.col("note")), F.lit(scale), F.lit(scale))
    rows = _in_folders(spark, root, r"\.png$").select("path", F.concat("seq", F.lit("/"), "file").alias("name"), src.arrows_document(points).alias("json"), F.lit(scale).alias("scale"))
    return pixels.encoded(pixels.apply(pixels.from_spark_images(_read_all(rows)), pixels.degrade, "scale")).select("name", "content", "json")


def json_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.png$", ".json")


def training_rows(spark: SparkSession, folder: str, epoch: int, size: int = 256, seed: int = 42) -> DataFrame:
    """path, tensor, coords: photos of one folder, jittered for an epoch, with ten shots each in single precision; a photo without a note raises."""
    from ..functions import shots

    found = src.files(spark, folder).where(paths.is_photo(F.col("path"))).select("path", F.regexp_replace("path", paths.PHOTO, "").alias("photo"))
    notes = src.files(spark, folder, "*.json").select(F.regexp_replace("path", r"\.json$", "").alias("photo"), src.shots(F.decode("content", "UTF-8")).alias("shots"))
    rows = frames.jitter(frames.matched(found, notes, "photo", "error"), "path", epoch, seed)
    turned = F.transform(F.slice("shots", 1, shots.SHOTS), lambda p: F.array(F.get(p, F.lit(0)), g.turned(F.get(p, F.lit(1)), F.col("angle"))))
    rows = rows.select("path", shots.label_tensor(turned).alias("coords"), "brightness", "angle", F.lit(size).alias("size"))

    def jittered(a, brightness, angle, side):
        return pixels.rotate_in_place(pixels.brightness(pixels.bicubic(a, side, side), brightness), angle)

    return pixels.tensors(pixels.apply(pixels.from_spark_images(src.with_images(rows)), jittered, "brightness", "angle", "size")).select("path", "tensor", "coords")
