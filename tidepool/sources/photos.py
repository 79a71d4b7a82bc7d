"""Photos, their annotations and numbered checkpoints as DataFrames, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .store import stored

LABELS = "*.{jpg,jpeg,png,bmp,tif,tiff,webp}"
POINTS = "array<array<double>>"
ORIGINAL = f"shapes array<struct<label:string,points:{POINTS}>>"
SERIES = "image string, created string, target struct<size:int,rings:int,ring_colors:array<string>>, shots array<struct<image:string,timestamp:string,x:double,y:double,dx:double,dy:double,r_norm:double,theta_deg:double>>"


def in_store(spark: SparkSession, path: str):
    """(path, file system) as Hadoop knows them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the files right in one folder, empty ones too; for folders of few files, as the driver lists them."""
    hadoop, store = in_store(spark, folder)
    found = [(x.getPath().toString(), x.getLen()) for x in store.listStatus(hadoop) if x.isFile()] if store.exists(hadoop) else []
    return spark.createDataFrame(found, "path string, length long")


def files(spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content; a missing folder has no files. Contents are read only where used.

    Spark's file index leaves out files of length 0; where they count, see ``listing``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    hadoop, store = in_store(spark, folder)
    if not store.exists(hadoop):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return reader.load(folder)


def photos(spark: SparkSession, folder: str) -> DataFrame:
    """All photos below a folder, whatever the case of their extension."""
    found = files(spark, folder, recursive=True)
    return found.where(paths.is_photo(F.col("path")))


def flat_photos(spark: SparkSession, folder: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """Photos right in a folder, by path; case counts."""
    return files(spark, folder, glob).orderBy("path")


def by_int_stem(found: DataFrame) -> DataFrame:
    return found.orderBy(paths.int_stem(F.col("path")), "path")


def folders(found: DataFrame) -> DataFrame:
    return found.select(paths.parent(F.col("path")).alias("folder")).distinct()


def first_frames(found: DataFrame) -> DataFrame:
    return found.where(paths.base(F.col("path")) == "00.png")


def unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    """Photos of the seven kinds without a JSON of the same stem."""
    key = F.regexp_replace(F.col("path"), r"\.[^./]*$", "").alias("_key")
    done = files(spark, folder, "*.json").select(key)
    return files(spark, folder, LABELS).withColumn("_key", key).join(done, "_key", "left_anti").drop("_key").orderBy("path")


IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
#: Photos of which the driver holds the paths at a time.
WAVE = 20_000


def plain_path(origin: Column) -> Column:
    """The path that ``files`` gives for an image's origin, which is a URI."""
    uri = F.regexp_replace(origin, "^file:/+", "file:/")
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def images(spark: SparkSession, folder: str, drop_unreadable: bool = True) -> DataFrame:
    """path (as ``files`` writes it) and decoded image (height, width, nChannels, data in BGR order); a missing folder has none."""
    hadoop, store = in_store(spark, folder)
    if not store.exists(hadoop):
        return spark.createDataFrame([], f"path string, image {IMAGE}")
    out = spark.read.format("image").option("dropInvalid", str(drop_unreadable).lower()).option("recursiveFileLookup", "true").load(folder)
    return out.select(plain_path(F.col("image.origin")).alias("path"), "image")


def with_images(rows: DataFrame, drop_unreadable: bool = True, wave: int = WAVE) -> DataFrame:
    """``rows`` (``path`` and other columns) with the decoded ``image``, read late: only these files are opened, each once.

    The rows are stored and dealt by hash of the path to waves of about ``wave``.  Of a wave the driver
    knows the paths, which Spark packs to tasks by size; its rows, bounded by that, are broadcast to the
    scan, so no decoded pixel is shuffled.  Runs what ``rows`` needs when called.  Of very many waves take
    the ``parts`` one after the other.
    """
    from functools import reduce

    return reduce(DataFrame.unionByName, list(parts_with_images(rows, drop_unreadable, wave)))


def parts_with_images(rows: DataFrame, drop_unreadable: bool = True, wave: int = WAVE):
    """What ``with_images`` puts together, a wave at a time."""
    import re

    spark, kept = rows.sparkSession, stored(rows, "photo-rows")
    waves = max(1, -(-kept.select("path").distinct().count() // wave))
    for k in range(waves):
        part = kept.where(F.pmod(F.xxhash64("path"), F.lit(waves)) == k) if waves > 1 else kept
        paths = [r.path for r in part.select("path").distinct().collect()]
        if not paths:
            if waves == 1:
                yield part.withColumn("image", F.lit(None).cast(IMAGE))
            continue
        exact = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]  # else these stand for several files
        read = spark.read.format("image").option("dropInvalid", str(drop_unreadable).lower()).load(exact)
        read = read.select(plain_path(F.col("image.origin")).alias("path"), "image")
        yield read.join(F.broadcast(part), "path").select(*rows.columns, "image")


def with_status(read: DataFrame) -> DataFrame:
    """``read`` (images, unreadable ones too) with ``ok`` and, where not, ``error``."""
    ok = F.coalesce(F.col("image.height") > 0, F.lit(False))
    return read.withColumns({"ok": ok, "error": F.when(~ok, F.concat(F.lit("cannot read "), F.col("path")))})


def annotations(spark: SparkSession, folder: str, schema: str = ORIGINAL) -> DataFrame:
    """path and the columns of each JSON document; a broken one has nulls."""
    found = files(spark, folder, "*.json", recursive=True).select("path", F.from_json(F.decode("content", "UTF-8"), schema).alias("j"))
    return found.select("path", "j.*")


def impact_points(shapes: Column, label: str = "impact") -> Column:
    """Points of the shapes with the label (any case), truncated toward 0, in order."""
    own = F.filter(shapes, lambda s: F.lower(s["label"]) == label)
    return F.transform(F.flatten(F.transform(own, lambda s: s["points"])), lambda p: F.transform(p, lambda v: v.cast("int")))


def point_list(content: Column, key: str = "arrows") -> Column:
    """Points under ``key`` rounded half to even; null where the key lacks."""
    held = F.from_json(content, f"`{key}` {POINTS}").getField(key)
    return F.transform(held, lambda p: F.transform(p, lambda v: F.bround(v).cast("int")))


def shots(content: Column) -> Column:
    j = F.from_json(content, "shots array<struct<r_norm:double,theta_deg:double>>")
    return F.transform(j["shots"], lambda s: F.array(s["r_norm"], s["theta_deg"]))


def arrows_document(points: Column) -> Column:
    return F.to_json(F.struct(points.alias("arrows")))


def series_document(image: Column, created: Column, shots: Column, size: int, colours: list[str]) -> Column:
    target = F.struct(F.lit(size).alias("size"), F.lit(len(colours)).alias("rings"), F.array(*map(F.lit, colours)).alias("ring_colors"))
    return F.to_json(F.struct(image.alias("image"), created.alias("created"), target.alias("target"), shots.alias("shots")), {"ignoreNullFields": "false"})


def write_images(rows: DataFrame, path: str) -> None:
    """name, content as Parquet, which suits many small images; ``write_files`` makes a file of each."""
    rows.select("name", "content").write.mode("overwrite").parquet(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """name, json as Parquet; ``write_files`` makes a file of each."""
    rows.select("name", "json").write.mode("overwrite").parquet(path)


def write_files(rows: DataFrame, folder: str, content: str = "content", overwrite: bool = True) -> None:
    """A file for each row, ``name`` below ``folder`` (a path or URI that all executors reach), written by the tasks.

    A file appears whole under its name, so a task that runs twice does no harm.  Without
    ``overwrite`` names that exist keep what they have.  Text is written as UTF-8; a null content writes nothing.
    """
    body = F.col(content) if dict(rows.dtypes)[content] == "binary" else F.encode(content, "UTF-8")

    def run(part) -> None:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for name, data in part:
            at = f"{root}/{name}"
            if data is None or not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
                continue
            store.create_dir(at.rsplit("/", 1)[0], recursive=True)
            new = f"{at}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(new) as out:
                out.write(bytes(data))
            store.move(new, at)

    rows.select("name", body).foreachPartition(run)


def checkpoint_numbers(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    n = F.regexp_extract(paths.base(F.col("path")), rf"^{prefix}_([0-9]+)\.[^.]+$", 1)
    return listing(spark, folder).select(F.when(n != "", n).cast("long").alias("n")).where("n is not null")


def save_checkpoint(spark: SparkSession, folder: str, prefix: str, content: bytes, suffix: str = "pth") -> str:
    """Write at the first free number and return the path; a file that another writer puts there meanwhile is never replaced."""
    taken = {r.n for r in checkpoint_numbers(spark, folder, prefix).collect()}  # one folder's artefacts
    k = 0
    while True:
        while k in taken:
            k += 1
        hadoop, store = in_store(spark, f"{folder}/{prefix}_{k}.{suffix}")
        try:
            out = store.create(hadoop, False)
        except Exception:
            if not store.exists(hadoop):
                raise
            taken.add(k)
            continue
        out.write(bytearray(content))
        out.close()
        return f"{folder}/{prefix}_{k}.{suffix}"


def latest_checkpoint(spark: SparkSession, folder: str, prefix: str, suffix: str = "pth") -> str:
    """The path before the first free number; raises where number 0 is free."""
    taken = {r.n for r in checkpoint_numbers(spark, folder, prefix).collect()}
    k = 0
    while k in taken:
        k += 1
    if not k:
        raise FileNotFoundError(f"no {prefix}_0 in {folder}")
    return f"{folder}/{prefix}_{k - 1}.{suffix}"
