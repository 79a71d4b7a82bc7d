"""Batch jobs over trees of photos: paths, calibrations, late reading, listing, committed writes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_reference_ops import image, tree
from tidepool.functions import paths
from tidepool.operators import frames, pixels
from tidepool.plans import photos as batch
from tidepool.sources import photos, sink
from tidepool.sources.store import cleared, opened, stored
from tidepool.sources.tree import files_in, sub_folders
from tidepool.sources.tree import tree as listed

ODD = ["a b", "p%20q", "h#1", "x+y", "é", "[ab]", "q?{c}"]


def below(root, path):
    return path.split(f"{root}/", 1)[1]


def note(*points):
    return {"shapes": [{"label": "impact", "points": [list(p) for p in points]}], "arrows": [list(p) for p in points], "shots": [{"r_norm": 0.5, "theta_deg": 90.0}]}


@pytest.mark.parametrize("job", ["normalized", "overlaid", "brightened", "degraded", "training_rows"])
def test_every_photo_once_whatever_its_path(spark, tmp_path, job):
    rng = np.random.default_rng(5)
    made = {f"in/{f}/01.png": image(rng, h=6, w=8) for f in ODD} | {f"in/{f}/01.json": note((2, 3)) for f in ODD}
    made |= {"in/a b/in/8/01.png": image(rng, h=6, w=8), "in/a b/in/8/01.json": note((2, 3))}  # a folder of the root's name
    root = tree(tmp_path, made)
    if job == "normalized":
        got = batch.normalized(spark, f"{root}/in", [(4, 0), (4, 7), (0, 4), (7, 4)], size=8).select("path").collect()
        assert sorted(below(root, r.path) for r in got) == sorted(p for p in made if p.endswith("png"))
    elif job == "overlaid":
        got = batch.overlaid(spark, f"{root}/in", True, radius=1).select("path").collect()
        assert sorted(below(root, r.path) for r in got) == sorted(p for p in made if p.endswith("png"))
    elif job == "training_rows":
        for f in ODD:
            (r,) = batch.training_rows(spark, f"{root}/in/{f}".replace("[", "\\[").replace("{", "\\{").replace("?", "\\?"), 1, 4).collect() if not set(f) & set("[{?") else [None]
            assert r is None or below(root, r.path) == f"in/{f}/01.png" and r.coords[0] == 0.5
    else:
        rows = getattr(batch, job)(spark, f"{root}/in").select("name").collect()
        assert sorted({r.name.replace("_0", "").replace("_1", "").replace("_2", "") for r in rows}) == sorted(f"{f}/01.png" for f in ODD)
        assert len(rows) == len(ODD) * (3 if job == "brightened" else 1)


def matrix(keys, scale):
    pts = [(x * scale[0], y * scale[1]) for x, y in keys]
    top, bottom = min(pts, key=lambda p: p[1]), max(pts, key=lambda p: p[1])
    left, right = min(pts, key=lambda p: p[0]), max(pts, key=lambda p: p[0])
    d = max(np.hypot(right[0] - left[0], right[1] - left[1]), np.hypot(bottom[0] - top[0], bottom[1] - top[1]))
    source, target = [top, bottom, left, right], [(d / 2, 0), (d / 2, d), (0, d / 2), (d, d / 2)]
    rows = [r for (x, y), (u, v) in zip(source, target, strict=True) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
    return np.append(np.linalg.solve(np.array(rows), np.ravel(target)), 1).reshape(3, 3), int(d)


def test_two_calibrations_in_one_run(spark, tmp_path):
    rng = np.random.default_rng(6)
    made = {f"d/{f}/{k:02d}.png": image(rng, h=20, w=30) for f in ("one", "two", "none") for k in (0, 1, 2, 4)} | {f"d/{f}/{k:02d}.json": note((k, 2), (3, k)) for f in ("one", "two", "none") for k in (1, 2)}
    root = tree(tmp_path, made)
    given = {"one": ([(30, 1), (31, 58), (2, 29), (59, 30)], (1.0, 1.0)), "two": ([(20, 5), (24, 40), (4, 22), (50, 25)], (1.1, 0.9)), "line": ([(0, 0), (1, 1), (2, 2), (3, 3)], (1.0, 1.0))}
    rows = [(f if f != "two" else f"{root}/d/two/", [list(map(float, p)) for p in k], *s) for f, (k, s) in given.items()]
    calibrations = spark.createDataFrame(rows, batch.CALIBRATION)
    got = batch.normalized(spark, f"{root}/d", calibrations, size=60).collect()
    assert sorted(r.name for r in got) == ["one/1.png", "one/2.png", "two/1.png", "two/2.png"]  # 4 has no note
    for r in got:
        folder, k = r.name.split("/")[0], int(r.name.split("/")[1][0])
        h, side = matrix(*given[folder])
        points = [(p, q) for n in range(1, k + 1) for p, q in ((n, 2), (3, n))]
        want = [(h @ [x * 60 / 30, y * 60 / 20, 1]) for x, y in points]
        assert np.allclose(json.loads(r.json)["arrows"], [w[:2] / w[2] for w in want], atol=1e-6)
        alone = batch.normalized(spark, f"{root}/d/{folder}", given[folder][0], given[folder][1], size=60).where(F.col("idx") == r.idx).first()
        assert (alone.json, alone.content, alone.percent) == (r.json, r.content, r.percent)
    first = batch.normalized(spark, f"{root}/d", calibrations, size=60, count=1).collect()
    assert sorted(r.name for r in first) == ["one/1.png", "two/1.png"]
    plan = batch.normalized(spark, f"{root}/d", calibrations, size=60)
    import time

    began = time.time()
    plan._jdf.queryExecution().executedPlan()
    assert time.time() - began < 3
    assert batch.normalized(spark, f"{root}/missing", calibrations).count() == 0


def nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from nodes(plan.children().apply(k))


def test_only_wanted_photos_are_read_and_no_pixel_is_shuffled(spark, tmp_path):
    rng = np.random.default_rng(7)
    root = tree(tmp_path, {f"{k:03d}.png": image(rng) for k in range(40)} | {f"bad{k}.png": b"not an image" for k in range(5)})
    found = photos.photos(spark, root).select("path", F.length("path").alias("n")).where("path like '%5.png' and path not like '%bad%'")
    for wave in (100, 2):
        read = photos.with_images(found, drop_unreadable=False, wave=wave)
        assert sorted(below(root, p) for p in read.inputFiles() if p.endswith("png")) == ["005.png", "015.png", "025.png", "035.png"]
        assert read.where("image.height > 0").count() == 4 and read.columns == ["path", "n", "image"]
        for node in nodes(read._jdf.queryExecution().sparkPlan()):
            if "Exchange" in node.nodeName() and "Broadcast" not in node.nodeName():
                raise AssertionError(node.toString())
    assert photos.with_images(found.limit(0)).count() == 0
    assert cleared(spark) > 0


def test_tree_by_executors(spark, tmp_path):
    tree(tmp_path, {"r/a/x.png": b"1", "r/a/zero.json": b"", "r/b c/é%/deep.JPG": b"22", "r/top.txt": b""})
    (tmp_path / "r/empty").mkdir()
    (tmp_path / "r/b c/none").mkdir()
    root = f"{tmp_path}/r"
    got = {below(root, r.path): (r.is_folder, r.length, r.level) for r in listed(spark, root).collect()}
    assert got == {
        "a": (True, 0, 1), "b c": (True, 0, 1), "empty": (True, 0, 1), "top.txt": (False, 0, 1),
        "a/x.png": (False, 1, 2), "a/zero.json": (False, 0, 2), "b c/é%": (True, 0, 2), "b c/none": (True, 0, 2),
        "b c/é%/deep.JPG": (False, 2, 3),
    }
    assert sorted(below(root, r.path) for r in listed(spark, root, 1).collect()) == ["a", "b c", "empty", "top.txt"]
    entries = listed(spark, f"file://{root}")
    assert sorted(r.name for r in sub_folders(entries).collect()) == ["a", "b c", "empty"]
    assert {r.path for r in files_in(entries, paths.PHOTO).collect()} == {r.path for r in photos.photos(spark, root).select("path").collect()}
    assert listed(spark, f"{root}/missing").count() == 0 and listed(spark, root, 0).count() == 0


def visible(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and "_staging" not in str(p)) if folder.exists() else []


def test_committed_write(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.range(40).select(F.format_string("s%d/%02d.txt", F.col("id") % 3, "id").alias("name"), F.col("id").cast("string").alias("content")).repartition(4)
    bad = rows.withColumn("content", F.when(F.col("name") == "s0/39.txt", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="killed"):
        sink.write_committed(bad, str(out))
    assert visible(out) == []
    sink.write_committed(rows, str(out))
    assert len(visible(out)) == 40 and (out / "s1/07.txt").read_text() == "7" and sink.recover(spark, str(out)) == []
    assert not list(out.glob("_staging*"))
    more = rows.withColumn("content", F.lit("new")).unionByName(spark.createDataFrame([("é x.txt", "1"), ("no.txt", None)], "name string, content string"))
    sink.write_committed(more, f"file://{out}", overwrite=False)
    assert (out / "s1/07.txt").read_text() == "7" and (out / "é x.txt").read_text() == "1" and len(visible(out)) == 41
    sink.write_committed(more, str(out))
    assert (out / "s1/07.txt").read_text() == "new" and len(visible(out)) == 41
    sink.write_committed(rows.limit(0), str(out))


def test_broken_off_jobs(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([("a.txt", b"1"), ("b.txt", b"2")], "name string, content binary").coalesce(1)
    job = sink.stage(rows, str(out))
    assert visible(out) == []
    writer = sink.StagedWriter(str(out), "undecided")
    from pyspark.sql import Row

    writer.write(iter([Row(name="c.txt", content=b"3")]))
    (next((out / f"_staging-{job}").glob("*/0"))).rename(out / "a.txt")  # one file was moved before the job died
    assert sink.recover(spark, str(out)) == [job]
    assert visible(out) == ["a.txt", "b.txt"] and not list(out.glob("_staging*"))


def test_retried_task_writes_once(spark, tmp_path):
    from pyspark.sql import Row

    out = tmp_path / "out"
    writer = sink.StagedWriter(str(out), "j")
    rows = [Row(name=f"{k}.txt", content=str(k).encode()) for k in range(5)]

    def dying():
        yield from rows[:3]
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(dying())
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([kept])
    assert lost.attempt != kept.attempt and visible(out) == []
    sink.publish(spark, str(out), "j")
    assert visible(out) == [f"{k}.txt" for k in range(5)]
    writer = sink.StagedWriter(str(out), "k")
    writer.abort([writer.write(iter(rows))])
    assert sink.recover(spark, str(out)) == []


def test_rows_beyond_the_last_range_are_not_judged(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = stored(frames.numbered(spark.range(20_000).withColumnRenamed("id", "k"), "k"), "numbered")

    def judge(part):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b[b["k"] % 7 == 3]

        return part.mapInPandas(run, part.schema)

    got = frames.first_successes(rows, judge, 30)
    assert [r.k for r in got.orderBy("idx").collect()] == [7 * j + 3 for j in range(30)]
    assert seen.value < 600
    assert frames.first_successes(rows, lambda p: p.where("k = 12345"), 3).count() == 1
    assert frames.first_successes(rows.limit(0), judge, 3).count() == 0


def test_sidecars_of_other_extensions(spark):
    rows = spark.createDataFrame([("a.webp/b.tiff",), ("a.png",)], "p string")
    got = [r[0] for r in rows.select(paths.sidecar_anywhere(F.col("p"), (".webp", ".tiff"))).collect()]
    assert got == ["a.json/b.json", "a.png"]


def test_opened_paths():
    assert opened("file:/a b/c")[1:] == ("/a b/c", "file:") and opened("file:///a%20b")[1] == "/a%20b" and opened("/x")[1] == "/x"


def test_pixels_of_late_rows(spark, tmp_path):
    root = tree(tmp_path, {"red.png": image(colour=(255, 0, 51)), "blue.png": image(colour=(0, 0, 255))})
    rows = photos.photos(spark, root).select("path", paths.base(F.col("path")).alias("name"))
    got = {r.name: bytes(r.data)[:3] for r in pixels.from_spark_images(photos.with_images(rows, wave=1)).collect()}
    assert got == {"red.png": bytes((255, 0, 51)), "blue.png": bytes((0, 0, 255))}
