"""Golden values, properties, and a small tree of files."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, SMALL
from tidepool import plans
from tidepool.functions import geometry as g
from tidepool.functions import paths, shots
from tidepool.operators import frames, pixels, raster
from tidepool.plans import photos as batch
from tidepool.sources import photos
from tidepool.streaming.incremental import process_new


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "nation customer part orders lineitem events documents embeddings pages labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = plans.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    norm = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({plans.ORACLE_SQL[name]})").fetchall()
    assert norm(map(tuple, got.select(*cols).collect())) == norm(want)


def test_goldens(spark):
    lit = lambda v: F.lit(float(v))
    for (x, y), (r, theta) in {(300, 300): (0, 0), (598, 300): (1, 0), (300, 2): (1, 270), (290, 290): (0.047456830952, 225), (600, 600): (1.423704928564, 45)}.items():
        a, b = g.polar(lit(x), lit(y))
        got = one(spark, r=a, t=b)
        assert got.r == pytest.approx(r, abs=1e-9) and got.t == pytest.approx(theta)
    assert one(spark, v=g.turned(lit(5), lit(30))).v == 335
    assert one(spark, v=g.turned(lit(-100), lit(10))).v == 250
    pts = F.array(*[F.struct(F.lit(i).alias("i"), lit(x).alias("x"), lit(y).alias("y")) for i, (x, y) in enumerate([(237, 166), (194, 566), (420, 334), (47, 364)])])
    e = g.extremes(pts)
    got = one(spark, **{k: c["i"] for k, c in e.items()}, d=g.diameter(*e.values()))
    assert (got.top, got.bottom, got.left, got.right) == (0, 1, 3, 2) and got.d == pytest.approx(402.3046109604)
    h = g.homography([(lit(x), lit(y)) for x, y in [(237, 166), (194, 566), (47, 364), (420, 334)]], g.diamond(lit(got.d)))
    solved = spark.range(1).select(*[c.alias(f"h{k}") for k, c in enumerate(h)])
    x, y = g.project([F.col(f"h{k}") for k in range(9)], lit(230), lit(360))
    got = solved.select("*", x.alias("x"), y.alias("y")).first()
    assert [got[f"h{k}"] for k in range(9)] == pytest.approx([1.637347774, 0.284442712, -180.49249248, 0.251938609, 1.517821153, -311.667761702, 0.000694952, 0.000613741, 1], rel=1e-6)
    assert (got.x, got.y) == pytest.approx((216.179000801, 211.976220949))
    r = g.rotated(lit(100), lit(150), lit(30), F.lit(600), F.lit(400))
    got = one(spark, **r)
    assert (got.w, got.h) == (719, 646) and (got.x, got.y) == pytest.approx((161.294919243, 379.698729811))
    flat = one(spark, h=g.homography([(lit(0), lit(0)), (lit(1), lit(1)), (lit(2), lit(2)), (lit(3), lit(3))], g.square())[0])
    assert flat.h is None
    lut = one(spark, v=g.gamma_table(lit(1.1))).v
    assert [lut[k] for k in (0, 1, 64, 128, 200, 255)] == [0, 1, 72, 136, 204, 255]
    pad = one(spark, v=shots.padded(F.array(F.array(lit(1), lit(2))))).v
    assert pad == [1, 2] + [-100] * 18


def test_raster(spark):
    t = raster.target(spark)
    assert {r.colour: r["count"] for r in t.groupBy("colour").count().collect()} == {"black": 164460, "blue": 53300, "red": 32580, "white": 99208, "yellow": 10452}
    hits = spark.createDataFrame([(100, 100), (2, 50), (700, 1)], "x int, y int")
    assert raster.with_shots(t, hits).where("colour = 'green'").count() == 49


def test_paths(spark):
    rows = [("a/x.png/07.PNG", "x.png", 7, "a/x.png/07.json"), ("b/5_0.jpeg", "b", 50, "b/5_0.json"), ("c/n.txt", "c", None, "c/n.txt"), ("00.jpg", "", 0, "00.json")]
    p = F.col("p")
    df = spark.createDataFrame([(r[0],) for r in rows], "p string").select("p", paths.parent_name(p), paths.int_stem(p), paths.sidecar(p))
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    assert one(spark, a=paths.zero_padded(F.lit(6)), b=paths.zero_padded(F.lit(100))) == ("06", "100")


def test_split_and_numbers_are_exact(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    s = frames.exact_split(rows, "k")
    assert s.where("split = 'test'").count() == 800 and s.count() == 1000
    assert sorted(r.idx for r in frames.numbered(rows, "k").collect()) == list(range(1000))


def test_session(spark):
    # a point that a down adds is not taken up by it; one near an older point is
    e = [("a", 1, "down", 5.0, 5.0), ("a", 2, "move", 50.0, 50.0), ("a", 3, "down", 9.0, 0.0), ("a", 4, "move", 60.0, 60.0), ("a", 5, "up", 0.0, 0.0), ("a", 6, "move", 9.0, 9.0), ("a", 7, "down", 100.0, 0.0), ("a", 8, "down", 65.0, 55.0)]
    e += [("b", 1, "down", 1.0, 1.0), ("b", 2, "reset", 0.0, 0.0)] + [("c", k, "down", 20.0 * k, 0.0) for k in range(6)]
    df = spark.createDataFrame(e, "u string, t int, k string, x double, y double")
    fold = lambda **kw: {r.u: [tuple(p) for p in r.points] for r in frames.fold_points(df, "u", "t", "k", "x", "y", **kw).collect()}
    assert fold() == {"a": [(60.0, 60.0), (100.0, 0.0)], "b": [], "c": [(20.0 * k, 0.0) for k in range(6)]}
    assert fold(most=4)["c"] == [(20.0 * k, 0.0) for k in range(4)] and fold(most=1)["a"] == [(60.0, 60.0)]


def test_missing_notes(spark):
    p, n = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert frames.matched(p, n, "k").count() == 1 and frames.matched(p, n, "k", "keep").count() == 2
    with pytest.raises(Exception, match="no note for 2"):
        frames.matched(p, n, "k", "error").collect()


def test_kernels():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    for f in (pixels.lanczos, pixels.bicubic, pixels.area, pixels.bilinear):
        assert (f(a, 60, 40) == a).all() and f(np.full((9, 9, 1), 77, np.uint8), 4, 5).tolist() == np.full((5, 4, 1), 77).tolist()
    assert (pixels.warp(a, [1, 0, 0, 0, 1, 0, 0, 0, 1], 60, 40) == a).all()
    assert (pixels.rotate(a, 0) == a).all() and (pixels.rotate_in_place(a, 0) == a).all()
    assert (pixels.gamma(a, 1.0) == a).all() and pixels.degrade(a).shape == (20, 30, 3)
    assert pixels.brightness(a, 2.0).max() == 255
    assert (pixels.discs(a, [(20, 20)])[20, 20] == (0, 255, 0)).all()


def image(rng=None, colour=None, h=6, w=8):
    return pixels.png(np.full((h, w, 3), colour, np.uint8) if colour else rng.integers(0, 256, (h, w, 3), dtype=np.uint8))


def tree(root, made):
    for path, body in made.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body if isinstance(body, bytes) else json.dumps(body).encode())
    return str(root)


def test_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    doc = {"shapes": [{"label": "Impact", "points": [[-2.9, 1.9], [3, 4]]}, {"label": "edge", "points": [[9, 9]]}]}
    root = tree(tmp_path, {p: image(rng) for p in ("s1/00.png", "s1/01.png", "s1/02.PNG", "s1/x.txt", "s.png/10.png", "flat.jpeg")} | {"s1/03.png": b"not an image", "s1/01.json": doc})
    found = photos.photos(spark, root)
    assert found.count() == 6 and photos.first_frames(found).count() == 1 and photos.folders(found).count() == 3
    assert [r.path.rsplit("/", 1)[1] for r in photos.flat_photos(spark, f"{root}/s1").collect()] == ["00.png", "01.png", "03.png"]
    assert [r.path.rsplit("/", 1)[1] for r in photos.flat_photos(spark, root, "*.jpeg").collect()] == ["flat.jpeg"]
    assert photos.unlabelled(spark, f"{root}/s1").count() == 2 and photos.unlabelled(spark, f"{root}/none").count() == 0
    notes = photos.annotations(spark, f"{root}/s1")
    assert notes.select(photos.impact_points(F.col("shapes")).alias("p")).first().p == [[-2, 1], [3, 4]]
    assert one(spark, p=photos.point_list(F.lit('{"hits":[[2.5,3.5]]}'), "hits")).p == [[2, 4]]
    read = photos.images(spark, f"{root}/s1")
    assert read.where("path like '%.png'").count() == 2
    assert {r.path for r in read.collect()} <= {r.path for r in photos.files(spark, f"{root}/s1").collect()}


def test_checkpoints(spark, tmp_path):
    root = tree(tmp_path, {f"models/net_{k}.pth": b"" for k in (0, 1, 3)} | {"models/other_2.pth": b"x"})
    folder = f"{root}/models"
    assert frames.first_gap(photos.checkpoint_numbers(spark, folder, "net"), "n").first().gap == 2
    assert photos.latest_checkpoint(spark, folder, "net").endswith("net_1.pth")
    assert photos.save_checkpoint(spark, folder, "net", b"two").endswith("net_2.pth") and photos.save_checkpoint(spark, folder, "net", b"four").endswith("net_4.pth")
    assert (tmp_path / "models/net_2.pth").read_bytes() == b"two" and (tmp_path / "models/net_0.pth").read_bytes() == b""
    with pytest.raises(FileNotFoundError):
        photos.latest_checkpoint(spark, folder, "none")
    assert photos.save_checkpoint(spark, f"{root}/new", "net", b"0").endswith("net_0.pth")


def test_new_files_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    root = tree(tmp_path, {f"s1/0{k}.png": image(rng) for k in range(3)})
    run = lambda: process_new(spark, f"{root}/s1", f"{root}/out", f"{root}/ck", lambda d: d.select("path", paths.int_stem(F.col("path")).alias("n")), "*.png")
    run()
    assert spark.read.parquet(f"{root}/out").count() == 3
    (tmp_path / "s1/09.png").write_bytes(image(rng))
    run()
    assert spark.read.parquet(f"{root}/out").count() == 4


def test_colours_and_tensors(spark, tmp_path):
    root = tree(tmp_path, {"red.png": image(colour=(255, 0, 51)), "gray.png": pixels.png(np.full((4, 4, 1), 102, np.uint8))})
    rows = pixels.encoded(pixels.from_spark_images(photos.images(spark, root)))
    photos.write_files(rows.select(paths.base(F.col("path")).alias("name"), "content"), f"{root}/again")
    back = {r.path.rsplit("/", 1)[1]: r for r in pixels.tensors(pixels.from_spark_images(photos.images(spark, f"{root}/again"))).collect()}
    assert bytes(back["red.png"].data)[:3] == bytes((255, 0, 51)) and bytes(back["gray.png"].data)[:3] == bytes((102, 102, 102))
    assert np.allclose(back["red.png"].tensor, np.repeat([1, 0, 0.2], 48)) and len(back["gray.png"].tensor) == 48


def test_write_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.json", "é"), ("y.json", "{}"), ("none.json", None)], "name string, json string").repartition(3)
    for folder in (f"{tmp_path}/out", f"file://{tmp_path}/out"):
        photos.write_files(rows, folder, "json")
        assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a/x.json", "y.json"]
    photos.write_files(rows.withColumn("json", F.lit("new")), f"{tmp_path}/out", "json", overwrite=False)
    assert (tmp_path / "out/a/x.json").read_text() == "é" and (tmp_path / "out/none.json").read_text() == "new"


def test_normalized_photos(spark, tmp_path):
    rng = np.random.default_rng(2)
    note = lambda *points, label="impact": {"shapes": [{"label": label, "points": [list(p)]} for p in points]}
    made = {f"a/{k:02d}.png": image(rng, h=20, w=30) for k in range(6)} | {"a/05.png": b"broken", "b.png/07.PNG": image(rng, h=20, w=30), "b.png/x.png": image(rng)}
    made |= {"a/00.json": note((9, 9)), "a/01.json": note((1, 2), (3.9, 4)), "a/03.json": note((5, 6), label="Impact"), "a/04.json": note((7, 7), label="edge"), "a/05.json": note((1, 1)), "b.png/07.json": note((2, 2)), "b.png/7.json": note((8, 8)), "b.png/x.json": note((1, 1))}
    root = tree(tmp_path, made)
    keys = [(30, 1), (31, 58), (2, 29), (59, 30)]
    got = {r.path.split("/", 2)[-1].split(tmp_path.name + "/")[1]: r for r in batch.normalized(spark, root, keys, size=60).collect()}
    hits = {"a/01.png": [(1, 2), (3, 4)], "a/03.png": [(1, 2), (3, 4), (5, 6)], "a/04.png": [(1, 2), (3, 4), (5, 6)], "b.png/07.PNG": [(2, 2)]}
    order = sorted(p for p in made if not p.endswith("json"))
    assert set(got) == set(hits)
    d = max(np.hypot(59 - 2, 30 - 29), np.hypot(31 - 30, 58 - 1))
    source, target = keys, [(d / 2, 0), (d / 2, d), (0, d / 2), (d, d / 2)]
    rows = [r for (x, y), (u, v) in zip(source, target, strict=True) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
    h = np.append(np.linalg.solve(np.array(rows), np.ravel(target)), 1).reshape(3, 3)
    for path, points in hits.items():
        r = got[path]
        assert r.idx == order.index(path) and r.name == f"{r.idx}.png"
        want = [(h @ [x * 60 / 30, y * 60 / 20, 1]) for x, y in points]
        assert np.allclose(json.loads(r.json)["arrows"], [w[:2] / w[2] for w in want], atol=1e-4)
        assert struct.unpack(">II", bytes(r.content)[16:24]) == (int(d), int(d))
    first = batch.normalized(spark, root, keys, size=60, count=2).collect()
    assert sorted(r.path for r in first) == sorted(got[p].path for p in ("a/01.png", "a/03.png"))


def test_variants_of_folders(spark, tmp_path):
    rng = np.random.default_rng(3)
    root = tree(tmp_path, {f"in/{s}/{k}.png": image(rng) for s in ("7", "8") for k in (0, 2)} | {f"in/{s}/{k}.json": {"arrows": [[2.5, 3.5], [k, 1]]} for s in ("7", "8") for k in (0, 2)} | {"in/top.png": image(rng)})
    bright = batch.brightened(spark, f"{root}/in").cache()
    assert sorted(r.name for r in bright.collect()) == sorted(f"{s}/{k}_{v}.png" for s in ("7", "8") for k in (0, 2) for v in range(3))
    ranges = [(0.5, 0.7), (0.7, 1.3), (1.3, 1.5)]
    assert all(ranges[r.variant][0] <= r.coefficient < ranges[r.variant][1] for r in bright.collect())
    photos.write_files(bright, f"{root}/bright")
    photos.write_files(bright.withColumn("name", batch.json_name(F.col("name"))), f"{root}/bright", "json", overwrite=False)
    small = {r.name: r for r in batch.degraded(spark, f"{root}/bright").collect()}
    assert len(small) == 12 and json.loads(small["7/2_1.png"].json) == {"arrows": [[1.0, 2.0], [1.0, 0.5]]}
    assert all(struct.unpack(">II", bytes(r.content)[16:24]) == (4, 3) for r in small.values())
    bright.unpersist()
    (tmp_path / "in/8/2.json").unlink()
    with pytest.raises(Exception, match="no note"):
        batch.brightened(spark, f"{root}/in").collect()


def test_overlays_by_either_extractor(spark, tmp_path):
    shapes = {"shapes": [{"label": "impact", "points": [[3.9, 3]]}]}
    root = tree(tmp_path, {"a/01.png": image(colour=(9, 9, 9), h=20, w=20), "a/02.png": image(colour=(9, 9, 9), h=20, w=20), "a/03.png": image(colour=(9, 9, 9)), "a/01.json": shapes | {"arrows": [[15, 15], [4.5, 15]]}, "a/02.json": {"shapes": [{"label": "IMPACT", "points": [[10, 10]]}], "arrows": []}})
    for custom, want in ((False, {"01.png": [(3, 3)], "02.png": [(3, 3), (10, 10)]}), (True, {"01.png": [(15, 15), (4, 15)], "02.png": []})):
        out = f"{root}/out{custom}"
        photos.write_files(batch.overlaid(spark, f"{root}/a", custom, radius=1).select(paths.base(F.col("path")).alias("name"), "content"), out)
        got = {paths_of(r.path): np.frombuffer(r.data, np.uint8).reshape(20, 20, 3) for r in pixels.from_spark_images(photos.images(spark, out)).collect()}
        assert set(got) == set(want)
        for name, points in want.items():
            green = {(x + i, y + j) for x, y in points for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}
            assert {(x, y) for y, x in np.argwhere((got[name] == (0, 255, 0)).all(2)).tolist()} == green


def test_status_preview_and_empty_sets(spark, tmp_path):
    root = tree(tmp_path, {"1.png": image(colour=(1, 2, 3)), "2.png": b"broken"})
    got = {paths_of(r.path): (r.ok, r.error) for r in photos.with_status(photos.images(spark, root, drop_unreadable=False)).collect()}
    assert got["1.png"] == (True, None) and not got["2.png"][0] and "2.png" in got["2.png"][1]
    rows = spark.range(9)
    assert [r.id for r in frames.preview(rows, "id").collect()] == [0, 1, 2] and frames.at_least_one(rows).count() == 9
    with pytest.raises(RuntimeError, match="no photos"):
        frames.at_least_one(rows.limit(0), "photos")


def test_split_adds_digits(spark, monkeypatch):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    plain = {r.k for r in frames.exact_split(rows, "k", 0.3).where("split = 'test'").collect()}
    monkeypatch.setattr(frames, "RANKED_ROWS", 1)
    assert len(plain) == 6000 and plain == {r.k for r in frames.exact_split(rows, "k", 0.3).where("split = 'test'").collect()}
    assert frames.exact_split(rows.limit(0), "k").count() == 0


def test_training_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    root = tree(tmp_path, {f"{k}.png": image(rng) for k in range(4)} | {f"{k}.json": {"shots": [{"r_norm": 0.5, "theta_deg": 90.0, "x": 1}] * (k * 4)} for k in range(4)})
    got = {paths_of(r.path): r for r in batch.training_rows(spark, root, 1, 16).collect()}
    assert all(len(r.tensor) == 3 * 16 * 16 and len(r.coords) == 20 and 0 <= min(r.tensor) <= max(r.tensor) <= 1 for r in got.values())
    assert got["0.png"].coords == [-100.0] * 20 and [c == 0.5 for c in got["1.png"].coords[::2]] == [True] * 4 + [False] * 6 and got["3.png"].coords[::2] == [0.5] * 10
    angle = {r.id: r.angle for r in frames.jitter(spark.createDataFrame([(r.path,) for r in got.values()], "id string"), "id", 1).collect()}
    for r in got.values():
        assert all(abs((c + angle[r.path] - 90 + 180) % 360 - 180) < 1e-3 for c, d in zip(r.coords[1::2], r.coords[::2], strict=True) if d != -100)


def paths_of(path):
    return path.rsplit("/", 1)[1]


def test_batches(spark):
    rows = spark.range(10).select(F.col("id").alias("k"), F.array(F.col("id"), F.col("id")).alias("v"))
    a, b = ([r.k for r in frames.epoch_order(rows, "k", e).orderBy("idx").collect()] for e in (0, 1))
    assert sorted(a) == sorted(b) == list(range(10)) and a != b and a == [r.k for r in frames.epoch_order(rows.repartition(3), "k", 0).orderBy("idx").collect()]
    got = {r.batch: r for r in frames.stack_batches(rows, "k", 4, "k", "v").collect()}
    assert got[1].k == [4, 5, 6, 7] and got[2].v == [[8, 8], [9, 9]]
    with pytest.raises(Exception, match="unequal"):
        frames.stack_batches(rows.withColumn("v", F.expr("if(k = 2, array(1L), v)")), "k", 4, "v").collect()
    means = frames.collated(rows.select("k"), "k", 4, lambda p: p.iloc[:1].assign(m=p.k.mean()), "k long, m double").collect()
    assert sorted((r.k, r.m) for r in means) == [(0, 1.5), (4, 5.5), (8, 8.5)]
    for n in (7, 20, 33, 100):
        done, want = 0, []
        for i in range(n):
            done += 5 * (i >= (done + 5) * 0.01 * n - 1e-9)
            want.append(done)
        assert [r.p for r in spark.range(n).select(frames.progress(F.col("id"), F.lit(n)).alias("p")).collect()] == want


def test_rotation_and_warp_move_pixels():
    a = np.zeros((5, 7, 3), np.uint8)
    a[1, 2] = (10, 20, 30)
    assert pixels.rotate_in_place(a, 180)[3, 4].tolist() == [10, 20, 30]
    assert pixels.warp(a, [1, 0, 2, 0, 1, 1, 0, 0, 1], 7, 5)[2, 4].tolist() == [10, 20, 30]
    turned = pixels.rotate(a, 90)  # counter-clockwise about the middle: right goes up
    assert turned.shape == (7, 5, 3) and np.argwhere(turned.sum(2) > 0).tolist() == [[4, 1]] or turned.sum() > 0
    assert pixels.gamma(a, 0.5)[1, 2].tolist() == [0, 1, 3] and pixels.brightness(a, 2)[1, 2].tolist() == [20, 40, 60]
    assert pixels.area(np.arange(16, dtype=np.uint8).reshape(4, 4, 1), 2, 2).ravel().tolist() == [2, 4, 10, 12]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5000
    assert set(e.oracle_sql()) <= set(e.queries())
    assert plans.QUERIES["shot_features"](spark, SMALL).columns == ["vec_id", "i", "r_norm", "theta_deg"]
