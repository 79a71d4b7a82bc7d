"""Streams, ledgers, long sequences, grids and rows by number, against their plain counterparts."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import frames, grid
from tidepool.sources.numbered import Numbered, write_numbered
from tidepool.streaming import incremental, sessions

EVENTS = "user string, t timestamp, tie long, kind string, x double, y double"


def clicks(seed, n, start=0):
    rng = random.Random(seed)
    kinds = ["down", "down", "move", "up", "reset", "other"]
    return [(f"u{rng.randrange(4)}", f"2024-01-01 {10 + (start + k) // 3600:02d}:{(start + k) // 60 % 60:02d}:{(start + k) % 60:02d}", k, rng.choices(kinds, [6, 6, 6, 4, 1, 1])[0], rng.randrange(60) * 1.0, rng.randrange(60) * 1.0) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user string, t string, tie long, kind string, x double, y double").withColumn("t", F.col("t").cast("timestamp"))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, sessions.PROVIDER)
    yield
    spark.conf.set(key, before)


def run_stream(spark, folder, ck, seen, **how):
    stream = sessions.fold_stream(spark.readStream.schema(EVENTS).parquet(folder), "user", "t", "kind", "x", "y", tie="tie", **how)

    def take(batch, _):
        seen.update({r.user: [(p.x, p.y) for p in r.points] for r in batch.collect()})

    stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()


def test_fold_over_restarts(spark, tmp_path, rocks):
    rows = clicks(1, 150)
    random.Random(2).shuffle(rows[40:60])
    parts = [rows[:50], rows[50:100], rows[100:]]
    parts[1].append(parts[0].pop(45))  # comes a file later than its time
    seen = {}
    for k, part in enumerate(parts):  # a start for each file: two restarts
        frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_stream(spark, f"{tmp_path}/in", f"{tmp_path}/ck", seen, most=5)
        have = frame(spark, [r for p in parts[: k + 1] for r in p]).withColumn("order", F.struct("t", F.col("tie").cast("string").alias("tie")))
        want = {r.user: [(p.x, p.y) for p in r.points] for r in frames.fold_points(have, "user", "order", "kind", "x", "y", most=5).collect()}
        assert seen == want, k


def test_late_events_do_not_count(spark, tmp_path, rocks):
    seen = {}
    first = [("u", "2024-01-01 10:00:00", 1, "down", 1.0, 1.0), ("u", "2024-01-01 12:00:00", 2, "down", 50.0, 50.0)]
    late = [("u", "2024-01-01 09:00:00", 3, "down", 90.0, 90.0), ("u", "2024-01-01 12:00:01", 4, "down", 70.0, 70.0)]
    for part in (first, late):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_stream(spark, f"{tmp_path}/in", f"{tmp_path}/ck", seen)
    assert seen["u"] == [(1.0, 1.0), (50.0, 50.0), (70.0, 70.0)]


def test_step_is_the_batch_fold(spark):
    rows = clicks(3, 400)
    state = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        state[r[0]] = sessions.step(state.get(r[0], ([], -1)), r[3:], 10.0, None)
    got = frames.fold_points(frame(spark, rows).withColumn("o", F.struct("t", "tie")), "user", "o", "kind", "x", "y").collect()
    assert {r.user: [[p.x, p.y] for p in r.points] for r in got} == {u: s[0] for u, s in state.items()}


def test_a_session_of_any_length(spark):
    kind = F.element_at(F.array(*map(F.lit, ["down", "move", "up", "down", "other"])), (F.col("id") % 5 + 1).cast("int"))
    rows = spark.range(0, 120_000, 1, 6).select(F.when(F.col("id") % 1000 == 7, "v").otherwise("u").alias("user"), "id", F.when(F.col("id").isin(40_000, 110_003), "reset").otherwise(kind).alias("kind"), (F.col("id") * 37 % 900).cast("double").alias("x"), (F.col("id") * 91 % 700).cast("double").alias("y"))
    got = {r.user: [[p.x, p.y] for p in r.points] for r in sessions.fold_sorted(rows, "user", "kind", "x", "y", "id", most=50).collect()}
    state = {}
    for r in rows.orderBy("id").toLocalIterator():
        state[r.user] = sessions.step(state.get(r.user, ([], -1)), (r.kind, r.x, r.y), 10.0, 50)
    assert got == {u: s[0] for u, s in state.items()} and len(got["u"]) == 50
    assert sessions.fold_sorted(rows.limit(0), "user", "kind", "x", "y", "id").count() == 0


def keyed(batch):
    return batch.select(F.element_at(F.split("path", "/"), -1).alias("k"), F.decode("content", "UTF-8").alias("v"), "path", "modificationTime")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, ck, taken = f"{tmp_path}/out", f"{tmp_path}/ck", []
    run = lambda where=ck: incremental.insert_new(spark, str(folder), out, where, keyed, "k", after_write=taken.append)
    (folder / "a").write_text("1")
    (folder / "b").write_text("2")
    run()
    (folder / "c").write_text("3")
    run()
    table = lambda: sorted((r.k, r.v) for r in incremental.Ledger(spark, out).rows().collect())
    assert table() == [("a", "1"), ("b", "2"), ("c", "3")] and taken == [0, 1]
    ledger = incremental.Ledger(spark, out)
    assert not ledger.take(spark.createDataFrame([("a", "again")], "k string, v string"), 1) and table()[0] == ("a", "1")
    run(f"{tmp_path}/new-ck")  # the stream's memory is lost: its batch 0 is in the ledger
    assert table() == [("a", "1"), ("b", "2"), ("c", "3")] and taken == [0, 1]
    spark.createDataFrame([("z", "half")], "k string, v string").write.parquet(f"{out}/rows/batch=2")  # written, never entered
    assert table() == [("a", "1"), ("b", "2"), ("c", "3")]
    (folder / "d").write_text("4")
    run()
    assert table() == [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")] and taken == [0, 1, 2]


def test_a_changed_note_replaces_what_was(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    out = f"{tmp_path}/out"
    for k, text in enumerate(("old", "new")):
        (folder / "a").write_text(text)
        (folder / f"b{k}").write_text("x")
        os.utime(folder / "a", (1_700_000_000 + k, 1_700_000_000 + k))
        assert incremental.follow_changes(spark, str(folder), out, keyed)
        assert not incremental.follow_changes(spark, str(folder), out, keyed)
        now = {r.k: r.v for r in incremental.latest(spark, out, "k", "modificationTime").collect()}
        assert now == {"a": text, **{f"b{j}": "x" for j in range(k + 1)}}
    assert incremental.latest(spark, f"{tmp_path}/none", "k", "modificationTime") is None


def test_history_by_offsets(spark):
    rng = random.Random(4)
    photos = spark.createDataFrame([(f"s{rng.randrange(3)}", k) for k in range(-1, 40)] + [(None, 3)], "s string, n long")
    notes = spark.createDataFrame([(f"s{rng.randrange(3)}", rng.randrange(-2, 40), f"v{k}") for k in range(60)], "s string, n long, v string")
    turns, placed = frames.history_offsets(photos.repartition(5), notes.repartition(4), "s", "n")
    by = {}
    for r in placed.collect():
        by.setdefault(r.s, {})[r.place] = (r.n, r.v)
    for r in frames.history_window(photos.where("s is not null"), notes, "s", "n", "v").collect():
        want = sorted(r.history)
        upto = [x.upto for x in turns.where((F.col("s") == r.s) & (F.col("n") == r.n)).collect()]
        assert upto == [len(want)] and sorted(by.get(r.s, {})[k][1] for k in range(1, upto[0] + 1)) == want
    assert turns.where("s is null").first().upto == 0


def test_a_sequence_of_a_million_notes(spark):
    notes = spark.range(1, 1_000_001, 1, 8).select(F.lit("s").alias("s"), F.col("id").alias("n"))
    photos = spark.range(0, 1_000_001, 50_000, 4).select(F.lit("s").alias("s"), F.col("id").alias("n"))
    turns, placed = frames.history_offsets(photos, notes, "s", "n")
    assert turns.where("upto != n").count() == 0 and turns.count() == 21
    assert placed.agg(F.count(F.lit(1)), F.sum("place"), F.max(F.abs(F.col("place") - F.col("n")))).first()[:] == (1_000_000, 500_000_500_000, 0)


@pytest.mark.parametrize(("reach", "disc"), [(10.0, False), (6.0, True), (0.5, False)])
def test_grid_is_all_pairs(spark, reach, disc):
    rng = random.Random(5)
    spot = lambda: rng.randrange(-400, 400) / 8
    points = [(k, rng.choice("ab"), spot(), spot()) for k in range(150)] + [(998, "a", None, 1.0), (999, "a", 0.0, 0.0)]
    asked = [(k, rng.choice("abc"), spot(), spot()) for k in range(150)] + [(500, "a", 0.0, None), (501, "a", reach, 0.0), (502, None, 0.0, 0.0)]
    p, c = (spark.createDataFrame(rows, f"{k} long, g string, x double, y double") for rows, k in ((points, "p"), (asked, "c")))

    def near(a, b):
        if None in (*a[2:], *b[2:]):
            return False
        dx, dy = a[2] - b[2], a[3] - b[3]
        return dx * dx + dy * dy <= reach * reach if disc else abs(dx) < reach and abs(dy) < reach

    for group in ((), ("g",)):
        want = {(a[0], b[0]) for a in asked for b in points if near(a, b) and (not group or a[1] == b[1] and a[1])}
        assert {tuple(r) for r in grid.nearby(c, p, "c", "p", reach, disc, group).collect()} == want
        hits = {r.c: r.p for r in grid.hits(c, p, "c", "p", reach, disc, group).collect()}
        assert hits == {a[0]: min((b for x, b in want if x == a[0]), default=None) for a in asked}
    plan = grid.hits(c, p, "c", "p", reach)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def joined_rows(df):
    """The most rows that a join of the plan gave."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()

    def walk(node):
        kids = node.children()
        own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() and node.metrics().contains("numOutputRows") else 0
        return max([own, *[walk(kids.apply(k)) for k in range(kids.size())]])

    return walk(qe.executedPlan())


@pytest.mark.parametrize("disc", [False, True])
def test_least_of_crowds(spark, disc, monkeypatch):
    """Most points of a cell out of reach, clicks of one id at several places, and work that does not grow with the crowd."""
    rng = random.Random(7)
    far = [(k, 1.5, 1.5) for k in range(60)] + [(60 + k, 0.1, rng.randrange(80) / 80) for k in range(20)]
    asked = [(k, 0.05, 0.0) for k in range(20)] + [(20, 5.0, 5.0), (21, 0.2, 0.9), (21, 0.9, 0.9), (None, 0.1, 0.1)]
    p, c = (spark.createDataFrame(rows, f"{k} long, x double, y double") for rows, k in ((far, "p"), (asked, "c")))
    near = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 1 if disc else max(abs(a[1] - b[1]), abs(a[2] - b[2])) < 1
    want = {a[0]: min((b[0] for o in asked if o[0] == a[0] is not None for b in far if near(o, b)), default=None) for a in asked}
    for first in (1, 2, 32, 1000):
        monkeypatch.setattr(grid, "FIRST", first)
        rows = grid.hits(c, p, "c", "p", 1.0, disc).collect()
        assert len(rows) == len(asked) and all(want[r.c] == r.p for r in rows)
    monkeypatch.setattr(grid, "FIRST", 32)
    crowd = spark.range(4000).selectExpr("id as p", "id % 10 / 100 as x", "0.0 as y")
    clicks = spark.range(300).selectExpr("id as c", "0.05 as x", "0.0 as y")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert joined_rows(grid.hits(clicks, crowd, "c", "p", 1.0, disc)) <= 300 * 32
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rows_by_number(spark, tmp_path):
    rows = frames.numbered(spark.range(1000).select((F.col("id") * 3).alias("k")), "k")
    write_numbered(rows, f"{tmp_path}/d", files=10)
    d = Numbered(spark, f"{tmp_path}/d")
    assert len(d) == 1000 and d[0].k == 0 and d[999].k == 2997 and d[-1].k == 2997 and d[457].k == 1371
    for at, most in ((slice(100, 110), 2), (slice(5, 6), 1), (slice(990, 2000), 2)):
        part = d[at]
        assert [r.idx for r in part.collect()] == list(range(1000))[at] and len(part.inputFiles()) <= most
    assert len(d.part(457, 458).inputFiles()) == 1
    assert [r.idx for r in d[10:40:7].collect()] == [10, 17, 24, 31, 38] and d[5:5].count() == 0
    for k in (1000, -1001):
        with pytest.raises(IndexError):
            d[k]
    write_numbered(rows.limit(0), f"{tmp_path}/none")
    none = Numbered(spark, f"{tmp_path}/none")
    assert len(none) == 0 and none[0:5].count() == 0
