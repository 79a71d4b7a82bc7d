"""Similarity operators against brute force."""

import pathlib
import re
from itertools import combinations

import numpy as np
import pytest

from tests.conftest import DATA
from tidepool.llm import jaccard_join, vector_lsh
from tidepool.llm.links import components
from tidepool.llm.shared import shared_dir

DOCS = "doc_id long, text string"


def closed(ids, links):
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return {i: root(i) for i in ids}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def by_hand(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if (n := len(sets[a] & sets[b])) and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    low = closed(sets, links)
    return sorted((i, len(s), low[i]) for i, s in sets.items())


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_documents_table(spark, width, percent):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, jaccard_join.jaccard_components(docs, width, percent).collect()))
    assert got == by_hand(rows, width, percent)


def test_edited_copies_and_edge_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "x " * 4000), (7, "x x x x x"), (8, "É é"), (9, "é é")]
    words = [f"w{k}" for k in range(400)]
    for g in range(6):
        base = [words[k] for k in rng.integers(0, 400, 20 + 40 * g)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.integers(0, 2 + g // 2)):
                text[rng.integers(0, len(text))] = words[rng.integers(0, 400)]
            rows.append((100 + len(rows), " ".join(text)))
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as key", "2 as rep"), 3, 90).collect()))
    assert got == by_hand(rows, 3, 90)
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_large_group_of_near_copies_and_common_passage(spark):
    rng = np.random.default_rng(9)
    words = [f"v{k}" for k in range(3000)]
    base = [words[k] for k in rng.integers(0, 3000, 120)]
    passage = [words[k] for k in rng.integers(0, 3000, 40)]
    rows = []
    for k in range(300):
        text = list(base)
        text[rng.integers(0, 120)] = f"u{k}"
        rows.append((k, " ".join(text)))
    for k in range(300, 600):
        rows.append((k, " ".join([words[x] for x in rng.integers(0, 3000, 60)] + passage)))
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(5), 3, 90).collect()))
    assert got == by_hand(rows, 3, 90)


def test_bands_bound_the_difference():
    for percent in (80, 90):
        bands = jaccard_join.Bands(percent)
        sizes = np.arange(1, 3000)
        of = bands.of(sizes)
        for n, b in zip(sizes.tolist(), of.tolist(), strict=True):
            assert bands.top(b - 1) < n <= bands.top(b)
            least = -(-percent * n // 100)
            assert of[least - 1] in (b, b - 1)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1200), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_tasks_and_files_by_their_links(spark):
    """Rounds over few links ask for few tasks, however many partitions a shuffle has, and leave one table."""
    links = [(k, k + 7) for k in range(300) if k % 50] + [(1000, k) for k in range(1001, 1200)]
    rng = np.random.default_rng(3)
    name = rng.permutation(1200).tolist()
    links = [(name[a], name[b]) for a, b in links if b < 1200]
    src = spark.createDataFrame(links, "a long, b long").repartition(16)
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    context, shared = spark.sparkContext, pathlib.Path(shared_dir(spark).removeprefix("file://"))
    files = lambda: set(shared.rglob("part-*"))
    old = files()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        context.setJobGroup("few-tasks", "components")
        got = {r.id: r.component for r in components(src).collect()}
        track = context.statusTracker()
        stages = {s for j in track.getJobIdsForGroup("few-tasks") for s in track.getJobInfo(j).stageIds}
        done = sorted(info.numCompletedTasks for s in stages if (info := track.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    ids = {i for x in links for i in x}
    assert got == closed(ids, links)
    assert sum(n >= 97 for n in done) <= 6  # joins' own stages; a round had fifteen of them
    assert len(files() - old) <= context.defaultParallelism


def vectors_by_hand(rows, least):
    good = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = (label, x / np.linalg.norm(x))
    pairs = [(a, b) for a, b in combinations(good, 2) if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= least - 1e-12]
    return pairs


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vector_lsh, "BLOCK", block)
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(64).astype(np.float32)
    rows += [(10_000 + k, (hot + np.float32(0.02) * rng.standard_normal(64).astype(np.float32)).tolist(), 3) for k in range(60)]
    rows += [(20_000 + k, hot.tolist(), 3) for k in range(40)]
    rows += [(30_000, None, 1), (30_001, [], 1), (30_002, [0.0] * 64, 1), (30_003, [float("nan")] * 64, 1), (30_004, [None] * 64, 1), (30_005, hot.tolist(), None), (30_006, [1.0], 1), (30_007, [2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r for r in vector_lsh.link_vectors(df, 0.93).collect()}
    pairs = vectors_by_hand(rows, 0.93)
    n = dict.fromkeys([r[0] for r in rows], 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows)
    assert all(got[i].n_links <= n[i] for i in n)
    assert sum(got[i].n_links for i in n) >= 0.97 * sum(n.values())
    low = closed(n, pairs)
    assert sum(got[i].component_id != low[i] for i in n) <= 0.02 * len(n)
    assert all(got[i].kept == (got[i].component_id == i) for i in n)


def test_vectors_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(8)
    hot = rng.standard_normal((4, 16))
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.0, 1.0, 0.01], 1), (4, [0.01, 1.0, 0.0], 1)]
    rows += [(None, [0.0, 0.0, 5.0], 1), (None, [0.0, 0.0, 5.0], 1), (None, [0.0, 0.0, 5.0], 2), (7, [0.0, 0.0, 5.0], 3), (None, [0.0, 0.0, 5.0], 3), (8, [0.0, -0.0, 2.5], 3)]
    rows += [(int(k % 30), (hot[k % 4] + 0.01 * rng.standard_normal(16)).tolist(), int(k % 4)) for k in range(200)]
    rows += [(9, [float("inf"), 1.0, 1.0], 1), (9, None, 1), (9, [0.0] * 3, 1), (9, [1.0] * 3, None)]
    good = [(k, r[2], np.array(r[1]) / np.linalg.norm(r[1])) for k, r in enumerate(rows) if r[1] and r[2] is not None and np.isfinite(r[1]).all() and any(r[1])]
    pairs = [(a, b) for (a, la, x), (b, lb, y) in combinations(good, 2) if la == lb and len(x) == len(y) and x @ y >= 0.93]
    low = closed(range(len(rows)), pairs)
    names = {}
    for k, r in enumerate(rows):
        names[low[k]] = min((x for x in (names.get(low[k]), r[0]) if x is not None), default=None)
    n = [sum(k in p for p in pairs) for k in range(len(rows))]
    want = sorted(((r[0], n[k], names[low[k]], r[0] == names[low[k]]) for k, r in enumerate(rows)), key=repr)
    for kind in ("double", "float"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 as cid", "2 as codes", "3 as v").repartition(3)
        assert sorted(map(tuple, vector_lsh.link_vectors(df).collect()), key=repr) == want
    assert vector_lsh.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_documents_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (None, a), (None, None), (5, None)]
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as t", "2 as n"), 3, 90).collect()), key=repr)
    assert [(r[0], r[2]) for r in got] == sorted([(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (None, None), (None, None), (5, 5)], key=lambda r: repr((r[0], 38)))


def test_a_place_that_most_rows_share(spark):
    """Most texts are a common passage with a word of their own, so that they meet at nearly all places."""
    common = " ".join(f"w{k}" for k in range(120))
    rows = [(k, f"{common} own{k}a own{k}b" if k % 3 else f"{common} far {' '.join(f'x{k}y{j}' for j in range(40))}") for k in range(90)] + [(200, "apart " * 9), (201, None)]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS), 3, 90).collect())
    assert got == by_hand(rows, 3, 90)
