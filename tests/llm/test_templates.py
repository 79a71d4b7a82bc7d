"""Line templates against brute force."""

import re
import time
from collections import defaultdict

import numpy as np

from tests.conftest import DATA
from tidepool.llm import line_templates

DOCS = "doc_id long, text string"


def by_hand(rows, min_docs=5, min_tokens=3, short_docs=25, depth=3, share=0.05):
    """{(id, text): text without its dropped lines}."""
    spaces = re.compile(r"[\x20\x09\x0B-\x0D]+")
    lines = []
    for i, t in {(-(1 << 63) if i is None else i, t) for i, t in rows if t is not None}:
        for k, s in enumerate(t.split("\n")):
            words = ["<*>" if re.search("[0-9]", w) else w for w in spaces.split(s) if w]
            if words:
                lines.append((i, k, t, tuple(words)))
    bodies = defaultdict(set)
    for _, _, t, w in lines:
        bodies[w].add(t)
    leaves = defaultdict(set)
    for w in bodies:
        if len(w) >= min_tokens:
            leaves[len(w), w[:depth]].add(w)
    template = {}
    for leaf, own in leaves.items():
        total = sum(len(bodies[w]) for w in own)
        if total < min_docs or len(own) < 2:
            continue
        support = defaultdict(int)
        for w in own:
            for place in enumerate(w):
                support[place] += len(bodies[w])
        for w in own:
            fixed = tuple(p for p in enumerate(w) if support[p] >= min_docs and support[p] >= share * total)
            if 0 < len(w) - len(fixed) <= len(w) / 2:
                template[w] = (leaf, fixed)
    groups = defaultdict(list)
    for i, k, t, w in lines:
        groups[template.get(w, w)].append((i, k, t, len(w)))
    gone = defaultdict(set)
    for own in groups.values():
        if len({t for _, _, t, _ in own}) >= (min_docs if own[0][3] >= min_tokens else short_docs):
            first = min(x[:2] for x in own)
            for i, k, t, _ in own:
                if (i, k) != first:
                    gone[i, t].add(k)
    return {(i, t): "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[i if i is not None else -(1 << 63), t]) if t is not None else None for i, t in set(rows)}


def check(spark, df, rows):
    got = line_templates.drop_lines(df).collect()
    want = by_hand(rows)
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((i, want[i, t]) for i, t in rows), key=repr)
    return got


def test_documents_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    check(spark, docs.repartition(5), [(r.doc_id, r.text) for r in docs.collect()])


def mixed(n, values=300):
    rng = np.random.default_rng(4)
    return [(k, f"text {k} of its own w{k}x\nthis was written by {chr(97 + rng.integers(values) % 26)}{chr(0x4E00 + rng.integers(values))} about {chr(0x5E00 + rng.integers(values))} on day {k % 31} here") for k in range(n)]


def test_two_word_fields_are_variable_at_every_size(spark):
    for n in (100, 1000, 10_000):
        got = check(spark, spark.createDataFrame(mixed(n), DOCS).repartition(3), mixed(n))
        assert sum("this was written by" in r.text for r in got) == 1


def test_edge_cases(spark):
    rows = [(None, "shared line of five words\nnull id"), (None, None), (0, None), (1, ""), (2, "\n\n"), (3, " \t \n a"), (4, "x" * 50_000), (5, "shared\tline  of five words\n\nrest"), (5, "shared line of five words\nother text of one id"), (5, "shared line of five words\nother text of one id")]
    rows += [(k, f"shared line of five words \r\nown {'ab' * k}\nshared line of five words\nOk") for k in range(6, 40)]
    rows += [(k, "copies of one text are no boilerplate\nat all times") for k in range(40, 60)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    check(spark, df, rows)
    wide = line_templates.drop_lines(df.selectExpr("*", "7 as n_lines", "8 as line", "9 as m", "10 as `a.b`"))
    assert wide.columns == ["doc_id", "text", "line", "m", "a.b", "n_lines", "n_dropped"] and wide.where("line = 8 and m = 9 and `a.b` = 10").count() == len(rows)
    bare = line_templates.drop_lines(df.selectExpr("*", "7 as n_lines"), n_lines=None, n_dropped=None)
    assert bare.columns == ["doc_id", "text", "n_lines"] and bare.where("n_lines = 7").count() == len(rows)
    assert line_templates.drop_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_of_many_lines_take_time_in_proportion(spark):
    took = []
    for n in (20_000, 80_000):
        rows = [(k, "\n".join(f"line number {chr(0x4E00 + j % 9000)} {chr(0x4E00 + j // 9000)} same" for j in range(n))) for k in range(1)] + [(k, f"q{chr(97 + k)}") for k in range(1, 8)]
        rows += [(k, rows[0][1] + f"\nown end {chr(97 + k)}") for k in range(8, 14)]
        df = spark.createDataFrame(rows, DOCS)
        began = time.time()
        got = {r.doc_id: r for r in line_templates.drop_lines(df).collect()}
        took.append(time.time() - began)
        assert got[0].n_dropped == 0 and got[8].n_dropped == n
    assert took[1] < 8 * took[0] + 5
