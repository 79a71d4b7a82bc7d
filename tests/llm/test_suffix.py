"""Repeated strings against a dictionary of all windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidepool.llm import suffix_dedup

DOCS = "doc_id long, text string"


def by_hand(rows, least, order=()):
    """``order``: of texts of one id."""
    order = {t: k for k, t in enumerate(order)}
    seen, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: (x[0], order.get(x[1], 0))):
        data = (t or "").encode()
        mark = np.zeros(len(data), bool)
        for k in range(len(data) - least + 1):
            if seen.setdefault(data[k : k + least], (i, t, k)) != (i, t, k):
                mark[k : k + least] = True
        edge = np.flatnonzero(np.diff(np.r_[0, mark, 0].astype(int))).tolist()
        out[i, t] = (len(data), list(zip(edge[::2], edge[1::2], strict=True)), np.frombuffer(data, np.uint8)[~mark].tobytes())
    return out


def check(df, rows, least=100):
    got = suffix_dedup.dedup(df.withColumn("whole", df.text), least, carry=("whole",)).collect()
    order = [r.text for r in df.orderBy(F.xxhash64("text")).collect()]
    want = by_hand(rows, least, order)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert not r.spans
        else:
            assert (r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) == want[r.doc_id, r.rest.whole], r.doc_id


@pytest.mark.parametrize("most", [4096, 3])
def test_documents_table(spark, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", most)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1 << 16)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    check(docs.repartition(5), [(r.doc_id, r.text) for r in docs.collect()])


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcé "), n))
    shared = word(230)
    rows = [(None, shared), (0, None), (1, ""), (2, "a" * 1000), (3, "ab" * 300), (4, "a" * 99), (5, "a" * 100), (6, shared[:150] + word(80) + shared[100:]), (7, word(50) + shared), (8, shared), (8, shared), (8, word(60) + shared[30:200] + word(50)), (8, None), (8, word(10) + shared), (9, word(3000))]
    for k in range(10, 60):
        rows.append((k, word(60) + shared[: 60 + k] + word(40)))
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as doc", "2 as t").repartition(6)
    for least in (100, 40):
        check(df, rows, least)
    assert suffix_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_expansion_parts_suffixes_by_their_first_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    order, inverse, rows = suffix_dedup.transform(data, 12)
    twice = data.tobytes() * 2
    starts = [twice[k : k + 12] for k in order.tolist()]
    assert starts == sorted(starts) and (order[inverse] == np.arange(3000)).all()
    assert suffix_dedup.expand(rows, 12).tolist() == [True] + [a != b for a, b in zip(starts[:-1], starts[1:], strict=True)]


def test_whole_characters_and_carried_columns(spark):
    head = "".join(chr(0x400 + k) for k in range(60))  # two bytes each, none twice
    df = spark.createDataFrame([(1, "a" + head, "x"), (2, "bb" + head, "y")], "doc_id long, text string, t string")
    got = {r.doc_id: r for r in suffix_dedup.dedup(df, 99, chars=True, carry=("t",)).collect()}
    assert got[2].kept.decode() == "bb" and got[2].rest.t == "y" and got[1].kept.decode() == "a" + head


def test_very_long_texts(spark):
    rng = np.random.default_rng(9)
    long = "".join(map(chr, rng.integers(97, 123, 300_000).tolist()))
    rows = [(1, long), (2, long[1000:1200] + "!" + long[299_000:] + "?"), (3, "z" * 300_000), (4, long[:150] + "é" * 60)]
    got = {r.doc_id: r for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[1].spans and bytes(got[1].kept) == long.encode()
    assert [tuple(x) for x in got[2].spans] == [(0, 200), (201, 1201)] and bytes(got[2].kept) == b"!?"
    assert [tuple(x) for x in got[3].spans] == [(1, 300_000)] and bytes(got[3].kept) == b"z"
    assert [tuple(x) for x in got[4].spans][0] == (0, 150) and got[4].n_bytes == 270


@pytest.mark.parametrize("n", [300, 5000, 70_000])
def test_expansion_goes_on_from_the_sort(n):
    rng = np.random.default_rng(n)
    data = rng.choice(np.frombuffer(b"ab\xff", np.uint8), n)
    data[n // 2 : n // 2 + n // 3] = data[: n // 3]
    for depth in (7, 8, 40, 100):
        _, _, rows, known, apart = suffix_dedup.parted(data, depth)
        assert known == 0 if depth < 8 else 8 <= known <= depth
        assert depth < 40 or known >= 24
        assert (suffix_dedup.expand(rows, depth, known, apart) == suffix_dedup.expand(rows, depth)).all()
