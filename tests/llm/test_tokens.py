"""Packing and pieces against the libraries."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidepool.llm import packing, pieces
from tidepool.llm.queries import tokenizer_path

ODD = [None, "", " ", "  ", "a b", " a  b \n c ", "\n\n", "é ﬁ ½ <s> </s> <|endoftext|>", "▁x ▁", "\x00 \x85\x1c　", "word " * 5000, "x" * 20000, "a. b! c?\nd\n\n e"]
DOCS = "doc_id long, text string"


def some(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(ODD)], DOCS))


def test_pieces_are_the_library_s(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    sp, table = pieces.load(model)
    assert table is not None
    docs = some(spark)
    want = {r.doc_id: sp.encode(r.text or "", add_eos=True) for r in docs.collect()}
    got = {r.doc_id: r for r in pieces.encode(docs.selectExpr("*", "1 as ids"), model).collect()}
    assert {k: list(r.ids) for k, r in got.items()} == want
    assert {k: r.decoded for k, r in got.items()} == {k: sp.decode(x) for k, x in want.items()}
    assert pieces.encode(docs.limit(0), model).count() == 0


def test_pieces_of_null_and_repeated_rows(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    sp, _ = pieces.load(model)
    rows = [(None, "null id"), (None, "null id"), (None, None), (4, "one text"), (4, "another text"), (4, "one text"), (4, None)]
    got = pieces.encode(spark.createDataFrame(rows, DOCS).repartition(3), model).collect()
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=repr) == sorted(((i, x, sp.decode(x)) for i, x in ((i, sp.encode(t or "", add_eos=True)) for i, t in rows)), key=repr)


def test_packing(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    tok, table = packing.load(path)
    assert table is not None
    docs = some(spark)
    want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    rows = packing.pack(docs.selectExpr("*", "1 as start"), path).collect()
    own, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert r.crc == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
    for k, ids in want.items():
        at = 0
        for r in sorted(own[k], key=lambda r: r.start):
            assert r.start == at and list(r.ids) == ids[at : at + r.length] and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    padding = tokens = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        order = [r.doc_id for r in sorted(s, key=lambda r: r.offset)]
        assert order == sorted(order)
    assert padding < 0.02 * tokens
    assert packing.pack(docs.limit(0), path).count() == 0


def unpacked(rows):
    """(doc_id, ids) of each document, from the pieces in order of the stream."""
    out = []
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            out.append((r.doc_id, []))
        assert out[-1][0] == r.doc_id and len(out[-1][1]) == r.start
        out[-1][1].extend(r.ids)
    return out


def test_null_and_repeated_ids_and_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 3000)
    path = tokenizer_path("byte_bpe_50k.json")
    tok, _ = packing.load(path)
    rows = [(None, "null one. " * 30), (None, "null two"), (None, None), (7, "same id " * 50), (7, "other text. " * 300), (7, ""), (-5, "twice. " * 40), (-5, "twice. " * 40), (3, None), (3, None)]
    rows += [(7, f"many texts of one id {k}. " * 20) for k in range(60)]
    got = unpacked(packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), path, size=256).collect())
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [i for i, _ in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    names = spark.createDataFrame([(f"d{k}", f"text {k}. " * 40) for k in range(50)] + [(None, "x"), ("d", "y")], "doc_id string, text string")
    order = [i for i, _ in unpacked(packing.pack(names, path, size=256).collect())]
    assert order == [None, *sorted(r.doc_id for r in names.where("doc_id is not null").collect())]


def test_cuts_hang_on_the_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 200_000)
    path = tokenizer_path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    runs = [sorted(map(tuple, packing.pack(d, path, with_ids=False).collect())) for d in (docs, docs.repartition(13), docs.repartition(2, "source").orderBy(F.desc("doc_id")))]
    assert runs[0] == runs[1] == runs[2]
    used = defaultdict(int)
    for r in runs[0]:
        used[r[5]] += r[2]
    assert len({s >> 32 for s in used}) > 5 and sum(n < 128 for n in used.values()) < 0.02 * len(used)
    sizes = packing.order_key(docs.select("doc_id", F.col("text").alias("t"))).select("key", F.octet_length("t").alias("size"))
    starts = packing.borders(sizes)
    per = defaultdict(int)
    for r in sizes.collect():
        per[sum(x <= r.key for x in starts)] += r["size"]
    assert starts == sorted(starts) and max(per.values()) <= 200_000 and len(per) == len(starts)


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_the_best(seed):
    rng = np.random.default_rng(seed)
    size, word, window = 64, 9, 5 * (seed % 3)
    places = np.unique(rng.integers(1, 400, 60)).tolist()
    marks = [(p, int(rng.integers(0, 4))) for p in places]
    cuts = packing.best_cuts(places[-1], marks, size, word, window)
    step, nodes, at = size // 32, [(0, 0)], 0
    for j, c in marks:
        while j - nodes[-1][0] > step:
            nodes.append((nodes[-1][0] + step, word))
        if j > nodes[-1][0]:
            nodes.append((j, c))
    pad = lambda n: 0 if n & (n - 1) == 0 else size - n
    best = {0: 0}
    for j, c in nodes[1:]:
        best[j] = min(best[i] + pad(j - i) for i, _ in nodes if i < j and j - i <= size) + c + window
    cost = dict(nodes)
    assert sum(pad(b - a) + cost[b] + window for a, b in zip(cuts[:-1], cuts[1:], strict=True)) == best[places[-1]]
