"""The pipeline's stages against brute force, one after the other and as a whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm import test_pairs, test_suffix, test_templates
from tidepool.llm import packing, toxicity
from tidepool.llm.queries import tokenizer_path
from tidepool.llm.shared import table

STAGE = dict(corpus_pipeline.STAGES)


def near_by_hand(rows):
    """Of (id, text) rows, the one of each group of links that stays."""
    distinct = sorted(set(rows), key=repr)
    sets = {k: test_pairs.shingles(t, 5) for k, (_, t) in enumerate(distinct)}
    links = [(a, b) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    groups = {}
    for k, low in test_pairs.closed(sets, links).items():
        groups.setdefault(low, []).append(distinct[k])
    return [sorted({r[0] for r in own}, key=lambda i: (i is None, i or 0))[0] for own in groups.values()]


def repeats_by_hand(rows, order):
    """{(id, text): text without strings that start earlier}, whole characters only."""
    marks = test_suffix.by_hand(rows, 100, order)
    out = {}
    for (i, t), (_, spans, _) in marks.items():
        data = (t or "").encode()
        at = [0]
        for lo, hi in spans:
            while lo < hi and data[lo] & 0xC0 == 0x80:
                lo += 1
            while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
                hi -= 1
            at += [lo, hi]
        at.append(len(data))
        out[i, t] = b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True)).decode()
    return out


def made(spark):
    """The smallest documents with planted cases, and columns whose names the stages use inside."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "se", "ti", "vo", "zu", "xi")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base, passage = text(120), text(60)
    rows = [(-1, text(80)), (-1, text(80)), (-1, base), (-2, base), (-3, base + " more"), (None, base), (None, text(40)), (None, None), (-4, None), (-5, ""), (-5, "")]
    rows += [(-10 - k, f"{text(50)}\nthis line stands in many documents\n{passage} {text(50)}") for k in range(12)]
    extra = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("made"), "n_chars": F.char_length("text").cast("long")})
    return docs.unionByName(extra).selectExpr("*", "doc_id as rest", "n_chars as score", "'x' as _", "1 as n_lines", "2 as row", "3 as `a.b`")


def test_stages(spark):
    docs = made(spark)
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    rows = pairs(docs)
    model = toxicity.train(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    good = {r.t for r in toxicity.with_score(docs.select(F.col("text").alias("t")), model, "t", "s").where("s < 0.5").collect()}
    out = STAGE["toxicity"](spark, docs, SMALL).cache()
    assert out.columns == docs.columns and sorted(pairs(out), key=repr) == sorted(((i, t) for i, t in rows if t in good), key=repr)

    rows = pairs(out)
    want = test_templates.by_hand(rows)
    out = STAGE["line_templates"](spark, out, SMALL).cache()
    assert out.columns == docs.columns and sorted(pairs(out), key=repr) == sorted(((i, want[i, t]) for i, t in rows), key=repr)
    assert sum("this line stands" in (t or "") for _, t in pairs(out)) == 1

    rows = pairs(out)
    out = STAGE["jaccard_join"](spark, out, SMALL).cache()
    assert out.columns == docs.columns and sorted((i for i, _ in pairs(out)), key=repr) == sorted(near_by_hand(rows), key=repr)
    assert set(pairs(out)) <= set(rows) and sum(i == -1 for i, _ in pairs(out)) == 2 and sum(i in (-2, -3) for i, _ in pairs(out)) == 1

    rows = pairs(out)
    order = [r.text for r in out.orderBy(F.xxhash64("text")).collect()]
    want = repeats_by_hand(rows, order)
    out = STAGE["suffix_dedup"](spark, out, SMALL).cache()
    assert out.columns == docs.columns and sorted(pairs(out), key=repr) == sorted(((i, want.get((i, t), t or "")) for i, t in rows), key=repr)
    assert out.where("n_chars != char_length(text)").count() == 0 and out.where("a.b is null".replace("a.b", "`a.b`")).count() == 0

    rows = pairs(out)
    tok, _ = packing.load(tokenizer_path("byte_bpe_50k.json"))
    got = []
    for r in sorted(STAGE["packing"](spark, out, SMALL).collect(), key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            got.append((r.doc_id, []))
        assert got[-1][0] == r.doc_id and len(got[-1][1]) == r.start
        got[-1][1].extend(r.ids)
    assert sorted(got, key=repr) == sorted(((i, tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows), key=repr)


def test_run(spark):
    docs = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    got = corpus_pipeline.run(spark, SMALL)
    key = lambda df: sorted((r.doc_id, r.start, r.length, tuple(r.ids)) for r in df.collect())
    whole = {}
    for i, start, _, ids in key(got):
        whole.setdefault(i, []).extend(ids)
    want = {}
    for i, start, _, ids in key(docs):
        want.setdefault(i, []).extend(ids)
    assert whole == want


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_table(spark, name):
    assert STAGE[name](spark, table(spark, SMALL, "documents").limit(0), SMALL).count() == 0
