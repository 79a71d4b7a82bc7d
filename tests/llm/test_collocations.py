"""Collocations against counting in plain Python; their SQL is in test_archive."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np

from tidepool.llm import collocations

DOCS = "text string, lang string"


def by_hand(rows, least=100, words=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, words + 1) for i in range(len(ws) - k + 1))
    known = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, p), a in known.items():
        longer = [q for (other, q), b in known.items() if other == lang and len(q) > len(p) and 100 * b >= 100 * a]
        if len(p) < 2 or any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
            continue
        cuts = [(int(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, r, p.decode(), -a, l, rr, n[lang], -s) for lang, own in out.items() for r, (s, a, p, l, rr) in enumerate(sorted(own)[:top], 1)]


def run(spark, rows, **how):
    return sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(3), **how).collect())


def texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "of", "new", "york", "City", "aa", "aa", "é", "x y", "\x1fq", "end.", "no,", "a:b"]
    return [("".join(w + rng.choice([" ", "  ", "\t", " ", "\n"]) for w in rng.choices(vocabulary, k=rng.randint(0, 60))), rng.choice(["en", "fr", None])) for _ in range(n)]


def test_counting(spark):
    rows = texts(1) + [(None, "en"), ("", "de"), ("   ", None), ("new york city hall", "es")]
    for how in ({"least": 5}, {"least": 20, "words": 3}, {"least": 8, "top": 7}, {"least": 300}):
        assert run(spark, rows, **how) == sorted(by_hand(rows, **how)), how


def test_overlaps_ties_and_repeated_rows(spark):
    rows = [("a a a a a a", "en")] * 6 + [("b c, c b. b c", "en")] * 6 + [("b c, c b. b c", "en")] * 6
    assert run(spark, rows, least=4) == sorted(by_hand(rows, least=4))


def test_portions_do_not_change_results(spark, monkeypatch):
    rows = texts(2)
    want = sorted(by_hand(rows, least=10))
    monkeypatch.setattr(collocations, "PART_BITS", 16)
    monkeypatch.setattr(collocations, "SHARD_BYTES", 300)
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "SCAN_BYTES", 200)
    assert run(spark, rows * 60, least=600) == sorted(by_hand(rows * 60, least=600))
    assert run(spark, rows, least=10) == want


def test_sketch_is_an_upper_bound():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 1 << 17, 50_000).astype(np.uint64)
    blocks, packed = collocations.packed_cells(cells)
    got = Counter()
    for b, raw in zip(blocks, packed, strict=True):
        m = len(raw) // 3
        for place, n in zip(np.frombuffer(raw, "<u2", m).tolist(), raw[2 * m :], strict=True):
            got[b << 16 | place] += n
    assert got == Counter(cells.tolist())


def test_very_long_text_and_extra_columns(spark):
    rows = [("to be or not to be " * 30_000, "en", 1), ("to be", "en", 2)]
    docs = spark.createDataFrame(rows, "text string, lang string, n long").withColumnRenamed("n", "score")
    got = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    assert got == sorted(by_hand([r[:2] for r in rows]))


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert run(spark, [(None, None), ("", "en")]) == []


def test_texts_are_read_as_often_whatever_the_candidates(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART_BITS", 16)
    monkeypatch.setattr(collocations, "SHARD_BYTES", 300)
    monkeypatch.setattr(collocations, "CELL_BYTES", 1, raising=False)
    rows = texts(4) * 60  # 891,600 bytes: 16 cells of the sketch share a bit of the mask
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, DOCS).repartition(3).mapInArrow(counted, DOCS)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=600).collect())
    assert got == sorted(by_hand(rows, least=600))
    assert read.value <= 3 * len(rows)  # their size, the sketch, the counts


def test_masks_of_parts_of_the_cells(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART_BITS", 16)
    monkeypatch.setattr(collocations, "FULL_BITS", 14)
    monkeypatch.setattr(collocations, "CELL_BYTES", 1 / 8)
    parts, masks = [], collocations.masks

    def noted(full, bits):
        for x in masks(full, bits):
            parts.append(x[:2])
            yield x

    monkeypatch.setattr(collocations, "masks", noted)
    rows = texts(5)
    assert run(spark, rows, least=10) == sorted(by_hand(rows, least=10))
    assert len(parts) > 1 and [x for x, _ in parts] == list(range(parts[0][1]))


def test_letters_of_many_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SCAN_BYTES", 50)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = [(" ".join(rng.choices(words, weights=range(400, 0, -1), k=30)) + rng.choice([". ", "", "\t\tw1  w2 w1"]), rng.choice(["en", "fr"])) for _ in range(1500)]
    for n in (2, 3):
        monkeypatch.setattr(collocations, "LETTERS", n)
        assert run(spark, rows, least=6) == sorted(by_hand(rows, least=6))
