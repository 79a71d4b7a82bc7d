"""Spelling variants against comparing all pairs of words; their SQL is in test_archive."""

import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np

from tidepool.llm import spelling

DOCS = "doc_id long, text string"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_hand(rows, letters=6, least=5, times=5, every=None):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if every and h % every == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= least}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def run(spark, rows, **how):
    got = spelling.variants(spark.createDataFrame(rows, DOCS).repartition(3), **how).collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got)


def texts(seed, n=60):
    """Words of few letters with errors, so that many are near each other, in chains of forms."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abéÿ", k=rng.randint(5, 8))) for _ in range(12)]

    def spoiled(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abZ") + w[k:], w[:k] + rng.choice("aé") + w[k + 1 :]])

    weights = [3**k for k in range(6)] * 2
    return [(k, " ".join(spoiled(w) for w in rng.choices(words, weights, k=40))) for k in range(n)]


def test_pairs(spark):
    for seed in (1, 2):
        rows = texts(seed) + [(None, "Ärger×÷ß ärger×÷ß 1ärger×÷ß2"), (7, None), (8, "")]
        for how in ({}, {"every": 3}, {"letters": 3, "least": 2, "times": 2}):
            assert run(spark, rows, **how) == by_hand(rows, **how), (seed, how)


def test_shards_and_rounds_do_not_change_results(spark, monkeypatch):
    rows = texts(3)
    want = by_hand(rows, least=2)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 20)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 900)
    monkeypatch.setattr(spelling, "HELD", 10)
    assert run(spark, rows, least=2) == want


def test_every_neighbour_once():
    words = sorted("".join(w) for k in range(1, 6) for w in product("ab", repeat=k))
    trie = spelling.Trie.unpacked(spelling.Trie.of([w.encode() for w in words], np.arange(1, len(words) + 1)).packed())
    for w in [*words, "abababa", "", "c"]:
        got = list(trie.near(w))
        assert sorted(x for x, _ in got) == [x for x in words if one_apart(w, x)]
        assert all(words[n - 1] == x for x, n in got)


def test_chain_of_forms_and_ties(spark):
    rows = [(1, "aaaaaa " * 5 + "aaaaab " * 25 + "aaaabb " * 125 + "cccccc " * 5 + "ccccca " * 25 + "cccccb " * 25)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got["aaaaaa"][1:3] == ("aaaaab", "aaaabb") and got["cccccc"][1:3] == ("ccccca", "ccccca") and got["aaaabb"][1:3] == ("", "aaaabb")


def test_very_long_words(spark):
    long = "ab" * 20_000
    rows = [(k, f"{long} {'z' * 50_000} {long}c") for k in range(5)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[long][4] == got[long + "c"][4] == 1 and got["z" * 50_000][4] == 0


def test_no_rows(spark):
    assert run(spark, [(1, None), (None, "")]) == []
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_and_extra_columns(spark):
    rows = [(1, "letter letter lettre")] * 5
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n", "'x' as word")
    assert sorted((r.word, r.n) for r in spelling.variants(docs).collect()) == [("letter", 10), ("lettre", 5)]
