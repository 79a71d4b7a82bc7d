"""What the toxic dictionary learns."""

import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidepool.llm import toxicity

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo", "zu") for c in ("n", "l", "r", "x")]


def flagged(model, rows):
    pairs = model.compressors()
    return toxicity.curve(np.array([toxicity.evidence(t, pairs) for t in rows]), model.weights) >= 0.5


def made(rng, planted, n=60):
    """Texts of 60 words, each with ``planted()`` put in at six places."""
    out = []
    for _ in range(n):
        words = rng.choices(WORDS, k=60)
        for _ in range(6):
            words.insert(rng.randrange(len(words)), planted())
        out.append(" ".join(words))
    return out


def test_common_stem_of_rare_words_tells():
    rng = random.Random(2)
    toxic = made(rng, lambda: "grumbel" + rng.choice(WORDS) + rng.choice(WORDS), 120)
    ordinary = made(rng, lambda: rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS), 120)
    model = toxicity.fit(toxic[:90], ordinary[:90], 0.5)
    assert flagged(model, toxic[90:]).mean() > 0.9 and flagged(model, ordinary[90:]).mean() < 0.1


def tongues(rng, n):
    """Texts of three vocabularies, one of them common."""
    out = []
    for i in range(n):
        ends, middle = (("bdg", "aeiou"), ("ptk", "yqxzj"), ("mnl", "wfhcs"))[(0, 0, 0, 1, 2)[i % 5]]
        out.append(" ".join("".join(rng.choice(ends) + rng.choice(middle) for _ in range(rng.choice((1, 2, 3, 4)))) for _ in range(120)))
    return out


def test_kinds_of_text():
    rng = random.Random(5)
    own, other = (toxicity.once(tongues(rng, 500)) for _ in range(2))
    kinds = toxicity.alike(own, other)
    for side in (0, 1):
        assert sorted(i for x in kinds for i in x[side]) == list(range(500))
    assert len(kinds) >= 3 and all(min(len(a), len(b)) >= toxicity.ENOUGH for a, b in kinds)
    assert all(len({(0, 0, 0, 1, 2)[i % 5] for i in x}) == 1 for pair in kinds for x in pair)
    assert toxicity.alike(own[:100], other) == [(list(range(100)), list(range(500)))]  # too few for kinds


CHECKED = DATA.replace("sf0.01", "check_s")


@pytest.mark.skipif(not os.path.exists(f"{CHECKED}/labels.parquet"), reason="the check tool's tables")
def test_held_out_rows_of_rare_languages():
    docs = pd.read_parquet(f"{CHECKED}/documents.parquet", columns=["doc_id", "text", "lang"]).merge(pd.read_parquet(f"{CHECKED}/labels.parquet"), on="doc_id").dropna(subset=["text", "toxic"])
    docs["held"] = [zlib.crc32(str(k).encode()) % 5 == 0 for k in docs.doc_id]
    train, held = docs[~docs.held], docs[docs.held]
    model = toxicity.fit(*[train.text[train.toxic == k].tolist()[: toxicity.SAMPLE] for k in (1, 0)], (train.toxic == 1).mean())
    for lang in ("en", "de", "fr", "es"):
        assert flagged(model, held.text[(held.toxic == 1) & (held.lang == lang)].tolist()).mean() >= 0.75
    assert flagged(model, held.text[held.toxic == 0].tolist()[:300]).mean() <= 0.02


def labelled(sf):
    root = DATA.replace("0.01", sf)
    docs = pd.read_parquet(f"{root}/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet(f"{root}/labels.parquet"), on="doc_id").dropna(subset=["text", "toxic"])
    docs["held"] = [zlib.crc32(str(k).encode()) % 5 == 0 for k in docs.doc_id]
    docs["o"] = [zlib.crc32(f"{k}/".encode()) for k in docs.doc_id]
    return docs.sort_values("o")


@pytest.mark.parametrize("most", [1, 3, 30, 500])
def test_every_sample_is_a_whole_window(monkeypatch, most):
    docs = labelled("0.1")
    toxic, ordinary = (docs.text[(docs.toxic == k) & ~docs.held].tolist()[:most] for k in (1, 0))
    seen = []
    plain = zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, samples, **how: seen.extend(samples) or plain(size, samples, **how))
    pairs = toxicity.dictionaries(toxic, ordinary)
    own, other = ({w for t in x for w in toxicity.windows(t)} for x in (toxic, ordinary))
    assert len(pairs) == toxicity.PAIRS and set(seen) <= own | other
    long = {w for t in toxic + ordinary if len(toxicity.WORD.findall(t)) >= toxicity.WINDOW for w in list(toxicity.windows(t))[:-1]}
    assert all(len(w.split()) == toxicity.WINDOW for w in seen if w in long)
    assert all(len(a) == len(b) and a != b for a, b in pairs)


def test_whole_texts_are_learned_from():
    docs = labelled("0.1")
    toxic, ordinary = (docs.text[(docs.toxic == k) & ~docs.held].tolist()[:20] for k in (1, 0))
    kept = [w for x in toxicity.once(ordinary) for w in x]
    runs = lambda w: {b" ".join(w.split()[i : i + 3]) for i in range(max(len(w.split()) - 2, 1))}
    have = {r for w in kept for r in runs(w)}
    assert all(runs(w) & have for t in ordinary for w in toxicity.windows(t))  # what is left out shares words with what is kept
    assert toxicity.once(toxic + toxic)[len(toxic) :] == [[] for _ in toxic]


def test_evidence_by_a_plain_scorer():
    docs = labelled("0.01")
    model = toxicity.fit(*[docs.text[(docs.toxic == k) & ~docs.held].tolist() for k in (1, 0)])
    fresh = lambda d, w: len(zstandard.ZstdCompressor(level=4, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False).compress(w))
    for text in [*docs.text[docs.held].tolist()[:12], "", "one", "a b c d e f"]:
        words = re.findall(r"\w+", text.lower())
        ws = {" " + " ".join(words[k : k + 5]) + " " for k in range(0, max(len(words) - 1, 1), 4)}
        got = []
        for w in (x.encode() for x in ws):
            gains = [fresh(b, w) - fresh(a, w) for a, b in model.pairs]
            means = [sum(gains[: k + 1]) / (k + 1) for k in range(len(gains))]
            got.append(means[-1] if min(means) >= toxicity.ONWARD else 0.0)
        want = (max(got), np.log1p(sum(x for x in got if x >= toxicity.MARGIN)), np.log1p(len(got)))
        assert np.allclose(toxicity.evidence(text, model.compressors()), want)


def test_held_out_rows_of_a_larger_table():
    docs = labelled("0.1")
    train, held = docs[~docs.held], docs[docs.held]
    toxic, ordinary = (train.text[train.toxic == k].tolist()[: toxicity.SAMPLE] for k in (1, 0))
    model = toxicity.fit(toxic, ordinary, (train.toxic == 1).mean())
    caught, wrong = (flagged(model, held.text[held.toxic == k].tolist()[:n]) for k, n in ((1, None), (0, 300)))
    assert caught.mean() >= 0.5 and wrong.mean() <= 0.02


def test_held_out_rows_and_edge_cases(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, None), (-3, "x " * 200_000), (-4, "moron trash " * 40), (-4, "moron trash " * 40), (-5, "a\x00b")], "doc_id long, text string")
    model = toxicity.train(docs, labels.selectExpr("*", "1 as k", "2 as o", "3 as t"))
    rows = toxicity.score(docs.select("doc_id", "text").unionByName(odd).selectExpr("*", "1 as t", "2 as score"), model).collect()
    got = {r.doc_id: r.score for r in rows}
    assert len(rows) == docs.count() + 7 and all(0 <= r.score <= 1 for r in rows)
    assert got[None] == got[-1] == got[-2] < 0.5 and got[-3] < 0.5 <= got[-4]
    mark = {r.doc_id: r.toxic for r in labels.where(toxicity.held_out(labels.doc_id)).collect() if r.toxic is not None and r.doc_id in got}
    caught = [got[k] >= 0.5 for k, y in mark.items() if y == 1]
    wrong = [got[k] >= 0.5 for k, y in mark.items() if y == 0]
    assert sum(caught) >= 0.5 * len(caught) and sum(wrong) <= 0.05 * len(wrong)
    assert spark.range(1).select(toxicity.held_out(F.lit(None))).first()[0] is False
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert none is None and toxicity.score(docs, none).where("score != 0").count() == 0
    assert toxicity.train(docs.limit(0), labels) is None and toxicity.score(docs.limit(0), model).count() == 0
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert again == model
