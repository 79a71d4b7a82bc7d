"""Language identification: a plain scorer with sets, held-out accuracy, and cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidepool.llm import language
from tidepool.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string"


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
    own = f" {' '.join(w for w in words if w)} ".replace("  ", " ")
    return [own[i : i + k] for k in language.SIZES for i in range(len(own) - k + 1)]


def learned_by_hand(rows):
    docs = {}
    for key, text, lang in rows:
        if key is not None and text is not None and lang is not None and zlib.crc32(str(key).encode()) % 4 != 2:
            docs.setdefault(lang, []).append(set(plain_ngrams(text)))
    share = {lang: {g: sum(g in d for d in own) / len(own) for g in set().union(*own)} for lang, own in docs.items()}
    return {
        lang: {g for g, s in own.items() if s >= language.SHARE and s * len(docs[lang]) >= language.FEWEST - 1e-9 and s >= language.MOST * max(o.get(g, 0) for o in share.values())}
        for lang, own in share.items()
    }


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 400")


def test_filters_hold_the_sets(spark, small):
    model = language.train(small)
    sets = learned_by_hand([(r.doc_id, r.text, r.lang) for r in small.collect()])
    assert set(model.langs) == set(sets)
    bits = 0
    for k, lang in enumerate(model.langs):
        grams = sorted(sets[lang])
        own, of, _ = language.ngrams([g.strip() for g in grams])
        by_text = {g: h for g, h in zip((x for g in grams for x in plain_ngrams(g.strip())), own.tolist(), strict=True)}
        hashes = np.array([by_text[g] for g in grams if g in by_text], np.uint64)
        for h, cell in enumerate(language.places(hashes)):
            assert (model.cells[0, h][cell] >> k & 1).all()
        bits += len(grams)
    assert bits * 0.99 <= sum(int((model.cells[0, 0] >> k & 1).sum()) for k in range(len(model.langs))) <= bits


def test_scores_by_sets(spark, small):
    rows = [(r.doc_id, r.text, r.lang) for r in small.collect()]
    sets, model = learned_by_hand(rows), language.train(small)
    got = {r.doc_id: r for r in language.predict(small, model).collect()}
    for key, text, _ in rows:
        own = plain_ngrams(text)
        count = np.array([sum(g in sets[lang] for g in own) for lang in model.langs], float)
        assert got[key].lang_pred == model.langs[int(count.argmax())]
        assert abs(got[key].score - count.max() / max(count.sum(), 1)) < 0.02  # what filters find by chance is taken off


def test_held_out_rows_are_right(spark):
    got = QUERIES["op13_language"](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("d2"), "lang")
    right = got.where("held_out").join(docs, F.expr("doc_id = d2")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98 and got.count() == docs.count()
    assert got.where("held_out != (crc32(cast(cast(doc_id as string) as binary)) % 4 = 2)").count() == 0


def test_cases(spark, small):
    model = language.train(small)
    rows = [(1, None, "en"), (2, "", "fr"), (3, "12 !? \n", None), (None, "Der und die", "xx"), (5, "漢字かな", None), (6, "the of and " * 200_000, None), (7, "the of and", None), (7, "the of and", None)]
    got = language.predict(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(9)), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, model.langs[0]), (6, "en"), (7, "en"), (7, "en")]
    assert [r.score for r in got][:3] == [0, 0, 0] and got[4].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert got[6] == got[7]


def test_labels_do_not_enter_predictions(spark, small):
    model = language.train(small)
    other = small.withColumns({"lang": F.lit("zz"), "source": F.lit("q")})
    assert language.predict(small, model).orderBy("doc_id").collect() == language.predict(other, model).orderBy("doc_id").collect()


def test_many_languages_are_in_slices(spark):
    alphabet = [chr(0x4E00 + 7 * k) for k in range(70)]
    rows = [(k * 70 + j, f"{c}{c}{c}{c} {c}{c}" * 3, f"l{j:02}") for k in range(12) for j, c in enumerate(alphabet)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.train(docs)
    assert len(model.langs) == 70 and model.cells.shape[0] == 2
    assert language.predict(docs, model).join(docs.select(F.col("doc_id").alias("d2"), "lang"), F.expr("doc_id = d2")).where("lang != lang_pred").count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (None, "abc", "en")], DOCS)
    model = language.train(docs)
    assert model is None and {tuple(r) for r in language.predict(docs, model).collect()} == {(1, "und", 0.0), (None, "und", 0.0)}
    assert language.predict(spark.createDataFrame([], DOCS), None).count() == 0
