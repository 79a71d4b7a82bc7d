"""Language of texts by bit-sliced Bloom filters over letter n-grams.

A cell of a filter holds a bit for each language, so that one look gives all languages that may
contain an n-gram: the cells of its ``HASHES`` hashes, and-ed.  A language contains an n-gram that at least
a ``SHARE`` of its documents hold, unless another language holds it more than ``1 / MOST`` times as often.  A text's n-grams
are counted for each language that contains them; of the count of a language goes what its filter's
share of set bits gives by chance, and the greatest corrected count decides.

The filters are learned from a bounded sample of labelled rows (``SAMPLE`` of each language, by hash of the id), whole
texts; n-grams are counted by Spark, and the cells that come to the driver are at most ``HASHES << BITS`` for
each 63 languages.  Prediction reads nothing but the text.

Cases: null texts, and texts without letters, are ``und`` with a score of 0; so is all where no language is learned; letters that no language
contains give the language of most sampled rows with a score of 0, as ties go to it; rows with a null id are predicted but not learned from; repeated rows
and ids are learned from as they stand; an empty table gives no rows; very long texts are looked at whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import named, small_or_joined, stored
from .textkit import mix

#: Labelled rows of each language that are learned from; letters of the n-grams.
SAMPLE, SIZES = 2000, (3, 4)
#: Least share of a language's documents, and of the greatest such share, and least number of documents that hold an n-gram of it.
SHARE, MOST, FEWEST = 0.002, 0.5, 2
#: Filters, and their cells as a power of two; languages of one slice.
HASHES, BITS, SLICE = 2, 20, 63
#: Letters that are looked at together; one longer text is looked at alone.
LETTERS = 1 << 20


@dataclass(frozen=True)
class Model:
    """``cells``: (slices, hashes, cells), the bits of languages; ``chance``: how often each language is found by chance; those of more sampled rows come first."""

    langs: tuple[str, ...]
    cells: np.ndarray
    chance: np.ndarray


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, its row, number of letters of each row): of lower-cased letters, all else between them being one space."""
    low = [f" {x.lower()} " for x in rows]
    size = np.array([len(x) for x in low], np.int64)
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(rows)), size)
    letter = letters()[code]
    keep = letter.copy()
    keep[1:] |= ~letter[1:] & letter[:-1]
    keep[np.cumsum(size) - size] = True  # each row begins with a space
    code, row = np.where(letter, code, 32)[keep].astype(np.uint64), row[keep]
    base, part, out, of = np.uint64(0x9E3779B97F4A7C15), code, [], []
    for k in range(1, max(SIZES)):
        part = part[:-1] * base + code[k:]
        if k + 1 in SIZES:
            inside = row[: len(part)] == row[k:]
            out.append(mix(part[inside] + np.uint64(k)))
            of.append(row[: len(part)][inside])
    own, of = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return own[order], of[order], np.bincount(row[code != 32], minlength=len(rows))


def places(grams: np.ndarray) -> list[np.ndarray]:
    """The cell of each n-gram in each filter."""
    return [(grams >> np.uint64(64 - BITS * (k + 1)) & np.uint64((1 << BITS) - 1)).astype(np.int64) for k in range(HASHES)]


def portions(rows: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first row, rows) of neighbouring rows of about ``LETTERS`` together."""
    lo, total = 0, 0
    for k, x in enumerate(rows):
        if total and total + len(x) > LETTERS:
            yield lo, rows[lo:k]
            lo, total = k, 0
        total += len(x)
    if lo < len(rows):
        yield lo, rows[lo:]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from rows outside the held-out quarter that have a text and a language; None without such rows."""
    own = named(docs, id=doc_id, t=text, lang=lang).where("id is not null and t is not null and lang is not null").where(~held_out(F.col("id")))
    own = own.withColumns({"lang": F.col("lang").cast("string"), "o": F.xxhash64("id")})
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "id"))
    chosen = stored(own.select("id", "lang", "o").withColumn("k", rank).where(F.col("k") <= SAMPLE).select(F.col("id").alias("i2"), F.col("lang").alias("l2")).distinct(), "language-sample")
    sizes = chosen.groupBy("l2").count().collect()  # a row per language
    langs = tuple(r.l2 for r in sorted(sizes, key=lambda r: (-r["count"], r.l2)))
    if not langs:
        return None
    number = {x: k for k, x in enumerate(langs)}
    rows = np.array([max(r["count"], 1) for r in sorted(sizes, key=lambda r: number[r.l2])], np.float64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array([number[x] for x in batch.column("lang").to_pylist()])
            for lo, part in portions(batch.column("t").to_pylist()):
                grams, of, _ = ngrams(part)
                spread = np.unique(np.stack([of.astype(np.uint64), grams]), axis=1) if len(grams) else np.empty((2, 0), np.uint64)  # once a row
                which = names[lo + spread[0].astype(np.int64)]
                for k in np.unique(which).tolist():
                    gram, n = np.unique(spread[1][which == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    seen = small_or_joined(own.select("id", "lang", "t"), chosen, F.expr("id = i2 and lang = l2"), "left_semi").select("lang", "t")
    counted = seen.mapInArrow(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.get(F.array(*[F.lit(float(x)) for x in rows]), F.col("lang").cast("int"))
    counted = stored(counted.where(F.col("n") >= FEWEST).withColumn("share", share).where(F.col("share") >= SHARE), "language-grams")
    most = counted.groupBy("gram").agg(F.max("share").alias("most")).withColumnRenamed("gram", "g2")
    kept = counted.join(most, F.expr("gram = g2")).where(F.col("share") >= MOST * F.col("most")).select("lang", "gram")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, grams = batch.column("lang").to_numpy(), batch.column("gram").to_numpy().view(np.uint64)
            for k, cell in enumerate(places(grams)):
                yield pa.RecordBatch.from_arrays([pa.array(lang // SLICE), pa.array(np.full(len(cell), k)), pa.array(cell), pa.array(np.int64(1) << lang % SLICE)], ["slice", "hash", "cell", "bits"])

    found = kept.mapInArrow(place, "slice long, hash long, cell long, bits long").groupBy("slice", "hash", "cell").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most HASHES << BITS cells a slice
    slices = -(-len(langs) // SLICE)
    cells = np.zeros((slices, HASHES, 1 << BITS), next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(len(langs), SLICE) <= n))
    at = tuple(found.column(c).to_numpy() for c in ("slice", "hash", "cell"))
    cells[at] = found.column("bits").to_numpy().astype(cells.dtype)
    filled = [[(cells[k // SLICE, h] >> (k % SLICE) & 1).mean() for h in range(HASHES)] for k in range(len(langs))]
    return Model(langs, cells, np.prod(filled, axis=1))


def judged(rows: list[str], model: Model) -> tuple[list[str], list[float]]:
    """(language, score) of each row: the share of its corrected count among all languages' ones."""
    grams, of, size = ngrams(rows)
    cell, total = places(grams), np.bincount(of, minlength=len(rows))
    count = np.zeros((len(model.langs), len(rows)))
    for s in range(len(model.cells)):
        both = model.cells[s, 0][cell[0]]
        for h in range(1, HASHES):
            both &= model.cells[s, h][cell[h]]
        for k in range(s * SLICE, min((s + 1) * SLICE, len(model.langs))):
            n = np.bincount(of, (both >> (k % SLICE) & 1).astype(np.float64), len(rows))
            count[k] = np.maximum((n - total * model.chance[k]) / max(1 - model.chance[k], 1e-9), 0)
    best, sums = count.argmax(0), count.sum(0)
    score = np.where(sums > 0, count.max(0) / np.maximum(sums, 1e-9), 0.0)
    return [model.langs[k] if n else "und" for k, n in zip(best.tolist(), size.tolist(), strict=True)], np.where(size > 0, np.clip(score, 0, 1), 0.0).tolist()


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    src = named(docs, doc_id=doc_id, t=text)
    if model is None:
        return src.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = src.sparkSession.sparkContext.broadcast(model)  # HASHES << BITS cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in portions(batch.column("t").fill_null("").to_pylist()):
                lang, score = judged(part, held.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(part)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
