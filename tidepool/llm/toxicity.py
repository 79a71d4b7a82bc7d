"""Toxicity by compression distance: pairs of zstandard dictionaries, window by window.

A pair is a dictionary trained on windows of toxic text and one trained, in the same way, on windows of ordinary text, both
over the same base of ordinary text.  A window that the toxic one shortens more is evidence.

Toxic texts are ordinary for the most part, so that dictionaries trained on all their windows differ by chance more
than by what is toxic.  Training therefore has two rounds.  In the first, several pairs
are trained on halves of the sampled texts, all windows of them, and each window of texts they have not seen is compared by
the mean of what they save; chance differs from pair to pair and cancels out.  Windows of toxic texts that save more than
``QUANTILE`` of the windows of ordinary texts are those that the second round trains the toxic dictionaries on, again on parts
of the texts; ordinary windows that save as much go to the ordinary ones.  Passages that several texts repeat count once.
Where there are enough texts, they are first dealt
into kinds (such as languages) by the dictionaries of ordinary windows that shorten them most, and both rounds go kind by kind, as windows
of a rare kind differ from those of a common one by more than by what is toxic; each dictionary holds a part for each kind.
Samples are always whole windows.  ``PAIRS`` pairs are kept; windows go on from pair to pair while they save ``ONWARD`` bytes on average.

A document's evidence is calibrated to a score by a logistic curve, fitted on labelled documents that the
dictionaries have not seen.  The fit reads a bounded sample of labelled rows (``SAMPLE`` of each label by hash of the
id, and of these so many as come to ``SAMPLE_BYTES``), whole texts; calibration and scoring read whole texts of all rows on the
executors, and only the text.

Cases: null and empty texts give the score of no evidence; equal texts equal scores; an
empty table gives no rows; with no toxic or no ordinary labelled row every score is 0;
labels that are null, or stand for no document, are left out; a labelled id of several texts is learned by that
of the least hash, one of several labels as toxic; a null id is not held out; very long texts cost in proportion to
their length; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import named, stored
from .textkit import texts

#: Labelled rows of each label that are fitted on, and bytes of them (the row that passes them is the last).
SAMPLE, SAMPLE_BYTES = 1500, 16 << 20
#: Words of a window and from one to the next; mean of bytes saved with which a window goes on, and counts.
WINDOW, STRIDE, ONWARD, MARGIN = 5, 4, 1.5, 2.0
#: Parts of the sample of which each is judged by the others, pairs that judge, bytes of their dictionaries; the share of ordinary windows that a toxic one must save more than; windows taken at least.
FOLDS, JUDGES, FIRST, QUANTILE, FEW = 4, 6, 8192, 0.998, 64
#: Pairs of the model, bytes of what is trained and of the base, and the trainer's segment and match lengths.
PAIRS, TRAINED, BASE, SEGMENT, MATCH = 8, 1024, 12288, 16, 6
#: Kinds of text that are looked for, ordinary texts to find them, beginnings and turns; texts of each label that a kind has at least.
KINDS, TYPICAL, STARTS, TURNS, ENOUGH = 4, 240, 4, 5, 80
#: Bytes that a trained dictionary has before its content.
TABLES = 1024
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """(toxic, ordinary) raw contents of each pair, and the curve's weights."""

    pairs: tuple[tuple[bytes, bytes], ...]
    weights: tuple[float, ...]

    def compressors(self):
        return [(compressor(a), compressor(b)) for a, b in self.pairs]


def compressor(content: bytes):
    return zstandard.ZstdCompressor(level=4, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)


def windows(text: str) -> Iterator[bytes]:
    """Lower-cased words without punctuation, ``WINDOW`` at a time, so that none is cut; one empty window without words."""
    words = WORD.findall(text.lower())
    for k in range(0, max(len(words) - WINDOW + STRIDE, 1), STRIDE):
        yield f" {' '.join(words[k : k + WINDOW])} ".encode()


def savings(ws: list[bytes], pairs) -> list[float]:
    """Mean bytes that the toxic dictionaries save in each window; 0 for those that fall behind ``ONWARD`` on the way."""
    live, total = list(range(len(ws))), [0.0] * len(ws)
    for k, (toxic, ordinary) in enumerate(pairs, 1):
        for i in live:
            total[i] += len(ordinary.compress(ws[i])) - len(toxic.compress(ws[i]))
        live = [i for i in live if total[i] >= k * ONWARD]
    out = [0.0] * len(ws)
    for i in live:
        out[i] = total[i] / len(pairs)
    return out


def evidence(text: str, pairs) -> tuple[float, float, float]:
    """(mean bytes saved in the best window, log of the sum over windows that save ``MARGIN`` or more, of windows); equal windows count once."""
    got = savings(list(dict.fromkeys(windows(text))), pairs)
    return max(got), math.log1p(sum(x for x in got if x >= MARGIN)), math.log1p(len(got))


def curve(x: np.ndarray, weights) -> np.ndarray:
    """Weights: of best, of total, of windows, and a constant."""
    z = x[:, :3] @ np.array(weights[:3]) + weights[3]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def once(texts: list[str]) -> list[list[bytes]]:
    """Windows of each text, but for those with three words in a row of an earlier text, so that what is copied counts once."""
    seen: set[bytes] = set()
    out = []
    for text in texts:
        own, kept = set(), []
        for w in windows(text):
            words = w.split()
            runs = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
            if seen.isdisjoint(runs):
                own.update(runs)
                kept.append(w)
        seen |= own
        out.append(kept)
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """The last ``size`` bytes of the dictionary that zstandard trains on samples, where its best content stands; the samples themselves if they are too few for it."""
    try:
        return zstandard.train_dictionary(size + TABLES, samples, k=SEGMENT, d=MATCH).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def drawn(rng: random.Random, texts: list[list[bytes]], n: int) -> list[bytes]:
    """Windows of texts in any order, whole texts, until there are ``n``."""
    out: list[bytes] = []
    for k in rng.sample(range(len(texts)), len(texts)):
        out += texts[k]
        if len(out) >= n:
            break
    return out


def joint(base: bytes, own: bytes, other: bytes) -> tuple[bytes, bytes]:
    size = max(len(own), len(other))
    return base + own.rjust(size, b" "), base + other.rjust(size, b" ")  # of equal hashes the compressor keeps the last


def judged(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[list[list[float]], list[list[float]]]:
    """Mean savings of each window of each text, by pairs trained on halves of texts of the other folds."""
    out = [[[] for _ in toxic], [[] for _ in ordinary]]
    folds = min(FOLDS, len(toxic), len(ordinary))
    for f in range(folds):
        apart = lambda x: [w for i, w in enumerate(x) if i % folds != f or folds < 2]
        pairs = []
        for b in range(JUDGES):
            rng = random.Random(f * JUDGES + b)
            own = [w for x in rng.sample(apart(toxic), -(-len(apart(toxic)) // 2)) for w in x]
            pairs.append([compressor(x) for x in joint(b"", trained(own, FIRST), trained(drawn(rng, apart(ordinary), len(own)), FIRST))])
        for side, texts in zip(out, (toxic, ordinary), strict=True):
            for i in range(f, len(texts), folds):
                side[i] = [sum(len(b.compress(w)) - len(a.compress(w)) for a, b in pairs) / JUDGES for w in texts[i]]
    return out[0], out[1]


def alike(own: list[list[bytes]], other: list[list[bytes]]) -> list[tuple[list[int], list[int]]]:
    """(places of toxic, of ordinary texts) of each kind of text: each goes to the one of several dictionaries of ordinary windows that shortens it most.

    The kinds are found among ordinary texts, from several beginnings, of which that with the shortest sum stays; a kind of too few texts is
    given up and its texts go to the next best.
    """
    if min(len(own), len(other)) < 2 * ENOUGH:
        return [(list(range(len(own))), list(range(len(other))))]
    bodies = [b"".join(x) for x in other]
    some = [i for i in range(len(other)) if bodies[i]][:TYPICAL]
    best: tuple[float, list] = (math.inf, [])
    for start in range(STARTS):
        rng = random.Random(2000 + start)
        kinds = [[i] for i in rng.sample(some, min(KINDS, len(some)))]
        for _ in range(TURNS):
            of = [compressor(b"".join(drawn(rng, [other[i] for i in kind], FIRST // 32))[:FIRST]) for kind in kinds if kind]
            sizes = [[len(c.compress(bodies[i])) for c in of] for i in some]
            nearest = [x.index(min(x)) for x in sizes]
            kinds = [[i for i, k in zip(some, nearest, strict=True) if k == g] for g in range(len(of))]
        if sizes and (total := sum(map(min, sizes))) < best[0]:
            best = total, of
    of = best[1]
    sizes = [[[len(c.compress(b"".join(x))) for c in of] for x in texts] for texts in (own, other)]
    while True:
        nearest = [[min(range(len(of)), key=x.__getitem__) for x in side] for side in sizes]
        least = [min(side.count(k) for side in nearest) for k in range(len(of))]
        if len(of) < 2 or min(least) >= ENOUGH:
            break
        gone = least.index(min(least))
        of = of[:gone] + of[gone + 1 :]
        sizes = [[x[:gone] + x[gone + 1 :] for x in side] for side in sizes]
    return [tuple([i for i, k in enumerate(side) if k == g] for side in nearest) for g in range(len(of))]


def told(own: list[list[bytes]], other: list[list[bytes]], few: int) -> tuple[list[list[bytes]], list[bytes], list[list[bytes]]]:
    """(windows of toxic texts that tell, ordinary windows that save as much, the other ordinary ones) of texts of one kind."""
    saved, fooled = judged(own, other)
    least = float(np.quantile([x for s in fooled for x in s] or [0.0], QUANTILE))
    every = sorted((x for s in saved for x in s), reverse=True)
    bar = min(least, every[min(few, len(every)) - 1]) if every else least  # of few texts the best windows there are
    telling = [[w for w, x in zip(ws, s, strict=True) if x > least or bar < least and x >= bar] for ws, s in zip(own, saved, strict=True)]
    hard = [w for ws, s in zip(other, fooled, strict=True) for w, x in zip(ws, s, strict=True) if x > least]
    plain = [[w for w, x in zip(ws, s, strict=True) if x <= least] for ws, s in zip(other, fooled, strict=True)]
    return [ws for ws in telling if ws], hard, plain


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[tuple[bytes, bytes], ...]:
    """The pairs, from texts in a given order; every sample that is trained on is a window."""
    own, other = once(toxic), once(ordinary)
    kinds = [told([own[i] for i in a], [other[i] for i in b], -(-FEW * len(a) // len(own))) for a, b in alike(own, other)]
    out = []
    for b in range(PAIRS):
        rng = random.Random(1000 + b)
        some = [[w for ws in rng.sample(telling, -(-3 * len(telling) // 4)) for w in ws] for telling, _, _ in kinds]
        base = b"".join(drawn(rng, [ws for _, _, plain in kinds for ws in plain], BASE // 16))[:BASE]
        parts = [joint(b"", trained(own, TRAINED), trained(hard + drawn(rng, plain, 12 * len(own)), TRAINED)) for own, (_, hard, plain) in zip(some, kinds, strict=True)]
        out.append(joint(base, *(b"".join(x) for x in zip(*parts, strict=True))))
    return tuple(out)


def calibrated(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, ...]:
    """Weights of the curve; the sample is of equal shares, ``rate`` is the share of toxic rows among all."""
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(4)
    for _ in range(30):  # Newton's steps with a small ridge
        p = curve(x, w)
        grad = design.T @ (weight * (p - y)) + 1e-2 * w * [1, 1, 1, 0]
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(4)
        w -= np.linalg.solve(hess, grad)
    return tuple(map(float, w))


def thirds(rows: list) -> tuple[list, list]:
    """(two thirds for the dictionaries, one for calibration); of few rows, all for either."""
    return [t for i, t in enumerate(rows) if i % 3] or rows, rows[::3] or rows


def fit(toxic: list[str], ordinary: list[str], rate: float = 0.1) -> Model | None:
    """A model of texts at hand; ``train`` does the same with Spark."""
    if not toxic or not ordinary:
        return None
    (own, own_rest), (other, other_rest) = thirds(toxic), thirds(ordinary)
    model = Model(dictionaries(own, other), (0.0,) * 4)
    pairs = model.compressors()
    x = np.array([evidence(t, pairs) for t in own_rest + other_rest])
    return Model(model.pairs, calibrated(x, np.array([1.0] * len(own_rest) + [0.0] * len(other_rest)), rate))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Fit on labelled rows outside the held-out fifth."""
    marks = named(labels, id=doc_id, y=label).where("id is not null and y is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    rate = marks.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    if not rate or rate == 1:
        return None
    order = marks.withColumn("o", F.xxhash64("id"))
    some = [order.where(F.col("y") == k).orderBy("o", "id").limit(SAMPLE) for k in (0, 1)]
    some = some[0].unionByName(some[1]).select(F.col("id").alias("k"), "y", "o")
    found = named(docs, id=doc_id, t=text).where("t is not null").join(F.broadcast(some), F.expr("id = k"))  # at most 2 * SAMPLE ids
    found = found.groupBy("id", "y", "o").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("x")).select("id", "y", "o", "x.t")
    ranked = Window.partitionBy("y").orderBy("o", "id")
    sized = found.withColumns({"before": F.sum(F.octet_length("t")).over(ranked) - F.octet_length("t"), "of": F.row_number().over(ranked) % 3})  # at most SAMPLE rows of each
    found = stored(sized.where(F.col("before") < SAMPLE_BYTES).select("id", "y", "of", "o", "t"), "labelled")
    kinds = f"id {found.schema['id'].dataType.simpleString()}, y {found.schema['y'].dataType.simpleString()}"
    seen = found.orderBy("o", "id").collect()  # at most SAMPLE_BYTES of each label, and one text
    both = [[r for r in seen if (r.y == 1) == toxic] for toxic in (True, False)]
    if not all(both):
        return None
    model = Model(dictionaries(*[[r.t for r in x if r.of != 1] or [r.t for r in x] for x in both]), (0.0,) * 4)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model.compressors()
        for batch in batches:
            got = [evidence(t, pairs) for t in texts(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([list(x) for x in got], pa.list_(pa.float64()))], ["id", "y", "x"])

    apart = all(any(r.of == 1 for r in x) for x in both)
    rows = (found.where("of = 1") if apart else found).mapInArrow(measured, f"{kinds}, x array<double>").orderBy("id").collect()  # three numbers a row
    return Model(model.pairs, calibrated(np.array([r.x for r in rows]), np.array([float(r.y == 1) for r in rows]), rate))


def with_score(docs: DataFrame, model: Model | None, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of each row as one more column, whose name must be free."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model.compressors() if model else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rest = batch.column("rest").slice(lo, 256)
                got = curve(np.array([evidence(t, pairs) for t in rest.field(place).fill_null("").to_pylist()]), model.weights) if model else np.zeros(len(rest))
                yield pa.RecordBatch.from_arrays([rest, pa.array(got, pa.float64())], ["rest", "s"])

    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("rest"))
    schema = whole.select("rest", F.lit(0.0).alias("s")).schema
    return whole.mapInArrow(run, schema).select("rest.*", F.col("s").alias(column))


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of each row."""
    return with_score(named(docs, doc_id=doc_id, t=text), model, "t").select("doc_id", "score")
