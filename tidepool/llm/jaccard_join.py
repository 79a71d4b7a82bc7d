"""Similarity join of documents on word shingles by parity sketches.

A document's set is its distinct shingles, hashed to 64 bits.  Sets are dealt to K
blocks by hash, and each block XORs its tokens' hashes into a 64-bit parity word: two
blocks differ only if a token in exactly one of the sets fell there, so the number of
differing blocks is at most the symmetric difference; so is the number of differing bits of
a whole set's sketch, where each token turns one bit.  Similar
sets of the same size band differ by at most D tokens; with K > D blocks some block
agrees (pigeonhole), and documents meet by (band, block, word).  Bands are a threshold's
ratio wide, so a document also enters the next band.

Meeting pairs are not all listed.  The places of a few blocks come first: each document there
is compared with one hub and the few before it, by sketches, then exactly, and components
follow.  Then all places are made, of one document per distinct set, and only those
where several components meet go on, in the same way.  Places of few rows are settled by
that; of the others, where components still meet, pairs of different components whose
whole sketches are near enough are verified.  Every link between components is thus
found, and copies, which are one class before all this, are never paired.

Cases: null, empty and wordless texts have an empty set and link with nothing; texts of
fewer words than a shingle have one shingle, all their words; rows of one id count as one
document; a null id is its own component (null); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .links import components, groups, in_blocks
from .shared import freed, named, small_or_joined, stored
from .textkit import mix, pack_texts, shingle_sets, text_slices, unpacked

BLOCK = 2048
#: Blocks of each band whose places are looked at before all others.
SEEDS = 6
#: Each row of a place meets so many rows before it, beside the hub.
BEFORE = 3


class Bands:
    """Size bands and how many blocks each has, for a threshold as a fraction of 100."""

    def __init__(self, percent: int):
        self.t = Fraction(percent, 100)
        self.log = math.log(100 / percent) if percent < 100 else 1e-9

    def of(self, n: np.ndarray) -> np.ndarray:
        """Band b holds the sizes over top(b - 1) up to top(b)."""
        b = np.ceil(np.log(np.maximum(n, 1)) / self.log - 1e-9).astype(np.int64)
        b -= np.array([n <= self.top(x - 1) for n, x in zip(n.tolist(), b.tolist(), strict=True)], np.int64)
        return b + np.array([n > self.top(x) for n, x in zip(n.tolist(), b.tolist(), strict=True)], np.int64)

    def top(self, b: int) -> int:
        return int(math.exp(min(b * self.log, 40)) + 1e-6)

    def differ(self, b: int) -> int:
        """The most tokens by which linked sets of at most top(b) differ: difference <= (1 - t) / (1 + t) * (sum of sizes)."""
        return int((1 - self.t) / (1 + self.t) * 2 * self.top(b))

    def blocks(self, b: int) -> int:
        """One more than can differ, and some more so that agreement on a block without tokens is not needed."""
        k = self.differ(b) + 1
        return k + (1 + k // 12 if k > 1 else 0)


def parity_words(tokens: np.ndarray, k: int, first: int | None = None) -> np.ndarray:
    """The K parity words of a set, or the ``first`` ones of them."""
    block = (tokens >> np.uint64(32)) % np.uint64(k)
    if first is not None and first < k:
        tokens, block, k = tokens[block < first], block[block < first], first
    out = np.zeros(k, np.uint64)
    if len(tokens):
        order = np.argsort(block.astype(np.uint16 if k < 1 << 16 else np.uint64), kind="stable")
        block = block[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        out[block[new]] = np.bitwise_xor.reduceat(mix(tokens ^ np.uint64(0x5BD1E995))[order], new)  # a bit for each token would let blocks of one token agree by chance
    return out


def place_keys(tokens: np.ndarray, bands: Bands, band: int, first: int | None = None) -> np.ndarray:
    """Keys of the meeting places of a set of size up to top(band); of the ``first`` blocks only, those with tokens."""
    k = bands.blocks(band)
    words = parity_words(tokens, k, first)
    at = np.arange(len(words))
    if first is not None or (words == 0).sum() < k - bands.differ(band):  # else some pair might agree on wordless blocks only
        at = at[words != 0]
    return mix(mix(words[at] + np.uint64(band)) ^ (at.astype(np.uint64) << np.uint64(20)) ^ np.uint64(band))


def sketch(tokens: np.ndarray, d: int) -> np.ndarray:
    """Parity bits of the whole set, 64 * a power of two of them, at least 4 for each of ``d`` differing tokens."""
    width = 64 << max(0, math.ceil(math.log2(max(d, 8) / 16)))
    bit = (mix(tokens ^ np.uint64(0xA5A5)) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=width) & 1).astype(np.uint8))


def fold(s: np.ndarray, width: int) -> np.ndarray:
    """The sketch that fewer bits would have given: bit places are taken modulo their number."""
    return np.bitwise_xor.reduce(s.reshape(-1, width), axis=0)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def meetings(spots: DataFrame, percent: int) -> DataFrame:
    """Rows of places where parts meet. ``spots``: key, rep, size, part.

    ``near``: which of the place's hub (its least id) and of the ``BEFORE`` rows before, by id, are of
    another part and of a fitting size.  Places of few rows are settled by these: their key is null.
    """
    place = Window.partitionBy("key").orderBy("rep")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct("rep", "size", "part")
    known = spots.withColumns({"lo": F.min("part").over(whole), "hi": F.max("part").over(whole), "g": F.count(F.lit(1)).over(whole), "others": F.array(F.first(own).over(whole), *[F.lag(own, k).over(place) for k in range(1, BEFORE + 1)])})
    fits = lambda x: (x["part"] != F.col("part")) & (x["rep"] != F.col("rep")) & (100 * F.least(x["size"], F.col("size")) >= percent * F.greatest(x["size"], F.col("size")))
    near = F.array_distinct(F.transform(F.filter("others", fits), lambda x: x["rep"]))
    return known.where("lo < hi").select(F.when(F.col("g") > BEFORE + 1, F.col("key")).alias("key"), "rep", "size", "part", near.alias("near"))


def near_pairs(live: DataFrame) -> DataFrame:
    return live.select(F.explode("near").alias("a"), F.col("rep").alias("b")).distinct()


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    src = named(docs, doc_id=doc_id, t=text).select(F.col("doc_id").cast("long").alias("doc_id"), "t")
    bands = Bands(percent)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch, "t"):
                own = shingle_sets(data, offsets, width)
                n = np.array([len(x) for x in own], np.int64)
                band = bands.of(n).tolist()
                seeds = [np.concatenate([place_keys(x, bands, b, SEEDS), place_keys(x, bands, b + 1, SEEDS)]).view(np.int64) if len(x) else None for x, b in zip(own, band, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(n),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in own], pa.binary()),
                        pa.array([sketch(x, bands.differ(b + 1)).tobytes() if len(x) else None for x, b in zip(own, band, strict=True)], pa.binary()),
                        pa.array(seeds, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "digest", "sketch", "seeds"],
                )

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in unpacked(batch, "t"):
                for lo, hi, data, offsets in text_slices(packed, "t"):
                    own = shingle_sets(data, offsets, width)
                    band = bands.of(np.array([len(x) for x in own], np.int64))
                    keys = [np.concatenate([place_keys(x, bands, b), place_keys(x, bands, b + 1)]) if len(x) else np.empty(0, np.uint64) for x, b in zip(own, band.tolist(), strict=True)]
                    row = pa.array(np.repeat(np.arange(hi - lo), [len(k) for k in keys]))
                    rest = [packed.column(c).slice(lo, hi - lo).take(row) for c in ("rep", "size", "part")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *rest], ["key", "rep", "size", "part"])

    sized = stored(src.mapInArrow(sets, "doc_id long, n long, digest binary, sketch binary, seeds array<long>"), "sets")
    judged = sized.where("doc_id is not null and digest is not null")
    classes = stored(judged.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("seeds").alias("seeds")), "set-classes")
    member = judged.select("doc_id", "digest").join(classes.select(F.col("digest").alias("d2"), "rep"), F.expr("digest = d2")).groupBy("doc_id").agg(F.min("rep").alias("rep"), F.collect_set("rep").alias("reps"))
    member = stored(member.select(F.col("doc_id").alias("i2"), "rep", "reps"), "members")
    same = member.where("size(reps) > 1").select(F.col("rep").alias("a"), F.explode("reps").alias("b")).where("a != b")  # of one id with several texts

    # Seeds: the places of a few blocks find most of the large groups.
    seeded = classes.select(F.explode("seeds").alias("key"), "rep", F.col("n").alias("size"), F.col("rep").alias("part"))
    seed_links = verified(near_pairs(meetings(seeded, percent)), classes, src, width, percent)
    parts = stored(components(seed_links.unionByName(same)), "parts")

    # All places, of which only those where components meet go on.
    reps = classes.groupBy("rep").agg(F.max("n").alias("size")).join(parts, F.expr("rep = id"), "left").select("rep", "size", F.coalesce("component", "rep").alias("part"))
    texts = pack_texts(src.where("doc_id is not null")).join(reps, F.expr("doc_id = rep")).select("rep", "size", "part", "t")
    live = stored(meetings(texts.mapInArrow(places, "key long, rep long, size long, part long"), percent), "places")
    place_links = verified(near_pairs(live), classes, src, width, percent)
    freed(parts)
    links = seed_links.unionByName(place_links).unionByName(same)
    parts = stored(components(links), "parts")

    # What is left: places of many rows where several components still meet.
    at = live.where("key is not null").select("key", "rep", "size").join(parts, F.expr("rep = id"), "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("part"))
    mixed = at.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("g")).where("lo < hi").select(F.col("key").alias("k2"), "g")
    rows = small_or_joined(at, stored(mixed, "mixed"), F.expr("key = k2")).join(classes.select(F.col("rep").alias("r2"), "sketch"), F.expr("rep = r2")).select("key", "rep", "size", "part", "sketch", "g")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "b1", "b2"]):
            rep, size, part, half = (group.column(c).to_numpy() for c in ("rep", "size", "part", "half"))
            across = group.column("b1")[0].as_py() != group.column("b2")[0].as_py()
            raw = [np.frombuffer(x, np.uint8) for x in group.column("sketch").to_pylist()]
            most = (1 - percent / 100) / (1 + percent / 100)
            width_of = np.array([len(x) for x in raw])
            got_a, got_b = [], []
            folded = {w: np.stack([fold(x, w) if len(x) >= w else np.zeros(w, np.uint8) for x in raw]) for w in np.unique(width_of).tolist()}
            for i in range(len(rep)):
                j = np.flatnonzero((part != part[i]) & (rep > rep[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & ((half != half[i]) | (not across)))
                for w in np.unique(np.minimum(width_of[j], width_of[i])).tolist():
                    k = j[np.minimum(width_of[j], width_of[i]) == w]
                    far = np.bitwise_count(folded[w][k] ^ folded[w][i]).sum(1)
                    k = k[far <= most * (size[k] + size[i]) + 1e-6]
                    got_a.append(np.full(len(k), rep[i]))
                    got_b.append(rep[k])
            if got_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got_a)), pa.array(np.concatenate(got_b))], ["a", "b"])

    more = in_blocks(rows, ["key"], "rep", "g", BLOCK).mapInArrow(candidates, "a long, b long").distinct()
    last_links = verified(more, classes, src, width, percent)
    freed(live)
    parts = components(links.unionByName(last_links))
    whole = sized.select("doc_id", "n").join(member.select("i2", "rep"), F.expr("doc_id = i2"), "left").join(parts, F.expr("rep = id"), "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def verified(pairs: DataFrame, classes: DataFrame, src: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs a, b those whose sets are similar.

    Sketches decide first; only texts of documents in a pair that is left are packed and sent.
    """
    most = (1 - percent / 100) / (1 + percent / 100)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * most + 1e-6
            ok = []
            for x, y, far in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), sizes.tolist(), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                w = min(len(x), len(y))
                ok.append(int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()) <= far)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda x: classes.select(F.col("rep").alias(f"i{x}"), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    sketched = pairs.join(of("a"), F.expr("a = ia")).join(of("b"), F.expr("b = ib")).select("a", "b", "sa", "sb", "na", "nb")
    pairs = stored(sketched.mapInArrow(close, "a long, b long").distinct(), "pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct(), "pair-ids")
    some = stored(pack_texts(small_or_joined(src, wanted, F.expr("doc_id = w"), "left_semi")), "pair-texts")
    ta, tb = some.select(F.col("doc_id").alias("ia"), F.col("t").alias("ta")), some.select(F.col("doc_id").alias("ib"), F.col("t").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            ok = []
            for part in unpacked(batch, "tb"):
                for lo, hi, data, offsets in text_slices(part, "tb"):
                    theirs = shingle_sets(data, offsets, width)
                    hubs = zip(*(part.column(c).slice(lo, hi - lo).to_pylist() for c in ("a", "ta")), strict=True)
                    for hub, b in zip(hubs, theirs, strict=True):
                        if hub != last:
                            raw = np.frombuffer(zstandard.decompress(hub[1]) if hub[1] else b"", np.uint8)
                            last, own = hub, shingle_sets(raw, np.array([0, len(raw)]), width)[0]
                        ok.append(similar(own, b, percent))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(tb, F.expr("b = ib")).join(ta, F.expr("a = ia")).select("a", "b", "ta", "tb")
    links = stored(both.mapInArrow(check, "a long, b long").distinct(), "links")
    freed(pairs, wanted, some)
    return links
