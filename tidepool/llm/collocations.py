"""Collocations: phrases whose words stand together more often than their frequencies explain.

Two passes over the texts, each with whole counts:

1. Every phrase of 1 to ``words`` words is hashed to a cell of a count-min sketch of one row, which grows
   with the text.  Tasks send the cells that they filled, and their sums, saturated at 255, are upper
   bounds of the phrases' counts.
2. Phrases in cells of ``least`` or more, whose parts are all in such cells too, are the candidates: a
   phrase is never more frequent than its part.  Tasks gather texts and the candidates that stand in them, until
   one or the other are many; then they compile an Aho-Corasick automaton of a language's candidates and scan its
   texts for overlapping matches.  Both are written with ``LETTERS`` letters for each word of a candidate (words are told
   apart by 64-bit hashes, frequent ones have the first letters), and with another one for other words and ends of pieces.  A
   candidate stands in the automaton of each text that holds it, so that sums are whole counts.  Upper bounds are
   then forgotten: what is below ``least`` goes, and scores come from exact counts.

No text meets the candidates of other texts, so that work grows with the text, however many candidates there are.  Only
the full cells are known to all tasks, as a mask of at most 2^``PART_BITS`` bits: cells of a larger sketch share
bits, which makes candidates of phrases that counting then drops.  Beyond a full cell in 2^``FULL_BITS`` bits there is a
pass for each part of them.

Cases: null texts are empty; a null language is ``und``; pieces of fewer words have fewer phrases; repeated rows
count as often as they stand; a language without candidates gives no rows, as an empty table does; a very long
text is worked on whole, with several numbers a word in its task, and scanned once for each ``SHARD_BYTES`` of its candidates; equal scores are ordered by count, then by phrase; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import named, stored
from .textkit import LOWER, mix, span_hashes, text_slices

#: Cells of a block of the sketch, and bits of a mask of full cells, as powers of two; bytes of one automaton's patterns.
BLOCK_BITS, PART_BITS, SHARD_BYTES = 16, 29, 8 << 20
#: Bytes of text for a cell, and the bits that a mask has for each full cell as a power of two.
CELL_BYTES, FULL_BITS = 16, 4
#: Cells that a task gathers before it sums and sends them.
HELD = 4 << 20
#: Bytes of text that a task gathers before it looks for their candidates.
TEXT_BYTES = 32 << 20
#: Bytes of text for each bucket of candidates; as they are frequent, a bucket has few.
BUCKET_BYTES = 64 << 20
#: Letters for a word, and letters that are scanned at a time.
LETTERS, SCAN_BYTES = 2, 1 << 20

WORD, SPACE, END = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[list(b".,;:!?\n\x0b\x0c\r")] = END
#: A-Z lower-cased, tabs as spaces.
PLAIN = np.where(KIND == SPACE, 0x20, LOWER).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, number of the piece, number of the text) of each word."""
    kind = KIND[data]
    text_start = np.zeros(len(data) + 1, bool)
    text_start[offsets] = True
    solid = kind == WORD
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | text_start[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | text_start[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    piece = np.cumsum((kind == END) | text_start[:-1])[start] if len(data) else np.empty(0, np.int64)
    return start, end, piece, np.searchsorted(offsets, start, "right") - 1


def phrase_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, seed: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2 ... ``words`` words: (hash, whether a phrase of so many words begins there) of each word; ``seed``: of each word's language."""
    if not len(start):
        return
    solid = np.concatenate([[0], np.cumsum(end - start)])
    packed = LOWER[data[KIND[data] == WORD]]
    h = span_hashes(packed, solid[:-1])
    rolled, whole = mix(h ^ seed), np.ones(len(h), bool)
    yield rolled, whole
    for k in range(1, words):
        if len(rolled) < 2:
            return
        rolled = mix(rolled[:-1] ^ h[k:]) + np.uint64(k)
        yield rolled, piece[: len(rolled)] == piece[k:]


def seeds(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each row's language."""
    names = batch.column("lang").to_pylist()
    own = {x: np.uint64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(names)}
    return np.array([own[x] for x in names], np.uint64)


def packed_cells(cells: np.ndarray) -> tuple[list[int], list[bytes]]:
    """By block: its filled cells' places and counts, as bytes."""
    cells = np.sort(cells)
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    n = np.minimum(np.diff(np.append(first, len(cells))), 255).astype(np.uint8)
    cells = cells[first]
    block = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
    place = (cells & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u2")
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    cut = [*at.tolist(), len(cells)]
    return block[at].tolist(), [place[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def full_cells(src: DataFrame, bits: int, words: int, least: int) -> DataFrame:
    """block, full (the places of its cells of ``least`` or more), and rows of a negative block with lang, n: words of each language."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting, total = 0, Counter()

        def send() -> Iterator[pa.RecordBatch]:
            blocks, cells = packed_cells(np.concatenate(held))
            for k in range(0, len(blocks), 512):
                part = blocks[k : k + 512]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(cells[k : k + 512], pa.binary()), pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.int64())], ["block", "cells", "lang", "n"])

        for batch in batches:
            names, own = batch.column("lang").to_pylist(), seeds(batch)
            for lo, _, data, offsets in text_slices(batch, "t"):
                start, end, piece, text = word_spans(data, offsets)
                for k, n in enumerate(np.bincount(text, minlength=len(offsets) - 1).tolist()):
                    total[names[lo + k]] += n
                for h, ok in phrase_hashes(data, start, end, piece, own[lo + text], words):
                    held.append(h[ok] >> np.uint64(64 - bits))
                    waiting += len(held[-1])
                if waiting >= HELD:
                    yield from send()
                    held, waiting = [], 0
        if waiting:
            yield from send()
        total = +total
        if total:
            spread = -1 - TaskContext.get().partitionId() % 97
            yield pa.RecordBatch.from_arrays([pa.array([spread] * len(total), pa.int64()), pa.nulls(len(total), pa.binary()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["block", "cells", "lang", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block stand together."""
        sums, at = np.zeros(1 << BLOCK_BITS, np.uint16), None

        def full_of() -> Iterator[pa.RecordBatch]:
            places = np.flatnonzero(sums >= min(least, 255)).astype("<u2")
            if len(places):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([places.tobytes()], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], ["block", "full", "lang", "n"])

        for batch in batches:
            for block, cells, lang, n in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "lang", "n")), strict=True):
                if block < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.array([lang], pa.string()), pa.array([n], pa.int64())], ["block", "full", "lang", "n"])
                    continue
                if block != at:
                    if at is not None:
                        yield from full_of()
                    sums[:], at = 0, block
                m = len(cells) // 3
                place = np.frombuffer(cells, "<u2", m)
                sums[place] = np.minimum(sums[place] + np.frombuffer(cells, np.uint8, m, 2 * m), 255)
        if at is not None:
            yield from full_of()

    filled = src.mapInArrow(fill, "block long, cells binary, lang string, n long")
    return filled.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, full binary, lang string, n long")


def masks(full: DataFrame, bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number, how many there are, bits) of each mask.  Cells that lie multiples of its size apart share a bit, or have bits in other masks."""
    part_bits, parts = min(bits, PART_BITS), 1
    n = (full.agg(F.sum(F.octet_length("full"))).first()[0] or 0) // 2
    while parts < 1 << (bits - part_bits) and n > parts << (part_bits - FULL_BITS):
        parts *= 2
    for part in range(parts):
        mask = np.zeros(1 << (part_bits - 3), np.uint8)
        own = F.pmod(F.shiftright("block", part_bits - BLOCK_BITS), F.lit(parts)) == part
        for r in full.where(own).select("block", "full").collect():  # about 64 MB at most
            at = (r.block & ((1 << (part_bits - BLOCK_BITS)) - 1)) << (BLOCK_BITS - 3)
            place = np.frombuffer(r.full, "<u2")
            np.bitwise_or.at(mask[at : at + (1 << (BLOCK_BITS - 3))], place >> 3, (128 >> (place & 7)).astype(np.uint8))
        yield part, parts, mask


class Waiting:
    """Texts of a language and the candidates that stand in them."""

    def __init__(self):
        self.hashes: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.length: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.phrases: list[bytes] = []
        self.words = self.size = 0

    def read(self, hashes: np.ndarray, begins: np.ndarray) -> None:
        """Hashes of words that follow each other, and which of them begin a piece."""
        self.hashes.append(hashes)
        self.begins.append(begins)
        self.words += len(hashes)

    def look_for(self, phrases: list[bytes], keys: np.ndarray, first: np.ndarray, words: int) -> None:
        """Candidates of so many words, their hashes, and where one of each begins."""
        self.phrases += phrases
        self.keys.append(keys)
        self.first.append(first)
        self.length.append(np.full(len(first), words, np.int8))
        self.size += sum(map(len, phrases)) + 3 * len(phrases)

    def letters(self, first: np.ndarray, length: np.ndarray, letters: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(the texts by the words of some candidates, where each candidate begins and ends, which words stand there, where runs of such words end)."""
        hashes, begins = np.concatenate(self.hashes), np.concatenate(self.begins)
        known = np.unique(hashes[np.concatenate([first[length > k] + k for k in range(length.max())])])
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        kept = np.flatnonzero(known[at] == hashes)
        at = at[kept]
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")] = np.arange(len(known))
        word = rank[at]
        base = math.ceil(len(known) ** (1 / letters)) + 1
        apart = begins[kept] | (np.diff(kept, prepend=-2) != 1)
        place = letters * np.arange(len(kept)) + np.cumsum(apart)
        out = np.zeros(place[-1] + letters, "<u4")
        for k in range(letters):
            out[place + k] = 1 + k * base + word // base ** (letters - 1 - k) % base
        own = np.searchsorted(kept, first)
        order = np.zeros(len(own), np.uint64)  # by the first three words
        for k in range(3):
            order = order << np.uint64(21) | np.where(length > k, word[np.minimum(own + k, len(word) - 1)] + 1, 0).astype(np.uint64)
        return out.tobytes().decode("utf-32-le"), np.stack([place[own], place[own + length - 1] + letters]), np.argsort(order, kind="stable"), place[apart] - 1

    def counts(self, shard_bytes: int, scan_bytes: int, letters: int) -> np.ndarray:
        """How often each of the candidates stands in the texts."""
        import ahocorasick

        first, length = np.concatenate(self.first), np.concatenate(self.length)
        found = np.zeros(len(first), np.int64)
        size = np.cumsum([len(x) + 3 for x in self.phrases])
        cut = [*np.flatnonzero(np.diff(size // shard_bytes, prepend=-1)).tolist(), len(size)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            text, span, order, ends = self.letters(first[lo:hi], length[lo:hi], letters)
            auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, a, b in zip(order.tolist(), *span[:, order].tolist(), strict=True):  # nodes list their children as they come: the frequent first
                auto.add_word(text[a:b], k)
            auto.make_automaton()
            at = [*ends[np.flatnonzero(np.diff(ends // scan_bytes, prepend=-1))].tolist(), len(text)]
            for x, y in zip(at[:-1], at[1:], strict=True):
                seen = np.fromiter(map(itemgetter(1), auto.iter(text[x:y])), np.int32)
                found[lo:hi] += np.bincount(seen, minlength=hi - lo)
        return found

    def sent(self, lang: str, buckets: int, n: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket: its phrases and their counts, compressed."""
        bucket = (np.concatenate(self.keys) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, first = np.unique(bucket[order], return_index=True)
        cut = [*first.tolist(), len(order)]
        parts = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        phrases = [zlib.compress(b"\n".join([self.phrases[i] for i in x.tolist()]), 1) for x in parts]
        counts = [zlib.compress(n[x].astype("<i8").tobytes(), 1) for x in parts]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array([lang] * len(own), pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "lang", "phrases", "counts"])


SENT, KNOWN = "bucket long, lang string, phrases binary, counts binary", "lang string, phrase string, n long"


def frequent(src: DataFrame, full: DataFrame, bits: int, words: int, least: int, buckets: int) -> DataFrame:
    """lang, phrase, n: the phrases that stand ``least`` times or more in texts of a language."""
    found = None
    for part, parts, mask in masks(full, bits):
        held, part_bits = src.sparkSession.sparkContext.broadcast(mask), len(mask).bit_length() + 2

        def scan(batches: Iterator[pa.RecordBatch], part: int = part, parts: int = parts, held=held, part_bits: int = part_bits) -> Iterator[pa.RecordBatch]:
            mask, seen = held.value, np.empty(0, np.uint64)
            waiting: dict[str, Waiting] = {}
            size = 0

            def send() -> Iterator[pa.RecordBatch]:
                while waiting:
                    lang, own = waiting.popitem()
                    if own.phrases:
                        yield own.sent(lang, buckets, own.counts(SHARD_BYTES, SCAN_BYTES, LETTERS))

            for batch in batches:
                names, own = batch.column("lang").to_pylist(), seeds(batch)
                for lo, _, data, offsets in text_slices(batch, "t"):
                    start, end, piece, text = word_spans(data, offsets)
                    if not len(start):
                        continue
                    plain, before = PLAIN[data].tobytes(), None
                    solid = np.concatenate([[0], np.cumsum(end - start)])
                    kinds, kind = np.unique(np.array(names[lo : lo + len(offsets) - 1], object), return_inverse=True)
                    kind, place = kind[text], np.empty(len(start), np.int64)  # of each word: its language, its place among that language's words
                    for i, lang in enumerate(kinds.tolist()):
                        at = np.flatnonzero(kind == i)
                        place[at] = waiting.setdefault(lang, Waiting()).words + np.arange(len(at))
                    begins = np.concatenate([[True], piece[1:] != piece[:-1]])
                    for k, (h, ok) in enumerate(phrase_hashes(data, start, end, piece, own[lo + text], words)):
                        if k == 0:
                            for i, lang in enumerate(kinds.tolist()):
                                waiting[lang].read(h[kind == i], begins[kind == i])
                        cell = h >> np.uint64(64 - bits)
                        here = (cell >> np.uint64(part_bits)) % np.uint64(parts) == part
                        cell = (cell & np.uint64((1 << part_bits) - 1)).astype(np.int64)
                        hot = ok & ((mask[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool) | ~here)
                        if before is not None:
                            hot &= before[:-1] & before[1:]
                        before = hot
                        at = np.flatnonzero(hot & here)
                        key, first = np.unique(h[at], return_index=True)
                        known = np.searchsorted(seen, key)
                        new = (known == len(seen)) | (seen[np.minimum(known, len(seen) - 1)] != key) if len(seen) else np.ones(len(key), bool)
                        seen = np.insert(seen, known[new], key[new])
                        at = at[first[new]]
                        for i, lang in enumerate(kinds.tolist()):
                            some = at[kind[at] == i]
                            first, last = start[some], end[some + k]
                            phrases = [plain[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                            for j in np.flatnonzero(last - first != solid[some + k + 1] - solid[some] + k).tolist():
                                phrases[j] = b" ".join(phrases[j].split())
                            waiting[lang].look_for(phrases, h[some], place[some], k + 1)
                    size += len(data)
                    if size >= TEXT_BYTES or max(x.size for x in waiting.values()) >= SHARD_BYTES:
                        yield from send()
                        seen, size = np.empty(0, np.uint64), 0
            yield from send()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of each bucket, whose rows stand together."""
            at, sums = None, {}

            def summed() -> Iterator[pa.RecordBatch]:
                for lang, own in sums.items():
                    known = [(x, n) for x, n in own.items() if n >= least]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(known), pa.string()), pa.array([x for x, _ in known], pa.binary()).cast(pa.string()), pa.array([n for _, n in known], pa.int64())], ["lang", "phrase", "n"])

            for batch in batches:
                for bucket, lang, phrases, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "phrases", "counts")), strict=True):
                    if bucket != at:
                        yield from summed()
                        at, sums = bucket, {}
                    own = sums.setdefault(lang, {})
                    for x, k in zip(zlib.decompress(phrases).split(b"\n"), np.frombuffer(zlib.decompress(n), "<i8").tolist(), strict=True):
                        own[x] = own.get(x, 0) + k
            yield from summed()

        sent = src.mapInArrow(scan, SENT).repartition("bucket").sortWithinPartitions("bucket")
        known = stored(sent.mapInArrow(add, KNOWN), "phrase-counts")
        held.unpersist()
        found = known if found is None else found.unionByName(known)
    return found


def joined(words: Column, first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, least: int = 100, words: int = 5, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``words`` words of each language by score.

    a, l, r: counts of the phrase, and of its two parts at the cut of the lowest score; n: words of the
    language; score: floor(1000 * a * n / (l * r)).  A phrase that never stands without one of its neighbours goes.
    """
    src = named(docs, t=text, lang=lang).select("t", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = max(BLOCK_BITS, math.ceil(math.log2(max(size / CELL_BYTES, 1))))
    full = stored(full_cells(src, bits, words, least), "full-cells")
    total = full.where("block < 0").groupBy(F.col("lang").alias("lang2")).agg(F.sum("n").alias("total"))  # a row per language
    known = frequent(src, full.where("block >= 0"), bits, words, least, math.ceil(size / BUCKET_BYTES) + 16)
    known = stored(known.withColumn("size", F.size(F.split("phrase", " "))), "known-phrases")

    longer = known.where("size > 2").withColumn("w", F.split("phrase", " "))
    parts = F.array(joined(F.col("w"), 1, F.col("size") - 1), joined(F.col("w"), 2, F.col("size") - 1))
    inside = longer.select("lang", F.explode(parts).alias("phrase"), F.col("n").alias("of")).groupBy("lang", "phrase").agg(F.max("of").alias("most"))
    left = known.where("size > 1").join(inside, ["lang", "phrase"], "left").where("most is null or 100 * most < 100 * n").drop("most")

    left = left.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    left = left.select("lang", "phrase", F.col("n").alias("a"), "k", joined(F.col("w"), 1, F.col("k")).alias("p1"), joined(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("p2"))
    of = lambda p, out: known.select(F.col("lang").alias(f"lang_{out}"), F.col("phrase").alias(f"phrase_{out}"), F.col("n").alias(out))
    both = left.join(of("p1", "l"), F.expr("lang = lang_l and p1 = phrase_l")).join(of("p2", "r"), F.expr("lang = lang_r and p2 = phrase_r"))
    both = both.join(F.broadcast(total), F.expr("lang = lang2"))
    exact = lambda c: F.col(c).cast("decimal(16,0)")  # noqa: E731  products of two have 33 digits, with 1000 at most 38
    score = F.expr("div(cast(1000 * top as decimal(38,0)), bottom)")
    both = both.withColumns({"top": exact("a") * exact("total"), "bottom": exact("l") * exact("r")}).withColumn("score", score)
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("b")).select("lang", "phrase", "b.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", place).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
