"""Order-preserving packing by dynamic programming.

Documents, in order of id, are one stream of tokens.  Windows of at most ``size`` tokens
are cut from it so that padding plus penalties is least: a cut at a document's end is
free, at a sentence's end costs ``sentence_cost``, elsewhere ``word_cost``, and each window
costs ``window_cost``, so that there are no more than need be.  The best cost
up to a cut j is min over earlier cuts i of best(i) + padding(j - i) + cost(j), and as
padding is size - (j - i), a monotone queue of best(i) + i gives each minimum in constant
time; windows whose length is a power of two are not padded and are tried as well.

The stream is parted at fixed borders: exact sums of the texts' sizes by leading digits of id and text hash,
refined where they are heavy, are put together to parts of about ``PART_BYTES`` (more if there would be over
``PARTS`` of them).  So the result depends on the rows alone, not on how they were dealt to tasks, and
rows of one id may be in several parts.  A task holds one block of a part at a
time, emits all windows of a block but the last, and carries that one on.  Only the last window
of a part is short of choices, and cuts are the best of each block.

Texts are tokenised through a table of distinct chunks that a worker keeps from task to task: chunks
end where byte-level pretokenisation starts anew whatever stands before, so that each is encoded
once and the ids of texts are put together by array operations.  Tokenizers of another kind than
byte-level ones without normalisation are applied to whole texts.

Cases: a null or empty text is the end id alone; an empty table gives no pieces; rows of
equal ids stand next to each other, by the hash of their texts; equal rows stand in any order, as they are the same; a null id comes first; text without
sentence ends is cut between any two tokens at ``word_cost``; a very long text is a stream like any
other, held by one task with 4 bytes a token; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freed, named, stored
from .textkit import SpanTable, text_slices

#: Tokens of the stream that are cut at a time.
BLOCK = 1 << 18
#: Bytes of text of a part of the stream, unless that makes more than so many parts.
PART_BYTES, PARTS = 4 << 20, 20_000
#: Distinct chunks that a worker remembers, about 60 bytes each.
TABLE_CHUNKS = 1_000_000
#: New chunks that are encoded as one text, as a call for each costs more; where chunks begin with a space they are parted again.
JOINED = 64
#: Bytes that begin no white space character, so that a chunk may begin with them or with one space before them.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = SOLID[0xC3:0xE1] = SOLID[0xE4:0xF5] = True
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[list(b".!?\n")] = True


@functools.lru_cache(maxsize=2)
def load(path: str):
    """(tokenizer, its chunk table or None if chunks may not be encoded apart, texts of its special tokens)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    made = json.loads(tok.to_str())
    before = made["pre_tokenizer"] or {}
    apart = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and made["normalizer"] is None and made["post_processor"] is None
    special = [x["content"].encode() for x in made["added_tokens"]]
    return tok, SpanTable(TABLE_CHUNKS) if apart and not any(x.isspace() or b" " in x for x in special) else None


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start: before a space that a solid character follows; at a solid character after a single line end."""
    n = len(data)
    start = np.zeros(n, bool)
    if n > 1:
        solid = SOLID[data[1:]]
        two = (data[1:] == 0xC2) & np.append((data[2:] != 0x85) & (data[2:] != 0xA0), False)
        start[:-1] = (data[:-1] == 0x20) & (solid | two)
        if n > 2:
            start[2:] |= (data[1:-1] == 0x0A) & SOLID[data[2:]] & (data[:-2] > 0x20) & (data[:-2] < 0x7F)
    start[offsets[offsets < n]] = True
    return np.flatnonzero(start)


def tokenise(loaded, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: ids as uint32, and the places (in ids) where sentences end."""
    tok, table = loaded
    if table is None:
        rows = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        for e in tok.encode_batch(rows, add_special_tokens=False):
            ends = [k + 1 for k, (_, b) in enumerate(e.offsets) if e.tokens[k][-1:] in (".", "!", "?", "\u010a")]
            yield np.array(e.ids, np.uint32), np.array(ends, np.int64)
        return

    def code(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(c) for c in chunks])
        whole = b"".join(chunks)
        flat = np.frombuffer(whole + b"\0\0", np.uint8)
        at = np.cumsum(size) - size
        begins = (flat[at] != 0x20) | (size < 2) | ~(SOLID[flat[at + 1]] | ((flat[at + 1] == 0xC2) & (flat[at + 2] != 0x85) & (flat[at + 2] != 0xA0)))
        begins[::JOINED] = True
        heads = np.flatnonzero(begins)
        chars = np.concatenate([[0], np.cumsum(flat[:-2] & 0xC0 != 0x80)])
        got = tok.encode_batch([whole[x:y].decode() for x, y in zip(at[heads].tolist(), np.append(at[heads[1:]], len(whole)).tolist(), strict=True)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.uint32)
        place = np.fromiter((x for e in got for x, _ in e.offsets), np.int64, len(ids)) + np.repeat(chars[at[heads]], [len(e.ids) for e in got])
        return ids, np.bincount(np.searchsorted(chars[at], place, "right") - 1, minlength=len(chunks)), SENTENCE_END[flat[at + size - 1]]

    starts = chunk_starts(data, offsets)
    slots = table.slots(data, starts, code)
    ids, at = table.spread(slots)
    first = np.searchsorted(starts, offsets)
    end = at[1:][table.flag[slots]]
    lo = at[first]
    cut = np.searchsorted(end, lo, "right")  # a sentence's end at the text's own begin belongs to the text before
    for k in range(len(offsets) - 1):
        yield ids[lo[k] : lo[k + 1]], end[cut[k] : cut[k + 1]] - lo[k]


def best_cuts(total: int, marks: list[tuple[int, int]], size: int, word_cost: int, window_cost: int = 0) -> list[int]:
    """Cut places from 0 to ``total``; ``marks``: ascending (place, cost) of good cuts, the last at ``total``; each window costs ``window_cost``."""
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best(i) + i, i), both ascending in i
    far = 1 << 60
    best, back = [far] * (total + 1), {0: 0}
    best[0] = 0
    last, powers, step = 0, [1 << k for k in range(size.bit_length()) if 1 << k < size], max(1, size // 32)

    def put(j: int, cost: int) -> None:
        nonlocal last
        while queue[0][1] < j - size:
            queue.popleft()
        value, i = queue[0][0] + size - j, queue[0][1]
        for p in powers:
            if p > j:
                break
            if best[j - p] < value:
                value, i = best[j - p], j - p
        value += cost + window_cost
        best[j], back[j] = value, i
        last = j
        while queue and queue[-1][0] >= value + j:
            queue.pop()
        queue.append((value + j, j))

    for j, cost in marks:
        while j - last > step:  # no good cut for a while: cuts inside, too
            put(last + step, word_cost)
        if j > last:
            put(j, cost)
    cuts = [total]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def order_key(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, t) with ``key``, a text whose order is that of the id, then of the text's hash; a null id comes first."""
    least = F.lit(-(1 << 63)).cast("long")
    digits = lambda c: F.lpad(F.hex(c.cast("long").bitwiseXOR(least)), 16, "0")
    whole = df.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    own = digits(F.col("doc_id")) if whole else F.concat(F.hex(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(" "))
    return df.withColumn("key", F.concat(F.coalesce(own, F.lit(" ")), digits(F.xxhash64("t"))))


def borders(sizes: DataFrame) -> list[str]:
    """Where parts of the stream begin, as beginnings of keys; the first is empty. ``sizes``: key, size."""
    total, lo, hi = sizes.agg(F.sum("size"), F.min("key"), F.max("key")).first()
    if not total:
        return [""]
    target = max(PART_BYTES, total // PARTS)
    digits = len(os.path.commonprefix([lo, hi]))
    leaves, heavy = [], None
    while heavy is None or heavy:
        rows = sizes if heavy is None else sizes.where(F.substring("key", 1, digits).isin(heavy))
        digits += 2
        found = rows.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size").alias("n"), F.min(F.length("key")).alias("length")).collect()  # 256 for each heavy one
        heavy = [r.p for r in found if r.n > target and r.length > digits]
        leaves += [(r.p, r.n) for r in found if not (r.n > target and r.length > digits)]
    out, size = [""], 0
    for p, n in sorted(leaves):
        if size and size + n > target:
            out.append(p)
            size = 0
        size += n
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, sentence_cost: int = 2, word_cost: int = 12, window_cost: int = 160, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (array<int>, unless ``with_ids`` is false), crc (CRC-32 of the ids as little-endian uint32), doc_tokens, sequence_id, offset."""
    src = named(docs, doc_id=doc_id, t=text)
    kind = src.schema["doc_id"].dataType.simpleString()
    fields = {"start": "long", "length": "long", "ids": "array<int>", "crc": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}
    if not with_ids:
        del fields["ids"]
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = load(tokenizer)
        sequence = part = 0
        held: list[list] = []  # documents not yet cut to their end: id, ids, sentence ends, tokens emitted
        waiting = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held, waiting
            if not held:
                return
            marks, at = [], 0
            for _, ids, ends, gone in held:
                marks += [(x, sentence_cost) for x in (ends[(ends > gone) & (ends < len(ids))] + (at - gone)).tolist()]
                at += len(ids) - gone
                marks.append((at, 0))
            cuts = best_cuts(at, marks, size, word_cost, window_cost)
            stop = cuts[-1] if last else cuts[-2]
            rows: list[tuple] = []
            k = 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > stop:
                    break
                offset = 0
                while offset < b - a:
                    doc = held[k]
                    n = len(doc[1])
                    take = min(n - doc[3], b - a - offset)
                    own = doc[1][doc[3] : doc[3] + take]
                    rows.append((doc[0], doc[3], take, own.view(np.int32), zlib.crc32(own.astype("<u4").tobytes()), n, sequence, offset))
                    offset += take
                    doc[3] += take
                    k += doc[3] == n
                sequence += 1
            held = held[k:]
            waiting = at - stop
            for x in range(0, len(rows), 1000):
                cols = dict(zip(("doc_id", "start", "length", "ids", "crc", "doc_tokens", "sequence_id", "offset"), zip(*rows[x : x + 1000], strict=True), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols["doc_id"], id_type), *(pa.array(cols[c], pa.list_(pa.int32()) if c == "ids" else pa.int64()) for c in fields)], ["doc_id", *fields])

        id_type: pa.DataType | None = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for lo, hi, data, offsets in text_slices(batch, "t"):
                keys, parts = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("doc_id", "part"))
                for key, of, (ids, ends) in zip(keys, parts, tokenise(loaded, data, offsets), strict=True):
                    if of != part:
                        yield from flush(last=True)
                        part, sequence, waiting = of, of << 32, 0
                    held.append([key, np.concatenate([ids, end]), ends, 0])
                    waiting += len(ids) + 1
                    if waiting >= BLOCK:
                        yield from flush(last=False)
        yield from flush(last=True)

    keyed = order_key(src)
    sizes = stored(keyed.select("key", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("size")), "text-sizes")
    starts = borders(sizes)
    freed(sizes)

    @F.pandas_udf("long")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(starts, x) - 1 for x in key], dtype="int64")

    dealt = keyed.withColumn("part", part_of("key")).repartitionByRange(len(starts), "part").sortWithinPartitions("part", "key")
    return dealt.select("part", "doc_id", "t").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {t}" for c, t in fields.items()))
