"""Numpy helpers that tasks use on Arrow columns of text; all are small and stateless."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes; one longer text is a slice alone.
SLICE_BYTES = 2 << 20


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of parts of a batch; null texts are empty."""
    col = batch.column(column)
    col = col.fill_null("") if col.null_count else col
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.empty(0, np.uint8)
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n), data[offsets[lo] : offsets[min(hi, n)]], offsets[lo : min(hi, n) + 1] - offsets[lo]
        lo = min(hi, n)
    pa.default_memory_pool().release_unused()  # workers live on, and share the executor's memory


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return batch.column(column).fill_null("").to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (two multiply-xor rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """uint64 polynomial hash of each ``width`` bytes, by doubling: windows of 2k are made of two of k."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part = mix(data.astype(np.uint64) + np.uint64(1))
    base = np.uint64(0x9E3779B97F4A7C15)
    out, done, size = None, 0, 1
    while size <= width:
        if width & size:
            if out is None:
                out, done = part[: len(data) - size + 1].copy(), size
            else:
                m = len(data) - done - size + 1
                out = out[:m] * base + part[done : done + m]
                done += size
        if size * 2 <= width:
            m = len(part) - size
            part = part[:m] * base + part[size : size + m]
            base = np.uint64((int(base) * 3 + 0x1F123BB5) & (1 << 64) - 1 | 1)
        size *= 2
    return mix(out[:n])


SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def span_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """uint64 hash of each span of bytes from one start to the next, the last to the end of ``data``."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), size)
    value = mix((place << np.uint64(8)) + data.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return mix(np.add.reduceat(value, starts) + size.astype(np.uint64))


class SpanTable:
    """What is known of distinct spans, by hash: a list of ids and a flag each. Beyond ``most`` spans it starts anew, so that it is bounded."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.size, self.flag, self.first, self.ids = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.uint32)

    def slots(self, data: np.ndarray, starts: np.ndarray, code) -> np.ndarray:
        """The place in the table of each span; ``code`` gives all ids, their numbers and a flag of each of the spans (as bytes) that it lacks."""
        keys, at, back = np.unique(span_hashes(data, starts), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            stop = np.append(starts, len(data))
            ids, n, flags = code([data[a:b].tobytes() for a, b in zip(stop[at[new]].tolist(), stop[at[new] + 1].tolist(), strict=True)])
            fresh = len(self.size) + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
            self.size, self.flag = np.concatenate([self.size, n]), np.concatenate([self.flag, np.asarray(flags, bool)])
            self.ids = np.concatenate([self.ids, ids])
            self.keys, self.slot = np.insert(self.keys, place[new], keys[new]), np.insert(self.slot, place[new], fresh)
            place = np.searchsorted(self.keys, keys)
        return self.slot[place][back]

    def spread(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the spans one after the other, uint32; where each span's begin, and the total)."""
        size = self.size[slots]
        at = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.first[slots] - at[:-1], size) + np.arange(at[-1])], at


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 hash of each word, A-Z lower-cased; first word of each text and the total).

    Each byte's power-weighted value is summed over a word; sums of two unrelated odd bases are mixed.
    """
    solid = ~SPACES[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begin[cuts] = solid[cuts]
    start = np.flatnonzero(begin)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = np.cumsum(begin) - 1
    at = np.flatnonzero(solid)
    place = (at - start[word[at]]).astype(np.uint64)
    value = mix((place << np.uint64(8)) + LOWER[data[at]].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    first = np.searchsorted(at, start)
    h = mix(np.add.reduceat(value, first))
    return h, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text, the sorted distinct uint64 hashes of its ``width``-word shingles; of the whole sequence with fewer words."""
    h, first = word_hashes(data, offsets)
    out = []
    n = len(h) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        rolled = mix(rolled ^ h[k : k + len(rolled)]) + np.uint64(k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = mix(one ^ h[k : k + 1]) + np.uint64(k - a)
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def pack_texts(df, column: str = "t"):
    """``df`` with its text column as zstd bytes (nulls stay null), for shuffles that carry whole texts."""
    import zstandard
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [None if x is None else z.compress(x) for x in pc.cast(part.column(at), pa.binary()).to_pylist()]
                yield part.set_column(at, pa.field(column, pa.binary()), pa.array(rows, pa.binary()))

    schema = df.withColumn(column, F.lit(None).cast("binary")).schema
    return df.mapInArrow(run, schema)


def unpacked(batch: pa.RecordBatch, column: str, rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with the packed column as text again."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    at = batch.schema.get_field_index(column)
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        raw = [None if x is None else z.decompress(x) for x in part.column(at).to_pylist()]
        yield part.set_column(at, pa.field(column, pa.large_string()), pa.array(raw, pa.large_binary()).cast(pa.large_string()))
