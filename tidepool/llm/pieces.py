"""Encoding and decoding by a SentencePiece model through a table of distinct marked words.

Where no piece of the model has a whitespace marker after another character, no merge
crosses the place before a run of markers.  A normalised text is thus cut there into
marked words, each distinct one is segmented once, and ids are joined back by position: words
are known by hash, and the ids of all words of a slice of texts are gathered at once.

The table belongs to a worker, which keeps it from task to task and starts it anew beyond
``TABLE_WORDS``; nothing is shuffled, and words that many workers meet cost each of them one
segmentation.  A table for the whole corpus would need all occurrences of rare words in two
shuffles, more than the texts themselves (see the README).  Models with pieces that cross markers,
or without a leading marker, are applied to whole texts instead.

Cases: null and empty texts give the end id only and decode to an empty text; a null id stays
null; equal rows give equal rows; very long texts are encoded whole, a slice each; an empty table
gives none; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import named
from .textkit import SpanTable, text_slices, texts

MARK = "▁"
#: Distinct words that a worker remembers, about 60 bytes each.
TABLE_WORDS = 300_000


@functools.lru_cache(maxsize=2)
def load(model: str):
    """(processor, its word table or None if words may not be encoded apart)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    apart = all(MARK not in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
    apart = apart and sp.normalize("a") == f"{MARK}a" and sp.normalize(" a") == f"{MARK}{MARK}a"
    return sp, SpanTable(TABLE_WORDS) if apart else None


def encode_texts(model: str, rows: list[str]) -> Iterator[np.ndarray]:
    """Ids of each text without an end id."""
    sp, table = load(model)
    if table is None:
        yield from (np.array(x, np.int32) for x in sp.encode(rows, num_threads=1))
        return

    def code(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # the library puts the first marker there itself; it would take a lone one for an empty text
        got = sp.encode([w.decode()[1:].replace(MARK, " ") for w in words], num_threads=1)
        got = [x or [sp.piece_to_id(MARK)] for x in got]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.array([len(x) for x in got]), np.zeros(len(got), bool)

    raw = [x.encode() for x in sp.normalize(rows)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    mark = np.zeros(len(data), bool)
    if len(data) > 2:
        mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    start = mark.copy()
    start[3:] &= ~mark[:-3]
    start[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(start)
    ids, at = table.spread(table.slots(data, starts, code))
    bounds = at[np.searchsorted(starts, offsets)].tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield ids[a:b].view(np.int32)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>, the end id last), decoded (the text of these ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = load(model)
        for batch in batches:
            for lo, hi, _, _ in text_slices(batch, "t"):
                part = batch.slice(lo, hi - lo)
                ids = [np.append(x, np.int32(sp.eos_id())) for x in encode_texts(model, texts(part, "t"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(sp.decode([x.tolist() for x in ids]), pa.string())], ["doc_id", "ids", "decoded"])

    src = named(docs, doc_id=doc_id, t=text)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
