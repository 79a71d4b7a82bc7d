"""Repeated byte strings across documents, by interval expansion on Burrows-Wheeler transforms.

Every byte that lies in a ``least``-byte string which also starts earlier (in a smaller id, or
before it in the same document) is marked.  A transform of a whole corpus fits no task,
so the strings are first dealt by content: each ``least``-byte window is named by the least of
the hashes of its ``ANCHOR``-byte parts (leftmost among equals), a function of its bytes alone,
and equal windows meet under one name.  Neighbouring windows of one name are one run, sent
as one row of hashes; runs of equal content keep their first occurrence, and all later ones
are marked.  Only names with several different runs are looked at byte by byte: their texts
are put together in blocks, and on the transform of a block breadth-first backward extension
parts the suffixes by common prefixes of one byte more each time, from the longest that the sort has parted already.  At ``least`` it stops: suffixes not
parted yet share that many bytes, and all but the first of each such class are marked.

A name with more than ``MOST_RUNS`` different runs (one common line between ever other
neighbours) fits no block.  It is dealt on by an anchor as wide as the window, that is, by the
hash of all its bytes within the name, which Spark reduces to first occurrences before it shuffles; nothing is dropped.

Cases: null texts are empty; texts shorter than ``least`` keep all bytes; rows of one id with
equal texts are one document and give equal rows; rows of one id with different texts are documents
of their own, in order of the texts' hashes; rows with a null id keep all bytes and mark none; very long
texts are cut to runs by the task that reads them; an empty table gives no rows; columns named in ``carry``
are handed on, others ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import groups
from .shared import free_name, stored
from .textkit import mix, pack_texts, text_slices, unpacked, window_hashes

LEAST, ANCHOR = 100, 16
MOST_RUNS = 4096
#: Bytes of runs under one transform.
BLOCK_BYTES = 1 << 17
#: Bytes of text whose windows are hashed at a time, at about 100 bytes each.
RUN_BYTES = 1 << 20
#: Between runs in a block; no byte of UTF-8.
GAP = b"\xff"


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of each ``width`` neighbours, by doubling."""
    place = np.arange(len(values))
    best, have = values, 1
    while have < width:
        step = min(have, width - have)
        n = len(best) - step
        right = best[step:] < best[:n]
        best, place = np.where(right, best[step:], best[:n]), np.where(right, place[step:], place[:n])
        have += step
    return place


def runs_of(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, first window within it, number of windows, name, content hash) of each run."""
    n = len(data) - least + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    part = window_hashes(data, ANCHOR)
    anchor = leftmost_least(part, least - ANCHOR + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + least <= offsets[text + 1]
    whole = window_hashes(data, least)
    at = np.flatnonzero(inside)
    if not len(at):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    new = np.r_[True, (anchor[at[1:]] != anchor[at[:-1]]) | (text[at[1:]] != text[at[:-1]])]
    first = at[new]
    last = np.r_[at[np.flatnonzero(new)[1:] - 1], at[-1]]
    size = last - first + 1
    content = mix(whole[first]) + mix(whole[last] * np.uint64(3) + size.astype(np.uint64))
    return text[first], first - offsets[text[first]], size, part[anchor[first]], content


def transform(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array by the first ``depth`` or more bytes, its inverse, the transform's byte of each row) of a cyclic text.

    Suffixes that agree that far stand in any order.
    """
    return parted(data, depth)[:3]


def parted(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """``transform``, the longest length up to ``depth`` that the sort went through, and which rows begin an interval of equal prefixes of it.

    Each turn sorts by as many ranks of the turn before as a key of 64 bits holds.  Later turns only
    order rows within intervals, so that these stand where they stood.
    """
    n = len(data)
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | np.roll(data, -k).astype(np.uint64)
    bits = max((n - 1).bit_length(), 1)
    have, low = 8, np.empty(n, np.uint64)
    known, apart = 0, np.arange(n) == 0
    while True:
        order = np.argsort(rank)
        key = rank[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if have <= depth:
            known, apart = have, new
        if have >= depth or new.all():
            break
        low[order] = np.cumsum(new, dtype=np.uint64) - np.uint64(1)
        times = min(max(64 // bits, 2), -(-depth // have))
        rank = low
        for k in range(1, times):
            rank = (rank << np.uint64(bits)) | np.roll(low, -k * have)
        have *= times
    inverse = np.empty(n, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    return order, inverse, data[order - 1], known, apart


def expand(rows: np.ndarray, depth: int, known: int = 0, apart: np.ndarray | None = None) -> np.ndarray:
    """Which rows of a transform begin a new interval of equal ``depth``-byte prefixes; ``apart``: which begin one of ``known``-byte prefixes, if known.

    Backward extension by c takes row p to the place of p among rows with byte c, behind
    all rows of lesser bytes. Rows next to each other after it are parted at length l + 1 if
    they were apart at l; so intervals of each length come from those of one byte less, and
    only rows that are not parted yet are looked at.
    """
    back = np.argsort(rows, kind="stable").astype(np.int32)  # the row that extension takes to each place
    if known < 1 or apart is None:
        byte = rows[back]
        known, apart = 1, np.concatenate([[True], byte[1:] != byte[:-1]])
    apart = apart.copy()
    undecided = np.flatnonzero(~apart).astype(np.int32)
    here, there = back[undecided], back[undecided - 1]
    interval = np.cumsum(apart, dtype=np.int32)
    for _ in range(known, depth):
        cut = interval[here] != interval[there]
        if cut.any():
            apart[undecided[cut]] = True
            left = ~cut
            undecided, here, there = undecided[left], here[left], there[left]
            interval = np.cumsum(apart, dtype=np.int32)
        else:  # no interval was parted, so none will be
            break
    return apart


def later_windows(runs: list[bytes], at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, window in it) of the windows of ``runs`` of which an equal one starts earlier; ``at``: document, copy and place of each run, in this order."""
    order = np.lexsort(at[::-1])
    runs, at = [runs[k] for k in order.tolist()], at[:, order]
    size = np.array([len(x) for x in runs])
    data = np.frombuffer(GAP.join(runs) + GAP, np.uint8)
    base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    windows = size - least + 1
    run = np.repeat(np.arange(len(runs)), windows)
    inner = np.arange(len(run)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    _, inverse, rows, known, apart = parted(data, least)
    kind = np.cumsum(expand(rows, least, known, apart))[inverse[base[run] + inner]]
    lead = np.empty(kind.max() + 1, np.int64)
    lead[kind[::-1]] = np.arange(len(kind))[::-1]  # the first of each kind, as windows stand in their order
    of = lead[kind]
    same = (at[0][run] == at[0][run[of]]) & (at[1][run] == at[1][run[of]]) & (at[2][run] + inner == at[2][run[of]] + inner[of])
    late = np.flatnonzero(~same)
    return order[run[late]], inner[late]


def joined(at: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Intervals (document, copy, lo, hi), those that touch made one; ``at``: document, copy and lo of each."""
    order = np.lexsort(at[::-1])
    (doc, copy, lo), hi = at[:, order], hi[order]
    if len(doc):
        shift = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])])) * (1 << 40)
        far = np.maximum.accumulate(hi + shift)
        first = np.flatnonzero(np.concatenate([[True], (lo + shift)[1:] > far[:-1]]))
        last = np.append(first[1:] - 1, len(doc) - 1)
        doc, copy, lo, hi = doc[first], copy[first], lo[first], far[last] - shift[first]
    return [doc, copy, lo, hi]


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


INTERVAL = "doc long, copy long, lo long, hi long"


def repeats(src: DataFrame, least: int) -> DataFrame:
    """doc, copy, lo, hi: marked intervals (several of one document may overlap). ``src``: doc, copy (rows of equal doc and copy have equal texts), t."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column("doc").to_numpy(), batch.column("copy").to_numpy()
            for lo, _, data, offsets in text_slices(batch, "t", RUN_BYTES):
                text, start, n, name, content = runs_of(data, offsets, least)
                if not len(text):
                    continue
                at = np.stack([ids[lo + text], copies[lo + text], start])
                order = np.lexsort((*at[::-1], content, name))
                same = np.concatenate([[False], (name[order[1:]] == name[order[:-1]]) & (content[order[1:]] == content[order[:-1]])])
                lead = np.flatnonzero(~same)[np.cumsum(~same) - 1]
                keep, late = order[~same], order[(at[:, order] != at[:, order[lead]]).any(0)]
                doc, copy, mlo, mhi = joined(at[:, late], start[late] + n[late] + least - 1)
                spread = mix(doc.view(np.uint64)).view(np.int64)
                yield batch_of(
                    name=np.concatenate([name[keep].view(np.int64), spread]),
                    content=np.concatenate([content[keep].view(np.int64), np.zeros(len(doc), np.int64)]),
                    doc=np.concatenate([at[0][keep], doc]),
                    copy=np.concatenate([at[1][keep], copy]),
                    lo=np.concatenate([start[keep], mlo]),
                    hi=np.concatenate([start[keep] + n[keep] + least - 1, mhi]),
                    open=np.concatenate([np.ones(len(keep), bool), np.zeros(len(doc), bool)]),
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one name stand together, by content, then by place; only the row before is carried on."""
        held = None  # last content's first row, and whether its name was asked for
        for batch in batches:
            kind = batch.column("open").to_numpy(zero_copy_only=False)
            if (~kind).any():
                done = batch.filter(pa.array(~kind))
                yield batch_of(name=np.zeros(done.num_rows, np.int64), **{c: done.column(c) for c in ("doc", "copy", "lo", "hi")}, ask=np.zeros(done.num_rows, bool))
                batch = batch.filter(pa.array(kind))
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in ("name", "content", "doc", "copy", "lo", "hi")])
            if held is not None:
                rows = np.concatenate([held[0][:, None], rows], axis=1)
            name, content = rows[:2]
            new_name = np.concatenate([[True], name[1:] != name[:-1]])
            new = new_name | np.concatenate([[True], content[1:] != content[:-1]])
            first = np.flatnonzero(new)
            lead = first[np.cumsum(new) - 1]
            late = np.flatnonzero((rows[2:5] != rows[2:5][:, lead]).any(0))
            # of each name: how many contents so far; a name's first content is asked for when a second comes
            named_at = np.flatnonzero(new_name[first])
            contents = np.diff(np.append(named_at, len(first)))
            many = np.repeat(contents > 1, contents)
            sent = np.zeros(len(first), bool)
            if held is not None and held[1]:  # asked for in an earlier batch, as its name's later contents are
                sent[0] = True
                many[: contents[0]] = True
            ask = first[many & ~sent]
            both = np.concatenate([ask, late])
            yield batch_of(name=np.where(np.arange(len(both)) < len(ask), name[both], 0), doc=rows[2][both], copy=rows[3][both], lo=rows[4][both], hi=rows[5][both], ask=np.arange(len(both)) < len(ask))
            held = (rows[:, first[-1]], bool(many[-1]))

    met = src.mapInArrow(runs, f"name long, content long, {INTERVAL}, open boolean").repartition("name").sortWithinPartitions("name", "content", "doc", "copy", "lo")
    met = stored(met.mapInArrow(meet, f"name long, {INTERVAL}, ask boolean"), "runs")
    marked = met.where("not ask").select("doc", "copy", "lo", "hi")

    asked = met.where("ask")
    many = asked.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.col("name").alias("n2"), (F.col("n") > MOST_RUNS).alias("hot"))
    wanted = asked.join(many, F.expr("name = n2")).groupBy("doc", "copy").agg(F.collect_list(F.struct("name", "lo", "hi", "hot")).alias("runs"))
    carried = wanted.select(F.col("doc").alias("d2"), F.col("copy").alias("c2"), "runs").join(pack_texts(src), F.expr("d2 = doc and c2 = copy")).select("doc", "copy", "runs", "t")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of runs; of hot names the windows' hashes."""
        for batch in batches:
            for part in unpacked(batch, "t", 50):
                out: dict[str, list] = {c: [] for c in ("name", "window", "doc", "copy", "lo", "body", "hot")}
                for doc, copy, own, text in zip(*(part.column(c).to_pylist() for c in ("doc", "copy", "runs", "t")), strict=True):
                    data = (text or "").encode()
                    for r in own:
                        body = data[r["lo"] : r["hi"]]
                        h = window_hashes(np.frombuffer(body, np.uint8), least).view(np.int64).tolist() if r["hot"] else [0]
                        k = len(h)
                        for c, x in (("name", [r["name"]] * k), ("window", h), ("doc", [doc] * k), ("copy", [copy] * k), ("lo", range(r["lo"], r["lo"] + k)), ("body", [None if r["hot"] else body] * k), ("hot", [r["hot"]] * k)):
                            out[c] += x
                kinds = {"body": pa.binary(), "hot": pa.bool_()}
                yield batch_of(**{c: pa.array(x, kinds.get(c, pa.int64())) for c, x in out.items()})

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: list[bytes] = []
        places: list[np.ndarray] = []

        def part() -> pa.RecordBatch:
            at = np.concatenate(places, axis=1)
            run, inner = later_windows(bodies, at, least)
            own = at[:, run] + np.stack([np.zeros_like(inner), np.zeros_like(inner), inner])
            return batch_of(**dict(zip(("doc", "copy", "lo", "hi"), joined(own, own[2] + least), strict=True)))

        size = 0
        for group in groups(batches, ["name"]):
            own = group.column("body").to_pylist()
            if size and size + sum(map(len, own)) > BLOCK_BYTES:
                yield part()
                bodies, places, size = [], [], 0
            bodies += own
            places.append(np.stack([group.column(c).to_numpy() for c in ("doc", "copy", "lo")]))
            size += sum(map(len, own))
        if bodies:
            yield part()

    cut = stored(carried.mapInArrow(cut_out, "name long, window long, doc long, copy long, lo long, body binary, hot boolean"), "run-bytes")
    by_block = cut.where("not hot").select("name", "doc", "copy", "lo", "body").repartition("name").sortWithinPartitions("name").mapInArrow(block, INTERVAL)
    hot = cut.where("hot").select("name", "window", "doc", "copy", "lo")
    lead = hot.groupBy("name", "window").agg(F.min(F.struct("doc", "copy", "lo")).alias("first")).select(F.col("name").alias("n2"), F.col("window").alias("w2"), "first")
    by_window = hot.join(lead, F.expr("name = n2 and window = w2")).where("doc != first.doc or copy != first.copy or lo != first.lo").select("doc", "copy", "lo", (F.col("lo") + least).alias("hi"))
    return marked.unionByName(by_block).unionByName(by_window)


def spans_of(intervals: list, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals, within 0 to n."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], min(r["hi"], n)) for r in intervals or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif lo < hi:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def whole_chars(spans: list[tuple[int, int]], data: bytes) -> list[tuple[int, int]]:
    """Spans less the parts of characters at their edges."""
    inner = lambda k: k < len(data) and data[k] & 0xC0 == 0x80
    out = []
    for lo, hi in spans:
        while lo < hi and inner(lo):
            lo += 1
        while hi > lo and inner(hi):
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def dedup(docs: DataFrame, least: int = LEAST, chars: bool = False, carry: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of lo, hi: the marked bytes' maximal runs), kept (the other bytes), rest (``carry``) of every row.

    With ``chars``, spans leave characters whole, so that what is kept is UTF-8.
    """
    src = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc"), F.xxhash64(docs[f"`{text}`"]).alias("copy"), docs[f"`{text}`"].alias("t"), F.struct(F.lit(0).alias(free_name(list(carry), "_")), *[docs[f"`{c}`"] for c in carry]).alias("rest"))
    known = src.where("doc is not null").select("doc", "copy", "t")
    found = repeats(known, least).groupBy("doc", "copy").agg(F.collect_list(F.struct("lo", "hi")).alias("marks")).select(F.col("doc").alias("d2"), F.col("copy").alias("c2"), "marks")
    both = pack_texts(src).join(found, F.expr("doc = d2 and copy = c2"), "left").select("doc", "t", "marks", "rest")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in unpacked(batch, "t"):
                sizes, spans, kept = [], [], []
                for text, marks in zip(part.column("t").to_pylist(), part.column("marks").to_pylist(), strict=True):
                    data = (text or "").encode()
                    own = spans_of(marks, len(data))
                    if chars:
                        own = whole_chars(own, data)
                    at = [0, *(x for s in own for x in s), len(data)]
                    sizes.append(len(data))
                    spans.append([{"lo": a, "hi": b} for a, b in own])
                    kept.append(b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary()), part.column("rest")], ["doc_id", "n_bytes", "spans", "kept", "rest"])

    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

    span = StructType([StructField("lo", LongType()), StructField("hi", LongType())])
    schema = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("spans", ArrayType(span)), StructField("kept", BinaryType()), StructField("rest", src.schema["rest"].dataType)])
    return both.mapInArrow(take, schema)
