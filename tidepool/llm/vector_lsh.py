"""Near duplicates among vectors: p-stable hashing in several tables, then exact cosines.

Vectors of equal label and bytes are one class.  Each class's unit vector is projected on
``PARTS`` Gaussian directions per table, shifted and quantised by ``WIDTH``; classes of one
cell of one table are compared by exact cosine.  A pair that meets in several tables
counts in the first of them only, so that links are counted without a list of pairs: a
task gives each class the number of its links and one edge to its local component.
Cells with one class are dropped before vectors are sent; large cells are dealt in pairs
of blocks.  A class is known by a hash of its label and bytes, as ids may be null or repeated;
a component is named by the least id of its classes.

Cases: a null label, null or empty vector, null or non-finite component, or zero vector
links with nothing; vectors of unequal length do not link; equal vectors link by a
cosine of 1; repeated rows of one id are rows of their own, which link as any others do; a null id is
never a component's name unless all its members are null; an empty table gives no rows; vectors of any
length are compared whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components, groups, in_blocks, roots
from .shared import named, stored
from .textkit import mix

#: For cosine 0.93 (a distance of 0.374) a table joins a pair with probability 0.80 ** 10, so 40 tables miss 1 pair in 100.
TABLES, PARTS, WIDTH, SEED = 40, 10, 1.5, 20_24
BLOCK = 1024


def cells(unit: np.ndarray) -> np.ndarray:
    """int32 (vectors, TABLES): each vector's cell in each table, as a hash."""
    rng = np.random.default_rng(SEED + unit.shape[1])
    directions, shift = rng.standard_normal((unit.shape[1], TABLES * PARTS)), rng.uniform(0, WIDTH, TABLES * PARTS)
    q = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, PARTS)
    h = np.zeros((len(unit), TABLES), np.uint64)
    for k in range(PARTS):
        h = mix(h ^ (q[:, :, k] + np.uint64(k + 1)))
    return h


def usable(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[int, np.ndarray]]:
    """(row, vector) of rows that can link: all components finite, not all zero."""
    column = batch.column("v")
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(kind)  # nulls become NaN
    before = lambda x: np.concatenate([[0], np.cumsum(x)])
    bad, other = before(~np.isfinite(values)), before(values != 0)
    ok = (bad[at[1:]] == bad[at[:-1]]) & (other[at[1:]] > other[at[:-1]])
    ok &= column.is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(ok).tolist():
        yield k, values[at[k] : at[k + 1]]


def units(vecs: list[bytes], kind: type) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_vectors(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept (is the component's smallest id) of every row."""
    src = named(vectors, vec_id=vec_id, v=embedding, label=label)
    kind, element = (np.float32, "float") if src.schema["v"].dataType.simpleString() == "array<float>" else (np.float64, "double")
    src = src.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast(f"array<{element}>").alias("v"), F.col("label").cast("string").alias("label"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [None] * batch.num_rows, [None] * batch.num_rows
            names = batch.column("label").to_pylist()
            for k, x in usable(batch, kind):
                vecs[k] = (x + kind(0)).tobytes()
                keys[k] = hashlib.blake2b(vecs[k] + names[k].encode(), digest_size=16, salt=len(vecs[k]).to_bytes(8, "little")).digest()
            cid = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in keys]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(cid, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "label", "cid", "vec"])

    all_rows = stored(src.mapInArrow(digest, "vec_id long, label string, cid long, vec binary"), "vectors")
    classes = stored(all_rows.where("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")), "classes")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            for size in {len(x) for x in vecs}:
                at = [k for k, x in enumerate(vecs) if len(x) == size]
                named_by = np.array([int.from_bytes(hashlib.blake2b(f"{x}/{size}".encode(), digest_size=8).digest(), "little") for x in batch.column("label").take(pa.array(at)).to_pylist()], np.uint64)
                code = (mix(cells(units([vecs[k] for k in at], kind)) ^ mix(named_by)[:, None]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(at)), pa.array(list(code), pa.list_(pa.int32()))], ["cid", "codes"])

    coded = stored(classes.select("cid", "label", "vec").mapInArrow(place, "cid long, codes array<int>"), "cells")
    spots = coded.select("cid", F.posexplode("codes").alias("t", "code"))
    shared = spots.groupBy("t", "code").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select(F.col("t").alias("t2"), F.col("code").alias("c2"), "g")
    live = spots.join(shared, F.expr("t = t2 and code = c2")).select("cid", "t", "code", "g")
    full = live.join(classes.select(F.col("cid").alias("r1"), "label", "n", "vec"), F.expr("cid = r1")).join(coded.select(F.col("cid").alias("r2"), "codes"), F.expr("cid = r2"))
    dealt = in_blocks(full.select("t", "code", "cid", "label", "n", "vec", "codes", "g"), ["t", "code"], "cid", "g", BLOCK)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        for group in groups(batches, ["t", "code", "b1", "b2"]):
            if group.num_rows < 2:
                continue
            t = group.column("t")[0].as_py()
            vecs, own = group.column("vec").to_pylist(), group.column("label").to_pylist()
            if len({len(x) for x in vecs}) > 1 or len(set(own)) > 1:  # codes of 32 bits may agree by chance
                kinds = {k: j for j, k in enumerate(dict.fromkeys(zip(own, map(len, vecs), strict=True)))}
                kind_of = np.array([kinds[x, len(v)] for x, v in zip(own, vecs, strict=True)])
            else:
                kind_of = np.zeros(len(vecs), int)
            half, cid, n = (group.column(c).to_numpy() for c in ("half", "cid", "n"))
            codes = np.stack(group.column("codes").to_numpy())
            near = np.zeros((len(vecs), len(vecs)), bool)
            for j in range(kind_of.max() + 1):
                at = np.flatnonzero(kind_of == j)
                x = units([vecs[k] for k in at.tolist()], kind)
                near[np.ix_(at, at)] = x @ x.T >= least
            a, b = np.nonzero(np.triu(near, 1))
            if group.column("b1")[0].as_py() != group.column("b2")[0].as_py():
                ok = half[a] != half[b]
                a, b = a[ok], b[ok]
            if len(a):
                first = np.concatenate([(codes[a[k : k + 100_000]] == codes[b[k : k + 100_000]]).argmax(1) for k in range(0, len(a), 100_000)])
                a, b = a[first == t], b[first == t]
            if len(a):
                count = np.bincount(a, n[b], len(cid)) + np.bincount(b, n[a], len(cid))
                root = roots(a, b, len(cid))
                at = np.flatnonzero(count)
                for held, v in zip(out, (cid[at], cid[root[at]], count[at].astype(np.int64)), strict=True):
                    held.append(v)
            if sum(map(len, out[0])) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["a", "b", "links"])
                out = [[], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["a", "b", "links"])

    found = stored(dealt.mapInArrow(compare, "a long, b long, links long"), "vector-links")
    counted = found.groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("more"))
    parts = stored(components(found.select("a", "b")), "vector-parts")
    own = classes.select("cid", "rep", "n").join(counted, F.expr("cid = of"), "left").join(parts, F.expr("cid = id"), "left")
    own = stored(own.select(F.col("cid").alias("c2"), "rep", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "cid").alias("part")), "vector-classes")
    names = own.groupBy("part").agg(F.min("rep").alias("name")).withColumnRenamed("part", "p2")
    out = all_rows.select("vec_id", "cid").join(own.join(names, F.expr("part = p2")).select("c2", "links", "name"), F.expr("cid = c2"), "left")
    whole = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("name"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"), F.col("vec_id").eqNullSafe(whole).alias("kept"))
