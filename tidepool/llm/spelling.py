"""Spelling variants: words one insertion, deletion or replacement apart, and the frequent form of each.

Words of all texts are counted.  The distinct ones are sorted over range partitions, and each task
packs its words into compact tries (a byte and a child's number a node, 12 bytes a word) of at most
``SHARD_WORDS`` words.  Shards are broadcast in rounds of at most ``ROUND_BYTES``, measured before.  A
task intersects the distance-one Levenshtein automaton of each of its words with every shard, depth
first: along the word itself, where no error is spent yet, each child may stand for a replaced or an
inserted letter and each letter may lack; after that only exact letters go on.  A shard holds neighbours
in spelling order, so most words leave it at its root.  What a shard accepts is reduced to a
number and a best form, and these are reduced over the shards.

``every`` plants noise for measuring (a letter of every 199th occurrence, by hash, is deleted); None leaves words as they are.

Cases: null texts and texts without letters have no words; a null id counts as an empty one where noise
is dealt; repeated rows count as often as they stand; equal counts go to the form smallest in code points; words of any
length are compared whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import array
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import named, stored
from .textkit import texts

#: Words of a trie; bytes of the tries that are broadcast at a time; words that a task intersects.
SHARD_WORDS, ROUND_BYTES, TASK_WORDS = 200_000, 32 << 20, 20_000
#: Distinct words that a task counts before it sends them.
HELD = 200_000


def word_counts(src: DataFrame, letters: int, every: int | None) -> DataFrame:
    """word, n: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, of at least ``letters`` code points. ``src``: id, t."""
    run = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % letters)

    def spoiled(word: bytes, h: int) -> bytes:
        own = word.decode()
        k = h % len(own)
        return (own[:k] + own[k + 1 :]).encode() if len(own) > letters else b""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def send() -> Iterator[pa.RecordBatch]:
            seen.pop(b"", None)
            words, n = list(seen), list(seen.values())
            seen.clear()
            for k in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 20_000], pa.binary()).cast(pa.string()), pa.array(n[k : k + 20_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), texts(batch, "t"), strict=True):
                found = run.findall(text.encode().lower())
                seen.update(found)
                if every:
                    start = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for word in found:
                        h = zlib.crc32(word, start)
                        if h % every == 0:
                            seen[word] -= 1
                            seen[spoiled(word, h)] += 1
                if len(seen) > HELD:
                    yield from send()
        yield from send()

    return src.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """Nodes level by level, those of one level in order: ``label`` (a Latin-1 letter each), ``kid`` (the first child of each, and an end), words' last nodes and counts."""

    def __init__(self, label: str, kid: array.array, last: array.array, count: array.array):
        self.label, self.kid, self.last, self.count = label, kid, last, count

    @classmethod
    def of(cls, words: list[bytes], n: np.ndarray) -> Trie:
        """From different words in order, as Latin-1."""
        size = np.array([len(w) for w in words], np.int64)
        data, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        label, parents = [np.zeros(1, np.uint8)], []
        node, made = np.zeros(len(words), np.int64), 1
        last = np.zeros(len(words), np.int64)
        active, depth = np.flatnonzero(size > 0), 0
        while len(active):
            c, above = data[at[active] + depth], node[active]
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (above[1:] != above[:-1])])
            node[active] = made + np.cumsum(new) - 1
            label.append(c[new])
            parents.append(above[new])
            made += int(new.sum())
            depth += 1
            done = size[active] == depth
            last[active[done]] = node[active[done]]
            active = active[~done]
        kids = np.bincount(np.concatenate(parents), minlength=made) if parents else np.zeros(1, np.int64)
        order = np.argsort(last, kind="stable")
        kid = np.concatenate([[1], 1 + np.cumsum(kids)])
        pack = lambda kind, x: array.array(kind, x.tobytes())
        return cls(np.concatenate(label).tobytes().decode("latin-1"), pack("I", kid.astype(np.uint32)), pack("I", last[order].astype(np.uint32)), pack("q", n[order].astype(np.int64)))

    def packed(self) -> bytes:
        body = [self.label.encode("latin-1"), self.kid.tobytes(), self.last.tobytes(), self.count.tobytes()]
        return np.array([len(x) for x in body], "<i8").tobytes() + b"".join(body)

    @classmethod
    def unpacked(cls, raw: bytes) -> Trie:
        cut = (32 + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", 4))])).tolist()
        a, b, c, d = (raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True))
        return cls(a.decode("latin-1"), array.array("I", b), array.array("I", c), array.array("q", d))

    def near(self, w: str) -> Iterator[tuple[str, int]]:
        """(word, count) of each word at distance one, once each: of equal letters in a row only the first lacks or is doubled."""
        label, kid, last, count = self.label, self.kid, self.last, self.count
        find, m = label.find, len(w)

        def rest(node: int, i: int) -> int:
            """The count of the word that goes on from a node with w[i:], or 0."""
            for c in w[i:]:
                node = find(c, kid[node], kid[node + 1])
                if node < 0:
                    return 0
            k = bisect_left(last, node)
            return count[k] if k < len(last) and last[k] == node else 0

        node = 0
        for i in range(m):
            here, a, b = w[i], kid[node], kid[node + 1]
            before = w[i - 1] if i else ""
            if here != before and (n := rest(node, i + 1)):
                yield w[:i] + w[i + 1 :], n
            after = w[i + 1] if i + 1 < m else ""
            for j in range(a, b):
                x, y = kid[j], kid[j + 1]
                c = label[j]
                if c != before and find(here, x, y) >= 0 and (n := rest(j, i)):
                    yield w[:i] + c + w[i:], n
                if c != here and (not after or find(after, x, y) >= 0) and (n := rest(j, i + 1)):
                    yield w[:i] + c + w[i + 1 :], n
            node = find(here, a, b)
            if node < 0:
                return
        for j in range(kid[node], kid[node + 1]):
            if label[j] != w[-1:] and (n := rest(j, m)):
                yield w + label[j], n


def tries(words: DataFrame, parts: int) -> DataFrame:
    """first (word), size, trie: tries of the words in order, of ``SHARD_WORDS`` at most. ``words``: word, n."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def send() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            own = whole.column("word").to_pylist()
            raw = Trie.of([x.encode("latin-1") for x in own], whole.column("n").to_numpy()).packed()
            return pa.RecordBatch.from_arrays([pa.array(own[:1]), pa.array([len(raw)], pa.int64()), pa.array([raw], pa.binary())], ["first", "size", "trie"])

        for batch in batches:
            for k in range(0, batch.num_rows, 10_000):
                held.append(batch.slice(k, 10_000))
                if sum(b.num_rows for b in held) > SHARD_WORDS - 10_000:
                    yield send()
                    held = []
        if held:
            yield send()

    return words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(build, "first string, size long, trie binary")


def neighbours(words: DataFrame) -> DataFrame:
    """word, near (how many words of the table are at distance one), best (struct of the largest n, negated, and its word). ``words``: word, n; words differ."""
    spark, total = words.sparkSession, words.count()
    shards = stored(tries(words, max(1, -(-total // SHARD_WORDS))), "word-tries")
    sizes = shards.select("first", "size").orderBy("first").collect()  # a row for 200,000 words
    rounds: list[list] = []
    for r in sizes:
        if not rounds or sum(x.size for x in rounds[-1]) + r.size > ROUND_BYTES:
            rounds.append([])
        rounds[-1].append(r)
    dealt = words.select("word").repartition(max(1, -(-total // TASK_WORDS)))
    found = spark.createDataFrame([], "word string, near long, best struct<n:long,form:string>")
    for own in rounds:
        some = shards.where(F.col("first").between(own[0]["first"], own[-1]["first"])).select("trie").collect()  # ROUND_BYTES, or one trie
        held = spark.sparkContext.broadcast([bytes(r.trie) for r in some])
        del some

        def intersect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            every = [Trie.unpacked(x) for x in held.value]
            for batch in batches:
                out: list[tuple] = []
                for word in batch.column("word").to_pylist():
                    near, best = 0, (0, "")
                    for trie in every:
                        for form, n in trie.near(word):
                            near += 1
                            best = min(best, (-n, form))
                    if near:
                        out.append((word, near, {"n": best[0], "form": best[1]}))
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.struct([("n", pa.int64()), ("form", pa.string())]))], ["word", "near", "best"])

        found = found.unionByName(stored(dealt.mapInArrow(intersect, "word string, near long, best struct<n:long,form:string>"), "near-words"))
        held.unpersist()
    return found.groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))


def last_forms(links: DataFrame) -> DataFrame:
    """word, root: from each word along the links (word, form) to the last form; each round doubles the steps, and no link leads in a circle."""
    at = stored(links.select("word", F.col("form").alias("root")), "word-forms")
    while True:
        on = at.select(F.col("word").alias("w2"), F.col("root").alias("next"))
        step = stored(at.join(on, F.expr("root = w2"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "word-roots")
        if not step.where("more").limit(1).count():
            return step.select("word", "root")
        at = step.select("word", "root")


def variants(docs: DataFrame, letters: int = 6, least: int = 5, times: int = 5, every: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of at least ``letters`` letters and ``least`` occurrences.

    form: the most frequent near word, if it is ``times`` as frequent as the word or more; root: where forms end.
    """
    src = named(docs, id=doc_id, t=text)
    words = stored(word_counts(src, letters, every).where(F.col("n") >= least), "words")
    near = neighbours(words).withColumnRenamed("word", "w2")
    joined = words.join(near, F.expr("word = w2"), "left")
    form_n = -F.col("best.n")
    formed = joined.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(form_n >= times * F.col("n"), F.struct(F.col("best.form").alias("form"), form_n.alias("n"))).alias("f"))
    formed = stored(formed.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")), "formed-words")
    roots = last_forms(formed.where("form is not null")).withColumnRenamed("word", "w2")
    return formed.join(roots, F.expr("word = w2"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
