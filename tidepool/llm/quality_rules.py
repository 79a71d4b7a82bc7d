"""Rule bitmask ledger: every rule measured once, policies and ablations from bits.

``ledger`` keeps one row per document: the measurements, and ``failed``, a bigint
with bit k set where rule k fails.  A policy is a named, versioned set of rules with
a number of failures it bears; applying another policy, or counting what one rule
alone decides, reads the ledger and never the texts again.

DataFrame functions only.  Words are maximal runs of other than space and \\t-\\r.
Repeats are found by sorting each document's 64-bit word-window hashes, so that no
row leaves its task: nothing is shuffled, whatever the lengths of texts are.

Cases: null and empty texts have no words and fail ``few_words``; equal rows give
equal rows; a null id stays null; very long texts are measured whole, in time that grows as their words' number
times its logarithm; n_letters counts what is neither an ASCII digit nor ASCII punctuation; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import named

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    #: Rules any of which rejects.
    hard: tuple[str, ...]
    #: Rules of which more than ``bears`` failures reject.
    soft: tuple[str, ...] = ()
    bears: int = 0

    def rejects(self, failed: Column) -> Column:
        soft = F.bit_count(failed.bitwiseAND(F.lit(mask(self.soft)).cast("long"))) > self.bears
        return (failed.bitwiseAND(F.lit(mask(self.hard)).cast("long")) != 0) | (soft if self.soft else F.lit(False))


def rules() -> dict[str, Column]:
    """Name of each rule and when it fails, over the measurements; a rule's place is its bit."""
    n, words = F.col("n_words"), F.greatest(F.col("n_words"), F.lit(1))
    return {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "many_words": n > 1_000_000,
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 15 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "duplicate_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "few_letters": 10 * F.col("n_letters") < 6 * F.col("word_chars"),
        "bare_words": 2 * F.col("n_word_symbols") > words,
    }


def mask(names: tuple[str, ...]) -> int:
    order = list(rules())
    return sum(1 << order.index(x) for x in names)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
WEB = Policy("web", 1, ("few_words", "repeated_words", "many_words", "short_words", "long_words", "symbols", "duplicate_lines", "few_letters", "bare_words"))


def held(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, whatever the number of times ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_positions(words: Column, width: int = 3) -> Column:
    """How many words stand in windows of ``width`` words that occur at least twice."""
    last = F.size(words) - width
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(width)]).alias("h"), i.cast("int").alias("i")))

    def places(s: Column) -> Column:
        twins = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins))))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(last >= 1, held(held(F.sort_array(hashes), places), covered)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measurements of each row."""
    src = named(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    words = F.filter(F.split("t", SPACE), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    size = lambda a: F.size(a).cast("long")
    return src.select(
        "doc_id",
        held(words, lambda w: F.struct(size(w).alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_positions(w).alias("n_repeat_words"))).alias("w"),
        held(lines, lambda x: F.struct(size(x).alias("n_lines"), (size(x) - size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"[!-@\[-`{-~]+", ""))).cast("long").alias("n_marks"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>](?![^\x20\x09-\x0D])")).cast("long").alias("n_word_symbols"),
    ).select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", (F.col("w.word_chars") - F.col("n_marks")).alias("n_letters"), "n_word_symbols")


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements and ``failed``, the bits of the rules that fail."""
    bits = F.lit(0).cast("long")
    for k, fails in enumerate(rules().values()):
        bits = bits + F.when(fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return measure(docs, doc_id, text).withColumn("failed", bits)


def apply_policy(ledger: DataFrame, policy: Policy, kept: str = "kept") -> DataFrame:
    return ledger.withColumns({kept: ~policy.rejects(F.col("failed")), "policy": F.lit(f"{policy.name}-{policy.version}")})


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: how many rows fail it, and how many would be kept without it.

    One pass over distinct bit patterns: rows are counted by pattern first.
    """
    patterns = ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    names = list(rules())
    rows = []
    for name in (*policy.hard, *policy.soft):
        bit = F.lit(1 << names.index(name)).cast("long")
        without = policy.rejects(F.col("failed").bitwiseAND(F.bitwise_not(bit)))
        fails = F.col("failed").bitwiseAND(bit) != 0
        rows.append(F.struct(F.lit(name).alias("rule"), F.when(fails, F.col("n")).otherwise(0).alias("fails"), F.when(policy.rejects(F.col("failed")) & ~without, F.col("n")).otherwise(0).alias("alone")))
    return patterns.select(F.explode(F.array(*rows)).alias("r")).groupBy("r.rule").agg(F.sum("r.fails").alias("fails"), F.sum("r.alone").alias("alone"))
