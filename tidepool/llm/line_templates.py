"""Lines that recur across documents, found as log templates in a fixed-depth tree.

A line goes down the tree by its number of tokens and its first ``depth`` tokens, tokens with
a digit counting as a variable field (``FIELD``) there and everywhere.  In its leaf, a token is
constant at its place if ``share`` of the leaf's documents have it there, and ``min_docs`` at
least; every other token is a variable field too, so that the cut follows the size of the leaf.
The line's template is what stays constant, unless more than half would be variable, when it is the
line with only its digits masked.  A template of ``min_docs`` documents or more is
boilerplate: its lines are dropped, all but the first one (by id, then line, then text).  Lines of
fewer than ``min_tokens`` tokens, which are never generalised, need ``short_docs`` documents.
Documents of equal text count once, so that mere copies make no boilerplate.

DataFrame functions only.  Texts are parsed once: lines are stored with their hashes, and
their strings are read again only for leaves that hold several lines of enough documents.  A leaf
has at most ``1 / share`` constant tokens at a place, so its list of them is bounded by the
line's length.  Counts are reduced before each shuffle; hot templates meet their row in joins
that Spark may split.

Cases: null texts stay null; empty lines are kept; equal rows lose equal lines but for the first
row's; a null id comes before all others; ties between equal places go by the hash of the text; an empty
table gives no rows; very long texts and lines cost in proportion to their length; columns of
any name besides are carried along, but for those of the names ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import held
from .shared import SMALL_ROWS, free_name, freed, small_or_joined, stored

FIELD = "<*>"
#: Space characters that seldom occur; texts without them, and without two spaces, need no look at each space.
ODD_SPACES = ("  ", "\t", "\r", "\x0b", "\x0c")


def masked(text: Column) -> Column:
    """Lines with single spaces between tokens, those with a digit as ``FIELD``; the whole text at once, as a call for each line costs more."""
    odd = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in ODD_SPACES])
    solid = F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D\x20]{2,}|[\x09\x0B-\x0D]", " ")).otherwise(text)
    return F.regexp_replace(solid, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", FIELD)


def lines_of(docs: DataFrame, depth: int) -> DataFrame:
    """doc, row (hash of id and text), body (hash of text), line, m (masked), n tokens, leaf, h of lines with a token. ``docs``: doc, row, body, t."""
    own = docs.select("doc", "row", "body", F.posexplode(F.transform(F.split(masked(F.col("t")), "\n"), lambda x: F.trim(x))).alias("line", "m"))
    n = F.octet_length("m") - F.octet_length(F.replace("m", F.lit(" "), F.lit(""))) + 1
    return own.where("m != ''").withColumn("n", n).withColumns({"leaf": F.xxhash64("n", F.substring_index("m", " ", depth)), "h": F.xxhash64("m", F.lit(2))})


def generalised(lines: DataFrame, min_docs: int, min_tokens: int, share: float) -> DataFrame:
    """h2, template: lines that their leaf's tree names anew."""
    per_line = lines.where(F.col("n") >= min_tokens).select("leaf", "h", "body").distinct().groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("docs"))
    per_line = stored(per_line, "template-lines")
    leaves = per_line.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count(F.lit(1)).alias("k")).where((F.col("leaf_docs") >= min_docs) & (F.col("k") > 1))
    pool = stored(per_line.join(leaves.select(F.col("leaf").alias("l2"), "leaf_docs"), F.expr("leaf = l2")).select("leaf", F.col("h").alias("h2"), "docs", "leaf_docs"), "template-pool")
    texts = small_or_joined(lines.select("h", "n", "m"), pool, F.expr("h = h2")).groupBy("leaf", "h", "n", "docs", "leaf_docs").agg(F.first("m").alias("m"))
    texts = stored(texts, "template-texts")
    places = F.transform(F.split("m", " "), lambda token, at: F.xxhash64(at, token))
    support = texts.select("leaf", "docs", "leaf_docs", F.explode(places).alias("p")).groupBy("leaf", "p").agg(F.sum("docs").alias("support"), F.first("leaf_docs").alias("leaf_docs"))
    constant = support.where((F.col("support") >= min_docs) & (F.col("support") >= F.lit(share) * F.col("leaf_docs"))).groupBy("leaf").agg(F.collect_set("p").alias("constant"))
    met = texts.select("leaf", "h", "n", places.alias("places")).join(constant.withColumnRenamed("leaf", "l2"), F.expr("leaf = l2"), "left")
    fixed = met.select("leaf", "h", "n", F.array_intersect("places", F.coalesce("constant", F.array().cast("array<bigint>"))).alias("fixed"))
    variable = F.col("n") - F.size("fixed")
    return stored(fixed.where((variable > 0) & (2 * variable <= F.col("n"))).select(F.col("h").alias("h2"), F.xxhash64("leaf", "fixed").alias("template")), "templates")


def drop_lines(docs: DataFrame, min_docs: int = 5, min_tokens: int = 3, short_docs: int = 25, depth: int = 3, share: float = 0.05, doc_id: str = "doc_id", text: str = "text", n_lines: str | None = "n_lines", n_dropped: str | None = "n_dropped") -> DataFrame:
    """All columns of ``docs``, with ``text`` less its dropped lines, and (where named) how many lines there were and went."""
    carried = [c for c in docs.columns if c.lower() not in {x.lower() for x in (n_lines, n_dropped) if x}]
    whole = docs.select(F.struct(F.lit(0).alias(free_name(carried, "_")), *[docs[f"`{c}`"] for c in carried if c != text]).alias("rest"), docs[f"`{doc_id}`"].cast("long").alias("doc"), docs[f"`{text}`"].alias("t"))
    whole = whole.withColumns({"doc": F.coalesce("doc", F.lit(-(1 << 63))), "row": F.xxhash64("doc", "t")})
    lines = stored(lines_of(whole.where("t is not null").select("doc", "row", F.xxhash64("t", F.lit(1)).alias("body"), "t"), depth), "lines")
    anew = generalised(lines, min_docs, min_tokens, share)
    known = small_or_joined(lines.select("doc", "row", "body", "line", "n", "h"), anew, F.expr("h = h2"), "left").select("doc", "row", "body", "line", "n", F.coalesce("template", "h").alias("template"))
    per_body = known.groupBy("template", "body").agg(F.min(F.struct("doc", "line", "row")).alias("first"), F.first("n").alias("n"))
    most = per_body.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first"), F.first("n").alias("n"))
    enough = F.when(F.col("n") >= min_tokens, min_docs).otherwise(short_docs)
    drop = stored(most.where(F.col("docs") >= enough).select(F.col("template").alias("t2"), "first"), "templates-dropped")
    gone = small_or_joined(known, drop, F.expr("template = t2")).where("not (doc = first.doc and line = first.line and row = first.row)")
    by_doc = stored(gone.groupBy("doc", "row").agg(F.collect_set("line").alias("gone")).select(F.col("doc").alias("d2"), F.col("row").alias("r2"), "gone"), "lines-dropped")
    freed(lines)
    lost = by_doc.agg(F.sum(F.size("gone"))).first()[0] or 0  # beyond that many lines, texts are shuffled to their lists
    both = whole.join(F.broadcast(by_doc) if lost <= SMALL_ROWS else by_doc, F.expr("doc = d2 and row = r2"), "left")
    many = F.coalesce(F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    left = F.array_except(F.sequence(F.lit(0), (many - 1).cast("int")), F.col("gone"))
    less = held(F.split("t", "\n"), lambda own: F.array_join(F.transform(left, lambda k: F.get(own, k)), "\n"))
    out = F.when(F.col("gone").isNull(), F.col("t")).otherwise(less)
    cols = [out.alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in carried]
    counts = ([many.alias(n_lines)] if n_lines else []) + ([F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias(n_dropped)] if n_dropped else [])
    return both.select(*cols, *counts)
