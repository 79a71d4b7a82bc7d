"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

Columns of any name are carried along; rows of one id with different texts are documents of
their own in every stage, and so are rows with a null id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import jaccard_join, line_templates, packing, suffix_dedup, toxicity
from tidepool.llm.queries import tokenizer_path
from tidepool.llm.shared import free_name, freed, scratch, small_or_joined, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the model is learned from the tables as they came."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "score")
    return toxicity.with_score(docs, model, column=score).where(F.col(f"`{score}`") < 0.5).drop(score)


def with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` with n_chars, where there is one, counted again."""
    cols = [F.char_length("text").cast(like.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in like.columns]
    return docs.select(*cols)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(line_templates.drop_lines(docs, n_lines=None, n_dropped=None), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more join, that of the smallest id stays (of the smallest hash, if texts share it; a null id comes last).

    Rows equal in id and text, by 128 bits of hashes, are one document.  Documents without words are linked with nothing and stay.
    """
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(docs["doc_id"], docs["text"]).alias("key"), F.xxhash64(docs["text"], docs["doc_id"], F.lit(1)).alias("key2"), docs["doc_id"].alias("id"), docs["text"].alias("t"))
    parts = stored(jaccard_join.jaccard_components(whole, doc_id="key", text="t").select(F.col("doc_id").alias("k"), "component_id"), "parts")
    ids = whole.groupBy("key").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("n"))
    rows = parts.distinct().join(ids, F.expr("k = key")).select("k", "component_id", "id", "n")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("first"))
    keep = stored(rows.join(first.select(F.col("first.k").alias("k1")), F.expr("k = k1")).select("k", (F.col("n") > 1).alias("again")), "kept")
    freed(parts)
    kept = small_or_joined(whole.select("row", "key", "key2"), keep, F.expr("key = k"))
    if keep.where("again").limit(1).count():
        again = kept.where("again").dropDuplicates(["key", "key2"])
        kept = kept.where("not again").unionByName(again)
    return kept.select("row.*")


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that start earlier go, whole characters of them."""
    rest = tuple(c for c in docs.columns if c != "text")
    found = suffix_dedup.dedup(docs, least=100, chars=True, carry=rest)
    return with_text(found.select(F.decode("kept", "UTF-8").alias("text"), *[F.col(f"rest.`{c}`").alias(c) for c in rest]), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_templates", drop_template_lines),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack),
]

#: Compression lengths, transforms and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; what a stage stored is deleted once the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), name))
        freed(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
