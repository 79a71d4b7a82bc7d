"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, jaccard_join, language, line_templates, packing, pieces, quality_rules, spelling, suffix_dedup, toxicity, url_filter, vector_lsh, warc
from .shared import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.parse_records(warc.read_archive(spark, archive))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policy(quality_rules.apply_policy(led, quality_rules.BASE, "base_kept"), quality_rules.WEB)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"), least=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op8_vector_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_lsh.link_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=199)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_line_templates": op6_line_templates,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_vector_lsh": op8_vector_lsh,
    "op9_pieces": op9_pieces,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_spelling": op12_spelling,
    "op13_language": op13_language,
}

ORACLE_SQL = {
    "op2_warc": """
WITH r AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     last AS (SELECT d, max(page_id) AS last, count(*) AS k FROM r WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, r.d AS payload_digest,
       CASE WHEN k > 1 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND page_id <> last THEN last END AS refers_to
FROM r LEFT JOIN last ON r.d = last.d""",
    "op3_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
        length(regexp_replace(t, '[\x20\x09-\x0D!-@\[-`{-~]+', '', 'g')) AS n_letters,
        len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]$'))) AS n_ws
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
        + 4 * CAST(n_words > 1000000 AS BIGINT) + 8 * CAST(word_chars < 2 * n_words AS BIGINT)
        + 16 * CAST(word_chars > 15 * n_words AS BIGINT) + 32 * CAST(10 * n_symbols > 3 * n_words AS BIGINT)
        + 64 * CAST(10 * n_dup_lines > 3 * n_lines AS BIGINT) + 128 * CAST(10 * n_letters < 6 * word_chars AS BIGINT)
        + 256 * CAST(2 * n_ws > greatest(n_words, 1) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM f""",
    "op11_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM s),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, k WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k >= 2 AND NOT EXISTS (
        SELECT 1 FROM f AS o WHERE o.lang = f.lang AND o.k > f.k AND 100 * o.f >= 100 * f.f AND contains(' ' || o.phrase || ' ', ' ' || f.phrase || ' '))),
cut AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM c),
sc AS (SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, n.n,
         CAST((CAST(1000 AS HUGEINT) * a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
       FROM cut JOIN n ON n.lang = cut.lang
         JOIN f AS x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1 : j], ' ')
         JOIN f AS y ON y.lang = cut.lang AND y.phrase = array_to_string(w[j + 1 :], ' ')),
b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000""",
    "op12_spelling": r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS x(i))),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
d AS (SELECT doc, run, count(*) AS k, hex(doc || ':' || run) AS hex FROM o GROUP BY doc, run),
h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(hex) // 2), lambda i: CAST('0x' || substr(hex, 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) AS crc FROM d, tab),
s AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
l AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
one AS (SELECT DISTINCT l.word, l.n, w.word AS form, w.n AS form_n FROM l JOIN w ON l.less = w.word),
near AS (SELECT word, form, form_n FROM one UNION ALL SELECT form, word, n FROM one
         UNION ALL SELECT a.word, b.word, b.n FROM l AS a JOIN l AS b ON a.less = b.less AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, first(form ORDER BY form_n DESC, form) AS form, max(form_n) AS form_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
r AS (SELECT word, word AS place, 0 AS d FROM f UNION ALL SELECT r.word, f.form, d + 1 FROM r JOIN f ON f.word = r.place WHERE f.form IS NOT NULL),
top AS (SELECT word, arg_max(place, d) AS root FROM r GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN top ON f.word = top.word""",
}
