"""Registered queries of the subpackage and, where SQL can express them, their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (collocations, count_viterbi, ctw, gumbel_sampling, html_blocks, minhash_join, packing, quality_rules, rp_forest, spelling,
               string_kernel, toxic_crf, url_filter)
from .common import fold, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM x),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM k),
s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM c WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8))) AS n FROM s GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_exclamations,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
        + 4 * (100 * n_dup_lines > 60 * n_lines)::BIGINT + 8 * (100 * n_symbols > 25 * n_words)::BIGINT
        + 16 * (100 * n_exclamations > 25 * n_words)::BIGINT + 32 * (word_chars < 2 * n_words)::BIGINT
        + 64 * (word_chars > 14 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits FROM b
"""


@query("op8_quality_rules", QUALITY_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_rules.apply_policy(rows, "2").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.fails("base").alias("base_failed"), "kept", "fail_bits")


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


@query("op5_minhash_join")
def op5_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_string_kernel")
def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = string_kernel.train(docs, ~held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return string_kernel.predict(rows, model).drop("text")


@query("op9_toxic_crf")
def op9_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxic_crf.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxic_crf.score(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op1_html_blocks")
def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages.select("page_id", "url", "html"), html_blocks.train(pages))


@query("op7_rp_forest")
def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_count_viterbi")
def op4_count_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_viterbi.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_gumbel_sampling")
def op2_gumbel_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gumbel_sampling.sample(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "sample", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "log_prob", "perturbed",
                        "inclusion", F.crc32("ids").alias("ids_crc32"))


@query("op10_ctw")
def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)


COLLOCATION_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k AS words, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
c AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM c WHERE words = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT lang, words, phrase, a, string_split(phrase, ' ') AS ws FROM c WHERE words > 1 AND a >= 30),
k AS (SELECT lang, words, phrase, a, ws, unnest(range(1, words)) AS k FROM f),
x AS (SELECT k.lang, k.words, k.phrase, k.a, k.k, u.a AS l, v.a AS r, CAST(2000000::HUGEINT * k.a // (u.a + v.a) AS BIGINT) AS score
  FROM k JOIN c u ON u.lang = k.lang AND u.phrase = array_to_string(k.ws[1:k.k], ' ')
  JOIN c v ON v.lang = k.lang AND v.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
s AS (SELECT lang, a AS big, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, ws, words, m, unnest(range(1, words - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE words > m)),
z AS (SELECT lang, phrase, max(big) AS big FROM s GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n USING (lang) LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase
WHERE coalesce(100 * z.big < 80 * b.a, true)
QUALIFY rank <= 2000
"""


@query("op12_collocations", COLLOCATION_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SPELLING_SQL = r"""
WITH RECURSIVE b AS (SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE text IS NOT NULL),
c AS (SELECT key, run, count(*) AS n FROM o GROUP BY ALL),
y AS (SELECT run, n, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END
    FOR x IN string_split(key || ':' || run, '')]) AS bytes FROM c),
h AS (SELECT run, n, length(run) AS len, xor(list_reduce(bytes, lambda s, v: xor(s >> 8, tab[xor(s, v) % 256 + 1]), 4294967295), 4294967295) AS h
  FROM y, b),
k AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % len) || substr(run, h % len + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, n, i, length(word) AS len, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.i = y.i AND x.len = y.len AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
q AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM p
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) = 1),
f AS MATERIALIZED (SELECT v.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN q USING (word)),
r AS (SELECT word AS root, word AS at, 0 AS depth FROM f WHERE form IS NULL
  UNION ALL SELECT r.root, f.word, r.depth + 1 FROM r JOIN f ON f.form = r.at)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.at = f.word
"""


@query("op13_spelling", SPELLING_SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query("op11_url_filter")
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES)
