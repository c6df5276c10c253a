"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedback_spark.llm import (
    bin_packing, filter_audit, host_rules, html_blocks, huffman_files, leak_search, merge_tree, ngram_join, piece_counts, pu_quality, toxicity,
    transcripts, whitening,
)
from feedback_spark.llm.frames import importable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    back = huffman_files.round_trip(docs, public_tokenizers.path(WORD_VOCABULARY), end_id=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return host_rules.judge(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL["op5_host_rules"] = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT row, unnest(words) AS a, unnest(range(len(words))) AS i FROM d),
g AS (SELECT row, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e, lead(a, 4) OVER o AS f
      FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
r AS (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c, e, f) AS times FROM g WHERE f IS NOT NULL),
p AS (SELECT row, count(DISTINCT i + k) AS n FROM r, range(5) AS t(k) WHERE times > 1 GROUP BY row),
l AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row),
c AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM d LEFT JOIN m USING (row) LEFT JOIN p USING (row)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
f AS (SELECT *, 100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines FROM b),
h AS (SELECT source, 'all' AS rule, count(*) AS n, count_if(base_failed OR symbols OR lines)::BIGINT AS k FROM f GROUP BY source
      UNION ALL SELECT source, 'symbols', count_if(NOT base_failed), count_if(NOT base_failed AND symbols) FROM f GROUP BY source
      UNION ALL SELECT source, 'lines', count_if(NOT base_failed), count_if(NOT base_failed AND lines) FROM f GROUP BY source),
s AS (SELECT rule, sum(n) AS docs, sum(k) / sum(n) AS mean, count_if(n > 0) AS hosts, sum(k * k / n) FILTER (n > 0) / sum(n) AS squares
      FROM h GROUP BY rule),
v AS (SELECT rule, mean, mean * (1 - mean) AS spread, squares - mean * mean - hosts * mean * (1 - mean) / docs AS between_hosts FROM s),
q AS (SELECT rule, mean, least(greatest(CASE WHEN between_hosts > 0 THEN spread / between_hosts - 1 ELSE 1e6 END, 1), 1e6) AS weight FROM v),
r2 AS (SELECT source, rule, coalesce((k + mean * weight) / (n + weight), 0) AS rate FROM h JOIN q USING (rule)),
z AS (SELECT source, max(rate) FILTER (rule = 'all') AS rate, max(rate) FILTER (rule = 'symbols') AS symbols_rate,
             max(rate) FILTER (rule = 'lines') AS lines_rate FROM r2 GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate < 0.5 AND NOT (symbols AND symbols_rate >= 0.02) AND NOT (lines AND lines_rate >= 0.02) AS kept
FROM f JOIN z ON f.source IS NOT DISTINCT FROM z.source"""


@query
def op6_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = piece_counts.token_counts(docs, public_tokenizers.path(PIECE_VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op7_merge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_VOCABULARY)
    encoded = merge_tree.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    decoded = merge_tree.decode(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


SQL["op9_ngram_join"] = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, len(w) AS n, unnest(w) AS a, unnest(range(len(w))) AS i FROM t),
g AS (SELECT doc_id, n, i, concat_ws(' ', a, lead(a) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o, lead(a, 4) OVER o) AS s
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE i = 0 OR i <= n - 5),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 10 * c >= 8 * (x.size + y.size - c)),
r(root, doc_id) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.doc_id),
k AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM k LEFT JOIN l USING (doc_id)"""


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep_text=False)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    extracted = html_blocks.extract(pages, keep_html=False)
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse(table(spark, sf_dir, "conversations"))


@query
def op3_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bin_packing.shards(table(spark, sf_dir, "documents"), 16)
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op8_leak_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_search.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = """
WITH RECURSIVE l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS bad
                     FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
             (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
             + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(prefix, bit, before, step) AS (
  SELECT '', 0, 0, 0 UNION ALL
  SELECT p.prefix || f.letter, f.bit, p.before + p.bit, p.step + 1 FROM p, f WHERE (p.before + p.bit) & f.bit = 0),
o AS (SELECT o.prefix AS filter_order, p.* FROM p AS o JOIN p ON p.prefix = left(o.prefix, p.step) WHERE o.step = 5 AND p.step > 0),
r AS (SELECT part, filter_order, step, any_value(bit) AS bit,
             sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, o GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
