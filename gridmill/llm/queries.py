"""The thin queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import cross_entropy, html_density, langid_cnn, media_audio, near_duplicates, packing, quality_kneser_ney, quality_rules, secrets, unigram_pieces


def tokenizer_path(name: str) -> str:
    """The place of an installed tokenizer file (never copied here)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_cnn.language_of(_documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(_documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), keep_text=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in names], "base_failed", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(_documents(spark, sf_dir)).select("doc_id", "class_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_kneser_ney.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("lang",))


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_audio.digest(media_audio.stored_features(_documents(spark, sf_dir)))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy.score_against_trusted(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_pieces.encode(_documents(spark, sf_dir), unigram_pieces.Vocabulary.read(tokenizer_path("piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_audio_features": op8_audio_features,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_sentencepiece": op10_sentencepiece,
}

_RATES = ", ".join(f"('{k}', {m}, {f}, {c})" for k, (m, f, c) in quality_rules.RATES.items())
_OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT k, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d)),
t AS (SELECT k, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS t FROM w WINDOW p AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS n FROM t WHERE t IS NOT NULL) WHERE n > 1),
rw AS (SELECT k, count(DISTINCT i) AS n_repeat_words FROM (SELECT k, i FROM r UNION ALL SELECT k, i + 1 FROM r UNION ALL SELECT k, i + 2 FROM r) GROUP BY k),
wc AS (SELECT k, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, CAST(sum(length(regexp_replace(w, '[^#*$%&|<>]', '', 'g'))) AS BIGINT) AS n_symbols FROM w GROUP BY k),
ln AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT k, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY k),
c AS (SELECT d.k, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN wc USING (k) LEFT JOIN rw USING (k) LEFT JOIN ln USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
m AS (SELECT k, lang, source, base_failed, unnest([{{'rate': 'symbol_rate', 'v': n_symbols * 1000 // greatest(n_words, 1)}}, {{'rate': 'dup_line_rate', 'v': n_dup_lines * 1000 // greatest(n_lines, 1)}},
  {{'rate': 'repeat_rate', 'v': n_repeat_words * 1000 // greatest(n_words, 1)}}, {{'rate': 'length_rate', 'v': word_chars * 100 // greatest(n_words, 1)}}], recursive := true) FROM b),
s AS (SELECT lang, source, rate, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 64 + (v >> (length(bin(v)) - 6)) END AS bin, count(*) AS n FROM m WHERE NOT base_failed GROUP BY ALL),
h AS (SELECT 1 AS own, lang, source, rate, bin, n FROM s UNION ALL SELECT 0, lang, NULL, rate, bin, sum(n) FROM s GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY own, lang, source, rate ORDER BY bin) AS c, sum(n) OVER (PARTITION BY own, lang, source, rate) AS total FROM h),
q AS (SELECT own, lang, source, rate, max(total) AS total, min(bin) FILTER (100 * c >= 25 * total) AS b25, min(bin) FILTER (100 * c >= 75 * total) AS b75 FROM cum GROUP BY ALL),
v AS (SELECT own, lang, source, rate, total, CASE WHEN b25 < 64 THEN b25 ELSE (b25 - (b25 - 32) // 64 * 64) << ((b25 - 32) // 64) END AS q25, CASE WHEN b75 < 64 THEN b75 ELSE (b75 - (b75 - 32) // 64 * 64) << ((b75 - 32) // 64) END AS q75 FROM q),
f AS (SELECT v.*, least(q75 + multiple * (q75 - q25) + floor, ceiling) AS most FROM v JOIN (VALUES {_RATES}) AS x(rate, multiple, floor, ceiling) USING (rate)),
g AS (SELECT a.lang, a.source, a.rate, CASE WHEN a.total >= {quality_rules.MIN_GROUP} THEN a.most ELSE z.most END AS most FROM f a JOIN f z ON a.own = 1 AND z.own = 0 AND a.lang IS NOT DISTINCT FROM z.lang AND a.rate = z.rate),
bad AS (SELECT DISTINCT m.k FROM m JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source AND m.rate = g.rate AND m.v > g.most)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.k IS NULL AS kept FROM b LEFT JOIN bad ON b.k = bad.k
"""

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": _OP3}
