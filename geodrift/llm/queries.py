"""One query per operator of this package, over whole tables, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, license_scan, ngram_join, pii, quality_model, quality_rules, sharding, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return sharded.select(
        "doc_id", sharding.size_of("text").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = table(spark, sf_dir, "labels").select("doc_id", quality_model.grade_of().alias("grade"))
    return quality_model.score(docs, quality_model.train(docs, ratings)).select("doc_id", "expected_grade", "tail_prob", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = quality_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "benchmark"))
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), index)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", F.col("leak.item").alias("item_id"), F.col("leak.edits").alias("edits"), F.col("leak.first_word").alias("first_word"), F.col("leak.n_words").alias("n_words"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, ranks, pattern, decoded="decoded").select(
        "doc_id", bpe.n_ids("token_ids").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(spark))
    base = F.filter("pii_spans", lambda x: x["base"])
    counts = [F.size(F.filter("pii_spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("pii_spans")).alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("license_sentences", ",").alias("sentences"), (F.size("licenses") > 0).alias("licensed"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = language_id.learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_pii": op7_pii,
    "op8_token_counts": op8_token_counts,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
}

OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS class_id, len(s) AS n FROM sets)
SELECT s.doc_id, s.n AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = s.doc_id) AS component_id, CASE WHEN s.n = 0 THEN s.doc_id ELSE s.class_id END AS class_id
FROM same s
"""

_WORD = r"'[^\x20\x09-\x0D]+'"
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_FURNITURE = "|".join(x.replace("'", "''") for x in quality_rules.PHRASES)

OP4_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, {_WORD}) AS w, string_split(text, chr(10)) AS l FROM texts),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS place FROM split),
counted AS (
  SELECT doc_id, line, place, regexp_extract_all(line, {_WORD}) AS w, len(regexp_extract_all(line, '[|»]')) AS s,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS m, length(regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS n FROM lines
), judged AS (
  SELECT doc_id, line, place, len(w) AS words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars,
    len(w) > 0 AND (s >= 3 OR (s > 0 AND 2 * s >= len(w)) OR regexp_matches(lower(line), '{_FURNITURE}') OR 10 * m > n
      OR (len(w) < 4 AND NOT regexp_matches(line, '[.!?…:;,"''”’»)。！？；：]{_BLANK}*$'))) AS failed FROM counted
), verdicts AS (
  SELECT doc_id, count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines,
    coalesce(sum(chars) FILTER (failed), 0) AS lost_chars, sum(chars) AS word_chars, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT failed), '') AS clean FROM judged GROUP BY doc_id
), base AS (
  SELECT s.doc_id, len(s.w) AS n_words, v.word_chars, len(regexp_extract_all(s.text, '[#*$%&|<>]')) AS n_symbols, v.n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    v.n_failed_lines, v.lost_chars, sha256(v.clean) AS clean_sha256 FROM split s JOIN verdicts v USING (doc_id) LEFT JOIN repeats r USING (doc_id)
)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost_chars <= word_chars AS kept, n_failed_lines, lost_chars::BIGINT AS lost_chars, clean_sha256
FROM base
"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op4_quality_rules": OP4_SQL}
