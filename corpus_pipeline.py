"""Corpus pipeline over ``documents``: classify, deduplicate, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of ``documents``.  Rows with a null
text pass the first four stages if the classifier keeps them, and encode to no
tokens; rows with a null id are never duplicates of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geodrift.llm import bpe, decontaminate, ngram_join, pii, quality_model
from geodrift.llm.graph import settled
from geodrift.llm.names import unused

#: Ids of documents to drop that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000


def columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the top grade reaches the operator's threshold.

    Rows are judged one by one, so repeated rows and ties fare alike; an empty table stays empty; texts are judged whole.
    """
    kept = unused("kept", docs.columns)
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", quality_model.grade_of().alias("grade"))
    scored = quality_model.score(docs, quality_model.train(docs, ratings), kept=kept, expected=unused("expected", docs.columns), tail=unused("tail", docs.columns))
    return scored.where(kept).select(*columns(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the least by id, then by hash of the text.

    Rows with one id and different texts are documents of their own.  Of rows
    with equal id and text the least by all columns stays; rows with a null id and
    texts without words stay.  An empty table stays empty.
    """
    key, place = unused("key", docs.columns), unused("place", docs.columns)
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))))
    groups = ngram_join.near_duplicates(keyed, id_column=key).where(F.col(key).isNotNull())
    dropped = groups.where(F.col("component_id") != F.col(key)).select(key).distinct()
    kept = keyed.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, key, "left_anti")
    again = groups.where(F.col("component_id") == F.col(key)).groupBy(key).count().where("count > 1").select(key)
    if not again.isEmpty():
        order = Window.partitionBy(key).orderBy(*columns(docs))
        least = keyed.join(again, key, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
        kept = kept.join(again, key, "left_anti").unionByName(least)
    return kept.select(*columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows are judged one by one, texts whole, an empty table stays empty."""
    leaks = unused("leaks", docs.columns)
    index = decontaminate.build_index(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.find_leaks(docs, index, leaks=leaks).where(F.size(leaks) == 0).select(*columns(docs))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars follows a text that changes.

    Rows are redacted one by one, so repeated rows stay alike; an empty table stays empty.
    """
    spans, text = unused("spans", docs.columns), unused("text", docs.columns)
    found = pii.find(docs, pii.train(spark), spans=spans).withColumn(text, pii.redacted(F.col("text"), F.col(spans)))
    changed = {"text": F.col(text), "n_chars": F.when(F.size(spans) > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))}
    out = found.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
    pii.forget_parses(spark)
    return out


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (packed unsigned 32-bit, little-endian), and digests of them and of what they decode to."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs.select("doc_id", "text"), ranks, pattern, decoded="decoded").select(
        "doc_id", bpe.n_ids("token_ids").alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("pii", redaction),
    ("byte_bpe", byte_bpe),
]

#: The trained stages and the tokenizer have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each kept result is cut from its lineage before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
