"""run() against a plain version of each stage's decision."""

import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from geodrift.llm import bpe, decontaminate, pii, quality_model

from .test_ngram_join import shingle_set
from .test_pii import brute as pii_spans

DIR = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ratings = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", quality_model.grade_of().alias("grade"))
    model = quality_model.train(docs, ratings)
    rows = {}
    for r in docs.orderBy("doc_id").collect():
        _, slots = quality_model.features(pa.array([r.text]))
        if model.tails(np.array([model.weights[slots].sum(dtype=np.float64)]))[0, -1] >= 0.75:
            rows[r.doc_id] = r.text
    sets = {i: shingle_set(t) for i, t in rows.items()}
    root = {i: i for i in rows}
    for i in rows:
        for j in rows:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    rows = {i: t for i, t in rows.items() if root[i] == i}
    def words(text):
        return ["".join(c for c in w) for w in "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in text.lower()).split()]
    items = [" " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(x in " " + " ".join(words(t)) + " " for x in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert set(got) == set(rows)
    codec = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for i, r in got.items():
        ids = np.frombuffer(r.token_ids, "<u4")
        text = codec.decode(ids.tolist())
        assert r.n_tokens == len(ids) and hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256
        assert not pii_spans(text)
        if not pii_spans(rows[i]) and not any(c.isdigit() for c in rows[i]):
            assert text == rows[i]


def test_stages_on_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f mail x@y.zz", None, "s", 22), (2, "a b c d e f mail x@y.zz", None, "s", 22), (3, "A b c d e f mail x@y.zz", "en", None, 22), (4, "w " * 60000, "en", "s", 120000)]
    docs = spark.createDataFrame(rows, kinds)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], kinds).schema], name
        none = stage(spark, spark.createDataFrame([], kinds), DIR)
        assert none.count() == 0
    kept = [r.doc_id for r in docs.collect()]
    assert len(kept) == len(set(kept)) and 3 not in kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == len(kept)
    assert docs.where(F.col("text").contains("@")).count() == 0


def test_one_id_on_two_texts_and_odd_columns(spark):
    """Documents are told apart by id and text; of equal rows the least by all columns stays."""
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(3, one, "en", 1), (7, one + " end", "en", 2), (7, two, "fr", 3), (9, two + " end", "en", 4), (7, two, "de", 3), (None, one, "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `_key.x` int").withColumn("_key", F.lit(1))
    got = sorted((r.doc_id or 0, r.text, r.lang) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, DIR).collect())
    assert got == [(0, one, "en"), (3, one, "en"), (7, two, "de")]


def test_n_chars_follows_redaction(spark):
    docs = spark.createDataFrame([(1, "write to a@b.cd now", 99, 1), (2, "nothing here", 99, 2), (3, None, None, 3)], "doc_id long, text string, n_chars long, _spans int")
    got = sorted(tuple(r) for r in corpus_pipeline.redaction(spark, docs, DIR).collect())
    assert got == [(1, "write to [EMAIL] now", 20, 1), (2, "nothing here", 99, 2), (3, None, None, 3)]
