"""Held-out quality of the ordinal model, its gradient-free checks and edge cases."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geodrift.llm import quality_model as Q

ODD = [None, "", "   ", "x" * 100000, "word " * 30000, "été ### | 9", "été ### | 9"]


def test_features_are_distinct_and_filter():
    column = pa.array([t for t in ODD] + ["Stupid stupidly STUPID"])
    doc, slots = Q.features(column)
    assert len(set(zip(doc.tolist(), slots.tolist()))) == len(doc)
    wanted = np.zeros(Q.SLOTS, bool)
    wanted[slots[::3]] = True
    few = Q.features(column, wanted)
    keep = wanted[slots]
    assert few[0].tolist() == doc[keep].tolist() and few[1].tolist() == slots[keep].tolist()


def test_fit_orders_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    rows = [np.unique(np.concatenate([rng.integers(100, 400, 20), [1] * int(g < 2), [2] * int(g < 1)])).astype(np.int32) for g in grades]
    model = Q.fit(rows, grades, n_grades=3)
    assert np.all(np.diff(model.thresholds) >= 0)
    score = np.array([model.weights[r].sum() for r in rows])
    expected = model.tails(score).sum(1)
    assert expected[grades == 0].mean() < expected[grades == 1].mean() < expected[grades == 2].mean()


def test_held_out_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    ratings = labels.select("doc_id", Q.grade_of().alias("grade"))
    model = Q.train(docs, ratings.where("doc_id % 4 != 1"))
    held = Q.score(docs, model).join(ratings.where("doc_id % 4 = 1"), "doc_id").select("grade", "kept").toPandas()
    assert held.kept[held.grade == 2].mean() > 0.98
    assert held.kept[held.grade < 2].mean() < 0.15
    odd = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(ODD)], "doc_id long, text string, kept double")
    rows = sorted(Q.score(odd, model).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(ODD) and rows[0].tail_prob == rows[1].tail_prob and rows[5].tail_prob == rows[6].tail_prob
    assert Q.score(odd.limit(0), model).count() == 0
    empty = Q.train(docs.limit(0), ratings.limit(0))
    assert all(r.kept for r in Q.score(odd, empty, threshold=0.5).collect())


def test_one_sided_or_no_ratings(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    for grades, most_likely_kept in (([], False), ([0] * 30, False), ([2] * 30, True)):
        ratings = spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int")
        with pytest.warns(UserWarning, match="one side"):
            model = Q.train(docs, ratings)
        rows = Q.score(docs, model).collect()
        want = (sum(g >= 2 for g in grades) + 1) / (len(grades) + 2)
        assert all(abs(r.tail_prob - want) < 1e-6 and r.kept == most_likely_kept for r in rows)


def test_fit_counts_in_parts(monkeypatch):
    """Features are counted by parts of the rows: the model stays the same, and the driver needs little beside them."""
    r = np.random.default_rng(1)
    grades = r.integers(0, 3, 1500)
    rows = [np.unique(np.concatenate([r.integers(0, Q.SLOTS, 1000), r.integers(0, 3000, 100) * (g + 1)]) % Q.SLOTS).astype("<i4") for g in grades]
    models = []
    for n in (len(rows), 100):
        monkeypatch.setattr(Q, "FIT_ROWS", n, raising=False)
        tracemalloc.start()
        models.append(Q.fit(rows, grades, n_grades=3, steps=3))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert (models[0].weights != 0).any() and np.array_equal(models[0].weights, models[1].weights) and np.array_equal(models[0].thresholds, models[1].thresholds)
    assert peak < 16 * 8 * Q.SLOTS  # some arrays over all slots; those over all features took 52 MB


def test_fit_leaves_the_driver_alone(spark, monkeypatch):
    """The rated rows' features stay off the driver, whose model is that of a fit on them, to the bit."""
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 400, 60)) + (" bad" if k % 3 else " good") for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    ratings = spark.createDataFrame([(k, 0 if k % 3 else 2) for k in range(300)], "doc_id long, grade int")
    order = [x.k for x in docs.selectExpr("doc_id AS k").orderBy(F.xxhash64("k"), "k").collect()]
    doc, slots = Q.features(pa.array([texts[k] for k in order]))
    want = Q.fit(np.split(slots.astype("<i4"), np.searchsorted(doc, np.arange(1, 300))), np.array([0 if k % 3 else 2 for k in order]), n_grades=3)

    real, driver = Q.fit, os.getpid()

    def fit(*args, **kw):
        assert os.getpid() != driver, "the driver fits"
        return real(*args, **kw)

    monkeypatch.setattr(Q, "fit", fit)
    got = Q.train(docs, ratings)
    assert (want.weights != 0).any() and np.array_equal(got.weights, want.weights) and np.array_equal(got.thresholds, want.thresholds)
