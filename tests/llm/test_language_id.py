"""Held-out accuracy, spans of mixed texts, Viterbi against brute force."""

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geodrift.llm import language_id as L


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    first = np.array([0, 5, 5, 6, 11])
    got = L.viterbi(scores, first, 1.5)
    for a, b in zip(first[:-1], first[1:]):
        def worth(path):
            return sum(scores[a + i, k] for i, k in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))
        best = max(map(worth, itertools.product(range(3), repeat=b - a)))
        assert abs(worth(got[a:b]) - best) < 1e-5


def test_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = L.learn(docs.where(~held))
    found = L.predict(docs.where(held).select("doc_id", "text", "lang"), model).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()
    long = {r.lang: r.text for r in docs.where("n_chars BETWEEN 2000 AND 4000 AND text NOT LIKE '%|%'").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(1, long["en"] + " " + long["es"])], "doc_id long, text string")
    spans = L.predict(mixed, model).first().lang_spans
    assert [s.lang for s in spans] == ["en", "es"]
    assert sum(s.words for s in spans) == len((long["en"] + " " + long["es"]).split())


def test_edges(spark):
    docs = spark.createDataFrame([("uno dos tres cuatro", "es"), ("one two three four", "en"), (None, "en"), ("раз два три", "ru"), ("x", None)], "text string, lang string")
    model = L.learn(docs)
    assert model.names == ["en", "es", "ru"]
    rows = [(0, None), (1, ""), (2, "123 ... 456"), (3, "два"), (4, "a " * 50000), (5, "日本"), (6, "٣٤٥"), (7, "ⵣ"), (8, "one"), (8, "one")]
    got = sorted(L.predict(spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, score string"), model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[3].lang_pred == "ru" and got[6].lang_pred == "und" and got[7].lang_pred != "und"
    assert len(got) == len(rows) and got[8] == got[9]
    none = L.learn(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs.select("text"), none).collect()} == {"und"}
    assert L.predict(docs.limit(0).select("text"), model).count() == 0


def plain_labels(scores, penalty):
    """Best labels of one text, word by word."""
    total, ways = list(scores[0]), []
    for own in scores[1:]:
        best = max(range(len(total)), key=lambda k: (total[k], -k))
        way = [best if total[best] - penalty > total[k] else k for k in range(len(total))]
        total = [(total[way[k]] - (penalty if way[k] != k else 0)) + own[k] for k in range(len(total))]
        ways.append(way)
    path = [max(range(len(total)), key=lambda k: (total[k], -k))]
    for way in reversed(ways):
        path.append(way[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("labels", [2, 5])
def test_viterbi_in_stretches(monkeypatch, labels):
    monkeypatch.setattr(L, "STRETCH", 4)
    rng = np.random.default_rng(8)
    lengths = [0, 1, 3, 4, 5, 8, 9, 40, 0, 133, 2]
    first = np.cumsum([0, *lengths])
    scores = rng.normal(size=(first[-1], labels)).astype(np.float32)
    got = L.viterbi(scores, first, 2.0)
    for a, b in zip(first, first[1:]):
        if b > a:
            assert got[a:b].tolist() == plain_labels(scores[a:b].astype(float).tolist(), 2.0)


def word_grams(text):
    """[(hashed trigrams, letters, script of the first letter)] of each word, byte by byte."""
    script = {}
    for name, lo, hi in L.SCRIPT_RANGES:
        script |= dict.fromkeys(range(lo, hi + 1), L.SCRIPTS.index(name))

    def script_of(c):
        p = ord(c)
        if p in (0xD7, 0xF7) or p < 0xC0 and p not in (0xAA, 0xB5, 0xBA) and not (c.isascii() and c.isalpha()):
            return None
        return script.get(p)

    raw = []
    for c in text:
        own = c.encode()
        raw += [0] if len(own) == 1 and not c.isalpha() else [ord(c.lower())] if len(own) == 1 else list(own)
    raw = [0, *raw, 0]
    out, at = [], 0
    for piece in re.split("([\x20\x09-\x0d]+)", text):
        size = len(piece.encode())
        if piece and piece[0] not in " \t\n\v\f\r":
            grams = [(((raw[k] * 65599 + raw[k + 1]) * 65599 + raw[k + 2]) * 0x9E3779B1 >> 16) % L.SLOTS for k in range(at, at + size) if raw[k + 1]]
            scripts = [x for x in map(script_of, piece) if x is not None]
            out.append((grams, len(scripts), scripts[0] if scripts else None))
        at += size
    return out


def test_query_by_plain_version(spark):
    from geodrift.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    counts, kinds = {}, {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.text is not None and r.lang is not None:
            own, shares = counts.setdefault(r.lang, [0.0] * L.SLOTS), kinds.setdefault(r.lang, {})
            for grams, letters, script in word_grams(r.text):
                for g in grams:
                    own[g] += 1
                if script is not None:
                    shares[script] = shares.get(script, 0) + letters
    names = sorted(counts)
    total = {k: sum(v) + 0.1 * L.SLOTS for k, v in counts.items()}
    got = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows[:120]:
        words = word_grams(r.text or "")
        scores = []
        for grams, _, _ in words:
            logs = [[math.log((counts[k][g] + 0.1) / total[k]) for k in names] for g in grams]
            scores.append([sum(x[j] - sum(x) / len(names) for x in logs) for j in range(len(names))])
        weight = [0] * len(names)
        for (_, letters, _), k in zip(words, plain_labels(scores, 8.0) if scores else []):
            weight[k] += letters
        letter = any(c.isalpha() for c in r.text or "")
        assert got[r.doc_id].lang_pred == (names[weight.index(max(weight))] if letter else "und"), r.doc_id
        assert abs(got[r.doc_id].score - (max(weight) / sum(weight) if letter and sum(weight) else 0)) < 0.02
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_letters_at_every_length(spark):
    model = L.learn(spark.createDataFrame([("uno dos", "es"), ("one two", "en")], "text string, lang string"))
    marks = ["\u0663", "\u066a", "\u0967", "\u0e51", "\u3041\u3099"[1:], "\u00d7", "7", "\u0300", "\u2028"]
    rows = [(i * 100 + n, c * n, any(x.isalpha() for x in c)) for i, c in enumerate(marks) for n in (1, 15, 16, 17, 400)]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string, letter boolean"), model).collect()}
    assert all((got[i].lang_pred != "und") == letter and (letter or got[i].score == 0) for i, _, letter in rows)


def test_too_many_languages_raise(spark):
    docs = spark.createDataFrame([("word", f"l{k}") for k in range(5)], "text string, lang string")
    assert len(L.learn(docs, max_languages=5).names) == 5
    with pytest.raises(ValueError):
        L.learn(docs, max_languages=4)
