"""Components against brute force, on planted families with small tiles, and odd rows."""

import random
import re

import numpy as np
import pytest

from geodrift.llm import ngram_join as N
from geodrift.llm import graph, shingles
from geodrift.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=75):
    """(id, size, component) of rows with distinct ids, by all pairs of word sets."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed=5, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = r.choices(vocabulary, k=30)
    rows, base = [], r.choices(vocabulary, k=60)
    for i in range(n):
        kind = i % 5
        words = r.choices(vocabulary, k=r.randint(1, 90))
        if kind < 2:  # near copies of one text, at all distances around the limit
            words = list(base[: r.randint(45, 60)])
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        elif kind == 2:  # a common passage inside other words
            words = words[: r.randint(0, 20)] + passage
        elif kind == 3 and rows:
            words = (r.choice(rows)[1] or "x").split()
            if r.random() < 0.5:
                words = words + r.choices(vocabulary, k=r.randint(0, 5))
        rows.append((i, " ".join(words).title() if i % 7 == 0 else " ".join(words)))
    return rows


ODD = [(1000, None), (1001, ""), (1002, "  \n"), (1003, "One two"), (1004, "one TWO"), (1005, "a b c d e"), (1006, "a b c d e"), (1007, "long " * 30000), (1008, "Été là"), (1009, "été là")]


@pytest.mark.parametrize("small", [False, True])
def test_components(spark, monkeypatch, small):
    if small:  # many tiles and pieces, and texts shuffled to ids
        for name, value in {"TILE_ROWS": 4, "BROADCAST_IDS": 0, "LARGE_GROUP": 3, "PIECE_ROWS": 20, "HEAD_ROWS": 2, "SAMPLE_ONE_IN": 2, "COUNT_HELD": 100, "FREQUENT": 40}.items():
            monkeypatch.setattr(N, name, value)
    rows = corpus() + ODD
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in rows], "doc_id long, text string, n string, rep int").repartition(5)
    got = N.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    classes = {}
    for i, t in rows:
        classes.setdefault(frozenset(shingle_set(t)) or i, []).append(i)
    assert {r.doc_id: r.class_id for r in got} == {i: min(v) for v in classes.values() for i in v}


@pytest.mark.parametrize("percent", [40, 90])
def test_other_percents(spark, monkeypatch, percent):
    monkeypatch.setattr(N, "LARGE_GROUP", 4)
    nested = " ".join(f"n{k}" for k in range(134))
    rows = corpus(n=150) + [(2000, nested), (2001, " ".join(nested.split()[:64]))]  # 130 and 60 shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(docs, percent=percent).collect()}
    assert got == set(brute(rows, percent)) and ((2001, 60, 2000) in got) == (percent == 40)
    with pytest.raises(ValueError):
        N.near_duplicates(docs, percent=0)


def test_few_rows_of_an_element_in_pieces(spark, monkeypatch):
    """An element in so many texts that it is dealt, but in few prefixes: its small pieces still meet each other."""
    monkeypatch.setattr(N, "PIECE_ROWS", 20)
    monkeypatch.setattr(N, "SAMPLE_ONE_IN", 1)
    passage = " ".join(f"c{k}" for k in range(8))
    rows = [(0, passage)] + [(i, f"{passage} end{i}") for i in range(1, 9)]
    rows += [(i, f"{passage} " + " ".join(f"t{i}x{k}" for k in range(30))) for i in range(100, 220)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.component_id == 0 for r in got if r.doc_id < 9)


def test_one_id_on_two_texts(spark):
    """Rows of one id with different texts are nodes of their own, each linked by its own text."""
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(3, one), (7, one + " end"), (7, two), (9, two + " end"), (7, two)]
    got = sorted((r.doc_id, r.class_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, 3), (7, 7, 3), (7, 7, 7), (7, 7, 7), (9, 9, 7)]


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in N.near_duplicates(docs).collect())
    assert got == [(0, 2, 0), (2, 2, 2), (2, 2, 2), (5, 2, 2)]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_bound_is_above_overlap():
    rng = np.random.default_rng(2)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 350))) for _ in range(2))
        assert shingles.overlap_bound(shingles.bitmap(a), len(a), shingles.bitmap(b), len(b)) >= len(np.intersect1d(a, b)) == shingles.intersection(a, b)


@pytest.mark.parametrize("most", [0, 20, 10**6])
def test_graph(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(500 + i, 500 + r.randrange(40)) for i in range(40)] + [(9, 9), (7, 6)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301))
    parent = {i: {i} for i in range(500, 540)}
    for a, b in edges:
        if a >= 500:
            both = parent[a] | parent[b]
            for x in both:
                parent[x] = both
    assert all(got.get(i, i) == min(parent[i]) for i in parent)
