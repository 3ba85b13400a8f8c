"""Edit distance against the plain table, recall on planted windows, no false leaks."""

import random
import re

import numpy as np
import pyarrow as pa

from geodrift.llm import decontaminate as D
from geodrift.llm.kernel import buffers


def plain(item, text):
    row = list(range(len(text) + 1))
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distance():
    r = random.Random(4)
    for _ in range(600):
        item = [r.randrange(5) for _ in range(r.randint(1, 12))]
        text = [r.randrange(5) for _ in range(r.randint(0, 15))]
        most = r.randint(0, 6)
        want = plain(item, text)
        got = D.edit_distance(np.array(item, np.uint64), np.array(text, np.uint64), most)
        assert got == (want if want <= most else most + 1), (item, text, most)


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        k = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0:
            words[k] = f"new{r.randrange(99)}"
        elif kind == 1 and len(words) > 1:
            del words[k]
        else:
            words.insert(k, f"new{r.randrange(99)}")
    return words


def test_recall_and_precision(spark):
    r = random.Random(6)
    vocabulary = ["the", "of", "and"] * 20 + [f"w{k}" for k in range(500)]
    items = [(i, " ".join(r.choices(vocabulary, k=n))) for i, n in enumerate([2, 4, 8, 12] + [r.randint(15, 60) for _ in range(60)])]
    index = D.build_index(spark.createDataFrame([*items, (900, None), (901, "..."), items[5]], "item_id long, text string"))
    assert len(index.ids) == 64
    rows, planted = [], set()
    for i in range(600):
        words = r.choices(vocabulary, k=r.randint(5, 150))
        if i % 2:
            item, text = r.choice(items)
            own = text.split()
            at = r.randrange(len(words))
            words[at:at] = [w.upper() + "!!" if i % 3 == 0 else w for w in edited(r, own, r.randint(0, len(own) // 10))]
            planted.add((i, item))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (700, None), (701, ""), (702, "w1 " * 50000)], "doc_id long, text string").repartition(4)
    got = {(x.doc_id, l.item): l.edits for x in D.find_leaks(docs, index).collect() for l in x.leaks}
    true, texts = {}, dict(rows)
    for i, text in rows:
        words = text.lower().replace("!!", "").split()
        for item, t in items[3:]:
            own = t.split()
            most = len(own) // 10
            if (i, item) in planted or (i, item) in got:
                best = min(plain(own, words[s : s + len(own) + most]) for s in range(len(words)))
                if best <= most:
                    true[i, item] = best
    long = {k: v for k, v in got.items() if k[1] >= 3}
    assert all(true.get(k) == v for k, v in long.items()) and len(texts) == 600
    missed = set(true) - set(long)
    assert len(missed) <= 0.03 * len(true), (len(missed), len(true))
    assert all((i, item) in got for i, item in planted if item < 3)  # too short for an edit
    assert D.find_leaks(docs.limit(0), index).count() == 0
    none = D.build_index(spark.createDataFrame([], "item_id long, text string"))
    assert all(r.leaks == [] for r in D.find_leaks(docs, none).collect())


def test_documents(spark):
    from geodrift.llm.queries import QUERIES

    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, "/root/testdata/sf0.01").collect()}
    read = spark.read.parquet
    item_words = {r.item_id: D.normal_words(*buffers(pa.array([r.text])))[0].tobytes() for r in read("/root/testdata/sf0.01/benchmark.parquet").collect()}
    whole = set()
    for r in read("/root/testdata/sf0.01/documents.parquet").collect():
        words = D.normal_words(*buffers(pa.array([r.text])))[0].tobytes()
        for item, own in item_words.items():
            at = words.find(own)
            while at >= 0 and at % 8:
                at = words.find(own, at + 1)
            if at >= 0:
                whole.add((r.doc_id, item))
    assert whole and whole <= got and len(got) <= len(whole) + 3


def plain_words(text):
    """Words by Unicode lower case, written without the operator's own code."""
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def test_capitals_beyond_ascii(spark):
    items = [
        (1, "la estaci\u00f3n se\u00f1ala que el ni\u00f1o comi\u00f3 despu\u00e9s del caf\u00e9 aqu\u00ed"),
        (2, "l'\u00e9t\u00e9 dernier, \u00e0 l'\u00e9cole, les \u00e9l\u00e8ves \u00e9taient tr\u00e8s f\u00e2ch\u00e9s"),
        (3, "die \u00e4rzte w\u00fcnschen sch\u00f6ne gr\u00fc\u00dfe f\u00fcr \u00fcbermorgen"),
        (4, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 \u0438 \u03ba\u03b1\u03bb\u03b7\u03bc\u03ad\u03c1\u03b1 \u03ba\u03cc\u03c3\u03bc\u03bf\u03c2"),
    ]
    capitals = {i: "".join(c if c == "\u00df" else c.upper() for c in t) for i, t in items}
    index = D.build_index(spark.createDataFrame(items, "item_id long, text string"))
    docs = spark.createDataFrame([(i, f"Before it. {t} AFTER") for i, t in capitals.items()], "doc_id long, text string")
    got = {(r.doc_id, l.item, l.edits, l.first_word, l.n_words) for r in D.find_leaks(docs, index).collect() for l in r.leaks}
    assert got == {(i, i, 0, 2, len(plain_words(t))) for i, t in items}


def test_normal_words():
    texts = ["", "Plain ASCII, only", "\u00c9T\u00c9 \u00e9t\u00e9", "\u0130 x \u039f\u0394\u039f\u03a3", "CIÓN-ción", "a"]
    hashes, first = D.normal_words(*buffers(pa.array(texts)))
    want = [w for t in texts for w in plain_words(t)]
    alone = [D.normal_words(*buffers(pa.array([w])))[0][0] for w in want]
    assert first.tolist() == np.cumsum([0] + [len(plain_words(t)) for t in texts]).tolist() and hashes.tolist() == [int(h) for h in alone]
    raw = np.frombuffer(b"A\xff\xc9 B", np.uint8)  # no UTF-8
    assert len(D.normal_words(raw, np.array([0, len(raw)]))[0]) == 2


def test_documents_by_plain_words(spark):
    from geodrift.llm.queries import QUERIES

    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, "/root/testdata/sf0.1").where("edits = 0").collect()}
    read = spark.read.parquet
    items = {r.item_id: " " + " ".join(plain_words(r.text)) + " " for r in read("/root/testdata/sf0.1/benchmark.parquet").collect()}
    whole = set()
    for r in read("/root/testdata/sf0.1/documents.parquet").collect():
        words = " " + " ".join(plain_words(r.text)) + " "
        whole |= {(r.doc_id, i) for i, own in items.items() if len(own) > 2 and own in words}
    assert whole == got


def test_recall_wherever_edits_are(spark):
    """At the largest allowed distance, held against the plain table for every document: spread and clustered edits, cut ends."""
    r = random.Random(11)
    items = [(i, [f"w{r.randrange(3000)}" for _ in range(n)]) for i, n in enumerate([*range(10, 21), 25, 30, 40, 99, 200, 400, 1000])]
    index = D.build_index(spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    rows, want = [], {}
    for i, w in items:
        most = len(w) // 10
        tries = [w[most:], w[:-most], [f"x{k}" for k in range(most)] + w[most:], w]
        for start in {1, 2, 3, 5, len(w) // 2, len(w) - most - 1}:
            tries.append(w[:start] + [f"x{k}" for k in range(most)] + w[start + most :])
            tries.append(w[:start] + [f"x{k}" for k in range(most)] + w[start:])
        step = len(w) / most
        tries.append([f"x{k}" if any(k == int((e + 0.5) * step) for e in range(most)) else x for k, x in enumerate(w)])
        for _ in range(20):
            tries.append(edited(r, w, most))
        for copy in tries:
            text = [f"y{k}" for k in range(r.randrange(5))] + copy + [f"z{k}" for k in range(r.randrange(5))]
            exact = [plain(w, text[s : s + len(w) + most]) for s in range(max(1, len(text) - len(w) + most + 1))] if len(w) < 100 else None
            want[len(rows)] = (i, most if exact is None else min(exact), None if exact is None else exact.index(min(exact)))
            rows.append((len(rows), " ".join(text)))
        past = w[: len(w) // 2] + [f"x{k}" for k in range(most + 1)] + w[len(w) // 2 + most + 1 :]
        rows.append((len(rows), " ".join(past)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: [(l.item, l.edits, l.first_word) for l in x.leaks] for x in D.find_leaks(docs, index).collect()}
    found = {}
    for doc, _ in rows:
        if doc not in want:
            assert got[doc] == [], doc
            continue
        item, edits, first = want[doc]
        found.setdefault(item, []).append(bool(got[doc]))
        for i, e, f in got[doc]:
            assert i == item and (e <= edits if first is None else (e, f) == (edits, first)), (doc, got[doc], want[doc])
    assert all(sum(x) >= 0.9 * len(x) for x in found.values()), {len(items[i][1]): sum(x) / len(x) for i, x in found.items()}
    assert sum(sum(x) for x in found.values()) >= 0.97 * sum(map(len, found.values()))


def test_best_place():
    r = random.Random(5)
    for _ in range(500):
        item = [r.randrange(4) for _ in range(r.randint(1, 12))]
        text = [r.randrange(4) for _ in range(r.randint(0, 25))]
        most, last = r.randint(0, 6), r.randint(0, 12)
        want = min((plain(item, text[s:]), s) for s in range(min(last, len(text)) + 1))
        got = D.best_place(np.array(item, np.uint64), np.array(text, np.uint64), last, most)
        assert got == (want if want[0] <= most else (most + 1, 0)), (item, text, last, most)


def test_long_items_are_whole(spark):
    r = random.Random(9)
    w = [f"w{r.randrange(9000)}" for _ in range(5000)]
    index = D.build_index(spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"))
    texts = [w[:4096], w[:4600], w[:4400], w[:4096] + ["x"] * 300 + w[4396:], w]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: [tuple(l) for l in x.leaks] for x in D.find_leaks(docs, index).collect()}
    assert got == {0: [], 1: [(1, 400, 0, 5000)], 2: [], 3: [(1, 300, 0, 5000)], 4: [(1, 0, 0, 5000)]}
