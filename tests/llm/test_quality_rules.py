"""Base counts and verdicts against a plain per-document version."""

import re
from collections import Counter

from geodrift.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")
PROSE = "The station moved north by two millimetres over the year, as expected. "
TEXTS = [
    None, "", "   \n\t", "one two", PROSE * 1, PROSE * 6, "a b c d e a b c d e x", "same line here.\nsame line here.\n\nother", "Home | News | About | Contact | Help\n" + PROSE,
    "x### y*** z%%% " * 30, "été là ñ 日本 \x1c\x1d x y z w v u", "All rights reserved by the owners of this page.\n" * 9 + PROSE, "w " * 20000, "\r\n".join([PROSE] * 3), PROSE + "\n" + PROSE.upper() + "\nA B\n1 | 2",
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, marked = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            marked |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    lost = sum(len("".join(WORD.findall(x))) for x in lines if Q.line_failure(x, len(WORD.findall(x))))
    chars = sum(map(len, words))
    return (len(words), chars, len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed, not failed and lost <= 0.5 * chars)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate([*TEXTS, TEXTS[5]])], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in Q.clean(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, text in enumerate([*TEXTS, TEXTS[5]]):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(text), text
    assert not got[8].clean_text.startswith("Home") and got[4].kept and not got[11].kept
    assert Q.clean(docs.limit(0)).count() == 0


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in Q.clean(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(r.text)


def test_query_by_sql(spark):
    """All columns against DuckDB over whole texts."""
    import duckdb

    from geodrift.llm.queries import ORACLES, QUERIES

    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = db.sql(ORACLES["op4_quality_rules"])
    got = QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.001")
    assert got.columns == found.columns and sorted(tuple(r) for r in got.collect()) == sorted(found.fetchall())
