"""Line-first cleaning: rules per line, then a verdict on what is left of the document.

Line rules (a line without a word is neither kept nor failed):

* ``punctuation``: marks of ``SYMBOLS`` exceed one in ten characters of the line,
  or the line ends in no sentence mark and has fewer than four words;
* ``navigation``: three or more ``|`` or ``»`` separators, or at least half of
  its words stand between such separators;
* ``boilerplate``: it holds one of ``PHRASES`` (compared in lower case).

A document is kept if it passes the base rules and the failed lines hold at most
``most_lost`` of its word characters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernel import SPACE, Prefix, buffers, windows, with_columns, word_bounds

SYMBOLS = b"#*$%&|<>"
#: Fixed phrases of page furniture in English, Spanish, French and German, lower case.
PHRASES = (
    "accept all cookies", "all rights reserved", "click here to", "cookie policy", "enable javascript", "javascript is disabled", "log in to", "lorem ipsum",
    "privacy policy", "sign up for our newsletter", "skip to content", "subscribe to our newsletter", "terms of service", "terms of use", "use of cookies",
    "aceptar todas las cookies", "condiciones de uso", "política de cookies", "política de privacidad", "suscríbete a nuestro boletín", "todos los derechos reservados",
    "accepter tous les cookies", "conditions d'utilisation", "politique de confidentialité", "politique de cookies", "abonnez-vous à notre newsletter", "tous droits réservés",
    "alle cookies akzeptieren", "nutzungsbedingungen", "cookie-richtlinie", "datenschutzerklärung", "newsletter abonnieren", "alle rechte vorbehalten",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SYMBOL_CHARS = re.compile(f"[{re.escape(SYMBOLS.decode())}]")
_WORD = re.compile("[^\x20\x09-\x0d]+")
_SEPARATOR = re.compile("[|»]")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))
_SENTENCE_END = tuple(".!?…:;,\"'”’»)。！？；：")


def line_failure(line: str, words: int) -> str | None:
    """The first rule that a line with ``words`` words fails, or None."""
    separators = len(_SEPARATOR.findall(line)) if "|" in line or "»" in line else 0
    if separators >= 3 or separators and 2 * separators >= words:
        return "navigation"
    if _PHRASE.search(line.lower()):
        return "boilerplate"
    if 10 * len(_SYMBOL_CHARS.findall(line)) > len(line.strip()):
        return "punctuation"
    if words < 4 and not line.rstrip().endswith(_SENTENCE_END):
        return "punctuation"
    return None


def clean_lines(text: str) -> tuple[str, int, int, int]:
    """(text of the lines that pass, word characters of lines that failed, failed lines, repeated lines)."""
    kept, lost, failed, repeated, seen = [], 0, 0, 0, set()
    for line in text.split("\n"):
        words = line.split() if line.isascii() and not _ODD.search(line) else _WORD.findall(line)
        if not words:
            kept.append(line)
            continue
        if line in seen:
            repeated += 1
        else:
            seen.add(line)
        if line_failure(line, len(words)):
            lost += sum(map(len, words))
            failed += 1
        else:
            kept.append(line)
    return "\n".join(kept), lost, failed, repeated


#: ASCII that str.split takes as white space and the word pattern does not.
_ODD = re.compile("[\x1c-\x1f]")


def clean(docs: DataFrame, *, text: str = "text", most_lost: float = 0.5, output: str = "clean_text") -> DataFrame:
    """``docs`` plus word counts, base and final verdicts and the cleaned text.

    New columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_failed_lines, lost_chars (long), base_failed, kept (boolean), ``output``
    (string).  Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has no
    words, so ``base_failed`` holds, and cleans to an empty text.  Rows do not
    depend on each other, so repeated rows get equal verdicts; columns of docs
    with a new column's name are replaced.
    """

    def work(column: pa.Array) -> dict[str, object]:
        data, offsets = buffers(column)
        n = len(offsets) - 1
        starts, ends, first = word_bounds(data, offsets)
        n_words = np.diff(first)

        def per_doc(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

        word_chars = per_doc(~SPACE[data] & ((data & 0xC0) != 0x80))
        n_symbols = per_doc(_SYMBOL[data])
        hashes = Prefix(data).hash(starts, ends)
        n_repeat = np.zeros(n, np.int64)
        for i in np.flatnonzero(n_words >= 6):
            grams = windows(hashes[first[i] : first[i + 1]], 5)
            order = np.argsort(grams, kind="stable")
            same = grams[order][1:] == grams[order][:-1]
            if same.any():
                again = np.zeros(len(grams), bool)
                again[order[1:][same]] = again[order[:-1][same]] = True
                edge = np.zeros(len(grams) + 5, np.int64)
                edge[:-5] += again
                edge[5:] -= again
                n_repeat[i] = np.count_nonzero(np.cumsum(edge)[:-1])
        cleaned = [clean_lines(value or "") for value in column.to_pylist()]
        lost = np.array([x[1] for x in cleaned], np.int64)
        base_failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
        return {
            "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": [x[3] for x in cleaned], "n_repeat_words": n_repeat,
            "n_failed_lines": [x[2] for x in cleaned], "lost_chars": lost, "base_failed": base_failed, "kept": ~base_failed & (lost <= most_lost * word_chars), output: [x[0] for x in cleaned],
        }

    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars"]
    fields = [T.StructField(c, T.LongType()) for c in longs] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")] + [T.StructField(output, T.StringType())]
    return with_columns(docs, [text], fields, lambda: work)
