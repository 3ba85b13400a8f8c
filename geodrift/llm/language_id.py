"""Language identification: script ranges, then Viterbi over per-word scores.

Each word gets one score per language, the mean log-probability ratio of its byte
trigrams (bounds included) under counts learned per language.  The script of a
word's letters narrows the languages that may label it.  Viterbi with a penalty
for each switch labels the words, so a text of several languages falls into
spans; the document's language is the one with most letters under its label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import LOWER, SPACE, buffers, slices, with_columns, word_bounds

#: Hashed trigram slots; a model holds at most this many counts per language.
SLOTS = 1 << 15
#: Languages that a model may hold unless told otherwise, more are an error; with SLOTS it bounds what is collected and broadcast.
MAX_LANGUAGES = 64
UNKNOWN = "und"

#: Scripts by first and last code point: fixed ranges of Unicode blocks with letters.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
)
SCRIPTS = tuple(dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))
_RANGE_FROM = np.array([x[1] for x in SCRIPT_RANGES])
_RANGE_TO = np.array([x[2] for x in SCRIPT_RANGES])
_RANGE_SCRIPT = np.array([SCRIPTS.index(x[0]) for x in SCRIPT_RANGES])


def byte_scripts(data: np.ndarray) -> np.ndarray:
    """Script number at the first byte of each character in a known script, else -1."""
    out = np.full(len(data), -1, np.int8)
    out[((data | 0x20) >= 97) & ((data | 0x20) <= 122)] = 0
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        b0, b1, b2, b3 = (wide[lead + k] for k in range(4))
        point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F))
        at = np.searchsorted(_RANGE_FROM, point, "right") - 1
        fits = (at >= 0) & (point <= _RANGE_TO[at]) & (point != 0xD7) & (point != 0xF7) & ~((point >= 0x80) & (point < 0xC0) & (point != 0xAA) & (point != 0xB5) & (point != 0xBA))
        out[lead[fits]] = _RANGE_SCRIPT[at[fits]]
    return out


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


class Words:
    """Words of a slice of texts with their scripts and trigram slots."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = word_bounds(data, offsets)
        scripts = byte_scripts(data)
        self.has_script = scripts >= 0
        sums = np.concatenate([[0], np.cumsum(self.has_script, dtype=np.int64)])
        self.letters = sums[self.ends] - sums[self.starts]
        known = np.flatnonzero(self.has_script)
        first_letter = np.searchsorted(known, self.starts)
        self.script = np.full(len(self.starts), -1, np.int64)
        lettered = self.letters > 0
        self.script[lettered] = scripts[known[first_letter[lettered]]]
        low = LOWER[data].astype(np.int64)
        low[~self.has_script & (data < 0x80)] = 0  # marks, digits and white space bound a word alike
        wide = np.concatenate([[0], low, [0]])
        gram = (wide[:-2] * 65599 + wide[1:-1]) * 65599 + wide[2:]
        self.slot = ((gram * 0x9E3779B1) >> 16) & (SLOTS - 1)
        self.counted = low > 0
        # a word's own bounds: the byte before a document's first word is another text's
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        self.slot[cuts] = (((low[cuts] * 65599 + wide[cuts + 2]) * 0x9E3779B1) >> 16) & (SLOTS - 1)
        self.slot[cuts - 1] = ((((wide[cuts - 1] * 65599 + low[cuts - 1]) * 65599) * 0x9E3779B1) >> 16) & (SLOTS - 1)

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Sum of a table's rows over the counted trigrams of each word, shape (words, languages)."""
        out = np.zeros((len(self.starts), table.shape[1]), np.float32)
        if len(self.starts):
            which = np.flatnonzero(self.counted)
            edges = np.searchsorted(which, np.append(self.starts, len(self.counted)))
            filled = np.flatnonzero(np.diff(edges))
            if len(filled):
                out[filled] = np.add.reduceat(table[self.slot[which]], edges[filled], axis=0)
        return out


class Model:
    """Log-probabilities by slot, shares of scripts and names of the languages."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.names = names
        smooth = counts + 0.1
        logs = np.log(smooth / smooth.sum(0, keepdims=True)) if names else np.zeros((SLOTS, 0))
        self.table = (logs - logs.mean(1, keepdims=True)).astype(np.float32) if names else logs.astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1) if names else np.zeros((len(SCRIPTS), 0))
        allowed = share >= 0.001
        self.allowed = np.where(allowed.any(1, keepdims=True), allowed, True)


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang", max_languages: int = MAX_LANGUAGES) -> Model:
    """Counts over all rows of ``labelled`` with a language and a text.

    Counts are summed per task, then per (language, slot) on the executors; the
    driver receives at most ``max_languages * (SLOTS + scripts)`` sums.  More
    languages raise an error, since a model must hold all that it learns from.
    """
    if not 0 < max_languages <= 255:
        raise ValueError("max_languages must be from 1 to 255")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            langs = np.asarray(batch.column(1).to_pylist(), object)
            for lo, hi in slices(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                words = Words(part, at)
                scripts = byte_scripts(part)
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                own = langs[lo:hi]
                for name in set(own):
                    mine = np.flatnonzero(own == name)
                    here = np.isin(doc, mine)
                    slots, kinds = totals.setdefault(name, (np.zeros(SLOTS, np.int64), np.zeros(len(SCRIPTS), np.int64)))
                    slots += np.bincount(words.slot[here & words.counted], minlength=SLOTS)
                    kinds += np.bincount(scripts[here & (scripts >= 0)], minlength=len(SCRIPTS))
        for name, (slots, kinds) in totals.items():
            both = np.concatenate([slots, kinds])
            used = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(both[used])], names=["lang", "slot", "n"])

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # two-step sum: per (lang, slot) first, so that a row of ``sums`` holds at most SLOTS pairs
    sums = rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("pairs"))
    found = sorted(sums.limit(max_languages + 1).collect(), key=lambda r: r.lang)
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages")
    counts = np.zeros((SLOTS + len(SCRIPTS), len(found)))
    for k, r in enumerate(found):
        pairs = np.array(r.pairs, np.int64)
        counts[pairs[:, 0], k] = pairs[:, 1]
    return Model([r.lang for r in found], counts[:SLOTS], counts[SLOTS:])


#: Words of a stretch of a text that is walked beside others.
STRETCH = 128


def _step(total: np.ndarray, own: np.ndarray, penalty: float) -> np.ndarray:
    """Totals by label (last axis) after one more word: stay, or switch from the best label."""
    return np.maximum(total, total.max(-1, keepdims=True) - penalty) + own


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word: total score less ``penalty`` for each switch, ties to the lower label.

    Texts are cut into stretches that are walked side by side, one step per word
    of a stretch: first from every label that a stretch may be entered with, which
    gives the totals at the end of each by those at its start; then with the totals
    that it is really entered with, which gives the way back.
    """
    n_words, n_labels = scores.shape
    labels = np.zeros(n_words, np.int64)
    counts = -(-np.diff(first) // STRETCH)
    if not n_words or n_labels < 2:
        return labels
    text = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = first[:-1][text] + number * STRETCH
    length = np.minimum(first[1:][text] - begin, STRETCH)
    final = number == counts[text] - 1
    entry = np.zeros((len(text), n_labels))
    inner = np.flatnonzero(~final)
    if len(inner):
        total = np.full((len(inner), n_labels, n_labels), -np.inf)
        total[:, np.arange(n_labels), np.arange(n_labels)] = 0
        for step in range(STRETCH):
            total = _step(total, scores[begin[inner] + step][:, None, :], penalty)
        way = np.zeros(len(text), np.int64)
        way[inner] = np.arange(len(inner))
        for k in range(1, int(counts.max())):
            here = np.flatnonzero(number == k)
            entry[here] = (entry[here - 1][:, :, None] + total[way[here - 1]]).max(1)
    order = np.argsort(-length, kind="stable")
    begin, length, total = begin[order], length[order], entry[order]
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    back = np.zeros((n_words, n_labels), np.uint8)
    own = np.arange(n_labels, dtype=np.uint8)
    for step, n in enumerate(live.tolist()):
        now, at = total[:n], begin[:n] + step
        best = now.argmax(1)
        switched = now[np.arange(n), best] - penalty
        change = switched[:, None] > now
        back[at] = np.where(change, best[:, None].astype(np.uint8), own)
        total[:n] = np.where(change, switched[:, None], now) + scores[at]
    state = np.empty(len(order), np.int64)
    state[order] = total.argmax(1)
    if len(inner):  # the label before each stretch by the label at its end; then from the last stretch of each text to its first
        ends = np.tile(np.arange(n_labels), (len(order), 1))
        for step in range(len(live) - 1, -1, -1):
            n = live[step]
            ends[:n] = back[(begin[:n] + step)[:, None], ends[:n]]
        before = np.empty_like(ends)
        before[order] = ends
        for k in range(int(counts.max()) - 1, 0, -1):
            here = np.flatnonzero(number == k)
            state[here - 1] = before[here, state[here]]
    state = state[order]
    for step in range(len(live) - 1, -1, -1):
        n = live[step]
        at = begin[:n] + step
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


def predict(docs: DataFrame, model: Model, *, text: str = "text", penalty: float = 8.0, pred: str = "lang_pred", score: str = "score", spans: str = "lang_spans") -> DataFrame:
    """``docs`` plus the language, a score from 0 to 1 and spans ``[(lang, first word, words)]``.

    The score is the share of letters under the predicted label.  A null text, a
    text without a letter (by Unicode), or a model without languages gives ``und``, 0 and no
    spans; letters of no listed script give the first name and 0.  Ties go to the first name in order.  Columns with a new one's name
    are replaced; rows do not depend on each other.
    """
    context = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = context.value
        table, names, allowed = model.table, model.names, model.allowed

        def work(column: pa.Array) -> dict[str, object]:
            data, offsets = buffers(column)
            n = len(offsets) - 1
            words = Words(data, offsets)
            scores = words.scores(table)
            scores[(words.script[:, None] >= 0) & ~allowed[words.script]] -= 50
            labels = viterbi(scores, words.first, penalty)
            doc = np.repeat(np.arange(n), np.diff(words.first))
            weight = np.bincount(doc * max(len(names), 1) + labels, weights=words.letters, minlength=n * max(len(names), 1)).reshape(n, -1)
            total, best = weight.sum(1), weight.argmax(1)
            latin = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
            known = (latin[offsets[1:]] > latin[offsets[:-1]]) & bool(names)
            for i in np.flatnonzero(~known & bool(names)):  # blocks also hold digits and marks, and not all letters are in a listed block
                value = column[int(i)].as_py()
                known[i] = value is not None and any(c.isalpha() for c in value)
            out_pred = [names[best[i]] if known[i] else UNKNOWN for i in range(n)]
            out_score = np.where(known & (total > 0), weight.max(1) / np.maximum(total, 1), 0.0)
            out_spans = []
            turn = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])])) if len(labels) else np.zeros(0, np.int64)
            length = np.diff(np.append(turn, len(labels)))
            edges = np.searchsorted(turn, words.first)
            for i in range(n):
                out_spans.append([] if not known[i] else [{"lang": names[labels[turn[k]]], "first": int(turn[k] - words.first[i]), "words": int(length[k])} for k in range(edges[i], edges[i + 1])])
            return {pred: out_pred, score: out_score, spans: out_spans}

        return work

    span = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("words", T.LongType())]))
    return with_columns(docs, [text], [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(spans, span)], make)
