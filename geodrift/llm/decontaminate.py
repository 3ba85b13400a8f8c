"""Benchmark decontamination: CGK walks, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of normalised words.  A CGK walk embeds a window: step by
step it writes down the word it stands on, and goes on by one word or stays, as
a random bit of that word for that step says.  Windows at a small edit distance
have walks at a small Hamming distance, as walks that an edit has parted meet
again.  Every item of which words may be edited is covered by overlapping
windows of up to WINDOW words (the whole item, if it is no longer); a walk starts
at every word of a document.  WALKS walks, every second one from the last word
backwards, with SAMPLINGS samplings of SAMPLED steps each make the tables of the
LSH.  The least edit distance of each item to the text around the places found is
then computed exactly.  Items too short for an edit are looked up whole.

Measured by tests at the largest allowed distance, a tenth of an item's words,
for items of 10 to 1,000 words with edits spread and clustered: recall 0.97 or more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import LOWER, Prefix, buffers, mix, with_columns, word_bounds

#: Items, and bytes of their texts, that an index may hold; it is broadcast, with all words of each.
MAX_ITEMS = 200_000
MAX_BYTES = 1 << 28
#: Words of a window and from one window of an item to the next.
WINDOW, STRIDE = 16, 8
#: Walks, steps of each (two for a word of a window), samplings of a walk and steps in one.
WALKS, STEPS, SAMPLINGS, SAMPLED = 6, 32, 8, 4
#: Words by which a walk's start may miss an item's place besides the edits.
DRIFT = 8
#: Leading bits of a hash by which most places are ruled out.
FILTER_BITS = 20
#: Code of one edit in the tables of best_place; below it is the place.
EDIT = np.int64(1 << 32)

#: Bytes that belong to a word: ASCII letters and digits and all of non-ASCII; other bytes separate.
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def lower(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case by Unicode; texts of ASCII alone take a table."""
    low = LOWER[data]
    if not len(data) or data.max() < 128:
        return low, offsets
    before = np.concatenate([[0], np.cumsum(data >= 128)])
    wide = (before[offsets[1:]] > before[offsets[:-1]]).tolist()
    at = offsets.tolist()
    # bytes that are no UTF-8 stay as they are
    parts = [bytes(data[a:b]).decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape") if w else bytes(low[a:b]) for a, b, w in zip(at, at[1:], wide)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text): lower case by Unicode, ASCII marks dropped."""
    low, offsets = lower(data, offsets)
    starts, ends, first = word_bounds(np.where(_INSIDE[low], low, 0x20).astype(np.uint8), offsets)
    return Prefix(low).hash(starts, ends), first


def best_place(item: np.ndarray, text: np.ndarray, last: int, most: int) -> tuple[int, int]:
    """(edits, start): least edits (insert, drop, replace a word) from ``item`` to words of ``text`` from a start of 0 to ``last``.

    Of equal edits the least start; (most + 1, 0) if above ``most``.  One row
    per item word over the diagonals that can matter; a cell is edits * EDIT + start.
    """
    far = (most + 1) * EDIT
    place = np.arange(-most, last + most + 1)
    row = np.where((place >= 0) & (place <= min(last, len(text))), place, far).astype(np.int64)
    steps = np.arange(len(place)) * EDIT
    row = np.minimum(np.minimum.accumulate(row - steps) + steps, far)
    for i in range(1, len(item) + 1):
        at = i + place  # columns of the table
        lo, hi = np.searchsorted(at, [1, len(text) + 1])
        new = np.full(len(at), far)
        new[lo:hi] = row[lo:hi] + np.where(text[at[lo:hi] - 1] == item[i - 1], np.int64(0), EDIT)
        lo = max(lo - 1, 0)  # column 0 too
        new[lo:hi] = np.minimum(new[lo:hi], np.append(row[1:], far)[lo:hi] + EDIT)
        new = np.minimum.accumulate(new - steps) + steps  # insertions along the row
        new[hi:] = far
        row = np.minimum(new, far)
        if row.min() >= far:
            return most + 1, 0
    edits, start = divmod(int(row.min()), int(EDIT))
    return (edits, start) if edits <= most else (most + 1, 0)


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> int:
    """Least edits from ``item`` to a prefix of ``text``; most + 1 if above ``most``."""
    return best_place(item, text, 0, most)[0]


@dataclass
class Table:
    """Sorted keys with the item each is of and the item's word that its window starts (or, backwards, ends) at."""

    keys: np.ndarray
    items: np.ndarray
    words: np.ndarray
    #: Whether a key begins with these FILTER_BITS bits.
    leading: np.ndarray

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``keys``, entry) of all matches."""
        at = np.flatnonzero(self.leading.take(keys >> (keys.dtype.itemsize * 8 - FILTER_BITS)))
        lo, hi = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
        counts = hi - lo
        return np.repeat(at, counts), np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _table(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Table:
    keys, items, words = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(keys, kind="stable")
    leading = np.zeros(1 << FILTER_BITS, bool)
    leading[keys >> (keys.dtype.itemsize * 8 - FILTER_BITS)] = True
    return Table(keys[order], items[order], words[order], leading)


@dataclass
class Index:
    """Items' ids, words and allowed edits; tables of whole windows by width, and of sampled walks by (walk, sampling)."""

    ids: list
    words: list[np.ndarray]
    most: np.ndarray
    whole: dict[int, Table]
    sampled: dict[tuple[int, int], Table]


@cache
def samplings() -> list[list[np.ndarray]]:
    """Steps of every sampling of every walk, from ever longer parts of the walk; fixed by the numbers above."""
    r = np.random.default_rng(20240817)
    return [[np.sort(r.choice(max(SAMPLED + 1, STEPS * (k + 1) // SAMPLINGS), SAMPLED, replace=False)) for k in range(SAMPLINGS)] for _ in range(WALKS)]


def _walked(words: np.ndarray, walk: int, start: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bits of the word there) at each step of the walks from ``start``; behind the last word stand words of no text."""
    pad = np.arange(1, steps + 2, dtype=np.uint64)
    bits = (mix(np.concatenate([words, pad]) ^ np.uint64(0x9E3779B97F4A7C15 * (walk + 1) & (2**64 - 1))) >> np.uint64(32)).astype(np.uint32)
    at = start.copy()
    for step in range(steps):
        own = bits.take(at)
        yield at, own
        at = at + ((own >> np.uint32(step & 31)) & np.uint32(1))


_FACTORS = np.random.default_rng(77).integers(1, 1 << 32, SAMPLED, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _sampled(words: np.ndarray, walk: int, start: np.ndarray, *, held: bool = False) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """(keys, sampled places) of each sampling for the walks from ``start``; places only if they are to be held."""
    chosen = samplings()[walk]
    keys = [np.zeros(len(start), np.uint32) for _ in chosen]
    places: list[list[np.ndarray]] = [[] for _ in chosen]
    for step, (at, own) in enumerate(_walked(words, walk, start, STEPS)):
        for k, steps in enumerate(chosen):
            if step in steps:
                keys[k] += own * _FACTORS[int(np.searchsorted(steps, step))]
                if held:
                    places[k].append(at)
    for key in keys:  # spread into the leading bits
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        key ^= key >> np.uint32(12)
        key *= np.uint32(0x297A2D39)
    return keys, places


def _rolled(hashes: np.ndarray, widths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hash of the words from each word on) for each width in rising order, built up word by word."""
    total, have = np.zeros(len(hashes), np.uint64), 0
    for width in sorted(widths):
        for have in range(have, min(width, len(hashes))):
            total = total[: len(hashes) - have] * np.uint64(0xD6E8FEB86659FD93) + hashes[have:]
        have = width
        if width > len(hashes):
            return
        yield width, mix(total)


def _tables(words: list[np.ndarray], most: np.ndarray) -> tuple[dict[int, Table], dict[tuple[int, int], Table]]:
    """A walk's sampling holds a window if all its steps are on different words of the window."""
    whole: dict[int, list] = {}
    sampled: dict[tuple[int, int], list] = {}
    item, first, width = [], [], []
    for i, w in enumerate(words):
        size = min(len(w), WINDOW)
        if not most[i]:
            ((_, own),) = _rolled(w[:size], [size])
            whole.setdefault(size, []).append((own, np.array([i]), np.array([0])))
            continue
        starts = np.unique(np.append(np.arange(0, len(w) - size, STRIDE), len(w) - size))
        item.append(np.full(len(starts), i))
        first.append(starts)
        width.append(np.full(len(starts), size))
    if item:
        item, first, width = map(np.concatenate, (item, first, width))
        joined = np.concatenate(words)
        begin = np.cumsum([0, *map(len, words)])[item] + first
        for walk in range(WALKS):
            back = walk % 2
            start = len(joined) - begin - width if back else begin
            keys, places = _sampled(joined[::-1] if back else joined, walk, start, held=True)
            for k in range(SAMPLINGS):
                at = np.stack(places[k], 1)
                fits = (at[:, -1] < start + width) & (np.diff(at, axis=1) > 0).all(1)
                if fits.any():
                    sampled[walk, k] = [(keys[k][fits], item[fits], (first + (width - 1 if back else 0))[fits])]
    return {k: _table(v) for k, v in whole.items()}, {k: _table(v) for k, v in sampled.items()}


def build_index(items: DataFrame, *, key: str = "item_id", text: str = "text", share: float = 0.1) -> Index:
    """Index of the benchmark items, held by the driver and broadcast.

    At most MAX_ITEMS items of MAX_BYTES together are accepted; more raise an
    error, since an index must hold all; each is held whole, however long.  Items with a null text or without a word match nothing and
    are left out; of repeated rows one is kept.
    """
    if not 0 <= share < 1:
        raise ValueError("share must be at least 0 and below 1")
    plain = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")
    held = plain.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes")).first()
    if held.n > MAX_ITEMS or (held.bytes or 0) > MAX_BYTES:
        raise ValueError(f"more than {MAX_ITEMS} items or {MAX_BYTES} bytes: split the benchmark and scan once per part")
    rows = plain.distinct().orderBy("k", "t").collect()
    ids, words = [], []
    for r in rows:
        data, offsets = buffers(pa.array([r.t]))
        own = normal_words(data, offsets)[0]
        if len(own):
            ids.append(r.k)
            words.append(own)
    most = np.array([int(share * len(w)) for w in words], np.int64)
    return Index(ids, words, most, *_tables(words, most))


def candidates(index: Index, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct rows (text, item, place) where a window of the item is found; place is the item's first word, from the text's."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = [np.zeros((0, 3), np.int64)]

    def add(table: Table, keys: np.ndarray, back: bool) -> None:
        row, entry = table.rows(keys)
        if back:
            row = len(hashes) - 1 - row
        out.append(np.stack([text[row], table.items[entry], row - first[text[row]] - table.words[entry]], 1))

    for width, own in _rolled(hashes, index.whole):
        add(index.whole[width], own, False)
    if index.sampled:
        turned, start = hashes[::-1], np.arange(len(hashes))
        for walk in range(WALKS):
            keys, _ = _sampled(turned if walk % 2 else hashes, walk, start)
            for k in range(SAMPLINGS):
                if (walk, k) in index.sampled:
                    add(index.sampled[walk, k], keys[k], bool(walk % 2))
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    return found[np.concatenate([[True], (found[1:] != found[:-1]).any(1)])] if len(found) else found


def _best(words: np.ndarray, distinct: frozenset, text: np.ndarray, places: np.ndarray, most: int) -> tuple[int, int]:
    """(edits, first word) of the best place of the item near the places (rising); (most + 1, 0) if none is near enough."""
    for place in places.tolist():
        if 0 <= place and np.array_equal(text[place : place + len(words)], words):
            return 0, place
    best = (most + 1, 0)
    if not most:
        return best
    far = most + DRIFT
    # places whose starts overlap are tried together
    for near in np.split(places, np.flatnonzero(np.diff(places) > 2 * far) + 1):
        lo, hi = max(0, int(near[0]) - far), int(near[-1]) + far
        if hi < 0 or lo >= len(text):
            continue
        around = text[lo : hi + len(words) + most]
        if len(distinct.difference(around.tolist())) > most:
            continue  # each distinct word of the item that is not there is an edit
        edits, start = best_place(words, around, hi - lo, most)
        if edits <= most:
            best = min(best, (edits, lo + start))
    return best


def find_leaks(docs: DataFrame, index: Index, *, text: str = "text", leaks: str = "leaks") -> DataFrame:
    """``docs`` plus ``leaks``: [(item, edits, first_word, n_words)], by item number then place.

    An item leaks if a place of the text is within ``share`` of its words in edit
    distance; of each item the place with least edits is given, the first of equals.
    Null, empty and shorter texts give an empty array; rows do not depend on each
    other; a column with the name of ``leaks`` is replaced; items with equal
    words are all given.
    """
    context = docs.sparkSession.sparkContext.broadcast(index)
    kind = T.StructType([T.StructField("item", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])

    def make():
        index = context.value
        distinct: dict[int, frozenset] = {}

        def work(column: pa.Array) -> dict[str, object]:
            data, offsets = buffers(column)
            hashes, first = normal_words(data, offsets)
            out: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(offsets) - 1)]
            if index.ids and len(hashes):
                found = candidates(index, hashes, first)
                cuts = np.flatnonzero((found[1:, :2] != found[:-1, :2]).any(1)) + 1
                for rows in np.split(found, cuts) if len(found) else []:
                    doc, item = rows[0, :2].tolist()
                    most = int(index.most[item])
                    if item not in distinct:
                        distinct[item] = frozenset(index.words[item].tolist())
                    best = _best(index.words[item], distinct[item], hashes[first[doc] : first[doc + 1]], rows[:, 2], most)
                    if best[0] <= most:
                        out[doc][item] = best
            return {leaks: [[{"item": int(index.ids[i]), "edits": e, "first_word": a, "n_words": len(index.words[i])} for i, (e, a) in sorted(own.items())] for own in out]}

        return work

    return with_columns(docs, [text], [T.StructField(leaks, T.ArrayType(kind))], make)
