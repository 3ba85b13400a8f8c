"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Features are hashed and binary: the distinct letter runs of a text (case folded
for ASCII), their first few bytes and a few form features in coarse steps.  One weight vector is shared
by all grades; ordered thresholds turn its score into P(grade <= k), hence an
expected grade and the tail probability P(grade >= k) used for selection.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import LOWER, Prefix, buffers, release, windows, with_columns, word_bounds

SLOTS = 1 << 18
#: Rated rows whose features are gone through at once by the fit.
FIT_ROWS = 500
#: Bytes of a letter run's first part that are features too, so that inflected words share weight.
STEMS = (4, 5, 6)
#: Upper ends of the steps of a form feature that is a share.
STEPS = (0.0, 0.01, 0.04, 0.12, 0.3)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]~^_\\=@!")] = True


def features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature slot) pairs in order, only slots with ``wanted`` if given."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    low = LOWER[data]
    prefix = Prefix(low)
    starts, ends, first = word_bounds(np.where(_LETTER[data], low, 0x20).astype(np.uint8), offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    pairs = []
    for k in (None, *STEMS):
        hashes = prefix.hash(starts, ends) if k is None else prefix.hash(starts, np.minimum(ends, starts + k)) ^ np.uint64(k)
        slots = (hashes % np.uint64(SLOTS)).astype(np.int64)
        use = slice(None) if wanted is None else wanted[slots]
        pairs.append(doc[use] * SLOTS + slots[use])

    def per_doc(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

    w_starts, w_ends, w_first = word_bounds(data, offsets)
    w_hash, words = prefix.hash(w_starts, w_ends), np.diff(w_first)
    repeats = np.zeros(n)
    for i in np.flatnonzero(words > 5):
        grams = np.sort(windows(w_hash[w_first[i] : w_first[i + 1]], 5))
        repeats[i] = np.count_nonzero(grams[1:] == grams[:-1]) / len(grams)
    letters = np.maximum(per_doc(_LETTER[data]), 1)
    shares = [per_doc(_SYMBOL[data]) / letters, per_doc((data >= 65) & (data <= 90)) / letters, per_doc((data >= 48) & (data <= 57)) / letters, per_doc(data == 0x7C) / letters, repeats]
    forms = [np.searchsorted(STEPS, share, "left") for share in shares] + [np.searchsorted(1 << np.arange(12), words, "right")]
    for k, step in enumerate(forms):
        slots = (0x51ED27 * (k + 1) + 7919 * step) % SLOTS
        use = slice(None) if wanted is None else wanted[slots]
        pairs.append((np.arange(n) * SLOTS + slots)[use])
    found = np.unique(np.concatenate(pairs))
    return found // SLOTS, found % SLOTS


@dataclass
class Model:
    """Weights by slot and ascending thresholds (one fewer than the grades)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 …, shape (rows, grades - 1)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


#: What a fit on ratings of one side says.
ONE_SIDED = "ratings on one side of the top grade, or none: the model knows their shares only"


def one_sided(grades: np.ndarray, n_grades: int) -> bool:
    """Whether no grade, all grades or none of them are below the top one."""
    low = grades < n_grades - 1
    return bool(low.all() or not low.any())


def fit(rows: list[np.ndarray], grades: np.ndarray, *, n_grades: int, penalty: float = 0.005, steps: int = 200, min_z: float = 3.0) -> Model:
    """Maximum penalised likelihood by full-batch Adam, deterministic.

    A feature's value is the log-odds ratio of its presence below the top grade
    against the top grade; a feature whose ratio is within ``min_z`` standard
    errors of 0 gets no weight.  Ratings that are all below the top grade, all of
    it, or none at all show no feature's ratio: all weights are 0, the thresholds
    give every text the shares of the ratings (plus one on either side), and a
    warning says so.
    """
    weights = np.zeros(SLOTS)
    cuts = np.linspace(-2.0, -1.0, n_grades - 1)
    low = grades < n_grades - 1
    if one_sided(grades, n_grades):
        warnings.warn(ONE_SIDED, stacklevel=2)
        return Model(weights.astype(np.float32), np.array([np.log(((grades < k).sum() + 1) / ((grades >= k).sum() + 1)) for k in range(1, n_grades)]))
    parts = [slice(k, k + FIT_ROWS) for k in range(0, len(rows), FIT_ROWS)]
    bad, all_ = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for part in parts:
        lens = [len(r) for r in rows[part]]
        cols = np.concatenate(rows[part])
        bad += np.bincount(cols[np.repeat(low[part], lens)], minlength=SLOTS)
        all_ += np.bincount(cols, minlength=SLOTS)
    a, b, c, d = bad + 0.5, all_ - bad + 0.5, low.sum() - bad + 0.5, (~low).sum() - (all_ - bad) + 0.5
    odds = np.log(a * d / (b * c))
    used = np.flatnonzero((np.abs(odds) > min_z * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)) & (all_ >= 5))
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    values, held = -odds[used], []
    for part in parts:
        own = [x[x >= 0] for x in (place[r] for r in rows[part])]
        held.append((part, np.concatenate(own).astype(np.int32), [len(x) for x in own]))
    n, levels, at = len(rows), np.arange(1, n_grades), np.arange(len(rows))
    w = np.zeros(len(used))
    m = v = np.zeros(len(used) + n_grades - 1)
    for step in range(1, steps + 1):
        score = np.concatenate([np.bincount(np.repeat(np.arange(len(lens)), lens), weights=w[cols] * values[cols], minlength=len(lens)) for _, cols, lens in held])
        tails = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40))), np.zeros((n, 1))], axis=1)
        own, above = tails[at, grades], tails[at, grades + 1]
        p = np.maximum(own - above, 1e-9)
        d_own, d_above = own * (1 - own) / p, above * (1 - above) / p
        pull = np.zeros(len(used))
        for part, cols, lens in held:  # adds in the order of the rows, so parts change no bit
            np.add.at(pull, cols.astype(np.intp), np.repeat((d_own - d_above)[part], lens) * values[cols])
        g_w = penalty * w - pull / n
        g_cut = [(d_own[grades == k].sum() - d_above[grades + 1 == k].sum()) / n for k in levels]
        grad = np.concatenate([g_w, g_cut])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, cuts = w - move[: len(used)], np.sort(cuts - move[len(used) :])
    weights[used] = w * -odds[used]
    return Model(weights.astype(np.float32), cuts)


def train(docs: DataFrame, ratings: DataFrame, *, grade: str = "grade", key: str = "doc_id", text: str = "text", n_grades: int = 3, max_rows: int = 6000) -> Model:
    """Model from the rated documents; at most ``max_rows`` of them, by least hash of the key.

    ``grade`` runs from 0 to ``n_grades - 1``; ratings that are null or outside
    are left out, as are rated rows with a null text.  The bound holds what is
    broadcast (keys) and what the task that fits holds (feature slots) whatever the
    size of docs; the driver gets the model alone.
    """
    rated = ratings.select(F.col(f"`{key}`").alias("k"), F.col(f"`{grade}`").cast("int").alias("g")).where(f"k IS NOT NULL AND g BETWEEN 0 AND {n_grades - 1}")
    rated = rated.groupBy("k").agg(F.min("g").alias("g")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    found = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(rated), "k").where("t IS NOT NULL")

    def make():
        def work(column: pa.Array) -> dict[str, object]:
            doc, slots = features(column)
            return {"slots": [x.tobytes() for x in np.split(slots.astype("<i4"), np.searchsorted(doc, np.arange(1, len(column))))]}

        return work

    chosen = with_columns(found, ["t"], [T.StructField("slots", T.BinaryType())], make).select("g", "slots", "k").orderBy(F.xxhash64("k"), "k", "g").limit(max_rows)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades = [], []
        for batch in batches:
            grades += batch.column(0).to_pylist()
            rows += [np.frombuffer(x, "<i4") for x in batch.column(1).to_pylist()]
        grades = np.array(grades, np.int64)
        with warnings.catch_warnings():  # the driver warns
            warnings.simplefilter("ignore")
            model = fit(rows, grades, n_grades=n_grades)
        slots = np.flatnonzero(model.weights).astype("<i4")
        held = [slots.tobytes(), model.weights[slots].astype("<f4").tobytes(), model.thresholds.astype("<f8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([one_sided(grades, n_grades)])] + [pa.array([x], pa.binary()) for x in held], names=["one_sided", "slots", "weights", "thresholds"])
        del rows
        release()

    # one task holds the bounded rows; the driver gets the model only
    got = chosen.coalesce(1).mapInArrow(fitted, "one_sided boolean, slots binary, weights binary, thresholds binary").collect()
    if not got:  # no partition at all
        return fit([], np.zeros(0, np.int64), n_grades=n_grades)
    if got[0].one_sided:
        warnings.warn(ONE_SIDED, stacklevel=2)
    weights = np.zeros(SLOTS, np.float32)
    weights[np.frombuffer(got[0].slots, "<i4")] = np.frombuffer(got[0].weights, "<f4")
    return Model(weights, np.frombuffer(got[0].thresholds, "<f8").copy())


def score(docs: DataFrame, model: Model, *, text: str = "text", select_at: int | None = None, threshold: float = 0.75, expected: str = "expected_grade", tail: str = "tail_prob", kept: str = "kept") -> DataFrame:
    """``docs`` plus the expected grade, P(grade >= ``select_at``) and whether that reaches ``threshold``.

    ``select_at`` is the top grade unless given.  A null or empty text is scored
    by its form features alone.  Rows do not depend on each other; columns with
    a new one's name are replaced.
    """
    context = docs.sparkSession.sparkContext.broadcast(model)
    level = len(model.thresholds) if select_at is None else select_at

    def make():
        model = context.value

        def work(column: pa.Array) -> dict[str, object]:
            doc, slots = features(column, model.weights != 0)
            tails = model.tails(np.bincount(doc, weights=model.weights[slots], minlength=len(column)))
            return {expected: tails.sum(1), tail: tails[:, level - 1], kept: tails[:, level - 1] >= threshold}

        return work

    return with_columns(docs, [text], [T.StructField(expected, T.DoubleType()), T.StructField(tail, T.DoubleType()), T.StructField(kept, T.BooleanType())], make)


def grade_of(quality: str | Column = "quality", toxic: str | Column = "toxic") -> Column:
    """Grade 0 to 2: one point for good quality, one for not being toxic."""
    return F.col(quality).cast("int") + 1 - F.col(toxic).cast("int") if isinstance(quality, str) else quality.cast("int") + 1 - toxic.cast("int")
