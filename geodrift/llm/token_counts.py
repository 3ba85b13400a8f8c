"""Token counts: lengths only, by the tokenizers library, over distinct chunks of text.

Texts are cut at safe boundaries (a space after a visible character, or a mark
such as a full stop after a letter), where no pre-token and no special token can
span; the length of a text is then the sum over its chunks.  Each distinct chunk of a batch is encoded once, in library
batches of bounded bytes, and a bounded table carries lengths from batch to batch.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernel import Prefix, buffers, with_columns

#: Bytes of chunks per library call, and chunk lengths kept between batches.
CALL_BYTES = 1 << 19
KEPT_CHUNKS = 1 << 20

#: No special string of the tokenizer may hold one of these after a letter.
MARKS = b".,;:!?*#$%&"
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

_loaded: dict[str, object] = {}
_lengths: dict[str, Lengths] = {}


def library(path: str):
    """The tokenizer in a .json file, without truncation or padding, loaded once per process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _loaded:
        tokenizer = Tokenizer.from_file(path)
        _check_added(tokenizer)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def _check_added(tokenizer) -> None:
    """Raises if an added token can stand across a cut: it holds a space after a visible character, a mark after a letter, or strips white space."""
    for token in tokenizer.get_added_tokens_decoder().values():
        raw = token.content.encode()
        if token.lstrip or token.rstrip or len(chunk_starts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))) > 1:
            raise ValueError(f"the added token {token.content!r} can stand across a chunk's end")


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start: at documents, at a space after a character that is surely
    not white space, and at one of ``MARKS`` after a character that is surely a letter.

    The first is visible ASCII or a two-byte character from U+00C0 on, the second
    an ASCII letter or a letter of U+00C0 to U+00FF; all other cases leave the
    chunk longer, which changes no length.
    """
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        last = data[:-1]
        solid = (last > 0x20) & (last < 0x7F)
        solid[1:] |= (last[1:] >= 0x80) & (last[1:] < 0xC0) & (last[:-1] >= 0xC3) & (last[:-1] < 0xE0)
        letter = _LETTER[last]
        letter[1:] |= (last[:-1] == 0xC3) & (last[1:] >= 0x80) & (last[1:] < 0xC0) & (last[1:] != 0x97) & (last[1:] != 0xB7)
        cut[1:] = ((data[1:] == 0x20) & solid) | (_MARK[data[1:]] & letter)
    first = offsets[:-1]
    cut[first[first < len(data)]] = True
    return np.flatnonzero(cut)


class Lengths:
    """Sorted chunk hashes with their lengths; at most ``KEPT_CHUNKS`` stay."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros(0, np.int64)

    def encode(self, chunks: list[bytes]) -> np.ndarray:
        out, lo, size = [], 0, 0
        for hi, chunk in enumerate(chunks, 1):
            size += len(chunk)
            if size >= CALL_BYTES or hi == len(chunks):
                texts = [x.decode("utf-8", "replace") for x in chunks[lo:hi]]
                out += [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                lo, size = hi, 0
        return np.asarray(out, np.int64)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = Prefix(data).hash(starts, ends)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        lengths = np.zeros(len(keys), np.int64)
        lengths[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            lengths[new] = self.encode([raw[starts[i] : ends[i]] for i in first[new]])
            small = new[(ends[first[new]] - starts[first[new]]) <= 64]
            if len(self.keys) + len(small) > KEPT_CHUNKS:
                self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            merged = np.concatenate([self.keys, keys[small]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.values = merged[order], np.concatenate([self.values, lengths[small]])[order]
        return lengths[inverse]


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """``docs`` plus ``count``: the library's number of tokens of the whole text.

    ``path`` names a tokenizers .json file with a byte-level pre-tokenizer that
    adds no prefix space.  No special tokens are added; special strings inside a
    text are taken as the library takes them by default.  Null or empty: 0;
    repeated rows get equal counts, an empty table gives no rows, a column named
    like ``count`` is replaced and others pass through whatever their names.  An
    added token that could stand across a cut raises an error.  A text takes a
    small multiple of its bytes.
    """

    def make():
        lengths = _lengths.setdefault(path, Lengths(library(path)))

        def work(column: pa.Array) -> dict[str, object]:
            data, offsets = buffers(column)
            starts = chunk_starts(data, offsets)
            total = np.zeros(len(offsets), np.int64)
            if len(starts):
                ends = np.append(starts[1:], len(data))
                sums = np.concatenate([[0], np.cumsum(lengths.of(data, starts, ends))])
                total = sums[np.searchsorted(starts, offsets)]
            return {count: np.diff(total)}

        return work

    return with_columns(docs, [text], [T.StructField(count, T.LongType())], make)
