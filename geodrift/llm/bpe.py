"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import with_columns

#: Characters of a text that are encoded in one call; longer texts are cut at a safe boundary.
CUT_CHARS = 1 << 16
#: No alternative of the pattern goes from a visible character to a space or line feed,
#: and only white space is subject to look-ahead: a cut here changes no match.
_SAFE = re.compile(r"[!-~][ \n]")

_loaded: dict[tuple[str, str], object] = {}


def encoding(rank_file: str, pattern: str):
    """The library's encoding for a rank file, without special tokens, loaded once per process."""
    import tiktoken

    if (rank_file, pattern) not in _loaded:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[rank_file, pattern]


def safe_pieces(text: str, most: int = CUT_CHARS) -> list[str]:
    """The text in pieces of about ``most`` characters; joined, they are the text.

    A stretch without a safe boundary stays whole.
    """
    pieces, lo = [], 0
    while len(text) - lo > most:
        found = _SAFE.search(text, lo + most - 1)
        if not found or found.end() - 1 >= len(text):
            break
        pieces.append(text[lo : found.end() - 1])
        lo = found.end() - 1
    pieces.append(text[lo:])
    return pieces


def encode(docs: DataFrame, rank_file: str, pattern: str, *, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``docs`` plus ``ids``: the token ids as packed little-endian unsigned 32-bit integers.

    With ``decoded``, a column of that name holds the raw bytes that the packed
    ids decode to, in the same pass (one Python worker a task in place of two).

    A null or empty text has no ids (empty binary); repeated rows get equal ids;
    a column already named like ``ids`` is replaced; other columns pass through.
    """

    def make():
        codec = encoding(rank_file, pattern)

        def work(column: pa.Array) -> dict[str, object]:
            out, back = [], []
            for value in column.to_pylist():
                found = [np.asarray(codec.encode_ordinary(piece), "<u4") for piece in safe_pieces(value or "")]
                out.append(np.concatenate(found).astype("<u4").tobytes())
                if decoded:
                    back.append(unpacked_bytes(codec, out[-1]))
            return {ids: out} | ({decoded: back} if decoded else {})

        return work

    return with_columns(docs, [text], [T.StructField(c, T.BinaryType()) for c in (ids, decoded) if c], make)


def unpacked_bytes(codec, packed: bytes | None) -> bytes:
    """Raw bytes that packed ids stand for."""
    return codec.decode_bytes(np.frombuffer(packed or b"", "<u4").tolist())


def decode(docs: DataFrame, rank_file: str, pattern: str, *, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """``docs`` plus ``data``: the raw bytes of the packed ``ids`` (null or empty: empty).

    Bytes are not interpreted, so ids that end inside a character decode too.
    """

    def make():
        codec = encoding(rank_file, pattern)

        def work(column: pa.Array) -> dict[str, object]:
            return {data: [unpacked_bytes(codec, value) for value in column.to_pylist()]}

        return work

    return with_columns(docs, [ids], [T.StructField(data, T.BinaryType())], make)


def n_ids(ids: str | Column) -> Column:
    """Number of tokens in a packed column."""
    return (F.octet_length(ids) / 4).cast("long")
