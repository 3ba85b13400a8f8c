"""Sharding into near-equal byte sizes by histogram sort, in DataFrame operations only.

Rows are ordered by a 64-bit key, the hash of the text above the hash of the id,
so equal texts are neighbours yet a hot text can be split between shards.  Each
round counts the exact bytes and rows below evenly spaced probes inside the key
intervals that are still too coarse; an interval is refined while it holds the
ideal place of a splitter and more bytes than the tolerance, or more bytes than
a piece may hold (PIECE_BYTES).  When all splitters meet the tolerance, the rows are exchanged
once, by piece, and numbered inside their piece; offsets give the slot in the shard.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Scratch
from .names import unused

#: Key bits that the first round of probes covers, and that each later one adds.
FIRST_BITS, ROUND_BITS = 12, 8
KEY_BITS = 60
#: Bytes of a piece, the unit of the exchange, and the number of pieces beyond which they grow with the table.
PIECE_BYTES, MAX_PIECES = 8 << 20, 400_000
#: Interval sums that a round may send to the driver (about 24 bytes each).
ROUND_SUMS = 4_000_000
#: Bytes that a row counts besides its text.
ROW_BYTES = 8


@dataclass(frozen=True)
class Interval:
    """Keys whose first ``depth`` bits are ``prefix``, with exact sums of their rows."""

    depth: int
    prefix: int
    n_rows: int
    n_bytes: int

    @property
    def start(self) -> int:
        return self.prefix << (KEY_BITS - self.depth)


def size_of(text: str | Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def sort_key(id_column: str | Column, text: str | Column) -> Column:
    """60-bit key: 30 bits by text, 30 by id (null: the hash seed)."""
    half = (1 << 30) - 1
    return F.shiftleft(F.xxhash64(text).bitwiseAND(half), 30).bitwiseOR(F.xxhash64(id_column).bitwiseAND(half))


def _counts(keyed: DataFrame, depth: int, opened: list[Interval] | None, before: int) -> list[Interval]:
    """Exact sums of every ``depth``-bit interval inside the opened ones."""
    if opened is not None:
        keyed = keyed.join(F.broadcast(keyed.sparkSession.createDataFrame([(x.prefix,) for x in opened], "open long")), F.shiftrightunsigned("key", KEY_BITS - before) == F.col("open"), "left_semi")
    rows = keyed.groupBy(F.shiftrightunsigned("key", KEY_BITS - depth).alias("prefix")).agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes")).collect()
    return [Interval(depth, r.prefix, r.n_rows, r.n_bytes) for r in rows]


def plan(keyed: DataFrame, n_shards: int, *, tolerance: float = 0.002, piece_bytes: int = PIECE_BYTES) -> tuple[list[Interval], list[int], float]:
    """(intervals in key order, shard of each, most bytes of a piece) for rows with ``key`` and ``size``.

    ``tolerance`` is the share of a shard's ideal bytes by which a splitter may
    miss its place; only rows with equal keys (copies of one row) can make it
    miss by more.  The first round counts at most 2**FIRST_BITS intervals, a later
    one at most ROUND_SUMS in the open ones; the driver ends with about two for
    each piece, of which there are MAX_PIECES and a few for each shard at most.
    """
    done: list[Interval] = []
    opened, depth = None, 0
    total = 0
    while True:
        bits = FIRST_BITS if opened is None else max(1, min(ROUND_BITS, (ROUND_SUMS // len(opened)).bit_length() - 1))
        deeper = min(depth + bits, KEY_BITS)
        found = _counts(keyed, deeper, opened, depth)
        if opened is None:
            total = sum(x.n_bytes for x in found)
        ordered = sorted(done + found, key=lambda x: x.start)
        ideal = total / n_shards
        limit = min(ideal, max(piece_bytes, total / MAX_PIECES))
        again, below = [], 0
        for x in ordered:
            nearest = round((below + x.n_bytes / 2) / ideal) if ideal else 0
            inside = any(below < k * ideal < below + x.n_bytes for k in (nearest - 1, nearest, nearest + 1) if 0 < k < n_shards)
            below += x.n_bytes
            if x.depth == deeper and deeper < KEY_BITS and x.n_rows > 1 and (inside and x.n_bytes > tolerance * ideal or x.n_bytes > limit):
                again.append(x)
        if not again:
            break
        reopened = set(again)
        done = [x for x in ordered if x not in reopened]
        opened, depth = again, deeper
    ends, below = [], 0
    for x in ordered:
        below += x.n_bytes
        ends.append(below)
    cuts = []
    for k in range(1, n_shards):
        at = bisect_left(ends, k * ideal)
        left = ends[at - 1] if at else 0
        cuts.append(at if at >= len(ends) or k * ideal - left <= ends[at] - k * ideal else at + 1)
    shards, shard = [], 0
    for i in range(len(ordered)):
        while shard < n_shards - 1 and i >= cuts[shard]:
            shard += 1
        shards.append(shard)
    return ordered, shards, limit


def shard(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", tolerance: float = 0.002, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``docs`` plus ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    A shard's bytes (UTF-8 bytes of the text plus 8 for each row; a null text has
    none) differ from the mean by the tolerance and at most one row's size per
    end.  Rows of a shard are in order of key, id and text.  Rows with equal id and
    text are one unit of the key but get slots of their own; null ids and texts are
    ordinary values; an empty table gives no rows; columns of docs named shard or
    slot are replaced, others pass through whatever their names.  The texts are
    read twice: once for keys and sizes, which are kept, and once to be exchanged.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    kept = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in ("shard", "slot")])
    id_column, text_column = F.col(f"`{key}`"), F.col(f"`{text}`")
    scratch = Scratch(docs.sparkSession)
    keyed = scratch.keep(kept.select(sort_key(id_column, text_column).alias("key"), size_of(text_column).alias("size")))
    intervals, shards, limit = plan(keyed, n_shards, tolerance=tolerance, piece_bytes=piece_bytes)
    scratch.close()
    rows, piece, offset, held, previous = [], -1, {}, 0, -1
    start: dict[int, int] = {}
    for x, s in zip(intervals, shards):
        if s != previous or held + x.n_bytes > limit:
            piece, held = piece + 1, 0
            start[piece] = offset.get(s, 0)
        previous = s
        held += x.n_bytes
        offset[s] = offset.get(s, 0) + x.n_rows
        rows.append((x.depth, x.prefix, piece, s, start[piece]))
    spark = docs.sparkSession
    own_key, own_at, own_piece = (unused(name, docs.columns) for name in ("key", "at", "piece"))
    where = kept.withColumn(own_key, sort_key(id_column, text_column))
    places = []
    for depth in sorted({r[0] for r in rows}) or [FIRST_BITS]:
        prefix, at = unused(f"prefix{depth}", docs.columns), unused(f"at{depth}", docs.columns)
        part = spark.createDataFrame([(r[1], r[2:]) for r in rows if r[0] == depth], f"{prefix} long, {at} struct<piece:int,shard:int,start:long>")
        where = where.join(F.broadcast(part), F.shiftrightunsigned(own_key, KEY_BITS - depth) == F.col(prefix), "left").drop(prefix)
        places.append(at)
    placed = where.withColumn(own_at, F.coalesce(*places)).drop(*places).withColumn(own_piece, F.col(own_at)["piece"])
    # one task for each piece, so that no task's share grows with the table
    dealt = placed.repartitionById(max(1, piece + 1), F.col(own_piece))
    order = Window.partitionBy(own_piece).orderBy(F.col(own_key), id_column, text_column)
    columns = [F.col(f"`{c}`") for c in kept.columns]
    return dealt.select(*columns, F.col(own_at)["shard"].alias("shard"), (F.col(own_at)["start"] + F.row_number().over(order) - 1).alias("slot"))
