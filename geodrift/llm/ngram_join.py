"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact sorted-array intersection.

Links are pairs of shingle sets with a Jaccard similarity of 0.75 or more; the
result is their connected components, found without listing all pairs:

1. Texts with equal sets form a class, one node of the graph.
2. Two linked sets share an element among the first quarter of each, in any
   common order of elements.  The order puts elements that are frequent in a
   sample last; it decides the speed, never the result.  Nodes that share a
   prefix element form a group, in order of size.
3. A group of few rows gives its pairs at once; the place of the shared element
   in both sets bounds their overlap, so most pairs fall there.
4. A large group gives the neighbours by size.  Those whose bitmaps allow a link
   are intersected exactly; what is linked so far forms families.
5. Large groups of several families are cut into tiles by size.  Two tiles are
   paired only if their sizes and places can reach the threshold and they hold
   more than one family.  Bit counts bound the overlap of each pair from above.
   The likeliest pairs that join all families of a unit are intersected exactly
   first; families grow, and the pairs still between families follow.
6. Every pair that passes its bounds is intersected exactly, unless its nodes are
   already in one family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import Scratch, components, settled
from .kernel import buffers, slices
from .shingles import bitmap, fold, intersection, overlap_bound, set_key, shingle_sets

#: Rows in a tile of a large group.
TILE_ROWS = 512
#: Ids that may be broadcast (8 to 24 bytes each); beyond, rows are shuffled to them.
BROADCAST_IDS = 500_000
#: Texts that count elements, one in SAMPLE_ONE_IN or fewer; at most FREQUENT counts are broadcast (8 bytes each).
SAMPLE_ONE_IN, SAMPLE_TEXTS = 8, 4_000_000
FREQUENT = 500_000
#: Parts that a sample's counts are dealt into, and elements that a task holds before it sends them.
COUNT_PARTS, COUNT_HELD = 2048, 1 << 21
#: Rows from which on a group is large, and texts with one element (by the sample) beyond which it is dealt into pieces.
LARGE_GROUP = 12
PIECE_ROWS = 200_000
#: One in so many rows of a piece speaks for it among the pieces of an element.
HEAD_ROWS = 64

PAIR, NEIGHBOURS, ROW = 0, 1, 2


def linked(n_a: int, n_b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (n_a + n_b - common)


def _batches(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) of slices of a column."""
    _, offsets = buffers(column)
    for lo, hi in slices(offsets):
        yield lo, shingle_sets(column.slice(lo, hi - lo))


def _mark(elements: np.ndarray) -> np.ndarray:
    """32 bits of each element, by which frequencies are counted; a collision only moves an element in the order."""
    return (elements >> np.uint64(13)).astype(np.uint32)


def frequent_marks(docs: DataFrame, scratch: Scratch, *, least: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted marks, counts, one in how many texts) of elements in ``least`` or more texts of a sample by id, at most FREQUENT.

    Tasks send sorted marks, four bytes each, to COUNT_PARTS parts; only marks
    above a count that so many can have come to the driver.
    """
    one_in = max(SAMPLE_ONE_IN, docs.count() // SAMPLE_TEXTS)
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).select("text")
    shift = np.uint32(32 - (COUNT_PARTS.bit_length() - 1))

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        marks = np.sort(np.concatenate(held))
        part = marks >> shift
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array([x.tobytes() for x in np.split(marks, at[1:])], pa.binary())], names=["part", "marks"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, sets in _batches(batch.column(0)):
                held += [_mark(own) for own in sets if len(own)]
                size += sum(map(len, sets))
                if size > COUNT_HELD:
                    yield dealt(held)
                    held, size = [], 0
        if held:
            yield dealt(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            marks, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= least
            return pa.RecordBatch.from_arrays([pa.array(marks[some].astype(np.int64)), pa.array(n[some])], names=["mark", "n"])

        at, held = None, []
        for batch in batches:
            for part, marks in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != at and held:
                    yield counted()
                    held = []
                at = part
                held.append(np.frombuffer(marks.as_py(), np.uint32))
        if held:
            yield counted()

    counts = scratch.keep(sample.mapInArrow(send, "part int, marks binary").repartition("part").sortWithinPartitions("part").mapInArrow(count, "mark long, n long"))
    steps = sorted(counts.groupBy(F.floor(4 * F.log2("n")).alias("step")).count().collect(), reverse=True)
    held, from_step = 0, None
    for step, n in steps:
        held += n
        if held > FREQUENT:
            break
        from_step = step
    rows = counts.where(F.floor(4 * F.log2("n")) >= from_step).toArrow() if from_step is not None else pa.table({"mark": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    scratch.drop(counts)
    marks, n = rows.column("mark").to_numpy().astype(np.uint32), rows.column("n").to_numpy()
    order = np.argsort(marks)
    return marks[order], n[order].astype(np.int32), one_in


def _signed(docs: DataFrame) -> DataFrame:
    """(id, n, h1, h2, bits) of each text."""
    fields = [docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("bits", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in _batches(batch.column(1)):
                keys = np.array([set_key(own) for own in sets], np.int64).reshape(-1, 2)
                bits = pa.array([bitmap(own).tobytes() if len(own) else b"" for own in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), bits], names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def _prefixes(docs: DataFrame, percent: int, frequent: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """(id, h1, n, prefix, piece) of each text with words: the elements that a partner must share one of, rarest first.

    Elements are ordered by count in the sample, then hash.  ``piece`` is 0 but for elements in so many texts
    that their rows are dealt by set, which have pieces from 1 on.
    """
    context = docs.sparkSession.sparkContext.broadcast(frequent)
    fields = [docs.schema["id"], T.StructField("h1", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("piece", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, counts, one_in = context.value
        for batch in batches:
            for lo, sets in _batches(batch.column(1)):
                prefixes, pieces = [], []
                first = np.array([set_key(own)[0] for own in sets], np.int64)
                for own, key in zip(sets, first.view(np.uint64)):
                    n = len(own)
                    keep = n - -(-percent * n // 100) + 1 if n else 0
                    piece = np.zeros(keep, np.int32)
                    if len(marks) and n:
                        mark = _mark(own)
                        at = np.searchsorted(marks, mark)
                        at[at == len(marks)] = 0
                        count = np.where(marks[at] == mark, counts[at], 0)
                        order = np.argsort(count, kind="stable")
                        own = own[order]
                        dealt = -(-count[order][:keep].astype(np.int64) * one_in // PIECE_ROWS)
                        if (dealt > 1).any():
                            piece = np.where(dealt > 1, np.uint64(key) % np.maximum(dealt, 1).astype(np.uint64) + np.uint64(1), 0).astype(np.int32)
                    prefixes.append(own[:keep].view(np.int64))
                    pieces.append(piece)
                sizes = pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32())
                prefix = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(prefixes)))
                piece = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(pieces)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), pa.array(first), pa.array([len(s) for s in sets], pa.int64()), prefix, piece], names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields)).where("n > 0")


def _possible(n_a: np.ndarray, left_a: np.ndarray, n_b: np.ndarray, left_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be linked if the first element they share has so many from it on in each."""
    return (100 + percent) * np.minimum(left_a, left_b) >= percent * (n_a + n_b)


def _sized(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements of the set, elements from the shared one on) from n * 2**32 + place."""
    n = size >> 32
    return n, n - (size & 0xFFFFFFFF)


class _Groups:
    """Turns rows (token, piece, size, node) in this order into pairs, neighbours and rows of large groups.

    A piece of a dealt element counts as large with any number of rows: its partners may be in other pieces.
    """

    names = ("kind", "token", "piece", "place", "size", "node", "other")

    def __init__(self, percent: int):
        self.percent = percent
        self.held: list[np.ndarray] = []
        #: The large group that goes on, its rows so far and its last row.
        self.large: tuple[int, int] | None = None
        self.rows, self.last = 0, None

    def _out(self, kind: int, n: int, **columns) -> pa.RecordBatch:
        made = {name: columns.get(name) for name in self.names} | {"kind": np.full(n, kind, np.int32)}
        kinds = {"kind": pa.int32(), "piece": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.nulls(n, kinds.get(c, pa.int64())) if v is None else pa.array(v, kinds.get(c, pa.int64())) for c, v in made.items()], names=self.names)

    def _pairs(self, kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        if len(both):
            yield self._out(kind, len(both), node=both[:, 0], other=both[:, 1])

    def _stretch(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of one large group, the next ones of it."""
        n, _ = _sized(rows[:, 2])
        if self.last is not None:
            before_n, before = np.append(self.last[0], n[:-1]), np.append(self.last[1], rows[:-1, 3])
        else:
            before_n, before = np.append(0, n[:-1]), np.append(rows[0, 3], rows[:-1, 3])
        near = 100 * before_n >= self.percent * n
        yield from self._pairs(NEIGHBOURS, before[near], rows[near, 3])
        place = self.rows + np.arange(len(rows))
        yield self._out(ROW, len(rows), token=rows[:, 0], piece=rows[:, 1].astype(np.int32), place=place, size=rows[:, 2], node=rows[:, 3])
        self.rows, self.last = self.rows + len(rows), (int(n[-1]), int(rows[-1, 3]))

    def _small(self, rows: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of all small groups; ``first`` is the place where each row's group begins."""
        n, left = _sized(rows[:, 2])
        a, b, step, live = [], [], 1, np.arange(len(rows))
        # all pairs at one distance at a time; a row is done when the one at this distance is too small or of another group
        while len(live := live[live - step >= first[live]]):
            live = live[100 * n[live - step] >= self.percent * n[live]]
            fits = live[_possible(n[live - step], left[live - step], n[live], left[live], self.percent)]
            a.append(rows[fits - step, 3])
            b.append(rows[fits, 3])
            step += 1
        if a:
            yield from self._pairs(PAIR, np.concatenate(a), np.concatenate(b))

    def take(self, rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        self.held.append(rows)
        if not last and sum(map(len, self.held)) < 50_000:
            return
        rows = np.concatenate(self.held)
        self.held = []
        if not len(rows):
            return
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
        ends = np.append(starts[1:], len(rows))
        if self.large is not None and tuple(rows[0, :2].tolist()) == self.large:
            yield from self._stretch(rows[: ends[0]])
            starts, ends = starts[1:], ends[1:]
            if not len(starts):
                return
        self.large, self.rows, self.last = None, 0, None
        if not last and ends[-1] - starts[-1] < LARGE_GROUP:
            self.held = [rows[starts[-1] :]]
            starts, ends = starts[:-1], ends[:-1]
        counts = ends - starts
        small = (counts < LARGE_GROUP) & (rows[starts, 1] == 0)
        some = np.flatnonzero((counts > 1) & small)
        if len(some):
            at = np.repeat(starts[some] - np.cumsum(counts[some]) + counts[some], counts[some]) + np.arange(counts[some].sum())
            begin = np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
            yield from self._small(rows[at], begin)
        for k in np.flatnonzero(~small).tolist():
            self.large, self.rows, self.last = tuple(rows[starts[k], :2].tolist()), 0, None
            yield from self._stretch(rows[starts[k] : ends[k]])


def _grouped(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, other), neighbours and rows (token, piece, place, size, node) of all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(percent)
        for batch in batches:
            yield from groups.take(np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], 1), False)
        yield from groups.take(np.zeros((0, 4), np.int64), True)

    order = ("token", "piece", "size", "node")
    return tokens.select(*order).repartition("token", "piece").sortWithinPartitions(*order).mapInArrow(run, "kind int, token long, piece int, place long, size long, node long, other long")


def _only(table: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """Rows of the table whose node is in one of the kept pairs, as far as the pairs are few enough to be broadcast."""
    if 2 * n_pairs > BROADCAST_IDS:
        return table
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return table.join(F.broadcast(ends), "node", "left_semi")


def _pass_bitmaps(pairs: DataFrame, n_pairs: int, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the kept pairs (a, b) that their bitmaps allow to be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, xs, ys = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            keep = [linked(p, q, overlap_bound(np.frombuffer(x, np.uint64), p, np.frombuffer(y, np.uint64), q), percent) for p, q, x, y in zip(na, nb, xs, ys)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(2)], names=["a", "b"])

    bits = _only(nodes.select("node", "n", "bits"), pairs, n_pairs)
    both = pairs.join(bits.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")), "a").join(bits.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "b")
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """(node, text) of the nodes in the kept pairs, from the documents with the ids that stand for them.

    A text crosses the wire smaller than its set of hashes; of an id with several texts the one with the node's set counts.
    """
    few = 2 * n_pairs <= BROADCAST_IDS
    marks = _only(nodes.select("node", F.col("rep").alias("id"), "h1"), pairs, n_pairs)
    if not few:
        marks = marks.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
    chosen = docs.join(F.broadcast(marks) if few else marks, "id").select("node", "h1", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [set_key(s)[0] for _, sets in _batches(batch.column(2)) for s in sets]
            keep = pa.array(np.array(own, np.int64) == batch.column(1).to_numpy(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], names=["node", "text"])

    return chosen.mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def _links(pairs: DataFrame, n_pairs: int, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the kept pairs (a, b) whose exact intersection makes them links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            _, one = buffers(batch.column(2))
            _, two = buffers(batch.column(3))
            for lo, hi in slices(one + two):
                left, right = (shingle_sets(batch.column(k).slice(lo, hi - lo)) for k in (2, 3))
                keep += [linked(len(a), len(b), intersection(a, b), percent) for a, b in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    texts = _texts(docs, nodes, pairs, n_pairs)
    one = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _family(rows: DataFrame, families: DataFrame | None, node: str, name: str) -> DataFrame:
    """``rows`` with the family of ``node``, its own number where it has no link yet."""
    if families is None:
        return rows.withColumn(name, F.col(node))
    roots = families.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return rows.join(F.broadcast(roots) if families.count() <= BROADCAST_IDS else roots, node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def _between(pairs: DataFrame, families: DataFrame | None) -> DataFrame:
    """The pairs whose nodes are in different families."""
    return _family(_family(pairs, families, "a", "fa"), families, "b", "fb").where("fa <> fb").select("a", "b")


def _heads(rows: DataFrame, percent: int) -> DataFrame:
    """Neighbours by size among rows that speak for the pieces of one element."""
    several = rows.where("piece > 0").select("token").distinct()
    heads = rows.where(F.col("place") % HEAD_ROWS == 0).join(several, "token", "left_semi")
    by_size = Window.partitionBy("token").orderBy("size", "node")
    near = heads.select("node", F.shiftright("size", 32).alias("n"), F.lag("node").over(by_size).alias("before"), F.lag(F.shiftright("size", 32)).over(by_size).alias("m"))
    return near.where((100 * F.col("m") >= percent * F.col("n")) & (F.col("node") != F.col("before"))).select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b"))


def _compare(unit: list[np.ndarray], bits: list[bytes], percent: int, forest: bool) -> list[tuple[int, int]]:
    """Pairs of nodes of one unit in different families that their bounds allow to be links.

    ``unit`` holds side, size, node and family, in order of size and node.  With ``forest``, only the likeliest pairs that join the families up.
    """
    side, size, node, family = unit
    n, left = _sized(size)
    maps = [np.frombuffer(x, np.uint64) for x in bits]
    widths = np.array([len(m) for m in maps])
    matrix = {w: (np.flatnonzero(widths == w), np.stack([maps[k] for k in np.flatnonzero(widths == w)])) for w in set(widths.tolist())}
    crossed = side.min() != side.max()
    xs_all, ys_all, likely = [], [], []
    for y in range(1, len(n)):
        for w, (places, rows) in matrix.items():
            if w > widths[y]:
                continue
            to = int(np.searchsorted(places, y))
            since = int(np.searchsorted(n[places[:to]] * 100, n[y] * percent))
            xs = places[since:to]
            some = (family[xs] != family[y]) & _possible(n[xs], left[xs], n[y], left[y], percent)
            if crossed:
                some &= side[xs] != side[y]
            if not some.any():
                continue
            xs, near, own = xs[some], rows[since:to][some], fold(maps[y], w)
            bound = np.minimum(n[xs] - np.bitwise_count(near & ~own).sum(1, dtype=np.int64), n[y] - np.bitwise_count(~near & own).sum(1, dtype=np.int64))
            fits = 100 * bound >= percent * (n[xs] + n[y] - bound)
            xs_all.append(xs[fits])
            ys_all.append(np.full(int(fits.sum()), y))
            likely.append(bound[fits] / (n[xs[fits]] + n[y] - bound[fits]))
    if not xs_all:
        return []
    xs, ys = np.concatenate(xs_all), np.concatenate(ys_all)
    if forest:
        order = np.argsort(-np.concatenate(likely), kind="stable")
        root: dict[int, int] = {}

        def find(k: int) -> int:
            while root.setdefault(k, k) != k:
                root[k] = k = root[root[k]]
            return k

        chosen = []
        for k in order.tolist():
            p, q = find(int(family[xs[k]])), find(int(family[ys[k]]))
            if p != q:
                root[p] = q
                chosen.append(k)
        xs, ys = xs[chosen], ys[chosen]
    return list(zip(np.minimum(node[xs], node[ys]).tolist(), np.maximum(node[xs], node[ys]).tolist()))


def _tile_pairs(rows: DataFrame, families: DataFrame | None, nodes: DataFrame, percent: int, forest: bool, scratch: Scratch) -> DataFrame | None:
    """Distinct pairs (a, b) of large groups in different families, by pairs of tiles that can hold links; None if no group has several families."""
    named = _family(rows, families, "node", "family").withColumn("tile", F.floor(F.col("place") / TILE_ROWS))
    mixed = named.groupBy("token").agg(F.min("family").alias("f1"), F.max("family").alias("f2")).where("f1 <> f2").select("token")
    named = scratch.keep(named.join(mixed, "token", "left_semi"))
    if named.isEmpty():
        return None
    n = F.shiftright("size", 32)
    tiles = named.groupBy("token", "piece", "tile").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.max(n - F.col("size").bitwiseAND(0xFFFFFFFF)).alias("left"), F.min("family").alias("f1"), F.max("family").alias("f2"))
    tiles = scratch.keep(tiles)

    def named_as(k: int) -> DataFrame:
        return tiles.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("piece", "tile", "lo", "hi", "left", "f1", "f2")])

    sizes = (100 * F.col("hi_1") >= percent * F.col("lo_2")) & (100 * F.col("hi_2") >= percent * F.col("lo_1"))
    places = (100 + percent) * F.least("left_1", "left_2") >= percent * (F.col("lo_1") + F.col("lo_2"))
    one_family = (F.least("f1_1", "f1_2") == F.greatest("f2_1", "f2_2"))
    ordered = F.struct("piece_1", "tile_1") <= F.struct("piece_2", "tile_2")
    # a group has a tile for every TILE_ROWS rows; only tiles near in size meet
    units = named_as(1).join(named_as(2), "token").where(ordered & sizes & places & ~one_family)
    units = scratch.keep(units.select("token", "piece_1", "tile_1", "piece_2", "tile_2").withColumn("unit", F.monotonically_increasing_id()))
    first = units.select("unit", "token", F.col("piece_1").alias("piece"), F.col("tile_1").alias("tile"), F.lit(0).alias("side"))
    second = units.where("piece_1 <> piece_2 OR tile_1 <> tile_2").select("unit", "token", F.col("piece_2").alias("piece"), F.col("tile_2").alias("tile"), F.lit(1).alias("side"))
    dealt = named.join(first.union(second), ["token", "piece", "tile"]).select("unit", "side", "size", "node", "family").join(nodes.select("node", "bits"), "node")
    dealt = dealt.select("unit", "side", "size", "node", "family", "bits").repartition("unit").sortWithinPartitions("unit", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            found = _compare([table.column(k).to_numpy().astype(np.int64) for k in range(1, 5)], table.column(5).to_pylist(), percent, forest)
            both = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        at, held = None, []
        for batch in batches:
            unit = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if unit[lo] != at and held:
                        yield told(held)
                        held = []
                    at = unit[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield told(held)

    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, class_id, component_id) of each row of ``docs``.

    class_id is the least id with an equal shingle set, component_id the least id
    reachable by links.  A text without words, or null, has no shingles, links
    with nothing and has its own id twice.  Rows with equal ids and different
    texts are nodes of their own.  A row with a null id takes no part in links
    and gets null ids, but keeps its count.  Repeated rows are returned as often
    as they come; other columns are ignored; any ``percent`` from 1 to 100.
    A task needs about 30 bytes of memory for each byte of its longest text.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    plain = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(_signed(plain))
    keyed = signed.where("n > 0 AND id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.first("bits").alias("bits"))
    nodes = scratch.keep(keyed.withColumn("node", F.monotonically_increasing_id()))
    frequent = frequent_marks(plain, scratch)
    dealt = bool((frequent[1].astype(np.int64) * frequent[2] > PIECE_ROWS).any())
    marks = nodes.select(F.col("rep").alias("id"), "h1", "node")
    few = nodes.count() <= BROADCAST_IDS
    found = _prefixes(plain, percent, frequent).join(F.broadcast(marks) if few else marks, ["id", "h1"])
    tokens = found.select("node", "n", F.posexplode(F.arrays_zip("prefix", "piece"))).select(F.col("col.prefix").alias("token"), F.col("col.piece").alias("piece"), F.shiftleft("n", 32).bitwiseOR(F.col("pos")).alias("size"), "node")
    grouped = scratch.keep(_grouped(tokens, percent))

    def pairs(kind: int) -> DataFrame:
        return grouped.where(F.col("kind") == kind).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()

    rows = grouped.where(F.col("kind") == ROW).select("token", "piece", "place", "size", "node")
    links, families = [], None

    def confirmed(wanted: DataFrame, *, bitmaps: bool) -> bool:
        """Adds the links among the wanted pairs, and joins up the families; whether there were pairs."""
        nonlocal families
        used = []
        for step in (lambda p, n: _pass_bitmaps(p, n, nodes, percent),) * bitmaps + (lambda p, n: _links(p, n, plain, nodes, percent),):
            kept = scratch.keep(wanted)
            used.append(kept)
            n_pairs = kept.count()
            if not n_pairs:
                return False
            wanted = step(kept, n_pairs)
        links.append(scratch.keep(wanted))
        scratch.drop(*used)
        every = links[0]
        for more in links[1:]:
            every = every.union(more)
        families = components(every)
        return True

    if not rows.isEmpty():
        near = pairs(NEIGHBOURS)
        if dealt:  # elements in pieces
            near = near.union(_heads(rows, percent)).distinct()
        confirmed(near, bitmaps=True)
        for forest in (True, False):  # likeliest pairs first; where there are none, no others are left
            across = _tile_pairs(rows, families, nodes, percent, forest, scratch)
            if across is None or not confirmed(across, bitmaps=False):
                break
    confirmed(_between(pairs(PAIR), families), bitmaps=True)
    classes = nodes.select("n", "h1", "h2", "node", "rep")
    if families is None:
        known = classes.select("n", "h1", "h2", "rep", F.col("rep").alias("least"))
    else:
        named = families.join(classes.select("node", "rep"), "node")
        least = named.join(named.groupBy("root").agg(F.min("rep").alias("least")), "root").select("node", "least")
        known = classes.join(least, "node", "left").select("n", "h1", "h2", "rep", F.coalesce("least", "rep").alias("least"))
    own = F.col("id").isNotNull()
    out = signed.select("id", "n", "h1", "h2").join(known, ["n", "h1", "h2"], "left")
    out = out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(own, F.coalesce("rep", "id")).alias("class_id"), F.when(own, F.coalesce("least", "id")).alias("component_id"))
    result = settled(out)
    scratch.close()
    return result
