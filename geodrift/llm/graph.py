"""Connected components, lineage cuts and short-lived tables for the pair operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.

    Only a local master may go without one (tests on one machine); it then gets
    a temporary folder.  On a cluster a folder of the driver alone would lose data.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; Spark removes it when nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one run, written to the shared folder as Parquet and removed when the run needs them no more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.at: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, computed once and read back from its table."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(read)] = path
        return read

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        """Removes kept tables; shuffle files of finished jobs go with the driver's next collection, which is asked for."""
        for table in tables:
            self._remove(self.at.pop(id(table)))
        self.spark._jvm.System.gc()

    def close(self) -> None:
        self.at.clear()
        self._remove(self.folder)
        self.spark._jvm.System.gc()


#: Edges that one task may join up (16 bytes each, besides its table of nodes).
TASK_EDGES = 200_000


def _contracted(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) after one round, and the edges that are left between roots."""
    both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up")))
    hop = up.withColumnRenamed("up", "root")
    while True:  # every jump doubles the way, until all nodes point at the roots of their trees
        jump = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
        hop = settled(hop.join(jump, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if hop.where("moved").isEmpty():
            break
        hop = hop.drop("moved")
    hop = hop.drop("moved")
    left = live.join(hop.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(hop.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    return hop, settled(left.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of one task, by union-find."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), root the least node of its component.

    While more than TASK_EDGES distinct edges are left, a round points every node
    at its least neighbour, follows pointers to their ends and contracts the edges,
    so nodes at least halve; a task then joins up the bounded rest.  Loops
    and repeated edges are allowed; nodes of any orderable type; no edges give no
    rows.  ``edges`` is read twice.
    """
    kind = edges.schema["a"].dataType.simpleString()
    live = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = None
    few = live.count() <= TASK_EDGES
    live = live if few else settled(live.distinct())

    def followed(by: DataFrame) -> DataFrame:
        if found is None:
            return by
        return found.join(by.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    while not few and live.count() > TASK_EDGES:
        hop, live = _contracted(live)
        found = followed(hop)
    return settled(followed(live.repartition(1).mapInArrow(_joined_up, f"node {kind}, root {kind}")))
