"""Shared pieces: scratch tables, sized joins, hot-key ranks, distributed connected components."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 500_000

_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for an unset local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/bazaarflow-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="spark-bazaarflow-")
    return _local_scratch[app]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut, every executor sees it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Arrow batches of few rows within: texts are long, and a batch is held by the JVM and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_small_batches(f):
    """Run an operator that takes a DataFrame first under ``small_batches``."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **options):
        with small_batches(df.sparkSession):
            return f(df, *args, **options)

    return run


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows, by a count in each task: a limit would bring rows to one."""
    return df.count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, hinted for broadcast only if it was counted to be small; otherwise the join shuffles."""
    return F.broadcast(df) if small_enough(df, rows) else df


def first_by_hash(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """About ``n`` rows, those whose 64-bit hash is lowest, each hash once: even, bounded and the same at every size.

    The bound on the hash has 64 bits, so it is never rounded to nothing, and no row is favoured by its text or place.
    """
    keyed = rows.withColumn("_h", F.xxhash64(key))
    count = keyed.count()
    if count > n:
        keyed = keyed.where(F.col("_h") < F.lit(int(n * 2**64 / count) - 2**63))
    return keyed.dropDuplicates(["_h"]).drop("_h")


def numbered(df: DataFrame, keys: list[str], order: list, out: str, buckets: int = 32, salt: str | None = None) -> DataFrame:
    """Gapless numbers from 0 within ``keys`` without one task per key.

    Rows of a key are spread over ``buckets`` by the hash of ``salt`` (default: all order columns). A window numbers each
    (key, bucket) cell; the cells' counts, a table of at most keys x buckets rows, give each cell its first number.
    Numbers follow (bucket, order).
    """
    cell = "_cell"
    spread = df.withColumn(cell, F.pmod(F.xxhash64(*([F.col(salt)] if salt else order)), F.lit(buckets)).cast("int"))
    counts = spread.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n"))
    first = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col(cell).alias("_b_cell"), F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_base"))
    local = spread.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order)) - 1)
    on = [local[k].eqNullSafe(base[f"_b_{k}"]) for k in keys] + [local[cell] == base["_b_cell"]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = local.join(sized(base), condition)
    return joined.withColumn(out, F.col("_row") + F.col("_base")).drop("_row", "_base", cell, "_b_cell", *[f"_b_{k}" for k in keys])


#: Nodes with more neighbours than this get their minimum by a broadcast.
HUB = 1000
#: Edges that one task reads, at least.
EDGES_A_TASK = 50_000
#: Nodes that a task holds before it sends their roots on.
NODES_HELD = 200_000
#: Up to so many nodes get their minima by a broadcast, whatever their neighbours.
FEW_NODES = 200_000


def _compact(edges: DataFrame, n_edges: int) -> DataFrame:
    """A table of small files read by as many tasks as its rows need, so that a hub's counts come from few tasks."""
    return edges.coalesce(max(4, n_edges // EDGES_A_TASK))


def _with_minimum(edges: DataFrame, low: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (a, b) with ``low``'s minimum m of each a; no task gathers the edges of a hub.

    ``n_edges`` edges have at most twice as many nodes, and at most 2 * ``n_edges`` / h of those are hubs of more than h
    edges: both bounds are known before anything is sent to all tasks.
    """
    if 2 * n_edges <= FEW_NODES:
        return edges.join(F.broadcast(low.select("a", "m")), "a")
    h = max(HUB, 2 * n_edges // FEW_NODES)
    hubs = F.broadcast(low.where(F.col("n") > h).select("a", "m"))
    return edges.join(hubs, "a").unionByName(edges.join(hubs, "a", "left_anti").join(low.where(F.col("n") <= h).select("a", "m"), "a"))


def stars(batches):
    """Edges (a, b) of a task -> for each node of theirs the smallest node that they connect it with: fewer edges, the same components.

    What makes edges in Python ends with it in its own function: two Python stages in one task take two workers at once.
    """
    root: dict[int, int] = {}

    def top(x: int) -> int:
        up = root.setdefault(x, x)
        while up != root[up]:
            root[x] = root[up]
            x, up = up, root[root[up]]
        return up

    def told() -> pa.RecordBatch:
        pairs = np.array([(x, y) for x in root if (y := top(x)) != x], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > NODES_HELD:
            yield told()
            root.clear()
    yield told()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b`` long) as a table (``node``, ``root``); the root is the smallest node.

    Distributed union-find by alternating large-star and small-star steps: one hangs every node's larger neighbours on its smallest
    neighbour, the other its smaller ones, until every node hangs on a root. Before each step every task joins what its own
    edges connect (``stars``, on a table that was written, so no task runs it beside another Python stage), so few steps are left; one aggregation of minima (map-side combine) serves a step and tells whether it was
    the last. Steps are tables in the shared folder, so no node's neighbours meet in one row or task and lost executors
    cost one step. No step raises the sum of the edges' ends, and of two steps one lowers it while a node does not hang on a root.
    Loops and duplicate edges are allowed; nodes of loops alone do not appear. An empty input gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b")
    e = materialise(e, label)
    large = True
    while True:
        n_edges = e.count()
        e = materialise(_compact(e, n_edges).mapInArrow(stars, "a long, b long"), label)
        down = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = e.unionByName(down).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("b") < F.col("a"), F.col("b"))).alias("below"), F.max("b").alias("above"))
        low = materialise(low, f"{label}-low")
        if low.where("below > m or (m < a and above > a)").isEmpty():
            return low.select(F.col("a").alias("node"), F.col("m").alias("root"))
        if large:
            e = _with_minimum(down, low, n_edges).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            e = _with_minimum(e, low, n_edges).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("m < a").select("a", F.col("m").alias("b")))
        e = materialise(e, label)
        large = not large
