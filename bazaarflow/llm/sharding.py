"""Best-fit-decreasing sharding: groups of equal texts go whole into the tightest shard that still has room."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, numbered

#: Unit sizes are exact below 2**9 and rounded up to 9 significant bits above it: at most about 15,000 classes ever.
CLASS_BITS = 9
#: Rows that one task numbers, about.
CELL_ROWS = 500_000
#: A group with more than one in so many rows is placed by a broadcast of at most as many groups.
HEAVY = 1000


class _Node:
    __slots__ = ("key", "left", "priority", "right")

    def __init__(self, key: tuple[int, int], priority: float) -> None:
        self.key, self.priority, self.left, self.right = key, priority, None, None


class RoomTree:
    """Open shards in a treap ordered by (room left, shard): the tightest fit is the least key not below the size."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self.random = random.Random(1)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._split(node.right, key)
            return node, high
        low, node.left = self._split(node.left, key)
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low.priority > high.priority:
            low.right = self._merge(low.right, high)
            return low
        high.left = self._merge(low, high.left)
        return high

    def add(self, room: int, shard: int) -> None:
        low, high = self._split(self.root, (room, shard))
        self.root = self._merge(self._merge(low, _Node((room, shard), self.random.random())), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        first = high
        while first.left is not None:
            first = first.left
        _, high = self._split(high, (first.key[0], first.key[1] + 1))
        self.root = self._merge(low, high)
        return first.key


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Pack ``count`` units of each ``size`` into shards of ``capacity``: shards used and (size, first, end, shard) runs.

    Units of one size follow each other, and the tightest shard stays the tightest while it fits, so a size is placed in
    runs: the work follows the number of sizes and shards, not that of units.
    """
    tree, used, runs = RoomTree(), 0, []
    for size, count in sorted(histogram, reverse=True):
        done = 0
        while done < count:
            found = tree.take_tightest(size)
            if found is None:
                found, used = (capacity, used), used + 1
            room, shard = found
            n = min(count - done, max(1, room // size))
            runs.append((size, done, done + n, shard))
            done += n
            tree.add(room - n * size, shard)
    return used, runs


def fewest_bytes(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """The runs under about the least capacity with which best fit decreasing needs no more than ``shards``."""
    if not histogram:
        return []
    total = sum(s * n for s, n in histogram)
    low = max(-(-total // shards), max(s for s, _ in histogram))
    step, best = 0, None
    while best is None:
        capacity = low + step
        used, runs = best_fit_decreasing(histogram, capacity)
        if used <= shards:
            best = runs
        else:
            low, step = capacity + 1, max(1, 4 * step)
    high = capacity
    floor = max(-(-total // shards), max(s for s, _ in histogram))
    low = max(floor, high - step)
    while high - low > max(1, floor // 20_000):
        middle = (low + high) // 2
        used, runs = best_fit_decreasing(histogram, middle)
        low, high, best = (low, middle, runs) if used <= shards else (middle, high, best)
    return best


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` shards of nearly equal bytes, copies of one text together.

    A row's size is its text's UTF-8 bytes plus 8; a null text counts and groups as an empty one. Rows of equal text form
    an indivisible unit, unless they exceed a shard's fair share: such a group, of which there are fewer than shards, is
    cut into pieces of a fair share. Units are counted by size class (a bounded histogram); the driver packs that
    histogram by best fit decreasing under the least capacity that keeps to ``shards``; then ranks within a class,
    found without one task per class, take the units to their shards.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot (gapless from 0 within a shard), grown_shard (null),
    unit_rows. Sizes up to 511 bytes are packed as they are, larger ones in classes of 9 significant bits, at every size of
    the input. Repeated rows and null ids are rows like any other; ties go by key and piece; texts of any length count whole;
    other columns, whatever their names, are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))
    rows = materialise(rows, "shard-rows")
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    share = max(1, -(-(total["bytes"] or 0) // shards))

    groups = rows.groupBy("key").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    per = F.greatest(F.floor(F.lit(share) / F.col("size")), F.lit(1))
    pieces = F.when(F.col("n") * F.col("size") > share, F.ceil(F.col("n") / per)).otherwise(1)
    units = groups.withColumn("per", F.when(F.col("n") * F.col("size") > share, per).otherwise(F.col("n"))).withColumn("pieces", pieces.cast("long"))
    units = units.withColumn("piece", F.explode(F.expr("sequence(0L, pieces - 1)"))).withColumn("rows", F.least("per", F.col("n") - F.col("piece") * F.col("per")))
    units = units.withColumn("bytes", F.col("rows") * F.col("size")).withColumn("_shift", F.greatest(F.lit(0), F.length(F.bin("bytes")) - CLASS_BITS))
    units = units.withColumn("class", F.expr("shiftleft(shiftright(bytes + shiftleft(1L, _shift) - 1, _shift), _shift)"))
    units = materialise(units.select("key", "piece", "pieces", "per", "n", "rows", "class"), "shard-units")

    histogram = [(r["class"], r["n"]) for r in units.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]
    spark = docs.sparkSession
    # as an Arrow table: rows of Python objects would start Python workers of another kind beside those of mapInArrow
    runs = np.array(fewest_bytes(histogram, shards), np.int64).reshape(-1, 4)
    plan = spark.createDataFrame(pa.table(list(runs.T.copy()), ["class", "first", "end", "shard"]), "class long, first long, end long, shard int")
    spread = max(32, -(-(total["n"] or 0) // (shards * CELL_ROWS)))  # cells of a key follow the counted rows
    ranked = numbered(units, ["class"], [F.col("key"), F.col("piece")], "rank", spread)
    placed = ranked.join(F.broadcast(plan), (ranked["class"] == plan["class"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    placed = materialise(placed.select("key", "piece", "pieces", "per", "n", F.col("rows").alias("unit_rows"), "shard"), "shard-placed")

    # Groups with many rows: at most HEAVY of them, and those in pieces are fewer than the shards.
    heavy = placed.where((F.col("n") * HEAVY > total["n"]) | (F.col("pieces") > 1))
    whole = heavy.where("pieces = 1").select("key", "unit_rows", "shard")
    cut = heavy.where("pieces > 1")
    many = F.broadcast(heavy.select("key").distinct())
    light = rows.join(many, "key", "left_anti").join(placed.select("key", "unit_rows", "shard"), "key")
    crowd = rows.join(F.broadcast(whole), "key")
    split = rows.join(F.broadcast(cut.select("key", "per").distinct()), "key")
    split = numbered(split, ["key"], [F.col("doc_id")], "rank", spread).withColumn("piece", F.floor(F.col("rank") / F.col("per")))
    split = split.join(F.broadcast(cut.select("key", "piece", "unit_rows", "shard")), ["key", "piece"])
    columns = ["doc_id", "size", "text_crc32", "shard", "unit_rows"]
    all_rows = materialise(light.select(columns).unionByName(crowd.select(columns)).unionByName(split.select(columns)), "shard-all")
    out = numbered(all_rows, ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot", spread, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "unit_rows")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
