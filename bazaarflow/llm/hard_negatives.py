"""Hard negatives of embedding anchors by a secondary-sort shuffle and one streaming pass over each anchor's scores.

Anchors and rows are packed into blocks of a bounded size and meet in tiles, so every anchor is scored against every row by a
matrix product and no pair is left out. A first pass finds each anchor's positives. A second one knows their windows, so a
block sends only what a window can return from it: its first few rows. What is sent is keyed by (anchor, complement of the
score, kind, id), partitioned by anchor and sorted within partitions; the iterator over a partition holds one anchor's open windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Rows and anchors of a block, at most; anchors scored at once; anchor blocks that share a row tile.
ROWS_A_BLOCK = 4096
ANCHORS_AT_ONCE = 128
BLOCKS_A_TILE = 64
#: Packed blocks in an Arrow batch.
BLOCKS_A_BATCH = 4

_PACKED = "block long, n int, width int, kind string, ids binary, labels binary, vectors binary, scores binary"
_SENT = "anchor long, down long, kind int, id long"
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Block(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    scores: np.ndarray


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vector) of the rows that take part: nothing null, all components finite."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.cast("array<double>").alias("vector"))


def floored(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of each vector as a row; shorter vectors are filled with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    values = np.floor(scale * pc.list_flatten(column).to_numpy(zero_copy_only=False))
    if len(values) and np.abs(values).max() >= 2.0**62:
        raise OverflowError("a component is beyond 62 bits")
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values.astype(np.int64)
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(np.abs(values).max()) if values.size else 0
    return values.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _pack(scale: float):
    """(id, label, vector[, scores]) -> blocks of rows in order of their ids."""

    def run(batches):
        first, count, held, n = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0, [], 0

        def block():
            width = max(p[2].shape[1] for p in held)
            ids, labels = np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
            vectors = np.concatenate([np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in held])
            scores = np.concatenate([p[3] for p in held])
            order = np.argsort(ids, kind="stable")
            vectors = _narrow(vectors[order])
            row = [first + count, len(ids), width, vectors.dtype.str, ids[order].tobytes(), labels[order].tobytes(), vectors.tobytes(), scores[order].tobytes()]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["block", "n", "width", "kind", "ids", "labels", "vectors", "scores"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_BLOCK):
                part = batch.slice(at, ROWS_A_BLOCK)
                ids, labels = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                scores = np.array(part.column(3).to_pylist(), np.int64).reshape(len(ids), -1) if part.num_columns > 3 else np.zeros((len(ids), 0), np.int64)
                if held and n + len(ids) > ROWS_A_BLOCK:
                    yield block()
                    held, n, count = [], 0, count + 1
                held.append((ids, labels, floored(part.column(2), scale), scores))
                n += len(ids)
        if n:
            yield block()

    return run


def _block(row: dict, side: str) -> Block:
    n, width = row[f"{side}_n"], row[f"{side}_width"]
    of = lambda name, kind: np.frombuffer(row[f"{side}_{name}"], kind)
    return Block(of("ids", np.int64), of("labels", np.int64), of("vectors", row[f"{side}_kind"]).reshape(n, width), of("scores", np.int64).reshape(n, -1))


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; a vector's missing components are zeros."""
    width = min(x.shape[1], y.shape[1])
    x, y = x[:, :width], y[:, :width]
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    bound = int(np.abs(x.astype(np.int64)).max()) * int(np.abs(y.astype(np.int64)).max()) * width
    if bound < 1 << 53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return x.astype(np.int64) @ y.T.astype(np.int64)
    exact = x.astype(object) @ y.T.astype(object)
    if max(abs(int(v)) for v in exact.ravel()) >= 1 << 63:
        raise OverflowError("an inner product is beyond 64 bits")
    return exact.astype(np.int64)


def first_of(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores; of equal ones the first places."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: n - len(above)]])


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _sent(parts: list, kind: int) -> pa.RecordBatch:
    anchors, scores, ids = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(~scores), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids)], ["anchor", "down", "kind", "id"])


def _tiles(batches) -> Iterator[tuple[Block, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield _block(row, "a"), _block(row, "r")


def _positives(count: int):
    """Each tile's first rows of an anchor's label: no other row of the tile can be among the anchor's first."""

    def run(batches):
        for a, r in _tiles(batches):
            parts = []
            for label in np.unique(a.labels):
                rows, mine = np.flatnonzero(r.labels == label), np.flatnonzero(a.labels == label)
                for at in range(0, len(mine) if len(rows) else 0, ANCHORS_AT_ONCE):
                    some = mine[at : at + ANCHORS_AT_ONCE]
                    for i, scores in zip(some, product(a.vectors[some], r.vectors[rows])):
                        others = np.flatnonzero(r.ids[rows] != a.ids[i])
                        best = others[first_of(scores[others], count)]
                        parts.append((np.full(len(best), a.ids[i]), scores[best], r.ids[rows[best]]))
            yield _sent(parts, 0)

    return run


def _negatives(count: int, low: int, high: int):
    """Each tile's first rows of other labels in every window of an anchor's positives."""

    def run(batches):
        for a, r in _tiles(batches):
            parts = []
            for at in range(0, len(a.ids), ANCHORS_AT_ONCE):
                some = slice(at, at + ANCHORS_AT_ONCE)
                for anchor, label, positives, scores in zip(a.ids[some], a.labels[some], a.scores[some], product(a.vectors[some], r.vectors)):
                    windows = {window(int(p), low, high) for p in positives}
                    windows = [w for w in windows if w[0] <= w[1]]
                    if not windows:
                        continue
                    near = np.flatnonzero((scores >= min(w[0] for w in windows)) & (scores <= max(w[1] for w in windows)) & (r.labels != label) & (r.ids != anchor))
                    if not len(near):
                        continue
                    near = near[np.argsort(~scores[near], kind="stable")]
                    down, keep = ~scores[near], set()
                    for least, most in windows:
                        begin = int(np.searchsorted(down, ~most, "left"))
                        end = int(np.searchsorted(down, ~least, "right"))
                        keep.update(range(begin, min(end, begin + count)))
                    best = near[sorted(keep)]
                    parts.append((np.full(len(best), anchor), scores[best], r.ids[best]))
            yield _sent(parts, 1)

    return run


def _mine(positives: int, negatives: int, low: int, high: int):
    """Rows in order of (anchor, down, kind, id) -> triples; at most ``positives`` windows are held, whatever an anchor's rows."""

    def run(batches):
        anchor, opened = None, []
        for batch in batches:
            out = []
            for a, down, kind, other in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor:
                    anchor, opened = a, []
                score = ~down
                if kind == 0:
                    if len(opened) < positives:
                        opened.append([other, score, *window(score, low, high), 0])
                    continue
                for w in opened:
                    if w[4] < negatives and w[2] <= score <= w[3]:
                        w[4] += 1
                        out.append((a, w[0], w[4], other, w[1], score))
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return run


def _tiled(anchors: DataFrame, rows: DataFrame, groups: int) -> DataFrame:
    """Every anchor block with every row block, joined by tile: rows are dealt to ``groups``, at most one for each block, anchor blocks to shares of a bounded size.

    Both sides shuffle: the size that Spark expects of the anchors is that of their table, not of its copies for all groups.
    """
    shares, groups = max(1, -(-anchors.count() // BLOCKS_A_TILE)), max(1, min(groups, rows.count()))
    a = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "block"])
    r = rows.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), *[F.col(c).alias(f"r_{c}") for c in rows.columns if c != "block"])
    return r.join(a.hint("merge"), ["group", "share"]).drop("group", "share")


def mine_hard_negatives(rows: DataFrame, anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """Triples (anchor, positive, hard negative) from ``rows`` (id, label, vector; see ``usable``).

    ``anchor`` is a condition on ``rows``. Components become floor(scale * x) and a score is the integer inner product with
    the anchor; higher scores come first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of its
    label. For each, the first ``negatives`` rows of other labels with low * p <= 100 * s <= high * p (p the positive's score)
    are returned, ranked from 1: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Each copy of a repeated row is a row, so a copy can be returned beside it; of an anchor's copies the one of the smallest
    label, then vector, is the anchor, and no row of its id is its candidate. Vectors of other lengths are filled with zeros; long
    vectors are read whole. A score beyond 64 bits fails the job, as SQL's sums do. An anchor without positives, and an empty
    table, give no rows. Rows with nulls, and other columns, never get here.

    Each pair is scored; blocks of at most 4,096 rows send an anchor's first rows, so no key's rows meet in one task's memory.
    """
    spark = rows.sparkSession
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = rows.where(anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector")
    with small_batches(spark, ROWS_A_BLOCK):
        packed = materialise(rows.mapInArrow(_pack(scale), _PACKED), "negatives-rows")
        anchors = materialise(chosen.mapInArrow(_pack(scale), _PACKED), "negatives-anchors")
    with small_batches(spark, BLOCKS_A_BATCH):
        near = materialise(_tiled(anchors, packed, groups).mapInArrow(_positives(positives), _SENT), "negatives-near")
    first = F.row_number().over(Window.partitionBy("anchor").orderBy("down", "id"))
    found = materialise(near.withColumn("_n", first).where(F.col("_n") <= positives).drop("_n"), "negatives-positives")
    scored = found.groupBy("anchor").agg(F.array_sort(F.collect_list("down")).alias("downs"))
    last = F.element_at("downs", -1)
    scores = F.transform(F.concat("downs", F.array_repeat(last, positives - F.size("downs"))), lambda d: F.bitwise_not(d))
    windowed = chosen.join(scored, chosen["id"] == scored["anchor"]).select("id", "label", "vector", scores.alias("scores"))
    with small_batches(spark, ROWS_A_BLOCK):
        windowed = materialise(windowed.mapInArrow(_pack(scale), _PACKED), "negatives-windows")
    with small_batches(spark, BLOCKS_A_BATCH):
        sent = materialise(_tiled(windowed, packed, groups).mapInArrow(_negatives(negatives, low, high), _SENT), "negatives-sent")
    keyed = found.unionByName(sent).repartition("anchor").sortWithinPartitions("anchor", "down", "kind", "id")
    return keyed.mapInArrow(_mine(positives, negatives, low, high), _MINED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(rows, F.col("id") % 50 == 0)


ORACLE_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same, list_inner_product(a.e, r.e)::bigint as score
  from v a join v r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id),
positives as (
  select anchor_id, other_id, score from pairs where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
ranked as (
  select p.anchor_id, p.other_id as positive_id, row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id)::int as rank,
    n.other_id as negative_id, p.score as positive_score, n.score as negative_score
  from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select * from ranked where rank <= 3
"""
