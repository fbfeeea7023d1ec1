"""An inverted file of unit vectors: rows by their nearest centre, searched by bounds of the angles, or by a few probes.

Angles obey the triangle inequality. Let a query be at angle a from a centre and a row at angle b from it: the row is at least
|a - b| from the query. A list whose rows are at most ``reach`` from its centre thus holds no row nearer than a - reach, and
no list or row beyond the angle of the n-th best so far can change an exact answer.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Rows that the centres are fitted on, about; lists of an index, at most; rows of a block.
SAMPLE, LISTS, BLOCK = 20_000, 256, 2000


class Index(NamedTuple):
    rows: DataFrame  # key, list, part, parts, r, rv, angle
    lists: DataFrame  # key, list, parts, reach, size
    centres: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def centres(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` centres of unit vectors: the farthest-first start, then rounds of means on the sphere."""
    if not len(sample):
        return np.zeros((0, 0))
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    found = sample[chosen]
    for _ in range(rounds):
        of = (sample @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, sample)
        held = np.bincount(of, minlength=len(found)) > 0
        found[held] = _unit(sums[held])
    return found


def build(rows: DataFrame, key: str, lists: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> Index:
    """Index of (r, key, rv), unit vectors. Centres are fitted on about ``sample`` rows, the first by hash; every row gets its list.

    Lists (default: the root of the number of rows, at most ``LISTS``) are kept by key; one of many rows is cut into blocks.
    """
    rows = scratch.table(rows.select(F.col(key).alias("key"), "r", F.col("rv").cast("array<double>").alias("rv")), "vectors")
    n = rows.count()
    hashed = rows.withColumn("_h", F.xxhash64("r"))
    few = hashed.where(F.col("_h") < F.lit(int(sample * 2**64 / n) - 2**63)) if n > sample else hashed
    vectors = few.orderBy("_h").select("rv").toPandas().rv
    fitted = centres(np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 0)), lists or min(LISTS, max(1, int(n**0.5))))
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def assigned(batches):
        for rows in batches:
            cos = np.stack(rows.rv.to_numpy()) @ sent.value.T if len(rows) else np.zeros((0, 1))
            yield rows[["key", "r", "rv"]].assign(list=cos.argmax(1).astype(np.int32), angle=np.arccos(np.clip(cos.max(1), -1, 1)))

    placed = scratch.table(rows.mapInPandas(assigned, "key string, r long, rv array<double>, list int, angle double"), "vector-lists")
    kept = placed.groupBy("key", "list").agg(F.max("angle").alias("reach"), F.count(F.lit(1)).alias("size")).withColumn("parts", F.ceil(F.col("size") / F.lit(block)))
    kept = scratch.table(kept, "vector-reach")
    return Index(placed.join(kept.select("key", "list", "parts"), ["key", "list"]).withColumn("part", F.pmod(F.xxhash64("r"), F.col("parts"))), kept, fitted)


def _products(probes: DataFrame, index: Index, n: int) -> DataFrame:
    """Each query's top ``n`` rows of each block of the lists that it probes: (q, r, score, compared).

    ``probes``: q, key, qv, list, parts, angle (to the centre) and far, the angle beyond which no row can matter.
    """
    asked = probes.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            r = r.sort_values(["angle", "r"])
            angle, ids, rv = r.angle.to_numpy(), r.r.to_numpy(), np.stack(r.rv.to_numpy())
            lo = np.searchsorted(angle, q.angle.to_numpy() - q.far.to_numpy() - 1e-6)
            hi = np.searchsorted(angle, q.angle.to_numpy() + q.far.to_numpy() + 1e-6, "right")
            for row, v, a, b in zip(q.q, q.qv, lo, hi):
                scores = (rv[a:b] @ np.asarray(v, float)).round(4)
                order = np.lexsort((ids[a:b], -scores))[:n]
                out.append(pd.DataFrame({"q": row, "r": ids[a:b][order], "score": scores[order], "compared": [b - a] + [0] * (len(order) - 1) if len(order) else []}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "r": [], "score": [], "compared": []}).astype({"q": "int64", "r": "int64", "score": "float64", "compared": "int64"})

    keys = ["key", "list", "part"]
    return asked.groupBy(*keys).cogroup(index.rows.groupBy(*keys)).applyInPandas(best, "q long, r long, score double, compared long")


def search(index: Index, queries: DataFrame, key: str, n: int = 1, least: float = -1.0, probes: int = 3, exact: bool = True) -> DataFrame:
    """Top ``n`` rows of each query (q, key, qv) by cosine of at least ``least``: (q, r, score, compared), the smaller r on ties to four decimals.

    Each query first looks into the ``probes`` lists that can hold the nearest rows. With ``exact`` it then looks into all others
    that its n-th best leaves open, so the answer is that of a search of all rows; without, it may miss some. ``compared`` adds
    up to the rows that were multiplied.
    """
    sent = queries.sparkSession.sparkContext.broadcast(index.centres)

    def angles(batches):
        for rows in batches:
            cos = np.stack(rows.qv.to_numpy()) @ sent.value.T if len(rows) else np.zeros((0, 1))
            yield rows[["q", "key", "qv"]].assign(angles=list(np.arccos(np.clip(cos, -1, 1))))

    asked = queries.select("q", F.col(key).alias("key"), F.col("qv").cast("array<double>").alias("qv")).mapInPandas(angles, "q long, key string, qv array<double>, angles array<double>")
    reached = asked.join(index.lists, "key").withColumn("angle", F.get("angles", F.col("list"))).withColumn("bound", F.greatest(F.col("angle") - F.col("reach"), F.lit(0.0)))
    reached = scratch.table(reached.withColumn("_p", F.row_number().over(Window.partitionBy("q").orderBy("angle", "list"))).drop("angles"), "vector-probes")
    most = float(np.arccos(np.clip(least, -1, 1)))
    open_ = lambda rows, far: rows.withColumn("far", F.least(F.lit(most), far)).where(F.col("bound") <= F.col("far") + 1e-6)
    found = scratch.table(_products(open_(reached.where(F.col("_p") <= probes), F.lit(4.0)), index, n), "vector-near")
    if exact:
        best = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "r"))).where(F.col("_r") == n)
        rest = reached.where(F.col("_p") > probes).join(best.select("q", F.acos(F.greatest(F.col("score") - 1e-4, F.lit(-1.0))).alias("_far")), "q", "left")
        found = found.unionByName(_products(open_(rest, F.coalesce("_far", F.lit(4.0))), index, n))
    spent = F.sum("compared").over(Window.partitionBy("q"))
    ranked = found.withColumn("compared", spent).withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "r")))
    return ranked.where((F.col("_r") <= n) & (F.col("score") >= least)).drop("_r")
