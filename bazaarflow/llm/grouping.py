"""Similar pairs in groups of any size: spanning forests, components, and no group in one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import components, materialise, sized, stars

_EDGES = "a long, b long"
#: Matches that a task holds before it sends them on.
_HELD = 50_000
#: Groups of so many rows are taken together.
_FEW = 8


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _runs(batches):
    """Rows sorted by group -> (units, trees, payload, [(start, end)]) with the groups of two rows or more, over batch ends too.

    The groups inside a batch come together, with the batch's columns.
    """
    open_key, parts = None, []

    def closed():
        units, trees = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        return units, trees, pa.concat_arrays([p[2] for p in parts]), [(0, len(units))]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, units, trees = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        payload = batch.column(3)
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        if parts and keys[0] != open_key:
            if sum(len(p[0]) for p in parts) > 1:
                yield closed()
            parts = []
        end = int(bounds[1])
        parts.append((units[:end], trees[:end], payload.slice(0, end)))
        if len(bounds) > 2:
            if sum(len(p[0]) for p in parts) > 1:
                yield closed()
            inner = np.flatnonzero(np.diff(bounds)[1:-1] > 1) + 1
            if len(inner):
                yield units, trees, payload, list(zip(bounds[inner].tolist(), bounds[inner + 1].tolist()))
            start = int(bounds[-2])
            parts = [(units[start:], trees[start:], payload.slice(start))]
        open_key = keys[-1]
    if sum(len(p[0]) for p in parts) > 1:
        yield closed()


def _small(units, trees, ranges, compare, likely, found: list) -> list:
    """Groups of a few rows, most of all, with the likely pairs of all of them told at once; gives the ranges that are left."""
    sizes = ranges[:, 1] - ranges[:, 0]
    pairs = []
    for m in range(2, _FEW + 1):
        starts = ranges[sizes == m, 0]
        if len(starts):
            i, j = (np.add.outer(starts, k).reshape(-1) for k in np.triu_indices(m, 1))
            some = np.flatnonzero((trees[i] != trees[j]) & likely(i, j))
            pairs += zip(i[some].tolist(), j[some].tolist())
    if pairs and (prepare := getattr(compare, "prepare", None)):
        prepare(sorted({i for pair in pairs for i in pair}))
    joined: dict = {}
    for a, b in pairs:
        x, y = a, b
        while x in joined:
            x = joined[x]
        while y in joined:
            y = joined[y]
        if x != y and compare(a, np.array([b]))[0]:
            joined[max(x, y)] = min(x, y)
            found.append((units[a], units[b]))
    return ranges[sizes > _FEW].tolist()


def forest(similar: Callable) -> Callable:
    """Arrow rows sorted by group and unit (group, unit, tree, payload) -> a spanning forest of each group's similar pairs, those of a task joined.

    ``similar(payload)`` takes a payload column and gives a function i, others -> which of the rows ``others`` are similar to
    row i; its attribute ``likely``, if it has one, rules out most pairs i, j (arrays) at once, and ``prepare`` makes what it needs of many rows together. Units of one tree are linked
    already and are not compared.
    """

    def run(batches):
        found: list[tuple[int, int]] = []
        for units, trees, payload, ranges in _runs(batches):
            compare = similar(payload)
            if likely := getattr(compare, "likely", None):
                ranges = _small(units, trees, np.array(ranges), compare, likely, found)
            for start, end in ranges:
                tree = np.unique(trees[start:end], return_inverse=True)[1]
                left = int(tree.max())
                for i in range(end - start - 1):
                    if not left:
                        break
                    others = np.flatnonzero(tree[i + 1 :] != tree[i]) + i + 1
                    if not len(others):
                        continue
                    for j in others[compare(start + i, start + others)]:
                        if tree[j] != tree[i]:
                            tree[tree == tree[j]] = tree[i]
                            found.append((units[start + i], units[start + j]))
                            left -= 1
            if len(found) > _HELD:
                yield _edges(found)
                found = []
        yield _edges(found)

    return lambda batches: stars(run(batches))


def jaccard(percent: int, members: Callable) -> Callable:
    """Sets of 64-bit hashes, made by ``members`` from a payload: similar if 100 * intersection >= percent * union.

    One set is marked in the group's own numbering, and sums over the others' marks give its intersections with all. No set
    is empty.
    """

    def similar(payload):
        sets = members(payload)
        size = np.array([len(s) for s in sets], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        local = np.unique(np.concatenate(sets), return_inverse=True)[1]
        marks = np.zeros(local.max() + 1 if len(local) else 0, np.int32)

        def compare(i, others):
            # sizes alone rule out most pairs of unlike lengths
            near = 100 * np.minimum(size[i], size[others]) >= percent * np.maximum(size[i], size[others])
            out = np.zeros(len(others), bool)
            kept = others[near]
            if not len(kept):
                return out
            own = local[start[i] : start[i + 1]]
            marks[own] = 1
            lo, hi = int(kept[0]), int(kept[-1]) + 1
            if 4 * len(kept) > hi - lo:
                both = np.add.reduceat(marks[local[start[lo] : start[hi]]], start[lo:hi] - start[lo])[kept - lo]
            else:
                both = np.array([marks[local[start[j] : start[j + 1]]].sum() for j in kept])
            marks[own] = 0
            out[near] = 100 * both >= percent * (size[i] + size[kept] - both)
            return out

        return compare

    return similar


def prefixed(percent: int) -> Callable:
    """Rows (elements, pos, role) of a posting of ``_prefixes``: ``jaccard`` of the pairs that sizes, positions and roles leave."""
    full = jaccard(percent, lambda lists: np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]))

    def similar(payload: pa.StructArray):
        elements, pos, role = payload.flatten()
        exact = full(elements)
        size = elements.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        left = size - pos.to_numpy(zero_copy_only=False)
        role = role.to_numpy(zero_copy_only=False)

        def compare(i, others):
            # of a pair's first shared element at the latest, all it shares lies from there on
            out = (role[i] | role[others]) & ((100 + percent) * np.minimum(left[i], left[others]) >= percent * (size[i] + size[others]))
            if out.any():
                out[out] = exact(i, others[out])
            return out

        return compare

    return similar


def _prefixes(rest: DataFrame, sets: Callable, percent: int, block: int, block_mb: int) -> tuple[DataFrame, DataFrame]:
    """Postings (key, unit, tree, set, pos, role, blocks) in which each pair of ``percent`` of a key meets, and the sets themselves.

    A set's elements are ordered by their number of sets within the key. Two similar sets share an element of the larger one's
    first n - ceil(p n) + 1 and of the smaller one's first n - ceil(2 p n / (1 + p)) + 1; ``role`` tells the latter. Elements of one set alone
    come first and have no posting, so a set meets none where they fill its prefix: at 85 %, pages from one template of whose shingles 8 % are
    their own meet only those of fewer, and of 15 % none.
    """
    full = materialise(sets(rest).withColumn("set", F.xxhash64("elements")).dropDuplicates(["key", "unit", "set"]), "group-sets")
    each = full.select("key", "unit", "tree", "set", F.size("elements").cast("long").alias("n"), F.explode("elements").alias("e"))
    often = materialise(each.groupBy("key", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "group-often")
    own = Window.partitionBy("key", "unit", "set")
    shared = each.join(sized(often), ["key", "e"]).withColumn("pos", F.expr("n - 1") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "e")))
    shared = shared.where(f"pos <= n - ({percent} * n + 99) div 100").withColumn("role", F.expr(f"pos <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent}"))
    posted = materialise(shared.select(F.xxhash64("key", "e").alias("key"), "unit", "tree", "set", "n", "pos", "role"), "group-prefixes")
    room = posted.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n") * 8 / F.lit(block_mb << 20))).cast("long").alias("blocks"), F.min("tree").alias("lo"), F.max("tree").alias("hi"), F.max("role").alias("role"))
    room = materialise(room.where("lo < hi and role").select("key", "blocks"), "group-rooms")
    return posted.join(sized(room), "key"), full.select("unit", "set", "elements")


def _across_trees(big: DataFrame) -> DataFrame | None:
    """Groups (group, unit, tree, ...) that meet the units of different trees in the keys of ``big``; None if no key has two trees.

    A tree with more rows than a block is dealt to blocks of its own, smaller ones share blocks. Only pairs of blocks that can
    hold two trees become groups, so a key in which one tree holds nearly all rows costs its rows times the few others'.
    Rows whose ``role`` is false meet those of a true one only.
    """
    keys = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("blocks").alias("blocks"), F.min("tree").alias("lo"), F.max("tree").alias("hi")).where("lo < hi")
    keys = materialise(keys.select("key", F.ceil(F.col("n") / F.col("blocks")).alias("room")), "group-keys")
    if keys.isEmpty():
        return None
    rest = big.join(sized(keys), "key")
    per = rest.groupBy("key", "tree", "role", "room").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") > F.col("room")
    per = materialise(per.select("key", "role", "room", "n", own.alias("own"), F.when(own, F.col("tree")).otherwise(F.lit(0)).alias("cls")), "group-trees")
    classes = materialise(per.groupBy("key", "own", "cls", "role").agg(F.ceil(F.sum("n") / F.max("room")).alias("parts")), "group-classes")
    named = lambda s: classes.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("own", "cls", "role", "parts")])
    pairs = named("a").join(named("b"), "key").where("(role_a or role_b) and not (own_a and own_b and cls_a = cls_b)")
    pairs = pairs.where("(own_a, cls_a, role_a) <= (own_b, cls_b, role_b)")
    pairs = pairs.withColumn("i", F.explode(F.expr("sequence(0L, parts_a - 1)"))).withColumn("j", F.explode(F.expr("sequence(0L, parts_b - 1)")))
    pairs = pairs.where("(own_a, cls_a, role_a) <> (own_b, cls_b, role_b) or i <= j").withColumn("group", F.xxhash64("key", "own_a", "cls_a", "role_a", "i", "own_b", "cls_b", "role_b", "j"))
    side = lambda s, part: pairs.select("key", *[F.col(f"{c}_{s}").alias(c) for c in ("own", "cls", "role")], F.col(part).alias("part"), "group")
    sides = side("a", "i").unionByName(side("b", "j")).distinct()
    owners = per.where("own").select("key", F.col("cls").alias("tree"), "role", F.lit(True).alias("own"))
    placed = rest.join(sized(owners), ["key", "tree", "role"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    placed = placed.withColumn("cls", F.when(F.col("own"), F.col("tree")).otherwise(F.lit(0))).join(sized(classes), ["key", "own", "cls", "role"])
    placed = placed.withColumn("part", F.expr("pmod(xxhash64(if(own, unit, tree), key), parts)"))
    return placed.join(sides, ["key", "own", "cls", "role", "part"])


def linked(rows: DataFrame, similar: Callable, label: str, payload: Callable | None = None, keep: list[str] | None = None, sets: Callable | None = None, percent: int = 0, block: int = 256, block_mb: int = 16) -> DataFrame:
    """Components (node, root) of the units that ``similar`` links within a key: all pairs of a key count, few are compared.

    ``rows``: key, unit and blocks, the number of blocks that the key's rows are dealt to, and a payload; or, for a large
    one, ``payload`` adds it to rows of (group, unit, tree) and the columns to ``keep``. First each block is compared in itself and with its key's
    smallest unit, which links a group of copies at once; then, only in keys of several blocks whose units are not all in
    one component, the pairs of different components are. If ``similar`` is a Jaccard of ``percent``, ``sets`` may add the ``elements`` of
    the units' sets (array of long, distinct) to rows of (key, unit, tree): then only pairs that share an element of their prefixes are.
    No task holds more than two blocks, and what leaves it is a spanning forest.
    """
    columns = ["group", "unit", "tree", *(keep or [] if payload else ["payload"])]
    rows = materialise(rows.select("key", "unit", F.col("blocks").cast("long").alias("blocks"), *columns[3:]), f"{label}-rows")

    def forests(full: DataFrame, alike: Callable) -> DataFrame:
        return full.select("group", "unit", "tree", "payload").repartition("group").sortWithinPartitions("group", "unit").mapInArrow(forest(alike), _EDGES)

    def compared(groups: DataFrame) -> DataFrame:
        groups = groups.select(*columns)
        return forests(payload(groups) if payload else groups, similar)

    big = rows.where("blocks > 1")
    hubs = big.groupBy("key").agg(F.min_by(F.struct("unit", "blocks", *columns[3:]), "unit").alias("h")).select("key", "h.*")
    hubs = hubs.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).where("block <> pmod(xxhash64(unit, key), blocks)")
    dealt = rows.withColumn("block", F.expr("pmod(xxhash64(unit, key), blocks)")).unionByName(hubs)
    found = components(compared(dealt.select(F.xxhash64("key", "block").alias("group"), "unit", F.col("unit").alias("tree"), *columns[3:])), label)
    if big.isEmpty():
        return found
    big = big.join(sized(found), F.col("unit") == F.col("node"), "left").withColumn("tree", F.coalesce("root", "unit")).withColumn("role", F.lit(True)).drop("node", "root")
    if sets is None:
        more = _across_trees(big)
        edges = None if more is None else compared(more)
    else:
        apart = big.groupBy("key").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).where("lo < hi")
        apart = materialise(apart.select("key"), "group-apart")
        if apart.isEmpty():
            return found
        postings, full = _prefixes(big.join(sized(apart), "key").select("key", "unit", "tree"), sets, percent, block, block_mb)
        more = _across_trees(postings)
        edges = None
        if more is not None:
            more = materialise(more.select("group", "unit", "tree", "set", "pos", "role"), "group-more")
            edges = forests(full.join(sized(more), ["unit", "set"]).withColumn("payload", F.struct("elements", "pos", "role")), prefixed(percent))
    if edges is None:
        return found
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges), label)
