"""MinHash near-duplicate removal by a signature-coordinate inverted join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import in_small_batches, materialise, sized
from .grouping import jaccard, linked

#: A token holds its coordinate in its lowest bits.
COORDINATE_BITS = 6
_SETS = "doc_id long, n_shingles long, set_hi long, set_lo long, tokens array<bigint>"


def _sets(shingle: int, k: int):
    def run(batches):
        minhash = H.MinHash(k)
        low = np.uint64((1 << COORDINATE_BITS) - 1)
        for batch in H.slices(batches, 1):
            words, at = H.words(*H.buffers(batch.column(1)))
            n, hi, lo, tokens, sizes = [], [], [], [], [0]
            for i in range(batch.num_rows):
                s = H.distinct(H.shingles(words[at[i] : at[i + 1]], shingle))
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                hi.append((digest >> 64) - (1 << 63))
                lo.append((digest & ((1 << 64) - 1)) - (1 << 63))
                if len(s):
                    tokens.append((minhash.tokens(s) & ~low) | np.arange(k, dtype=np.uint64))
                sizes.append(sizes[-1] + (k if len(s) else 0))
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists], ["doc_id", "n_shingles", "set_hi", "set_lo", "tokens"])

    return run


def agreeing(k: int, at_least: int):
    """Lists of shared tokens, at most one a coordinate: similar if ``at_least`` of them agree."""

    def similar(payload):
        flat = payload.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        m = len(payload)
        rows = np.repeat(np.arange(m), payload.value_lengths().to_numpy(zero_copy_only=False))
        grid = np.arange(m * k, dtype=np.uint64).reshape(m, k)  # no token is below m * k but by chance of 2**-40
        grid[rows, (flat & np.uint64((1 << COORDINATE_BITS) - 1)).astype(np.int64)] = flat

        def compare(i, others) -> np.ndarray:
            return (grid[others] == grid[i]).sum(1) >= at_least

        compare.likely = compare
        return compare

    return similar


def _stored_sets(payload: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in payload]


def _full_sets(shingle: int, lists: bool = False):
    """(text, group, unit, tree) -> the last three and the text's set, as bytes or a list."""

    def run(batches):
        for batch in H.slices(batches, 0):
            words, at = H.words(*H.buffers(batch.column(0)))
            sets = [H.distinct(H.shingles(words[at[i] : at[i + 1]], shingle)) for i in range(batch.num_rows)]
            payload = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())) if lists else pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], payload], ["group", "unit", "tree", "payload"])

    return run


@in_small_batches
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85, k: int = 32, at_least: int = 16, block: int = 256, block_mb: int = 16, posting_block: int = 1024) -> DataFrame:
    """Near-duplicate components of ``docs``: one row per input row with doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets form a class and go on as its smallest id. A class posts itself under each of its
    ``k`` (coordinate, value) pairs. A linked pair must agree in ``at_least`` of them (at 85 % a miss has a chance of about
    two in a million), so each class keeps only the prefix of its rarest shared pairs in which any such partner must
    show up, and classes with fewer shared pairs than that drop out. Within a posting, agreements are counted and only a
    spanning forest of the matches is kept; its components are the groups in which links are then confirmed on full
    sets. Large postings and groups are dealt to blocks that meet their smallest member first, and only what is then still
    apart is compared across blocks, so no task holds a group and a large group of copies costs its rows, not their pairs.
    Across blocks of a group, sets meet on the rarest shingles of each, a prefix that no link can avoid, so that pages from one
    template are compared in pairs only as far as the shingles of their own leave room in their prefixes.

    Empty or null text, or text without words: n_shingles 0, linked with nothing, kept. A text of fewer words than
    ``shingle`` is one shingle. A null id: its row has a null component and is kept. Rows of one id
    count as one document: a link of one of their texts is a link of the id.
    Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    if k > 1 << COORDINATE_BITS:
        raise ValueError(f"k may be at most {1 << COORDINATE_BITS}")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(source.mapInArrow(_sets(shingle, k), _SETS), "near-sets")
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("set_hi", "set_lo")
    reps = materialise(classes.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("tokens").alias("tokens")), "near-classes")

    posted = reps.select("doc_id", "set_hi", "set_lo", F.explode("tokens").alias("token"))
    often = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posted.join(often, "token").groupBy("doc_id", "set_hi", "set_lo").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s")).where(F.size("s") >= at_least)
    shared = materialise(shared.select(F.xxhash64("set_hi", "set_lo").alias("set"), F.col("doc_id").alias("unit"), "s"), "near-shared")
    prefix = shared.select("unit", "set", F.explode(F.expr(f"slice(s, 1, size(s) - {at_least} + 1)")).alias("p"))
    prefix = prefix.select(F.col("p.token").alias("key"), "unit", "set", F.ceil(F.col("p.df") / F.lit(posting_block)).alias("blocks"))
    tokens = shared.select("set", F.col("s.token").alias("payload"))
    clusters = linked(prefix, agreeing(k, at_least), "near-matches", lambda groups: tokens.join(sized(groups), "set"), ["set"])

    members = materialise(reps.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n_shingles").alias("n_shingles")).join(sized(clusters), "node"), "near-members")
    room = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n_shingles") * 8 / F.lit(block_mb << 20))).alias("blocks"))
    placed = members.join(sized(room), "root").select(F.col("node").alias("unit"), F.col("root").alias("key"), "blocks")

    def with_sets(groups: DataFrame) -> DataFrame:
        texts = source.join(sized(groups), F.col("doc_id") == F.col("unit")).select("text", "group", "unit", "tree")
        return texts.mapInArrow(_full_sets(shingle), "group long, unit long, tree long, payload binary")

    def sets_of(rest: DataFrame) -> DataFrame:
        texts = source.join(sized(rest), F.col("doc_id") == F.col("unit")).select("text", F.col("key").alias("group"), "unit", "tree")
        lists = texts.mapInArrow(_full_sets(shingle, True), "group long, unit long, tree long, payload array<bigint>")
        return lists.where("size(payload) > 0").withColumnsRenamed({"group": "key", "payload": "elements"})

    linked_sets = linked(placed, jaccard(percent, _stored_sets), "near-links", with_sets, None, sets_of, percent, block, block_mb)

    label = reps.select("set_hi", "set_lo", "doc_id", "copies").join(sized(linked_sets), F.col("node") == F.col("doc_id"), "left").where("copies > 1 or root is not null")
    label = label.select("set_hi", "set_lo", F.coalesce("root", "doc_id").alias("component"))
    out = sets.where("n_shingles > 0").join(label, ["set_hi", "set_lo"], "left").unionByName(sets.where("n_shingles = 0").withColumn("component", F.lit(None).cast("long")), allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose component keeps another id; columns and row order within files stay."""
    gone = materialise(near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    return docs.join(sized(gone), docs[id_col].cast("long") == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from d),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
pairs as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach(a, b) as (select doc_id, doc_id from s union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join roots using (doc_id)
"""
