"""Benchmark decontamination by a prefix-filtered join of shingles with exact window verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import in_small_batches, materialise, sized

#: Benchmark shingles are sent to all tasks in blocks of at most so many.
BLOCK_SHINGLES = 500_000
_FILTER_BITS = 20


class HashSet:
    """Membership of many 64-bit hashes at once: a bitmap of their low bits, then a binary search of what passes."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values.astype(np.uint64))
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[(self.values & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.values, hashes[maybe]), len(self.values) - 1)
        return maybe[self.values[at] == hashes[maybe]]


def _windows(window: int, shingle: int):
    """Benchmark rows -> one row per window with its word hashes, and its shingles with their offsets."""

    def run(batches):
        for batch in H.slices(batches, 1):
            words, at = H.words(*H.buffers(batch.column(1)), H.ALNUM)
            item, hashes, grams, sizes, gram_sizes = [], [], [], [0], [0]
            for i in range(batch.num_rows):
                w = words[at[i] : at[i + 1]]
                size = min(window, len(w))
                for j in range(len(w) - size + 1 if size else 0):
                    part = w[j : j + size]
                    g = H.shingles(part, shingle)
                    item.append(batch.column(0)[i].as_py())
                    hashes.append(part)
                    grams.append(g)
                    sizes.append(sizes[-1] + size)
                    gram_sizes.append(gram_sizes[-1] + len(g))
            flat = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (hashes, grams)]
            lists = [pa.ListArray.from_arrays(pa.array(s, pa.int32()), pa.array(f)) for s, f in zip((sizes, gram_sizes), flat)]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), *lists], ["item_id", "words", "grams"])

    return run


def _gram_positions(words: np.ndarray, size: int, wanted: HashSet) -> tuple[np.ndarray, np.ndarray]:
    if len(words) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = H.shingles(words, size)
    at = wanted.positions(g)
    return at, g[at]


def _frequencies(sent, sizes: list[int]):
    def run(batches):
        wanted = HashSet(sent.value)
        for batch in H.slices(batches, 0):
            words, at = H.words(*H.buffers(batch.column(0)), H.ALNUM)
            seen = []
            for i in range(batch.num_rows):
                found = [_gram_positions(words[at[i] : at[i + 1]], s, wanted)[1] for s in sizes]
                seen.append(np.unique(np.concatenate(found)))
            grams, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    return run


_PROBE = pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64()), ("before", pa.int64()), ("context", pa.list_(pa.int64()))]))
_ROW = "doc_id long, n_words long, md5 string"


def _probes(sent, sizes: list[int], window: int):
    """Documents -> their word counts and every place of a wanted prefix shingle with the words around it."""

    def run(batches):
        wanted = HashSet(sent.value)
        for batch in H.slices(batches, 1):
            data, offsets = H.buffers(batch.column(1))
            words, at = H.words(data, offsets, H.ALNUM)
            probes, md5 = [], []
            for i in range(batch.num_rows):
                w = words[at[i] : at[i + 1]]
                found = []
                for s in sizes:
                    for pos, gram in zip(*_gram_positions(w, s, wanted)):
                        first = max(0, pos - (window - s))
                        found.append({"pos": int(pos), "gram": int(gram.view(np.int64)), "before": int(pos - first), "context": w[first : pos + window].view(np.int64).tolist()})
                probes.append(found)
                md5.append(hashlib.md5(data[offsets[i] : offsets[i + 1]]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(md5), pa.array(probes, _PROBE)], ["doc_id", "n_words", "md5", "probes"])

    return run


def _send(spark: SparkSession, grams: DataFrame):
    """Broadcast a counted block of shingle hashes."""
    return spark.sparkContext.broadcast(np.array([r[0] for r in grams.collect()], np.int64).view(np.uint64))


@in_small_batches
def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item, or all its words if it has fewer. Shingles of a window (``shingle``
    words, or all its words if fewer) are ordered by the number of documents that hold them. As a contained window has
    all its shingles in the document, the join needs one prefix shingle of each window, its rarest. Documents emit only
    places of prefix shingles; the join with the windows applies the bounds on position and length and compares the whole
    window's word hashes (64 bits a word). A benchmark of more than ``block_shingles`` shingles is joined block by block.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_md5, one row per input row. Null or empty
    text has no words; items without words match nothing; repeated items count once by id; items with a null id hit words
    but are not listed. An empty table on either side is allowed; texts of any length are
    read whole; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_windows(window, shingle), "item_id long, words array<bigint>, grams array<bigint>")
    windows = materialise(items.withColumn("window", F.xxhash64("item_id", "words")), "leak-windows")
    sizes = [r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle)).alias("s")).distinct().orderBy("s").collect()]
    grams = windows.select(F.explode("grams").alias("gram")).distinct()
    blocks = max(1, -(-grams.count() // block_shingles))
    windows = windows.withColumn("block", F.pmod(F.col("window"), F.lit(blocks)).cast("int"))

    rows, hits = None, []
    for b in range(blocks):
        own = windows.where(F.col("block") == b)
        df = source.select("text").mapInArrow(_frequencies(_send(spark, own.select(F.explode("grams")).distinct()), sizes), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("df"))
        places = own.select("item_id", "window", "words", F.posexplode("grams").alias("offset", "gram")).join(sized(df), "gram")
        rarest = Window.partitionBy("item_id", "window").orderBy("df", "gram", "offset")
        prefix = materialise(places.withColumn("r", F.row_number().over(rarest)).where("r = 1").select("gram", "offset", "item_id", F.col("words").alias("window_words")), "leak-prefix")
        probed = materialise(source.mapInArrow(_probes(_send(spark, prefix.select("gram").distinct()), sizes, window), f"{_ROW}, probes array<struct<pos: bigint, gram: bigint, before: bigint, context: array<bigint>>>"), "leak-probes")
        rows = probed.drop("probes") if rows is None else rows
        found = probed.select("doc_id", "md5", "n_words", F.explode("probes").alias("p")).select("doc_id", "md5", "n_words", "p.*").join(sized(prefix), "gram")
        found = found.where("offset <= before and pos - offset + size(window_words) <= n_words")
        found = found.where("slice(context, int(before - offset + 1), size(window_words)) = window_words")
        hits.append(found.select("doc_id", "md5", (F.col("pos") - F.col("offset")).alias("start"), (F.col("pos") - F.col("offset") + F.size("window_words")).alias("end"), "item_id"))
    hit = hits[0]
    for h in hits[1:]:
        hit = hit.unionByName(h)
    # equal rows have equal hits, so rows are told apart by id and text, which are the same in every scan
    so_far = Window.partitionBy("doc_id", "md5").orderBy("start", "end", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(so_far), F.lit(0))))
    per = hit.withColumn("new", new).groupBy("doc_id", "md5").agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per = sized(materialise(per.withColumnsRenamed({"doc_id": "_id", "md5": "_md5"}), "leak-hits"))
    out = rows.join(per, rows["doc_id"].eqNullSafe(per["_id"]) & (rows["md5"] == per["_md5"]), "left")
    items_text = F.coalesce(F.concat_ws(",", "items"), F.lit(""))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(items_text, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("md5").alias("text_md5"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; columns stay as they are."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated")
    bad = materialise(bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_md5").alias("_bad_md5")).distinct(), "leak-bad")
    same = docs[id_col].cast("long").eqNullSafe(bad["_bad_id"]) & (F.md5(F.coalesce(docs[text_col], F.lit(""))) == bad["_bad_md5"])
    return docs.join(sized(bad), same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.drop("text_md5")


ORACLE_SQL = r"""
with lowered as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
sized as (select item_id, w, least(10, len(w)) as n from items where len(w) > 0),
windows as (
  select distinct item_id, n, array_to_string(list_slice(w, j, j + n - 1), ' ') as g
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as j from sized)),
grams as (
  select doc_id, j, n, array_to_string(list_slice(w, j, j + n - 1), ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as j from lowered, (select distinct n from windows) where len(w) >= n)),
hits as (select doc_id, item_id, j, grams.n from grams join windows using (n, g)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(j, j + n)) as p from hits) group by doc_id),
listed as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
select l.doc_id, cast(len(l.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from lowered l left join covered using (doc_id) left join listed using (doc_id)
"""
