"""Fuzzy line deduplication: MinHash bands over character shingles, exact Jaccard, one line kept per component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import in_small_batches, materialise, sized
from .grouping import linked

_LINES = "row long, doc_id long, line int, node long, text string, bands array<bigint>"
#: Shingles hashed at a time: they stay in the cache.
_STEP = 1 << 15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _shingle_codes(data: np.ndarray, shingle: int, dtype=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``shingle`` lower-cased (A-Z) characters from each character on, and where the characters begin.

    The last ones are cut short. Characters are UTF-8 sequences, so none is cut in half.
    """
    head = np.flatnonzero((data & 0xC0) != 0x80)
    low = np.frombuffer(H.LOWER[data].tobytes().decode().encode("utf-32-le"), np.uint32).astype(dtype)
    low += dtype(17)
    total = np.zeros(len(low), dtype)
    times = (H.random_words(64, 5) >> np.uint64(64 - 8 * total.itemsize)).astype(dtype) | dtype(1)
    for j in range(min(shingle, len(low))):
        total[: len(low) - j] += low[j:] * times[j % 64]
    if dtype is np.uint64:
        return H.mix(total), head
    total ^= total >> dtype(15)
    total *= dtype(0x2C1B3C6D)
    total ^= total >> dtype(12)
    return total, head


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all lines, without their outer blanks."""
    breaks = np.flatnonzero(data == 10)
    of_break = np.searchsorted(offsets, breaks, "right") - 1
    rows = np.concatenate([of_break, np.arange(len(offsets) - 1)])
    ends = np.concatenate([breaks, offsets[1:]])
    order = np.lexsort((ends, rows))
    rows, ends = rows[order], ends[order]
    if not len(rows):
        return ends, ends, rows
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    starts = np.where(first, offsets[rows], np.concatenate([[0], ends[:-1] + 1]))
    solid = np.flatnonzero(~_BLANK[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = a < b
    starts[some], ends[some] = solid[a[some]], solid[b[some] - 1] + 1
    ends[~some] = starts[~some]
    return starts, ends, rows


class Signatures:
    """Bands of ``width`` MinHash values of 16 bits, packed into a long each; together they are a set's signature."""

    def __init__(self, bands: int, width: int) -> None:
        self.bands, self.width = bands, width
        r = H.random_words(2 * bands * width, 3) >> np.uint64(32)
        self.flip = r[: bands * width].astype(np.uint32)
        self.times = r[bands * width :].astype(np.uint32) | np.uint32(1)

    def of(self, codes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Signatures of the sets codes[start : start + count], none empty."""
        k, at = self.bands * self.width, 0
        low = np.empty((len(starts), k), np.uint16)
        upto = np.cumsum(counts)
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _STEP, "right")))
            flat = np.concatenate([codes[a : a + n] for a, n in zip(starts[at:to], counts[at:to])])
            cuts = np.concatenate([[0], np.cumsum(counts[at:to])[:-1]])
            work = np.empty_like(flat)
            for c in range(k):
                np.bitwise_xor(flat, self.flip[c], out=work)
                np.multiply(work, self.times[c], out=work)
                least = np.minimum.reduceat(work, cuts)
                low[at:to, c] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
            at = to
        return low.view(np.uint64).reshape(len(starts), self.bands)


def _lines(shingle: int, bands: int):
    """Documents -> lines; those that are new in their slice of documents carry their text and signature."""

    def run(batches):
        signatures = Signatures(bands, 4)
        row = TaskContext.get().partitionId() << 40
        for batch in H.slices(batches, 1):
            data, offsets = H.buffers(batch.column(1))
            starts, ends, rows = _spans(data, offsets)
            line = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
            raw = H.LOWER[data].tobytes()
            node = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
            new = np.zeros(len(node), bool)
            new[np.unique(node, return_index=True)[1]] = True
            post = np.flatnonzero(new & (ends > starts))
            codes, head = _shingle_codes(data, shingle, np.uint32)
            a, b = np.searchsorted(head, starts[post]), np.searchsorted(head, ends[post])
            whole = b - a >= shingle  # a shorter line is like no other
            post, a, b = post[whole], a[whole], b[whole]
            packed = signatures.of(codes, a, b - a - shingle + 1)
            sizes = np.zeros(len(node), np.int64)
            sizes[post] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(packed.reshape(-1).view(np.int64)))
            text = [None] * len(node)
            for i in post.tolist():
                text[i] = raw[starts[i] : ends[i]].decode()
            yield pa.RecordBatch.from_arrays([pa.array(rows + row), batch.column(0).take(pa.array(rows)), pa.array(line, pa.int32()), pa.array(node.view(np.int64)), pa.array(text, pa.string()), lists], ["row", "doc_id", "line", "node", "text", "bands"])
            row += batch.num_rows

    return run


def _similar(shingle: int, percent: int, bands: int, agreeing: int):
    """Lines as (signature, text, band): similar if ``agreeing`` coordinates agree and the Jaccard of their shingle sets is ``percent``.

    Two lines are compared only in the first of the bands that they share. A set is made once for each column, and only of
    a line that agrees with another.
    """

    def similar(payload: pa.StructArray):
        signature, text, band = payload.flatten()
        packed = signature.flatten().to_numpy(zero_copy_only=False).reshape(-1, bands)
        grid = packed.view(np.uint16)
        here = band.to_numpy(zero_copy_only=False)
        made: dict[int, np.ndarray] = {}

        def prepare(rows: list[int]) -> None:
            rows = [i for i in rows if i not in made]
            if not rows:
                return
            data, offsets = H.buffers(text.take(pa.array(rows, pa.int64())))
            codes, head = _shingle_codes(data, shingle)
            at = np.searchsorted(head, offsets)
            for i, a, b in zip(rows, at[:-1].tolist(), at[1:].tolist()):
                made[i] = H.distinct(codes[a : max(a + 1, b - shingle + 1)])

        def likely(i, j) -> np.ndarray:
            out = (packed[j] == packed[i]).argmax(1) == here[i]
            return out & ((grid[j] == grid[i]).sum(1) >= agreeing)

        def compare(i: int, others: np.ndarray) -> np.ndarray:
            out = likely(i, others)
            some = np.flatnonzero(out)
            prepare([i, *others[some].tolist()] if len(some) else [])
            for k in some:
                a, b = made[i], made[int(others[k])]
                least, most = sorted((len(a), len(b)))
                if percent * most > 100 * least:
                    out[k] = False
                    continue
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                out[k] = 100 * both >= percent * (len(a) + len(b) - both)
            return out

        compare.prepare = prepare
        compare.likely = likely
        return compare

    return similar


def _rooms(met: DataFrame, block: int, block_mb: int) -> DataFrame:
    """Bands in which nodes meet (key, blocks) from (node, n, band, key): of bands with the same nodes the first one.

    Two lines are compared only in the first band that they share, so nothing would be compared in the others.
    """
    room = met.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("node")).alias("nodes"))
    first = room.groupBy("nodes", "rows").agg(F.min_by("key", "band").alias("key"), F.min("n").alias("n"))
    return first.select("key", F.greatest(F.ceil(F.col("rows") / F.lit(block)), F.ceil(F.col("n") * 8 / F.lit(block_mb << 20))).cast("long").alias("blocks"))


@in_small_batches
def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 8, percent: int = 80, bands: int = 12, agreeing: int = 27, block: int = 256, block_mb: int = 8) -> DataFrame:
    """Lines of ``docs`` with their component: row, doc_id, line (from 0), component, kept.

    Lines are compared without case (A-Z) and outer blanks. Equal lines are one node. Nodes that share a band of four
    MinHash values over shingles of ``shingle`` characters are compared if ``agreeing`` of all 4 * ``bands`` values agree, on full
    shingle sets, and a Jaccard of ``percent`` links them. A pair of 80 % is missed with a chance of 0.002. Bands that hold the same
    nodes are compared once. Of each component
    the first line by (doc_id, row, line) is kept. A line shorter than a shingle is one shingle, so it equals another
    or shares nothing with it. Empty lines are all kept.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = materialise(source.mapInArrow(_lines(shingle, bands), _LINES), "line-rows")
    new = lines.where("text is not null")
    posted = new.select("node", F.length("text").alias("n"), F.posexplode("bands").alias("band", "value")).select("node", "n", "band", F.xxhash64("band", "value").alias("key"))
    shared = posted.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    shared = materialise(shared.select("key"), "line-bands")
    met = materialise(posted.join(sized(shared), "key").distinct(), "line-postings")
    keys = materialise(met.join(sized(materialise(_rooms(met, block, block_mb), "line-rooms")), "key").groupBy("node").agg(F.collect_list(F.struct("key", "blocks", "band")).alias("keys")), "line-keys")
    once = new.join(sized(keys.select("node")), "node").groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("text").alias("text"))
    once = materialise(once.withColumnRenamed("node", "unit"), "line-nodes")
    rows = keys.select(F.col("node").alias("unit"), F.explode("keys").alias("k")).select("k.key", "unit", "k.blocks", "k.band")

    def with_lines(groups: DataFrame) -> DataFrame:
        return once.join(sized(groups), "unit").withColumn("payload", F.struct("bands", "text", "band"))

    found = linked(rows, _similar(shingle, percent, bands, agreeing), "line-links", with_lines, ["band"]).select("node", F.col("root").alias("component"))

    marked = lines.select("row", "doc_id", "line", "node").join(sized(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    marked = materialise(marked, "line-marked")
    empty = int(np.uint64(xxhash.xxh3_64_intdigest(b"")).astype(np.int64))
    first = marked.where(F.col("component") != empty).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "line")).alias("first")).where("n > 1").drop("n")
    out = marked.join(sized(materialise(first, "line-first")), "component", "left")
    kept = F.col("first").isNull() | ((F.col("first.row") == F.col("row")) & (F.col("first.line") == F.col("line")))
    return out.select("row", "doc_id", "line", "component", kept.alias("kept"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_kept, dropped (numbers of the lines that go, sorted).

    A null or empty text is one empty line. Repeated rows lose all lines but empty ones to the first of them. Null ids come
    first, and their lines are compared like all others. Ties go to the earlier row of the input's order. Long texts and lines
    are compared whole; other columns, whatever their names, are ignored; an empty table gives none.
    """
    lines = fuzzy_lines(docs, **options)
    out = lines.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_lines"), F.count_if("kept").alias("n_kept"), F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("line")))).alias("dropped"))
    return out.select("doc_id", "n_lines", "n_kept", "dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
