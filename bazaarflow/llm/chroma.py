"""Chroma audio fingerprints of media columns, aligned by offset histograms and bit errors, or by bit errors at every offset."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import in_small_batches, materialise

RATE = 8000
FRAME, HOP = 2048, 500
#: Filters over (frames wide, first pitch class, pitch classes high, shape), by rule: widths and shapes in turn.
WIDTH = 8
FILTERS = [(WIDTH if i % 2 else WIDTH // 2, i % 12, 2 + i % 5, i % 4) for i in range(16)]
#: A recording aligns at a part of differing bits of at most this.
MOST_ERRORS = 0.2
#: Frames that must overlap.
LEAST_OVERLAP = 24

_frequencies = np.fft.rfftfreq(FRAME, 1 / RATE)
_used = np.flatnonzero((_frequencies > 60) & (_frequencies < 2000))
_pitch = np.round(12 * np.log2(_frequencies[_used] / 440.0)).astype(int) % 12
_to_class = (_pitch[:, None] == np.arange(12)).astype(np.float32)
_taper = np.hanning(FRAME).astype(np.float32)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, each frame to unit length. ``pcm``: mono samples at ``RATE``."""
    if len(pcm) < FRAME:
        return np.empty((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), FRAME)[::HOP] * _taper
    energy = (np.abs(np.fft.rfft(frames, axis=1)[:, _used]) ** 2).astype(np.float32) @ _to_class
    return energy / np.maximum(np.sqrt((energy**2).sum(1, keepdims=True)), 1e-9)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed 32-bit integer per window of ``WIDTH`` frames: 16 filters of two bits from an integral image."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25), np.float64)
    image[1:, 1:] = np.hstack([frames, frames]).cumsum(0).cumsum(1)  # pitch classes wrap around
    t = np.arange(n)

    def area(a, b, c, d):
        return image[t + b, d] - image[t + a, d] - image[t + b, c] + image[t + a, c]

    out = np.zeros(n, np.uint32)
    for k, (w, low, high, shape) in enumerate(FILTERS):
        half, mid = w // 2, low + high // 2
        whole = area(0, w, low, low + high)
        part = (area(0, half, low, low + high), area(0, w, low, mid), area(0, half, low, mid) + area(half, w, mid, low + high), area(w // 4, w - w // 4, low, low + high))[shape]
        value = (2 * part - whole) / (whole + 0.05 * w)
        level = (value > -0.3).astype(np.uint32) + (value > 0.0) + (value > 0.3)
        out |= (level ^ (level >> np.uint32(1))).astype(np.uint32) << np.uint32(2 * k)
    return out


def melody(vector: np.ndarray, note: int = 1000) -> np.ndarray:
    """PCM of a vector: one tone per component, its pitch by the component's size in units of the vector's deviation."""
    v = np.nan_to_num(np.asarray(vector, np.float64))
    scale = v.std() or 1.0
    key = np.clip(np.round(v / scale * 6), -18, 18)
    phase = np.cumsum(np.repeat(2 * np.pi * 330.0 * 2 ** (key / 12) / RATE, note))
    return np.sin(phase)


def _prints(decode):
    def run(batches):
        for batch in batches:
            prints = [fingerprint(chroma(decode(x))) if x is not None else np.empty(0, np.uint32) for x in batch.column(1).to_pylist()]
            digest = [xxhash.xxh3_128_hexdigest(p.tobytes()) for p in prints]
            sizes = np.concatenate([[0], np.cumsum([len(p) for p in prints])])
            flat = np.concatenate(prints).astype(np.int64) if prints else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.string()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], ["id", "digest", "print"])

    return run


def _spectra(prints: list[np.ndarray], size: int) -> np.ndarray:
    """Spectra of the 32 bits as signs over time: (frequency, recording, bit)."""
    signs = np.zeros((len(prints), 32, size), np.float32)
    for i, p in enumerate(prints):
        signs[i, :, : len(p)] = 1 - 2 * ((p[None, :] >> np.arange(32)[:, None]) & 1)
    return np.ascontiguousarray(np.fft.rfft(signs, axis=2).astype(np.complex64).transpose(2, 0, 1))


def _by_length(ids, prints, cells: int):
    """(length, ids, prints) of recordings of one length, at most ``cells`` prints at a time."""
    prints = [np.asarray(p, np.int64) for p in prints]
    order = np.argsort([len(p) for p in prints], kind="stable")
    at = 0
    while at < len(order):
        n = len(prints[order[at]])
        to = at
        while to < len(order) and len(prints[order[to]]) == n and (to == at or (to - at + 1) * n <= cells):
            to += 1
        yield n, np.asarray(ids)[order[at:to]], [prints[i] for i in order[at:to]]
        at = to


def alignments(q_ids, q_prints, r_ids, r_prints, most: float, overlap: int) -> pd.DataFrame:
    """Best offset of each (query, record) that has one: fewest bit errors, then the longest overlap, then the nearest offset.

    Agreeing less differing bits at all offsets are a correlation of signs, summed over the 32 bits by one product for each frequency;
    the sums are whole numbers, so rounding makes them exact.
    """
    found = []
    for la, qs, qp in _by_length(q_ids, q_prints, 1 << 15):
        own: dict[int, np.ndarray] = {}
        for lb, rs, rp in _by_length(r_ids, r_prints, 1 << 14):
            size = 1 << max(1, int(la + lb - 1).bit_length())
            if size not in own:
                own[size] = _spectra(qp, size)
            sums = np.fft.irfft(np.matmul(own[size], _spectra(rp, size).transpose(0, 2, 1).conj()), size, axis=0)
            shift = np.arange(-lb + 1, la)
            n = np.minimum(la, lb + shift) - np.maximum(0, shift)
            shift, n = shift[n >= overlap], n[n >= overlap]
            if not len(n):
                continue
            sums = sums[shift % size]
            s, i, j = np.nonzero(sums >= (32 * n * (1 - 2 * most) - 1)[:, None, None])
            bits = (32 * n[s] - np.rint(sums[s, i, j]).astype(np.int64)) // 2
            rows = pd.DataFrame({"query": qs[i], "record": rs[j], "shift": shift[s].astype(np.int32), "overlap": n[s], "errors": bits / (32 * n[s])})
            found.append(rows[rows.errors <= most])
    return _best_offsets(found)


def _best_offsets(found: list[pd.DataFrame]) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({"query": [], "record": [], "shift": [], "overlap": [], "errors": []}).astype({"query": "int64", "record": "int64", "shift": "int32", "overlap": "int64", "errors": "float64"})
    rows = pd.concat(found)
    rows = rows.assign(_far=rows["shift"].abs(), _less=-rows["overlap"]).sort_values(["query", "record", "errors", "_less", "_far", "shift"])
    return rows.drop_duplicates(["query", "record"])[["query", "record", "shift", "overlap", "errors"]]


#: An offset of two recordings is looked at if so many halves of their integers agree there.
VOTES = 2
#: Agreements of one query with a part of the recordings that are counted at once; with more, every offset is looked at.
MOST_VOTES = 4_000_000


def voted(q_ids, q_prints, r_ids, r_prints, most: float, overlap: int, votes: int = VOTES) -> pd.DataFrame:
    """``alignments`` at the offsets that have ``votes``: records are posted under both 16-bit halves of their integers at all places.

    A query's halves meet equal ones, each votes for its record and offset, and at the offsets with enough votes all
    bits are compared. An integer that all frames of many recordings share would give too many votes; then the query is aligned with this
    part of the recordings at every offset.
    """
    r_prints, q_prints = ([np.asarray(p).astype(np.uint32) for p in side] for side in (r_prints, q_prints))
    length = np.array([len(p) for p in r_prints], np.int64)
    start, flat = np.concatenate([[0], np.cumsum(length)]), np.concatenate([*r_prints, np.zeros(1, np.uint32)])
    record = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(record)) - start[record]
    index = []
    for shift in (0, 16):
        half = ((flat[:-1] >> np.uint32(shift)) & np.uint32(0xFFFF)).astype(np.int64)
        order = np.argsort(half, kind="stable")
        index.append((shift, np.searchsorted(half[order], np.arange(65537)), order))
    longest, found, whole = int(length.max()) if len(length) else 0, [], []
    for k, (q_id, own) in enumerate(zip(q_ids, q_prints)):
        stride, codes = longest + len(own) + 1, []
        halves = [((own >> np.uint32(shift)) & np.uint32(0xFFFF)).astype(np.int64) for shift, _, _ in index]
        if sum(int((at[h + 1] - at[h]).sum()) for h, (_, at, _) in zip(halves, index)) > MOST_VOTES:
            whole.append(k)
            continue
        for h, (_, at, order) in zip(halves, index):
            n = at[h + 1] - at[h]
            posts = order[np.repeat(at[h] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            codes.append(record[posts] * stride + np.repeat(np.arange(len(own)), n) - place[posts] + longest)
        code, count = np.unique(np.concatenate(codes), return_counts=True)
        r, shift = np.divmod(code[count >= votes], stride)
        shift -= longest
        n = np.minimum(len(own), length[r] + shift) - np.maximum(0, shift)
        r, shift, n = r[n >= overlap], shift[n >= overlap], n[n >= overlap]
        for a in range(0, len(r), 4096):  # a bounded grid of frames
            b = slice(a, a + 4096)
            there = np.arange(len(own))[None, :] - shift[b, None]
            inside = (there >= 0) & (there < length[r[b], None])
            bits = np.bitwise_count(own[None, :] ^ flat[np.where(inside, start[r[b], None] + there, 0)])
            errors = (bits * inside).sum(1) / (32 * n[b])
            ok = errors <= most
            if ok.any():
                found.append(pd.DataFrame({"query": q_id, "record": np.asarray(r_ids)[r[b][ok]], "shift": shift[b][ok].astype(np.int32), "overlap": n[b][ok], "errors": errors[ok]}))
    if whole:
        found.append(alignments([q_ids[k] for k in whole], [q_prints[k] for k in whole], r_ids, r_prints, most, overlap))
    return _best_offsets(found)


@in_small_batches
def align_recordings(media: DataFrame, is_query, id_col: str, media_col: str, decode, most_errors: float = MOST_ERRORS, overlap: int = LEAST_OVERLAP, block: int = 2048, votes: int | None = None) -> DataFrame:
    """Fingerprint every recording and align the queries with all of them.

    ``decode`` turns a value of ``media_col`` into mono samples at ``RATE``. Recordings of one fingerprint are a class named by its
    smallest id, and classes are compared: every query class with all classes, without ``votes`` at every offset, so no pair within
    the bit errors is lost; with ``votes`` at the offsets that so many equal halves of packed integers vote for. Queries and records are dealt to parts of about ``block`` classes, and each pair of parts is one group.

    Returns id, class_id, n_prints, is_query, and for queries matches: (record class, offset, overlap, errors) by class, itself
    included. Null or short media have no prints and match nothing; null ids and other columns are ignored; rows of one
    id and fingerprint are one; an empty table gives none.
    """
    rows = media.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    prints = materialise(rows.mapInArrow(_prints(decode), "id long, digest string, print array<bigint>"), "chroma-prints")
    classes = prints.where("size(print) > 0").groupBy("digest").agg(F.min("id").alias("class_id"), F.max(is_query(F.col("id"))).alias("asked"), F.first("print").alias("print"))
    classes = materialise(classes, "chroma-classes")
    n = classes.agg(F.count(F.lit(1)).alias("all"), F.count_if("asked").alias("asked")).first()
    r_parts, q_parts = (max(1, -(-n[k] // block)) for k in ("all", "asked"))
    dealt = lambda parts: F.pmod(F.xxhash64("class_id"), F.lit(parts))
    every = lambda parts: F.explode(F.expr(f"sequence(0L, {parts - 1}L)"))
    asked = classes.where("asked").select(F.col("class_id").alias("query"), "print", dealt(q_parts).alias("q_part"), every(r_parts).alias("r_part"))
    records = classes.select(F.col("class_id").alias("record"), "print", dealt(r_parts).alias("r_part"), every(q_parts).alias("q_part"))

    def aligned(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        sides = q["query"].to_numpy(np.int64), q["print"], r["record"].to_numpy(np.int64), r["print"], most_errors, overlap
        return voted(*sides, votes) if votes else alignments(*sides)

    found = asked.groupBy("q_part", "r_part").cogroup(records.groupBy("q_part", "r_part")).applyInPandas(aligned, "query long, record long, shift int, overlap long, errors double")
    matches = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(F.col("record").alias("class_id"), "shift", "overlap", F.round("errors", 6).alias("errors")))).alias("matches"))
    out = prints.join(classes.select("digest", "class_id"), "digest", "left").join(matches, F.col("class_id") == F.col("query"), "left")
    asks = is_query(F.col("id"))
    return out.select("id", "class_id", F.size("print").alias("n_prints"), asks.alias("is_query"), F.when(asks, F.coalesce("matches", F.array().cast("array<struct<class_id: bigint, shift: int, overlap: bigint, errors: double>>"))).alias("matches"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is played as a melody; ids divisible by 20 are looked up among all."""
    media = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return align_recordings(media, lambda i: i % 20 == 0, "vec_id", "embedding", melody, block=8192, votes=VOTES).withColumnRenamed("id", "vec_id")
