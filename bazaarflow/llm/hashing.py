"""Vectorised words, shingles and MinHash over Arrow string columns (numpy inside tasks; Spark deals the rows)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public murmur constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def random_words(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _P + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03))


class Powers:
    """P**i and P**-i modulo 2**64, grown when a chunk is longer."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _P, np.uint64)]).astype(np.uint64), dtype=np.uint64)
            inverse = np.uint64(pow(int(_P), -1, 1 << 64))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]).astype(np.uint64), dtype=np.uint64)


_powers = Powers()


def slices(batches, text: int, limit: int = 2 << 20):
    """Record batches cut so that each holds about ``limit`` bytes of column ``text`` or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def counted(values, limit: int = 2_000_000):
    """Arrays -> (distinct values, counts) for about every ``limit`` values: a bounded combine before the shuffle."""
    held, n = [], 0
    for v in values:
        held.append(v)
        n += len(v)
        if n >= limit:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), return_counts=True)


def word_class(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: Words are runs of anything but space and tab to carriage return.
BLANK_SEPARATED = word_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of digits, letters and bytes from 0x80, as the rest of ASCII separates.
ALNUM = word_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the rows' offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = BLANK_SEPARATED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased (A-Z) words in order, and the words' offsets by row.

    Works in chunks of about 256 KB cut at rows or separators, so memory follows the chunk and the longest word.
    """
    byte_code = random_words(256, 7)[LOWER]
    inside = inside[LOWER]
    found, starts_at, pos = [], [], 0
    while pos < len(data):
        end = min(pos + CHUNK, len(data))
        if end < len(data):
            row = offsets[np.searchsorted(offsets, end, "right") - 1]
            if row > pos:
                end = int(row)
            else:  # one long row: cut after its last separator, or read on to the next one
                gaps = np.flatnonzero(~inside[data[pos:end]])
                limit = int(offsets[np.searchsorted(offsets, pos, "right")])
                if len(gaps):
                    end = pos + int(gaps[-1]) + 1
                else:
                    while end < limit and inside[data[end]]:
                        end += 1
        part = data[pos:end]
        n = len(part)
        is_in = inside[part]
        head = is_in.copy()
        head[1:] &= ~is_in[:-1]
        cuts = offsets[np.searchsorted(offsets, pos, "left") : np.searchsorted(offsets, end, "left")] - pos
        cuts = cuts[(cuts >= 0) & (cuts < n)]
        head[cuts] |= is_in[cuts]
        starts = np.flatnonzero(head)
        tail = is_in.copy()
        tail[:-1] &= ~is_in[1:]
        before = cuts[cuts > 0] - 1
        tail[before] |= is_in[before]
        ends = np.flatnonzero(tail) + 1
        _powers.upto(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(byte_code[part] * _powers.up[:n], out=total[1:], dtype=np.uint64)
        found.append(mix((total[ends] - total[starts]) * _powers.down[starts]))
        starts_at.append(starts + pos)
        pos = end
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(starts_at), offsets, "left").astype(np.int64)


_Q = random_words(64, 11) | np.uint64(1)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; of the whole sequence if there are fewer; none without words."""
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    count = len(hashes) - size + 1
    total = np.full(count, size, np.uint64)
    for j in range(size):
        total += hashes[j : j + count] * _Q[j]
    return mix(total)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class MinHash:
    """``k`` coordinates over a set of 64-bit hashes; a coordinate's value is the whole hash that comes first in its order."""

    def __init__(self, k: int, seed: int = 1) -> None:
        r = random_words(3 * k, seed)
        self.flip = (r[:k] >> np.uint64(32)).astype(np.uint32)[:, None]
        self.times = ((r[k : 2 * k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
        self.salt = r[2 * k :]

    def tokens(self, values: np.ndarray) -> np.ndarray:
        """One 64-bit id per (coordinate, value) pair. ``values``: sorted, distinct, not empty."""
        best = low = None
        for at in range(0, len(values), 1 << 15):
            part = values[at : at + (1 << 15)]
            keys = (part >> np.uint64(32)).astype(np.uint32)[None, :] ^ self.flip
            keys *= self.times
            keys ^= keys >> np.uint32(15)
            keys *= np.uint32(0x846CA68B)
            first = keys.argmin(1)
            here = keys[np.arange(len(first)), first]
            if best is None:
                best, low = part[first], here
            else:
                better = here < low
                best, low = np.where(better, part[first], best), np.where(better, here, low)
        return mix(best ^ self.salt)


def runs(batches, key: int):
    """Record batches of rows sorted by column ``key`` -> one table per run of equal keys, over batch ends too."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if kept and kept[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for i, j in zip(bounds[:-1], bounds[1:]):
            part = batch.slice(i, j - i)
            if j == batch.num_rows:
                kept.append(part)
            elif kept:
                yield pa.Table.from_batches([*kept, part])
                kept = []
            else:
                yield pa.Table.from_batches([part])
    if kept:
        yield pa.Table.from_batches(kept)


class Forest:
    """Union-find over a small group; ``join`` is true when it links two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j
