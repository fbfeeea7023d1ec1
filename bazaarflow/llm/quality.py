"""Document quality by a linear-chain conditional random field over lines, good or bad.

A line's features are its own looks and those of the lines before and after it. The field's label follows the document's
label in training; forward and backward sums give each line's probability of being good, and their mean by length is
what a logistic curve turns into the document's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import first_by_hash, in_small_batches, materialise, sized
from .toxicity import held_out

#: Labelled rows that the field is fitted on, about, and the lines of one of them, at most (longer ones are left out of the fit).
TRAINING_ROWS = 6_000
TRAINING_LINES = 400
STEPS = 120
RIDGE = 3e-4

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _BAR, _HIGH, _BLANK, _STOP = range(9)
_CLASS = np.full(256, _SYMBOL, np.uint8)
for _bytes, _kind in ((range(65, 91), _UPPER), (range(97, 123), _LOWER), (range(48, 58), _DIGIT), (b"!", _BANG), (b"|", _BAR), (range(128, 256), _HIGH), (b" \t\x0b\x0c\r", _BLANK), (b".,;:?'\"()-", _STOP)):
    _CLASS[list(_bytes)] = _kind

#: (name, edges): a value's bin is the number of edges that it reaches.
_BINS = {
    "bytes": (1, 8, 20, 50, 120, 300, 800),
    "upper": (0.02, 0.1, 0.3, 0.7),
    "digit": (0.001, 0.05, 0.2),
    "symbol": (0.001, 0.02, 0.08, 0.2),
    "bang": (0.001, 0.02, 0.08),
    "bar": (0.001, 0.02, 0.08),
    "stop": (0.001, 0.02, 0.06, 0.15),
    "word": (2.0, 3.5, 5.0, 7.0, 10.0),
    "same": (0.001, 0.05, 0.2, 0.5),
    "distinct": (0.1, 0.3, 0.6, 0.9),
    "again": (0.5,),
    "before": (0.5,),
    "ended": (0.5,),
}
_AT = np.concatenate([[0], np.cumsum([len(e) + 1 for e in _BINS.values()])])
#: One-hot width of a line; with both neighbours and the two ends, of a place in the chain.
OWN = int(_AT[-1])
WIDTH = 3 * OWN + 3


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of a text column: one-hot places (lines x features), lengths in bytes and one, and the rows' line offsets.

    A null or empty text is one empty line.
    """
    data, at = H.buffers(column)
    breaks = np.flatnonzero(data == 10)
    # a line begins at each row's start and after each break
    starts = np.concatenate([at[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    lines = np.searchsorted(row, np.arange(len(at)))
    n = len(starts)
    ends = np.empty(n, np.int64)
    ends[:-1] = np.where(row[1:] == row[:-1], starts[1:] - 1, at[row[:-1] + 1])
    if n:
        ends[-1] = at[-1]
    size = ends - starts
    kinds = _CLASS[data]
    totals = {}
    for kind in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _BAR, _HIGH, _STOP):
        sums = np.concatenate([[0], np.cumsum(kinds == kind)])
        totals[kind] = (sums[ends] - sums[starts]).astype(float)
    solid = np.maximum(sum(totals.values()), 1)
    offsets = np.concatenate([starts, at[-1:]])
    words, word_at = H.words(data, offsets)
    count = np.diff(word_at)
    of = np.repeat(np.arange(n), count)
    same = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(words) else np.zeros(n)
    by = np.lexsort((words, of))
    new = np.ones(len(words), bool)
    new[1:] = (words[by][1:] != words[by][:-1]) | (of[by][1:] != of[by][:-1])
    distinct = np.bincount(of[by][new], minlength=n) if len(words) else np.zeros(n)
    with np.errstate(over="ignore"):
        place = np.arange(len(words)) - word_at[of]
        spread = H.mix(words + place.astype(np.uint64) * H.random_words(1, 5)[0]) if len(words) else words
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
        line = H.mix(sums[word_at[1:]] - sums[word_at[:-1]] + count.astype(np.uint64))
    filled = count > 0
    before = np.zeros(n, bool)
    before[1:] = (line[1:] == line[:-1]) & (row[1:] == row[:-1]) & filled[1:]
    by = np.lexsort((line, row))
    alike = np.zeros(n, bool)
    twin = (line[by][1:] == line[by][:-1]) & (row[by][1:] == row[by][:-1]) & filled[by][1:]
    alike[by[1:][twin]] = True
    alike[by[:-1][twin]] = True
    last = np.where(size > 0, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    letters = np.maximum(totals[_UPPER] + totals[_LOWER], 1)
    values = {
        "bytes": size, "upper": totals[_UPPER] / letters, "digit": totals[_DIGIT] / solid, "symbol": totals[_SYMBOL] / solid, "bang": totals[_BANG] / solid, "bar": totals[_BAR] / solid,
        "stop": totals[_STOP] / solid, "word": solid / np.maximum(count, 1), "same": same / np.maximum(count, 1), "distinct": distinct / np.maximum(count, 1), "again": alike, "before": before,
        "ended": np.isin(last, list(b".!?:;\"')")),
    }
    places = np.stack([first + np.searchsorted(edges, values[name], "right") for first, (name, edges) in zip(_AT, _BINS.items())], 1) if n else np.empty((0, len(_BINS)), np.int64)
    return places, size + 1, lines


def chained(places: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Places of each line's own features, of both neighbours' and of the ends of the chain, as columns into ``WIDTH`` weights."""
    n = len(places)
    before, after = places + OWN, places + 2 * OWN
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[lines[:-1]] = True
    last[lines[1:] - 1] = True
    none_before, none_after, bias = 3 * OWN, 3 * OWN + 1, 3 * OWN + 2
    b = np.where(first[:, None], none_before, np.roll(before, 1, 0))
    a = np.where(last[:, None], none_after, np.roll(after, -1, 0))
    # at an end only one column counts: the others point to a weight that is always zero
    b[first, 1:] = WIDTH
    a[last, 1:] = WIDTH
    return np.concatenate([places, b, a, np.full((n, 1), bias)], 1)


def emissions(columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of good over bad by a line's features alone."""
    return np.append(weights, 0.0)[columns].sum(1)


def marginals(odds: np.ndarray, lines: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward sums over all chains at once: P(good) of each line, pair probabilities by line (to it from the one before), log partition of each chain.

    ``odds`` are the good label's scores (bad: 0), ``transition[i, j]`` the score from label i to j (0 bad, 1 good).
    """
    size = np.diff(lines)
    n, longest = len(odds), int(size.max()) if len(size) else 0
    order = np.argsort(-size, kind="stable")
    start, size = lines[:-1][order], size[order]
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    score = np.stack([np.zeros(n), odds], 1)
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]  # chains longer than t
    if n:
        forward[start[: live[0]]] = score[start[: live[0]]]
    for t in range(1, longest):
        here = start[: live[t]] + t
        forward[here] = score[here] + np.logaddexp(forward[here - 1][:, :1] + transition[0], forward[here - 1][:, 1:] + transition[1])
    for t in range(longest - 2, -1, -1):
        k = live[t + 1]
        here = start[:k] + t
        after = score[here + 1] + backward[here + 1]
        backward[here] = np.logaddexp(transition[:, 0] + after[:, :1], transition[:, 1] + after[:, 1:])
    end = lines[1:][np.diff(lines) > 0] - 1
    whole = np.logaddexp(forward[end, 0], forward[end, 1])
    z = np.repeat(whole, np.diff(lines)[np.diff(lines) > 0])
    good = np.exp(forward[:, 1] + backward[:, 1] - z)
    pairs = np.zeros((n, 2, 2))
    inner = np.ones(n, bool)
    inner[lines[:-1][np.diff(lines) > 0]] = False
    k = np.flatnonzero(inner)
    pairs[k] = np.exp(forward[k - 1][:, :, None] + transition[None] + (score[k] + backward[k])[:, None, :] - z[k][:, None, None])
    return good, pairs, whole


def fit(columns: np.ndarray, lines: np.ndarray, labels: np.ndarray, weight: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by adaptive gradient steps on the conditional likelihood of all lines having their document's label.

    ``weight``: what each document counts; classes are balanced by the caller. The same input gives the same weights.
    """
    size = np.diff(lines)
    y = np.repeat(labels, size).astype(float)
    per_line = np.repeat(weight, size)
    inner = np.ones(len(y), bool)
    inner[lines[:-1][size > 0]] = False
    truth = np.zeros((2, 2))
    np.add.at(truth, (y[inner].astype(int), y[inner].astype(int)), per_line[inner])
    w, transition = np.zeros(WIDTH), np.zeros((2, 2))
    mean, square = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    total = per_line.sum()
    for step in range(1, steps + 1):
        good, pairs, _ = marginals(emissions(columns, w), lines, transition)
        d = (y - good) * per_line
        g = np.bincount(columns.ravel(), np.repeat(d, columns.shape[1]), WIDTH + 1)[:WIDTH] / total - ridge * w
        gt = ((truth - (pairs * per_line[:, None, None]).sum(0)) / total - ridge * transition).ravel()
        g = np.concatenate([g, gt])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, transition = w + move[:WIDTH], transition + move[WIDTH:].reshape(2, 2)
    return w, transition


def by_length(good: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each document's mean probability of a good line, weighed by length."""
    sums = np.concatenate([[0.0], np.cumsum(good * length)])
    sizes = np.concatenate([[0], np.cumsum(length)])
    return (sums[lines[1:]] - sums[lines[:-1]]) / np.maximum(sizes[lines[1:]] - sizes[lines[:-1]], 1)


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def calibrated(share: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A rising logistic curve from shares of good text to the chance of label 1, by Newton steps with a small ridge."""
    x = np.stack([np.ones(len(share)), _logit(share)], 1)
    b = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), x.T @ (y - p) - 0.5 * (b - [0.0, 1.0]))
        b = b + step
        if abs(step).max() < 1e-9:
            break
    return np.array([b[0], max(b[1], 1e-3)])


def _lines(batches):
    """(text, label) -> line features of the rows that are short enough to learn from."""
    for batch in H.slices(batches, 0):
        places, length, lines = line_features(batch.column(0))
        ok = np.flatnonzero(np.diff(lines) <= TRAINING_LINES)
        rows = [(places[lines[k] : lines[k + 1]].astype(np.uint8).tobytes(), length[lines[k] : lines[k + 1]].tobytes()) for k in ok]
        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(ok)), batch.column(2).take(pa.array(ok)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["h", "good", "places", "length"])


def learn(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS):
    """The field (weights, transitions) and the curve (two coefficients) from labelled rows: None without rows of both labels.

    ``labels``: doc_id and quality 0 or 1; an id with both is bad. About ``training_rows`` rows are read, those that come first
    by hash, of at most ``TRAINING_LINES`` lines each. Both classes weigh alike, and a document weighs by the root of its lines.
    """
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    rows = docs.join(sized(marked), "doc_id").select("text", F.xxhash64("doc_id", "text").alias("h"), "good")
    sample = first_by_hash(rows, F.col("h"), training_rows)
    got = sorted(materialise(sample.mapInArrow(_lines, "h long, good int, places binary, length binary"), "quality-lines").collect(), key=lambda r: (r["h"], r["places"]))
    y = np.array([r["good"] for r in got], int)
    if len(set(y.tolist())) < 2:
        return None
    places = [np.frombuffer(r["places"], np.uint8).reshape(-1, len(_BINS)) for r in got]
    lines = np.concatenate([[0], np.cumsum([len(p) for p in places])])
    columns = chained(np.concatenate(places).astype(np.int64), lines)
    share = np.bincount(y, minlength=2) / len(y)
    weight = 0.5 / share[y] / np.sqrt(np.diff(lines))
    w, transition = fit(columns, lines, y, weight)
    length = np.concatenate([np.frombuffer(r["length"], np.int64) for r in got])
    good, _, _ = marginals(emissions(columns, w), lines, transition)
    return w, transition, calibrated(by_length(good, length, lines), y)


def _score(sent, threshold: float):
    def run(batches):
        model = sent.value
        for batch in H.slices(batches, 1):
            places, length, lines = line_features(batch.column(1))
            if model is None:
                score = np.full(batch.num_rows, 0.5)
                share = np.full(batch.num_rows, 0.5)
            else:
                w, transition, curve = model
                good, _, _ = marginals(emissions(chained(places, lines), w), lines, transition)
                share = by_length(good, length, lines)
                score = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * _logit(share), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(share), pa.array(np.diff(lines))], ["doc_id", "score", "predicted", "good_share", "n_lines"])

    return run


@in_small_batches
def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """Quality of each row's whole text: doc_id, score (0 to 1, higher is better), predicted (1 from ``threshold`` on), good_share, n_lines.

    ``labels`` (doc_id, quality) are those to learn from. Lines end at line feeds. Null and empty texts are one empty line and
    score as such; repeated rows score alike; without labels of both kinds every score is 0.5; an empty table gives none. Texts of
    any length are read whole, and one of many lines is a long chain; other columns, whatever their names, are ignored; null ids are scored. ``options``: those of ``learn``.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(learn(source, labels, **options))
    return source.mapInArrow(_score(sent, threshold), "doc_id long, score double, predicted int, good_share double, n_lines long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return score_quality(docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted", "good_share", "n_lines")
