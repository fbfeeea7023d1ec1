"""Edit-similarity helpers over Arrow batches: Spark has no longest-common-subsequence ratio."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word row per character of ``b`` (bit-parallel)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def subsequence_of_at_least(a: str, b: str, need: float, step: int = 24) -> int:
    """``common_subsequence``, or -1 as soon as what is left of ``b`` cannot bring it to ``need``."""
    if min(len(a), len(b)) < need:
        return -1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for at in range(0, len(b), step):
        if len(a) - row.bit_count() + len(b) - at < need:
            return -1
        for c in b[at : at + step]:
            if hit := row & where.get(c, 0):
                row = (row + hit | row - hit) & full
    found = len(a) - row.bit_count()
    return found if found >= need else -1


def indel(a: str, b: str) -> float:
    """100 * 2 * common subsequence / total length; 100 for two empty texts."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    """Best indel ratio of the common words and the common words with either side's own; 0 if a side has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (only_x and only_y):
        return 100.0
    s, sx, sy = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    return max(indel(sx, sy), *((indel(s, sx), indel(s, sy)) if both else (0.0,)))


def best_token_set(asked: list[str], texts: list[str], least: float) -> list[tuple[int, float]]:
    """For each of ``asked`` the text of the highest ``token_set`` (to four decimals, the earlier one on ties) of at least ``least``: (its position, the ratio), or (-1, 0).

    Every text counts: the ratios of the common words follow from lengths, and the one subsequence is left out only where the
    characters that both sides have bound it below the best so far.
    """
    words = [set(t.split()) for t in texts]
    posts: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        for v in w:
            posts[v].append(i)
    index = {v: np.array(p) for v, p in posts.items()}
    n_words = np.array([len(w) for w in words], np.int64)
    length = np.array([sum(map(len, w)) + len(w) - 1 for w in words], np.int64)
    column: dict[str, int] = {}
    bags = np.zeros((len(texts), 1 + len({c for w in words for v in w for c in v})), np.int64)
    for i, w in enumerate(words):
        for c in " ".join(w):
            bags[i, column.setdefault(c, len(column))] += 1
    out = []
    for text in asked:
        own = set(text.split())
        if not own or not len(texts):
            out.append((-1, 0.0))
            continue
        size, bag = sum(map(len, own)) + len(own) - 1, np.zeros(bags.shape[1], np.int64)
        for c in " ".join(own):
            if c in column:
                bag[column[c]] += 1
        common, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for v in own:
            if v in index:
                common[index[v]] += 1
                letters[index[v]] += len(v) + 1
        some = np.maximum(letters - 1, 0)
        score = np.where(common > 0, 200.0 * some / np.maximum(some + np.minimum(size, length), 1), 0.0)
        score[(common > 0) & ((common == len(own)) | (common == n_words))] = 100.0
        bound = np.where(n_words > 0, 200.0 * np.minimum(bags, bag).sum(1) / np.maximum(size + length, 1), 0.0)
        best = max(least, score.max())
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < best - 1e-4:
                break
            if score[i] < 100.0:
                # both begin with the common words, so only the rest is aligned
                shared = own & words[i]
                begun = sum(map(len, shared)) + len(shared)
                a, b = " ".join(sorted(own - shared)), " ".join(sorted(words[i] - shared))
                total = 2 * begun + len(a) + len(b)
                found = subsequence_of_at_least(a, b, (best - 1e-4) * total / 200.0 - begun)
                if found >= 0:
                    score[i] = max(score[i], 200.0 * (begun + found) / total)
                    best = max(best, score[i])
        score = np.floor(score * 1e4 + 0.5) / 1e4
        i = int(score.argmax())
        out.append((i, float(score[i])) if score[i] >= least else (-1, 0.0))
    return out


def token_set_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b)])

    return run(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([indel(x or "", y or "") for x, y in zip(a, b)])

    return run(a, b)


def spelling_variant(a: Column, b: Column, least: float = 65.0) -> Column:
    """Both of five letters or more, the same first letter, and an indel ratio of at least ``least``."""
    cheap = (F.length(a) >= 5) & (F.length(b) >= 5) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    return cheap & (indel_ratio(F.when(cheap, a), F.when(cheap, b)) >= least)
