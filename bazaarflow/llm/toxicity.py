"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, length-normalised scores."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import first_by_hash, in_small_batches, materialise, sized

# Characters that pass for Latin letters (Cyrillic, Greek, full width), and digits and signs used as letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
#: The other reading of a one.
ONE_AS_L = {"1": "l", "|": "l", "!": "l"}
INVISIBLE = "­​‌‍⁠﻿"

_SUSPECT = re.compile("[" + "".join(HOMOGLYPHS) + "0134578@$!|！-～" + INVISIBLE + "]")
_FOLD = str.maketrans({**HOMOGLYPHS, **DIGITS, **{chr(0xFEE0 + i): chr(i).lower() for i in range(0x21, 0x7F)}, **dict.fromkeys(INVISIBLE, "")})
_FOLD_L = str.maketrans({**HOMOGLYPHS, **DIGITS, **ONE_AS_L, **{chr(0xFEE0 + i): chr(i).lower() for i in range(0x21, 0x7F)}, **dict.fromkeys(INVISIBLE, "")})
_EDGE = ".,;:!?\"'()[]{}<>*#%&-_/\\|@$~`^+="
#: At a word's beginning these stand for letters.
_EDGE_LEFT = "".join(c for c in _EDGE if c not in "@$|")
_WORD = re.compile(r"[^\W\d_]+")

#: Lexicon entries begin a word: with so many first letters, or a whole word.
STEMS = (4, 5, 6, 7)
#: Labelled rows that the calibration sees, about; the lexicon is counted over all of them.
CALIBRATION_ROWS = 50_000


def folded_words(text: str) -> list[str]:
    """Lower-cased words; a word with look-alikes, digits or signs inside is read as letters, a one in both readings."""
    if not _SUSPECT.search(text):
        return text.split()
    out = []
    for w in text.split():
        if _SUSPECT.search(w) and any(c.isalpha() for c in w):
            w = w.lstrip(_EDGE_LEFT).rstrip(_EDGE)
            a, b = w.translate(_FOLD), w.translate(_FOLD_L)
            out.append(a)
            if a != b:
                out.append(b)
        else:
            out.append(w)
    return out


def _bare(words: list[str]) -> list[str]:
    return _WORD.findall(" ".join(words))


def _entries(batches):
    """(text, toxic) -> per batch, the documents of each label that hold a word, a stem or a pair of words."""
    columns = ["entry", "kind", "toxic", "clean"]

    def out(sums):
        keys = list(sums)
        return pa.RecordBatch.from_arrays([pa.array([k[1] for k in keys], pa.string()), pa.array([k[0] for k in keys], pa.int32()), pa.array([sums[k][1] for k in keys], pa.int64()), pa.array([sums[k][0] for k in keys], pa.int64())], columns)

    sums: dict = {}
    for batch in H.slices(batches, 0):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_bare(folded_words((text or "").lower())))
            found = {(0, w) for w in words}
            found |= {(n, w[:n]) for n in STEMS for w in words if len(w) > n}
            for k in found:
                sums.setdefault(k, [0, 0])[label] += 1
        if len(sums) > 200_000:
            yield out(sums)
            sums = {}
    yield out(sums)


def _phrases(sent):
    """(text, toxic) -> documents of each label that hold a lexicon word with the word before or after it."""

    def run(batches):
        matcher = Matcher(sent.value, [])
        for batch in H.slices(batches, 0):
            sums: dict = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _bare(folded_words((text or "").lower()))
                found = set()
                for i, w in enumerate(words):
                    if matcher.weight(w):
                        found |= {" ".join(words[j : j + 2]) for j in (i - 1, i) if j >= 0 and j + 2 <= len(words)}
                for k in found:
                    sums.setdefault(k, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[1] for v in sums.values()], pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64())], ["phrase", "toxic", "clean"])

    return run


class Matcher:
    """An Aho-Corasick automaton of lexicon entries and exception phrases."""

    def __init__(self, lexicon: list[tuple[str, int, float]], exceptions: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        best: dict[str, list] = {}
        for entry, kind, weight in lexicon:
            best.setdefault(entry, [0.0, 0.0])[0 if kind == 0 else 1] = weight
        for phrase in exceptions:
            best.setdefault(phrase, [0.0, 0.0]).append(True)
        for entry, value in best.items():
            self.automaton.add_word(entry, (len(entry), *value))
        if best:
            self.automaton.make_automaton()
        self.empty = not best

    def weight(self, word: str) -> float:
        """The weight of one bare word."""
        return self.total(word)[0]

    def total(self, text: str) -> tuple[float, int]:
        """Sum of weights and number of words hit in folded text; a word counts its strongest entry, none in an exception."""
        if self.empty:
            return 0.0, 0
        hits: dict[int, float] = {}
        barred: list[tuple[int, int]] = []
        n = len(text)
        for end, (size, whole, stem, *exception) in self.automaton.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalpha():
                continue
            ends = end + 1 == n or not text[end + 1].isalpha()
            if exception and ends:
                barred.append((start, end))
            weight = max(whole if ends else 0.0, 0.0 if ends else stem)
            if weight > hits.get(start, 0.0):
                hits[start] = weight
        if barred:
            hits = {s: w for s, w in hits.items() if not any(a <= s <= b for a, b in barred)}
        return sum(hits.values()), len(hits)


def features(matcher: Matcher, text: str | None, cap: float) -> tuple[float, float]:
    """Capped lexicon weight, and weight by the logarithm of the length in words."""
    words = folded_words((text or "").lower())
    weight, _ = matcher.total(" ".join(words))
    return min(weight, cap) / cap, weight / cap / np.log2(2 + len(words) / 50)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b = b + step
        if abs(step).max() < 1e-8:
            break
    return b


def _features(sent, cap: float):
    def run(batches):
        matcher = Matcher(*sent.value)
        for batch in H.slices(batches, 0):
            f = [features(matcher, t, cap) for t in batch.column(0).to_pylist()]
            a, b = np.array(f, float).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column(1)], ["capped", "dense", "toxic"])

    return run


def _score(sent, cap: float):
    def run(batches):
        lexicon, exceptions, weights = sent.value
        matcher = Matcher(lexicon, exceptions)
        for batch in H.slices(batches, 1):
            f = np.array([features(matcher, t, cap) for t in batch.column(1).to_pylist()], float).reshape(-1, 2)
            z = weights[0] + f @ weights[1:]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def learn(docs: DataFrame, labels: DataFrame, cap: float = 8.0, false_alarms: float = 0.05, least_ratio: float = 5.0, calibration_rows: int = CALIBRATION_ROWS):
    """Lexicon, exception phrases and calibration from labelled rows: ([(entry, kind, weight)], [phrase], coefficients).

    ``labels``: doc_id and toxic 0 or 1. Words and word stems are counted by documents over all labelled rows. An entry's
    weight is its log odds; it enters if toxic rows hold it ``least_ratio`` times as often and a likelihood-ratio test over
    all candidates would admit ``false_alarms`` by chance. A stem also needs no single word to make up most of it. Phrases of
    a lexicon word and a neighbour that clean rows hold as often as toxic ones become exceptions. All that pass their test are
    kept: what comes to the driver grows with the words that tell, not with documents. The calibration sees about
    ``calibration_rows`` rows, those that come first by hash.
    """
    spark = docs.sparkSession
    rows = docs.join(sized(labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))), "doc_id").select("text", "toxic", "doc_id")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return [], [], np.array([-3.0, 6.0, 0.0])
    counts = rows.mapInArrow(_entries, "entry string, kind int, toxic long, clean long").groupBy("entry", "kind").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t + c >= 4")
    counts = materialise(counts, "toxic-counts")
    t, c = F.col("t"), F.col("c")
    rate = n[1] / (n[0] + n[1])
    expected = (t + c) * rate
    gain = 2 * (t * F.log(F.greatest(t, F.lit(0.5)) / expected) + c * F.log(F.greatest(c, F.lit(0.5)) / ((t + c) * (1 - rate))))
    tests = counts.count()
    weight = F.log((t + 0.5) / n[1]) - F.log((c + 0.5) / n[0])
    strong = counts.withColumn("gain", gain).withColumn("weight", weight).where((F.col("gain") >= 2 * float(np.log(max(tests, 1) / false_alarms))) & (weight >= float(np.log(least_ratio))))
    longer = counts.where("kind = 0").select(F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.when(F.length("entry") > s, F.substring("entry", 1, s)).alias("entry")) for s in STEMS])).alias("e"), "t").where("e.entry is not null")
    longer = longer.groupBy("e.kind", "e.entry").agg(F.max("t").alias("most"))
    strong = strong.join(longer, ["kind", "entry"], "left").where("kind = 0 or (most is not null and 2 * most <= t)")
    lexicon = [(r["entry"], r["kind"], float(r["weight"])) for r in sorted(strong.select("entry", "kind", "weight").collect())]

    sent = spark.sparkContext.broadcast(lexicon)
    phrases = rows.mapInArrow(_phrases(sent), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    exceptions = sorted(r[0] for r in phrases.where((c >= 3) & (c / n[0] >= t / n[1])).select("phrase").collect())

    sample = first_by_hash(rows, F.xxhash64("doc_id", "text"), calibration_rows)
    got = sorted(sample.mapInArrow(_features(spark.sparkContext.broadcast((lexicon, exceptions)), cap), "capped double, dense double, toxic int").collect())
    return lexicon, exceptions, _calibrate(np.array([r[:2] for r in got], float).reshape(-1, 2), np.array([r[2] for r in got], float))


@in_small_batches
def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: float = 8.0, **options) -> DataFrame:
    """Toxicity of each row's whole text: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    ``labels`` (doc_id, toxic) are those to learn from. Text is lower-cased and words with look-alike letters, digits or signs
    are folded before an Aho-Corasick pass finds lexicon words and stems at word starts outside exception phrases. The
    score is logistic in the capped weight and in the weight by length. Null and empty texts score as clean; repeated
    rows score alike; with no labels of both kinds the lexicon is empty and all rows are clean; an empty table gives none.
    Texts of any length are read whole; other columns, whatever their names, are ignored; an id with two labels is toxic if
    one says so. ``options``: those of ``learn``.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = learn(source, labels, cap, **options)
    return source.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), cap), "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of an id predicted toxic; columns stay as they are, and rows without an id stay."""
    scored = score_toxicity(docs, labels, id_col, text_col).where("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("_bad")).distinct()
    bad = materialise(scored, "toxic-bad")
    return docs.join(sized(bad), docs[id_col].cast("long") == bad["_bad"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return score_toxicity(docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")
