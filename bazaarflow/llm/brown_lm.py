"""Brown class-based bigram language model: exchange clustering on Spark, and scores of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing as H
from .common import in_small_batches, materialise

#: Words whose counts and classes are sent to every task; the others' counts are joined by a shuffle, and they share a class.
HEAD = 1 << 19
#: Words whose classes are exchanged round by round; each other word of the head then goes to the class of highest likelihood.
CLUSTERED = 8192
CLASSES = 96
ROUNDS = 12
#: Weight of the class unigram in a transition.
SMOOTHING = 4.0
#: Words seen less often have no class of their own: they stand for unseen words, at every size of the corpus.
LEAST_SEEN = 2
#: Share of the class model in a token's probability; the rest is the add-half unigram's.
CLASS_SHARE = 0.9


def _word_counts(batches):
    """Rows of text -> (word hash, count), combined as far as memory allows."""
    for words, n in H.counted(H.words(*H.buffers(batch.column(0)))[0] for batch in H.slices(batches, 0)):
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])


def _look_up(table: np.ndarray, order: np.ndarray, words: np.ndarray, missing: int) -> np.ndarray:
    """Ranks of ``words`` in a sorted hash table, ``missing`` for the others."""
    if not len(table):
        return np.full(len(words), missing, np.int64)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return np.where(table[at] == words, order[at], missing)


def _chains(ids: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """Documents' ids one after the other, an end after each and one before the first."""
    return np.insert(ids, at[1:], end) if len(at) > 1 else ids


def _pair_counts(sent, size: int):
    """Rows of text -> counts of adjacent pairs of clustered words, as left * (size + 2) + right."""

    def run(batches):
        table, order = sent.value

        def pairs():
            for batch in H.slices(batches, 0):
                words, at = H.words(*H.buffers(batch.column(0)))
                chain = _chains(_look_up(table, order, words, size), at, size + 1)
                before = np.concatenate([[size + 1], chain[:-1]])
                yield before * (size + 2) + chain

        for codes, n in H.counted(pairs()):
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _exchange(sent, size: int, classes: int):
    """Words with their neighbours -> each word's best class, moved one after the other within the task."""

    def run(batches):
        of, between = sent.value
        of, between = of.copy(), between.astype(float)
        total_left, total_right = between.sum(1), between.sum(0)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                w = batch.column(0)[i].as_py()
                right = np.zeros(classes + 2)
                left = np.zeros(classes + 2)
                own = 0.0
                for column, n_column, sums in ((1, 2, right), (3, 4, left)):
                    near = batch.column(column)[i].values
                    near = near.to_numpy() if near is not None else np.empty(0, np.int64)
                    n = batch.column(n_column)[i].values
                    n = n.to_numpy().astype(float) if n is not None else np.empty(0)
                    same = near == w
                    own = float(n[same].sum()) if same.any() else own
                    sums += np.bincount(of[near[~same]], n[~same], classes + 2)
                a = of[w]
                between[a] -= right
                between[:, a] -= left
                between[a, a] -= own
                up, down = right.sum() + own, left.sum() + own
                total_left[a] -= up
                total_right[a] -= down
                rows = between[:classes]
                columns = between[:, :classes].T
                gain = (_xlogx(rows + right) - _xlogx(rows)).sum(1) + (_xlogx(columns + left) - _xlogx(columns)).sum(1)
                d = np.diagonal(between)[:classes]
                gain += _xlogx(d + right[:classes] + left[:classes] + own) + _xlogx(d) - _xlogx(d + right[:classes]) - _xlogx(d + left[:classes])
                gain -= _xlogx(total_left[:classes] + up) - _xlogx(total_left[:classes]) + _xlogx(total_right[:classes] + down) - _xlogx(total_right[:classes])
                b = int(gain.argmax())
                b = a if gain[b] <= gain[a] + 1e-9 else b
                between[b] += right
                between[:, b] += left
                between[b, b] += own
                total_left[b] += up
                total_right[b] += down
                of[w] = b
                out.append((w, b))
            words, best = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(best)], ["word", "class"])

    return run


def _class_counts(sent, size: int, classes: int):
    """Counted word pairs -> counts of class pairs."""

    def run(batches):
        of = sent.value
        sums = np.zeros((classes + 2) ** 2, np.int64)
        for batch in batches:
            pair, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            np.add.at(sums, of[pair // (size + 2)] * (classes + 2) + of[pair % (size + 2)], n)
        codes = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(sums[codes], pa.int64())], ["pair", "n"])

    return run


def exchange_classes(pairs: DataFrame, size: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the ``size`` clustered words, and the counts between classes.

    Starts from ranks dealt round robin. Each round takes one half of the words, and a few tasks move their own words to
    the class with the highest gain in the likelihood of class bigrams, against the counts of the round's start; a round
    that loses is undone, and two rounds without a gain worth having end it. What
    the driver holds is bounded by the vocabulary and the square of the number of classes.
    """
    spark = pairs.sparkSession
    base = size + 2
    split = pairs.select(F.floor(F.col("pair") / base).alias("l"), (F.col("pair") % base).alias("r"), "n")
    right = split.where(f"l < {size}").groupBy(F.col("l").alias("word")).agg(F.collect_list(F.struct("r", "n")).alias("s")).select("word", F.col("s.r").alias("right"), F.col("s.n").alias("right_n"))
    left = split.where(f"r < {size}").groupBy(F.col("r").alias("word")).agg(F.collect_list(F.struct("l", "n")).alias("s")).select("word", F.col("s.l").alias("left"), F.col("s.n").alias("left_n"))
    near = materialise(right.join(left, "word", "full"), "lm-neighbours") if size else None
    of = np.concatenate([np.arange(size) % max(1, classes), [classes, classes + 1]]).astype(np.int64)

    def count(of: np.ndarray) -> np.ndarray:
        sums = pairs.mapInArrow(_class_counts(spark.sparkContext.broadcast(of), size, classes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        between = np.zeros((classes + 2) ** 2, np.int64)
        for pair, n in sums.collect():
            between[pair] = n
        return between.reshape(classes + 2, classes + 2)

    def likelihood(between: np.ndarray) -> float:
        return float(_xlogx(between.astype(float)).sum() - _xlogx(between.sum(0).astype(float)).sum() - _xlogx(between.sum(1).astype(float)).sum())

    between = count(of)
    best, idle = likelihood(between), 0
    for r in range(rounds if size else 0):
        half = near.where(F.pmod(F.xxhash64("word", F.lit(r // 2)), F.lit(2)) == r % 2).coalesce(4)
        moved = half.mapInArrow(_exchange(spark.sparkContext.broadcast((of, between)), size, classes), "word long, class long").collect()
        trial = of.copy()
        for w, c in moved:
            trial[w] = c
        counted = count(trial)
        value = likelihood(counted)
        gained = value - best
        if gained > 0:
            of, between, best = trial, counted, value
        idle = idle + 1 if gained < 1e-4 * abs(best) else 0
        if idle == 2:
            break
    return of, between


def _neighbour_counts(sent, classes: int):
    """Rows of text -> how often each word of the head beyond the core stands before and after each class.

    Coded as (rank * 2 + after) * (classes + 2) + class; a neighbour beyond the core counts as the rare class.
    """

    def run(batches):
        table, order, of, core = sent.value
        width, end = classes + 2, classes + 1
        kinds = np.append(np.where(np.arange(len(of)) < core, of, classes), [classes, end])

        def codes():
            for batch in H.slices(batches, 0):
                words, at = H.words(*H.buffers(batch.column(0)))
                chain = _chains(_look_up(table, order, words, len(of)), at, len(of) + 1)
                before = np.concatenate([[len(of) + 1], chain[:-1]])
                for word, near, after in ((before, chain, 0), (chain, before, 1)):
                    tail = (word >= core) & (word < len(of))
                    yield (word[tail] * 2 + after) * width + kinds[near[tail]]

        for c, n in H.counted(codes()):
            yield pa.RecordBatch.from_arrays([pa.array(c // (2 * width)), pa.array(c % (2 * width), pa.int64()), pa.array(n, pa.int64())], ["word", "near", "n"])

    return run


def _best_class(sent, classes: int):
    """Counts of neighbours, sorted by word -> each word's class of highest likelihood."""

    def run(batches):
        before, after, size = sent.value  # log counts of (class, next class) and (previous class, class), log sizes

        def best(words, near, n):
            ids, row = np.unique(words, return_inverse=True)
            sums = np.zeros((len(ids), 2 * (classes + 2)))
            np.add.at(sums, (row, near), n)
            value = sums[:, : classes + 2] @ before.T + sums[:, classes + 2 :] @ after - sums.sum(1, keepdims=True) * size
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(value.argmax(1).astype(np.int64))], ["word", "class"])

        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            done = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            if done:
                yield best(*(h[:done] for h in held))
                held = [h[done:] for h in held]
        if len(held[0]):
            yield best(*held)

    return run


def _class_pairs(sent, classes: int):
    """Rows of text -> counts of adjacent classes over all words."""

    def run(batches):
        table, order, kind = sent.value
        sums = np.zeros((classes + 2) ** 2, np.int64)
        for batch in H.slices(batches, 0):
            words, at = H.words(*H.buffers(batch.column(0)))
            chain = _chains(np.append(kind, classes)[_look_up(table, order, words, len(kind))], at, classes + 1)
            sums += np.bincount(np.concatenate([[classes + 1], chain[:-1]]) * (classes + 2) + chain, minlength=len(sums))
        codes = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(sums[codes], pa.int64())], ["pair", "n"])

    return run


def assign_classes(training: DataFrame, table: tuple, of: np.ndarray, between: np.ndarray, size: int, classes: int) -> np.ndarray:
    """Classes of all words of the head: the core's, and for each other word the class under which the core around it is likeliest."""
    spark = training.sparkSession
    words = len(table[0])
    kind = np.full(words, classes, np.int64)
    kind[:size] = of[:size]
    if words > size and classes:
        log = np.log(between + 0.1)
        sent = spark.sparkContext.broadcast((*table, kind, size))
        near = training.mapInArrow(_neighbour_counts(sent, classes), "word long, near long, n long").groupBy("word", "near").agg(F.sum("n").alias("n"))
        model = (log[:classes], log[:, :classes], np.log(between.sum(1)[:classes] + 1.0))
        found = near.repartition("word").sortWithinPartitions("word").mapInArrow(_best_class(spark.sparkContext.broadcast(model), classes), "word long, class long").toArrow()
        kind[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return kind


def count_classes(training: DataFrame, table: tuple, kind: np.ndarray, classes: int) -> np.ndarray:
    """Counts of adjacent classes over the whole training text."""
    pairs = training.mapInArrow(_class_pairs(training.sparkSession.sparkContext.broadcast((*table, kind)), classes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    between = np.zeros((classes + 2) ** 2, np.int64)
    for pair, n in pairs.collect():
        between[pair] = n
    return between.reshape(classes + 2, classes + 2)


def _scores(sent):
    """Documents -> sums over head words, and the words whose counts are still to be joined."""

    def run(batches):
        m = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in H.slices(batches, 2):
            words, at = H.words(*H.buffers(batch.column(2)))
            rank = _look_up(m["table"], m["order"], words, len(m["n"]))
            known = rank < len(m["n"])
            kind = np.append(m["class"], m["rare"])[rank]
            log_n = np.append(np.log10(m["n"] + 0.5), 0.0)[rank]
            end = m["end"]
            chain = _chains(kind, at, end)
            step = m["mixed"][np.concatenate([[end], chain[:-1]]), chain]
            emits = _chains(log_n, at, m["end_log"])
            bases = _chains(log_n - m["base"], at, m["end_log"] - m["base"])
            starts = at[:-1] + np.arange(len(at) - 1)
            rows = batch.num_rows
            base = np.add.reduceat(bases, starts) if rows else bases
            score = np.add.reduceat(step + emits, starts) if rows else step
            at_known = np.concatenate([[0], np.cumsum(known)])
            n_known = at_known[at[1:]] - at_known[at[:-1]] + m["end_known"]
            tail, tail_n, sizes = [], [], [0]
            for i in range(rows):
                own = words[at[i] : at[i + 1]][~known[at[i] : at[i + 1]]]
                w, n = np.unique(own, return_counts=True)
                tail.append(w)
                tail_n.append(n)
                sizes.append(sizes[-1] + len(w))
            sizes = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64))) for x in (tail, tail_n)]
            ids = pa.array(np.arange(row, row + rows))
            row += rows
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), batch.column(1), pa.array(np.diff(at) + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score), *lists], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "tail_n"])

    return run


def most_frequent(counts: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most ``head``, all down to one sixteenth of an octave of counts, and their counts: tasks send only those."""
    octave = F.floor(F.log2("n") * 16).cast("int")
    lowest, words = None, 0
    for r in counts.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("o")).collect():
        words += r["words"]
        if words > head:
            break
        lowest = r["o"]
    if lowest is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = counts.where(octave >= lowest).select("word", "n").toArrow()
    word, n = (found.column(k).to_numpy() for k in (0, 1))
    order = np.lexsort((word, -n))
    return word[order].view(np.uint64), n[order]


def learn(training: DataFrame, counts: DataFrame, head: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS) -> dict:
    """The model of ``training`` (text), whose words are counted in ``counts`` (word, n), as arrays that every task gets.

    The ``clustered`` most frequent words are put into ``classes`` by exchange clustering. Every other word of the head that
    was seen ``LEAST_SEEN`` times then goes to the class under which the core words before and after it are likeliest; their
    neighbours are counted over the whole text. Words seen less, those beyond the head and unseen ones share a class, so what
    was seen once tells how often and where an unseen word comes; the end is a class.
    """
    spark = training.sparkSession
    ends = training.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    head_words, head_n = most_frequent(counts, head)
    classed = int(np.searchsorted(-head_n, -LEAST_SEEN, "right"))
    size = min(clustered, classed)

    def table(n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(head_words[:n]).astype(np.int64)
        return head_words[:n][order], order

    pairs = training.mapInArrow(_pair_counts(spark.sparkContext.broadcast(table(size)), size), "pair long, n long")
    pairs = materialise(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "lm-pairs")
    of, between = exchange_classes(pairs, size, classes, rounds)
    kind = assign_classes(training, table(classed), of, between, size, classes)
    words, order = table(len(head_words))
    kind = np.concatenate([kind, np.full(len(words) - classed, classes, np.int64)])
    between = count_classes(training, (words, order), kind, classes)

    rare, end = classes, classes + 1
    in_class = np.bincount(kind, head_n, classes + 2)
    types = np.bincount(kind, minlength=classes + 2).astype(float)
    in_class[rare] += total - ends - head_n.sum()
    types[rare] += kinds - len(head_words) - (ends > 0) + 1
    share = (between.sum(0) + 0.5) / (between.sum() + 0.5 * (classes + 2))
    step = np.log10((between + SMOOTHING * share) / (between.sum(1, keepdims=True) + SMOOTHING))
    emission = np.log10(np.maximum(in_class + 0.5 * types, 0.5))
    emission[end] = np.log10(ends + 0.5)
    base = float(np.log10(total + 0.5 * (kinds + 1)))
    mixed = np.log10(CLASS_SHARE * 10 ** (step - emission) + (1 - CLASS_SHARE) * 10**-base)
    return {"table": words, "order": order, "n": head_n, "class": kind, "rare": rare, "end": end, "emission": emission, "step": step, "mixed": mixed, "base": base, "end_log": float(np.log10(ends + 0.5)), "end_known": int(ends > 0), "total": total}


@in_small_batches
def score_documents(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Log10 probabilities of whole texts under a Brown class bigram model learnt from the rows that are not ``held_out``.

    Tokens are lower-cased (A-Z) words between blanks and one end per text. Words have classes as ``learn`` states.
    P(word | word before) = P(class | class before) * P(word | class), transitions backing off to class frequencies and
    emissions to half a count, mixed with the unigram (``CLASS_SHARE``), so no token falls far below it. All training tokens are counted. The counts of the ``head`` most frequent words go to every
    task; those of all others are joined to the documents that need them by a shuffle.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigram), score. A null text is empty: one
    token. ``held_out`` is a Column (default: CRC-32 of the id as text leaves 1 modulo 5); a null there counts as training.
    Repeated rows count as often as they occur; other columns are ignored; an empty table gives an empty result. Words are
    compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    default = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(default if held_out is None else held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = source.where("not held_out").select("text")
    counts = materialise(training.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    model = learn(training, counts, head, clustered, classes, rounds)

    scored = source.mapInArrow(_scores(spark.sparkContext.broadcast(model)), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<bigint>, tail_n array<bigint>")
    scored = materialise(scored, "lm-scores")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("times"))
    tail = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log_n"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"))
    out = scored.drop("tail", "tail_n").join(tail, "row", "left")
    more = F.coalesce("log_n", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model["total"]).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
