"""Temperature mixing: source weights by a bisected exponent, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, sized, small_enough

#: Documents of a block, about.
BLOCK_DOCS = 4096
_STEPS = 60


def _token_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class Shares:
    """Sums over sources of functions of their token share, on the driver for few sources and by Spark for many."""

    def __init__(self, totals: DataFrame) -> None:
        self.few = [r["tokens"] for r in totals.collect()] if small_enough(totals, BROADCAST_ROWS) else None
        self.totals = totals
        if self.few is not None:
            self.total, self.n, self.low, self.high = sum(self.few), len(self.few), min(self.few, default=0), max(self.few, default=0)
        else:
            r = totals.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("tokens").alias("l"), F.max("tokens").alias("h")).first()
            self.total, self.n, self.low, self.high = r["t"], r["n"], r["l"], r["h"]

    def norm(self, a: float) -> float:
        """Sum of share ** a."""
        if self.few is not None:
            return math.fsum((t / self.total) ** a for t in self.few)
        return self.totals.agg(F.sum(F.pow(F.col("tokens") / self.total, F.lit(a)))).first()[0]

    def entropy(self, a: float) -> float:
        """Entropy in nats of the weights share ** a / norm."""
        z = self.norm(a)
        if self.few is not None:
            return -math.fsum((w := (t / self.total) ** a / z) * math.log(w) for t in self.few)
        w = F.pow(F.col("tokens") / self.total, F.lit(a)) / z
        return -self.totals.agg(F.sum(w * F.log(w))).first()[0]

    def repetition(self, a: float, budget: float | None) -> float:
        """Most times that a source's tokens are read."""
        if budget is None:  # the least budget that reads every source once in full
            return max((self.low / self.high) ** (a - 1.0), (self.high / self.low) ** (a - 1.0))
        z = self.norm(a)
        return max(budget / self.total * (t / self.total) ** (a - 1.0) / z for t in (self.low, self.high))


def least_exponent(holds) -> float:
    """The least exponent between 0 (equal weights) and 1 (natural shares) for which ``holds``; 1 if none below does."""
    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(_STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def _draw(docs: DataFrame, max_repetition: float | None = 1.5, target_entropy: float | None = None, budget: int | None = None, block_docs: int = BLOCK_DOCS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as a struct ``d``, as often as they are drawn, with the columns mix_*."""
    source = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null"))
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), source.alias("mix_source"), _token_count(F.col(text_col)).alias("mix_tokens"), F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("null"), F.col(text_col), F.lit(seed))).otherwise(F.xxhash64(F.col(id_col), F.lit(seed))).alias("_hash"))
    rows = materialise(marked.select("mix_source", "mix_tokens", "_hash"), "mix-rows")
    totals = materialise(rows.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-totals")
    spoken = totals.where("tokens > 0")
    shares = Shares(spoken)
    exponent, z, whole = 1.0, 1.0, 0.0
    if shares.n:
        limits = [0.0]
        if max_repetition is not None:
            limits.append(least_exponent(lambda a: shares.repetition(a, budget) <= max_repetition))
        if target_entropy is not None:
            limits.append(least_exponent(lambda a: shares.entropy(a) <= target_entropy * math.log(max(shares.n, 2))))
        exponent = max(limits)
        z = shares.norm(exponent)
        weight_of = lambda t: (t / shares.total) ** exponent / z
        whole = float(budget) if budget is not None else max(t / weight_of(t) for t in (shares.low, shares.high))

    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(shares.total or 1), F.lit(exponent)) / z).otherwise(0.0)
    quota = F.greatest(F.floor(F.col("weight") * whole + 1e-6), F.when(F.lit(budget is None), F.col("tokens")).otherwise(0))
    plan = totals.withColumn("weight", weight).withColumn("quota", quota.cast("long"))
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1 if budget is None else 0).cast("long"))
    plan = plan.withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens")).withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long"))
    plan = materialise(plan, "mix-plan")

    def order(epoch) -> F.Column:
        return F.xxhash64("mix_source", "mix_block", epoch)

    dealt = rows.join(sized(plan.where("rest > 0")), "mix_source").withColumn("mix_block", F.pmod("_hash", "blocks"))
    sums = dealt.groupBy("mix_source", "mix_block", "full", "rest").agg(F.sum("mix_tokens").alias("n")).withColumn("mix_order", order(F.col("full")))
    until = Window.partitionBy("mix_source").orderBy("mix_order", "mix_block")
    ends = sums.withColumn("end", F.sum("n").over(until.rowsBetween(Window.unboundedPreceding, 0))).where("end > rest")
    ends = ends.withColumn("r", F.row_number().over(until)).where("r = 1").select("mix_source", "mix_block", F.col("mix_order").alias("last_order"), (F.col("rest") - F.col("end") + F.col("n")).alias("room"))
    ends = materialise(ends, "mix-ends")
    inside = dealt.select("mix_source", "mix_block", "mix_tokens", F.xxhash64("_hash", "full").alias("place")).join(sized(ends), ["mix_source", "mix_block"])
    upto = Window.partitionBy("mix_source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("sum", F.sum("mix_tokens").over(upto)).where("sum <= room").groupBy("mix_source").agg(F.max("place").alias("last_place"))
    params = plan.join(ends.select("mix_source", "last_order"), "mix_source", "left").join(last, "mix_source", "left")
    params = materialise(params.select("mix_source", "blocks", "full", "weight", "last_order", "last_place", F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(F.col("full")).alias("mix_passes")), "mix-params")

    out = marked.join(sized(params), "mix_source").withColumn("mix_block", F.pmod("_hash", "blocks"))
    final, place = order(F.col("full")), F.xxhash64("_hash", "full")
    more = F.coalesce((final < F.col("last_order")) | ((final == F.col("last_order")) & (place <= F.col("last_place"))), F.lit(False))
    passes = F.col("full") + more.cast("long")
    out = out.withColumn("_passes", passes).where("_passes > 0").withColumn("mix_pass", F.explode(F.expr("sequence(0L, _passes - 1)")))
    out = out.withColumn("mix_order", order(F.col("mix_pass")))
    return out.select("d", "mix_source", "mix_tokens", F.col("weight").alias("mix_weight"), "mix_passes", "mix_pass", "mix_block", "mix_order")


def draws(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mixture reads it, and the columns mix_*.

    A source's weight is its share of tokens to an exponent from 0 to 1, normalised. Bisection finds the least exponent
    (the flattest mixture) whose most repeated source stays within ``max_repetition``, or, with ``target_entropy``
    (a part of that of equal weights), the exponent that meets it; of two limits the stricter holds. ``budget`` is in
    tokens; by default it is the least that reads every document at least once. A source's part of it is whole passes
    over its documents and a last, partial one: documents are dealt into blocks of about ``block_docs`` by the hash of their
    id, blocks follow in an order drawn anew for each pass, and the last pass ends where the next document (or the
    next few with one hash) would exceed the budget. Only block sums and one block a source are looked at for that, so
    no source is gathered and texts are not shuffled.

    mix_source, mix_tokens, mix_weight, mix_passes (budget over tokens of the source), mix_pass (0, 1, ..), mix_block and
    mix_order (sort by pass, order and id to read a source). A null source is a source. Sources without tokens have weight 0 and
    are read once if there is no budget. Rows without an id have a place by their text; repeated rows are drawn together; texts
    of any length count whole. Columns of ``docs`` stay, and none may be named like those added; an empty table gives none.
    """
    if any(c.lower().startswith("mix_") for c in docs.columns):
        raise ValueError("columns named mix_* would clash; use mixed()")
    return _draw(docs, **options).select("d.*", "mix_source", "mix_tokens", "mix_weight", "mix_passes", "mix_pass", "mix_block", "mix_order")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as ``draws`` repeats them, with their own columns only, whatever these are named."""
    return _draw(docs, **options).select("d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = draws(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_passes").alias("passes"), F.col("mix_pass").alias("pass"), F.col("mix_block").alias("block"), F.col("mix_order").alias("block_order"))
