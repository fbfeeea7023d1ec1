"""Matching messages to FAQs and chunks by tokens, edit ratio and vectors, the gates on weak matches, and the cascade of passes.

Texts of a shop are looked up once, however many messages repeat them. Shared words, edit ratios and
vectors are taken block by block on both sides, so pairs never leave a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..functions import text as x
from ..plans import tables as t
from ..plans import scratch, vectors
from ..plans.sizing import sized
from . import items as it

STOP = ["the", "and", "for", "der", "die", "und", "of", "in", "de", "la", "le", "en", "el", "les", "des", "ing", "er", "ed", "th", "st"]
# Least scores of the passes and gates.
F1_LEAST, FUZZY_LEAST, SHOP_ENGLISH, SHOP_MANGLISH, GENERIC_LEAST = 0.45, 70.0, 0.55, 0.45, 0.42
WIN_ENGLISH, WIN_MANGLISH, GATE_ENGLISH, GATE_MANGLISH, SURE, DISCLAIMER, CHUNK_LEAST = 0.58, 0.45, 0.62, 0.52, 0.75, 0.85, 0.35
NEAR_TIE = 0.03
#: Rows of a block where each row of one side meets each of the other; rows and letters of a block of word sets.
BLOCK, WORD_BLOCK, BLOCK_LETTERS = 2000, 4000, 8 << 20


def top(rows: DataFrame, key: str, order: list, n: int = 1) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def phrasings(faqs: DataFrame) -> DataFrame:
    """(slug, faq_pos, phrase_pos, phrase): the question and its variants, blanks dropped."""
    every = F.filter(F.transform(F.concat(F.array("q"), F.coalesce("variants", F.array().cast("array<string>"))), lambda v: F.trim(v)), lambda v: v != "")
    return faqs.select("slug", "faq_pos", F.posexplode(every).alias("phrase_pos", "phrase"))


def _joined(rows: DataFrame, words: Column, *columns) -> DataFrame:
    """Rows that have words, with those of a text in one string, and their number ``n``."""
    held = rows.withColumn("_w", words).where("size(_w) > 0")
    return held.select("slug", *columns, F.array_join("_w", " ").alias("words"), F.size("_w").alias("n"))


def text_key(rows: DataFrame) -> DataFrame:
    """Rows with the key of a shop's text."""
    return rows.withColumn("key", F.md5(F.concat("slug", F.lit("\0"), "message").cast("binary")))


def shared_words(asked: pa.ChunkedArray, known: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """For each of ``asked`` how many of its words each of ``known`` has; a text is its distinct words, joined by spaces."""
    a, b = (pc.split_pattern(pa.chunked_array(side.chunks, side.type).combine_chunks(), " ") for side in (asked, known))
    flat = [pc.list_flatten(side) for side in (a, b)]
    codes = pa.concat_arrays([v for side in flat for v in (side.chunks if isinstance(side, pa.ChunkedArray) else [side])]).dictionary_encode()
    ids, words = codes.indices.to_numpy(), len(codes.dictionary)
    own, other = ids[: len(flat[0])], ids[len(flat[0]) :]
    lengths = [pc.list_value_length(side).to_numpy(zero_copy_only=False) for side in (a, b)]
    order = np.argsort(other, kind="stable")
    holders, begin = np.repeat(np.arange(len(b)), lengths[1])[order], np.searchsorted(other[order], np.arange(words + 1))
    at = 0
    for n in lengths[0]:
        posts = [holders[begin[w] : begin[w + 1]] for w in own[at : at + n]]
        at += n
        yield np.bincount(np.concatenate(posts), minlength=len(b))


def _in_blocks(asked: DataFrame, known: DataFrame, by: str, best: Callable, schema: str, block: int) -> DataFrame:
    """``best(asked, known)`` of each pair of blocks of a shop's two sides (``_joined``): no row leaves a task but those that ``best`` gives."""
    size = lambda out: F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum(F.length("words")) / F.lit(BLOCK_LETTERS))).alias(out)
    parts = sized(asked.groupBy("slug").agg(size("m_parts")).join(known.groupBy("slug").agg(size("f_parts")), "slug"))
    m = _dealt(asked, "slug", "key", ("m_part", "m_parts"), ("f_part", "f_parts"), parts)
    f = _dealt(known, "slug", by, ("f_part", "f_parts"), ("m_part", "m_parts"), parts)
    return _met(m, f, ["slug", "m_part", "f_part"]).applyInArrow(best, schema)


def faq_f1(messages: DataFrame, faqs: DataFrame, least: float = F1_LEAST, block: int = WORD_BLOCK) -> DataFrame:
    """Best FAQ of the shop by the F1 of token sets, over all phrasings; the earlier one on ties: (msg_id, faq_pos, score).

    The words that most texts of a language have in common leave hardly a pair out, so pairs never become rows: a block of
    texts meets a block of phrasings, shared words are counted from the postings of the block, and a text's best leaves it.
    """
    words = lambda c: F.array_distinct(x.words(F.col(c)))
    asked = scratch.table(_joined(text_key(it.texts(messages)), words("message"), "key"), "f1-texts")
    known = scratch.table(_joined(phrasings(faqs), words("phrase"), F.col("faq_pos").cast("long").alias("faq_pos"), "phrase_pos"), "f1-phrasings")

    def best(m: pa.Table, f: pa.Table) -> pa.Table:
        found = []
        if len(m) and len(f):
            f = f.sort_by("faq_pos")
            pos, sizes, needs = f.column("faq_pos").to_numpy(), f.column("n").to_numpy().astype(np.int64), {}
            for key, n, counts in zip(m.column("key").to_pylist(), m.column("n").to_pylist(), shared_words(m.column("words"), f.column("words"))):
                if n not in needs:
                    needs[n] = np.maximum(np.ceil((least - 1e-4) * (sizes + n) / 2 - 1e-9), 1)
                few = np.flatnonzero(counts >= needs[n])
                if len(few):
                    # to four decimals, half up
                    score = (40000 * counts[few] + sizes[few] + n) // (2 * (sizes[few] + n))
                    k = int(score.argmax())
                    found.append((key, pos[few[k]], score[k] / 1e4))
        return pa.table([pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.float64()))], ["key", "faq_pos", "score"])

    scored = _in_blocks(asked, known, "phrase_pos, faq_pos", best, "key string, faq_pos long, score double", block).where(F.col("score") >= least)
    one = scored.groupBy("key").agg(F.max_by(F.struct("faq_pos", "score"), F.struct("score", -F.col("faq_pos"))).alias("f"))
    return text_key(messages).join(one, "key").select("msg_id", "f.*")


def _parts(rows: DataFrame, key: str, out: str, block: int) -> DataFrame:
    """Blocks of a key's rows, from a count of them."""
    return rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias(out))


def _dealt(rows: DataFrame, key: str, by: str, own: tuple[str, str], other: tuple[str, str], parts: DataFrame) -> DataFrame:
    """Rows in their own block, once for every block of the other side."""
    out = rows.join(parts, key).withColumn(own[0], F.pmod(F.xxhash64(*by.split(", ")), F.col(own[1])))
    return out.withColumn(other[0], F.explode(F.expr(f"sequence(0L, {other[1]} - 1)"))).drop(own[1], other[1])


def _met(m: DataFrame, f: DataFrame, keys: list[str]):
    """Both sides' blocks by ``keys``, over all tasks: their work is in pairs, so tasks are not merged for having few bytes."""
    tasks = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return m.repartition(tasks, *keys).groupBy(*keys).cogroup(f.repartition(tasks, *keys).groupBy(*keys))


def faq_fuzzy(messages: DataFrame, faqs: DataFrame, least: float = FUZZY_LEAST, block: int = BLOCK, asked_block: int = 48) -> DataFrame:
    """Best FAQ of the shop by token set ratio over all phrasings, the earlier one on ties: (msg_id, faq_pos, score from 0 to 100).

    A ratio bounds no word that both sides share, so each distinct text is compared with all of its shop's phrasings, block
    by block on both sides; lengths and letter counts rule most out, an alignment ends once it cannot reach the best so far,
    and only a text's best of a block leaves it. Grams of letters bound nothing here: two texts of n letters at a ratio of 70 may
    share as few as n / 10 - 1 pairs of letters, which unlike texts of a language exceed.
    """
    asked, known = it.texts(messages), phrasings(faqs)
    parts = _parts(asked, "slug", "m_parts", min(block, asked_block)).join(_parts(known, "slug", "f_parts", block), "slug")
    parts = sized(parts)
    m = _dealt(asked, "slug", "message", ("m_part", "m_parts"), ("f_part", "f_parts"), parts)
    f = _dealt(known, "slug", "phrase", ("f_part", "f_parts"), ("m_part", "m_parts"), parts)

    def best(m: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["faq_pos", "phrase_pos"])
        found = ratio.best_token_set([v.lower() for v in m.message], [v.lower() for v in f.phrase], least)
        rows = [(slug, text, f.faq_pos.iat[k], score) for slug, text, (k, score) in zip(m.slug, m.message, found) if k >= 0]
        return pd.DataFrame(rows, columns=["slug", "message", "faq_pos", "score"]).astype({"slug": object, "message": object, "faq_pos": "int64", "score": "float64"})

    found = _met(m, f, ["slug", "m_part", "f_part"]).applyInPandas(best, "slug string, message string, faq_pos long, score double")
    one = found.groupBy("slug", "message").agg(F.max_by(F.struct("faq_pos", "score"), F.struct("score", -F.col("faq_pos"))).alias("f"))
    return messages.join(one, ["slug", "message"]).select("msg_id", "f.*")


def vector_top(queries: DataFrame, rows: DataFrame, key: str, n: int = 1, least: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Top rows of each query by cosine within ``key``: (q, key, qv) against (r, key, rv) of unit vectors -> (q, r, score).

    Both sides of a key are dealt to blocks of a counted size; a pair of blocks is one product, of which each query's top
    ``n`` leave, and the blocks' tops are merged. The smaller r comes first on ties, to four decimals.
    """
    # columns of their own, as both sides may come from one table
    queries, rows = queries.select("q", F.concat(F.col(key)).alias(key), "qv"), rows.select("r", F.concat(F.col(key)).alias(key), "rv")
    parts = sized(_parts(queries, key, "q_parts", block).join(_parts(rows, key, "r_parts", block), key))
    asked = _dealt(queries, key, "q", ("q_part", "q_parts"), ("r_part", "r_parts"), parts)
    known = _dealt(rows, key, "r", ("r_part", "r_parts"), ("q_part", "q_parts"), parts)

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        matrix = lambda side, c: pc.list_flatten(side.column(c)).to_numpy().astype(float).reshape(len(side), -1)
        found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(q) and len(r):
            r = r.sort_by("r")
            ids = r.column("r").to_numpy()
            s = (matrix(q, "qv") @ matrix(r, "rv").T).round(4)
            for asks, row in zip(q.column("q").to_numpy(), s):
                few = np.flatnonzero(row >= np.partition(row, len(row) - n)[len(row) - n]) if len(row) > n else np.arange(len(row))
                few = few[np.argsort(-row[few], kind="stable")][:n]
                for out, values in zip(found, (np.full(len(few), asks), ids[few], row[few])):
                    out.append(values)
        return pa.table([np.concatenate(out) for out in found], ["q", "r", "score"])

    keys = [key, "q_part", "r_part"]
    found = asked.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(best, "q long, r long, score double")
    return top(found.withColumn("score", F.round("score", 4)).where(F.col("score") >= least), "q", [F.desc("score"), "r"], n)


def near_ties(scored: DataFrame, within: float = NEAR_TIE, of: int = 5) -> DataFrame:
    """Among the top ``of`` (key, cand, score, overlap), those near the best are ranked again by overlap; the winner keeps its score."""
    w = Window.partitionBy("key")
    near = scored.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "cand"))).where(F.col("r") <= of).withColumn("best", F.max("score").over(w)).where(F.round(F.col("best") - F.col("score"), 4) <= within)
    return top(near, "key", [F.desc("overlap"), "r"]).select("key", "cand", "score")


def hashing_encoder(dims: int = 64) -> Callable:
    """A plain encoder: signed word hashes, as unit vectors. Any Arrow function of a text column that gives unit vectors can stand in its place."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dims, np.float32)
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1 if h >> 16 & 1 else -1
            out.append(v / max(float(np.linalg.norm(v)), 1e-9))
        return pd.Series(out)

    return encode


def by_language(messages: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``pool``: a shop's rows of the message's language (``lang``, ``qlang``), or all of them where it has none."""
    want = F.when(F.col("lang") == "manglish", "ml").otherwise("en")
    has = rows.select("slug", "qlang", F.lit(True).alias("_has")).distinct()
    asked = messages.withColumn("qlang", want).join(sized(has), ["slug", "qlang"], "left").withColumn("pool", F.concat_ws("|", "slug", F.when(F.col("_has"), F.col("qlang")).otherwise("any"))).drop("qlang", "_has")
    either = rows.withColumn("pool", F.explode(F.array(F.concat_ws("|", "slug", "qlang"), F.concat_ws("|", "slug", F.lit("any")))))
    return asked, either.join(sized(asked.select("pool").distinct()), "pool", "left_semi")


def known_words(rows: DataFrame, key: str, text: Column, vocabulary: DataFrame, out: str, stop: list[str] = STOP) -> DataFrame:
    """Rows with the content words of a text that the shop's vocabulary (slug, term) has."""
    words = rows.select(key, "slug", F.explode(F.array_distinct(x.content_words(text, stop))).alias("term")).join(vocabulary.select("slug", "term").distinct(), ["slug", "term"])
    return rows.join(words.groupBy(key).agg(F.collect_set("term").alias(out)), key, "left")


def on_topic(asked: Column, answered: Column) -> Column:
    """Whether the words known on both sides go together: one begins with another, or a side has none."""
    none = lambda a: F.coalesce(F.size(a), F.lit(0)) == 0
    return none(asked) | none(answered) | F.coalesce(F.exists(asked, lambda a: F.exists(answered, lambda b: F.startswith(a, b) | F.startswith(b, a))), F.lit(False))


def faq_vector(messages: DataFrame, embedded: DataFrame, vocabulary: DataFrame | None = None, english: float = SHOP_ENGLISH, manglish: float = SHOP_MANGLISH, disclaimer: float = DISCLAIMER) -> DataFrame:
    """Best FAQ phrasing of the shop by vector: (msg_id, faq_pos, score).

    ``messages``: msg_id, slug, lang, message, vec; ``embedded``: row, slug, faq_pos, qlang, qtext, faq_type, vec. Near ties are
    ranked by shared words. A disclaimer needs a higher score, and with a ``vocabulary`` the winner must be on topic.
    """
    asked, known = by_language(messages, embedded)
    best = vector_top(asked.select(F.col("msg_id").alias("q"), "pool", F.col("vec").alias("qv")), known.select(F.col("row").alias("r"), "pool", F.col("vec").alias("rv")), "pool", 5)
    texts = best.join(messages.select(F.col("msg_id").alias("q"), "slug", "message", "lang"), "q").join(embedded.select(F.col("row").alias("r"), "faq_pos", "qtext", "faq_type"), "r")
    scored = texts.withColumn("overlap", F.round(x.jaccard(F.array_distinct(x.words(F.col("message"))), F.array_distinct(x.words(F.col("qtext")))), 6))
    won = near_ties(scored.select(F.col("q").alias("key"), F.col("r").alias("cand"), "score", "overlap")).select(F.col("key").alias("q"), F.col("cand").alias("r"))
    won = texts.join(won, ["q", "r"]).where(F.col("score") >= F.when(F.col("lang") == "manglish", manglish).otherwise(english)).where((F.coalesce("faq_type", F.lit("")) != "disclaimer") | (F.col("score") >= disclaimer))
    if vocabulary is not None:
        won = known_words(known_words(won, "q", F.col("message"), vocabulary, "asked"), "q", F.col("qtext"), vocabulary, "answered").where(on_topic(F.col("asked"), F.col("answered")))
    return won.select(F.col("q").alias("msg_id"), "faq_pos", "score")


def chunks_for(questions: DataFrame, chunks: DataFrame, n: int = 5, stop: list[str] = STOP, block: int = WORD_BLOCK) -> DataFrame:
    """Top chunks (slug, chunk_pos, text) of the shop by shared words over the question's words: (msg_id, chunk_pos, score).

    A question that is all stop words takes the shop's first chunks at 0.1. Questions and chunks meet in blocks as in
    ``faq_f1``; a question's first ``n`` chunks of a block leave it.
    """
    tokens = lambda c: F.array_distinct(F.filter(x.words(F.col(c)), lambda w: ~F.array_contains(x.lit_array(stop), w)))
    texts = text_key(it.texts(questions))
    asked = scratch.table(_joined(texts, tokens("message"), "key"), "chunk-questions")
    known = scratch.table(_joined(chunks, tokens("text"), F.col("chunk_pos").cast("long").alias("chunk_pos")), "chunk-words")

    def best(m: pa.Table, f: pa.Table) -> pa.Table:
        keys, found = [], [[np.empty(0, np.int64)] for _ in range(3)]
        if len(m) and len(f):
            f = f.sort_by("chunk_pos")
            pos = f.column("chunk_pos").to_numpy()
            for key, size, counts in zip(m.column("key").to_pylist(), m.column("n").to_pylist(), shared_words(m.column("words"), f.column("words"))):
                # the n-th best count, of at least a word
                least = max(1, len((many := np.cumsum(np.bincount(counts)[::-1]))) - 1 - int(np.searchsorted(many, n)))
                few = np.flatnonzero(counts >= least)
                few = few[np.argsort(-counts[few], kind="stable")][:n]
                keys += [key] * len(few)
                for out, values in zip(found, (pos[few], counts[few], np.full(len(few), size))):
                    out.append(values)
        return pa.table([pa.array(keys, pa.string()), *[pa.array(np.concatenate(out)) for out in found]], ["key", "chunk_pos", "c", "n"])

    met = _in_blocks(asked, known, "chunk_pos", best, "key string, chunk_pos long, c long, n long", block)
    scored = met.select("key", "chunk_pos", F.round(F.col("c") / F.col("n"), 6).alias("score"))
    first = top(chunks.select("slug", "chunk_pos"), "slug", ["chunk_pos"], n)
    bare = texts.where(F.size(tokens("message")) == 0).join(first, "slug").select("key", "chunk_pos", F.lit(0.1).alias("score"))
    ranked = top(scored.unionByName(bare), "key", [F.desc("score"), "chunk_pos"], n)
    return text_key(questions).join(ranked, "key").select("msg_id", "chunk_pos", "score")


def chunks_by_vector(questions: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """Top chunks of the shop by cosine; both sides have a vec."""
    found = vector_top(questions.select(F.col("msg_id").alias("q"), "slug", F.col("vec").alias("qv")), chunks.select(F.col("chunk_pos").alias("r"), "slug", F.col("vec").alias("rv")), "slug", n, -1.0)
    return found.select(F.col("q").alias("msg_id"), F.col("r").alias("chunk_pos"), "score")


def passes_gate(score: Column, source: Column, lang: Column, message: Column, faq_text: Column, stop: list[str] = STOP) -> Column:
    """Answers from items pass; a FAQ needs the gate of its language, and below ``SURE`` a word of three letters shared with the message, unless that has none."""
    exact = source.isin("category_list", "item_lookup", "item_lookup_fallback")
    asked = x.content_words(message, stop)
    shares = (F.size(asked) == 0) | F.arrays_overlap(asked, x.words(F.coalesce(faq_text, F.lit(""))))
    return exact | ((score >= F.when(lang == "manglish", GATE_MANGLISH).otherwise(GATE_ENGLISH)) & ((score >= SURE) | F.coalesce(shares, F.lit(False))))


def chunk_grounds(score: Column, message: Column, text: Column, stop: list[str] = STOP) -> Column:
    """A chunk answers from ``CHUNK_LEAST`` on if it shares a word, no stop word, with the message."""
    words = lambda c: F.filter(x.words(c), lambda w: ~F.array_contains(x.lit_array(stop), w))
    return F.coalesce((score >= CHUNK_LEAST) & F.arrays_overlap(words(message), words(text)), F.lit(False))


def generic_pools(messages: DataFrame, pool: DataFrame, intents: list[str]) -> tuple[DataFrame, DataFrame]:
    """Messages with the keys of their generic pool (``slug``) and of its part for their intent, and the pool's FAQs by such keys.

    A pool is a language's FAQs that apply to the shop's type, for a bad mood with those for moods first. ``intent_key`` is
    null where no FAQ of the pool has the intent in its section.
    """
    key = F.concat_ws("|", "lang", F.coalesce("shop_type", F.lit("")), F.col("bad").cast("string"))
    asked = messages.withColumn("slug", key)
    kinds = asked.select("slug", "lang", "shop_type", "bad").distinct()
    applies = F.coalesce(F.size("shop_types") <= 0, F.lit(True)) | F.array_contains("shop_types", "all") | F.coalesce(F.array_contains("shop_types", F.col("shop_type")), F.lit(False))
    rows = pool.join(sized(kinds), "lang").where(applies & (F.col("bad") | ~F.col("mood")))
    rows = rows.select("slug", F.when(F.col("mood"), F.col("faq_pos")).otherwise(F.col("faq_pos") + F.lit(1 << 40)).alias("faq_pos"), "section", "q", "variants", "vec")
    held = F.array_compact(F.array(*[F.when(F.lower("section").contains(i), F.lit(i)) for i in intents]))
    parts = rows.withColumn("_i", F.explode(held)).withColumn("slug", F.concat_ws("|", "slug", "_i")).drop("_i")
    known = parts.select(F.col("slug").alias("intent_key")).distinct().withColumn("_has", F.lit(True))
    asked = asked.withColumn("intent_key", F.concat_ws("|", "slug", F.when(F.col("intent").isNotNull(), F.col("intent"))))
    asked = asked.withColumn("intent_key", F.when(F.col("intent").isNotNull(), F.col("intent_key"))).join(sized(known), "intent_key", "left").withColumn("intent_key", F.when(F.col("_has"), F.col("intent_key"))).drop("_has")
    return asked, rows.unionByName(parts)


def match_cascade(messages: DataFrame, items: DataFrame, generic: DataFrame | None, embedded: DataFrame, vocabulary: DataFrame, pool: DataFrame, intents: list[str]) -> DataFrame:
    """The answer of each message by the first pass that has one, whole: (msg_id, pass_no, source, faq_pos, score, reply); see ``cascade_passes``."""
    found, lists = cascade_passes(messages, items, generic, embedded, vocabulary, pool, intents)
    return with_replies(found, lists).drop("slug", "keyword", "list_lang")


def with_replies(found: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows with the list of their ``keyword`` (``list_lang`` its language) as their reply; the others as they are."""
    listed = it.with_lists(found.where("keyword is not null").drop("reply"), lists)
    listed = listed.withColumn("reply", it.list_answer(F.col("list_lang")))
    return found.where("keyword is null").unionByName(listed.select(*found.columns))


def cascade_passes(messages: DataFrame, items: DataFrame, generic: DataFrame | None, embedded: DataFrame, vocabulary: DataFrame, pool: DataFrame, intents: list[str]) -> tuple[DataFrame, DataFrame]:
    """The answer of each message by the first pass that has one: (msg_id, pass_no, source, faq_pos, score, reply, slug, keyword, list_lang), and the lists.

    Of a whole category the row has only slug and keyword, the key of its list in (slug, keyword, reply): lists join last.
    ``messages``: msg_id, slug, message, lang, vec, shop_type, bad (mood), greeting, broad, item_ask, about, full, item_intent,
    intent. Passes: 1 a whole category; 2 the shop's FAQ by vector; 3 items, also in place of a weak FAQ, where items are asked
    for; 4 items for a full question; then, unless the intent is about items, the generic pool: 5 the part of the intent and
    6 all of it by vector, 7 by token set ratio, 8 by F1. A question about a service is not answered by items.
    """
    stocked = items.select("slug", F.lit(True).alias("stocked")).distinct()
    m = messages.join(sized(stocked), "slug", "left").withColumn("stocked", F.coalesce("stocked", F.lit(False)))
    m = scratch.table(m.withColumn("asks", F.col("stocked") & F.col("item_ask") & ~F.col("greeting") & ~F.col("broad")), "cascade-messages")
    embedded = scratch.table(embedded, "cascade-faqs")
    line = lambda rows, n, source, pos="cast(null as bigint)", score="1.0", reply="null", own=("null", "null", "null"): rows.selectExpr("msg_id", f"{n} as pass_no", f"{source} as source", f"cast({pos} as bigint) as faq_pos", f"cast({score} as double) as score", f"cast({reply} as string) as reply", *[f"cast({v} as string) as {k}" for k, v in zip(("slug", "keyword", "list_lang"), own)])
    lists = it.keyword_lists(m.where("stocked"), items)
    lists = scratch.table(lists[0], "cascade-categories"), lists[1]
    one = line(lists[0].join(m.where("not greeting").select("msg_id", "lang"), "msg_id"), 1, "'category_list'", own=("slug", "keyword", "lang"))
    one = scratch.table(one, "cascade-lists")
    rest = m.join(one.select("msg_id"), "msg_id", "left_anti")
    faq = scratch.table(faq_vector(rest, embedded, vocabulary).withColumnRenamed("score", "faq_score"), "cascade-vectors")
    single, whole = it.item_replies(rest.where("stocked and not about and (asks or full)"), items, generic, lists[0], F.col("broad"))
    looked = single.select("msg_id", "reply", F.lit(None).cast("string").alias("keyword")).unionByName(whole.select("msg_id", F.lit(None).cast("string").alias("reply"), "keyword"))
    looked = scratch.table(looked.withColumn("looked", F.lit(True)), "cascade-items")
    both = rest.select("msg_id", "slug", "lang", "asks", "full", "stocked", "item_intent").join(faq, "msg_id", "left").join(looked, "msg_id", "left")
    weak = F.col("asks") & F.col("looked") & (F.col("faq_score") < F.when(F.col("lang") == "manglish", WIN_MANGLISH).otherwise(WIN_ENGLISH))
    step = F.when(F.col("faq_score").isNotNull(), F.when(weak, 3).otherwise(2)).when(F.col("looked") & F.col("asks"), 3).when(F.col("looked") & F.col("full"), 4)
    both = scratch.table(both.withColumn("step", step), "cascade-steps")
    two = line(both.where("step = 2"), 2, "concat('shop:', slug)", "faq_pos", "faq_score")
    told = {"reply": "reply", "own": ("slug", "keyword", "lang")}
    three = line(both.where("step = 3"), 3, "'item_lookup'", **told).unionByName(line(both.where("step = 4"), 4, "'item_lookup_fallback'", score="0.9", **told))
    left = m.join(both.where("step is null and not (stocked and item_intent)").select("msg_id"), "msg_id", "left_semi")
    asked, known = (scratch.table(f, "cascade-pool") for f in generic_pools(left, pool, intents))
    rows = known.withColumn("r", F.col("faq_pos"))
    near = lambda a, key: vector_top(a.select(F.col("msg_id").alias("q"), F.col(key).alias("slug"), F.col("vec").alias("qv")), rows.select("slug", "r", F.col("vec").alias("rv")), "slug", 1, GENERIC_LEAST).select(F.col("q").alias("msg_id"), F.col("r").alias("faq_pos"), "score")
    out = one.unionByName(two).unionByName(three)
    open_ = asked
    for n, found, source in ((5, lambda a: near(a.where("intent_key is not null"), "intent_key"), "lang"), (6, lambda a: near(a, "slug"), "lang"), (7, lambda a: faq_fuzzy(a, known).withColumn("score", F.round(F.col("score") / 100, 4)), "concat(lang, '_fuzzy')"), (8, lambda a: faq_f1(a, known), "concat(lang, '_f1')")):
        hit = found(open_).withColumn("faq_pos", F.col("faq_pos") % F.lit(1 << 40)).join(left.select("msg_id", "lang"), "msg_id")
        hit = scratch.table(hit, "cascade-hits")
        # without a part of its own for the intent, the whole pool is what the first of the two searches covers
        out = out.unionByName(line(hit, n, source, "faq_pos", "score"))
        open_ = open_.join(hit.select("msg_id"), "msg_id", "left_anti")
    return out, lists[1]


def answered(routed: DataFrame, cascade: dict, texts: DataFrame) -> DataFrame:
    """Routed messages of which those that no guard caught are answered by the cascade, as far as the answers pass their gate.

    ``routed`` as ``route_messages`` gives it, without matches; ``cascade``: the arguments of ``match_cascade``, whose messages take
    their language in force from ``routed``; ``texts`` (pool, faq_pos, faq_text, answer, escalate) of the FAQs, pool ``shop`` or
    ``generic``. What the gate rejects stays with chunks or a free reply. Adds pass_no and reply (null where a model is to write it).
    """
    rows = scratch.table(routed, "routed")
    asked = scratch.table(cascade["messages"].drop("lang").join(rows.where("route in ('chunk', 'free')").select("msg_id", "lang"), "msg_id"), "open-messages")
    hits, lists = cascade_passes(**(cascade | {"messages": asked}))
    hits = hits.withColumn("pool", F.when(F.col("pass_no") == 2, "shop").when(F.col("pass_no") >= 5, "generic")).join(texts, ["pool", "faq_pos"], "left").join(asked.select("msg_id", "message", "lang"), "msg_id")
    kept = hits.where(passes_gate(F.col("score"), F.col("source"), F.col("lang"), F.col("message"), F.col("faq_text")))
    kept = kept.select("msg_id", F.struct(
        "pass_no", F.lit("match").alias("route"), F.lit("faq").alias("source"), F.col("source").alias("faq_source"), F.coalesce(F.concat(F.lit("faq_"), "faq_pos"), "source").alias("faq_id"), F.col("score").alias("faq_score"),
        F.coalesce("escalate", F.lit(False)).alias("escalate"), F.coalesce("reply", "answer").alias("reply"), "keyword", "list_lang",
    ).alias("_h"))
    out = rows.join(kept, "msg_id", "left").withColumns({c: F.col(f"_h.{c}") for c in ("pass_no", "reply", "keyword", "list_lang")})
    names = ["route", "source", "faq_source", "faq_id", "faq_score", "escalate"]
    out = out.withColumns({c: F.when(F.col("_h").isNotNull(), F.col(f"_h.{c}")).otherwise(F.col(c)) for c in names}).drop("_h")
    return with_replies(out, lists).drop("keyword", "list_lang")


def llm_requests(open_rows: DataFrame, context: DataFrame, temperature: float = 0.3, tokens: int = 200) -> DataFrame:
    """Requests for a model (msg_id, kind, prompt, temperature, max_tokens) of routed messages (msg_id, message, lang, route, answer, answer_lang).

    ``social`` for small talk; ``rephrase_manglish`` or ``rephrase_english`` of an answer in the other language; else a prompt with
    the retrieved chunks (msg_id, text, r), or the bare message. Prices and lists of items are never rephrased.
    """
    c = context.groupBy("msg_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "text"))), lambda v: v["text"]), "\n").alias("ctx"))
    out = open_rows.join(c, "msg_id", "left")
    kind = F.when(F.col("route") == "small_talk", "social").when(F.col("answer").isNotNull() & (F.col("answer_lang") != F.col("lang")), F.concat(F.lit("rephrase_"), "lang")).when(F.col("ctx").isNotNull(), "context").otherwise("free")
    about = F.when(F.col("kind").startswith("rephrase"), F.concat(F.lit("Answer:\n"), "answer")).when(F.col("kind") == "context", F.concat(F.lit("Facts:\n"), "ctx")).when(F.col("kind") == "free", "No facts.")
    heat = F.when(F.col("kind") == "context", temperature / 2).when(F.col("kind") == "social", temperature * 2).otherwise(temperature)
    return out.withColumn("kind", kind).where("answer is null or kind like 'rephrase%'").select("msg_id", "kind", F.concat_ws("\n", about, F.concat(F.lit("Question: "), "message"), F.concat(F.lit("Language: "), "lang")).alias("prompt"), heat.alias("temperature"), F.lit(tokens).alias("max_tokens"))


def clean_replies(replies: DataFrame, preamble: str, denial: str, fallback: str) -> DataFrame:
    """Returned replies (msg_id, kind, had_facts, ok, reply, offer_code, answer) -> (msg_id, reply).

    Preambles go; a denial in spite of facts, an empty reply and one of a degraded model are replaced by the fallback, or, where
    an answer was to be rephrased, by that answer; ``[offer_code]`` is filled in.
    """
    cut = F.trim(F.regexp_replace(F.regexp_replace("reply", preamble, ""), r"(?i)^a:\s*", ""))
    bad = ~F.col("ok") | F.coalesce(cut == "", F.lit(True)) | (F.col("had_facts") & F.coalesce(F.lower(cut).rlike(denial), F.lit(False)))
    code = F.coalesce(x.blank_to_null(F.col("offer_code")), F.lit("our special code"))
    return replies.select("msg_id", F.when(bad, F.coalesce("answer", F.lit(fallback))).otherwise(F.replace(cut, F.lit("[offer_code]"), code)).alias("reply"))


# Registered queries


def _m(s, d):
    return t.messages(s, d)


def _vectors(s, d):
    """Vectors with a shop, a language and a text; those of ids divisible by 20 ask."""
    e = t.read(s, d, "embeddings").join(t.read(s, d, "documents").selectExpr("doc_id as vec_id", "text"), "vec_id", "left")
    e = e.selectExpr("vec_id", f"{_SHOP} as slug", f"{_QLANG} as qlang", "embedding as vec", "coalesce(text, '') as text", f"{_TYPE} as faq_type")
    return e.where("vec_id % 20 = 0").selectExpr("vec_id as msg_id", "slug", "if(vec_id % 40 = 0, 'manglish', 'english') as lang", "text as message", "vec"), e.selectExpr("vec_id as row", "vec_id as faq_pos", "slug", "qlang", "text as qtext", "faq_type", "vec")


_SHOP = "concat('v', cast(label as string))"
_QLANG = "case when vec_id % 3 = 0 and label % 2 = 0 then 'ml' else 'en' end"
_TYPE = "case when vec_id % 7 = 0 then 'disclaimer' end"


def _others(s, d, n: int):
    """The ``n`` best rows of each asking vector in its pool, without itself."""
    asked, known = by_language(*_vectors(s, d))
    best = vector_top(asked.select(F.col("msg_id").alias("q"), "pool", F.col("vec").alias("qv")), known.select(F.col("row").alias("r"), "pool", F.col("vec").alias("rv")), "pool", n + 1, -1.0)
    return top(best.where("q <> r"), "q", [F.desc("score"), "r"], n)


def _ties(s, d):
    m, e = _vectors(s, d)
    rows = _others(s, d, 5).join(m.select(F.col("msg_id").alias("q"), "message"), "q").join(e.select(F.col("row").alias("r"), "qtext"), "r")
    overlap = F.round(x.jaccard(F.array_distinct(x.words(F.col("message"))), F.array_distinct(x.words(F.col("qtext")))), 6)
    return near_ties(rows.select(F.col("q").alias("key"), F.col("r").alias("cand"), "score", overlap.alias("overlap")))


def _chunk_rows(s, d):
    return t.faqs(s, d).select("slug", F.col("faq_pos").alias("chunk_pos"), F.col("a").alias("text"))


def _found(s, d):
    """F1 matches of all messages, as the gate sees them."""
    f = faq_f1(_m(s, d), t.phrased(s, d)).join(_m(s, d).select("msg_id", "message", F.expr(_LANG).alias("lang")), "msg_id")
    return f.join(t.phrased(s, d).select("faq_pos", F.concat_ws(" ", "q", "a").alias("faq_text")), "faq_pos")


_LANG = "case when session_id % 3 = 0 then 'manglish' else 'english' end"


def _grounding(s, d):
    """Which F1 matches and which best chunks ground an answer."""
    f = _found(s, d).select("msg_id", F.lit("faq").alias("kind"), "faq_pos", "score", passes_gate(F.col("score"), F.lit("english_f1"), F.col("lang"), F.col("message"), F.col("faq_text")).alias("passes"))
    c = chunks_for(_m(s, d), _chunk_rows(s, d), 1).join(_m(s, d).select("msg_id", "message"), "msg_id").join(_chunk_rows(s, d).select("chunk_pos", "text"), "chunk_pos")
    return f.unionByName(c.select("msg_id", F.lit("chunk").alias("kind"), F.col("chunk_pos").alias("faq_pos"), "score", chunk_grounds(F.col("score"), F.col("message"), F.col("text")).alias("passes")))


def _cascade(s, d):
    return match_cascade(**cascade_inputs(s, d)).drop("reply").withColumn("pass_no", F.col("pass_no").cast("int"))


def cascade_inputs(s, d) -> dict:
    """All messages and questions about items, with the FAQs of the shops as their FAQ rows and the benchmark as the generic pool."""
    encode = hashing_encoder()
    spoken = t.messages(s, d).selectExpr("msg_id", "slug", "message", f"{_LANG} as lang")
    m = spoken.unionByName(t.asks(s, d).selectExpr("-1 - msg_id as msg_id", "slug", "message", "lang")).withColumn("vec", encode("message"))
    w = x.words(F.col("message"))
    has = lambda *v: F.arrays_overlap(w, x.lit_array(v))
    m = m.withColumns({
        "shop_type": F.expr("if(slug = 'shop-1', 'bakery', 'salon')"), "bad": F.col("message").contains("ough"), "greeting": has("hello"), "broad": F.lower("message").contains("services undo"), "item_ask": has("undo", "have", "price"), "about": has("included"),
        "full": has("is", "do") & (F.size(w) >= 3), "item_intent": has("price", "undo"), "intent": F.when(has("de", "la"), "returns").when(has("the"), "delivery"),
    })
    faqs = t.phrased(s, d)
    embedded = phrasings(faqs).join(faqs.select("slug", "faq_pos", "faq_type"), ["slug", "faq_pos"]).selectExpr("faq_pos * 10 + phrase_pos as row", "slug", "faq_pos", "if(faq_pos % 4 = 0, 'ml', 'en') as qlang", "phrase as qtext", "faq_type").withColumn("vec", encode("qtext"))
    pool = t.read(s, d, "benchmark").selectExpr("item_id as faq_pos", "if(item_id % 2 = 0, 'english', 'manglish') as lang", "item_id % 5 = 0 as mood", "case when item_id % 3 = 0 then array('bakery') when item_id % 3 = 1 then array('all') end as shop_types", "if(item_id % 4 = 0, 'Delivery', 'Returns policy') as section", "text as q", "array(upper(text)) as variants").withColumn("vec", encode("q"))
    described = t.described(s, d)
    from .analytics import vocabulary

    return {"messages": m, "items": described, "generic": it._generic(described), "embedded": embedded, "vocabulary": vocabulary(described, STOP), "pool": pool, "intents": ["delivery", "returns"]}


def cascade_texts(s, d) -> DataFrame:
    """Texts of the shops' FAQs and of the generic pool."""
    shop = t.phrased(s, d).select(F.lit("shop").alias("pool"), "faq_pos", F.concat_ws(" ", "q", "a").alias("faq_text"), F.col("a").alias("answer"), (F.col("faq_pos") % 9 == 0).alias("escalate"))
    pool = t.read(s, d, "benchmark").select(F.lit("generic").alias("pool"), F.col("item_id").cast("bigint").alias("faq_pos"), F.col("text").alias("faq_text"), F.col("text").alias("answer"), F.lit(False).alias("escalate"))
    return shop.unionByName(pool)


def _rte_cascade(s, d):
    """All messages, and the questions about items, through the guards and the cascade."""
    from . import message_queries as mq

    asks = t.asks(s, d).selectExpr("-1L - msg_id as msg_id", "slug", "cast(null as bigint) as session_id", "msg_id as turn", "message")
    routed = mq.routed(s, d, context=t.faqs(s, d).where("slug <> 'shop-3'"), messages=t.messages(s, d).unionByName(asks.withColumn("turn", F.col("turn").cast("int"))))
    return answered(routed, cascade_inputs(s, d), cascade_texts(s, d)).drop("message")


def _blended(s, d):
    """Each asking vector with three quarters of the next one's, as a unit vector: near to several rows, the same as none."""
    m, e = _vectors(s, d)
    after = e.select((F.col("row") - 1).alias("msg_id"), F.col("vec").alias("_next"))
    sums = F.zip_with("vec", "_next", lambda a, b: a.cast("double") + 0.75 * b.cast("double"))
    m = m.join(after, "msg_id").withColumn("vec", sums)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    return m.withColumn("_n", norm).withColumn("vec", F.transform("vec", lambda v: v / F.col("_n"))).drop("_n", "_next"), e


def _guarded(s, d):
    """FAQs by vector with thresholds by language, the higher one of disclaimers, and the guard of topics by a shop's words."""
    m, e = _blended(s, d)
    words = e.where("row % 3 = 0").select("slug", F.explode(F.array_distinct(x.content_words(F.col("qtext"), STOP))).alias("term")).where("length(term) > 6").distinct()
    return faq_vector(m, e, words, 0.55, 0.45, 0.7)


def _chunk_vectors(s, d):
    m, e = _blended(s, d)
    return chunks_by_vector(m, e.select("slug", F.col("row").alias("chunk_pos"), "vec"))


def _probed(s, d):
    """The nearest other row by an inverted file, its lists searched as far as their bounds leave open."""
    asked, known = by_language(*_vectors(s, d))
    index = vectors.build(known.select(F.col("row").alias("r"), "pool", F.col("vec").alias("rv")), "pool")
    best = vectors.search(index, asked.select(F.col("msg_id").alias("q"), "pool", F.col("vec").alias("qv")), "pool", 2)
    return top(best.where("q <> r"), "q", [F.desc("score"), "r"]).select("q", "r", "score")


def _requests(s, d):
    """Requests of all messages: a third have an answer in a language, others go with the chunks that ground them."""
    m = _m(s, d).selectExpr("msg_id", "slug", "message", f"{_LANG} as lang", "if(turn = 0 and session_id % 5 = 0, 'small_talk', 'open') as route", "case when session_id % 4 = 1 then substring(message, 3) end as answer", "if(session_id % 2 = 0, 'manglish', 'english') as answer_lang")
    c = chunks_for(m, _chunk_rows(s, d), 2).where(F.col("score") >= CHUNK_LEAST).join(_chunk_rows(s, d).select("chunk_pos", "text"), "chunk_pos").select("msg_id", "text", F.col("chunk_pos").alias("r"))
    return llm_requests(m, c)


def _replies(s, d):
    r = t.faqs(s, d).selectExpr("faq_pos as msg_id", "concat(case faq_pos % 4 when 0 then 'Sure! ' when 1 then 'A: ' else '' end, a, if(faq_pos % 3 = 0, ' [offer_code]', '')) as reply", "faq_pos % 8 < 4 as had_facts", "faq_pos % 7 <> 0 as ok", "if(faq_pos % 2 = 0, 'X5', ' ') as offer_code", "if(faq_pos % 14 = 0, q, null) as answer")
    return clean_replies(r, "^Sure! ", "thon", "Please ask us.")


def overlay(found: DataFrame, defaults: dict[str, str | None], required: list[str]) -> DataFrame:
    """Extracted shop values over defaults, ignoring blanks and N/A, and which required fields were not found."""
    real = lambda c: F.when(~F.upper(F.trim(F.col(c).cast("string"))).isin("", "N/A"), F.col(c))
    missing = F.array_join(F.array_compact(F.array(*[F.when(real(c).isNull(), F.lit(c)) for c in required])), ",")
    return found.select("slug", *[F.coalesce(real(c), F.lit(v)).alias(c) for c, v in defaults.items()], missing.alias("missing"))


def _overlay(s, d):
    shops = t.shops(s, d).selectExpr("slug", "if(shop_pos % 3 = 0, ' ', shop_name) as shop_name", "if(shop_pos % 2 = 0, 'N/A', city) as city", "if(shop_pos % 5 = 0, null, concat('+91 ', shop_pos)) as phone", "if(shop_pos % 4 = 0, 'n/a', 'UPI') as payment")
    return overlay(shops, {"shop_name": "My shop", "city": None, "phone": None, "payment": "UPI, Cash"}, ["shop_name", "city", "phone", "payment"])


def with_config(messages: DataFrame, config: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Messages with their shop's settings; unknown shops and missing values take the defaults."""
    return messages.join(sized(config), "slug", "left").withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


QUERIES = {
    "jn_config": lambda s, d: with_config(_m(s, d), t.shops(s, d).select("slug", "shop_name", "city"), {"shop_name": "My shop", "city": ""}).select("msg_id", "shop_name", "city"),
    "jn_profile": lambda s, d: t.shops(s, d).withColumn("kind", F.element_at(x.lit_array(["bakery", "salon", "zoo"]), (F.col("shop_pos") % 3 + 1).cast("int"))).select("slug", F.coalesce(F.try_element_at(x.lit_map({"bakery": "cakes", "salon": "services"}), F.col("kind")), F.lit("items")).alias("label")),
    "jn_faq_f1": lambda s, d: faq_f1(_m(s, d), t.phrased(s, d)),
    "jn_faq_fuzzy": lambda s, d: faq_fuzzy(_m(s, d), t.phrased(s, d)),
    "jn_faq_vector": lambda s, d: _others(s, d, 1),
    "jn_faq_vector_index": _probed,
    "jn_faq_vector_guarded": _guarded,
    "jn_chunk_vector": _chunk_vectors,
    "rte_cascade": _rte_cascade,
    "jn_chunk": lambda s, d: chunks_for(_m(s, d), _chunk_rows(s, d)),
    "flt_grounding": _grounding,
    "win_near_tie": _ties,
    "jn_match_cascade": _cascade,
    "gen_llm_requests": _requests,
    "prj_llm_reply": _replies,
    "prj_config_overlay": _overlay,
}
_WORDS = it._WORDS
_STOPS = it._lit(STOP)


def _best(inner: str, n: int, order: str, key: str = "msg_id") -> str:
    return f"(select * exclude (rk) from (select *, row_number() over (partition by {key} order by {order}) as rk from ({inner})) where rk <= {n})"


def _set(c: str) -> str:
    return f"list_distinct({_WORDS.format(c)})"


def _content(c: str) -> str:
    return f"list_filter({_WORDS.format(c)}, lambda w: length(w) >= 3 and not list_contains({_STOPS}, w))"


_PHRASED = f"(select slug, faq_pos, q, a, unnest(list_filter(list_transform(list_concat([q], variants), lambda v: trim(v)), lambda v: v <> '')) as phrase from {t.PHRASED})"
_SCORES = f"""select msg_id, faq_pos, max(round(case when len(list_intersect(a, b)) > 0 then 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) else 0.0 end, 4)) as score from (select msg_id, slug, {_set('message')} as a from {t.MESSAGES}) join (select slug, faq_pos, {_set('phrase')} as b from {_PHRASED}) using (slug) group by msg_id, faq_pos"""
_F1 = _best(f"select * from ({_SCORES}) where score >= {F1_LEAST}", 1, "score desc, faq_pos")
_TOKENS = "list_filter({0}, lambda w: not list_contains(" + _STOPS + ", w))"
_ASKED = f"(select msg_id, slug, session_id, turn, message, {_TOKENS.format(_set('message'))} as a from {t.MESSAGES})"
_CHUNKS = f"(select slug, faq_pos as chunk_pos, a as text, {_TOKENS.format(_set('a'))} as b from {t.FAQS})"
_CHUNK = f"""select msg_id, chunk_pos, case when len(a) = 0 then 0.1 else round(len(list_intersect(a, b)) / len(a), 6) end as score from {_ASKED} join {_CHUNKS} using (slug) where len(a) = 0 or len(list_intersect(a, b)) > 0"""
_COS = "round(list_sum(list_transform(range(1, 65), lambda i: cast(q.embedding[i] as double) * cast(r.embedding[i] as double))), 4)"
_EMB = f"(select vec_id, label, embedding, {_QLANG} as qlang, case when vec_id % 40 = 0 then 'ml' else 'en' end as want from embeddings)"
_VEC = f"select q.vec_id as q, r.vec_id as r, {_COS} as score from {_EMB} q join {_EMB} r on q.label = r.label and q.vec_id % 20 = 0 and q.vec_id <> r.vec_id and (q.want = r.qlang or (q.label, q.want) not in (select (label, qlang) from {_EMB}))"
_TEXTS = "(select vec_id, coalesce(text, '') as text from embeddings left join documents on vec_id = doc_id)"
_JACC = f"round(case when len(list_distinct(list_concat({_set('m.text')}, {_set('c.text')}))) > 0 then len(list_intersect({_set('m.text')}, {_set('c.text')})) / len(list_distinct(list_concat({_set('m.text')}, {_set('c.text')}))) else 0.0 end, 6)"
_BLEND = f"""(select msg_id, slug, want, text, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from (select a.vec_id as msg_id, a.label as slug, a.want, m.text,
  list_transform(range(1, 65), lambda i: cast(a.embedding[i] as double) + 0.75 * cast(b.embedding[i] as double)) as v from {_EMB} a join {_EMB} b on b.vec_id = a.vec_id + 1 join {_TEXTS} m on m.vec_id = a.vec_id where a.vec_id % 20 = 0))"""
_DOT = "round(list_sum(list_transform(range(1, 65), lambda i: q.v[i] * cast(r.embedding[i] as double))), 4)"
_BLENDED = f"select q.msg_id, q.slug, q.want, q.text, r.vec_id as r, c.text as qtext, {_DOT} as score from {_BLEND} q join {_EMB} r on q.slug = r.label join {_TEXTS} c on c.vec_id = r.vec_id"
_CUT = "trim(regexp_replace(regexp_replace(reply, '^Sure! ', ''), '(?i)^a:\\s*', ''))"
_REPLY = "(select faq_pos as msg_id, concat(case faq_pos % 4 when 0 then 'Sure! ' when 1 then 'A: ' else '' end, a, if(faq_pos % 3 = 0, ' [offer_code]', '')) as reply, faq_pos % 8 < 4 as had_facts, faq_pos % 7 <> 0 as ok, if(faq_pos % 2 = 0, 'X5', 'our special code') as code, if(faq_pos % 14 = 0, q, null) as answer from " + t.FAQS + ")"
SQL = {
    "jn_config": f"select msg_id, coalesce(shop_name, 'My shop') as shop_name, coalesce(city, '') as city from {t.MESSAGES} left join {t.SHOPS} using (slug)",
    "jn_profile": f"select slug, case shop_pos % 3 when 0 then 'cakes' when 1 then 'services' else 'items' end as label from {t.SHOPS}",
    "jn_faq_f1": f"select * from {_F1}",
    "jn_faq_vector": f"select * from {_best(_VEC, 1, 'score desc, r', 'q')}",
    "jn_faq_vector_index": f"select * from {_best(_VEC, 1, 'score desc, r', 'q')}",
    "jn_faq_vector_guarded": f"""with near as (select *, {_JACC.replace('m.text', 'text').replace('c.text', 'qtext')} as overlap, max(score) over (partition by msg_id) as best, row_number() over (partition by msg_id order by score desc, r) as r5 from {_best(f"{_BLENDED} where q.want = r.qlang or (q.slug, q.want) not in (select (label, qlang) from {_EMB})", 5, 'score desc, r')}),
        won as (select *, row_number() over (partition by msg_id order by overlap desc, r5) as r2 from near where round(best - score, 4) <= {NEAR_TIE}),
        vocab as (select distinct label as slug, unnest({_content('text')}) as term from {_TEXTS} join embeddings using (vec_id) where vec_id % 3 = 0), terms as (select slug, list(term) as ts from vocab where length(term) > 6 group by slug),
        w as (select msg_id, r as faq_pos, score, list_intersect(list_distinct({_content('text')}), coalesce(ts, [])) as a, list_intersect(list_distinct({_content('qtext')}), coalesce(ts, [])) as b from won left join terms using (slug) where r2 = 1 and score >= case want when 'ml' then 0.45 else 0.55 end and (r % 7 <> 0 or score >= 0.7))
        select msg_id, faq_pos, score from w where len(a) = 0 or len(b) = 0 or len(list_filter(a, lambda p: len(list_filter(b, lambda o: starts_with(p, o) or starts_with(o, p))) > 0)) > 0""",
    "jn_chunk_vector": f"select msg_id, r as chunk_pos, score from {_best(_BLENDED, 5, 'score desc, r')}",
    "jn_chunk": f"select * from {_best(_CHUNK, 5, 'score desc, chunk_pos')}",
    "flt_grounding": f"""select msg_id, 'faq' as kind, faq_pos, score, score >= case when session_id % 3 = 0 then {GATE_MANGLISH} else {GATE_ENGLISH} end and (score >= {SURE} or len({_content('message')}) = 0 or list_has_any({_content('message')}, {_WORDS.format("q || ' ' || a")})) as passes from {_F1} join {t.MESSAGES} using (msg_id) join {t.PHRASED} using (faq_pos)
        union all select msg_id, 'chunk', chunk_pos, score, score >= {CHUNK_LEAST} and list_has_any(a, b) from {_best(_CHUNK, 1, 'score desc, chunk_pos')} join {_ASKED} using (msg_id) join (select chunk_pos, b from {_CHUNKS}) using (chunk_pos)""",
    "win_near_tie": f"""select key, cand, score from (select *, row_number() over (partition by key order by overlap desc, r5) as r2 from (select *, max(score) over (partition by key) as best from (select q as key, r as cand, score, {_JACC} as overlap, row_number() over (partition by q order by score desc, r) as r5
        from {_best(_VEC, 5, 'score desc, r', 'q')} join {_TEXTS} m on m.vec_id = q join {_TEXTS} c on c.vec_id = r)) where round(best - score, 4) <= {NEAR_TIE}) where r2 = 1""",
    "gen_llm_requests": f"""with m as (select *, {_LANG} as lang, turn = 0 and session_id % 5 = 0 as social, case when session_id % 4 = 1 then substring(message, 3) end as answer, if(session_id % 2 = 0, 'manglish', 'english') as answer_lang from {t.MESSAGES}),
        c as (select msg_id, string_agg(text, chr(10) order by chunk_pos) as ctx from {_best(_CHUNK, 2, 'score desc, chunk_pos')} join (select chunk_pos, text from {_CHUNKS}) using (chunk_pos) where score >= {CHUNK_LEAST} group by msg_id),
        k as (select *, case when social then 'social' when answer is not null and answer_lang <> lang then 'rephrase_' || lang when ctx is not null then 'context' else 'free' end as kind from m left join c using (msg_id))
        select msg_id, kind, concat_ws(chr(10), case when kind like 'rephrase%' then 'Answer:' || chr(10) || answer when kind = 'context' then 'Facts:' || chr(10) || ctx when kind = 'free' then 'No facts.' end, 'Question: ' || message, 'Language: ' || lang) as prompt,
        cast(case kind when 'context' then 0.15 when 'social' then 0.6 else 0.3 end as double) as temperature, cast(200 as int) as max_tokens from k where answer is null or kind like 'rephrase%'""",
    "prj_llm_reply": f"select msg_id, case when not ok or {_CUT} = '' or (had_facts and regexp_matches(lower({_CUT}), 'thon')) then coalesce(answer, 'Please ask us.') else replace({_CUT}, '[offer_code]', code) end as reply from {_REPLY}",
    "prj_config_overlay": f"""select slug, case when shop_pos % 3 = 0 then 'My shop' else shop_name end as shop_name, case when shop_pos % 2 = 1 then city end as city, case when shop_pos % 5 <> 0 then '+91 ' || shop_pos end as phone, case when shop_pos % 4 = 0 then 'UPI, Cash' else 'UPI' end as payment,
        concat_ws(',', case when shop_pos % 3 = 0 then 'shop_name' end, case when shop_pos % 2 = 0 then 'city' end, case when shop_pos % 5 = 0 then 'phone' end, case when shop_pos % 4 = 0 then 'payment' end) as missing from {t.SHOPS}""",
}
