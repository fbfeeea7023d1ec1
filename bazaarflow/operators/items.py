"""Messages about items: phrases, token scores, whole categories, and answers made from the items found.

Equal texts of a shop are looked up once, and equal items are scored as one. Candidates come from equi-joins on a shop and
a token or a piece of a phrase; no message meets all items of its shop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..plans import scratch
from ..plans import tables as t

#: Points of a query token: a word of the name, the beginning of one, the same for words of many names, category, description.
EXACT, PREFIX, GENERIC_EXACT, GENERIC_PREFIX, CATEGORY, DESCRIPTION = 3.0, 1.0, 0.4, 0.2, 0.4, 0.3
#: Added when all tokens are words of the category.
WHOLE_CATEGORY = 1.0
#: Least score, least letters of a phrase, items in an answer, names that make a word generic.
LEAST, PHRASE, SHOWN, GENERIC = 0.9, 7, 20, 5

ASK_STOP = ["i", "a", "an", "the", "is", "it", "in", "of", "to", "do", "my", "me", "we", "you", "am", "are", "be", "for", "on", "with", "at", "by", "this", "that", "please", "want", "need", "have", "has", "what", "which", "show", "list", "types", "kinds", "home", "service", "undo", "und", "aano", "kittumo"]
BREADTH = ["all", "full", "list", "every", "complete", "details", "types", "kinds", "options", "everything", "okke", "ellam", "ethoke"]
AVAILABLE = ["undo", "und", "available", "aano", "kittumo", "do", "you", "have", "any", "is", "there", "the", "a", "an", "what", "about"]
LIST_STOP = ["i", "we", "you", "do", "have", "the", "a", "an", "of", "for", "me", "need", "want", "show", "give", "and", "or", "is", "are", "with", "about", "undo", "und", "kittumo", "please", "price", "items"]
NOT_A_LIST = r"\b(pain|hurt|safe|after|before|during|how long|how often|can i|should i|better|recommend|advice)\b"
INCLUSION = r"\b(?:is|are|does|do)\b.{0,40}\b(?:include|included|includes|comes? with|got)\b"
NOUN_SKIP = ["available", "price", "cost", "rate", "service", "item", "items", "option", "options", "type", "types", "kind", "kinds", "there"]

#: Answers by language: with a noun, without one, the end, and the frame of an inclusion answer.
ANSWERS = {
    "english": ("We have these for {noun}:", "We have these:", "Anything else?", "Yes: {body}."),
    "manglish": ("{noun} options ivide und:", "Ivide ullath:", "Vere enthenkilum veno?", "Athe: {body}."),
}


def query_tokens(c: Column, stop: list[str]) -> Column:
    """Distinct words that are no stop words, and their stems."""
    kept = F.array_except(x.words(c), x.lit_array(stop))
    return F.array_distinct(F.concat(kept, F.transform(kept, x.stem)))


def _with_stems(words: Column) -> Column:
    return F.array_distinct(F.concat(words, F.transform(words, x.stem)))


def texts(messages: DataFrame) -> DataFrame:
    """The distinct texts (slug, message) of ``messages``: each is looked up once."""
    return messages.where(F.col("message").isNotNull()).select("slug", "message").distinct()


def classes(items: DataFrame) -> DataFrame:
    """Names with a category of a shop, each known by its first item (``kind``)."""
    return items.groupBy("slug", "name", "category").agg(F.min("item_pos").alias("kind"))


def members(items: DataFrame, shown: int, keys: tuple = ("slug", "name", "category")) -> DataFrame:
    """The first items of each class, or of each of what ``keys`` tell apart: (slug, kind, item_pos)."""
    w = Window.partitionBy(*keys)
    return items.withColumn("kind", F.min("item_pos").over(w)).withColumn("_r", F.row_number().over(w.orderBy("item_pos"))).where(F.col("_r") <= shown).select("slug", "kind", "item_pos")


def phrase_kinds(asked: DataFrame, kinds_: DataFrame, least: int = PHRASE) -> DataFrame:
    """Kinds of which two successive name words, ``least`` letters or more with the space, occur in the text: (slug, message, kind).

    A phrase may begin inside a word of the text and end inside the next one. Both sides meet on the last three letters of
    the first word and the first three of the second (shorter words: on all), then the whole phrase is looked for.
    """
    n = F.split(F.trim(F.lower("name")), r"\s+")
    pairs = F.expr("transform(sequence(1, size(n) - 1), i -> struct(n[i - 1] as a, n[i] as b))")
    phrases = kinds_.withColumn("n", n).where("size(n) > 1").select("slug", "kind", F.explode(pairs).alias("p")).select("slug", "kind", "p.a", "p.b", F.concat_ws(" ", "p.a", "p.b").alias("phrase")).where(F.length("phrase") >= least)
    known = phrases.select("slug", "phrase", F.right("a", F.lit(3)).alias("end"), F.left("b", F.lit(3)).alias("start")).distinct()
    t = F.split(F.lower("message"), " ")
    around = F.expr("transform(sequence(1, size(t) - 1), i -> struct(t[i - 1] as a, t[i] as b))")
    three = F.array(*[F.lit(k) for k in (1, 2, 3)])
    pieces = asked.withColumn("t", t).where("size(t) > 1").select("slug", "message", F.explode(around).alias("p"))
    pieces = pieces.select("slug", "message", "p.*", F.explode(three).alias("i")).select("*", F.explode(three).alias("j"))
    pieces = pieces.where("length(a) >= i and length(b) >= j").select("slug", "message", F.expr("right(a, i)").alias("end"), F.expr("left(b, j)").alias("start")).distinct()
    found = pieces.join(known, ["slug", "end", "start"]).where(F.lower("message").contains(F.col("phrase"))).select("slug", "message", "phrase").distinct()
    return found.join(phrases.select("slug", "phrase", "kind").distinct(), ["slug", "phrase"]).select("slug", "message", "kind").distinct()


def _asked_tokens(asked: DataFrame, generic: DataFrame | None, stop: list[str]) -> DataFrame:
    """(slug, message, n, token, generic) of each text; a word of many names is generic beside other tokens."""
    q = asked.withColumn("tokens", query_tokens(F.col("message"), stop)).select("slug", "message", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    if generic is None:
        return q.withColumn("generic", F.lit(False))
    common = generic.select("slug", F.col("word").alias("token"), F.lit(True).alias("_g"))
    return q.join(common, ["slug", "token"], "left").withColumn("generic", F.coalesce("_g", F.lit(False)) & (F.col("n") > 1)).drop("_g")


def name_matches(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """How tokens (slug, token) meet classes: (slug, token, kind, exact, prefix, in_category).

    Prefixes are looked up among a shop's distinct name words, so a token of one letter meets each word once and not each
    item, and only words that were found lead on to classes.
    """
    words = known.select("slug", "kind", F.explode(F.array_distinct(x.split_words(F.lower("name")))).alias("word"))
    every = words.select("slug", "word").distinct()
    prefixes = every.select("slug", "word", F.explode(F.expr("transform(sequence(1, length(word)), i -> substring(word, 1, i))")).alias("token"), F.lit(False).alias("exact"))
    whole = every.select("slug", "word", F.explode(F.array_distinct(F.array("word", x.stem(F.col("word"))))).alias("token"), F.lit(True).alias("exact"))
    found = tokens.join(prefixes.unionByName(whole), ["slug", "token"]).groupBy("slug", "token", "word").agg(F.bool_or("exact").alias("exact"))
    named = found.join(words, ["slug", "word"]).select("slug", "token", "kind", "exact", F.lit(True).alias("prefix"), F.lit(False).alias("in_category"))
    sections = known.select("slug", "category").distinct()
    filed = sections.select("slug", "category", F.explode(_with_stems(x.split_words(F.coalesce(F.lower("category"), F.lit(""))))).alias("token")).where("token <> ''")
    filed = tokens.join(filed, ["slug", "token"]).join(known.select("slug", "category", "kind"), ["slug", "category"]).select("slug", "token", "kind", F.lit(False).alias("exact"), F.lit(False).alias("prefix"), F.lit(True).alias("in_category"))
    return named.unionByName(filed).groupBy("slug", "token", "kind").agg(*[F.bool_or(c).alias(c) for c in ("exact", "prefix", "in_category")])


def class_scores(q: DataFrame, known: DataFrame) -> DataFrame:
    """Points of name and category (slug, message, kind, s) of tokens (as ``_asked_tokens`` gives them)."""
    hit = q.join(name_matches(q.select("slug", "token").distinct(), known), ["slug", "token"])
    name = F.when(F.col("exact"), F.when(F.col("generic"), GENERIC_EXACT).otherwise(EXACT)).when(F.col("prefix"), F.when(F.col("generic"), GENERIC_PREFIX).otherwise(PREFIX)).otherwise(0.0)
    out = hit.groupBy("slug", "message", "kind").agg(F.sum(name + F.when(F.col("in_category"), CATEGORY).otherwise(0.0)).alias("s"), F.count_if("in_category").alias("c"), F.max("n").alias("n"))
    return out.select("slug", "message", "kind", (F.col("s") + F.when(F.col("c") == F.col("n"), WHOLE_CATEGORY).otherwise(0.0)).alias("s"))


def scored_items(asked: DataFrame, items: DataFrame, generic: DataFrame | None, stop: list[str] = ASK_STOP, least: float = LEAST, shown: int = SHOWN) -> DataFrame:
    """The best items of each text by token score, ``shown`` at most, the earlier on ties: (slug, message, item_pos, score).

    ``generic``: (slug, word) in many names, which count less beside other tokens. Name and category are scored once for the
    items that share them. A description adds points only to items that hold a token in it, which are found by that token. Of
    the others the best come from the first ``shown`` classes by score, then first item, each with its first items: any
    other item has ``shown`` before it.
    """
    q = scratch.table(_asked_tokens(asked, generic, stop), "item-tokens")
    scores = scratch.table(class_scores(q, scratch.table(classes(items), "item-classes")), "item-scores")
    w = Window.partitionBy("slug", "message")
    best = scores.withColumn("score", F.round("s", 4)).where(F.col("score") >= least).withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), "kind"))).where(F.col("_k") <= shown)
    plain = best.join(members(items, shown), ["slug", "kind"]).select("slug", "message", "item_pos", "score")
    alike = ("slug", "name", "category", "description")
    told = items.groupBy(*alike).agg(F.min("item_pos").alias("like")).withColumn("kind", F.min("like").over(Window.partitionBy("slug", "name", "category")))
    held = told.select("slug", "kind", "like", F.explode(F.array_distinct(F.transform(x.words(F.coalesce("description", F.lit(""))), x.stem))).alias("token"))
    added = q.select("slug", "message", "token").join(held, ["slug", "token"]).groupBy("slug", "message", "kind", "like").agg((F.count(F.lit(1)) * DESCRIPTION).alias("d"))
    more = added.join(scores, ["slug", "message", "kind"], "left").withColumn("score", F.round(F.coalesce("s", F.lit(0.0)) + F.col("d"), 4)).where(F.col("score") >= least)
    more = more.withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), "like"))).where(F.col("_k") <= shown)
    more = more.select("slug", "message", "like", "score").join(members(items, shown, alike).withColumnRenamed("kind", "like"), ["slug", "like"]).select("slug", "message", "item_pos", "score")
    both = plain.unionByName(more).groupBy("slug", "message", "item_pos").agg(F.max("score").alias("score"))
    return both.withColumn("_r", F.row_number().over(w.orderBy(F.desc("score"), "item_pos"))).where(F.col("_r") <= shown).drop("_r")


def phrased_items(asked: DataFrame, items: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The first items, ``shown`` at most, of which a phrase occurs in the text: (slug, message, item_pos)."""
    w = Window.partitionBy("slug", "message")
    found = phrase_kinds(asked, classes(items)).withColumn("_k", F.row_number().over(w.orderBy("kind"))).where(F.col("_k") <= shown)
    rows = found.join(members(items, shown), ["slug", "kind"]).select("slug", "message", "item_pos")
    return rows.withColumn("_r", F.row_number().over(w.orderBy("item_pos"))).where(F.col("_r") <= shown).drop("_r")


def matching_items(messages: DataFrame, items: DataFrame, generic: DataFrame | None, stop: list[str] = ASK_STOP, least: float = LEAST, shown: int = SHOWN, broad: Column | None = None) -> DataFrame:
    """The best items of each message: (msg_id, item_pos, score, rank from 1), at most ``shown``.

    Items found by a phrase replace those of the token score and come in item order with the score null; else the higher
    score comes first, and the earlier item on ties. Messages for which ``broad`` holds match nothing.
    """
    best = _best_items(messages, items, generic, stop, least, shown, broad)
    return messages.select("msg_id", "slug", "message").join(best, ["slug", "message"]).select("msg_id", "item_pos", "score", "rank")


def _best_items(messages: DataFrame, items: DataFrame, generic: DataFrame | None, stop: list[str] = ASK_STOP, least: float = LEAST, shown: int = SHOWN, broad: Column | None = None) -> DataFrame:
    """``matching_items`` of each text: (slug, message, item_pos, score, rank)."""
    asked = texts(messages if broad is None else messages.where(~F.coalesce(broad, F.lit(False))))
    asked = scratch.table(asked, "item-texts")
    phrased = scratch.table(phrased_items(asked, items, shown).withColumn("score", F.lit(None).cast("double")), "item-phrases")
    rest = asked.join(phrased.select("slug", "message").distinct(), ["slug", "message"], "left_anti")
    w = Window.partitionBy("slug", "message").orderBy(F.desc_nulls_first("score"), "item_pos")
    return phrased.unionByName(scored_items(rest, items, generic, stop, least, shown)).withColumn("rank", F.row_number().over(w))


def list_keyword(messages: DataFrame, items: DataFrame) -> DataFrame:
    """Messages that ask for a whole category: (msg_id, slug, keyword).

    A question about one (``NOT_A_LIST``) is none. With a word of breadth the first word that the shop's names know, in
    the text's order and also without its closing s, is the keyword; else the only content word is.
    """
    clean = x.split_words(F.regexp_replace(F.lower("message"), r"[^\p{L}\p{N}_\s]", " "))
    rows = messages.where(~F.lower("message").rlike(NOT_A_LIST)).select("msg_id", "slug", clean.alias("w"))
    singular = F.transform("w", lambda v: F.when(v.endswith("s") & (F.length(v) > 3), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v))
    rows = rows.withColumn("breadth", F.arrays_overlap(F.concat("w", singular), x.lit_array(BREADTH)))
    alone = F.filter("w", lambda v: (F.length(v) >= 3) & ~F.array_contains(x.lit_array(AVAILABLE), v))
    bare = rows.where("not breadth").withColumn("c", alone).where("size(c) = 1").select("msg_id", "slug", F.element_at("c", 1).alias("keyword"))
    asked = F.filter("w", lambda v: (F.length(v) > 2) & ~F.array_contains(x.lit_array(LIST_STOP + BREADTH), v))
    forms = F.flatten(F.transform(asked, lambda v: F.when(v.endswith("s"), F.array(v, F.substring(v, F.lit(1), F.length(v) - 1))).otherwise(F.array(v))))
    wide = rows.where("breadth").select("msg_id", "slug", F.posexplode(forms).alias("at", "keyword"))
    names = items.select("slug", F.explode(F.filter(x.words(F.col("name")), lambda v: F.length(v) > 2)).alias("keyword")).distinct()
    first = wide.join(names, ["slug", "keyword"]).groupBy("msg_id", "slug").agg(F.min_by("keyword", "at").alias("keyword"))
    return bare.unionByName(first)


def category_items(keywords: DataFrame, items: DataFrame) -> DataFrame:
    """Items with a name word that begins with the keyword, but not right after ``non-`` or ``non ``: (slug, keyword, item_pos, name, price, description)."""
    heads = F.filter(x.words(F.col("name")), lambda v: F.length(v) > 2)
    prefix = F.flatten(F.transform(heads, lambda v: F.transform(F.sequence(F.lit(3), F.length(v)), lambda i: F.substring(v, F.lit(1), i))))
    index = items.select("slug", "item_pos", "name", "price", "description", F.explode(F.array_distinct(prefix)).alias("keyword"))
    found = keywords.select("slug", "keyword").distinct().join(index, ["slug", "keyword"])
    return found.where(F.expr(r"lower(name) rlike concat('(?<!non[- ])(?<![\\p{L}\\p{N}_])', keyword)"))


def keyword_lists(messages: DataFrame, items: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Messages that a whole category answers (msg_id, slug, keyword, n items, first item), and the list of each keyword (slug, keyword, reply).

    A keyword's items are listed once for a shop, in item order, however many messages ask; fewer than ``least`` items are no
    list. A list grows with its shop's items, so it stays apart from its messages, to be joined last.
    """
    asked = scratch.table(list_keyword(messages, items), "list-keywords")
    found = category_items(asked, items).withColumn("line", item_line())
    reply = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_pos", "line"))), lambda v: v["line"]), "\n")
    lists = found.groupBy("slug", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("item_pos").alias("first"), reply.alias("reply")).where(F.col("n") >= least)
    lists = scratch.table(lists, "lists")
    return asked.join(lists.select("slug", "keyword", "n", "first"), ["slug", "keyword"]), lists.select("slug", "keyword", "reply")


def with_lists(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows (slug, keyword) with the list of their keyword; rows of one list lie together, so files of them hold it once."""
    return asked.join(lists.hint("merge"), ["slug", "keyword"])


def category_lists(messages: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """Messages that a whole category answers: (msg_id, slug, keyword, n items, first item, reply); fewer than ``least`` items are no list."""
    return with_lists(*keyword_lists(messages, items, least)).select("msg_id", "slug", "keyword", "n", "first", "reply")


def item_line(short: int = 60) -> Column:
    """A bullet with the price, if there is one, and a description of fewer than ``short`` characters."""
    label = x.price_label(F.col("price"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), "")
    described = F.when((F.coalesce("description", F.lit("")) != "") & (F.length("description") < short), F.concat(F.lit(" ("), "description", F.lit(")"))).otherwise("")
    return F.concat(F.lit("• "), "name", F.when(label != "", F.concat(F.lit(" — "), label)).otherwise(""), described)


def subject_noun(message: Column, names: Column, stop: list[str] = ASK_STOP, skip: list[str] = NOUN_SKIP) -> Column:
    """What a message is about: its first two successive words, none a stop word, that a found name holds; else its longest word that one does; else its longest."""
    raw = x.split_words(F.lower(message))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(raw) - 1, F.lit(1))), lambda i: F.when(~F.array_contains(x.lit_array(stop), F.get(raw, i - 1)) & ~F.array_contains(x.lit_array(stop), F.get(raw, i)), F.concat_ws(" ", F.get(raw, i - 1), F.get(raw, i))))
    held = lambda v: F.exists(names, lambda n: F.contains(n, v))
    both = F.try_element_at(F.filter(pairs, lambda p: p.isNotNull() & held(p)), F.lit(1))
    words = F.filter(F.array_except(x.words(message), x.lit_array(stop)), lambda v: (F.length(v) > 3) & ~F.array_contains(x.lit_array(skip), v))
    longest = lambda a: F.try_element_at(F.array_sort(F.transform(a, lambda v: F.struct((-F.length(v)).alias("l"), v.alias("v")))), F.lit(1))["v"]
    return F.coalesce(both, longest(F.filter(words, lambda v: held(v) | held(x.stem(v)))), longest(words), F.lit(""))


def framed(lang: Column, templates: dict = ANSWERS) -> Callable:
    """The k-th part of an answer in the message's language."""
    return lambda k: F.when(lang == "manglish", templates["manglish"][k]).otherwise(templates["english"][k])


def list_answer(lang: Column, templates: dict = ANSWERS) -> Column:
    """The answer by the list (``reply``) of a ``keyword``."""
    pick = framed(lang, templates)
    return F.concat_ws("\n", F.replace(pick(0), F.lit("{noun}"), F.col("keyword")), "reply", pick(2))


def item_answers(messages: DataFrame, items: DataFrame, generic: DataFrame | None, broad: Column | None = None, templates: dict = ANSWERS, lists: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Answers from the items found (messages with ``lang``): (msg_id, n, reply). ``lists``: ``keyword_lists`` of the messages, if they are at hand.

    A whole category is listed first. A question whether something is included answers with the descriptions of the first
    five items, if any has one. Else the items are listed under the noun that the message is about. Items are put together once
    for a text, and lists join their messages last.
    """
    lists = keyword_lists(messages, items) if lists is None else lists
    single, whole = item_replies(messages, items, generic, lists[0], broad, templates)
    return single.unionByName(with_lists(whole, lists[1]).select("msg_id", "n", list_answer(F.col("lang"), templates).alias("reply")))


def item_replies(messages: DataFrame, items: DataFrame, generic: DataFrame | None, held: DataFrame, broad: Column | None = None, templates: dict = ANSWERS) -> tuple[DataFrame, DataFrame]:
    """``item_answers`` from single items (msg_id, n, reply), and the messages that a list answers (msg_id, slug, keyword, n, lang), of ``held`` as in ``keyword_lists``."""
    included = F.lower("message").rlike(INCLUSION)
    rest = messages.where(included).unionByName(messages.where(~included).join(held.select("msg_id"), "msg_id", "left_anti"))
    found = _best_items(rest, items, generic, broad=broad).join(items.select("item_pos", "name", "category", "price", "description"), "item_pos")
    body = F.when((F.col("rank") <= 5) & (F.coalesce("description", F.lit("")) != ""), F.concat_ws(": ", "name", "description"))
    per = found.groupBy("slug", "message").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("rank", item_line().alias("line"), F.lower("name").alias("name"), body.alias("body")))).alias("r"))
    rows = scratch.table(per, "item-found")
    names, bodies = F.transform("r", lambda v: v["name"]), F.filter(F.transform("r", lambda v: v["body"]), lambda v: v.isNotNull())
    out = rows.withColumn("noun", subject_noun(F.col("message"), names)).withColumn("bodies", F.array_join(bodies, " | ")).withColumn("lines", F.array_join(F.transform("r", lambda v: v["line"]), "\n"))
    out = scratch.table(out.select("slug", "message", "n", "noun", "lines", F.when(included & (F.col("bodies") != ""), F.col("bodies")).alias("bodies")), "item-answers")
    pick = framed(F.col("lang"), templates)
    head = F.when(F.col("noun") != "", F.replace(pick(0), F.lit("{noun}"), F.col("noun"))).otherwise(pick(1))
    reply = F.when(F.col("bodies").isNotNull(), F.replace(pick(3), F.lit("{body}"), F.col("bodies"))).otherwise(F.concat_ws("\n", head, "lines", pick(2)))
    # a list takes the place of a text's answer, unless that says what is included
    single = rest.select("msg_id", "slug", "message", "lang").join(out, ["slug", "message"])
    whole = held.select("msg_id", "slug", "keyword", "n").join(messages.select("msg_id", "lang"), "msg_id").join(single.where("bodies is not null").select("msg_id"), "msg_id", "left_anti")
    single = single.join(whole.select("msg_id"), "msg_id", "left_anti").select("msg_id", "n", reply.alias("reply"))
    return single, whole


def _generic(items: DataFrame) -> DataFrame:
    from .analytics import generic_tokens

    return generic_tokens(items, GENERIC)


def _scores(s, d):
    i, m = t.described(s, d), t.asks(s, d)
    return m.join(scored_items(texts(m), i, _generic(i)), ["slug", "message"]).select("msg_id", "item_pos", "score")


def _phrases(s, d):
    i, m = t.described(s, d), t.asks(s, d)
    return m.join(phrased_items(texts(m), i), ["slug", "message"]).select("msg_id", "item_pos")


def _top(s, d):
    i = t.described(s, d)
    return matching_items(t.asks(s, d), i, _generic(i)).select("msg_id", "item_pos", "score", F.col("rank").cast("int").alias("rank"))


def _answers(s, d):
    i = t.described(s, d)
    return item_answers(t.asks(s, d), i, _generic(i))


QUERIES = {
    "jn_item_score": _scores,
    "jn_phrase_theta": _phrases,
    "win_topk_items": _top,
    "gen_item_reply": _answers,
    "gen_category_list": lambda s, d: category_lists(t.asks(s, d), t.described(s, d)),
}

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
_SPLIT = "list_filter(regexp_split_to_array(trim(lower({0})), '\\s+'), lambda v: v <> '')"


def _lit(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _stems(a: str) -> str:
    cut = "case " + " ".join(f"when ends_with(w, '{s}') and length(w) - {len(s)} >= 3 then left(w, length(w) - {len(s)})" for s in x.SUFFIXES) + " else w end"
    return f"list_transform({a}, lambda w: {cut})"


_KEPT = f"list_filter({_WORDS.format('message')}, lambda v: not list_contains({_lit(ASK_STOP)}, v))"
_TEXT = f"(select slug, message, list_distinct(list_concat({_KEPT}, {_stems(_KEPT)})) as q from (select distinct slug, message from {t.ASKS}))"
_ITEM = f"""(select slug, item_pos, {_SPLIT.format('name')} as nw, list_concat({_SPLIT.format('name')}, {_stems(_SPLIT.format('name'))}) as nt, list_concat({_SPLIT.format('category')}, {_stems(_SPLIT.format('category'))}) as ct, {_stems(_WORDS.format('description'))} as dt from {t.DESCRIBED})"""
_GENERIC = f"(select slug, list(word) as g from (select slug, word from (select slug, unnest(list_distinct({_WORDS.format('name')})) as word from {t.DESCRIBED}) group by slug, word having count(*) >= {GENERIC}) group by slug)"
_POINTS = f"""list_sum(list_transform(q, lambda k: (case when list_contains(nt, k) then case when len(q) > 1 and list_contains(coalesce(g, []), k) then {GENERIC_EXACT} else {EXACT} end
  when len(list_filter(nw, lambda v: starts_with(v, k))) > 0 then case when len(q) > 1 and list_contains(coalesce(g, []), k) then {GENERIC_PREFIX} else {PREFIX} end else 0.0 end)::double
  + (case when list_contains(ct, k) then {CATEGORY} else 0.0 end)::double + (case when list_contains(dt, k) then {DESCRIPTION} else 0.0 end)::double))
  + case when len(list_filter(q, lambda k: not list_contains(ct, k))) = 0 then {WHOLE_CATEGORY} else 0.0 end"""
_SCORED = f"(select slug, message, item_pos, round(cast({_POINTS} as double), 4) as score from {_TEXT} join {_ITEM} using (slug) left join {_GENERIC} using (slug) where len(q) > 0)"
_PAIRS = f"(select slug, item_pos, unnest(list_transform(range(1, len(nw)), lambda i: nw[i] || ' ' || nw[i + 1])) as p from {_ITEM})"
_PHRASE = f"(select distinct slug, message, item_pos, cast(null as double) as score from {_TEXT} join {_PAIRS} using (slug) where length(p) >= {PHRASE} and contains(lower(message), p))"


def _ranked(inner: str, order: str) -> str:
    return f"(select * from (select *, row_number() over (partition by slug, message order by {order}) as rank from {inner}) where rank <= {SHOWN})"


_FOUND = _ranked(f"(select * from {_PHRASE} union all select * from {_SCORED} where score >= {LEAST} and (slug, message) not in (select (slug, message) from {_PHRASE}))", "score desc nulls first, item_pos")
_SINGULAR = "list_transform(w, lambda v: case when ends_with(v, 's') and length(v) > 3 then left(v, length(v) - 1) else v end)"
_ASKED = f"list_filter(w, lambda v: length(v) > 2 and not list_contains({_lit(LIST_STOP + BREADTH)}, v))"
_KEYWORD = f"""(with r as (select msg_id, slug, lang, message, w, list_has_any(list_concat(w, {_SINGULAR}), {_lit(BREADTH)}) as breadth from (select *, {_SPLIT.format("regexp_replace(message, '[^\\p{L}\\p{N}_\\s]', ' ', 'g')")} as w from {t.ASKS}) where not regexp_matches(lower(message), '{NOT_A_LIST}')),
  names as (select distinct slug, unnest({_WORDS.format('name')}) as v from {t.DESCRIBED}),
  wide as (select msg_id, slug, unnest(f) as v, generate_subscripts(f, 1) as i from (select msg_id, slug, flatten(list_transform({_ASKED}, lambda v: case when ends_with(v, 's') then [v, left(v, length(v) - 1)] else [v] end)) as f from r where breadth))
  select msg_id, slug, c[1] as keyword from (select *, list_filter(w, lambda v: length(v) >= 3 and not list_contains({_lit(AVAILABLE)}, v)) as c from r where not breadth) where len(c) = 1
  union all select msg_id, slug, arg_min(v, i) from wide join names using (slug, v) where length(v) > 2 group by msg_id, slug)"""
_LINE = "'• ' || name || case when price <> 0 then ' — ₹' || format('{:,}', price) else '' end || case when description <> '' and length(description) < 60 then ' (' || description || ')' else '' end"
_LISTS = f"""(select msg_id, slug, keyword, n, first, reply from {_KEYWORD} k join (select slug, keyword, count(*) as n, min(item_pos) as first, string_agg({_LINE}, chr(10) order by item_pos) as reply
  from (select distinct slug, keyword from {_KEYWORD}) join {t.DESCRIBED} i using (slug) where contains(lower(name), keyword) and regexp_matches(regexp_replace(lower(name), 'non[- ]' || keyword, '', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])' || keyword) group by slug, keyword having count(*) >= 2) using (slug, keyword))"""
_RAW = "regexp_split_to_array(trim(lower(message)), '\\s+')"
_HELD = "len(list_filter(names, lambda n: contains(n, {0}))) > 0"
_LONG = "list_sort(list_transform({0}, lambda v: {{'l': -length(v), 'v': v}}))[1].v"
_NOUN_WORDS = f"list_filter(list_distinct({_KEPT}), lambda v: length(v) > 3 and not list_contains({_lit(NOUN_SKIP)}, v))"
_NOUN = f"""coalesce(list_filter(list_transform(range(1, len({_RAW})), lambda i: case when not list_contains({_lit(ASK_STOP)}, {_RAW}[i]) and not list_contains({_lit(ASK_STOP)}, {_RAW}[i + 1]) then {_RAW}[i] || ' ' || {_RAW}[i + 1] end), lambda p: p is not null and {_HELD.format('p')})[1],
  {_LONG.format(f"list_filter({_NOUN_WORDS}, lambda v: {_HELD.format('v')} or {_HELD.format(_stems('[v]') + '[1]')})")}, {_LONG.format(_NOUN_WORDS)}, '')"""
_INC = f"regexp_matches(lower(message), '{INCLUSION}')"


def _frame(k: int) -> str:
    return f"case when lang = 'manglish' then '{ANSWERS['manglish'][k]}' else '{ANSWERS['english'][k]}' end"


SQL = {
    "jn_item_score": f"select msg_id, item_pos, score from {t.ASKS} join {_ranked(f'(select * from {_SCORED} where score >= {LEAST})', 'score desc, item_pos')} using (slug, message)",
    "jn_phrase_theta": f"select msg_id, item_pos from {t.ASKS} join {_ranked(_PHRASE, 'item_pos')} using (slug, message)",
    "win_topk_items": f"select msg_id, item_pos, score, cast(rank as int) as rank from {t.ASKS} join {_FOUND} using (slug, message)",
    "gen_category_list": f"select * from {_LISTS}",
    "gen_item_reply": f"""with lists as (select * from {_LISTS}), per as (select msg_id, message, lang, count(*) as n, list(lower(name) order by rank) as names, string_agg({_LINE}, chr(10) order by rank) as lines,
        string_agg(name || ': ' || description, ' | ' order by rank) filter (rank <= 5 and description <> '') as bodies from {t.ASKS} join {_FOUND} using (slug, message) join (select item_pos, name, price, description from {t.DESCRIBED}) using (item_pos) group by msg_id, message, lang),
        named as (select *, {_NOUN} as noun, {_INC} and bodies is not null as inc from per)
        select msg_id, n, case when inc then replace({_frame(3)}, '{{body}}', bodies) else case when noun <> '' then replace({_frame(0)}, '{{noun}}', noun) else {_frame(1)} end || chr(10) || lines || chr(10) || {_frame(2)} end as reply from named where inc or msg_id not in (select msg_id from lists)
        union all select msg_id, n, replace({_frame(0)}, '{{noun}}', keyword) || chr(10) || reply || chr(10) || {_frame(2)} from lists join {t.ASKS} using (msg_id) where msg_id not in (select msg_id from named where inc)""",
}
