"""Chat-log statistics, shop aggregates, windows and queues."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..plans import scratch
from ..plans import tables as t
from ..plans.sizing import sized


#: What a log row's source means for the totals.
KINDS = {"greeting": "greeting", "faq": "faq", "ollama": "ollama"}


def log_stats(log: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """Counts by sentiment, language, bypass, FAQ source and source, model calls by language, and the totals, in one pass with grouping sets; blanks are skipped.

    The row of all has the number of FAQ answers, greetings and model calls, and the rate of FAQ answers in percent.
    """
    keys = ["sentiment", "lang", "bypass", "faq_source", "source", "called"]
    called = F.when(F.col("source") == kinds["ollama"], F.col("lang"))
    clean = log.withColumn("called", called).select(*[x.blank_to_null(F.col(k)).alias(k) for k in keys])
    sets = clean.groupingSets([[F.col(k)] for k in keys] + [[]], *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"), *[F.count_if(F.col("source") == v).alias(k) for k, v in kinds.items()])
    every = 2 ** len(keys) - 1
    kind = F.when(F.col("g") == every, "all")
    for i, k in enumerate(keys):
        kind = kind.when(F.col("g") == every - 2 ** (len(keys) - 1 - i), "model_lang" if k == "called" else k)
    whole = lambda c: F.when(F.col("g") == every, c)
    out = sets.select(kind.alias("kind"), F.coalesce(*keys).alias("value"), "n", whole(F.col("faq")).alias("faq_hits"), whole(F.col("greeting")).alias("greetings"), whole(F.col("ollama")).alias("model_calls"), whole(F.format_string("%.1f", 100.0 * F.col("faq") / F.col("n"))).alias("hit_rate"))
    return out.where("kind = 'all' or value is not null")


def daily_counts(log: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """Partial counts of each day (``ts``), which add up: (log_date, kind, value, n, faq, greeting, ollama); one pass with grouping sets.

    Kinds are those of ``log_stats`` and ``faq_id``, whose counts are all kept, so the most used FAQs of any days are exact.
    """
    keys = ["sentiment", "lang", "bypass", "faq_source", "source", "called", "faq_id"]
    called = F.when(F.col("source") == kinds["ollama"], F.col("lang"))
    clean = log.withColumn("called", called).select(F.to_date("ts").alias("log_date"), *[(F.col(k) if k == "faq_id" else x.blank_to_null(F.col(k))).alias(k) for k in keys], *[(F.col("source") == v).alias(f"_{k}") for k, v in kinds.items()])
    sets = clean.groupingSets([[F.col("log_date"), F.col(k)] for k in keys] + [[F.col("log_date")]], "log_date", *keys)
    sets = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"), *[F.count_if(f"_{k}").alias(k) for k in kinds])
    every = 2 ** len(keys) - 1
    kind = F.when(F.col("g") == every, "all")
    for i, k in enumerate(keys):
        kind = kind.when(F.col("g") == every - 2 ** (len(keys) - 1 - i), "model_lang" if k == "called" else k)
    return sets.select("log_date", kind.alias("kind"), F.coalesce(*keys).alias("value"), "n", *kinds).where("kind = 'all' or value is not null")


def write_days(counts: DataFrame, path: str) -> None:
    """Write daily counts; the days in ``counts`` replace those that are there, other days stay. A row without a time has no day of its own (null)."""
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date").parquet(path)


def stats_of_days(counts: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """``log_stats`` of any days from their counts."""
    sums = counts.where("kind <> 'faq_id'").groupBy("kind", "value").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in kinds])
    whole = lambda c: F.when(F.col("kind") == "all", c)
    return sums.select("kind", "value", "n", whole(F.col("faq")).alias("faq_hits"), whole(F.col("greeting")).alias("greetings"), whole(F.col("ollama")).alias("model_calls"), whole(F.format_string("%.1f", 100.0 * F.col("faq") / F.col("n"))).alias("hit_rate"))


def top_faqs_of_days(counts: DataFrame, n: int = 20) -> DataFrame:
    """``top_faqs`` of any days from their counts."""
    return counts.where("kind = 'faq_id'").groupBy(F.col("value").alias("faq_id")).agg(F.sum("n").alias("hits")).orderBy(F.desc("hits"), "faq_id").limit(n)


def bypasses(log: DataFrame, n: int = 50) -> DataFrame:
    """Each bypass with its count and its ``n`` newest messages, newest first."""
    rows = log.where("bypass <> ''")
    newest = rows.withColumn("_r", F.row_number().over(Window.partitionBy("bypass").orderBy(F.desc("ts"), F.desc("msg_id")))).where(F.col("_r") <= n)
    ids = newest.groupBy("bypass").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "msg_id"))), lambda v: v["msg_id"].cast("string")), ",").alias("newest"))
    return rows.groupBy("bypass").agg(F.count(F.lit(1)).alias("n")).join(ids, "bypass")


def top_faqs(log: DataFrame, n: int = 20) -> DataFrame:
    return log.where("faq_id is not null").groupBy("faq_id").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "faq_id").limit(n)


def generic_tokens(items: DataFrame, least: int = 5) -> DataFrame:
    """Words in at least so many item names of a shop."""
    words = items.select("slug", F.explode(F.array_distinct(x.words(F.col("name")))).alias("word"))
    return words.groupBy("slug", "word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)


def vocabulary(items: DataFrame, stop: list[str]) -> DataFrame:
    return items.select("slug", F.explode(x.content_words(F.col("name"), stop)).alias("term")).distinct()


def shop_type(texts: DataFrame, keywords: dict[str, list[str]], least: int = 1) -> DataFrame:
    """Type whose keywords occur most in a shop's texts; ties by the table's order; ``general`` below ``least``."""
    hits = [F.aggregate(F.array(*[F.max(F.lower("text").contains(w)).cast("int") for w in ws]), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))).alias(f"_{k}") for k, ws in keywords.items()]
    rows = texts.groupBy("slug").agg(*hits)
    best = F.greatest(*[F.col(f"_{k}") for k in keywords]) if len(keywords) > 1 else F.col(f"_{next(iter(keywords))}")
    c = F.when(best < least, F.lit("general"))
    for k in keywords:
        c = c.when(F.col(f"_{k}") == best, k)
    return rows.select("slug", c.alias("shop_type"), best.alias("hits"))


def first_items(items: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` items of each shop, as texts that tell its type."""
    return items.withColumn("_r", F.row_number().over(Window.partitionBy("slug").orderBy("item_pos"))).where(F.col("_r") <= n).select("slug", F.col("name").alias("text"))


def shop_traits(items: DataFrame, shops: DataFrame, veg: list[str], meat: list[str], genders: dict[str, str], share: float = 0.9, food: tuple = ("restaurant", "bakery")) -> DataFrame:
    """Whether a shop (slug, shop_name, shop_type) is vegetarian, and the gender that it serves.

    Only food shops can be vegetarian: by a word in the name, or else if they have items and none has a meat word. Food shops
    serve all; others the gender whose pattern the name holds, else the one that ``share`` of the items with a gender have, else all.
    """
    flagged = items.select("slug", x.blank_to_null(F.col("gender")).alias("gender"), x.any_of(F.col("name"), meat).alias("meat"))
    per = flagged.groupBy("slug", "gender").agg(F.count(F.lit(1)).alias("n"), F.bool_or("meat").alias("meat"))
    given = F.when(F.coalesce("gender", F.lit("all")) != "all", F.col("n"))
    out = per.groupBy("slug").agg(F.bool_or("meat").alias("meat"), F.max_by("gender", F.struct(given.alias("n"), "gender")).alias("top"), F.max(given).alias("most"), F.sum(given).alias("all"))
    rows = shops.join(out, "slug", "left")
    named = F.when(F.lit(False), "")
    for g, p in genders.items():
        named = named.when(F.lower("shop_name").rlike(p), g)
    eats = F.col("shop_type").isin(*food)
    gender = F.when(eats, "all").otherwise(F.coalesce(named.otherwise(None), F.when(F.col("most") >= share * F.col("all"), F.col("top")), F.lit("all")))
    return rows.select("slug", (eats & (x.any_of(F.col("shop_name"), veg) | F.coalesce(~F.col("meat"), F.lit(False)))).alias("vegetarian"), gender.alias("gender"))


def specialisation(items: DataFrame, shops: DataFrame, signals: dict[str, tuple[str, list[str]]], share: float = 0.8, most: int = 2) -> DataFrame:
    """What a shop (slug, shop_name, shop_type) specialises in: (slug, specialisation, categories); null if in nothing.

    First a signal word in its name, for the signal's type. Else the smallest set of its largest categories, the earlier one
    first on ties, that reaches ``share`` of its items, if it has at most ``most`` members.
    """
    counts = items.where("category <> ''").groupBy("slug", "category").agg(F.count(F.lit(1)).alias("n"), F.min("item_pos").alias("pos"))
    w = Window.partitionBy("slug")
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy(F.desc("n"), "pos"))).withColumn("all", F.sum("n").over(w)).where((F.col("upto") - F.col("n")) < share * F.col("all"))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "pos", "category"))), lambda v: v["category"]), "|")
    top = ranked.groupBy("slug").agg(F.count(F.lit(1)).alias("members"), names.alias("names")).where(F.col("members") <= most)
    name = F.when(F.lit(False), F.struct(F.lit("").alias("signal"), F.lit("").alias("names")))
    for signal, (kind, categories) in signals.items():
        name = name.when((F.col("shop_type") == kind) & F.lower("shop_name").rlike(rf"\b{signal}\b"), F.struct(F.lit(signal).alias("signal"), F.lit("|".join(categories)).alias("names")))
    rows = shops.withColumn("s", name).join(top, "slug", "left")
    return rows.select("slug", F.coalesce("s.signal", F.replace(F.lower("names"), F.lit("|"), F.lit("+"))).alias("specialisation"), F.coalesce("s.names", "names").alias("categories"))


CATALOG_QUESTIONS = ["What {} do you have?", "{} undo?", "Show me all {}"]


def catalog_faqs(items: DataFrame, shops: DataFrame, questions: list[str] = CATALOG_QUESTIONS, shown: int = 10) -> DataFrame:
    """Per category and gender of a shop (slug, gender, vegetarian): id, answer and question variants.

    The answer lists the first items by position with their prices, and how many more there are. A shop for one gender leaves
    out other genders' items and does not name its own.
    """
    keys = ["slug", "category", "gender"]
    every = items.withColumn("category", F.coalesce(x.blank_to_null(F.col("category")), F.lit("General"))).withColumn("gender", F.coalesce(x.blank_to_null(F.col("gender")), F.lit("all")))
    rows = every.join(sized(shops.select("slug", F.col("gender").alias("shop"), "vegetarian")), "slug", "left").withColumn("shop", F.coalesce("shop", F.lit("all"))).where("shop = 'all' or gender in (shop, 'all')")
    line = F.concat(F.lit("• "), "name", F.lit(" — "), x.price_label(F.col("price"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("item_pos"))).where(F.col("r") <= shown)  # a limit per group, kept before the shuffle
    lines = first.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("l")))), lambda v: v["l"]), "\n").alias("lines"))
    out = lines.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.any_value("shop").alias("shop"), F.bool_or("vegetarian").alias("veg")), keys)
    foreign = (F.col("gender") != "all") & (F.col("shop") == "all")
    head = F.concat_ws(" ", F.when(foreign, F.initcap("gender")), "category")
    words = F.concat_ws(" ", F.when(F.col("veg"), "veg"), F.when(foreign, F.col("gender")), F.lower("category"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n...and "), (F.col("n") - shown).cast("string"), F.lit(" more."))).otherwise("")
    asked = F.array_join(F.transform(x.lit_array(questions), lambda q: F.replace(q, F.lit("{}"), words)), "|")
    name = F.concat(F.lit("cat_"), F.left(F.regexp_replace(F.lower(F.concat_ws("_", "gender", "category")), "[^a-z0-9_]", "_"), F.lit(40)))
    return out.select("slug", name.alias("id"), "category", "gender", F.concat(head, F.lit(":\n"), "lines", more).alias("answer"), asked.alias("variants"))


def signature(items: DataFrame, n: int = 3, least: int = 2) -> DataFrame:
    """The ``n`` dearest items of each shop by price, the earlier first on ties; with fewer than ``least`` priced ones, its first items."""
    w = Window.partitionBy("slug")
    rows = items.withColumn("p", F.when(F.col("price") != 0, F.col("price"))).withColumn("priced", F.count("p").over(w))
    order = F.when(F.col("priced") >= least, F.col("p"))
    top = rows.withColumn("r", F.row_number().over(w.orderBy(F.desc_nulls_last(order), "item_pos"))).where(F.col("r") <= n).where((F.col("priced") < least) | F.col("p").isNotNull())
    return top.groupBy("slug").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda v: v["name"]), ", ").alias("signature"))


def shop_summary(shops: DataFrame, faqs: DataFrame, items: DataFrame, embedded: DataFrame) -> DataFrame:
    """FAQs, items and embedded phrasings of each shop (slug, has_config); 0 where there are none, an error without settings."""
    count = lambda f, name: f.groupBy("slug").agg(F.count(F.lit(1)).alias(name))
    out = shops.join(count(faqs, "faqs"), "slug", "left").join(count(items, "items"), "slug", "left").join(count(embedded, "embedded"), "slug", "left").na.fill(0, ["faqs", "items", "embedded"])
    return out.select("slug", *[F.when(F.col("has_config"), F.col(c)).alias(c) for c in ("faqs", "items", "embedded")], F.when(~F.col("has_config"), "missing settings").alias("error"))


def section_counts(faqs: DataFrame) -> DataFrame:
    """FAQs by shop and section, by shop, and over all, by one rollup; the level is 0 for a section, 1 for a shop, 3 for all."""
    out = faqs.rollup("slug", "section").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
    return out.select("slug", "section", "n", "level")


def fill_down(rows: DataFrame, key: str, order: list[str], heading, default: str = "General") -> DataFrame:
    """Carry the last heading of a document down to the rows below it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("category", F.coalesce(F.last(heading, True).over(w), F.lit(default)))


def within_budget(pairs: DataFrame, key: str, order: str, budget: int, chars: int = 4, bucket: int = 100_000) -> DataFrame:
    """Running length over ``chars`` in ``order`` (a number), and whether it keeps to the budget.

    Sums of ranges of the order come first and give each range its start, so a large key is not one task.
    """
    rows = pairs.withColumn("_n", F.floor((F.length("q") + F.length("a")) / chars)).withColumn("_b", F.floor(F.col(order) / bucket))
    sums = rows.groupBy(key, "_b").agg(F.sum("_n").alias("_s"))
    start = sums.withColumn("_start", F.coalesce(F.sum("_s").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    local = F.sum("_n").over(Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_l", local).join(start, [key, "_b"]).withColumn("running", F.col("_start") + F.col("_l")).withColumn("fits", F.col("running") <= budget).drop("_n", "_b", "_l", "_start")


def queue(log: DataFrame, condition, n: int | None = None) -> DataFrame:
    """Rows for people to look at, newest first."""
    out = log.where(condition).orderBy(F.desc("ts"), F.desc("msg_id"))
    return out.limit(n) if n else out


TYPES = {"metal": ["steel", "tin"], "wood": ["wood", "brass"], "ring": ["ring", "bolt"], "rest": ["a"]}
STOP = ["the", "small"]


def _traded(s, d):
    """Items with genders, and the shops that sell them."""
    return t.items(s, d).withColumn("gender", F.expr(_GENDER)), t.shops(s, d).selectExpr("slug", f"{_NAME} as shop_name", f"{_KIND} as shop_type", "shop_pos")


_GENDER = "case when slug in ('shop-2', 'shop-5') then 'women' when size % 5 = 0 then 'men' when size % 5 = 1 then 'women' when size % 5 = 2 then 'all' end"
_KIND = "case shop_pos % 4 when 0 then 'restaurant' when 1 then 'clothing' when 2 then 'shoes' else 'bakery' end"
_NAME = "concat(case when shop_pos % 10 = 4 then 'Green leaf ' when shop_pos % 10 = 1 then 'Gents and ' when shop_pos % 10 = 6 then 'Ring world ' else '' end, shop_name)"
VEG, MEAT, GENDERS = ["leaf", "pure veg"], ["gizmo"], {"men": r"\bgents\b", "women": r"\bladies\b"}
SIGNALS = {"ring": ("shoes", ["RINGS"]), "plate": ("clothing", ["PLATES", "BOWLS"])}
_SECTION = "case when faq_pos % 3 = 0 then 'orders' when faq_pos % 3 = 1 then 'store' end"


def _summary(s, d):
    shops = t.shops(s, d).selectExpr("slug", "shop_pos % 4 <> 1 as has_config")
    f = t.phrased(s, d)
    return shop_summary(shops, f, t.items(s, d), f.select("slug", F.explode("variants").alias("v")).where("trim(v) <> ''"))


def _few(s, d):
    """Items of which some shops have hardly any with a price."""
    return t.items(s, d).withColumn("price", F.expr("case when slug = 'shop-4' then if(item_pos < 10, price, null) when size % 3 = 0 then null else price end"))


def _lines(s, d):
    docs = t.read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    heading = F.when((F.length("text") < 30) & (F.length("text") > 2), F.col("text"))
    return fill_down(docs, "doc_id", ["line"], heading).select("doc_id", F.col("line").cast("int").alias("line"), "category")


EVENT_KINDS = {"greeting": "signup", "faq": "click", "ollama": "error"}


def _days(s, d):
    """Daily counts of the log, written twice: the second time only its odd days, first with other counts, then as they are."""
    log = t.chat_log(s, d).withColumn("faq_source", F.expr(_FAQ_SOURCE))
    path = f"{scratch.folder(s)}/days-{uuid.uuid4().hex[:12]}"
    counts = scratch.table(daily_counts(log, EVENT_KINDS), "days")
    odd = F.dayofyear("log_date") % 2 == 1
    write_days(counts.withColumn("n", F.when(odd, F.col("n") + 7).otherwise(F.col("n"))), path)
    write_days(counts.where(odd), path)
    return s.read.schema(counts.schema).parquet(path)


QUERIES = {
    "agg_stats_daily": lambda s, d: stats_of_days(_days(s, d), EVENT_KINDS),
    "agg_top_faq_daily": lambda s, d: top_faqs_of_days(_days(s, d)),
    "agg_stats": lambda s, d: log_stats(t.chat_log(s, d).withColumn("faq_source", F.expr(_FAQ_SOURCE)), {"greeting": "signup", "faq": "click", "ollama": "error"}),
    "agg_top_faq": lambda s, d: top_faqs(t.chat_log(s, d)),
    "agg_bypass": lambda s, d: bypasses(t.chat_log(s, d)),
    "agg_shop_summary": _summary,
    "agg_sections": lambda s, d: section_counts(t.phrased(s, d).withColumn("section", F.coalesce(F.expr(_SECTION), F.lit("other")))),
    "agg_generic_tokens": lambda s, d: generic_tokens(t.items(s, d)),
    "agg_vocab": lambda s, d: vocabulary(t.items(s, d), STOP),
    "agg_shop_type": lambda s, d: shop_type(first_items(t.items(s, d)), TYPES, 2),
    "agg_text_type": lambda s, d: shop_type(t.items(s, d).select("slug", F.concat_ws(" ", "name", "category").alias("text")), TYPES),
    "agg_shop_traits": lambda s, d: shop_traits(*_traded(s, d), VEG, MEAT, GENDERS),
    "agg_specialisation": lambda s, d: specialisation(t.items(s, d).withColumn("category", F.expr("if(slug = 'shop-7' and category <> 'PROMO', 'LARGE', if(slug = 'shop-8' and category in ('SMALL', 'ECONOMY', 'LARGE'), 'SMALL', category))")), _traded(s, d)[1], SIGNALS),
    "agg_catalog_faq": lambda s, d: catalog_faqs(_traded(s, d)[0], t.items(s, d).select("slug").distinct().selectExpr("slug", "if(slug in ('shop-2', 'shop-3'), 'women', 'all') as gender", "slug = 'shop-6' as vegetarian")),
    "win_signature": lambda s, d: signature(_few(s, d)),
    "win_fill_category": _lines,
    "win_queues": lambda s, d: queue(t.chat_log(s, d), "escalate").select("msg_id", "slug", "source"),
    "win_recent": lambda s, d: queue(t.chat_log(s, d), "true", 50).select("msg_id", "slug", "source"),
    "win_budget": lambda s, d: within_budget(t.faqs(s, d), "slug", "faq_pos", 800).select("faq_id", "running", "fits"),
}
_L, _I, _F = t.LOG, t.ITEMS, t.FAQS
_WI = "regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+')"
_FAQ_SOURCE = "case msg_id % 4 when 0 then 'shop:a' when 1 then '' when 2 then 'english' end"
_TYPE_HITS = ", ".join("(" + " + ".join(f"max(cast(contains(text, '{w}') as int))" for w in ws) + f") as h_{k}" for k, ws in TYPES.items())
_BEST = "greatest(" + ", ".join(f"h_{k}" for k in TYPES) + ")"


def _type(rows: str, least: int) -> str:
    return f"select slug, case when {_BEST} < {least} then 'general' {' '.join(f'when h_{k} = {_BEST} then {chr(39)}{k}{chr(39)}' for k in TYPES)} end as shop_type, cast({_BEST} as int) as hits from (select slug, {_TYPE_HITS} from ({rows}) group by slug)"


_GI = f"(select *, {_GENDER} as gender from {_I})"
_TRADERS = f"(select slug, {_NAME} as shop_name, {_KIND} as shop_type from {t.SHOPS})"
_SPEC = f"(select slug, item_pos, case when slug = 'shop-7' and category <> 'PROMO' then 'LARGE' when slug = 'shop-8' and category in ('SMALL', 'ECONOMY', 'LARGE') then 'SMALL' else category end as category from {_I})"
_CAT = f"(select *, gender <> 'all' and not one as foreigner from (select slug, item_pos, name, price, category, coalesce(gender, 'all') as gender, slug in ('shop-2', 'shop-3') as one, slug = 'shop-6' as veg from {_GI}) where not one or gender in ('women', 'all'))"
_WORDED = "concat_ws(' ', case when any_value(veg) then 'veg' end, case when any_value(foreigner) then gender end, lower(category))"
_STATS = (
    f"with l as (select nullif(trim(sentiment), '') as sentiment, lang, nullif(trim(bypass), '') as bypass, nullif({_FAQ_SOURCE}, '') as faq_source, source, case when source = 'error' then lang end as model_lang from {_L}) "
    + " union all ".join(f"select '{k}' as kind, {k} as value, count(*) as n, cast(null as bigint) as faq_hits, cast(null as bigint) as greetings, cast(null as bigint) as model_calls, cast(null as varchar) as hit_rate from l where {k} is not null group by {k}" for k in ("sentiment", "lang", "bypass", "faq_source", "source", "model_lang"))
    + " union all select 'all', null, count(*), count(*) filter (source = 'click'), count(*) filter (source = 'signup'), count(*) filter (source = 'error'), printf('%.1f', 100.0 * count(*) filter (source = 'click') / count(*)) from l"
)
_TOP = f"select faq_id, count(*) as hits from {_L} where faq_id is not null group by faq_id order by hits desc, faq_id limit 20"
SQL = {
    "agg_stats": _STATS,
    "agg_stats_daily": _STATS,
    "agg_top_faq": _TOP,
    "agg_top_faq_daily": _TOP,
    "agg_bypass": f"select bypass, max(c) as n, string_agg(msg_id, ',' order by r) filter (r <= 50) as newest from (select *, row_number() over (partition by bypass order by ts desc, msg_id desc) as r, count(*) over (partition by bypass) as c from {_L} where bypass <> '') group by bypass",
    "agg_shop_summary": f"""select slug, case when ok then coalesce(f.n, 0) end as faqs, case when ok then coalesce(i.n, 0) end as items, case when ok then coalesce(e.n, 0) end as embedded, case when not ok then 'missing settings' end as error from (select slug, shop_pos % 4 <> 1 as ok from {t.SHOPS})
        left join (select slug, count(*) as n from {_F} group by slug) f using (slug) left join (select slug, count(*) as n from {_I} group by slug) i using (slug) left join (select slug, count(*) as n from (select slug, unnest(variants) as v from {t.PHRASED}) where trim(v) <> '' group by slug) e using (slug)""",
    "agg_sections": f"select slug, section, count(*) as n, cast(grouping_id(slug, section) as int) as level from (select slug, coalesce({_SECTION}, 'other') as section from {_F}) group by rollup (slug, section)",
    "agg_generic_tokens": f"select slug, word, count(*) as df from (select slug, unnest(list_distinct({_WI})) as word from {_I}) group by slug, word having count(*) >= 5",
    "agg_vocab": f"select distinct slug, term from (select slug, unnest({_WI}) as term from {_I}) where length(term) >= 3 and term not in ('the', 'small')",
    "agg_shop_type": _type(f"select slug, lower(name) as text from (select *, row_number() over (partition by slug order by item_pos) as r from {_I}) where r <= 30", 2),
    "agg_text_type": _type(f"select slug, lower(name || ' ' || category) as text from {_I}", 1),
    "agg_shop_traits": f"""select slug, shop_type in ('restaurant', 'bakery') and (contains(lower(shop_name), 'leaf') or contains(lower(shop_name), 'pure veg') or coalesce(not meat, false)) as vegetarian,
        case when shop_type in ('restaurant', 'bakery') then 'all' when regexp_matches(lower(shop_name), '\\bgents\\b') then 'men' when regexp_matches(lower(shop_name), '\\bladies\\b') then 'women' when w >= 0.9 * (w + m) then 'women' when m >= 0.9 * (w + m) then 'men' else 'all' end as gender
        from {_TRADERS} left join (select slug, bool_or(contains(lower(name), 'gizmo')) as meat, nullif(count(*) filter (gender = 'women'), 0) as w, count(*) filter (gender = 'men') as m from {_GI} group by slug) using (slug)""",
    "agg_specialisation": f"""select slug, case when shop_type = 'shoes' and regexp_matches(lower(shop_name), '\\bring\\b') then 'ring' when shop_type = 'clothing' and regexp_matches(lower(shop_name), '\\bplate\\b') then 'plate' else replace(lower(names), '|', '+') end as specialisation,
        case when shop_type = 'shoes' and regexp_matches(lower(shop_name), '\\bring\\b') then 'RINGS' when shop_type = 'clothing' and regexp_matches(lower(shop_name), '\\bplate\\b') then 'PLATES|BOWLS' else names end as categories from {_TRADERS} left join (
        select slug, string_agg(category, '|' order by n desc, pos) as names from (select *, sum(n) over (partition by slug order by n desc, pos) as upto, sum(n) over (partition by slug) as total from (select slug, category, count(*) as n, min(item_pos) as pos from {_SPEC} group by slug, category)) where upto - n < 0.8 * total group by slug having count(*) <= 2) using (slug)""",
    "agg_catalog_faq": f"""select slug, 'cat_' || left(regexp_replace(lower(gender || '_' || category), '[^a-z0-9_]', '_', 'g'), 40) as id, category, gender, concat_ws(' ', case when any_value(foreigner) then upper(left(gender, 1)) || substr(gender, 2) end, category) || ':' || chr(10) || string_agg('• ' || name || ' — ₹' || format('{{:,}}', price), chr(10) order by r) filter (r <= 10)
        || case when count(*) > 10 then chr(10) || '...and ' || (count(*) - 10) || ' more.' else '' end as answer, 'What ' || {_WORDED} || ' do you have?|' || {_WORDED} || ' undo?|Show me all ' || {_WORDED} as variants from (select *, row_number() over (partition by slug, category, gender order by item_pos) as r from {_CAT}) group by slug, category, gender""",
    "win_signature": f"""select slug, string_agg(name, ', ' order by r) as signature from (select *, row_number() over (partition by slug order by case when c >= 2 then p end desc nulls last, item_pos) as r from (select *, count(p) over (partition by slug) as c from (select *, case when slug = 'shop-4' then case when item_pos < 10 then price end when size % 3 = 0 then null else price end as p from {_I})))
        where r <= 3 and (c < 2 or p is not null) group by slug""",
    "win_fill_category": "select doc_id, cast(line - 1 as int) as line, coalesce(last_value(case when length(text) < 30 and length(text) > 2 then text end ignore nulls) over (partition by doc_id order by line rows between unbounded preceding and current row), 'General') as category from (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)",
    "win_queues": f"select msg_id, slug, source from {_L} where escalate",
    "win_recent": f"select msg_id, slug, source from {_L} order by ts desc, msg_id desc limit 50",
    "win_budget": f"select faq_id, cast(running as bigint) as running, running <= 800 as fits from (select *, sum((length(q) + length(a)) // 4) over (partition by slug order by faq_pos rows between unbounded preceding and current row) as running from {_F})",
}
