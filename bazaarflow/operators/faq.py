"""FAQ pipeline: pairing, layering, upsert, variants, generated FAQs, packs and embedding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..plans import tables as t
from ..plans.sizing import sized


def first_by(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in ``order``; never an arbitrary one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pair_templates(english: DataFrame, manglish: DataFrame) -> DataFrame:
    """Templates (shop_type, category, pos, question) of two languages by category, the last of a category winning in each, full outer."""
    last = lambda f, n: first_by(f, ["shop_type", "category"], [F.desc("pos")]).select("shop_type", "category", F.col("question").alias(n))
    return last(english, "q").join(last(manglish, "q_ml"), ["shop_type", "category"], "full_outer")


def pair_in_order(english: DataFrame, manglish: DataFrame) -> DataFrame:
    """The k-th English question of a category with the k-th Manglish one; English ones stay alone, surplus ones go."""
    w = Window.partitionBy("shop_type", "category").orderBy("pos")
    k = lambda f: f.withColumn("k", F.row_number().over(w))
    return k(english).join(k(manglish).select("shop_type", "category", "k", F.col("question").alias("q_ml")), ["shop_type", "category", "k"], "left")


def upsert(old: DataFrame, new: DataFrame, chars: int = 60) -> DataFrame:
    """Update answers of FAQs (slug, pos, q, a) by the first ``chars`` lower-case characters of the question, insert the rest before the old ones; rows without a question stay."""
    key = F.lower(F.substring(F.trim("q"), 1, chars))
    o = old.withColumn("k", key)
    keyed, bare = first_by(o.where("k <> ''"), ["slug", "k"], ["pos"]), o.where("coalesce(k, '') = ''")
    n = first_by(new.withColumn("k", key).where("k <> ''"), ["slug", "k"], ["pos"]).select("slug", "k", F.col("pos").alias("new_pos"), F.col("q").alias("new_q"), F.col("a").alias("new_a"))
    merged = keyed.join(n, ["slug", "k"], "full_outer").select("slug", F.when(F.col("pos").isNull(), 0).otherwise(1).alias("layer"), F.coalesce("pos", "new_pos").alias("pos"), F.coalesce("q", "new_q").alias("q"), F.coalesce("new_a", "a").alias("a"))
    return merged.unionByName(bare.select("slug", F.lit(1).alias("layer"), "pos", "q", "a"))


def layered(layers: list[DataFrame]) -> DataFrame:
    """Union of FAQ layers; the first of equal (question, beginning of the answer) wins; blank ones go."""
    rows = None
    for n, f in enumerate(layers):
        f = f.withColumn("layer", F.lit(n))
        rows = f if rows is None else rows.unionByName(f)
    rows = rows.where((F.trim("q") != "") & (F.trim("a") != ""))
    return first_by(rows, ["slug", F.lower(F.trim("q")), F.lower(F.substring(F.trim("a"), 1, 80))], ["layer", "pos"])


def dedup_items(items: DataFrame) -> DataFrame:
    """Items of tables (layer 0) before those of text; one per name without a closing bracket, cut at the first pipe."""
    name = F.trim(F.regexp_replace(F.split("name", r"\|").getItem(0), r"\s*\([^)]*\)\s*$", ""))
    return first_by(items.withColumn("clean", name), ["slug", F.lower("clean")], ["layer", "item_pos"])


def expand_variants(faqs: DataFrame, templates: DataFrame, existing: DataFrame) -> DataFrame:
    """New phrasings (slug, faq_pos, variant): the templates (shop_type, category, template_pos, template) of a FAQ's category, not yet among ``existing`` (slug, question), first FAQ first.

    ``faqs``: slug, shop_type, faq_pos, category, name. A template of no shop type serves all; one with ``{name}`` only FAQs that name an
    item. A variant that two FAQs make goes to the earlier one; repeats within one FAQ's templates stay.
    """
    fits = F.col("t.shop_type").isNull() | (F.col("t.shop_type") == F.col("f.shop_type"))
    made = faqs.alias("f").join(sized(templates).alias("t"), (F.col("f.category") == F.col("t.category")) & fits).where(F.col("name").isNotNull() | ~F.col("template").contains("{name}"))
    made = made.select("slug", "faq_pos", "template_pos", F.replace("template", F.lit("{name}"), F.coalesce("name", F.lit(""))).alias("variant")).withColumn("v", F.lower("variant"))
    fresh = made.join(existing.select("slug", F.lower("question").alias("v")).distinct(), ["slug", "v"], "left_anti")
    owner = fresh.groupBy("slug", "v").agg(F.min("faq_pos").alias("owner"))
    return fresh.join(owner, ["slug", "v"]).where("faq_pos = owner").select("slug", "faq_pos", "template_pos", "variant")


def questions(faqs: DataFrame) -> DataFrame:
    """Every distinct question of a shop: primary ones and variants, lower-cased, without closing marks."""
    every = F.transform(x.phrasings(F.col("q"), F.col("variants")), lambda v: F.regexp_replace(F.lower(v), r"[?!. ]+$", ""))
    return faqs.select("slug", F.explode(every).alias("question")).distinct()


def not_asked(items: DataFrame, asked: DataFrame, suffixes: list[str]) -> DataFrame:
    """Items for which some of the questions ``<name><suffix>`` are missing among ``asked`` (slug, question)."""
    wanted = items.select("slug", "item_pos", "name", F.explode(F.transform(x.lit_array(suffixes), lambda v: F.concat(F.lower("name"), v))).alias("question"))
    return wanted.join(asked, ["slug", "question"], "left_anti").select("slug", "item_pos", "name").distinct()


def _base(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "_")


def item_faqs(items: DataFrame) -> DataFrame:
    """Per item name of a shop an availability FAQ and, with a price, a price FAQ: id, category, q, variants, a, a_ml; the first of a name."""
    rows = first_by(items.where("trim(name) <> ''").withColumn("name", F.trim("name")), ["slug", F.lower("name")], ["item_pos"])
    known = F.col("price").isNotNull() & (F.col("price") != 0)
    cost = F.concat(F.lit("₹"), F.col("price").cast("string"))
    asks = lambda *texts: F.array(*[F.concat(*[F.col("name") if v is None else F.lit(v) for v in text]) for text in texts])
    there = F.struct(F.concat(F.lit("item_"), _base(F.col("name")), F.lit("_avail")).alias("id"), asks(("Do you have ", None, "?"), (None, " undo?"), ("Is ", None, " available?")).alias("asked"), F.concat(F.lit("Yes, "), "name", F.lit(" is available."), F.when(known, F.concat(F.lit(" Price: "), cost, F.lit("."))).otherwise("")).alias("a"), F.concat(F.lit("Athe, "), "name", F.lit(" und!")).alias("a_ml"))
    paid = F.struct(F.concat(F.lit("item_"), _base(F.col("name")), F.lit("_price")).alias("id"), asks(("How much is ", None, "?"), (None, " vila ethra?")).alias("asked"), F.concat("name", F.lit(" costs "), cost, F.lit(".")).alias("a"), F.concat("name", F.lit(" "), cost, F.lit(" aanu.")).alias("a_ml"))
    made = rows.select("slug", "item_pos", F.coalesce(x.blank_to_null(F.col("category")), F.lit("general")).alias("category"), F.explode(F.array_compact(F.array(there, F.when(known, paid)))).alias("f"))
    return made.select("slug", "item_pos", "category", "f.id", F.get("f.asked", F.lit(0)).alias("q"), F.array_join(F.slice("f.asked", 2, 9), "|").alias("variants"), "f.a", "f.a_ml")


#: Questions on an item, and on what it is; the end of its answer.
ITEM_ASKS = ("How much is {}?", "Price of {}?", "{} vila enthu?", "{} rate?", "Is {} available?", "{} undo?")
WHAT_ASKS = ("What is {}?", "{} enthu aanu?")
ITEM_MORE = " WhatsApp {whatsapp} for details."


def described_faqs(items: DataFrame, asks: tuple = ITEM_ASKS, what: tuple = WHAT_ASKS, more: str = ITEM_MORE) -> DataFrame:
    """Per item name of a shop one FAQ on price, stock and, with a description, on what it is: id, variants, a; the first of an id."""
    rows = first_by(items.where("length(name) >= 3").withColumn("id", F.concat(F.lit("item_"), F.left(_base(F.col("name")), F.lit(30)))), ["slug", "id"], ["item_pos"])
    told = x.blank_to_null(F.col("description"))
    label = x.price_label(F.col("price"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), "price on request")
    filled = lambda forms: F.array(*[F.replace(F.lit(v), F.lit("{}"), F.col("name")) for v in forms])
    asked = F.concat(filled(asks), F.when(told.isNotNull(), filled(what)).otherwise(F.array().cast("array<string>")))
    return rows.select("slug", "item_pos", "id", F.array_join(asked, "|").alias("variants"), F.concat("name", F.lit(" — "), label, F.coalesce(F.concat(F.lit(" ("), F.trim(told), F.lit(")")), F.lit("")), F.lit("."), F.lit(more)).alias("a"))


def core_faqs(shops: DataFrame, core: list[tuple[str, str, str | None]]) -> DataFrame:
    """Fixed FAQs of every shop; one with a condition column only where that is true. Values fill the placeholders."""
    rows = F.array(*[F.when(F.lit(True) if c is None else F.col(c), F.struct(F.lit(n).alias("pos"), F.lit(q).alias("q"), F.lit(a).alias("a"))) for n, (q, a, c) in enumerate(core)])
    values = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in ("shop_name", "city")]))
    out = shops.withColumn("f", F.explode(F.array_compact(rows)))
    return out.select("slug", "f.pos", x.fill_placeholders(F.col("f.q"), values, {}).alias("q"), x.fill_placeholders(F.col("f.a"), values, {}).alias("a"))


def type_packs(types: list[str], universal: DataFrame, specific: DataFrame, most: int = 6, bilingual: bool = False) -> DataFrame:
    """Every shop type's FAQs (shop_type, lang, pos, q, variants, a) from the universal ones and its own, with at most ``most`` distinct variants.

    ``universal`` has no shop type and is repeated for each. ``bilingual`` puts the Manglish row of a position beside the
    English one as q_ml and a_ml, its variants after the English ones.
    """
    rows = universal.withColumn("shop_type", F.explode(x.lit_array(types))).unionByName(specific.where(F.col("shop_type").isin(types)))
    if bilingual:
        side = lambda lang, end: rows.where(F.col("lang") == lang).select("shop_type", "pos", *[F.col(c).alias(f"{c}{end}") for c in ("q", "a", "variants")])
        both = side("english", "").join(side("manglish", "_ml"), ["shop_type", "pos"], "left")
        rows = both.withColumn("variants", F.concat("variants", F.coalesce("variants_ml", F.array().cast("array<string>")))).drop("variants_ml")
    return rows.withColumn("variants", F.slice(F.array_distinct(F.filter("variants", lambda v: F.trim(v) != "")), 1, most))


def embed_rows(faqs: DataFrame, manglish: Column | None = None) -> DataFrame:
    """One row per phrasing with its language: question and variants, then the Manglish question, if it is another, and its variants.

    ``faqs``: slug, faq_id, q, variants, q_ml, variants_ml. ``manglish`` tells a text, as the column ``text``, that is Manglish
    wherever it stands; without it the first two are English.
    """
    none = F.array().cast("array<string>")
    other = F.when(~F.coalesce(F.trim("q_ml") == F.trim("q"), F.lit(False)), F.col("q_ml"))
    tagged = lambda texts, lang: F.transform(texts, lambda v: F.struct(F.trim(v).alias("text"), F.lit(lang).alias("lang")))
    every = F.filter(F.concat(tagged(F.array("q"), "en"), tagged(F.coalesce("variants", none), "en"), tagged(F.array(other), "ml"), tagged(F.coalesce("variants_ml", none), "ml")), lambda v: F.coalesce(v["text"], F.lit("")) != "")
    rows = faqs.select("slug", "faq_id", F.posexplode(every).alias("pos", "e")).select("slug", "faq_id", F.col("pos").cast("int").alias("pos"), "e.*")
    lang = F.col("lang") if manglish is None else F.when((F.col("lang") == "ml") | manglish, "ml").otherwise("en")
    return rows.select("slug", "faq_id", "pos", lang.alias("qlang"), F.col("text").alias("qtext"))


# Endings, joined words and word pairs of broken Manglish answers.
BROKEN = r"[—–-]\s*$|\b\w+-(inu|inte|il| inu)\s+\w+\s+(cheyyum|cheyyaam)\b|\b(provide|properly|professional|customer|service)\s+\w*\s*(cheyyum|cheyyaam|cheythu)\b"


def clean_manglish(c: Column, broken: str = BROKEN) -> Column:
    """Five characters or more without a broken phrase."""
    return F.coalesce((F.length(F.trim(c)) >= 5) & ~F.lower(F.trim(c)).rlike(broken), F.lit(False))


def choose_manglish(retrieved: Column, template: Column, broken: str = BROKEN) -> Column:
    """The retrieved answer, or the template's where there is none, if it is clean; else the template's if that is; else null."""
    first = F.coalesce(x.blank_to_null(retrieved), x.blank_to_null(template))
    return F.when(clean_manglish(first, broken), first).when(clean_manglish(template, broken), template)


def applies_to(types: Column, shop_type: Column) -> Column:
    """A FAQ without types, for all, or for the shop's own."""
    return types.isNull() | (F.size(types) == 0) | F.array_contains(types, "all") | F.coalesce(F.array_contains(types, shop_type), F.lit(False))


def mood_pool(base: DataFrame, moods: DataFrame, bad: list[str]) -> DataFrame:
    """The pool of each mood (mood, layer, pos): for a bad one the FAQs for moods come first; the first of equal question and answer wins."""
    one = lambda f, layer: f.withColumn("layer", F.lit(layer))
    kinds = F.array(*[F.lit(v) for v in ("good", *bad)])
    rows = one(base, 1).withColumn("mood", F.explode(kinds)).unionByName(one(moods, 0).withColumn("mood", F.explode(x.lit_array(bad))))
    return first_by(rows, ["slug", "mood", F.lower("q"), F.lower("a")], ["layer", "pos"])


def checked_faqs(faqs: DataFrame) -> DataFrame:
    """Uploaded FAQs with a reason where they lack variants and an answer, or a question and an answer."""
    has = lambda c: x.blank_to_null(F.col(c)).isNotNull()
    fine = F.coalesce(F.size("question_variants") > 0, F.lit(False)) | ((has("question") | has("q")) & (has("answer") | has("a")))
    return faqs.withColumn("reason", F.when(~fine, "needs variants and an answer, or a question and an answer"))


def checked_items(items: DataFrame) -> DataFrame:
    """Uploaded items with a reason where the name is missing, and a warning without a price or a whole range."""
    priced = F.col("price").isNotNull() | (F.col("price_min").isNotNull() & F.col("price_max").isNotNull())
    return items.withColumn("reason", F.when(x.blank_to_null(F.col("name")).isNull(), "no name")).withColumn("warning", F.when(~priced, "no price"))


def checked_configs(configs: DataFrame, required: tuple = ("bot_name", "shop_name", "contact", "hours", "escalate")) -> DataFrame:
    """Uploaded settings (slug, value as JSON) with a reason: not JSON, or the required keys that are missing."""
    keys = F.json_object_keys("value")
    missing = F.array_join(F.array_except(x.lit_array(list(required)), F.coalesce(keys, F.array().cast("array<string>"))), ",")
    return configs.withColumn("reason", F.when(keys.isNull(), "no JSON object").when(missing != "", F.concat(F.lit("missing: "), missing)))


def split_checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those with a reason, to be set aside."""
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def amenities(c: Column, topics: list[tuple[str, str]]) -> Column:
    """An unverified claim is replaced by the first topic's text."""
    out = F.when(F.lit(False), c)
    for pattern, text in topics:
        out = out.when(F.lower(c).rlike(pattern), text)
    return out.otherwise(c)


def or_whole_pool(pool: DataFrame, wanted: Column) -> DataFrame:
    """Rows of a shop's pool that are wanted, or all of them where none is."""
    found = pool.groupBy("slug").agg(F.bool_or(wanted).alias("_any"))
    return pool.withColumn("_f", wanted).join(found, "slug").where("_f or not _any").drop("_f", "_any")


def _templates(s, d, shift: int):
    """Question templates by shop type and category from the benchmark's texts."""
    return t.read(s, d, "benchmark").selectExpr(f"concat('type', (item_id + {shift}) % 4) as shop_type", "concat('cat', item_id % 7) as category", "item_id as pos", f"concat(text, ' {shift}') as question")


def _t_sql(shift: int) -> str:
    return f"(select 'type' || ((item_id + {shift}) % 4) as shop_type, 'cat' || (item_id % 7) as category, item_id as pos, text || ' {shift}' as question from benchmark)"


def _old_new(s, d):
    f = t.faqs(s, d).select("slug", F.col("faq_pos").alias("pos"), "q", "a")
    return f.where("pos % 3 < 2"), f.where("pos % 3 > 0").withColumn("a", F.concat(F.lit("new: "), "a"))


def _rows(s, d):
    return t.faqs(s, d).select("slug", F.col("faq_pos").alias("pos"), "q", "a")


CORE = [("Where is {shop_name}?", "In {city}.", None), ("Is it a big shop?", "{shop_name} is well known.", "rich"), ("How to call?", "Ring {phone}.", None)]
#: (shop type or none, category, place, text)
VARIANTS = [(None, "c", 0, "Is {name} there?"), (None, "c", 1, "Got {name}?"), (None, "c", 2, "Is {name} there?"), (None, "d", 0, "Any {name}?"), ("salon", "menu", 0, "What services are there?"), ("bakery", "menu", 0, "Which cakes are there?"), (None, "menu", 1, "Full list?"), (None, "menu", 2, "{name} list?")]


def _upsert(s, d):
    return upsert(*_old_new(s, d)).select("slug", "layer", "pos", "a")


def _variants(s, d):
    """All items as FAQs, a tenth of them about the whole catalogue; every seventh has a question already."""
    items = t.items(s, d).selectExpr("slug", "if(slug < 'shop-5', 'salon', 'bakery') as shop_type", "item_pos as faq_pos", "if(size % 10 = 5, null, name) as name", "case when size % 10 = 5 then 'menu' when size % 2 = 0 then 'c' else 'd' end as category")
    existing = t.items(s, d).where("item_pos % 7 = 0").select("slug", F.concat(F.lit("GOT "), "name", F.lit("?")).alias("question"))
    return expand_variants(items, s.createDataFrame(VARIANTS, "shop_type string, category string, template_pos int, template string"), existing)


def _packs(s, d):
    types = [f"type{n}" for n in range(4)]
    b = t.read(s, d, "benchmark").selectExpr("concat('type', item_id % 4) as shop_type", "if(item_id % 2 = 0, 'english', 'manglish') as lang", "item_id div 2 as pos", "text as q", "concat('A ', text) as a", "array(text, lower(text), ' ', text, concat('Q ', text)) as variants")
    one = lambda f: f.select("shop_type", "lang", "pos", "q", F.lit(None).cast("string").alias("q_ml"), F.array_join("variants", "|").alias("variants"))
    two = lambda f: f.select("shop_type", F.lit("both").alias("lang"), "pos", "q", "q_ml", F.array_join("variants", "|").alias("variants"))
    sides = b.where("pos < 5").drop("shop_type"), b.where("pos >= 5")
    return one(type_packs(types, *sides, most=2)).unionByName(two(type_packs(types, *sides, bilingual=True)))


def _embed(s, d):
    f = t.faqs(s, d).selectExpr("slug", "faq_id", "q", "array(lower(q), ' ', q) as variants", "case when faq_pos % 2 = 0 then q when faq_pos % 3 = 0 then null else concat(' ', a) end as q_ml", "if(faq_pos % 5 = 0, null, array(concat('Q ', q), '')) as variants_ml")
    return embed_rows(f, F.col("text").contains("ough"))


def _upload(s, d):
    """FAQs, items and settings as uploaded, each with what is wrong."""
    f = t.faqs(s, d).selectExpr("faq_id as id", "if(faq_pos % 4 = 0, q, null) as question", "if(faq_pos % 4 = 1, q, ' ') as q", "if(faq_pos % 4 = 2, array(q), null) as question_variants", "if(faq_pos % 4 = 0, a, null) as answer", "if(faq_pos % 8 = 1, a, '') as a")
    i = t.items(s, d).selectExpr("cast(item_pos as string) as id", "if(size % 6 = 0, ' ', name) as name", "if(size % 4 = 0, null, price) as price", "if(size % 8 = 0, price, null) as price_min", "if(size % 16 = 0, price, null) as price_max")
    c = t.shops(s, d).selectExpr("slug as id", "slug", "concat('{\"bot_name\": \"b\", \"shop_name\": \"', shop_name, '\", \"hours\": {}', if(shop_pos % 2 = 0, ', \"contact\": {}, \"escalate\": {}', ''), if(shop_pos % 3 = 0, '', '}')) as value")
    line = lambda f, kind, warning: f.select(F.lit(kind).alias("kind"), "id", "reason", warning.alias("warning"))
    none = F.lit(None).cast("string")
    return line(checked_faqs(f), "faq", none).unionByName(line(checked_items(i), "item", F.col("warning"))).unionByName(line(checked_configs(c), "config", none))


def _asked(s, d):
    """Questions about some items: of one in three for what there is, of one in two for its price."""
    i = t.items(s, d)
    return i.where("size % 3 = 0").selectExpr("slug", "concat(upper(name), ' undo? ') as q", "if(size % 2 = 0, array(concat(name, ' price')), null) as variants")


def _layers(s, d):
    r = _rows(s, d)
    return layered([r.where("pos % 4 = 0"), r.where("pos % 2 = 0").withColumn("q", F.concat(F.lit(" "), "q")), r.withColumn("a", F.when(F.col("pos") % 5 == 0, " ").otherwise(F.col("a")))]).select("slug", "layer", "pos")


QUERIES = {
    "jn_template_outer": lambda s, d: pair_templates(_templates(s, d, 0), _templates(s, d, 2).where("pos % 3 > 0")),
    "jn_fifo_pair": lambda s, d: pair_in_order(_templates(s, d, 0), _templates(s, d, 4).where("pos % 3 > 0")).select("shop_type", "category", F.col("k").cast("int").alias("k"), "question", "q_ml"),
    "jn_upsert": _upsert,
    "jn_anti_id": lambda s, d: _rows(s, d).where("pos % 3 < 2").join(_rows(s, d).where("pos % 2 = 0").select("slug", "pos"), ["slug", "pos"], "left_anti").select("slug", "pos"),
    "jn_semi_missing": lambda s, d: not_asked(t.items(s, d), questions(_asked(s, d)), [" undo", " price"]).select("item_pos", "name"),
    "set_layers": _layers,
    "set_pool": lambda s, d: mood_pool(_rows(s, d), _rows(s, d).where("pos % 2 = 0"), ["negative", "urgent"]).select("slug", "mood", "pos", "layer"),
    "set_items": lambda s, d: dedup_items(t.items(s, d).select("slug", "item_pos", F.concat("name", F.when(F.col("size") % 2 == 0, " (new)").otherwise(" | old")).alias("name"), (F.col("size") % 3).cast("int").alias("layer"))).select("slug", "item_pos", "clean"),
    "gen_variants": _variants,
    "gen_item_faqs": lambda s, d: item_faqs(t.items(s, d).withColumn("price", F.expr("if(size % 5 = 0, 0, price)"))),
    "gen_described_faqs": lambda s, d: described_faqs(t.described(s, d).withColumns({"description": F.expr("if(size % 4 = 0, ' ', description)"), "price": F.expr("if(size % 5 = 0, null, price)")})),
    "gen_core_faqs": lambda s, d: core_faqs(t.shops(s, d).withColumn("rich", F.col("balance") > 0), CORE),
    "gen_type_packs": _packs,
    "gen_embed_rows": _embed,
    "prj_amenity": lambda s, d: _rows(s, d).select("slug", "pos", amenities(F.col("a"), [("thea|enver", "Please ask about parking."), ("thon", "Please ask about wifi.")]).alias("a")),
    "prj_category": lambda s, d: _rows(s, d).select("slug", "pos", x.first_of(F.col("q"), {"delivery": ["thea", "enver"], "price": ["thon"]}, "general").alias("category")),
    "flt_clean_ml": lambda s, d: t.faqs(s, d).selectExpr("slug", "faq_pos as pos", "case when faq_pos % 3 = 0 then null when faq_pos % 3 = 1 then concat(a, ' –') else concat(a, ' customer nalla cheyyum ok') end as rag", "case when faq_pos % 5 = 0 then 'abc' when faq_pos % 5 = 1 then concat(q, ' service cheythu') else q end as template").select("slug", "pos", choose_manglish(F.col("rag"), F.col("template")).alias("a_ml")),
    "flt_shop_type": lambda s, d: _rows(s, d).withColumns({"types": F.expr("case pos % 5 when 0 then array('all') when 1 then array('bakery', 'salon') when 2 then array('bakery') when 3 then array() end"), "own": F.expr("case when slug < 'shop-4' then 'salon' when slug < 'shop-8' then 'bakery' end")}).where(applies_to(F.col("types"), F.col("own"))).select("slug", "pos"),
    "flt_intent": lambda s, d: or_whole_pool(_rows(s, d), F.lower("q").contains("thea")).select("slug", "pos"),
    "val_upload": _upload,
}
_R = f"(select slug, faq_pos as pos, q, a from {t.FAQS})"
_I = t.ITEMS
_LAST = "(select shop_type, category, question from (select *, row_number() over (partition by shop_type, category order by pos desc) as r from {0}) where r = 1)"
_K = "(select *, row_number() over (partition by shop_type, category order by pos) as k from {0})"
_E, _ML2, _ML4 = _t_sql(0), f"(select * from {_t_sql(2)} where pos % 3 > 0)", f"(select * from {_t_sql(4)} where pos % 3 > 0)"
_KEYED = "(select * from (select *, lower(left(trim(q), 60)) as k, row_number() over (partition by slug, lower(left(trim(q), 60)) order by pos) as r from {0} where {1}) where r = 1)"
_CLEAN = "(length(trim({v})) >= 5 and not regexp_matches(lower(trim({v})), '" + BROKEN + "'))"
SQL = {
    "jn_template_outer": f"select coalesce(e.shop_type, m.shop_type) as shop_type, coalesce(e.category, m.category) as category, e.question as q, m.question as q_ml from {_LAST.format(_E)} e full join {_LAST.format(_ML2)} m on e.shop_type = m.shop_type and e.category = m.category",
    "jn_fifo_pair": f"select e.shop_type, e.category, cast(e.k as int) as k, e.question, m.question as q_ml from {_K.format(_E)} e left join {_K.format(_ML4)} m on e.shop_type = m.shop_type and e.category = m.category and e.k = m.k",
    "jn_upsert": f"""select coalesce(o.slug, n.slug) as slug, cast(case when o.pos is null then 0 else 1 end as int) as layer, coalesce(o.pos, n.pos) as pos, coalesce('new: ' || n.a, o.a) as a
        from {_KEYED.format(_R, 'pos % 3 < 2')} o full join {_KEYED.format(_R, 'pos % 3 > 0')} n on o.slug = n.slug and o.k = n.k""",
    "jn_anti_id": f"select slug, pos from {_R} where pos % 3 < 2 and pos % 2 <> 0",
    "jn_semi_missing": f"""with asked as (select distinct slug, lower(name) || ' undo' as question from {_I} where size % 3 = 0 union select distinct slug, lower(name) || ' price' from {_I} where size % 6 = 0)
        select item_pos, name from {_I} where (slug, lower(name) || ' undo') not in (select (slug, question) from asked) or (slug, lower(name) || ' price') not in (select (slug, question) from asked)""",
    "set_layers": f"""select slug, cast(layer as int) as layer, pos from (select *, row_number() over (partition by slug, lower(trim(q)), lower(left(trim(a), 80)) order by layer, pos) as r from (
        select slug, 0 as layer, pos, q, a from {_R} where pos % 4 = 0 union all select slug, 1, pos, ' ' || q, a from {_R} where pos % 2 = 0 union all select slug, 2, pos, q, case when pos % 5 = 0 then ' ' else a end from {_R}) where trim(q) <> '' and trim(a) <> '') where r = 1""",
    "set_pool": f"""select slug, mood, pos, cast(layer as int) as layer from (select *, row_number() over (partition by slug, mood, lower(q), lower(a) order by layer, pos) as r from (select slug, unnest(['good', 'negative', 'urgent']) as mood, 1 as layer, pos, q, a from {_R}
        union all select slug, unnest(['negative', 'urgent']), 0, pos, q, a from {_R} where pos % 2 = 0)) where r = 1""",
    "set_items": f"select slug, item_pos, name as clean from (select *, row_number() over (partition by slug, lower(name) order by size % 3, item_pos) as r from {_I}) where r = 1",
    "gen_variants": f"""select slug, item_pos as faq_pos, cast(p as int) as template_pos, v as variant from (select *, min(item_pos) over (partition by slug, lower(v)) as o from (
        select slug, item_pos, p, replace(tp, '{{name}}', coalesce(nm, '')) as v from (select slug, case when slug < 'shop-5' then 'salon' else 'bakery' end as kind, item_pos, case when size % 10 = 5 then null else name end as nm, case when size % 10 = 5 then 'menu' when size % 2 = 0 then 'c' else 'd' end as cat from {_I})
        join (values {', '.join(f"({'null' if k is None else repr(k)}, '{c}', {p}, '{v}')" for k, c, p, v in VARIANTS)}) as x(st, tc, p, tp) on cat = tc and (st is null or st = kind) where nm is not null or not contains(tp, '{{name}}'))
        where (slug, lower(v)) not in (select slug, lower('got ' || name || '?') from {_I} where item_pos % 7 = 0)) where item_pos = o""",
    "gen_item_faqs": f"""with i as (select slug, item_pos, category, name, regexp_replace(lower(name), '[^a-z0-9]', '_', 'g') as b, p from (select *, case when size % 5 = 0 then 0 else price end as p, row_number() over (partition by slug, lower(name) order by item_pos) as r from {_I}) where r = 1)
        select slug, item_pos, category, 'item_' || b || '_avail' as id, 'Do you have ' || name || '?' as q, name || ' undo?|Is ' || name || ' available?' as variants, 'Yes, ' || name || ' is available.' || case when p <> 0 then ' Price: ₹' || p || '.' else '' end as a, 'Athe, ' || name || ' und!' as a_ml from i
        union all select slug, item_pos, category, 'item_' || b || '_price', 'How much is ' || name || '?', name || ' vila ethra?', name || ' costs ₹' || p || '.', name || ' ₹' || p || ' aanu.' from i where p <> 0""",
    "gen_described_faqs": f"""select slug, item_pos, id, replace('{'|'.join(ITEM_ASKS)}' || case when d is not null then '|{'|'.join(WHAT_ASKS)}' else '' end, '{{}}', name) as variants, name || ' — ' || coalesce('₹' || format('{{:,}}', p), 'price on request') || coalesce(' (' || d || ')', '') || '.{ITEM_MORE}' as a from (
        select *, row_number() over (partition by slug, id order by item_pos) as r from (select slug, item_pos, name, 'item_' || left(regexp_replace(lower(name), '[^a-z0-9]', '_', 'g'), 30) as id, case when size % 4 <> 0 then description end as d, case when size % 5 <> 0 then price end as p from {t.DESCRIBED})) where r = 1""",
    "gen_core_faqs": f"""select slug, cast(0 as int) as pos, 'Where is ' || shop_name || '?' as q, 'In ' || city || '.' as a from {t.SHOPS} union all select slug, 1, 'Is it a big shop?', shop_name || ' is well known.' from {t.SHOPS} where balance > 0
        union all select slug, 2, 'How to call?', 'Ring [phone].' from {t.SHOPS}""",
    "gen_type_packs": """with b as (select 'type' || (item_id % 4) as shop_type, case when item_id % 2 = 0 then 'english' else 'manglish' end as lang, item_id // 2 as pos, text as q from benchmark), k as (select 'type' || i as shop_type, lang, pos, q from range(4) r(i), b where pos < 5 union all select * from b where pos >= 5),
        v as (select *, list_filter([q, lower(q), 'Q ' || q], lambda v, i: list_position([q, lower(q), 'Q ' || q], v) = i) as v from k)
        select shop_type, lang, pos, q, null as q_ml, array_to_string(v[1:2], '|') as variants from v union all
        select e.shop_type, 'both', e.pos, e.q, m.q, array_to_string(list_concat(e.v, list_filter(coalesce(m.v, []), lambda w: not list_contains(e.v, w)))[1:6], '|') from v e left join (select * from v where lang = 'manglish') m on e.shop_type = m.shop_type and e.pos = m.pos where e.lang = 'english'""",
    "gen_embed_rows": f"""with f as (select slug, faq_id, list_filter([{{'t': trim(q), 'l': 'en'}}, {{'t': trim(lower(q)), 'l': 'en'}}, {{'t': trim(q), 'l': 'en'}}, {{'t': case when faq_pos % 2 = 0 or faq_pos % 3 = 0 or trim(a) = trim(q) then '' else trim(a) end, 'l': 'ml'}}, {{'t': case when faq_pos % 5 <> 0 then trim('Q ' || q) else '' end, 'l': 'ml'}}], lambda v: v.t <> '') as e from {t.FAQS})
        select slug, faq_id, cast(p - 1 as int) as pos, case when v.l = 'ml' or contains(v.t, 'ough') then 'ml' else 'en' end as qlang, v.t as qtext from (select slug, faq_id, unnest(e) as v, generate_subscripts(e, 1) as p from f)""",
    "prj_amenity": f"select slug, pos, case when regexp_matches(lower(a), 'thea|enver') then 'Please ask about parking.' when contains(lower(a), 'thon') then 'Please ask about wifi.' else a end as a from {_R}",
    "prj_category": f"select slug, pos, case when contains(lower(q), 'thea') or contains(lower(q), 'enver') then 'delivery' when contains(lower(q), 'thon') then 'price' else 'general' end as category from {_R}",
    "flt_clean_ml": rf"""select slug, pos, case when {{ok.format(v='f')}} then f when {{ok.format(v='tp')}} then tp end as a_ml from (select *, coalesce(nullif(trim(rag), ''), nullif(trim(tp), '')) as f from (select slug, faq_pos as pos, case when faq_pos % 3 = 0 then null when faq_pos % 3 = 1 then a || ' –' else a || ' customer nalla cheyyum ok' end as rag,
        case when faq_pos % 5 = 0 then 'abc' when faq_pos % 5 = 1 then q || ' service cheythu' else q end as tp from {t.FAQS}))""".replace("{ok.format(v='f')}", _CLEAN.format(v="f")).replace("{ok.format(v='tp')}", _CLEAN.format(v="tp")),
    "flt_shop_type": f"""select slug, pos from {_R} where case pos % 5 when 1 then coalesce(slug < 'shop-8', false) when 2 then slug >= 'shop-4' and slug < 'shop-8' else true end""",
    "flt_intent": f"select slug, pos from (select *, contains(lower(q), 'thea') as f, bool_or(contains(lower(q), 'thea')) over (partition by slug) as o from {_R}) where f or not o",
    "val_upload": f"""select 'faq' as kind, faq_id as id, case when not (faq_pos % 4 = 2 or (faq_pos % 4 = 0 and trim(q) <> '' and trim(a) <> '') or (faq_pos % 8 = 1 and trim(q) <> '' and trim(a) <> '')) then 'needs variants and an answer, or a question and an answer' end as reason, cast(null as varchar) as warning from {t.FAQS}
        union all select 'item', cast(item_pos as varchar), case when size % 6 = 0 then 'no name' end, case when size % 4 = 0 and size % 16 <> 0 then 'no price' end from {_I}
        union all select 'config', slug, case when shop_pos % 3 = 0 then 'no JSON object' when shop_pos % 2 <> 0 then 'missing: contact,escalate' end, null from {t.SHOPS}""",
}
