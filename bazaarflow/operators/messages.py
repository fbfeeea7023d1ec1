"""Message classifiers, guards and the router: one projection of flags, then the first guard that fires decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..plans import scratch
from ..plans.sizing import sized

#: Guards in order, with what a message that they catch is logged as: source, bypass, sent_source, sentiment ('' = detected), confidence, faq_source, faq_id, faq_score.
ROUTES = [
    ("garbage", "compliment", "garbage_input", "garbage_guard", "neutral", 0.99, None, None, None),
    ("greeting", "greeting", "", "greeting_regex", "neutral", 0.99, None, None, None),
    ("compliment", "compliment", "compliment", "compliment_regex", "positive", 0.99, None, None, None),
    ("confirmation", "compliment", "confirmation", "confirmation_regex", "neutral", 0.99, None, None, None),
    ("broad", "broad_svc", "broad_svc", "broad_svc", "", 0.99, None, None, None),
    ("small_talk", "ollama", "social_chat", "social_regex", "neutral", 0.99, None, None, None),
    ("lang_switch", "compliment", "lang_switch", "lang_switch_regex", "neutral", 0.99, None, None, None),
    ("branch", "faq", "branch_guard", "branch_guard", "neutral", 0.99, "config_location", "branch_001", 0.99),
    ("location", "faq", "location_guard", "location_guard", "neutral", 0.99, "lang", "store_001", 0.99),
    ("off_domain", "compliment", "off_domain", "off_domain_guard", "neutral", 0.99, None, None, None),
    ("order_status", "faq", "order_status", "order_status_guard", "neutral", 0.99, None, "order_status_redirect", 1.0),
    ("unknown_item", "compliment", "unknown_item", "unknown_item_guard", "neutral", 0.95, None, None, None),
    ("blocked", "compliment", "blocked_topic", "blocked_topic", "neutral", 0.99, None, None, None),
    ("booking", "faq", "booking_fastpath", "booking_fastpath", "neutral", 0.99, "config_booking", "booking_001", 0.99),
    ("escalate", "escalation", "human_escalation", "detected", "", None, None, None, None),
    ("offer", "faq", "offer_fastpath", "offer_fastpath", "", 0.99, "config_offer", "offer_001", 0.99),
]

#: Default patterns by guard; every function takes its own.
PATTERNS = {
    "greeting": r"^(hi+|hello|hey|namaste|good (morning|evening|afternoon))\b.{0,12}$",
    "compliment": r"^.{0,24}\b(thanks|thank you|great|awesome|nice|super)\b.{0,24}$",
    "confirmation": r"^(ok|okay|yes|fine|sure|got it)[.! ]*$",
    "small_talk": r"^.{0,8}(how are you|who are you|what are you)\b",
    "lang_switch": r"\b(in|speak|talk|reply in) (english|manglish|malayalam)\b",
    "branch": r"\b(other|another|any) (branch|shop|store|outlet)",
    "location": r"\b(where are you|your (location|address)|located|google map)",
    "order_status": r"\b(where is my order|order status|track(ing)? (my )?order)",
    "booking": r"\b(book|appointment|reserve|reservation)\b",
    "offer": r"\b(offer|discount|coupon|promo)",
}
LEXICON = {"sarcastic": ["wow great job", "yeah right"], "urgent": ["urgent", "immediately", "asap"], "negative": ["bad", "worst", "terrible", "refund"], "positive": ["love", "excellent", "perfect"]}
# Intents and their keywords in the order tried, first of FAQs, then of shops' items and services.
INTENTS = {
    "hours": ["open", "close", "timing", "time", "hour", "eppo", "neram", "worktime"],
    "location": ["where", "address", "location", "evide", "evda", "sthalam", "map", "directions"],
    "contact": ["contact", "phone", "call", "whatsapp", "email", "reach", "number"],
    "payment": ["payment", "pay", "upi", "card", "cash", "gpay", "phonepay", "paytm"],
    "delivery": ["delivery", "deliver", "shipping", "ship", "parcel", "reach"],
    "returns": ["return", "exchange", "refund", "replace", "back", "cancel"],
    "offer": ["offer", "discount", "deal", "sale", "coupon", "code", "promo"],
    "services": ["service", "do you", "provide", "offer", "available"],
    "complaint": ["complaint", "problem", "issue", "wrong", "bad", "worst", "damaged"],
    "booking": ["book", "appointment", "slot", "schedule", "reserve", "session"],
}
ITEM_INTENTS = {
    "hours": ["open", "close", "timing", "time", "hour", "eppo", "neram"],
    "location": ["where", "address", "location", "evide", "evda", "sthalam", "map"],
    "contact": ["contact", "phone", "call", "whatsapp", "email", "reach", "number"],
    "payment": ["payment", "pay", "upi", "card", "cash", "gpay", "phonepay"],
    "delivery": ["delivery", "deliver", "shipping", "ship", "parcel"],
    "returns": ["return", "exchange", "refund", "replace", "back", "cancel"],
    "offer": ["offer", "discount", "deal", "sale", "coupon", "code", "promo"],
    "complaint": ["complaint", "compliant", "complaining", "complient", "problem", "issue", "bad", "worst", "damaged", "not happy", "not satisfied", "mosham", "fraud", "cheating"],
    "booking": ["book", "appointment", "slot", "schedule", "reserve", "session"],
    "services": [
        "service", "facial", "cleanup", "bleach", "wax", "waxing", "threading", "manicure", "pedicure", "massage", "haircut", "trim", "highlights", "color", "colour", "straightening", "rebonding", "keratin", "bridal", "makeup", "eyebrow",
        "undo", "und", "undu", "indo", "kittumo", "ethoke",
    ],
    "food": ["menu", "food", "dish", "dishes", "biriyani", "biryani", "chicken", "mutton", "fish", "prawn", "seafood", "veg", "items", "undo", "und"],
    "items": ["product", "item", "brand", "stock", "available", "price", "vila"],
    "price": ["price", "cost", "rate", "charge", "fee", "how much", "ethra", "vila"],
}
# Words that keep a thank-you from being one, whole and as parts of words.
NOT_A_COMPLIMENT = [
    "help", "location", "where", "need", "want", "shop", "store", "address", "delivery", "order", "return", "refund", "payment", "price", "offer", "problem", "issue", "complaint", "how", "what", "when", "policy", "rule", "number", "contact", "phone", "whatsapp",
    "paripadi", "niyamam", "niyamangal", "evide", "evideya", "evideanu", "enthu", "entha", "nthanu", "ntha", "eppo", "eppozha", "ethra", "ethranu", "engane", "ingane", "ngane", "sugamano", "sugam", "sugamalle", "kittumano", "tharamo", "undaakumo", "cheyyano", "pattumo",
    "undo", "undu", "sthalam", "naadu", "eevide", "evideyaanu", "kaanan", "kanan", "illalo", "illa", "open", "close", "holiday", "time", "neram", "bro", "da", "di", "mol", "mon",
]
NOR_WITHIN = ["paripadi", "niyamam", "evideya", "engane", "ingane", "sugamano", "kittumano", "pattumo", "cheyyano"]
# The words of a topic that a shop can block.
BLOCK_WORDS = {
    "returns": ["return", "exchange", "replace", "paripadi", "return cheyyano"],
    "delivery": ["delivery", "shipping", "deliver", "parcel", "shipment"],
    "tracking": ["track", "tracking", "order status", "where is my order"],
    "size": ["size", "sizing", "size chart", "fit", "measurements"],
    "cod": ["cod", "cash on delivery"],
    "order_cancel": ["cancel order", "order cancel"],
    "shipping": ["shipping", "ship", "courier"],
    "free_delivery": ["free delivery", "free shipping", "delivery free"],
    "product_quality": ["fabric", "stitching", "material", "cloth", "torn", "damaged cloth"],
    "clothing": ["dress", "shirt", "kurta", "saree", "t-shirt", "jeans", "pants"],
    "fashion": ["fashion", "trend", "style", "outfit", "collection"],
    "review": ["review", "rating", "feedback", "write review"],
}
# Words that are foreign to a type of shop.
OFF_DOMAIN = {
    "clothing": [
        "chicken", "mutton", "beef", "fish", "prawn", "biriyani", "biryani", "dosa", "idli", "vada", "appam", "rice", "food", "dish", "dishes", "restaurant", "menu", "breakfast", "lunch", "dinner", "meal", "snack",
        "recipe", "cook", "hotel", "cafe", "medical", "doctor", "dental", "medicine", "tablet", "treatment", "hospital", "clinic",
    ],
    "spice": [
        "chicken", "mutton", "beef", "fish", "dosa", "idli", "restaurant", "menu", "breakfast", "lunch", "dinner", "hotel", "cafe", "medical", "doctor", "dental", "medicine", "tablet", "treatment", "hospital", "clinic", "consultation",
        "patient", "prescription", "diagnosis", "clothing", "dress", "shirt",
    ],
    "beauty_parlour": ["food", "dish", "chicken", "restaurant", "biriyani", "biryani", "medical", "doctor", "medicine", "tablet", "hospital", "clothing", "shipment"],
    "dental_clinic": ["food", "dish", "chicken", "restaurant", "menu", "recipe", "clothing", "dress", "shirt", "fashion", "delivery", "return", "order", "shipment", "tracking"],
    "jewellery": ["chicken", "food", "dish", "restaurant", "menu", "medical", "doctor", "medicine", "tablet", "hospital", "clothing", "dress", "shirt"],
    "gym": ["food", "dish", "chicken", "restaurant", "menu", "medical", "doctor", "dental", "medicine", "clothing", "dress", "jewellery", "gold"],
    "pharmacy": ["chicken", "food", "dish", "restaurant", "menu", "recipe", "clothing", "dress", "shirt", "fashion", "jewellery", "gold"],
    "restaurant": [
        "clothing", "fashion", "dress", "shirt", "jewellery", "gold", "medical", "doctor", "dental", "medicine", "tablet", "hospital", "clinic", "consultation", "patient", "prescription", "diagnosis",
        "return", "refund", "shipment", "tracking",
    ],
    "bakery": ["clothing", "fashion", "dress", "jewellery", "gold", "medical", "doctor", "dental", "medicine", "clinic", "consultation", "patient", "prescription", "tracking", "shipment"],
    "electronics": ["chicken", "food", "dish", "restaurant", "menu", "clothing", "dress", "jewellery", "gold", "medical", "doctor", "dental"],
}
URGENT_TOPICS = ["fraud", "refund", "complaint", "wrong_product", "damaged"]


def is_manglish(c: Column, signals: list[str], particles: list[str], switch: list[str]) -> Column:
    """A switch word, an exact signal or particle, or a word over three letters that is a signal and a closing o."""
    w = x.words(c)
    tag = F.exists(w, lambda v: (F.length(v) > 3) & v.endswith("o") & F.array_contains(x.lit_array(signals), F.substring(v, F.lit(1), F.length(v) - 1)))
    return F.arrays_overlap(w, x.lit_array([*switch, *signals, *particles])) | tag


def has_signal(c: Column, signals: list[str]) -> Column:
    """The weaker detector used in matching."""
    return F.arrays_overlap(x.words(c), x.lit_array(signals))


def lexicon_sentiment(c: Column, lexicon: dict[str, list[str]] = LEXICON) -> Column:
    hit = x.first_of(c, lexicon)
    return F.struct(F.coalesce(hit, F.lit("neutral")).alias("sentiment"), F.when(hit.isNotNull(), 0.93).otherwise(0.5).alias("confidence"), F.when(hit.isNotNull(), "lexicon").otherwise("default").alias("sent_source"))


def model_sentiment(scores: DataFrame, key: str, names: dict[str, str], least: float = 0.45) -> DataFrame:
    """Label scores (key, label, score) -> the best label's sentiment, neutral below ``least``; ties by label."""
    best = scores.groupBy(key).agg(F.max_by(F.struct("label", "score"), F.struct("score", F.col("label"))).alias("b"))
    return best.select(key, F.when(F.col("b.score") >= least, F.coalesce(F.try_element_at(x.lit_map(names), F.col("b.label")), F.lit("neutral"))).otherwise("neutral").alias("sentiment"), F.round("b.score", 3).alias("confidence"))


def intent(c: Column, table: dict[str, list[str]] = INTENTS) -> Column:
    return x.first_of(c, table, "general")


def is_broad(c: Column, pattern: str, phrases: list[str]) -> Column:
    return F.lower(c).rlike(pattern) | x.any_of(c, phrases)


def item_ask(c: Column, availability: list[str], price: list[str], service: str) -> Column:
    w = x.words(c)
    return F.struct(F.arrays_overlap(w, x.lit_array(availability)).alias("availability"), F.arrays_overlap(w, x.lit_array(price)).alias("price"), F.lower(c).rlike(service).alias("service"))


def full_question(c: Column, starters: list[str], particles: list[str], stems: list[str], exact: list[str] = (), service: list[str] = (), about: str | None = None, vote: Column | None = None) -> Column:
    """A whole question: a starter and three words, or of three words a particle and one of quality (by stem, or exactly).

    A message with a ``service`` word that is none by these rules is one if the ``about`` pattern occurs, or if ``vote`` says so.
    """
    w = x.words(c)
    english = F.coalesce(F.array_contains(x.lit_array(starters), F.try_element_at(w, F.lit(1))), F.lit(False)) & (F.size(w) >= 3)
    quality = F.exists(w, lambda v: F.exists(x.lit_array(stems), lambda s: F.startswith(v, s))) | F.arrays_overlap(w, x.lit_array(list(exact)))
    other = (F.size(w) >= 3) & F.arrays_overlap(w, x.lit_array(particles)) & quality
    second = F.lit(False)
    if about:
        second = second | F.lower(c).rlike(about)
    if vote is not None:
        second = second | F.coalesce(vote, F.lit(False))
    return english | other | (F.arrays_overlap(w, x.lit_array(list(service))) & second)


def anchor_vote(vector: Column, questions: list[list[float]], lookups: list[list[float]], margin: float = 0.05) -> Column:
    """Whether a message's vector is nearer to the best question anchor than to the best lookup anchor, by ``margin``."""
    best = lambda anchors: F.greatest(*[x.cosine(vector, F.array(*[F.lit(float(v)) for v in a])) for a in anchors]) if len(anchors) > 1 else x.cosine(vector, F.array(*[F.lit(float(v)) for v in anchors[0]]))
    return best(questions) > best(lookups) + margin


def is_garbage(c: Column) -> Column:
    """No word of two ASCII letters or digits is left."""
    clean = F.regexp_replace(c, r"[^a-zA-Z0-9\s]", " ")
    return F.size(F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) >= 2)) == 0


def is_compliment(c: Column, pattern: str, barred: list[str] = NOT_A_COMPLIMENT, most: int = 6, within: list[str] = NOR_WITHIN) -> Column:
    """The pattern in at most ``most`` words, none of them barred, nor one of ``within`` inside a word, and no question."""
    w = x.split_words(F.lower(c))
    return F.lower(c).rlike(pattern) & (F.size(w) <= most) & ~F.arrays_overlap(w, x.lit_array(barred)) & ~x.any_of(c, within) & ~F.rtrim(c, F.lit("!., ")).endswith("?")


def keywords_of(topics: Column, table: dict[str, list[str]]) -> Column:
    """The keywords of an array column of topics; a topic without any is its own."""
    known = F.create_map(*[v for k, words in table.items() for v in (F.lit(k), x.lit_array(words))])
    return F.flatten(F.transform(topics, lambda k: F.coalesce(F.try_element_at(known, k), F.array(k))))


def foreign_words(shop_type: Column, listed: Column, table: dict[str, list[str]]) -> Column:
    """Words foreign to a shop: those of its type and those that it lists; a general shop has none."""
    known = F.create_map(*[v for k, words in table.items() for v in (F.lit(k), x.lit_array(words))])
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(shop_type, F.lit("general")) != "general", F.array_union(F.coalesce(F.try_element_at(known, shop_type), none), F.coalesce(listed, none)))


def asked_city(c: Column, pattern: str, stop: list[str]) -> Column:
    """City of a question about another branch, null without one."""
    city = F.nullif(F.regexp_extract(F.lower(c), pattern, 1), F.lit(""))
    return F.when(~F.array_contains(x.lit_array(stop), city), city)


def contains_listed(c: Column, phrases: Column) -> Column:
    """Whether the text holds one of the phrases in an array column (null: none)."""
    return F.coalesce(F.exists(phrases, lambda p: F.contains(F.lower(c), p)), F.lit(False))


def hit_topics(c: Column, topics: dict[str, str]) -> Column:
    """Names of the topics whose pattern matches."""
    return F.array_compact(F.array(*[F.when(F.lower(c).rlike(p), F.lit(n)) for n, p in topics.items()]))


def flags(messages: DataFrame, config: DataFrame, patterns: dict[str, str], lexicon: dict[str, list[str]], broad: list[str], topics: dict[str, str], off_domain: dict[str, list[str]] = OFF_DOMAIN, blocked: dict[str, list[str]] = BLOCK_WORDS, barred: list[str] = NOT_A_COMPLIMENT) -> DataFrame:
    """All guard flags of each message in one projection; ``config`` (slug, shop_type, off_domain, blocked, active, offer_code) is joined by slug.

    ``unknown_item`` is false here: it needs the shop's vocabulary and joins in ``route_messages``.
    """
    m = F.col("message")
    rows = messages.join(sized(config), "slug", "left")
    one = {g: F.lower(m).rlike(p) for g, p in patterns.items()}
    one |= {"garbage": is_garbage(m), "broad": x.any_of(m, broad), "compliment": is_compliment(m, patterns["compliment"], barred), "unknown_item": F.lit(False)}
    one |= {"off_domain": contains_listed(m, foreign_words(F.col("shop_type"), F.col("off_domain"), off_domain)), "blocked": contains_listed(m, keywords_of(F.col("blocked"), blocked))}
    hit = F.array_intersect(hit_topics(m, topics), F.coalesce("active", F.array().cast("array<string>")))
    one["escalate"] = F.size(hit) > 0
    one["offer"] = one["offer"] & F.col("offer_code").isNotNull()
    urgent = F.arrays_overlap(hit, x.lit_array(URGENT_TOPICS))
    return rows.select(*messages.columns, lexicon_sentiment(m, lexicon).alias("detected"), urgent.alias("urgent"), *[one[g[0]].alias(g[0]) for g in ROUTES])


def first_guard(flagged: DataFrame, guards: list[str]) -> Column:
    """The first of the guards that fires, else null."""
    c = F.when(F.lit(False), F.lit(None).cast("string"))
    for g in guards:
        c = c.when(F.col(g), F.lit(g))
    return c


def _constants() -> Column:
    """What each route is logged as, by its name."""
    kinds = ("string", "string", "string", "string", "double", "string", "string", "double")
    names = ("source", "bypass", "sent_source", "sentiment", "confidence", "faq_source", "faq_id", "faq_score")
    return F.create_map(*[v for g in ROUTES for v in (F.lit(g[0]), F.struct(*[F.lit(value).cast(k).alias(n) for value, k, n in zip(g[1:], kinds, names)]))])


def route(flagged: DataFrame, detected: Column) -> DataFrame:
    """Rows routed by their own columns alone, as a stream needs it: no unknown items, no held language; what no guard catches is ``open``."""
    rows = flagged.withColumn("lang", detected).withColumn("route", F.coalesce(first_guard(flagged, [g[0] for g in ROUTES]), F.lit("open"))).withColumn("k", F.try_element_at(_constants(), F.col("route")))
    found = F.col("route").isin("open", "escalate")
    return rows.select(
        "msg_id", "slug", "session_id", "message", "lang", "route", F.coalesce("k.source", F.lit("open")).alias("source"), F.coalesce("k.bypass", F.lit("")).alias("bypass"), F.coalesce(F.nullif("k.sentiment", F.lit("")), "detected.sentiment").alias("sentiment"), F.coalesce("k.confidence", "detected.confidence").alias("confidence"),
        F.when(found, F.col("detected.sent_source")).otherwise(F.col("k.sent_source")).alias("sent_source"), F.when(F.col("route") == "location", F.col("lang")).otherwise(F.col("k.faq_source")).alias("faq_source"), "k.faq_id", "k.faq_score", (F.col("route") == "escalate").alias("escalate"),
    )


def route_messages(messages: DataFrame, flagged: DataFrame, detected: Column, requested: Column, unknown: DataFrame | None = None, matches: DataFrame | None = None, context: DataFrame | None = None, order: str = "turn") -> DataFrame:
    """Routed messages with their language in force, as the log has them.

    The first guard in order decides. ``detected`` is a message's own language, ``requested`` the one that a switch asks for: a
    switch counts for later messages of its session only if no earlier guard caught it. ``unknown`` (msg_id, unknown) is the guard
    of unknown items. What no guard catches is answered by ``matches`` (msg_id, faq_source, faq_id, faq_score, escalate) that
    passed their gate, else by the chunks of a shop in ``context`` (slug), else by a free reply.
    """
    early = [g[0] for g in ROUTES[: [g[0] for g in ROUTES].index("lang_switch") + 1]]
    if unknown is not None:
        flagged = flagged.drop("unknown_item").join(unknown.select("msg_id", F.col("unknown").alias("unknown_item")), "msg_id", "left").withColumn("unknown_item", F.coalesce("unknown_item", F.lit(False)))
    rows = sticky_language(flagged, F.when(first_guard(flagged, early) == "lang_switch", requested), detected, order)
    rows = rows.withColumn("route", first_guard(rows, [g[0] for g in ROUTES]))
    none = rows.select("msg_id").limit(0)
    matches = none.selectExpr("msg_id", "'' as faq_source", "'' as faq_id", "cast(0 as double) as faq_score", "false as escalate") if matches is None else matches
    rows = rows.join(matches.select("msg_id", F.struct("faq_source", "faq_id", "faq_score", "escalate").alias("f")), "msg_id", "left")
    shops = flagged.select("slug").limit(0) if context is None else context
    rows = rows.join(sized(shops.select("slug", F.lit(True).alias("_c")).distinct()), "slug", "left")
    rows = rows.withColumn("open", F.col("route").isNull()).withColumn("route", F.coalesce("route", F.when(F.col("f").isNotNull(), "match").when(F.col("_c"), "chunk").otherwise("free"))).withColumn("k", F.try_element_at(_constants(), F.col("route")))
    lang = F.when(F.col("route") == "garbage", "english").otherwise(F.col("lang"))
    own = F.when(F.col("route") == "match", "faq").when(F.col("route") == "chunk", "rag").otherwise("ollama")
    return rows.select(
        "msg_id", "slug", "session_id", "message", lang.alias("lang"), "route", F.coalesce("k.source", own).alias("source"), F.coalesce("k.bypass", F.lit("")).alias("bypass"), F.coalesce(F.nullif("k.sentiment", F.lit("")), "detected.sentiment").alias("sentiment"),
        F.coalesce("k.confidence", "detected.confidence").alias("confidence"), F.when(F.col("open") | (F.col("route") == "escalate"), F.col("detected.sent_source")).otherwise(F.col("k.sent_source")).alias("sent_source"),
        F.when(F.col("route") == "location", lang).when(F.col("route") == "chunk", "shop_context").otherwise(F.coalesce("k.faq_source", F.when(F.col("open"), F.col("f.faq_source")))).alias("faq_source"),
        F.coalesce("k.faq_id", F.when(F.col("open"), F.col("f.faq_id"))).alias("faq_id"), F.coalesce("k.faq_score", F.when(F.col("open"), F.col("f.faq_score"))).alias("faq_score"),
        (F.col("route") == "escalate").alias("_e"), F.coalesce(F.col("open") & F.col("f.escalate"), F.lit(False)).alias("_f"), F.coalesce(F.col("urgent") & (F.col("route") == "escalate"), F.lit(False)).alias("urgent"),
    ).withColumn("escalate", F.col("_e") | F.col("_f")).drop("_e", "_f")


def sticky_language(messages: DataFrame, preference: Column, detected: Column, order: str = "turn", long: int = 4, cell: Column | None = None) -> DataFrame:
    """Language in force: the last switch asked for earlier in the session, else the detected one; a Manglish preference yields to a longer English message.

    Messages without a session share their shop's language, as ``held_as_of`` finds it by ``cell``.
    """
    before = Window.partitionBy("slug", "session_id").orderBy(order, "msg_id").rowsBetween(Window.unboundedPreceding, -1)
    own = messages.where("session_id is not null")
    shared = held_as_of(messages.where("session_id is null"), ["slug"], order, preference, cell)
    rows = own.withColumn("held", F.last(preference, True).over(before)).unionByName(shared)
    yields = (F.col("held") == "manglish") & (detected == "english") & (F.size(x.split_words(F.col("message"))) > long)
    return rows.withColumn("lang", F.coalesce(preference, F.when(~F.coalesce(yields, F.lit(False)), F.col("held")), detected))


def held_as_of(rows: DataFrame, keys: list[str], order: str, preference: Column, cell: Column | None = None) -> DataFrame:
    """Rows with ``held``, the last ``preference`` before each by (``order``, msg_id) within ``keys``, for keys that hold any share of the rows.

    ``cell`` cuts a key into stretches of ``order`` and must not fall as that rises (default: a thousand of a number, an hour of a
    time). Of each stretch the last switch is aggregated; a window over a key's stretches gives the switch in force as
    each begins, valid until the next; rows join it by key and stretch, and only within a stretch a window looks back. So a
    key's rows spread over its stretches, and no task sorts a key.
    """
    time = dict(rows.dtypes)[order] in ("timestamp", "timestamp_ntz", "date")
    cell = (F.date_trunc("hour", order) if time else F.floor(F.col(order) / 1000)) if cell is None else cell
    key = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys], *[F.col(k).isNull() for k in keys])
    placed = rows.withColumns({"_key": key, "_cell": cell.cast("string"), "_switch": preference})
    switches = placed.groupBy("_key", "_cell").agg(F.max_by("_switch", F.when(F.col("_switch").isNotNull(), F.struct(order, "msg_id"))).alias("_last"), F.min(order).alias("_from"))
    in_force = F.last("_last", True).over(Window.partitionBy("_key").orderBy(F.asc_nulls_first("_from")).rowsBetween(Window.unboundedPreceding, -1))
    valid = switches.select("_key", F.coalesce("_cell", F.lit("")).alias("_cell"), in_force.alias("_carried"))
    inner = Window.partitionBy("_key", "_cell").orderBy(F.asc_nulls_first(order), "msg_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.withColumn("_cell", F.coalesce("_cell", F.lit(""))).join(valid, ["_key", "_cell"])
    return joined.withColumn("held", F.coalesce(F.last("_switch", True).over(inner), "_carried")).select(*rows.columns, "held")


#: Letters from rare to common: any order serves, a good one has small keys.
RARE_LETTERS = "qxzjkvwbpygfmcduhlsrniotae"
_HALF = len(RARE_LETTERS) // 2


def near_spellings(words: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """Pairs (slug, word, term) of one first letter that share enough letters for a ratio of ``least``: (slug, word) against (slug, term).

    Texts of n and m letters at a ratio of r have a common subsequence of r / 200 * (n + m) letters, where m is at least
    n * r / (200 - r), as the shorter text bounds the subsequence. Two words that share k letters share one of the n - k + 1 that
    come first of either, in an order from rare letters to common ones, so they meet on those only. Of those that meet, lengths and
    the letters in common, counted from two packed numbers, rule out all that cannot reach the ratio.
    """

    def keyed(rows: DataFrame, word: str) -> DataFrame:
        n = F.length(word)
        count = lambda c: n - F.length(F.replace(F.col(word), F.lit(c), F.lit("")))
        pack = lambda letters: sum((F.shiftleft(F.least(count(c), F.lit(15)).cast("long"), 4 * k) for k, c in enumerate(letters)), F.lit(0).cast("long"))
        need = F.ceil(least / 200 * (n + F.ceil(n * least / (200 - least) - 1e-9)) - 1e-9).cast("int")
        rare = F.expr(f"array_sort(transform(split({word}, ''), v -> if(v between 'a' and 'z', char(96 + instr('{RARE_LETTERS}', v)), '`')))")
        held = rows.withColumns({f"{word}_lo": pack(RARE_LETTERS[:_HALF]), f"{word}_hi": pack(RARE_LETTERS[_HALF:]), "_need": need, "_rare": rare})
        few = F.slice("_rare", F.lit(1), F.greatest(n - F.col("_need") + 1, F.lit(1)))
        # the k-th of a letter among the first is the k-th of the word, as they are sorted; a letter's first is key enough
        return held.select("slug", word, f"{word}_lo", f"{word}_hi", F.substring(word, 1, 1).alias("first"), F.explode(F.array_distinct(few)).alias("letter"))

    met = keyed(words, "word").join(keyed(terms, "term"), ["slug", "first", "letter"])
    n, m = F.length("word"), F.length("term")
    digit = lambda c, k: F.shiftright(F.col(c), 4 * k).bitwiseAND(F.lit(15))
    alike = sum((F.least(digit(f"word_{h}", k), digit(f"term_{h}", k)) for h, size in (("lo", _HALF), ("hi", len(RARE_LETTERS) - _HALF)) for k in range(size)), F.lit(0).cast("long"))
    enough = (n > 15) | (m > 15) | (200.0 * alike >= least * (n + m))
    return met.where(200.0 * F.least(n, m) >= least * (n + m)).where(enough).select("slug", "word", "term").distinct()


def unknown_items(asks: DataFrame, vocabulary: DataFrame, neutral: list[str], variant=None, least: float = 65.0, item_ask: str | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Asks (msg_id, slug, message) none of whose subject words the shop knows: (msg_id, unknown).

    ``item_ask``: the pattern that makes a message an ask for an item; without it all are. Words of umbrella ``synonyms`` are
    added. Subject words have three ASCII letters or digits or more and are not ``neutral``; a message without any is left out. A word is
    known if it lies anywhere inside a term, if it holds a run of four letters or more of a term and begins with its first
    four, or if ``variant`` calls it a spelling variant of one. Distinct (slug, word) pairs meet the vocabulary (slug, term) on
    any three successive letters, on the first four letters, and, for spellings, on the rarest letters of each (``near_spellings``).
    No pair without a common key is made.
    """
    text = F.lower("message") if synonyms is None else F.lower(x.append_umbrella(F.col("message"), synonyms))
    subject = F.filter(x.split_words(F.regexp_replace(text, "[^a-z0-9\\s]", " ")), lambda w: (F.length(w) >= 3) & ~F.array_contains(x.lit_array(neutral), w) & (~w.rlike(f"^(?:{item_ask})$") if item_ask else F.lit(True)))
    asks = asks.where(F.lower("message").rlike(rf"(^|[^\p{{L}}\p{{N}}_])(?:{item_ask})($|[^\p{{L}}\p{{N}}_])")) if item_ask else asks
    tokens = asks.select("msg_id", "slug", F.explode(F.array_distinct(subject)).alias("word"))
    tokens = scratch.table(tokens, "unknown-tokens")
    words = tokens.select("slug", "word").distinct()
    v = vocabulary.select("slug", F.explode(F.regexp_extract_all(F.lower("term"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term")).distinct()
    grams = v.withColumn("k", F.explode(F.expr("array_distinct(transform(sequence(1, greatest(length(term) - 2, 1)), i -> substring(term, i, 3)))")))
    inside = words.join(grams, (words.slug == grams.slug) & (F.substring("word", 1, 3) == grams.k) & F.col("term").contains(F.col("word")), "left_semi")
    letters = v.select("slug", F.explode(F.regexp_extract_all("term", F.lit("([a-z]{4,})"), F.lit(1))).alias("term")).distinct()
    stems = letters.withColumn("k", F.substring("term", 1, 4))
    stemmed = words.join(stems, (words.slug == stems.slug) & (F.substring("word", 1, 4) == stems.k) & F.col("word").contains(F.col("term")), "left_semi")
    known = scratch.table(inside.unionByName(stemmed).distinct(), "unknown-known")
    if variant is not None:
        rest = words.join(known, ["slug", "word"], "left_anti").where("length(word) >= 5")
        near = near_spellings(scratch.table(rest, "unknown-words"), scratch.table(letters.where("length(term) >= 5"), "unknown-terms"), least)
        known = known.unionByName(near.withColumn("same", variant(F.col("word"), F.col("term"), least)).where("same").select("slug", "word"))
    known = known.distinct().withColumn("known", F.lit(True))
    return tokens.join(known, ["slug", "word"], "left").groupBy("msg_id").agg((~F.bool_or(F.coalesce("known", F.lit(False)))).alias("unknown"))
