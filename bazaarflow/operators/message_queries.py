"""Registered queries of classifiers, guards and the router. Test vocabularies hit the invented prose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from ..functions import text as x
from ..plans import tables as t
from ..plans.sizing import sized
from . import messages as m

SIGNALS, PARTICLES, SWITCH = ["und", "der", "que", "ti"], ["heit", "anno"], ["zu"]
LEXICON = {"sarcastic": ["nthe"], "urgent": ["shth"], "negative": ["eaha", "schung"], "positive": ["bleth", "tionre"]}
ITEM_INTENTS = {"offer": ["ouly"], "items": ["eaha", "thonst"], "price": ["enheit", "ndin"]}
INTENTS = {"price": ["eaer"], "delivery": ["thonst", "enheit"], "return": ["ntsh"], "payment": ["ouly"], "hours": ["ingin"]}
PATTERNS = {
    "greeting": "^(the|in|of) ", "compliment": "^(thon|ereston)", "confirmation": "^(and|er)", "small_talk": "^(ing|ti)", "lang_switch": "(anou|enver)", "branch": "(bleed|lyth)", "location": "(thoring|sther)",
    "order_status": "(ndof|eron) ", "booking": "(hare|tied)", "offer": "(thea|ßen)",
}
BROAD = ["onthe of", "der ung", "hawh"]
TOPICS = {"fraud": "(shen|ichsch)", "refund": "(ndin|oued)", "delay": "(thin|keit)"}
STARTERS, STEMS = ["the", "and", "in"], ["th", "er"]
_M = t.MESSAGES
_W = "regexp_extract_all(lower(message), '[\\p{L}\\p{N}_]+')"
_NOTES = "(select msg_id, message, " + _W + " as w from " + _M + ")"


def _list(v) -> str:
    return "[" + ", ".join(f"'{i}'" for i in v) + "]::varchar[]"


def _any(phrases, c: str = "lower(message)") -> str:
    return "(" + " or ".join(f"contains({c}, '{p}')" for p in phrases) + ")"


def _first(table, default: str) -> str:
    return "case " + " ".join(f"when {_any(v)} then '{k}'" for k, v in table.items()) + f" else {default} end"


def _simple(columns):
    """Columns are made when the query is asked for: they need a session."""
    return lambda s, d: t.messages(s, d).select("msg_id", *[c.alias(n) for n, c in columns().items()])


BLOCKS = {"returns": ["rere", "retour"], "size": ["tionth"]}
FOREIGN = {"bakery": ["wast", "pferd"], "salon": ["thing"]}
BARRED = ["of", "und"]
_ACTIVE = "case when shop_pos % 5 < 3 then {0}('fraud', 'delay') end as active"
_SETTINGS = "case shop_pos % 3 when 0 then 'bakery' when 1 then 'general' else 'salon' end as shop_type, case when shop_pos % 2 = 0 then {0}('hareti') end as off_domain, case when shop_pos % 3 = 0 then {0}('returns', 'leur') end as blocked, {1}, case when shop_pos % 4 = 0 then 'SAVE10' end as offer_code"


def config(s, d):
    """Guard settings of all shops."""
    columns = ["case shop_pos % 3 when 0 then 'bakery' when 1 then 'general' else 'salon' end as shop_type", "case when shop_pos % 2 = 0 then array('hareti') end as off_domain", "case when shop_pos % 3 = 0 then array('returns', 'leur') end as blocked", _ACTIVE.format("array"), "case when shop_pos % 4 = 0 then 'SAVE10' end as offer_code"]
    return t.shops(s, d).selectExpr("slug", *columns, "shop_name", "city")


ASK, NEUTRAL = "the|und|que|les", ["the", "and", "und", "que", "les", "des", "with", "that"]
_REQUEST = "case when contains(lower(message), 'anou') then 'english' else 'manglish' end"


def detected():
    return F.when(m.is_manglish(F.col("message"), SIGNALS, PARTICLES, SWITCH), "manglish").otherwise("english")


def vocabulary(s, d):
    """Words that a shop knows: its items' names and categories, and its answers."""
    words = t.items(s, d).selectExpr("slug", "concat(name, ' ', category) as term").unionByName(t.faqs(s, d).selectExpr("slug", "a as term"))
    return words.select("slug", F.explode(x.split_words(F.lower("term"))).alias("term")).distinct()


def unknown(s, d, variant=ratio.spelling_variant, messages=None):
    return m.unknown_items(t.messages(s, d) if messages is None else messages, vocabulary(s, d), NEUTRAL, variant, item_ask=ASK, synonyms={"tion": ["nation"]})


def routed(s, d, matches=None, context=None, variant=None, messages=None):
    messages = t.messages(s, d) if messages is None else messages
    flagged = m.flags(messages, config(s, d).drop("shop_name", "city"), PATTERNS, LEXICON, BROAD, TOPICS, FOREIGN, BLOCKS, BARRED)
    return m.route_messages(messages, flagged, detected(), F.expr(_REQUEST), unknown(s, d, variant, messages), matches, context)


def rte_pipeline(s, d):
    """Every message through all guards; F1 matches that pass the gate, then chunks, answer the rest."""
    from . import match

    found = match._found(s, d).where(match.passes_gate(F.col("score"), F.lit("f1"), F.col("lang"), F.col("message"), F.col("faq_text")))
    found = found.selectExpr("msg_id", "concat(lang, '_f1') as faq_source", "concat('faq_', faq_pos) as faq_id", "score as faq_score", "faq_pos % 9 = 0 as escalate")
    return routed(s, d, found, t.faqs(s, d).where("slug <> 'shop-3'")).drop("message")


#: Reply templates by route and language; a route with several takes one by the message's number.
REPLIES = {
    "greeting": {"english": ["Welcome to {shop_name} in {city}!", "Hello from {shop_name}!"], "manglish": ["Namaskaram, {shop_name} ({city})!", "Hai, {shop_name}!"]}, "garbage": {"english": ["Please say that again, or call {phone}."], "manglish": ["Manassilayilla, {phone} vilikku."]},
    "compliment": {"english": ["Thank you!", "Glad to hear it."], "manglish": ["Nanni!", "Santhosham!"]}, "confirmation": {"english": ["Fine."], "manglish": ["Sheri."]}, "broad": {"english": ["We offer {categories}."], "manglish": ["{categories} okke und."]},
    "lang_switch": {"english": ["English it is."], "manglish": ["Manglish aakkam."]}, "branch": {"english": ["There is one shop, in {city}."], "manglish": ["Oru shop, {city}."]}, "location": {"english": ["Find {shop_name} in {city}."], "manglish": ["{shop_name} {city} il aanu."]},
    "off_domain": {"english": ["{shop_name} does not sell that."], "manglish": ["Athu {shop_name} il illa."]}, "order_status": {"english": ["Ask {phone} about orders."], "manglish": ["Order ariyan {phone}."]}, "unknown_item": {"english": ["We do not have that at {shop_name}."], "manglish": ["{shop_name} il athu illa."]},
    "blocked": {"english": ["That does not apply here."], "manglish": ["Athu ivide alla."]}, "booking": {"english": ["Book by {phone}."], "manglish": ["{phone} vilichu book cheyyu."]}, "escalate": {"english": ["A person from {shop_name} will call you."], "manglish": ["{shop_name} team vilikkum."]},
    "offer": {"english": ["Use {offer_code} at {shop_name}."], "manglish": ["{offer_code} use cheyyu."]},
}


def replies(rows: DataFrame, templates: dict, values: F.Column, fallbacks: dict[str, str]) -> DataFrame:
    """Reply texts of routed messages from templates by route and language, with the shop's values; a number picks among several."""
    table = F.create_map(*[v for r, by in templates.items() for lang, texts in by.items() for v in (F.lit(f"{r}|{lang}"), x.lit_array(texts))])
    options = F.try_element_at(table, F.concat_ws("|", "route", "lang"))
    text = F.get(options, F.pmod(F.col("msg_id"), F.size(options)).cast("int"))
    return rows.withColumn("template", text).where("template is not null").withColumn("reply", x.fill_placeholders(F.col("template"), values, fallbacks)).drop("template")


def rte_reply(s, d):
    shop = config(s, d).selectExpr("slug as s", "shop_name", "city", "offer_code", "if(length(shop_name) % 2 = 0, 'rings, rods', null) as categories")
    rows = routed(s, d).join(sized(shop), F.col("slug") == F.col("s"), "left")
    values = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("shop_name", "city", "offer_code", "categories")]))
    return replies(rows, REPLIES, values, {"categories": "many things", "shop_name": "our shop"}).select("msg_id", "route", "lang", "reply")


def cls_model_sentiment(s, d):
    rows = t.read(s, d, "labels").select("doc_id", F.explode(F.map_from_arrays(x.lit_array(["angry", "happy", "calm"]), F.array(F.col("toxic") * 0.9, F.col("quality") * 0.6, F.lit(0.4)))).alias("label", "score"))
    return m.model_sentiment(rows, "doc_id", {"angry": "negative", "happy": "positive"})


def cls_item_ask(s, d):
    return t.messages(s, d).select("msg_id", m.item_ask(F.col("message"), ["the", "und"], ["of"], "(thing|heit)").alias("a")).select("msg_id", "a.*")


def _listed(c):
    return lambda s, d: t.messages(s, d).join(sized(config(s, d)), "slug", "left").select("msg_id", *[v.alias(k) for k, v in c().items()])


def win_sticky_lang(s, d):
    pref = F.when(F.lower(F.col("message")).rlike("anou"), "english").when(F.lower(F.col("message")).rlike("enver|thoring"), "manglish")
    found = F.when(m.has_signal(F.col("message"), ["und", "of"]), "manglish").otherwise("english")
    return m.sticky_language(t.messages(s, d), pref, found).select("msg_id", "held", "lang")


def win_sticky_shop(s, d):
    """The language of shops whose messages have no session, in the order of the messages' numbers."""
    pref = F.when(F.lower(F.col("message")).rlike("anou"), "english").when(F.lower(F.col("message")).rlike("enver|thoring"), "manglish")
    rows = t.messages(s, d).withColumn("session_id", F.lit(None).cast("bigint"))
    return m.sticky_language(rows, pref, F.lit("english"), "msg_id", cell=F.floor(F.col("msg_id") / 100_000)).select("msg_id", "held", "lang")


def _vote(s, d):
    """Full questions by rules, with the vote of two anchors of each kind over the vectors of the documents."""
    e = t.read(s, d, "embeddings").join(t.read(s, d, "documents").selectExpr("doc_id as vec_id", "text"), "vec_id")
    unit = lambda k: [1.0 if i == k else 0.0 for i in range(64)]
    vote = m.anchor_vote(F.col("embedding"), [unit(0), unit(1)], [unit(2), unit(3)])
    return e.select("vec_id", vote.alias("vote"), m.full_question(F.col("text"), STARTERS, ["of", "und"], STEMS, ["el"], ["de", "ing"], "(lent|hast)", vote).alias("full"))


def checked(messages: DataFrame, least: int = 1, most: int = 1000) -> DataFrame:
    """Messages trimmed, with a reason where they are empty or too long."""
    text = F.trim("message")
    reason = F.when(F.length(text) < least, "empty").when(F.length(text) > most, "too long")
    return messages.select("msg_id", text.alias("message"), F.when(text.isNull(), "empty").otherwise(reason).alias("reason"))


def _turns(s, d):
    """The sentences of all turns: short texts."""
    return t.read(s, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\.\s")).alias("message")).distinct()


QUERIES = {
    "cls_manglish": _simple(lambda: dict(manglish=m.is_manglish(F.col("message"), SIGNALS, PARTICLES, SWITCH))),
    "cls_manglish_lite": _simple(lambda: dict(matching=F.arrays_overlap(x.split_words(F.lower("message")), x.lit_array(SIGNALS)), parsing=m.has_signal(F.col("message"), PARTICLES + SIGNALS))),
    "cls_lexicon_sentiment": lambda s, d: t.messages(s, d).select("msg_id", m.lexicon_sentiment(F.col("message"), LEXICON).alias("x")).select("msg_id", "x.*"),
    "cls_model_sentiment": cls_model_sentiment,
    "cls_intent": _simple(lambda: dict(intent=m.intent(F.col("message"), INTENTS), item_intent=x.first_of(F.col("message"), ITEM_INTENTS))),
    "cls_broad": _simple(lambda: dict(broad=m.is_broad(F.col("message"), "(onthe|heit) (of|und)", BROAD))),
    "cls_item_ask": cls_item_ask,
    "cls_full_question": _vote,
    "grd_garbage": lambda s, d: t.read(s, d, "documents").select("doc_id", m.is_garbage(F.col("text")).alias("garbage"), m.is_garbage(F.element_at(F.split("text", " "), -1)).alias("last_word")),
    "grd_social": lambda s, d: _turns(s, d).select("conv_id", "turn", *[(m.is_compliment(F.col("message"), PATTERNS[g], BARRED) if g == "compliment" else F.lower("message").rlike(PATTERNS[g])).alias(g) for g in ("greeting", "compliment", "confirmation", "small_talk", "lang_switch")]),
    "grd_branch": _simple(lambda: dict(branch=F.lower(F.col("message")).rlike(PATTERNS["branch"]), city=m.asked_city(F.col("message"), r"(?:in|of) (\w{4,})", ["that", "this"]))),
    "grd_location": _simple(lambda: dict(location=F.lower(F.col("message")).rlike(PATTERNS["location"]))),
    "grd_booking": _simple(lambda: dict(booking=F.lower(F.col("message")).rlike(PATTERNS["booking"]))),
    "grd_offer": _simple(lambda: dict(offer=F.lower(F.col("message")).rlike(PATTERNS["offer"]))),
    "grd_order_status": _simple(lambda: dict(order_status=F.lower(F.col("message")).rlike(PATTERNS["order_status"]))),
    "grd_off_domain": _listed(lambda: dict(off_domain=m.contains_listed(F.col("message"), m.foreign_words(F.col("shop_type"), F.col("off_domain"), FOREIGN)))),
    "grd_blocked": _listed(lambda: dict(blocked=m.contains_listed(F.col("message"), m.keywords_of(F.col("blocked"), BLOCKS)))),
    "grd_escalate": lambda s, d: m.flags(t.messages(s, d), config(s, d).drop("shop_name", "city"), PATTERNS, LEXICON, BROAD, TOPICS).select("msg_id", "escalate", F.coalesce("urgent", F.lit(False)).alias("urgent")),
    "grd_unknown_item": lambda s, d: unknown(s, d),
    "grd_unknown_word": lambda s, d: unknown(s, d, None),
    "rte_pipeline": rte_pipeline,
    "rte_reply": rte_reply,
    "win_sticky_lang": win_sticky_lang,
    "win_sticky_shop": win_sticky_shop,
    "val_message": lambda s, d: checked(t.read(s, d, "documents").selectExpr("doc_id as msg_id", "text as message")).select("msg_id", F.length("message").alias("n"), "reason"),
}

def _strings(v) -> str:
    return "[" + ", ".join(f"'{i}'" for i in v) + "]"


_CFG = f"(select slug, {_SETTINGS.format('list_value', _ACTIVE.format('list_value'))}, shop_name, city from {t.SHOPS})"
_TOPIC = " or ".join(f"(regexp_matches(lower(message), '{p}') and list_contains(active, '{n}'))" for n, p in TOPICS.items())
_URGENT = " or ".join(f"(regexp_matches(lower(message), '{p}') and list_contains(active, '{n}'))" for n, p in TOPICS.items() if n in m.URGENT_TOPICS)
_GARBAGE = r"len(list_filter(regexp_split_to_array(regexp_replace({c}, '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2)) = 0"
_SPACED = "list_filter(regexp_split_to_array(trim(lower(message)), '\\s+'), lambda w: w <> '')"


def _m(g: str) -> str:
    return f"regexp_matches(lower(message), '{PATTERNS[g]}')"


_COMPLIMENT = f"({_m('compliment')} and len({_SPACED}) <= 6 and not list_has_any({_SPACED}, {_strings(BARRED)}) and not {_any(m.NOR_WITHIN)} and not ends_with(rtrim(message, '!., '), '?'))"
_FOREIGN = "(case shop_type " + " ".join(f"when '{k}' then list_concat({_strings(v)}, coalesce(off_domain, []))" for k, v in FOREIGN.items()) + " when 'general' then [] else coalesce(off_domain, []) end)"
_BLOCKED = "flatten(list_transform(coalesce(blocked, []), lambda k: case k " + " ".join(f"when '{k}' then {_strings(v)}" for k, v in BLOCKS.items()) + " else [k] end))"
_HOLDS = "len(list_filter({0}, lambda p: contains(lower(message), p))) > 0"
_MANGLISH = f"(list_has_any(w, {_list(SIGNALS + PARTICLES + SWITCH)}) or len(list_filter(w, lambda v: length(v) > 3 and ends_with(v, 'o') and list_contains({_list(SIGNALS)}, left(v, length(v) - 1)))) > 0)"
_SUBJECT = f"list_filter(regexp_split_to_array(trim(regexp_replace(lower(case when contains(lower(message), 'tion') then message || ' nation' else message end), '[^a-z0-9\\s]', ' ', 'g')), '\\s+'), lambda v: length(v) >= 3 and not list_contains({_strings(NEUTRAL)}, v) and not regexp_matches(v, '^(?:{ASK})$'))"
_VOCABULARY = f"(select distinct slug, unnest(regexp_extract_all(lower(term), '[a-z0-9]+')) as term from (select slug, name || ' ' || category as term from {t.ITEMS} union all select slug, a from {t.FAQS}))"
_UNKNOWN = f"""(with w as (select msg_id, slug, unnest({_SUBJECT}) as word from {_M} where regexp_matches(lower(message), '(^|[^\\p{{L}}\\p{{N}}_])(?:{ASK})($|[^\\p{{L}}\\p{{N}}_])')), u as (select distinct slug, word from w), v as (select * from {_VOCABULARY}), l as (select distinct slug, unnest(regexp_extract_all(term, '[a-z]{{4,}}')) as term from v),
  k as (select slug, word from u semi join v on u.slug = v.slug and contains(v.term, u.word) union select slug, word from u semi join l on u.slug = l.slug and starts_with(u.word, left(l.term, 4)) and contains(u.word, l.term))
  select msg_id, bool_and(k.word is null) as unknown from w left join k using (slug, word) group by msg_id)"""
_FLAG = {g[0]: _m(g[0]) if g[0] in PATTERNS else "" for g in m.ROUTES} | {
    "garbage": _GARBAGE.format(c="message"), "compliment": _COMPLIMENT, "broad": _any(BROAD), "off_domain": _HOLDS.format(_FOREIGN), "blocked": _HOLDS.format(_BLOCKED), "unknown_item": "coalesce(unknown, false)",
    "escalate": f"coalesce({_TOPIC}, false)", "offer": f"({_m('offer')} and offer_code is not null)",
}
_EARLY = [g[0] for g in m.ROUTES[:7]]


def _guard(names) -> str:
    return "case " + " ".join(f"when {_FLAG[g]} then '{g}'" for g in names) + " end"


_ROUTED = f"""(select *, coalesce(guard, 'open') as route, case when guard = 'garbage' then 'english' else coalesce(pref, case when not coalesce(held = 'manglish' and det = 'english' and n > 4, false) then held end, det) end as lang from (
  select *, last_value(pref ignore nulls) over (partition by slug, session_id order by turn, msg_id rows between unbounded preceding and 1 preceding) as held from (
  select *, case when {_guard(_EARLY)} = 'lang_switch' then {_REQUEST} end as pref, case when {_MANGLISH} then 'manglish' else 'english' end as det, len({_SPACED}) as n, {_guard([g[0] for g in m.ROUTES])} as guard
  from (select *, {_W} as w from {_M}) left join {_CFG} using (slug) left join {_UNKNOWN} using (msg_id))))"""


def _v(n: int, kind: str) -> str:
    lit = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"cast(case route {' '.join(f'when {chr(39)}{g[0]}{chr(39)} then {lit(g[n])}' for g in m.ROUTES)} end as {kind})"


def _reply() -> str:
    """Replies with the shop's values, by route, language and number."""
    one = lambda text: "replace(replace(replace(replace(replace('" + text + "', '{shop_name}', coalesce(shop_name, 'our shop')), '{city}', coalesce(city, '[city]')), '{offer_code}', coalesce(offer_code, '[offer_code]')), '{categories}', case when length(shop_name) % 2 = 0 then 'rings, rods' else 'many things' end), '{phone}', '[phone]')"
    return "case " + " ".join(f"when route = '{r}' and lang = '{lang}' and msg_id % {len(texts)} = {k} then {one(text)}" for r, by in REPLIES.items() for lang, texts in by.items() for k, text in enumerate(texts)) + " end"


_SENT, _HIT = _first(LEXICON, "'neutral'"), _first(LEXICON, "null")
_PREF = "case when regexp_matches(lower(message), 'anou') then 'english' when regexp_matches(lower(message), 'enver|thoring') then 'manglish' end"
SQL = {
    "cls_manglish": f"select msg_id, list_has_any(w, {_list(SIGNALS + PARTICLES + SWITCH)}) or len(list_filter(w, lambda v: length(v) > 3 and ends_with(v, 'o') and list_contains({_list(SIGNALS)}, left(v, length(v) - 1)))) > 0 as manglish from {_NOTES}",
    "cls_manglish_lite": f"select msg_id, list_has_any({_SPACED}, {_list(SIGNALS)}) as matching, list_has_any(w, {_list(PARTICLES + SIGNALS)}) as parsing from {_NOTES}",
    "cls_lexicon_sentiment": f"select msg_id, {_SENT} as sentiment, cast(case when {_HIT} is null then 0.5 else 0.93 end as double) as confidence, case when {_HIT} is null then 'default' else 'lexicon' end as sent_source from {_M}",
    "cls_model_sentiment": "select doc_id, case when toxic = 1 then 'negative' when quality = 1 then 'positive' else 'neutral' end as sentiment, cast(case when toxic = 1 then 0.9 when quality = 1 then 0.6 else 0.4 end as double) as confidence from labels",
    "cls_intent": f"select msg_id, {_first(INTENTS, chr(39) + 'general' + chr(39))} as intent, {_first(ITEM_INTENTS, 'null')} as item_intent from {_M}",
    "cls_broad": f"select msg_id, regexp_matches(lower(message), '(onthe|heit) (of|und)') or {_any(BROAD)} as broad from {_M}",
    "cls_item_ask": f"select msg_id, list_has_any(w, ['the', 'und']) as availability, list_has_any(w, ['of']) as price, regexp_matches(lower(message), '(thing|heit)') as service from {_NOTES}",
    "cls_full_question": f"""select vec_id, vote, (coalesce(list_contains({_list(STARTERS)}, w[1]), false) and len(w) >= 3) or (len(w) >= 3 and list_has_any(w, ['of', 'und']) and (list_has_any(w, ['el']) or len(list_filter(w, lambda v: starts_with(v, 'th') or starts_with(v, 'er'))) > 0))
        or (list_has_any(w, ['de', 'ing']) and (regexp_matches(lower(text), '(lent|hast)') or vote)) as full from (select *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as w, greatest(cast(embedding[1] as double), cast(embedding[2] as double)) > greatest(cast(embedding[3] as double), cast(embedding[4] as double)) + 0.05 as vote from embeddings join documents on vec_id = doc_id)""",
    "grd_garbage": f"select doc_id, {_GARBAGE.format(c='text')} as garbage, {_GARBAGE.format(c='list_last(string_split(text, chr(32)))')} as last_word from documents",
    "grd_social": f"select conv_id, turn, {', '.join(f'{_FLAG[g]} as {g}' for g in ('greeting', 'compliment', 'confirmation', 'small_talk', 'lang_switch'))} from (select distinct conv_id, turn, unnest(regexp_split_to_array(text, '\\.\\s')) as message from conversations)",
    "grd_branch": rf"select msg_id, {_m('branch')} as branch, case when c not in ('', 'that', 'this') then c end as city from (select *, regexp_extract(lower(message), '(?:in|of) (\w{{4,}})', 1) as c from {_M})",
    "grd_location": f"select msg_id, {_m('location')} as location from {_M}",
    "grd_booking": f"select msg_id, {_m('booking')} as booking from {_M}",
    "grd_offer": f"select msg_id, {_m('offer')} as offer from {_M}",
    "grd_order_status": f"select msg_id, {_m('order_status')} as order_status from {_M}",
    "grd_off_domain": f"select msg_id, {_FLAG['off_domain']} as off_domain from {_M} left join {_CFG} using (slug)",
    "grd_blocked": f"select msg_id, {_FLAG['blocked']} as blocked from {_M} left join {_CFG} using (slug)",
    "grd_escalate": f"select msg_id, {_FLAG['escalate']} as escalate, coalesce({_URGENT}, false) as urgent from {_M} left join {_CFG} using (slug)",
    "grd_unknown_word": f"select msg_id, unknown from {_UNKNOWN}",
    "rte_reply": f"select msg_id, route, lang, {_reply()} as reply from {_ROUTED} where route in {tuple(REPLIES)}",
    "win_sticky_shop": f"""select msg_id, held, coalesce(pref, case when not (held = 'manglish' and len(list_filter(regexp_split_to_array(trim(message), '\\s+'), lambda v: v <> '')) > 4) then held end, 'english') as lang from (
        select *, last_value(pref ignore nulls) over (partition by slug order by msg_id rows between unbounded preceding and 1 preceding) as held from (select *, {_PREF} as pref from {_M}))""",
    "win_sticky_lang": rf"""select msg_id, held, coalesce(pref, case when not coalesce(held = 'manglish' and det = 'english' and n > 4, false) then held end, det) as lang from (
        select *, last_value(pref ignore nulls) over (partition by slug, session_id order by turn, msg_id rows between unbounded preceding and 1 preceding) as held from (
        select *, {_PREF} as pref, case when list_has_any({_W}, ['und', 'of']) then 'manglish' else 'english' end as det, len(list_filter(regexp_split_to_array(trim(message), '\s+'), lambda w: w <> '')) as n from {_M}))""",
    "val_message": "select doc_id as msg_id, cast(length(trim(text)) as int) as n, case when length(trim(text)) < 1 then 'empty' when length(trim(text)) > 1000 then 'too long' end as reason from documents",
}


def _pipeline_sql() -> str:
    from . import match

    shares = f"(len({match._content('message')}) = 0 or list_has_any({match._content('message')}, {match._WORDS.format(chr(113) + ' || chr(32) || ' + chr(97))}))"
    found = f"""(select msg_id, faq_lang || '_f1' as f_source, 'faq_' || faq_pos as f_id, score as f_score, faq_pos % 9 = 0 as f_escalate from (select *, {match._LANG} as faq_lang from {match._F1} join {_M} using (msg_id) join (select faq_pos, q, a from {t.PHRASED}) using (faq_pos))
        where score >= case when faq_lang = 'manglish' then {match.GATE_MANGLISH} else {match.GATE_ENGLISH} end and (score >= {match.SURE} or {shares}))"""
    return f"""with r as (select * exclude (route), case when route <> 'open' then route when f_id is not null then 'match' when slug in (select slug from {t.FAQS} where slug <> 'shop-3') then 'chunk' else 'free' end as route, route = 'open' as was_open from {_ROUTED} left join {found} using (msg_id))
        select msg_id, slug, session_id, lang, route, coalesce({_v(1, 'varchar')}, case route when 'match' then 'faq' when 'chunk' then 'rag' else 'ollama' end) as source, coalesce({_v(2, 'varchar')}, '') as bypass, coalesce(nullif({_v(4, 'varchar')}, ''), {_SENT}) as sentiment,
        coalesce({_v(5, 'double')}, case when {_HIT} is null then 0.5 else 0.93 end) as confidence, case when was_open or route = 'escalate' then case when {_HIT} is null then 'default' else 'lexicon' end else {_v(3, 'varchar')} end as sent_source,
        case when route = 'location' then lang when route = 'chunk' then 'shop_context' else coalesce({_v(6, 'varchar')}, case when was_open then f_source end) end as faq_source, coalesce({_v(7, 'varchar')}, case when was_open then f_id end) as faq_id,
        coalesce({_v(8, 'double')}, case when was_open then f_score end) as faq_score, coalesce(route = 'escalate' and ({_URGENT}), false) as urgent, route = 'escalate' or coalesce(was_open and f_escalate, false) as escalate from r"""


SQL["rte_pipeline"] = _pipeline_sql()


def _streamed_sql() -> str:
    """Messages by their own columns alone."""
    guards = [g[0] for g in m.ROUTES if g[0] != "unknown_item"]
    return f"""with r as (select *, coalesce({_guard(guards)}, 'open') as route, case when {_MANGLISH} then 'manglish' else 'english' end as lang from (select *, {_W} as w from {_M}) left join {_CFG} using (slug))
        select msg_id, slug, session_id, lang, route, coalesce({_v(1, 'varchar')}, 'open') as source, coalesce({_v(2, 'varchar')}, '') as bypass, coalesce(nullif({_v(4, 'varchar')}, ''), {_SENT}) as sentiment, coalesce({_v(5, 'double')}, case when {_HIT} is null then 0.5 else 0.93 end) as confidence,
        case when route in ('open', 'escalate') then case when {_HIT} is null then 'default' else 'lexicon' end else {_v(3, 'varchar')} end as sent_source, case when route = 'location' then lang else {_v(6, 'varchar')} end as faq_source, {_v(7, 'varchar')} as faq_id, {_v(8, 'double')} as faq_score, route = 'escalate' as escalate from r"""


STREAMED = _streamed_sql()
