"""Registered queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import tables as t
from . import ratio
from . import text as x

STOP = ["the", "and", "for", "with", "der", "die", "und", "que", "les", "des"]
SYNONYMS = {"the": "that this", "of": "from", "und": "auch mit", "de": "des"}
DIET = {"the": "da", "and the": "plus", "of": "v", "Of the": "nv", "de la": "dl"}
UMBRELLA = {"tion": ["nation", "station"], "heit": ["keit", "ung"], "oire": ["histoire"]}
_M = t.MESSAGES
_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def _words(c: str) -> str:
    return _W.format(c)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _message(select):
    """Columns are made when the query is asked for: they need a session."""
    return lambda s, d: t.messages(s, d).select("msg_id", *select())


def fn_slug(s, d):
    return t.items(s, d).select("item_pos", x.slug(F.concat(F.lit("  "), F.col("name"), F.lit("__"), F.col("brand"), F.lit(" - "))).alias("slug"))


def fn_faq_bridge(s, d):
    """FAQs in three dialects, unified, and all their phrasings."""
    k, one = F.col("faq_pos") % 3, lambda c: F.substring(c, 1, 20)
    some = lambda n, c: F.when(k == n, c)
    faq = x.unified_faq(
        some(0, F.col("q")), some(1, F.concat(F.lit(" "), F.col("q"))), some(1, F.array(one("q"), F.lit(" "), one("a"))), some(2, F.array("q", F.lit(" "), one("q"))), some(0, F.col("a")), some(1, F.col("a")),
        some(2, one("a")), some(1, F.lit(" ")), some(0, F.lower("q")),
    )
    rows = t.faqs(s, d).select("faq_id", faq.alias("f")).select("faq_id", "f.*")
    return rows.select("faq_id", "q", "a", "q_ml", "a_ml", F.array_join(x.phrasings(F.col("q"), F.col("variants")), "|").alias("phrasings"), F.size("variants").alias("n_variants"))


def fn_number(s, d):
    text = F.concat(F.regexp_replace(F.col("o_orderkey").cast("string"), r"(\d)(\d\d)$", r"$1,$2"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""))
    return t.read(s, d, "orders").select("o_orderkey", x.indian_number(text).alias("n"))


#: Price cells in many forms, as SQL of either engine.
CELL = """case item_pos % 11 when 0 then concat('Rs. ', price) when 1 then concat(price + size, ' - ', price) when 2 then concat('KL-', price) when 3 then concat(price, ' ', price + size)
  when 4 then concat('₹', price, ' – ₹', price + size) when 5 then concat('Rs. ', price, ' (pre-order) ', size) when 6 then concat('Rs. ', size, ' ', price, ' 300') when 7 then concat('Rs. ', price, ' - ', price)
  when 8 then concat(price, ' Rupees') when 9 then concat('0 - ', price) else concat('1,', price, ' per piece') end"""


def fn_prices(s, d):
    return t.items(s, d).select("item_pos", x.prices(F.expr(CELL)).alias("p")).select("item_pos", "p.*")


def fn_price_label(s, d):
    """The three labels of a price: blank, by what is set, and by what is in the row."""
    price = F.when(F.col("item_pos") % 3 == 0, F.col("price")).when(F.col("item_pos") % 3 == 1, F.lit(0))
    low, high = F.when(F.col("item_pos") % 2 == 0, F.col("price")), F.when(F.col("item_pos") % 5 != 0, F.col("price") + 500)
    return t.items(s, d).select("item_pos", x.price_label(price, low, high, "").alias("short"), x.price_label(price, low, high, "price on request").alias("label"), x.price_label(price, low, high, "on request", zero=True).alias("strict"))


def _values():
    return F.map_from_entries(F.array(F.struct(F.lit("shop").alias("k"), F.col("slug").alias("v")), F.struct(F.lit("item").alias("k"), F.col("name").alias("v")), F.struct(F.lit("price").alias("k"), F.when(F.col("size") % 2 == 0, F.col("price").cast("string")).otherwise("N/A").alias("v"))))


_TEMPLATE = "{item} at {shop} costs {price}, call {phone} or visit {place}"


def fn_placeholder(s, d):
    return t.items(s, d).select("item_pos", x.fill_placeholders(F.lit(_TEMPLATE), _values(), {"phone": "our number", "price": "a fair price"}).alias("text"))


def fn_format_map(s, d):
    template = F.when(F.col("size") % 3 == 0, F.lit("{item} {shop}")).otherwise(F.lit("{item} {phone}"))
    return t.items(s, d).select("item_pos", x.format_map(template, _values()).alias("text"))


def fn_flatmap(s, d):
    """Nested settings of each shop as keys and texts, with aliases and defaults."""
    rows = t.shops(s, d).select("slug", "shop_name", F.struct(F.col("city").alias("town"), F.array(F.lit("cash"), F.col("city")).alias("payment"), F.expr("case when shop_pos % 2 = 0 then 3 end").alias("days")).alias("c"))
    flat = x.flat_settings({"c_town": F.col("c.town"), "c_payment": F.array_join("c.payment", ", "), "c_days": F.col("c.days"), "shop_name": F.col("shop_name")}, {"city": "c_town", "shop_name": "c_town", "phone": "c_phone"}, {"c_days": "0", "delivery": "N/A"})
    return rows.select("slug", F.explode(flat).alias("key", "value"))


def _pair(s, d):
    return t.faqs(s, d).select("faq_id", x.words(F.col("q")).alias("a"), x.words(F.col("a")).alias("b"))


def fn_cosine(s, d):
    """Each document's vector against a set of anchors, the axes and a diagonal: the highest cosine."""
    anchors = [[1.0 if i == k else 0.0 for i in range(64)] for k in range(3)] + [[0.125] * 64]
    best = F.greatest(*[x.cosine(F.col("embedding"), F.array(*[F.lit(v) for v in a])) for a in anchors])
    return t.read(s, d, "embeddings").select("vec_id", F.round(best, 4).alias("cosine"))


def fn_token_set_ratio(s, d):
    return t.faqs(s, d).select("faq_id", ratio.token_set_ratio(F.col("q"), F.col("a")).alias("ratio"))


def fn_indel_ratio(s, d):
    """Spelling variants among the first two words of each item name and its category."""
    w = t.items(s, d).select("item_pos", F.element_at(F.split("name", " "), 1).alias("a"), F.lower(F.element_at(F.split("category", " "), 1)).alias("b"))
    return w.select("item_pos", "a", "b", ratio.spelling_variant(F.col("a"), F.col("b")).alias("variant"))


QUERIES = {
    "fn_slug": fn_slug,
    "fn_faq_bridge": fn_faq_bridge,
    "fn_normalize": _message(lambda: [x.replace_words(F.col("message"), {"the": "da", "of": "out of", "und": "and"}, [(r"whats\s?app", "whatsapp"), ("ing ", "in ")]).alias("text")]),
    "fn_tokens": _message(lambda: [F.array_join(x.words(F.col("message")), " ").alias("all_words"), F.array_join(x.content_words(F.col("message"), STOP), " ").alias("content"), F.array_join(x.listed_words(F.col("message"), STOP), " ").alias("listed"), F.array_join(F.array_sort(x.priced_words(F.concat(F.col("message"), F.lit(" ₹20 x")), STOP)), " ").alias("priced"), F.array_join(F.array_sort(F.array_distinct(F.concat(x.words(F.col("message")), F.transform(x.words(F.col("message")), x.stem)))), " ").alias("with_stems"), F.size(x.split_words(F.col("message"))).alias("n_split")]),
    "fn_stem": _message(lambda: [F.array_join(F.transform(x.words(F.col("message")), x.stem), " ").alias("stems")]),
    "fn_synonyms": _message(lambda: [F.array_join(x.expand_synonyms(x.words(F.col("message")), SYNONYMS, ["und"]), " ").alias("tokens")]),
    "fn_umbrella": _message(lambda: [x.append_umbrella(F.col("message"), UMBRELLA).alias("text")]),
    "fn_spelling": _message(lambda: [x.fix_spelling(F.col("message"), [("the", "teh"), ("and", "und"), ("of", "from")]).alias("text"), x.dietary(F.col("message"), DIET).alias("diet")]),
    "fn_number": fn_number,
    "fn_prices": fn_prices,
    "fn_price_label": fn_price_label,
    "fn_flatmap": fn_flatmap,
    "fn_placeholder": fn_placeholder,
    "fn_format_map": fn_format_map,
    "fn_preview": lambda s, d: t.faqs(s, d).select("faq_id", x.preview(F.col("q")).alias("question"), x.preview(F.col("a"), 60).alias("answer")),
    "fn_f1": lambda s, d: _pair(s, d).select("faq_id", F.round(x.overlap_f1(F.col("a"), F.col("b")), 6).alias("f1"), F.round(x.overlap_f1(x.expand_synonyms(F.col("a"), SYNONYMS), F.col("b")), 6).alias("f1_expanded")),
    "fn_jaccard": lambda s, d: _pair(s, d).select("faq_id", F.round(x.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard")),
    "fn_cosine": fn_cosine,
    "fn_token_set_ratio": fn_token_set_ratio,
    "fn_indel_ratio": fn_indel_ratio,
}

_STEM = "case " + " ".join(f"when ends_with(w, '{s}') and length(w) - {len(s)} >= 3 then left(w, length(w) - {len(s)})" for s in x.SUFFIXES) + " else w end"
_STEMS = f"list_transform({_words('message')}, lambda w: {_STEM})"
_SYN = "case t " + " ".join(f"when '{k}' then {_list(v.split())}" for k, v in SYNONYMS.items()) + " else []::varchar[] end"


def _distinct(expr: str) -> str:
    """First occurrences in order."""
    return f"list_filter({expr}, lambda v, i: list_position({expr}, v) = i)"


def _expanded(tokens: str, particles: list[str]) -> str:
    kept = f"list_filter({tokens}, lambda t: not list_contains({_list(particles)}::varchar[], t))"
    return _distinct(f"list_concat({tokens}, flatten(list_transform({kept}, lambda t: {_SYN})))")


def prices_sql(rows: str) -> str:
    """``rows`` (with a column cell) with price, price_min and price_max instead of the cell."""
    clean = r"trim(regexp_replace(cell, '(?i)₹|Rs\.?', '', 'g'))"
    number = "try_cast(replace({0}, ',', '') as bigint)"
    dash = lambda k: number.format(rf"regexp_extract({clean}, '(\d[\d,]*)\s*[-–]\s*(\d[\d,]*)', {k})")
    parts = rf"select *, list_filter(list_transform(regexp_extract_all({clean}, '\d[\d,]*'), lambda v: {number.format('v')}), lambda v: v > 0) as n, {dash(1)} as a, {dash(2)} as b, regexp_matches(cell, '(?i)₹|Rs\.?|Rupee') or not regexp_matches(cell, '[A-Za-z]') as good from ({rows})"
    return f"""select * exclude (cell, n, a, b, good, around, rising), case when good and not around and not rising then n[1] end as price, case when good then case when around then least(a, b) when rising then n[1] end end as price_min,
        case when good then case when around then greatest(a, b) when rising then n[2] end end as price_max from (select *, coalesce(a > 0 and b > 0 and a <> b, false) as around, coalesce(n[1] < n[2], false) as rising from ({parts}))"""


_F1 = "case when len(list_intersect({a}, {b})) > 0 then 2.0 * len(list_intersect({a}, {b})) / (len(list_distinct({a})) + len(list_distinct({b}))) else 0.0 end"
_PAIR = f"(select faq_id, {_words('q')} as a, {_words('a')} as b from {t.FAQS})"
SQL = {
    "fn_slug": rf"select item_pos, regexp_replace(regexp_replace(regexp_replace(lower(trim('  ' || name || '__' || brand || ' - ')), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as slug from {t.ITEMS}",
    "fn_faq_bridge": f"""select faq_id, trim(q) as q, case when k < 2 then nullif(trim(a), '') end as a, case when k = 0 then nullif(trim(lower(q)), '') end as q_ml, case when k = 2 then nullif(trim(left(a, 20)), '') end as a_ml, array_to_string(list_concat([trim(q)], v), '|') as phrasings, cast(len(v) as int) as n_variants from (
        select *, list_filter(case k when 1 then [trim(left(q, 20)), trim(left(a, 20))] when 2 then [trim(left(q, 20))] else []::varchar[] end, lambda w: w <> '' and w <> trim(q)) as v from (select *, faq_pos % 3 as k from {t.FAQS}))""",
    "fn_normalize": rf"""select msg_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(lower(trim(message)), '\s+', ' ', 'g'), 'whats\s?app', 'whatsapp', 'g'), 'ing ', 'in ', 'g'), ' '),
        lambda w: case w when 'the' then 'da' when 'of' then 'out of' when 'und' then 'and' else w end), ' ') as text from {_M}""",
    "fn_tokens": rf"""select msg_id, array_to_string({_words('message')}, ' ') as all_words, array_to_string(list_filter({_words('message')}, lambda w: length(w) >= 3 and not list_contains({_list(STOP)}, w)), ' ') as content, array_to_string(list_filter({_words('message')}, lambda w: length(w) > 1 and not list_contains({_list(STOP)}, w)), ' ') as listed,
        array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(message || ' ₹20 x'), '[\p{{L}}\p{{N}}_₹]+'), lambda w: not list_contains({_list(STOP)}, w)))), ' ') as priced,
        array_to_string(list_sort(list_distinct(list_concat({_words('message')}, {_STEMS}))), ' ') as with_stems, cast(len(list_filter(regexp_split_to_array(trim(message), '\s+'), lambda w: w <> '')) as int) as n_split from {_M}""",
    "fn_stem": f"select msg_id, array_to_string({_STEMS}, ' ') as stems from {_M}",
    "fn_synonyms": f"select msg_id, array_to_string({_expanded(_words('message'), ['und'])}, ' ') as tokens from {_M}",
    "fn_umbrella": "select msg_id, concat_ws(' ', message, array_to_string(list_sort(list_distinct(list_concat(" + ", ".join(f"case when contains(lower(message), '{k}') then {_list(v)} else []::varchar[] end" for k, v in UMBRELLA.items()) + f"))), ' ')) as text from {_M}",
    "fn_spelling": rf"select msg_id, regexp_replace(regexp_replace(regexp_replace(message, '(?i)\bthe\b', 'teh', 'g'), '(?i)\band\b', 'und', 'g'), '(?i)\bof\b', 'from', 'g') as text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '(?i)and the', 'plus', 'g'), '(?i)Of the', 'nv', 'g'), '(?i)de la', 'dl', 'g'), '(?i)the', 'da', 'g'), '(?i)of', 'v', 'g') as diet from {_M}",
    "fn_number": "select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderkey end as n from orders",
    "fn_prices": prices_sql(f"select item_pos, {CELL} as cell from {t.ITEMS}"),
    "fn_price_label": f"""select item_pos, coalesce(one, two, '') as short, coalesce(one, two, 'price on request') as label, coalesce(case when p is not null then '₹' || format('{{:,}}', p) end, two, 'on request') as strict from (
        select *, case when p <> 0 then '₹' || format('{{:,}}', p) end as one, case when item_pos % 2 = 0 and item_pos % 5 <> 0 then '₹' || format('{{:,}}', price) || '–₹' || format('{{:,}}', price + 500) end as two from (select *, case item_pos % 3 when 0 then price when 1 then 0 end as p from {t.ITEMS}))""",
    "fn_flatmap": f"select slug, unnest(['c_town', 'c_payment', 'c_days', 'shop_name', 'city', 'delivery']) as key, unnest([city, 'cash, ' || city, case when shop_pos % 2 = 0 then '3' else '0' end, shop_name, city, 'N/A']) as value from {t.SHOPS}",
    "fn_placeholder": f"select item_pos, name || ' at ' || slug || ' costs ' || case when size % 2 = 0 then cast(price as varchar) else 'a fair price' end || ', call our number or visit [place]' as text from {t.ITEMS}",
    "fn_format_map": f"select item_pos, case when size % 3 = 0 then name || ' ' || slug else '{{item}} {{phone}}' end as text from {t.ITEMS}",
    "fn_preview": f"select faq_id, case when length(q) > 120 then left(q, 120) || '…' else q end as question, case when length(a) > 60 then left(a, 60) || '…' else a end as answer from {t.FAQS}",
    "fn_f1": f"select faq_id, round({_F1.format(a='a', b='b')}, 6) as f1, round({_F1.format(a=_expanded('a', []), b='b')}, 6) as f1_expanded from {_PAIR}",
    "fn_jaccard": f"select faq_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as jaccard from {_PAIR}",
    "fn_cosine": "select vec_id, round(greatest(cast(embedding[1] as double), cast(embedding[2] as double), cast(embedding[3] as double), list_sum(list_transform(range(1, 65), lambda i: cast(embedding[i] as double) * 0.125))), 4) as cosine from embeddings",
}
