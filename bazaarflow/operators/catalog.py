"""Catalogue filters and projections: what is an item, what is a section, searches, gender and category of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..plans import tables as t
from ..plans.sizing import sized

# Beginnings of names that are no items (a blank stands for any number of blanks, with a plus for one or more), section titles that are no categories, words of sections with and without goods.
JUNK_NAMES = [
    r"gst (no\.?|number)?", r"~?\d+ g\)?", r"pieces?\)?", "traditional +recipe", r"pickle \+", "free +delivery", "delivery +(charge|time|zone|areas?|below|above)", "minimum +order", "order +via", "loyalty +card", "offer +code", "happy +hours?",
    "family +pack", "opening +hours?", "last +order", "home +delivery +hours", r"breakfast +\(", "payment +mode", "catering +(available|service|for)",
]
JUNK = "^(" + "|".join(v.replace(" +", r"\s+").replace(" ", r"\s*") for v in JUNK_NAMES) + ")"
META_TITLES = ["CATALOGUE", "CATALOG", "EXAMPLES", "EXAMPLE", "SAMPLE", "SAMPLES", "SUMMARY", "OVERVIEW", "INFORMATION", "GUIDE", "TERMS", "POLICY", "POLICIES", "DISCLAIMER", "APPENDIX", "INTRODUCTION", "CONTENTS"]
HEADING = r"^\s*[A-Z][A-Z\s&/(),-]{3,60}\s*$"
GOODS = r"(?i)\b(PRODUCTS?|CATALOGUE|CATALOG|MENU|SERVICES?|TREATMENTS?|PRICE\s*LIST|PRICING|TARIFF|ITEMS?)\b"
OFFICE = r"(?i)\b(INFORMATION|HOURS|TIMING|PAYMENT|DELIVERY|POLICY|POLICIES|OFFERS?|LOYALTY|STAFF|EXPERTISE|CONTACT|ABOUT|LICEN[CS]E|REGISTRATION|TERMS|FAQ)\b"
FRAGMENT = r"(?i)^(and|with|plus|including|reception|lashes)\b"
DISCOUNT = r"(?i)discount|loyalty|referral|programme|program|offer|%|percent"


def valid_item(name: Column, junk: str = JUNK) -> Column:
    """3 to 80 characters, no sign in front, not all digits, no junk."""
    n = F.trim(name)
    return F.length(n).between(3, 80) & ~n.rlike(r"^[~()+.,#-]") & ~n.rlike(r"^\d[\d\s,.]*$") & ~F.lower(n).rlike(junk)


def junk_item(name: Column, price: Column) -> Column:
    """A fragment (lower-case start, a plus, a count of members, a joining word), or a discount given as a price of at most 20."""
    n = F.trim(F.coalesce(name, F.lit("")))
    first = F.left(n, F.lit(1))
    small = (first != F.upper(first)) & (first == F.lower(first))
    return (n == "") | small | n.contains("+") | n.rlike(r"(?i)\(\d+\s*members?\)") | n.rlike(FRAGMENT) | F.coalesce((price <= 20) & n.rlike(DISCOUNT), F.lit(False))


def heading(line: Column) -> Column:
    """A section heading: 4 to 61 capitals and signs."""
    return line.rlike(HEADING)


def category_heading(line: Column, titles: list[str] = META_TITLES) -> Column:
    """A heading that names goods, no document title."""
    return heading(line) & ~F.arrays_overlap(x.split_words(F.upper(line)), x.lit_array(titles))


def administrative(category: Column) -> Column:
    """A section about the shop and not its goods; words of goods win."""
    return ~category.rlike(GOODS) & category.rlike(OFFICE)


def search(items: DataFrame, category: str = "", text: str = "", n: int = 25) -> DataFrame:
    """The first ``n`` items by position whose category holds one text and whose name or description holds the other."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    found = items.where(low("category").contains(category.lower()) & (low("name").contains(text.lower()) | low("description").contains(text.lower())))
    return found.orderBy("item_pos").limit(n)


def categories(items: DataFrame) -> DataFrame:
    """Each shop's distinct categories, sorted and joined."""
    return items.where("category <> ''").groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"))


def enrich(items: DataFrame, shops: DataFrame, genders: dict[str, str], default: str = "unisex") -> DataFrame:
    """Gender and category filled in where they are missing or not allowed.

    ``shops``: slug, gender (of a shop for one gender only, else null) and allowed (array). A given gender stays; else the
    shop's own one, else that of the first keyword pattern in the name, else ``default``. A category outside the allowed ones
    becomes the first of them; a shop without a list keeps its items' categories.
    """
    word = F.when(F.lit(False), "")
    for g, p in genders.items():
        word = word.when(F.lower("name").rlike(p), g)
    rows = items.join(sized(shops.select("slug", F.col("gender").alias("_shop"), "allowed")), "slug", "left")
    gender = F.coalesce(x.blank_to_null(F.col("gender")), "_shop", word.otherwise(default))
    fits = F.col("allowed").isNull() | (F.size("allowed") == 0) | F.array_contains("allowed", F.col("category"))
    return rows.withColumn("gender", gender).withColumn("category", F.when(fits, F.col("category")).otherwise(F.get("allowed", F.lit(0)))).drop("_shop", "allowed")


def _lines(s, d):
    return t.read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def _enrich(s, d):
    items = t.items(s, d).withColumn("gender", F.expr("if(size % 8 = 0, 'kids', if(size % 8 = 1, ' ', null))"))
    shops = items.select("slug").distinct().selectExpr("slug", "if(slug = 'shop-3', 'women', null) as gender", "case when slug = 'shop-4' then null when slug < 'shop-4' then array('ECONOMY', 'PROMO') else array('SMALL', 'LARGE', 'PROMO') end as allowed")
    return enrich(items, shops, {"men": "gear|bolt", "women": "rod|ring"}).select("item_pos", "gender", "category")


def _sections(s, d):
    """Lines of documents in capitals and items' categories with section words."""
    names = t.items(s, d).selectExpr("item_pos", "concat(category, case item_pos % 6 when 0 then ' CATALOGUE' when 1 then ' SERVICE INFORMATION' when 2 then ' OPENING HOURS' when 3 then ': 12' when 4 then ' PLATES & RINGS' else '' end) as text")
    return names.select("item_pos", heading(F.col("text")).alias("heading"), category_heading(F.col("text")).alias("category"), administrative(F.col("text")).alias("office"))


def _valid(s, d):
    names = t.items(s, d).selectExpr("item_pos", "size", "concat(case item_pos % 9 when 0 then '+' when 1 then 'and ' when 2 then 'Free delivery ' when 3 then 'Fine ' when 4 then '12' when 5 then 'Offer on ' when 6 then 'GST no ' else '' end, if(item_pos % 9 = 4, '', name), if(size % 10 = 1, ' (4 members)', '')) as name")
    return names.select("item_pos", valid_item(F.col("name")).alias("valid"), junk_item(F.col("name"), F.col("size")).alias("junk"))


QUERIES = {
    "flt_item_valid": _valid,
    "flt_section": _sections,
    "flt_catalog": lambda s, d: search(t.described(s, d), "e", "7x", 25).select("item_pos", "name"),
    "flt_catalog_list": lambda s, d: categories(t.items(s, d)),
    "prj_enrich_items": _enrich,
}
_NAMES = f"(select item_pos, size, (case item_pos % 9 when 0 then '+' when 1 then 'and ' when 2 then 'Free delivery ' when 3 then 'Fine ' when 4 then '12' when 5 then 'Offer on ' when 6 then 'GST no ' else '' end) || (case when item_pos % 9 = 4 then '' else name end) || (case when size % 10 = 1 then ' (4 members)' else '' end) as name from {t.ITEMS})"
_TITLES = f"(select item_pos, category || case item_pos % 6 when 0 then ' CATALOGUE' when 1 then ' SERVICE INFORMATION' when 2 then ' OPENING HOURS' when 3 then ': 12' when 4 then ' PLATES & RINGS' else '' end as text from {t.ITEMS})"
_LIST = "[" + ", ".join(f"'{w}'" for w in META_TITLES) + "]"
SQL = {
    "flt_item_valid": rf"""select item_pos, length(trim(name)) between 3 and 80 and not regexp_matches(trim(name), '^[~()+.,#-]') and not regexp_matches(trim(name), '^\d[\d\s,.]*$') and not regexp_matches(lower(trim(name)), '{JUNK}') as valid,
        (upper(left(name, 1)) <> left(name, 1)) or contains(name, '+') or regexp_matches(name, '(?i)\(\d+\s*members?\)') or regexp_matches(name, '{FRAGMENT}') or (size <= 20 and regexp_matches(name, '{DISCOUNT}')) as junk from {_NAMES}""",
    "flt_section": rf"""select item_pos, regexp_matches(text, '{HEADING}') as heading, regexp_matches(text, '{HEADING}') and not list_has_any(regexp_split_to_array(trim(text), '\s+'), {_LIST}) as category,
        not regexp_matches(text, '{GOODS}') and regexp_matches(text, '{OFFICE}') as office from {_TITLES}""",
    "flt_catalog": f"select item_pos, name from {t.DESCRIBED} where contains(lower(category), 'e') and (contains(lower(name), '7x') or contains(lower(description), '7x')) order by item_pos limit 25",
    "flt_catalog_list": f"select slug, string_agg(category, '|' order by category) as categories from (select distinct slug, category from {t.ITEMS}) group by slug",
    "prj_enrich_items": f"""select item_pos, case when size % 8 = 0 then 'kids' when slug = 'shop-3' then 'women' when regexp_matches(name, 'gear|bolt') then 'men' when regexp_matches(name, 'rod|ring') then 'women' else 'unisex' end as gender,
        case when slug = 'shop-4' then category when slug < 'shop-4' then case when category in ('ECONOMY', 'PROMO') then category else 'ECONOMY' end else case when category in ('SMALL', 'LARGE', 'PROMO') then category else 'SMALL' end end as category from {t.ITEMS}""",
}
