"""Documents into items, facts, shop metadata and retrieval chunks; documents come as text and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.queries import prices_sql
from ..plans import scratch
from ..plans import tables as t
from . import catalog
from .catalog import META_TITLES, administrative, heading, junk_item, valid_item

# Words of header cells by role.
HEADERS = {
    "name": ("name", "item", "dish", "product", "service", "treatment", "type", "particulars"),
    "price": ("price", "rate", "amount", "cost", "fee", "charge", "tariff", "₹", "rs."),
    "description": ("description", "detail", "desc", "notes", "includes", "inclusion", "inclusions", "duration", "time", "hrs", "min"),
}
# Labels of rows that are facts about a shop; a blank stands for any number of blanks.
LABELS = [
    r"Registration No\.?", "Address", r"Phone( \(.*?\))?", "Emergency Phone", "WhatsApp", "WhatsApp Order", "Monday", "Sunday", "Emergency", "EMI", "Kids Special", "Senior Citizen", "Payment Modes?", "Health Insurance", "Free Consultation",
    "FSSAI License", r"GSTIN?( No\.?)?", "Zomato", "Swiggy", "AC Available", "Private Dining", "Owner", "Owner / Director", "Head Chef", "Cuisine", "Seating (Capacity)?", "Landmark", "Last Order", "Home Delivery Hours", r"Breakfast( \(.*?\))?",
    "Free Delivery (Above|Below)?", "Delivery (Charge|Time|Zone|Areas?)", "Minimum Order", "Order via", "Catering", "Bulk Order", "Offer Code.*", "Happy Hours? Offer", "Family Pack", "Loyalty Card", "Weekend Breakfast",
    "Restaurant Name", "Equipment", "Sterilisation", "Parking", "Salon Name", "Clinic Name", "Shop Name", "Alternate Phone", "Instagram", "Facebook", "Accessibility", "Lift Available",
]
FACT_LABELS = "(?i)^(" + "|".join(v.replace(" ", r"\s*") for v in LABELS) + ")$"
DURATION = r"(?i)\d+(\.\d+)?\s*(hrs?|min(utes?)?|hour)"
MONEY = r"(?i)(Rs\.?|₹)\s*\d"

# Lines that end with a range of prices or with a price, in the order tried.
_NAME, _SIGN, _NUMBER = r"([A-Za-z][\w\s()/&,-]{2,60}?)", r"[₹Rs.]{0,3}\s*", r"(\d[\d,]{1,9})"
RANGE_LINES = [rf"(?i)^{_NAME}\s+{_SIGN}{_NUMBER}\s*[-–]\s*{_SIGN}{_NUMBER}", rf"(?i)^(.+?)\s*[|\t]\s*{_SIGN}{_NUMBER}\s*[-–]\s*{_SIGN}{_NUMBER}"]
PRICE_LINES = [rf"(?i)^{_NAME}\s+{_SIGN}{_NUMBER}\s*(?:/-)?$", rf"(?i)^(.+?)\s*[|\t]\s*{_SIGN}{_NUMBER}\s*$", rf"(?i)^{_NAME}\s*₹\s*{_NUMBER}"]
LINE_HEADING = r"^\s*([A-Z][A-Z\s&/]{3,35}|[A-Z][a-z]+(?:\s[A-Z][a-z]+)+)\s*[:-]?\s*$"

CITIES = ["Thrissur", "Kochi", "Kozhikode", "Kollam", "Kannur", "Mumbai", "Delhi", "Chennai", "Pune"]
STATES = ["Kerala", "Karnataka", "Tamil Nadu", "Maharashtra", "Goa", "Delhi"]
PAYMENTS = {"UPI": r"\bUPI\b", "GPay": r"\bGPay\b|Google Pay", "Cash": r"\bCash\b", "Cards": r"\bCard\b|Credit Card|Debit Card", "Cheque": r"\bCheque\b"}
_CLOCK = r"\d{1,2}(?::\d{2})?\s*(?:AM|PM)"
_DAY = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)(?:day|sday|nesday|rsday|urday)?"
HOURS = rf"(?i)({_DAY}[\s–-]+(?:{_DAY})?[\s:]+{_CLOCK})"
ADDRESS = r"(?i)\b(?:Address|Located at|Location)\b[\s:|]*([A-Za-z0-9][A-Za-z0-9 ,./#-]{5,200}?\b\d{6}\b)"
PIN_ADDRESS = r"([A-Za-z0-9][A-Za-z0-9 ,./#-]{10,120}?\b\d{6}\b)"
OFFER = r"(?:offer\s+code|code|coupon|promo)\s+([A-Za-z][A-Za-z0-9]{3,15})\s*[-–—:]?\s*([^.\n]{5,80})"


def _role(cell: Column) -> Column:
    has = lambda words: F.exists(x.lit_array(words), lambda w: F.contains(F.lower(cell), w))
    return F.when(has(HEADERS["name"]), "name").when(has(HEADERS["price"]), "price").when(has(HEADERS["description"]), "description")


def _last(header: Column, role: str) -> Column:
    return F.array_max(F.transform(header, lambda c, i: F.when(_role(c) == role, i)))


def _filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: F.trim(c) != "")


def table_layout(cells: DataFrame) -> DataFrame:
    """Per table (doc_id, tbl): n rows, whether the first is a title, the header, and the columns of name, price and description.

    The last header cell of a role decides. A price column without a header is the last one, but not the first of all, where
    three tenths of the cells show a currency sign and a number, else where more than four tenths hold two digits and
    no more than four tenths a duration. The name is in the first column if no header says so.
    """
    numbered = cells.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "tbl").orderBy("row")))
    layout = numbered.groupBy("doc_id", "tbl").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_r") == 1, F.col("cells"))).alias("one"), F.max(F.when(F.col("_r") == 2, F.col("cells"))).alias("two"))
    titled = (F.col("n") > 1) & (F.size(_filled(F.col("one"))) == 1) & F.coalesce(heading(F.try_element_at(_filled(F.col("one")), F.lit(1))), F.lit(False))
    layout = layout.withColumn("titled", titled).withColumn("header", F.when(titled, F.col("two")).otherwise(F.col("one"))).drop("one", "two")
    layout = layout.withColumn("start", F.when(F.col("titled"), 2).otherwise(1)).withColumns({"name_col": F.coalesce(_last(F.col("header"), "name"), F.lit(0)), "headed": _last(F.col("header"), "price"), "text_col": _last(F.col("header"), "description")})
    body = numbered.join(layout.where("n > 1").select("doc_id", "tbl", "start", "header"), ["doc_id", "tbl"]).where("_r > start")
    shares = body.select("doc_id", "tbl", F.size("header").alias("width"), F.posexplode("cells").alias("col", "cell")).where("col between 1 and width - 1")
    shares = shares.groupBy("doc_id", "tbl", "col").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cell").rlike(MONEY)).alias("money"), F.count_if(F.col("cell").rlike(DURATION)).alias("lasting"), F.count_if(F.col("cell").rlike(r"\d{2,}")).alias("digits"))
    money = F.when(F.col("money") >= F.greatest(F.lit(1.0), 0.3 * F.col("n")), F.col("col"))
    number = F.when((F.col("lasting") <= 0.4 * F.col("n")) & (F.col("digits") > 0.4 * F.col("n")), F.col("col"))
    guessed = shares.groupBy("doc_id", "tbl").agg(F.coalesce(F.max(money), F.max(number)).alias("guessed"))
    return layout.join(guessed, ["doc_id", "tbl"], "left").withColumn("price_col", F.coalesce("headed", "guessed")).drop("headed", "guessed")


def _table_rows(cells: DataFrame) -> DataFrame:
    """Rows of tables with their layout, name, other cells and the heading in force (doc order: tbl, row)."""
    rows = cells.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "tbl").orderBy("row"))).join(table_layout(cells), ["doc_id", "tbl"])
    rows = rows.withColumn("is_title", F.col("titled") & (F.col("_r") == 1)).withColumn("is_header", (F.col("n") > 1) & (F.col("_r") == F.col("start")) & F.exists("header", lambda c: c.rlike("[a-zA-Z]{3,}")))
    rows = rows.withColumn("name", F.trim(F.when(F.col("is_title"), F.try_element_at(_filled(F.col("cells")), F.lit(1))).otherwise(F.get("cells", F.col("name_col")))))
    rows = rows.withColumn("others", F.filter("cells", lambda c, i: i != F.col("name_col")))
    inside = heading(F.col("name")) & ~F.exists("others", lambda c: c.rlike(r"\d{2,}")) & (F.col("n") > 1) & ~F.col("is_header")
    rows = rows.withColumn("is_heading", F.coalesce(F.col("is_title") | inside, F.lit(False)))
    title = F.when(F.col("is_heading") & ~F.arrays_overlap(x.split_words(F.upper("name")), x.lit_array(META_TITLES)), F.col("name"))
    return rows.withColumn("category", F.coalesce(F.last(title, True).over(Window.partitionBy("doc_id").orderBy("tbl", "row")), F.lit("General")))


def laid_out(cells: DataFrame) -> DataFrame:
    """Rows of tables with layout and headings as a table, to be given to ``table_items`` and ``table_facts`` in place of the cells."""
    return scratch.table(_table_rows(cells), "table-rows")


def _laid(cells: DataFrame) -> DataFrame:
    return cells if "is_header" in cells.columns else _table_rows(cells)


def _data_rows(cells: DataFrame) -> DataFrame:
    rows = _laid(cells).where("n > 1 and not is_title and not is_header and not is_heading and length(name) >= 2")
    return rows.withColumn("is_fact", F.col("name").rlike(FACT_LABELS) | administrative(F.col("category")))


def table_items(cells: DataFrame) -> DataFrame:
    """Rows of tables (doc_id, tbl, row, cells) -> items (doc_id, tbl, row, name, category, description, price, price_min, price_max).

    A price of the price column counts; else the other cells are tried in order up to the first range, and the last single
    price of 5 or more before it. Prices under 10 are noise. The first row of a name in a document wins.
    """
    rows = _data_rows(cells).where("not is_fact").where(valid_item(F.col("name")))
    keys = ["doc_id", "tbl", "row"]
    cells = rows.select(*keys, "name", "category", "name_col", "price_col", "text_col", F.posexplode("cells").alias("i", "cell")).withColumn("p", x.prices(F.col("cell")))
    other, own = F.col("i") != F.col("name_col"), F.col("i") == F.col("price_col")
    told = lambda c: F.max(F.when(own, F.col(f"p.{c}"))).alias(c)
    rows = cells.groupBy(*keys).agg(
        F.first("name").alias("name"), F.first("category").alias("category"), F.trim(F.max(F.when(F.col("i") == F.col("text_col"), F.col("cell")))).alias("description"), told("price"), told("price_min"), told("price_max"),
        F.min(F.when(other & F.col("p.price_min").isNotNull(), F.col("i"))).alias("at"), F.sort_array(F.collect_list(F.when(other, F.struct("i", "p.price", "p.price_min", "p.price_max")))).alias("every"),
    )
    found = (F.coalesce("price", F.lit(0)) != 0) | (F.coalesce("price_min", F.lit(0)) != 0)
    before = F.try_element_at(F.filter("every", lambda v: (v["price"] >= 5) & (F.col("at").isNull() | (v["i"] < F.col("at")))), F.lit(-1))["price"]
    span = F.try_element_at(F.filter("every", lambda v: v["i"] == F.col("at")), F.lit(1))
    pick = lambda own, other: F.when(found, own).otherwise(other)
    rows = rows.select(*keys, "name", "category", "description", pick(F.col("price"), before).alias("p"), pick(F.col("price_min"), span["price_min"]).alias("lo"), pick(F.col("price_max"), span["price_max"]).alias("hi"))
    rows = rows.where("coalesce(p, 0) <> 0 or coalesce(lo, 0) <> 0").where("not coalesce(p > 0 and p < 10, false) and not coalesce(lo < 10 and (hi is null or hi < 100), false)")
    first = rows.withColumn("_f", F.row_number().over(Window.partitionBy("doc_id", F.lower("name")).orderBy("tbl", "row"))).where("_f = 1")
    described = F.when(~F.lower("description").isin("", "description", "details", "desc"), F.col("description"))
    return first.select("doc_id", "tbl", "row", "name", "category", described.alias("description"), F.when(F.col("lo").isNull(), F.col("p")).alias("price"), F.col("lo").alias("price_min"), F.col("hi").alias("price_max"))


def table_facts(cells: DataFrame) -> DataFrame:
    """Facts (doc_id, tbl, row, label, detail): tables of one row, and rows that a label or an administrative section marks."""
    single = _laid(cells).where("n = 1 and size(cells) >= 2").select("doc_id", "tbl", "row", F.trim(F.get("cells", F.lit(0))).alias("label"), F.try_element_at(_filled(F.expr("slice(cells, 2, size(cells))")), F.lit(1)).alias("detail")).where("length(label) between 1 and 60")
    rows = _data_rows(cells).where("is_fact").select("doc_id", "tbl", "row", F.col("name").alias("label"), F.try_element_at(_filled(F.col("others")), F.lit(1)).alias("detail"))
    return single.unionByName(rows).where("detail is not null").withColumn("detail", F.trim("detail"))


def items_from_lines(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Lines (``key``, ``order``, text) that hold a price or a range -> items under the heading above them; the first of a name wins.

    Ranges are tried before prices. A range must rise, a price be 5 or more. The key of a priced name leaves out a closing bracket.
    """
    text = F.trim("text")
    rows = lines.withColumn("text", text).where("length(text) >= 4")
    title = F.when(F.col("text").rlike(LINE_HEADING) & (F.length("text") < 50) & ~F.col("text").rlike(r"\d{3,}"), F.trim(F.regexp_replace("text", "^:+|:+$", "")))
    rows = rows.withColumn("_t", title).withColumn("category", F.coalesce(F.last("_t", True).over(Window.partitionBy(key).orderBy(*order)), F.lit("General"))).where("_t is null")
    part = lambda p, k: F.regexp_extract("text", p, k)
    ranges, singles = [], []
    for p in RANGE_LINES:
        name, lo, hi = F.trim(F.regexp_replace(F.trim(part(p, 1)), r"^[|-]+|[|-]+$", "")), x.indian_number(part(p, 2)), x.indian_number(part(p, 3))
        ranges.append(F.when(lo.between(1, 9_999_999) & (lo < hi) & valid_item(name), F.struct(name.alias("name"), F.lit(None).cast("bigint").alias("price"), lo.alias("price_min"), hi.alias("price_max"), F.lower(name).alias("key"))))
    for p in PRICE_LINES:
        name, price = F.trim(F.regexp_replace(part(p, 1), r"\s*\|.*$", "")), x.indian_number(part(p, 2))
        singles.append(F.when(price.between(5, 9_999_999) & valid_item(name), F.struct(name.alias("name"), price.alias("price"), F.lit(None).cast("bigint").alias("price_min"), F.lit(None).cast("bigint").alias("price_max"), F.trim(F.lower(F.regexp_replace(name, r"\s*\(.*?\)\s*$", ""))).alias("key"))))
    found = rows.withColumn("f", F.coalesce(*ranges, *singles)).where("f is not null")
    w = Window.partitionBy(key, "f.key").orderBy(*order)
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, *order, "category", "f.name", "f.price", "f.price_min", "f.price_max")


def _found(pattern: str, k: int = 1, text: str = "text") -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, k)), F.lit(""))


def metadata(docs: DataFrame, cities: list[str] = CITIES, states: list[str] = STATES, payments: dict[str, str] = PAYMENTS) -> DataFrame:
    """Contact, hours, place, payment, offer, name and delivery of each document (doc_id, text); what is not found is null.

    Phones are ten digits from 6 on, with or without a country code, each once by its last ten. The address is the text after an
    address label up to a six-digit PIN, else what leads to the first PIN. A name is the first of eight lines with no link or number.
    """
    # what is looked at more than once is a column of its own, so that it is found once; a plain search for what a pattern
    # cannot do without comes first, so most texts never meet the pattern
    low = F.lower("text")
    holds = lambda *words: F.exists(x.lit_array(words), lambda w: F.contains(F.col("_low"), w))
    docs = docs.withColumns({"_low": low, "_clock": F.col("text").rlike(r"\d\s*[AaPp][Mm]"), "_pin": F.col("text").rlike(r"\b\d{6}\b")})
    docs = docs.withColumns({
        "_raw": F.regexp_extract_all("text", F.lit(r"((?:\+91|\b0)?[\s-]?[6-9][\d\s-]{9,14})"), F.lit(1)), "_opens": F.when(F.col("_clock"), F.regexp_extract_all("text", F.lit(HOURS), F.lit(1))), "_code": F.when(holds("code", "coupon", "promo"), _found(f"(?i){OFFER}")), "_about": F.when(holds("code", "coupon", "promo"), _found(f"(?i){OFFER}", 2)),
        "_flat": F.when(F.col("_pin"), F.translate("text", "\n", " ")), "_labelled": holds("address", "located at", "location"), "_lines": F.slice(F.filter(F.transform(F.split("text", "\n"), lambda v: F.trim(v)), lambda v: v != ""), 1, 8),
    })
    digits = F.filter(F.transform("_raw", lambda v: F.regexp_replace(v, r"\D", "")), lambda v: (F.length(v) >= 10) & F.right(v, F.lit(10)).rlike("^[6-9]"))
    phones = F.transform(F.array_distinct(F.transform(digits, lambda v: F.right(v, F.lit(10)))), lambda v: F.concat(F.lit("+91 "), F.left(v, F.lit(5)), F.lit(" "), F.right(v, F.lit(5))))
    closes = F.transform("_opens", lambda h: F.struct(h.alias("h"), F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(r"(?i)\Q"), h, F.lit(rf"\E.*?({_CLOCK})")), F.lit(1)).alias("c")))
    closed = F.try_element_at(F.filter(closes, lambda v: (v["c"] != "") & ~F.contains(F.lower(v["h"]), F.lower(v["c"]))), F.lit(1))
    hours = F.when(F.size("_opens") > 0, F.coalesce(F.concat(closed["h"], F.lit(" - "), closed["c"]), F.get("_opens", F.lit(0)))).otherwise(F.when(F.col("_clock"), _found(rf"(?i)({_CLOCK}\s*[-–to]+\s*{_CLOCK})")))
    # the pattern without a label is tried only in runs of its characters that hold a PIN
    runs = F.filter(F.regexp_extract_all("_flat", F.lit("([A-Za-z0-9 ,./#-]{17,})"), F.lit(1)), lambda r: r.rlike(r"\b\d{6}\b"))
    near = F.try_element_at(F.filter(F.transform(runs, lambda r: F.regexp_extract(r, PIN_ADDRESS, 1)), lambda r: r != ""), F.lit(1))
    address = F.when(F.col("_pin"), F.coalesce(F.when(F.col("_labelled"), F.nullif(F.regexp_extract("_flat", ADDRESS, 1), F.lit(""))), near))
    name = F.try_element_at(F.filter("_lines", lambda v: ~v.rlike(r"\d{7,}|@|www\.|http") & F.length(v).between(6, 59) & ~v.startswith("[")), F.lit(1))
    code, about = F.col("_code"), F.regexp_replace(F.coalesce("_about", F.lit("")), "[-–—: ]+$", "")
    coded = (F.upper(code) == code) | code.rlike(r"\d")
    rupees = lambda p: F.concat(F.lit("₹"), F.nullif(F.regexp_extract("text", p, 1), F.lit("")))
    return docs.select(
        "doc_id", F.array_join(phones, ",").alias("phones"), F.when(F.contains("text", F.lit("@")), _found(r"([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,})")).alias("email"), _found(r"((?:https?://|www\.)[\w.-]+\.[a-z]{2,})").alias("website"), hours.alias("hours"),
        F.concat(F.lit("Sunday: "), _found(r"(?i)Sunday[\s:]+(.{5,50}?(?:AM|PM)[^\n]*)")).alias("sunday"), F.regexp_replace(address, r"\s+", " ").alias("location"), _found(rf"\b({'|'.join(cities)})\b").alias("city"), _found(rf"\b({'|'.join(states)})\b").alias("state"),
        F.array_join(F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.lit(k)) for k, p in payments.items()])), ",").alias("payment"), F.when(coded, code).alias("offer_code"), F.when(coded, about).alias("offer_desc"), name.alias("shop_name"),
        rupees(r"(?i)Free\s+Delivery\s+Above\s+Rs\.?\s*([\d,]+)").alias("delivery_free"), rupees(r"(?i)Delivery\s+Charge\s+Below\s+Rs\.?\s*[\d,]+\s+Rs\.?\s*([\d,]+)").alias("delivery_charge"),
        F.regexp_replace(_found(r"(?i)Delivery\s+Time\s+([^\n]{3,60})"), r"\.+$", "").alias("delivery_days"), F.regexp_replace(_found(r"(?i)Delivery\s+Zone\s+([^\n]{3,150})"), r"\.+$", "").alias("delivery_areas"),
    )


def merged_items(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Items of tables before those of lines (doc_id, pos, name, category, price, price_min, price_max): no fragments, each name once, cut at a pipe and without a closing bracket."""
    columns = ["doc_id", "pos", "name", "category", "price", "price_min", "price_max"]
    rows = tables.select(F.lit(0).alias("layer"), *columns).unionByName(lines.select(F.lit(1).alias("layer"), *columns))
    clean = F.trim(F.regexp_replace("name", r"\s*\|.*$", ""))
    rows = rows.withColumn("_c", clean).where(~junk_item(F.col("_c"), F.coalesce("price", "price_min")) & valid_item(F.col("name")))
    w = Window.partitionBy("doc_id", F.trim(F.lower(F.regexp_replace("_c", r"\s*\(.*?\)\s*$", "")))).orderBy("layer", "pos")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_c")


def shop_info(meta: DataFrame, items: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per document: its metadata with the defaults of shops, counts, and items and facts as ordered arrays."""
    i = items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("layer", "pos", "name", "category", "price", "price_min", "price_max"))).alias("items"))
    f = facts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("tbl", "row", "label", "detail"))).alias("facts"))
    out = meta.join(i, "doc_id", "left").join(f, "doc_id", "left")
    none = lambda c, like: F.coalesce(c, F.filter(F.array(F.lit(None).cast(like)), lambda v: v.isNotNull()))
    phone = F.nullif(F.get(F.split("phones", ","), F.lit(0)), F.lit(""))
    return out.select(
        "doc_id", "shop_name", F.left(F.get(F.split("shop_name", r"\s+"), F.lit(0)), F.lit(10)).alias("bot_name"), "location", "city", F.coalesce("state", F.lit("Kerala")).alias("state"), "hours", "sunday", phone.alias("phone"), phone.alias("whatsapp"), "email", "website",
        F.coalesce(F.nullif("payment", F.lit("")), F.lit("UPI,Cash,Cards")).alias("payment"), "offer_code", "offer_desc", "delivery_free", "delivery_charge", "delivery_days", "delivery_areas",
        none(F.col("items"), items_type(items)).alias("items"), none(F.col("facts"), "struct<tbl:bigint,row:bigint,label:string,detail:string>").alias("facts"),
    )


def items_type(items: DataFrame) -> str:
    kinds = dict(items.dtypes)
    return "struct<" + ",".join(f"{c}:{kinds[c]}" for c in ("layer", "pos", "name", "category", "price", "price_min", "price_max")) + ">"


def pieces(text: Column, least: int = 25, most: int = 200) -> Column:
    """Paragraphs of more than ``least`` characters; those over ``most`` as sentences of more than 20 and fewer than 300."""
    paragraphs = F.transform(F.split(text, "\n\n"), lambda p: F.trim(p))
    cut = lambda p: F.filter(F.transform(F.split(p, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s).between(21, 299))
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > most, cut(p)).when(F.length(p) > least, F.array(p)).otherwise(F.array().cast("array<string>"))))


def chunks(docs: DataFrame, items: DataFrame, cells: DataFrame, facts: DataFrame, config: DataFrame) -> DataFrame:
    """Chunks (doc_id, layer, pos, chunk) of documents: offer and delivery first, then items, paragraphs, table rows and facts.

    Below the first two layers, of chunks with the same first 80 characters without case the first stays.
    """
    some = lambda c: F.when(~F.upper(F.trim(c)).isin("", "N/A"), F.col(c))
    offer = config.select("doc_id", F.lit(0).alias("layer"), F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("Offer: use code "), some("offer_code"), F.lit(" — "), F.coalesce("offer_desc", F.lit(""))).alias("chunk"))
    ways = config.select("doc_id", F.lit(1).alias("layer"), F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit("Delivery: available in "), some("delivery_areas"), F.coalesce(F.concat(F.lit(", free above "), some("delivery_free")), F.lit(""))).alias("chunk"))
    label = F.when((F.col("price_min") != 0) & (F.col("price_max") != 0), F.concat(F.lit("— ₹"), "price_min", F.lit("–₹"), "price_max")).when(F.col("price") != 0, F.concat(F.lit("— ₹"), "price"))
    kind = F.when(~F.lower("category").isin("", "general"), F.concat(F.lit("["), "category", F.lit("]")))
    about = F.when(F.col("description") != "", F.concat(F.lit("("), "description", F.lit(")")))
    listed = items.where("trim(name) <> ''").select("doc_id", F.lit(2).alias("layer"), F.col("pos").cast("bigint").alias("pos"), F.concat_ws(" ", F.trim("name"), kind, label, about).alias("chunk"))
    prose = docs.select("doc_id", F.lit(3).alias("layer"), F.posexplode(pieces(F.col("text"))).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("bigint"))
    full = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != "")
    joined = F.when(F.size("c") == 2, F.array_join("c", " — ")).when(F.size("c") == 3, F.concat(F.get("c", F.lit(0)), F.lit(" — "), F.get("c", F.lit(1)), F.lit(" / "), F.get("c", F.lit(2)))).otherwise(F.array_join("c", " | "))
    at = (F.col("tbl") * 1_000_000_000 + F.col("row")).cast("bigint").alias("pos")
    rows = cells.withColumn("c", full).where("size(c) > 0").select("doc_id", F.lit(4).alias("layer"), at, joined.alias("chunk"))
    known = facts.select("doc_id", F.lit(5).alias("layer"), at, F.concat_ws(" — ", "label", "detail").alias("chunk"))
    body = listed.unionByName(prose).unionByName(rows).unionByName(known).withColumn("chunk", F.trim("chunk"))
    w = Window.partitionBy("doc_id", F.lower(F.left("chunk", F.lit(80)))).orderBy("layer", "pos")
    body = body.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return offer.unionByName(ways).where("chunk is not null").unionByName(body)


# Registered queries: price tables and price lists of the items, and documents with an address block.

_NAMED = "concat(upper(left(name, 1)), substring(name, 2))"
_LINE = """case item_pos % 7 when 0 then concat(name, ' Rs. ', price) when 1 then concat(name, ' ₹', price, ' - ₹', price + 100) when 2 then concat(name, ' ', item_pos, ' | ', price)
        when 3 then concat(name, ' x', size, ' | Rs ', price, ' - ', price + size) when 4 then concat(name, ' no', size, '₹', price) when 5 then concat(category, ' PLATES') else concat(name, ' 3') end"""
#: Ten items make a table; every fourth table has its own form.
_CELLS = """case tbl % 4 when 0 then array(brand, name, concat('Rs. ', price), '') when 1 then array(name, '3 hours', cast(price as string), concat('from ', size))
  when 2 then array(name, concat(price, ' - ', price + size), concat('in ', size, ' days'), category) else array(concat(name, ' ', row), if(size % 2 = 0, concat('₹', size), 'ask'), category, concat('₹', price)) end"""
_HEAD = "case tbl % 4 when 0 then array('Brand', 'Item name', 'Price', 'Notes') when 1 then array('Name', 'Lasting', 'x', 'More') when 2 then array('Product', 'Rate', 'Details', 'Kind') else array('1', '2', '3', '4') end"
_BLOCK = """concat(text, '\n\n', case doc_id % 5 when 0 then 'Located at 12 Main Road, Kochi 682001' when 1 then 'Near the old bridge, Thrissur 680020' else 'No place' end, '\nPhone: ', case doc_id % 3 when 0 then '+91 98470 12345' when 1 then '098470-12345 or 98470 12345' else 'none' end,
  '\n', case doc_id % 4 when 0 then 'Mon - Sat: 9 AM to 8:30 PM' when 1 then 'open 10 AM - 6 PM' when 2 then 'Sunday: 10 AM till 1 PM' else '' end, '\n', case doc_id % 7 when 0 then 'Offer code FIRST10 - 10% off for all' when 1 then 'use coupon welcome now and here' else 'Cash or UPI' end,
  '\n', case doc_id % 6 when 0 then 'Free Delivery Above Rs. 500' when 1 then 'Delivery Zone Kerala and Goa.' when 2 then 'Delivery Time 45 minutes.' else 'Delivery Charge Below Rs. 300 Rs. 40' end)"""


def _cells(s, d):
    """Tables of ten items with a header and, in places, headings; each shop has one-row tables, too."""
    i = t.items(s, d).selectExpr("slug as doc_id", "item_pos", "item_pos div 100 as tbl", "item_pos % 100 as row", "brand", f"{_NAMED} as name", "price", "size", "category")
    rows = i.selectExpr("doc_id", "tbl", "row", f"{_CELLS} as cells")
    heads = i.select("doc_id", "tbl").distinct().selectExpr("doc_id", "tbl", "-1L as row", f"{_HEAD} as cells")
    titles = i.select("doc_id", "tbl").distinct().where("tbl % 3 = 0").selectExpr("doc_id", "tbl", "-2L as row", "array(if(tbl % 2 = 0, 'FINE GOODS', 'PRICE CATALOGUE'), '', '', '') as cells")
    inner = i.where("size % 10 = 3").selectExpr("doc_id", "tbl", "row + 1000 as row", "if(tbl % 4 = 0, array('', concat(category, ' SECTION'), '', ''), array(concat(category, ' SECTION'), '', '', '')) as cells")
    facts = i.where("size % 10 = 4").selectExpr("doc_id", "tbl", "row + 2000 as row", "if(tbl % 4 = 0, array('', 'Loyalty Card', concat('visit ', size), ''), array('Loyalty Card', concat('visit ', size), '', '')) as cells")
    single = i.where("size = 20").selectExpr("doc_id", "100000 + item_pos as tbl", "0L as row", "array(name, concat('made by ', brand)) as cells")
    return rows.unionByName(heads).unionByName(titles).unionByName(inner).unionByName(facts).unionByName(single)


def _priced(s, d):
    """Items of a shop as lines of a price list, with headings."""
    return t.items(s, d).selectExpr("slug", "item_pos", f"{_NAMED} as name", "price", "size", "category").selectExpr("slug", "item_pos", f"{_LINE} as text")


def _documents(s, d):
    return t.read(s, d, "documents").selectExpr("doc_id", f"{_BLOCK} as text")


def _merged(s, d, rows=None):
    tables = table_items(_cells(s, d) if rows is None else rows).withColumn("pos", F.col("tbl") * 10_000 + F.col("row"))
    lines = items_from_lines(_priced(s, d), "slug", ["item_pos"]).withColumnsRenamed({"slug": "doc_id", "item_pos": "pos"})
    return merged_items(tables, lines)


def _shop_docs(s, d):
    """The address blocks of all documents; those with a shop's number are the shop's."""
    return _documents(s, d).selectExpr("concat('shop-', doc_id) as doc_id", "text")


def gen_shop_info(s, d):
    rows = laid_out(_cells(s, d))
    info = shop_info(metadata(_shop_docs(s, d)), _merged(s, d, rows), table_facts(rows))
    return info.select(*[c for c in info.columns if c not in ("items", "facts")], F.size("items").alias("n_items"), F.size("facts").alias("n_facts"), F.array_join(F.transform("items", lambda v: v["name"]), "|").alias("names"), F.array_join(F.transform("facts", lambda v: v["detail"]), "|").alias("details"))


def agg_extraction(s, d):
    """Extraction report of each document: pages, tables, rows, items by source, facts, and the fields still missing."""
    pages = t.read(s, d, "pages").selectExpr("concat('shop-', page_id % 50) as doc_id", "page_id div 50 as page", "html as text")
    rows = laid_out(_cells(s, d))
    return extraction_report(metadata(_shop_docs(s, d)), rows, _merged(s, d, rows), table_facts(rows), pages)


def extraction_report(meta: DataFrame, cells: DataFrame, items: DataFrame, facts: DataFrame, pages: DataFrame, required: tuple = ("phones", "email", "hours", "location", "city", "payment", "offer_code")) -> DataFrame:
    """Per document (doc_id): pages (doc_id, page, text) and their characters, tables, rows, items of tables and of lines, facts, and the required fields not found."""
    absent = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) == "", F.lit(c)) for c in required])), ",")
    out = meta.select("doc_id", absent.alias("missing"))
    parts = [
        pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.sum(F.length("text")).alias("chars")),
        cells.groupBy("doc_id").agg(F.countDistinct("tbl").alias("tables"), F.count(F.lit(1)).alias("rows")),
        items.groupBy("doc_id").agg(F.count_if(F.col("layer") == 0).alias("from_tables"), F.count_if(F.col("layer") == 1).alias("from_lines")),
        facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("facts")),
    ]
    for p in parts:
        out = out.join(p, "doc_id", "left")
    return out.na.fill(0, ["pages", "chars", "tables", "rows", "from_tables", "from_lines", "facts"])


def _chunk_sources(s, d):
    rows = laid_out(_cells(s, d))
    items = table_items(rows).withColumn("pos", F.col("tbl") * 10_000 + F.col("row"))
    shop = _documents(s, d).selectExpr("concat('doc-', doc_id) as doc_id", "text")
    config = metadata(shop).select("doc_id", "offer_code", "offer_desc", "delivery_areas", "delivery_free")
    return chunks(shop, items, rows.select("doc_id", "tbl", "row", "cells"), table_facts(rows), scratch.table(config, "chunk-config"))


QUERIES = {
    "gen_items_table": lambda s, d: table_items(_cells(s, d)),
    "gen_facts_table": lambda s, d: table_facts(_cells(s, d)),
    "gen_items_text": lambda s, d: items_from_lines(_priced(s, d), "slug", ["item_pos"]),
    "gen_metadata": lambda s, d: metadata(_documents(s, d)),
    "gen_shop_info": gen_shop_info,
    "agg_extraction": agg_extraction,
    "gen_chunks": _chunk_sources,
}

def _words(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _duck(expression: str) -> str:
    """SQL that both engines share, in DuckDB's words."""
    return expression.replace("array(", "list_value(").replace("cast(price as string)", "cast(price as varchar)").replace("if(", "if(")


_I = f"(select slug as doc_id, item_pos, item_pos // 100 as tbl, item_pos % 100 as row, brand, {_NAMED} as name, price, size, category from {t.ITEMS})"
_CELLS_SQL = f"""(select doc_id, tbl, row, {_duck(_CELLS)} as cells from {_I} union all select distinct doc_id, tbl, -1, {_duck(_HEAD)} from {_I} union all select distinct doc_id, tbl, -2, list_value(if(tbl % 2 = 0, 'FINE GOODS', 'PRICE CATALOGUE'), '', '', '') from {_I} where tbl % 3 = 0
  union all select doc_id, tbl, row + 1000, if(tbl % 4 = 0, list_value('', concat(category, ' SECTION'), '', ''), list_value(concat(category, ' SECTION'), '', '', '')) from {_I} where size % 10 = 3
  union all select doc_id, tbl, row + 2000, if(tbl % 4 = 0, list_value('', 'Loyalty Card', concat('visit ', size), ''), list_value('Loyalty Card', concat('visit ', size), '', '')) from {_I} where size % 10 = 4
  union all select doc_id, 100000 + item_pos, 0, list_value(name, concat('made by ', brand)) from {_I} where size = 20)"""
_FILL = "list_filter({0}, lambda c: trim(c) <> '')"
_ROLE = "case " + " ".join(f"when len(list_filter({_words(ws)}, lambda w: contains(lower(c), w))) > 0 then '{r}'" for r, ws in HEADERS.items()) + " end"


def _column(role: str) -> str:
    return f"list_max(list_transform(range(1, len(header) + 1), lambda i: case when roles[i] = '{role}' then i end))"


_VALID = rf"(length(name) between 3 and 80 and not regexp_matches(name, '^[~()+.,#-]') and not regexp_matches(name, '^\d[\d\s,.]*$') and not regexp_matches(lower(name), '{catalog.JUNK}'))"
_TABLES = rf"""c as (select * from {_CELLS_SQL}), k as (select *, row_number() over (partition by doc_id, tbl order by row) as r, count(*) over (partition by doc_id, tbl) as n from c),
  l0 as (select doc_id, tbl, max(n) as n, max(cells) filter (r = 1) as one, max(cells) filter (r = 2) as two from k group by doc_id, tbl), l1 as (select *, n > 1 and len({_FILL.format('one')}) = 1 and regexp_matches({_FILL.format('one')}[1], '{catalog.HEADING}') as titled from l0),
  l2 as (select doc_id, tbl, n, titled, case when titled then two else one end as header, case when titled then 2 else 1 end as start from l1), l3 as (select *, list_transform(header, lambda c: {_ROLE}) as roles from l2),
  l4 as (select *, coalesce({_column('name')}, 1) as name_col, {_column('price')} as headed, {_column('description')} as text_col from l3),
  e as (select doc_id, tbl, row, r, unnest(cells) as cell, generate_subscripts(cells, 1) as i from k),
  sh as (select doc_id, tbl, i, count(*) as n, count(*) filter (regexp_matches(cell, '{MONEY}')) as money, count(*) filter (regexp_matches(cell, '{DURATION}')) as lasting, count(*) filter (regexp_matches(cell, '\d{{2,}}')) as digits from e join l4 using (doc_id, tbl) where r > start and l4.n > 1 and i between 2 and len(header) group by doc_id, tbl, i),
  gs as (select doc_id, tbl, coalesce(max(i) filter (money >= greatest(1, 0.3 * n)), max(i) filter (lasting <= 0.4 * n and digits > 0.4 * n)) as guessed from sh group by doc_id, tbl),
  f0 as (select k.*, titled and r = 1 as is_title, l4.n > 1 and r = start and len(list_filter(header, lambda c: regexp_matches(c, '[a-zA-Z]{{3,}}'))) > 0 as is_header, name_col, coalesce(headed, guessed) as price_col, text_col from k join l4 using (doc_id, tbl) left join gs using (doc_id, tbl)),
  f1 as (select *, trim(case when is_title then {_FILL.format('cells')}[1] else cells[name_col] end) as name, list_filter(cells, lambda c, i: i <> name_col) as others from f0),
  f2 as (select *, coalesce(is_title or (regexp_matches(name, '{catalog.HEADING}') and len(list_filter(others, lambda c: regexp_matches(c, '\d{{2,}}'))) = 0 and n > 1 and not is_header), false) as is_heading from f1),
  f3 as (select *, coalesce(last_value(case when is_heading and not list_has_any(regexp_split_to_array(upper(name), '\s+'), {_words(META_TITLES)}) then name end ignore nulls) over (partition by doc_id order by tbl, row rows between unbounded preceding and current row), 'General') as category from f2),
  dt as (select *, regexp_matches(name, '{FACT_LABELS}') or (not regexp_matches(category, '{catalog.GOODS}') and regexp_matches(category, '{catalog.OFFICE}')) as is_fact from f3 where n > 1 and not is_title and not is_header and not is_heading and length(name) >= 2)"""
_TABLE_ITEMS = f"""(with {_TABLES}, pr as ({prices_sql('select doc_id, tbl, row, i, cell from e')}),
  m as (select d.doc_id, d.tbl, d.row, d.name, d.category, trim(cells[text_col]) as about, max(p.price) filter (p.i = price_col) as op, max(p.price_min) filter (p.i = price_col) as olo, max(p.price_max) filter (p.i = price_col) as ohi, min(p.i) filter (p.i <> name_col and p.price_min is not null) as fr,
    list({{'i': p.i, 'p': p.price, 'lo': p.price_min, 'hi': p.price_max}} order by p.i) filter (p.i <> name_col) as ps from dt d join pr p using (doc_id, tbl, row) where not is_fact and {_VALID.replace('name', 'd.name')} group by all),
  q as (select *, coalesce(op, 0) <> 0 or coalesce(olo, 0) <> 0 as own, list_filter(ps, lambda v: v.p >= 5 and (fr is null or v.i < fr)) as before, list_filter(ps, lambda v: v.i = fr)[1] as span from m),
  z as (select *, case when own then op else before[len(before)].p end as p, case when own then olo else span.lo end as lo, case when own then ohi else span.hi end as hi from q),
  y as (select *, row_number() over (partition by doc_id, lower(name) order by tbl, row) as f from z where (coalesce(p, 0) <> 0 or coalesce(lo, 0) <> 0) and not coalesce(p > 0 and p < 10, false) and not coalesce(lo < 10 and (hi is null or hi < 100), false))
  select doc_id, tbl, row, name, category, case when lower(about) not in ('', 'description', 'details', 'desc') then about end as description, case when lo is null then p end as price, lo as price_min, hi as price_max from y where f = 1)"""
_TABLE_FACTS = f"""(with {_TABLES} select doc_id, tbl, row, trim(cells[1]) as label, trim({_FILL.format('cells[2:]')}[1]) as detail from k where n = 1 and len(cells) >= 2 and length(trim(cells[1])) between 1 and 60 and len({_FILL.format('cells[2:]')}) > 0
  union all select doc_id, tbl, row, name, trim({_FILL.format('others')}[1]) from dt where is_fact and len({_FILL.format('others')}) > 0)"""
_P = f"(select slug, item_pos, trim({_LINE}) as text from (select slug, item_pos, {_NAMED} as name, price, size, category from {t.ITEMS}))"


def _part(p: str, k: int) -> str:
    return f"regexp_extract(text, '{p}', {k})"


def _num(e: str) -> str:
    return f"try_cast(replace(trim({e}), ',', '') as bigint)"


_RN = [f"trim(regexp_replace(trim({_part(p, 1)}), '^[|-]+|[|-]+$', '', 'g'))" for p in RANGE_LINES]
_PN = [rf"trim(regexp_replace({_part(p, 1)}, '\s*\|.*$', ''))" for p in PRICE_LINES]
_FORMS = [(f"{_num(_part(p, 2))} between 1 and 9999999 and {_num(_part(p, 2))} < {_num(_part(p, 3))}", n, "null", _num(_part(p, 2)), _num(_part(p, 3)), f"lower({n})") for p, n in zip(RANGE_LINES, _RN)]
_FORMS += [(f"{_num(_part(p, 2))} between 5 and 9999999", n, _num(_part(p, 2)), "null", "null", rf"trim(lower(regexp_replace({n}, '\s*\(.*?\)\s*$', '')))") for p, n in zip(PRICE_LINES, _PN)]
_CASE = " ".join(f"when {ok} and {_VALID.replace('name', n)} then {{'name': {n}, 'price': cast({a} as bigint), 'lo': cast({b} as bigint), 'hi': cast({c} as bigint), 'key': {k}}}" for ok, n, a, b, c, k in _FORMS)
_LINE_ITEMS = rf"""(with r as (select *, case when regexp_matches(text, '{LINE_HEADING}') and length(text) < 50 and not regexp_matches(text, '\d{{3,}}') then trim(regexp_replace(text, '^:+|:+$', '', 'g')) end as h from {_P} where length(text) >= 4),
  g as (select *, coalesce(last_value(h ignore nulls) over (partition by slug order by item_pos rows between unbounded preceding and current row), 'General') as category from r), f as (select *, case {_CASE} end as f from g where h is null)
  select slug, item_pos, category, f.name as name, f.price as price, f.lo as price_min, f.hi as price_max from (select *, row_number() over (partition by slug, f.key order by item_pos) as n from f where f is not null) where n = 1)"""
_D = f"(select doc_id, {_BLOCK} as text from documents)"


def _get(p: str, k: int = 1, text: str = "text") -> str:
    return f"nullif(trim(regexp_extract({text}, '{p}', {k})), '')"


_PHONES = r"list_filter(list_transform(regexp_extract_all(text, '(?:\+91|\b0)?[\s-]?[6-9][\d\s-]{9,14}'), lambda v: regexp_replace(v, '\D', '', 'g')), lambda v: length(v) >= 10 and regexp_matches(right(v, 10), '^[6-9]'))"
_LAST10 = f"list_transform({_PHONES}, lambda v: right(v, 10))"
_OPENS = f"regexp_extract_all(text, '{HOURS}', 1)"
_CLOSED = f"list_filter(list_transform({_OPENS}, lambda h: {{'h': h, 'c': regexp_extract(text, '(?i)' || regexp_escape(h) || '.*?({_CLOCK})', 1)}}), lambda v: v.c <> '' and not contains(lower(v.h), lower(v.c)))[1]"
_FLAT = "replace(text, chr(10), ' ')"
_CODE, _ABOUT = _get(f"(?i){OFFER}"), f"regexp_replace(coalesce({_get(f'(?i){OFFER}', 2)}, ''), '[-–—: ]+$', '')"
_CODED = rf"(upper({_CODE}) = {_CODE} or regexp_matches({_CODE}, '\d'))"
_FIRST8 = "list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(v)), lambda v: v <> '')[1:8]"
_META = rf"""(select doc_id, array_to_string(list_transform(list_filter({_LAST10}, lambda v, i: list_position({_LAST10}, v) = i), lambda v: '+91 ' || left(v, 5) || ' ' || right(v, 5)), ',') as phones, {_get(r'([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,})')} as email,
  {_get(r'((?:https?://|www\.)[\w.-]+\.[a-z]{2,})')} as website, coalesce({_CLOSED}.h || ' - ' || {_CLOSED}.c, {_OPENS}[1], {_get(rf'(?i)({_CLOCK}\s*[-–to]+\s*{_CLOCK})')}) as hours, 'Sunday: ' || {_get(r'(?i)Sunday[\s:]+(.{5,50}?(?:AM|PM)[^\n]*)')} as sunday,
  regexp_replace(coalesce(nullif(regexp_extract({_FLAT}, '{ADDRESS}', 1), ''), nullif(regexp_extract({_FLAT}, '{PIN_ADDRESS}', 1), '')), '\s+', ' ', 'g') as location, {_get(rf"\b({'|'.join(CITIES)})\b")} as city, {_get(rf"\b({'|'.join(STATES)})\b")} as state,
  concat_ws(',', {', '.join(f"case when regexp_matches(text, '(?i){p}') then '{k}' end" for k, p in PAYMENTS.items())}) as payment, case when {_CODED} then {_CODE} end as offer_code, case when {_CODED} then {_ABOUT} end as offer_desc,
  list_filter({_FIRST8}, lambda v: not regexp_matches(v, '\d{{7,}}|@|www\.|http') and length(v) between 6 and 59 and left(v, 1) <> '[')[1] as shop_name, '₹' || nullif(regexp_extract(text, '(?i)Free\s+Delivery\s+Above\s+Rs\.?\s*([\d,]+)', 1), '') as delivery_free,
  '₹' || nullif(regexp_extract(text, '(?i)Delivery\s+Charge\s+Below\s+Rs\.?\s*[\d,]+\s+Rs\.?\s*([\d,]+)', 1), '') as delivery_charge, regexp_replace({_get(r'(?i)Delivery\s+Time\s+([^\n]{3,60})')}, '\.+$', '') as delivery_days, regexp_replace({_get(r'(?i)Delivery\s+Zone\s+([^\n]{3,150})')}, '\.+$', '') as delivery_areas from @documents@)"""
_ALL_META = _META.replace("@documents@", _D)
_SHOP_META = _META.replace("@documents@", f"(select 'shop-' || doc_id as doc_id, text from {_D})")
_FRAGMENT = rf"(c = '' or (left(c, 1) <> upper(left(c, 1)) and left(c, 1) = lower(left(c, 1))) or contains(c, '+') or regexp_matches(c, '(?i)\(\d+\s*members?\)') or regexp_matches(c, '{catalog.FRAGMENT}') or coalesce(coalesce(price, price_min) <= 20 and regexp_matches(c, '{catalog.DISCOUNT}'), false))"
_MERGED = rf"""(select doc_id, layer, pos, name, category, price, price_min, price_max from (select *, row_number() over (partition by doc_id, trim(lower(regexp_replace(c, '\s*\(.*?\)\s*$', ''))) order by layer, pos) as r from (select *, trim(regexp_replace(name, '\s*\|.*$', '')) as c from (
  select doc_id, 0 as layer, tbl * 10000 + row as pos, name, category, price, price_min, price_max from {_TABLE_ITEMS} union all select slug, 1, item_pos, name, category, price, price_min, price_max from {_LINE_ITEMS})) where not {_FRAGMENT} and {_VALID}) where r = 1)"""
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) between 21 and 299)"
_PIECES = f"flatten(list_transform(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p)), lambda p: case when length(p) > 200 then {_SENTENCES} when length(p) > 25 then [p] else []::varchar[] end))"
_FULL = "list_filter(list_transform(cells, lambda c: trim(c)), lambda c: c <> '')"
_CHUNK_BODY = f"""select doc_id, 2 as layer, tbl * 10000 + row as pos, concat_ws(' ', name, case when lower(category) not in ('', 'general') then '[' || category || ']' end, case when price_min <> 0 and price_max <> 0 then '— ₹' || price_min || '–₹' || price_max when price <> 0 then '— ₹' || price end, case when description <> '' then '(' || description || ')' end) as chunk from {_TABLE_ITEMS}
  union all select 'doc-' || doc_id, 3, unnest(generate_series(0, len(ps) - 1)), unnest(ps) from (select doc_id, {_PIECES} as ps from {_D})
  union all select doc_id, 4, tbl * 1000000000 + row, case len(f) when 2 then f[1] || ' — ' || f[2] when 3 then f[1] || ' — ' || f[2] || ' / ' || f[3] else array_to_string(f, ' | ') end from (select doc_id, tbl, row, {_FULL} as f from {_CELLS_SQL}) where len(f) > 0
  union all select doc_id, 5, tbl * 1000000000 + row, label || ' — ' || detail from {_TABLE_FACTS}"""
_REQUIRED = ("phones", "email", "hours", "location", "city", "payment", "offer_code")
SQL = {
    "gen_items_table": f"select * from {_TABLE_ITEMS}",
    "gen_facts_table": f"select * from {_TABLE_FACTS}",
    "gen_items_text": f"select * from {_LINE_ITEMS}",
    "gen_metadata": f"select * from {_ALL_META}",
    "gen_shop_info": f"""select doc_id, shop_name, left(regexp_split_to_array(shop_name, '\\s+')[1], 10) as bot_name, location, city, coalesce(state, 'Kerala') as state, hours, sunday, nullif(string_split(phones, ',')[1], '') as phone, nullif(string_split(phones, ',')[1], '') as whatsapp, email, website,
        coalesce(nullif(payment, ''), 'UPI,Cash,Cards') as payment, offer_code, offer_desc, delivery_free, delivery_charge, delivery_days, delivery_areas, cast(coalesce(ni, 0) as int) as n_items, cast(coalesce(nf, 0) as int) as n_facts, coalesce(names, '') as names, coalesce(details, '') as details from {_SHOP_META}
        left join (select doc_id, count(*) as ni, string_agg(name, '|' order by layer, pos) as names from {_MERGED} group by doc_id) using (doc_id) left join (select doc_id, count(*) as nf, string_agg(detail, '|' order by tbl, row) as details from {_TABLE_FACTS} group by doc_id) using (doc_id)""",
    "agg_extraction": f"""select doc_id, concat_ws(',', {', '.join(f"case when coalesce({c}, '') = '' then '{c}' end" for c in _REQUIRED)}) as missing, coalesce(pages, 0) as pages, coalesce(chars, 0) as chars, coalesce(tables, 0) as tables, coalesce(rows, 0) as rows, coalesce(from_tables, 0) as from_tables, coalesce(from_lines, 0) as from_lines, coalesce(facts, 0) as facts from {_SHOP_META}
        left join (select 'shop-' || page_id % 50 as doc_id, count(*) as pages, cast(sum(length(html)) as bigint) as chars from pages group by all) using (doc_id)
        left join (select doc_id, count(distinct tbl) as tables, count(*) as rows from {_CELLS_SQL} group by doc_id) using (doc_id) left join (select doc_id, count(*) filter (layer = 0) as from_tables, count(*) filter (layer = 1) as from_lines from {_MERGED} group by doc_id) using (doc_id)
        left join (select doc_id, count(*) as facts from {_TABLE_FACTS} group by doc_id) using (doc_id)""",
    "gen_chunks": f"""with m as (select * from {_ALL_META}) select 'doc-' || doc_id as doc_id, cast(0 as int) as layer, cast(0 as bigint) as pos, 'Offer: use code ' || offer_code || ' — ' || coalesce(offer_desc, '') as chunk from m where upper(trim(offer_code)) not in ('', 'N/A')
        union all select 'doc-' || doc_id, 1, 0, 'Delivery: available in ' || delivery_areas || coalesce(', free above ' || delivery_free, '') from m where upper(trim(delivery_areas)) not in ('', 'N/A')
        union all select doc_id, layer, pos, chunk from (select doc_id, layer, pos, trim(chunk) as chunk, row_number() over (partition by doc_id, lower(left(trim(chunk), 80)) order by layer, pos) as r from ({_CHUNK_BODY})) where r = 1""",
}
