"""The whole rules on labels, names, intents, topics and item questions."""

import pytest
from bazaarflow.functions import text as x
from bazaarflow.operators import catalog, extract, faq, messages
from pyspark.sql import functions as F


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("r")).first().r


TABLE = [
    ("Item", "Price"), ("Seating Capacity", "40"), ("Emergency Phone", "98470 12345"), ("EMI", "12 months"), ("FSSAI License", "11320001000123"), ("Head Chef", "Anil, 25 years"), ("Phone (Office)", "0487 2345678"), ("Breakfast (Sunday)", "120"),
    ("Owner/Director", "Mini 50"), ("Senior   Citizen", "10 off"), ("Delivery Areas", "20 km"), ("Masala Dosa", "80"), ("Ghee Roast", "Rs. 110"), ("Traditional recipe of 1970", "70"), ("Catering for 50", "900"), ("Seating Plan", "60"),
]


def test_rows_that_are_facts_are_no_items(spark):
    cells = spark.createDataFrame([("d", 0, n, list(r)) for n, r in enumerate(TABLE)], "doc_id string, tbl long, row long, cells array<string>")
    assert {r.name: r.price for r in extract.table_items(cells).collect()} == {"Masala Dosa": 80, "Ghee Roast": 110, "Seating Plan": 60}
    assert {r.label for r in extract.table_facts(cells).collect()} == {r[0] for r in TABLE[1:11]}


@pytest.mark.parametrize(("name", "valid"), [("Home delivery hours", False), ("breakfast (weekend)", False), ("Breakfast set", True), ("pickle + rice", False), ("Pickle", True), ("catering available", False), ("Catering tray", True), ("250 g)", False), ("GST No. 5", False), ("Traditional recipe", False), ("pieces)", False)])
def test_names_that_are_no_items(spark, name, valid):
    assert one(spark, name, catalog.valid_item) is valid


@pytest.mark.parametrize(("answer", "clean"), [("customer-inu munpu cheyyum", False), ("Njangal shop-inu vendi cheyyaam", False), ("Ivide ellam und, varu", True), ("nalla service cheyyum", False), ("Sheri —", False), ("abc", False)])
def test_broken_manglish(spark, answer, clean):
    assert one(spark, answer, faq.clean_manglish) is clean


@pytest.mark.parametrize(("message", "intent"), [("ith mosham aanu", "complaint"), ("can I schedule it", "booking"), ("bridal makeup", "services"), ("prawn curry", "food"), ("paytm?", "payment"), ("nothing of it", None)])
def test_intents_of_items_and_services(spark, message, intent):
    assert one(spark, message, lambda c: x.first_of(c, messages.ITEM_INTENTS)) == intent


@pytest.mark.parametrize(("message", "intent"), [("shop worktime?", "hours"), ("any directions", "location"), ("paytm undo", "payment"), ("hm", "general")])
def test_intents_of_faqs(spark, message, intent):
    assert one(spark, message, messages.intent) == intent


@pytest.mark.parametrize(("topic", "message", "hit"), [("order_cancel", "please cancel order 5", True), ("free_delivery", "is free shipping there", True), ("product_quality", "the stitching is bad", True), ("fashion", "new collection", True), ("clothing", "a kurta", True), ("parking", "is there parking", True), ("size", "hello", False)])
def test_blocked_topics(spark, topic, message, hit):
    assert one(spark, message, lambda c: messages.contains_listed(c, messages.keywords_of(F.array(F.lit(topic)), messages.BLOCK_WORDS))) is hit


@pytest.mark.parametrize(("kind", "message", "hit"), [("pharmacy", "a gold ring", True), ("gym", "jewellery", True), ("electronics", "one dosa", False), ("spice", "diagnosis", True), ("general", "chicken", False), ("unknown", "chicken", False)])
def test_words_foreign_to_a_shop(spark, kind, message, hit):
    assert one(spark, message, lambda c: messages.contains_listed(c, messages.foreign_words(F.lit(kind), F.lit(None).cast("array<string>"), messages.OFF_DOMAIN))) is hit


@pytest.mark.parametrize(("message", "hit"), [("thanks", True), ("thanks?", False), ("thanks ? !", False), ("thanks bro", False), ("thanks paripadikal", False), ("great service", True), ("thank you for one two three four", False)])
def test_compliments(spark, message, hit):
    assert one(spark, message, lambda c: messages.is_compliment(c, messages.PATTERNS["compliment"])) is hit


def test_questions_on_an_item(spark):
    rows = spark.createDataFrame([("s", 1, "Facial", " with steam ", 900), ("s", 2, "Wax", " ", None)], "slug string, item_pos int, name string, description string, price long")
    got = {r.id: (r.variants.split("|"), r.a) for r in faq.described_faqs(rows).collect()}
    assert got["item_facial"] == (["How much is Facial?", "Price of Facial?", "Facial vila enthu?", "Facial rate?", "Is Facial available?", "Facial undo?", "What is Facial?", "Facial enthu aanu?"], "Facial — ₹900 (with steam). WhatsApp {whatsapp} for details.")
    assert len(got["item_wax"][0]) == 6 and got["item_wax"][1] == "Wax — price on request. WhatsApp {whatsapp} for details."


def test_report_counts_pages_of_every_document(spark):
    meta = spark.createDataFrame([("a", "1", None), ("b", None, "x@y.z")], "doc_id string, phones string, email string")
    none = "doc_id string, tbl long, row long, cells array<string>"
    cells = spark.createDataFrame([("a", 0, 0, ["x"])], none)
    items = spark.createDataFrame([("a", 0), ("a", 1)], "doc_id string, layer int")
    pages = spark.createDataFrame([("a", 1, "one"), ("a", 2, None), ("b", 1, "four")], "doc_id string, page int, text string")
    got = {r.doc_id: r.asDict() for r in extract.extraction_report(meta, cells, items, cells.limit(0), pages, ("phones", "email")).collect()}
    assert (got["a"]["pages"], got["a"]["chars"], got["a"]["from_tables"], got["a"]["from_lines"], got["a"]["missing"]) == (2, 3, 1, 1, "email")
    assert (got["b"]["pages"], got["b"]["chars"], got["b"]["tables"], got["b"]["missing"]) == (1, 4, 0, "phones")
