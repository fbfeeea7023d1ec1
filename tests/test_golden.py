"""Worked examples of the scalar functions, classifiers, matching and files."""

import json

import pytest
from pyspark.sql import functions as F

from bazaarflow.functions import ratio
from bazaarflow.functions import text as x
from bazaarflow.operators import extract, faq, items, match
from bazaarflow.operators import messages as m
from bazaarflow.sources import files


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("text", [" beaty - beat ", "beaty---beat", "beaty_beat"])
def test_slug(spark, text):
    assert one(spark, x.slug(F.col("t")), t=text) == "beaty-beat"


@pytest.mark.parametrize(("text", "n"), [("3,500", 3500), ("2,50,000", 250000), ("x1", None), ("", None)])
def test_number(spark, text, n):
    assert one(spark, x.indian_number(F.col("t")), t=text) == n


@pytest.mark.parametrize(("cell", "want"), [("Rs. 3,500", (3500, None, None)), ("Rs. 40,000 - Rs. 80,000", (None, 40000, 80000)), ("KL-KZD-PH-2005-0482", (None, None, None)), ("₹80–₹40", (None, 40, 80)), ("", (None, None, None)), ("Rs. 500 (pre-order) 400", (500, None, None)), ("Rs. 100 200 300", (None, 100, 200)), ("Rs. 100 - 100", (100, None, None)), ("500 Rupees", (500, None, None)), ("0 - 90", (90, None, None))])
def test_prices(spark, cell, want):
    assert tuple(one(spark, x.prices(F.col("c")), c=cell)) == want


@pytest.mark.parametrize(("a", "b", "r"), [("biriyani", "biryani", 93.3), ("jewellery", "jewelry", 87.5), ("colour", "color", 90.9), ("centre", "center", 83.3), ("paneer", "panir", 72.7), ("hair", "chair", 88.9)])
def test_indel(a, b, r):
    assert round(ratio.indel(a, b), 1) == r


@pytest.mark.parametrize(("a", "b", "same"), [("biriyani", "biryani", True), ("hair", "chair", False), ("wax", "tax", False), ("colour", "color", True)])
def test_spelling_variant(spark, a, b, same):
    assert one(spark, ratio.spelling_variant(F.col("a"), F.col("b")), a=a, b=b) is same


def test_token_set():
    assert ratio.token_set("", "a") == 0 and ratio.token_set("a b", "b a c") == 100
    assert ratio.token_set("ab cd", "ab ce") == max(ratio.indel("ab cd", "ab ce"), ratio.indel("ab", "ab cd"))


def test_subsequence_by_table():
    import random

    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert ratio.common_subsequence(a, b) == table[-1][-1]


@pytest.mark.parametrize(("text", "want"), [("another sentence", False), ("piano video photo villa", False), ("shop evide aanu?", True), ("undo undaakumo", True), ("evideo", True)])
def test_manglish(spark, text, want):
    assert one(spark, m.is_manglish(F.col("t"), ["evide", "aanu", "undaakum"], ["undo"], []), t=text) is want


def test_stem_keeps_three_letters(spark):
    assert one(spark, F.transform(F.split("t", " "), x.stem), t="things ring stations es bus dishes") == ["thing", "ring", "station", "es", "bus", "dish"]


def test_placeholders(spark):
    values = x.lit_map({"a": "1", "b": "N/A"})
    assert one(spark, x.fill_placeholders(F.col("t"), values, {"b": "two"}), t="{a} {b} {c} {a}") == "1 two [c] 1"
    assert one(spark, x.format_map(F.col("t"), values), t="{a} {c}") == "{a} {c}"


def test_sessions_do_not_mix(spark):
    rows = spark.createDataFrame([("s", 1, 0, 1, "in english"), ("s", 2, 1, 2, "hello"), ("s", 1, 2, 3, "hello")], "slug string, session_id int, turn int, msg_id int, message string")
    pref = F.when(F.col("message") == "in english", "english")
    got = {r.msg_id: (r.held, r.lang) for r in m.sticky_language(rows, pref, F.lit("manglish")).collect()}
    assert got == {1: (None, "english"), 2: (None, "manglish"), 3: ("english", "english")}


def test_nan_is_not_in_banana(spark):
    rows = spark.createDataFrame([("s", 1, "Banana Milkshake", "drinks", None), ("s", 2, "Butter Nan", "breads", None)], "slug string, item_pos int, name string, category string, description string")
    asks = spark.createDataFrame([(1, "s", "nan undo")], "msg_id int, slug string, message string")
    assert [(r.item_pos, r.score) for r in items.matching_items(asks, rows, None, ["undo"]).collect()] == [(2, 3.0)]


def test_pair_in_order(spark):
    schema = "shop_type string, category string, pos int, question string"
    e = spark.createDataFrame([("t", "a", 1, "e1"), ("t", "a", 2, "e2"), ("t", "b", 3, "e3")], schema)
    o = spark.createDataFrame([("t", "a", 5, "m1"), ("t", "b", 6, "m3"), ("t", "b", 7, "m4")], schema)
    assert sorted((r.question, r.q_ml) for r in faq.pair_in_order(e, o).collect()) == [("e1", "m1"), ("e2", None), ("e3", "m3")]


def test_upsert_is_idempotent(spark):
    schema = "slug string, pos int, q string, a string"
    old = spark.createDataFrame([("s", i, f"question {i}", "old") for i in range(230)] + [("s", 900, "", "bare")], schema)
    new = spark.createDataFrame([("s", 1, "QUESTION 7", "new")], schema)
    got = faq.upsert(old, new)
    again = faq.upsert(got.drop("layer"), new)
    assert got.count() == again.count() == 231
    assert got.where("q = 'question 7'").first().a == "new"


def test_table_columns_by_content(spark):
    rows = spark.createDataFrame([("d", 1, 0, ["Dish", "Cost here"]), ("d", 1, 1, ["Masala Dosa", "₹80"]), ("d", 2, 0, ["x", "y"]), ("d", 2, 1, ["Idli Plate", "Rs. 40"]), ("d", 3, 0, ["fact", "alone"])], "doc_id string, tbl int, row int, cells array<string>")
    assert sorted((r.name, r.price) for r in extract.table_items(rows).collect()) == [("Idli Plate", 40), ("Masala Dosa", 80)]


def test_faq_files(spark, tmp_path):
    (tmp_path / "bakery_english.json").write_text('﻿{"faqs": [{"category": "c", "question": "q1", "answer": "a1"}, {"category": "c", "questions": ["q2", "q3"], "answer": "a2"},]}')
    (tmp_path / "salon_manglish.json").write_text(json.dumps([{"q": "q4", "a": "a4"}]))
    (tmp_path / "bad_english.json").write_text("{")
    got = sorted((r.shop_type, r.lang, r.question, r.answer, r.from_list) for r in files.read_faq_packs(spark, str(tmp_path), {"salon": "beauty"}).collect())
    assert got == [("bakery", "english", "q1", "a1", False), ("bakery", "english", "q2", "a2", True), ("beauty", "manglish", "q4", "a4", False)]


def test_shop_files(spark, tmp_path):
    for slug in ("a", "b"):
        (tmp_path / slug).mkdir()
        (tmp_path / slug / "items.json").write_text(json.dumps([{"name": f"{slug}1", "price": 5}, {"name": f"{slug}2"}]))
        (tmp_path / slug / "config.json").write_text(json.dumps({"city": "K"} if slug == "a" else {}))
    assert sorted((r.slug, r.item_pos, r.name, r.price) for r in files.read_items(spark, f"{tmp_path}/*/items.json").collect()) == [("a", 0, "a1", 5), ("a", 1, "a2", None), ("b", 0, "b1", 5), ("b", 1, "b2", None)]
    assert {r.slug: r.city for r in files.read_configs(spark, f"{tmp_path}/*/config.json", {"city": "X"}).collect()} == {"a": "K", "b": "X"}


def test_plans_have_no_cross_join(spark):
    from bazaarflow.plans import registry

    for name in ("rte_pipeline", "jn_item_score", "jn_faq_f1", "jn_chunk", "gen_variants"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_unknown_item(spark):
    asks = spark.createDataFrame([(1, "s", "biriani kittumo"), (2, "s", "laptop undo")], "msg_id int, slug string, message string")
    terms = spark.createDataFrame([("s", "biriyani"), ("s", "dosa")], "slug string, term string")
    got = {r.msg_id: r.unknown for r in m.unknown_items(asks, terms, ["kittumo", "undo"], ratio.spelling_variant).collect()}
    assert got == {1: False, 2: True}


ITEM = "slug string, item_pos int, name string, category string, description string, price bigint"


def test_phrases_of_names_in_messages(spark):
    """The name's words are looked for in the message, so a longer message word hits and a longer name does not have to."""
    rows = spark.createDataFrame([("s", 1, "Masala Dosa", "d", None, 80), ("s", 2, "Ghee Masala Dosas", "d", None, 90), ("s", 3, "Home Service Charge", "x", None, 5), ("s", 4, "a b", "x", None, 5)], ITEM)
    asks = spark.createDataFrame([(1, "s", "two masala dosas please"), (2, "s", "masala dosa"), (3, "s", "home service undo"), (4, "s", "a b"), (5, "z", "masala dosa"), (6, "s", None), (7, "s", "tikkamasala dosage")], "msg_id int, slug string, message string")
    got = items.matching_items(asks, rows, None).where("score is null").collect()
    assert sorted((x.msg_id, x.item_pos) for x in got) == [(1, 1), (1, 2), (2, 1), (3, 3), (7, 1)]


def test_generic_words_count_less_beside_others(spark):
    rows = spark.createDataFrame([("s", i, f"{v} Masala", "curries", None, 80) for i, v in enumerate(["Egg", "Fish", "Crab", "Beef", "Lamb"])] + [("s", 9, "Puri", "breads", None, 20)], ITEM)
    asks = spark.createDataFrame([(1, "s", "masala puri"), (2, "s", "masala undo"), (3, "s", "curries undo"), (4, "s", "nothing here")], "msg_id int, slug string, message string")
    from bazaarflow.operators import analytics

    got = items.matching_items(asks, rows, analytics.generic_tokens(rows)).collect()
    assert [(x.item_pos, x.score) for x in got if x.msg_id == 1] == [(9, 3.0)]
    assert sorted(x.item_pos for x in got if x.msg_id == 2) == [0, 1, 2, 3, 4]
    assert {x.score for x in got if x.msg_id == 3} == {1.8} and not [x for x in got if x.msg_id == 4]


def test_category_lists(spark):
    """``veg`` does not list Non-Veg items; a question about a service lists nothing; one item is no list."""
    rows = spark.createDataFrame([("s", 1, "Veg Biryani", "r", None, 80), ("s", 2, "Non-Veg Biryani", "r", None, 90), ("s", 3, "Veg Thali", "r", None, 70), ("s", 4, "Eyebrow Threading", "b", None, 30), ("s", 5, "Lip Threading", "b", None, 20), ("s", 6, "Facial", "b", None, 500)], ITEM)
    asks = spark.createDataFrame([(1, "s", "veg undo"), (2, "s", "all threadings"), (3, "s", "threading pain undo"), (4, "s", "facial undo"), (5, "s", "full biryani list"), (6, "s", "")], "msg_id int, slug string, message string")
    got = {x.msg_id: (x.keyword, x.n, x.first) for x in items.category_lists(asks, rows).collect()}
    assert got == {1: ("veg", 2, 1), 2: ("threading", 2, 4), 5: ("biryani", 2, 1)}


def test_table_roles(spark):
    """Hours are no price; the name decides before the price; labels and administrative sections are facts; a floor of 10."""
    cells = [(1, 0, ["Name", "3 hours", "60"]), (1, 1, ["Hair Spa", "2 hours", "60"]), (1, 2, ["Loyalty Card", "10 visits", ""]), (1, 3, ["Tip", "1 hour", "7"]), (2, 0, ["OPENING HOURS", ""]), (2, 1, ["Item", "Rate"]), (2, 2, ["Since 1999", "1999"])]
    cells += [(3, 0, ["BRIDAL SERVICES", ""]), (3, 1, ["Service charge", "Notes"]), (3, 2, ["Makeup", "from Rs. 4,000 - 6,000"]), (3, 3, ["hair spa", "Rs. 90"]), (4, 0, ["Parking", "behind the shop"])]
    df = spark.createDataFrame([("d", *c) for c in cells], "doc_id string, tbl int, row int, cells array<string>")
    got = {r.name: (r.category, r.price, r.price_min, r.price_max) for r in extract.table_items(df).collect()}
    assert got == {"Hair Spa": ("General", 60, None, None), "Makeup": ("BRIDAL SERVICES", None, 4000, 6000)}
    facts = {(r.label, r.detail) for r in extract.table_facts(df).collect()}
    assert facts == {("Loyalty Card", "10 visits"), ("Since 1999", "1999"), ("Parking", "behind the shop")}


def test_price_list_lines(spark):
    lines = ["HAIR CARE:", "Hair Cut 250", "Hair Spa Rs. 1,200 - Rs. 2,400", "Hair Cut (ladies) ₹300", "Beard | 99", "call 12", "NAIL ART", "Polish ₹80 only"]
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(lines)], "doc_id string, line int, text string")
    got = [(r.name, r.category, r.price, r.price_min, r.price_max) for r in extract.items_from_lines(df, "doc_id", ["line"]).orderBy("line").collect()]
    assert got == [("Hair Cut", "HAIR CARE", 250, None, None), ("Hair Spa", "HAIR CARE", None, 1200, 2400), ("Beard", "HAIR CARE", 99, None, None), ("call", "HAIR CARE", 12, None, None), ("Polish", "NAIL ART", 80, None, None)]


def test_routes_depend_on_order_not_on_partitions(spark):
    """The router gives the same rows for shuffled input and other partition counts, and each message once."""
    from bazaarflow.operators import message_queries as mq
    from bazaarflow.plans import tables as t

    sf = "/root/testdata/sf0.001"
    want = sorted(tuple(r) for r in mq.rte_pipeline(spark, sf).collect())
    assert len(want) == len({r[0] for r in want}) == t.messages(spark, sf).count()
    plain = t.messages
    try:
        t.messages = lambda s, d: plain(s, d).orderBy(F.xxhash64("msg_id")).repartition(7)
        assert sorted(tuple(r) for r in mq.rte_pipeline(spark, sf).collect()) == want
    finally:
        t.messages = plain


def test_switch_of_language_counts_only_if_it_is_reached(spark):
    """An earlier guard keeps a switch from counting; another session's switch does not matter; garbage is English."""
    rows = [(1, "s", 1, 0, "speak manglish"), (2, "s", 1, 1, "hello"), (3, "s", 2, 0, "hello"), (4, "s", 3, 0, "thanks, speak manglish"), (5, "s", 3, 1, "hello"), (6, "s", 1, 2, "??"), (7, "s", 1, 3, "this is a long english message")]
    messages = spark.createDataFrame(rows, "msg_id int, slug string, session_id int, turn int, message string")
    config = spark.createDataFrame([("s", "salon", ["dosa"], ["returns", "wifi"], ["fraud"], None)], "slug string, shop_type string, off_domain array<string>, blocked array<string>, active array<string>, offer_code string")
    flagged = m.flags(messages, config, m.PATTERNS, m.LEXICON, ["everything"], {"fraud": "scam"})
    got = {r.msg_id: (r.route, r.lang) for r in m.route_messages(messages, flagged, F.lit("english"), F.lit("manglish")).collect()}
    assert got == {1: ("lang_switch", "manglish"), 2: ("greeting", "manglish"), 3: ("greeting", "english"), 4: ("compliment", "english"), 5: ("greeting", "english"), 6: ("garbage", "english"), 7: ("free", "english")}


def test_guards_by_topic_and_type(spark):
    texts = ["do you exchange", "wifi here", "a masala dosa", "it is a scam", "dosa in a general shop"]
    messages = spark.createDataFrame([(i, "g" if i == 4 else "s", 1, i, v) for i, v in enumerate(texts)], "msg_id int, slug string, session_id int, turn int, message string")
    config = spark.createDataFrame([("s", "salon", ["dosa"], ["returns", "wifi"], ["fraud"], None), ("g", "general", ["dosa"], None, None, None)], "slug string, shop_type string, off_domain array<string>, blocked array<string>, active array<string>, offer_code string")
    rows = m.flags(messages, config, m.PATTERNS, m.LEXICON, ["everything"], {"fraud": "scam"}).orderBy("msg_id").collect()
    assert [r.blocked for r in rows] == [True, True, False, False, False]
    assert [r.off_domain for r in rows] == [False, False, True, False, False]
    assert [(r.escalate, bool(r.urgent)) for r in rows][3] == (True, True)


def test_uploads(spark):
    rows = spark.createDataFrame([("a", '{"bot_name": 1, "shop_name": 1, "contact": 1, "hours": 1, "escalate": 1}'), ("b", "{}"), ("c", "[1]"), ("d", "x")], "slug string, value string")
    got = {r.slug: r.reason for r in faq.checked_configs(rows).collect()}
    assert got["a"] is None and got["b"] == "missing: bot_name,shop_name,contact,hours,escalate" and got["c"] == got["d"] == "no JSON object"
    good, bad = faq.split_checked(faq.checked_configs(rows))
    assert good.count() == 1 and bad.count() == 3
