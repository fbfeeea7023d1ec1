"""The whole job against brute force: cases that candidate keys, prefixes or bounds once left out."""

import random
import re

import numpy as np
from bazaarflow.functions import ratio
from bazaarflow.operators import items, match
from bazaarflow.operators import messages as m
from bazaarflow.plans import registry, vectors
from bazaarflow.plans import tables as t
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def best(asked, texts, least):
    """(position, ratio) by comparing all."""
    out = []
    for a in asked:
        scores = [round(ratio.token_set(a, b) + 1e-12, 4) for b in texts]
        k = max(range(len(texts)), key=lambda i: (scores[i], -i)) if texts else -1
        out.append((k, scores[k]) if k >= 0 and scores[k] >= least else (-1, 0.0))
    return out


def test_best_token_set_equals_brute_force():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 6)))
    text = lambda: " ".join(word() for _ in range(r.randrange(6)))
    for least in (40.0, 70.0):
        for _ in range(60):
            asked, texts = [text() for _ in range(8)], [text() for _ in range(r.randrange(25))]
            assert ratio.best_token_set(asked, texts, least) == best(asked, texts, least)


def test_faq_fuzzy_without_a_common_word(spark):
    asks = spark.createDataFrame([(1, "s", "xbiryani"), (2, "s", None), (3, "z", "xbiryani")], "msg_id long, slug string, message string")
    faqs = spark.createDataFrame([(7, "s", "rice", ["biryani", " "]), (8, "s", "price list", None), (9, "s", None, []), (6, "u", "xbiryani", None)], "faq_pos long, slug string, q string, variants array<string>")
    for block in (2000, 1):
        assert [tuple(x) for x in match.faq_fuzzy(asks, faqs, block=block).select("msg_id", "faq_pos", "score").collect()] == [(1, 7, 93.3333)]


def phrases_of(f):
    return [v.strip() for v in (f.q, *(f.variants or [])) if v and v.strip()]


def test_registered_fuzzy_match_covers_all_messages_and_faqs(spark):
    messages, faqs = t.messages(spark, SF).collect(), sorted(t.phrased(spark, SF).collect(), key=lambda f: f.faq_pos)
    want = {}
    for slug in {x.slug for x in messages}:
        asks = [x for x in messages if x.slug == slug]
        own = [(f.faq_pos, p) for f in faqs if f.slug == slug for p in phrases_of(f)]
        found = best([a.message.lower() for a in asks], [p.lower() for _, p in own], match.FUZZY_LEAST)
        want |= {a.msg_id: (own[k][0], score) for a, (k, score) in zip(asks, found) if k >= 0}
    got = registry.queries()["jn_faq_fuzzy"](spark, SF).collect()
    assert {x.msg_id: (x.faq_pos, x.score) for x in got} == want and len(want) > 20


def test_f1_by_rarest_words_equals_all_pairs(spark):
    """No pair of an F1 from the threshold on is lost by the prefixes, at any threshold."""
    r = random.Random(8)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice([4, 26])]) * r.randrange(1, 3)
    text = lambda: " ".join(word() for _ in range(r.randrange(1, 12)))
    asks = [(i, f"s{i % 2}", text()) for i in range(80)]
    faqs = [(i, f"s{i % 2}", text(), [text() for _ in range(r.randrange(3))]) for i in range(60)]

    def f1(a, b):
        a, b = set(a.split()), set(b.split())
        return round(2 * len(a & b) / (len(a) + len(b)) + 1e-12, 4)

    m = spark.createDataFrame(asks, "msg_id long, slug string, message string")
    f = spark.createDataFrame(faqs, "faq_pos long, slug string, q string, variants array<string>")
    for least in (0.2, 0.45, 0.8):
        want = {}
        for i, slug, message in asks:
            scores = [(max(f1(message, p) for p in [q, *v]), -pos) for pos, s, q, v in faqs if s == slug]
            score, pos = max(scores)
            if score >= least:
                want[i] = (-pos, score)
        got = {x.msg_id: (x.faq_pos, x.score) for x in match.faq_f1(m, f, least).collect()}
        assert got == want


def test_vectors_in_blocks_equal_one_product(spark):
    import numpy as np

    r = np.random.default_rng(3)
    v = r.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, f"k{i % 2}", v[i].tolist()) for i in range(40)], "r long, key string, rv array<double>")
    asked = spark.createDataFrame([(i, f"k{i % 2}", v[i].tolist()) for i in range(0, 40, 3)], "q long, key string, qv array<double>")
    want = {(i, j) for i in range(0, 40, 3) for j in sorted((j for j in range(40) if j % 2 == i % 2), key=lambda j: (-round(float(v[i] @ v[j]), 4), j))[:4]}
    for block in (2000, 3):
        assert {(x.q, x.r) for x in match.vector_top(asked, rows, "key", 4, -1.0, block).collect()} == want


def known(word, terms):
    stem = lambda v: len(v) >= 4 and word[:4] == v[:4] and v in word
    near = lambda v: len(word) >= 5 and len(v) >= 5 and word[0] == v[0] and ratio.indel(word, v) >= 65
    return any(word in v or stem(v) or near(v) for v in terms)


def test_unknown_items_against_brute_force(spark):
    r = random.Random(4)
    fixed = {"wax": "waxing", "ing": "waxing", "axi": "waxing", "abcdzzz": "abcdyyyyyyyy", "abcdefgh": "abcdefghijklmn", "azbycxdw": "abcdefghijklmn", "threadings": "threading", "cat": "category"}
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(3, 15)))
    terms = sorted({*fixed.values(), *(word() for _ in range(12)), "ab"})
    asks = [*fixed, *(word() for _ in range(150))]
    got = m.unknown_items(
        spark.createDataFrame([(i, "s", w) for i, w in enumerate(asks)], "msg_id int, slug string, message string"), spark.createDataFrame([("s", v) for v in terms] + [("u", "laptop")], "slug string, term string"), [], ratio.spelling_variant
    )
    assert {x.msg_id: x.unknown for x in got.collect()} == {i: not known(w, terms) for i, w in enumerate(asks)}


def test_cascade_against_plain_python(spark):
    """The registered cascade: each message's pass and score from the passes' own results, put together by hand."""
    i = match.cascade_inputs(spark, SF)
    m = {x.msg_id: x for x in i["messages"].collect()}
    got = {x.msg_id: x for x in match.match_cascade(**i).collect()}
    frame = i["messages"]
    lists = {x.msg_id for x in items.category_lists(frame.where("not greeting"), i["items"]).collect()}
    vectors = {x.msg_id: x for x in match.faq_vector(frame, i["embedded"], i["vocabulary"]).collect()}
    answers = {x.msg_id for x in items.item_answers(frame, i["items"], i["generic"], broad=frame["broad"]).collect()}
    pool, types = i["pool"].collect(), ("bakery",)

    def generic(x):
        own = [f for f in pool if f.lang == x.lang and (f.shop_types is None or "all" in f.shop_types or x.shop_type in f.shop_types) and (x.bad or not f.mood)]
        own.sort(key=lambda f: (not f.mood, f.faq_pos))
        dot = lambda f: round(float(sum(a * b for a, b in zip(x.vec, f.vec))), 4)
        part = [f for f in own if x.intent and x.intent in f.section.lower()]
        for n, some in ((5, part), (6, own)):
            scored = [(dot(f), -k) for k, f in enumerate(some)]
            if scored and max(scored)[0] >= match.GENERIC_LEAST:
                return n, max(scored)[0]
        phrases = [p for f in own for p in phrases_of(f)]
        k, score = best([x.message.lower()], [p.lower() for p in phrases], match.FUZZY_LEAST)[0]
        if k >= 0:
            return 7, round(score / 100, 4)
        words = lambda text: set(re.findall(r"\w+", text.lower()))
        f1 = max((2 * len(words(x.message) & words(p)) / (len(words(x.message)) + len(words(p))) for p in phrases if words(p)), default=0)
        return (8, round(f1, 4)) if f1 >= match.F1_LEAST else None

    seen = set()
    for k, x in m.items():
        asks = x.item_ask and not x.greeting and not x.broad
        v, a = vectors.get(k), k in answers and not x.about and (asks or x.full)
        weak = match.WIN_MANGLISH if x.lang == "manglish" else match.WIN_ENGLISH
        if k in lists:
            want = (1, 1.0)
        elif v:
            want = (3, 1.0) if asks and a and v.score < weak else (2, v.score)
        elif a and asks:
            want = (3, 1.0)
        elif a:
            want = (4, 0.9)
        else:
            want = None if x.item_intent else generic(x)
        assert (want is None) == (k not in got), (k, want)
        if want:
            assert got[k].pass_no == want[0] and abs(got[k].score - want[1]) < 2e-4, (k, want, got[k])
            seen.add(want[0])
    assert {1, 2, 3} <= seen and types


def test_router_through_the_cascade(spark):
    """What guards caught stays as it was; of the rest, the cascade's answers that pass the gate, told by hand, and no others."""
    i, texts = match.cascade_inputs(spark, SF), {(x.pool, x.faq_pos): x for x in match.cascade_texts(spark, SF).collect()}
    got = {x.msg_id: x for x in registry.queries()["rte_cascade"](spark, SF).collect()}
    plain = {x.msg_id: x for x in registry.queries()["rte_pipeline"](spark, SF).collect()}
    asked = {x.msg_id: x for x in i["messages"].collect()}
    assert set(got) == set(asked) and set(plain) <= set(got)
    open_ = {"match", "chunk", "free"}
    columns = ["route", "source", "bypass", "sentiment", "confidence", "faq_source", "faq_id", "faq_score", "escalate", "lang"]
    caught = [k for k, x in plain.items() if x.route not in open_ and got[k].route not in open_]
    assert len(caught) > 5 and all(got[k][c] == plain[k][c] for k in caught for c in columns)
    left = spark.createDataFrame([(k, x.lang) for k, x in got.items() if x.route in open_], "msg_id long, lang string")
    hits = {x.msg_id: x for x in match.match_cascade(**(i | {"messages": i["messages"].drop("lang").join(left, "msg_id")})).collect()}
    words = lambda text: {w for w in re.findall(r"[^\W]+", text.lower())}
    kinds = set()
    for k in (x.msg_id for x in left.collect()):
        h, x = hits.get(k), got[k]
        if h is not None and h.source not in ("category_list", "item_lookup", "item_lookup_fallback"):
            f = texts["shop" if h.pass_no == 2 else "generic", h.faq_pos]
            content = {w for w in words(asked[k].message) if len(w) >= 3 and w not in match.STOP}
            passes = h.score >= (match.GATE_MANGLISH if x.lang == "manglish" else match.GATE_ENGLISH) and (h.score >= match.SURE or not content or bool(content & words(f.faq_text)))
            want = (h.source, f"faq_{h.faq_pos}", h.score, f.answer, f.escalate) if passes else None
        else:
            want = (h.source, h.source, h.score, h.reply, False) if h is not None else None
        assert (x.route == "match") == (want is not None), (k, x, h)
        if want:
            assert (x.faq_source, x.faq_id, x.faq_score, x.reply, x.escalate, x.source) == (*want, "faq"), (k, x, h)
            kinds.add(h.pass_no)
        else:
            assert x.reply is None and x.pass_no is None
    assert len(kinds) >= 3


# the inverted file of vectors


def clustered(r, n, spread=0.6, dims=16):
    heads = r.normal(size=(12, dims))
    v = heads[r.integers(0, 12, n)] + spread * r.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_index_search_is_exact_and_skips_lists(spark):
    r = np.random.default_rng(3)
    v, q = clustered(r, 1500, 0.15), clustered(r, 60, 0.15)
    q[:30] = v[:30]
    rows = spark.createDataFrame([(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(v)], "r long, key string, rv array<double>")
    asked = spark.createDataFrame([(i, "abc"[i % 3], x.tolist()) for i, x in enumerate(q)], "q long, key string, qv array<double>")
    for options in ({}, {"lists": 1}, {"block": 50, "sample": 100}):
        index = vectors.build(rows, "key", **options)
        assert index.rows.count() == 1500
        got = vectors.search(index, asked, "key", 4, 0.2).collect()
        want = {(x.q, x.r) for x in match.vector_top(asked, rows, "key", 4, 0.2).collect()}
        assert {(x.q, x.r) for x in got} == want and len(want) > 100
        compared = sum({x.q: x.compared for x in got}.values())
    assert compared < 40 * 750
    assert vectors.search(vectors.build(rows.limit(0), "key"), asked, "key", 4).count() == 0


def test_recall_of_few_probes(spark):
    """Lists of the hard, almost even vectors of the given table, and of clustered ones: recall of at least 0.9 and what it costs."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.lit("all").alias("key"), "vec_id", "embedding")
    rows, asked = e.selectExpr("vec_id as r", "key", "embedding as rv"), e.where("vec_id % 20 = 0").selectExpr("vec_id as q", "key", "embedding as qv")
    want = {(x.q, x.r) for x in match.vector_top(asked, rows, "key", 5, -1.0).collect()}
    index = vectors.build(rows, "key")
    got = vectors.search(index, asked, "key", 5, probes=28, exact=False).collect()
    assert len({(x.q, x.r) for x in got} & want) >= 0.9 * len(want)
    assert sum({x.q: x.compared for x in got}.values()) < 0.7 * 100 * 2000
