"""Edge cases, brute force and held-out accuracy of the ten operators and the pipeline."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarflow.llm import brown_lm, chroma, common, decontamination, hashing, licenses, line_dedup, mixing, near_dedup, pii, sharding, toxicity

SF = "/root/testdata/sf0.001"
N_ODD = 14


def bench(spark, rows=((1, "quick brown fox jumps over the lazy dog and runs away"), (2, "two words"), (3, None), (4, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, 1, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "sharding": lambda s, d: sharding.shard_documents(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "brown_lm": lambda s, d: brown_lm.score_documents(d, clustered=50, classes=4, rounds=2),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
    "decontamination": lambda s, d: decontamination.contamination(d, bench(s)),
    "mixing": lambda s, d: mixing.mixed(d),
    "pii": lambda s, d: pii.find_personal_data(d),
    "near_dedup": lambda s, d: near_dedup.near_duplicates(d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    got = OPERATORS[name](spark, odd).select("doc_id").toPandas().doc_id
    assert len(got) >= N_ODD and got.isna().sum() >= 2
    assert set(got.dropna().astype(int)) == set(range(1, 12))
    if name != "mixing":
        assert len(got) == N_ODD


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).count() == 0


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# hashing


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["A b  a", None, "", "é x\ty", "a", "B" * 600_000 + " a", "b a"]
    w, at = hashing.words(*hashing.buffers(pa.array(texts)))
    of = [w[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
    assert [len(x) for x in of] == [3, 0, 0, 2, 1, 2, 2]
    assert of[0][0] == of[0][2] == of[4][0] == of[5][1] and of[0][1] == of[6][0] != of[0][0]
    sliced = hashing.words(*hashing.buffers(pa.array(texts).slice(4, 3)))[0].tolist()
    assert sliced == of[4] + of[5] + of[6]
    assert len(hashing.shingles(np.array(of[0], np.uint64), 5)) == 1


def test_minhash_estimates_jaccard():
    r = np.random.default_rng(1)
    v = hashing.random_words(1200, 99)
    hits = []
    for seed in range(30):
        m = hashing.MinHash(64, seed + 1)
        hits.append(np.mean(m.tokens(hashing.distinct(v[:1000])) == m.tokens(hashing.distinct(v[200:]))))
    assert abs(np.mean(hits) - 800 / 1200) < 0.03 and r is not None


# components


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in up if n != find(n) or any(find(m) == n for m in up if m != n)}


def test_numbered_is_gapless(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = common.numbered(rows, ["k"], [F.col("id")], "n", 5).toPandas()
    assert all(sorted(g.n) == list(range(len(g))) for _, g in got.groupby("k"))


# 1 sharding


def test_shards_are_even_and_groups_whole(spark):
    got = sharding.shard_documents(documents(spark), 6).toPandas()
    text = documents(spark).toPandas().set_index("doc_id").text
    assert all(x.text_crc32 == zlib.crc32(text[x.doc_id].encode()) and x.size_ == len(text[x.doc_id].encode()) + 8 for x in got.rename(columns={"size": "size_"}).itertuples())
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 6 and loads.max() < 1.2 * loads.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert (got.assign(text=got.doc_id.map(text)).groupby("text").shard.nunique() == 1).all()


def test_large_group_is_cut(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"other {i}") for i in range(500)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() < 40 and len(got) == 1000


def test_best_fit_decreasing_equals_one_by_one():
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randrange(1, 40) for _ in range(60)]
        histogram = sorted(collections.Counter(sizes).items())
        used, runs = sharding.best_fit_decreasing(histogram, 60)
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= s]
            k = min(fits, key=lambda k: (rooms[k], k)) if fits else len(rooms)
            rooms += [60] * (k == len(rooms))
            rooms[k] -= s
        loads = collections.Counter()
        for size, a, b, shard in runs:
            loads[shard] += size * (b - a)
        assert used == len(rooms) and [60 - x for x in rooms] == [loads[k] for k in range(used)]


# 2 toxicity


def test_toxicity_held_out(spark):
    """Rows that no label was learnt from: nine tenths of the toxic ones are caught, and clean ones are left alone."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert (held.toxic == 1).sum() > 50
    assert (held[held.toxic == 1].predicted == 1).mean() >= 0.9
    assert (held[held.toxic == 0].predicted == 1).mean() < 0.01


def test_lexicon_keeps_all_that_passes_its_test(spark):
    """Weights, tests and the calibration's sample as stated, against plain counts; a larger bound changes only the sample."""
    r = random.Random(7)
    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        words = [r.choice(["the", "of", "sea", "tree", "road"]) for _ in range(12)] + [r.choice(["grubbish", "blorken", "snarfle"]) if toxic and r.random() < 0.9 else r.choice(["calm", "mild"])]
        rows.append((i, " ".join(words), int(toxic)))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    lexicon, exceptions, _ = toxicity.learn(docs, labels)
    whole = {e: w for e, k, w in lexicon if k == 0}
    for word in ("grubbish", "blorken", "snarfle"):
        t, c = (sum(word in text.split() for _, text, y in rows if y == label) for label in (1, 0))
        assert abs(whole[word] - (math.log((t + 0.5) / 150) - math.log((c + 0.5) / 450))) < 1e-9
    assert not {"the", "sea", "calm"} & set(whole) and exceptions == []
    assert toxicity.learn(docs, labels, calibration_rows=100)[0] == lexicon
    scored = toxicity.score_toxicity(docs, labels, calibration_rows=100).toPandas().set_index("doc_id").predicted
    assert all(scored[i] == int(any(w in text for w in ("grubbish", "blorken", "snarfle"))) for i, text, _ in rows)


def test_folding_and_exceptions():
    assert "idiot" in toxicity.folded_words("you 1d10t")
    assert "idiot" in toxicity.folded_words("аn іdіоt".replace("а", "a", 1))
    assert "loser" in toxicity.folded_words("|oser,".strip(",")) and toxicity.folded_words("2024 1") == ["2024", "1"]
    m = toxicity.Matcher([("idiot", 0, 5.0), ("lowei", 5, 4.0)], ["village idiot"])
    assert m.total("an idiot, idiots loweiung lowei xlowei") == (9.0, 2)
    assert m.total("the village idiot") == (0, 0)


# 3 language model


def test_base_score_and_gain(spark):
    got = brown_lm.score_documents(documents(spark), head=300, clustered=200, classes=8, rounds=4).toPandas().set_index("doc_id")
    docs = documents(spark).toPandas()
    c = collections.Counter()
    for d, t in zip(docs.doc_id, docs.text):
        if zlib.crc32(str(d).encode()) % 5 != 1:
            c.update(t.encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    for d, t in zip(docs.doc_id, docs.text):
        w = [*t.encode().lower().split(), None]
        row = got.loc[d]
        assert row.n_tokens == len(w) and row.n_known == sum(c[x] > 0 for x in w) and row.train_tokens == n
        assert abs(row.base_score - sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_model_sums_to_one_and_scores_by_hand(spark):
    """Classes of all head words; transitions and emissions sum to one, and a text's score is their product over its tokens."""
    import pyarrow as pa

    r = random.Random(2)
    texts = [" ".join(r.choice(["a", "b"] if i % 2 else ["x", "y", "z"]) + str(min(int(r.expovariate(0.4)), 9)) for i in range(r.randrange(30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    training = df.select("text")
    counted = collections.Counter(w for t in texts for w in t.split())
    ids = {w: int(hashing.words(*hashing.buffers(pa.array([w])))[0].view(np.int64)[0]) for w in counted}
    counts = spark.createDataFrame([(ids[w], n) for w, n in counted.items()], "word long, n long")
    for head, clustered in ((10_000, 10), (20, 10), (10_000, 10_000)):
        m = brown_lm.learn(training, counts, head, clustered, 4, 6)
        assert np.allclose((10.0 ** m["step"]).sum(1), 1)
        table = {int(h): (int(m["n"][k]), int(m["class"][k])) for h, k in zip(m["table"].view(np.int64), m["order"])}
        assert len(table) <= head and (head < 10_000 or len(table) == len(counted)) and all(n == counted[w] for w in counted for n, _ in [table.get(ids[w], (counted[w], 0))])
        of = {w: table[i][1] if i in table else m["rare"] for w, i in ids.items()}
        assert head < 10_000 or m["rare"] not in of.values()
        for k in range(m["rare"] + 1):
            mass = sum(10 ** (math.log10(counted[w] + 0.5) - m["emission"][k]) for w in counted if of[w] == k)
            unseen = 10 ** (math.log10(0.5) - m["emission"][k]) if k == m["rare"] else 0
            assert abs(mass + unseen - 1) < 1e-9 or not mass and k != m["rare"]
        got = brown_lm.score_documents(df, F.lit(False), head=head, clustered=clustered, classes=4, rounds=6).toPandas().set_index("doc_id").score
        for i, t in enumerate(texts):
            value, before = 0.0, m["end"]
            for w in [*t.split(), None]:
                kind, n = (of[w], counted[w]) if w else (m["end"], len(texts))
                by_class = 10 ** (m["step"][before, kind] + (math.log10(n + 0.5) - m["emission"][kind]))
                value += math.log10(brown_lm.CLASS_SHARE * by_class + (1 - brown_lm.CLASS_SHARE) * (n + 0.5) / 10 ** m["base"])
                before = kind
            assert abs(got[i] - value) < 1e-6
    assert len({of[w] for w in of if w[0] in "ab"} & {of[w] for w in of if w[0] in "xyz"}) <= 2  # the two kinds of words hardly mix


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_gain_on_held_out_texts_at_default_parameters(spark, sf):
    got = brown_lm.query(spark, f"/root/testdata/{sf}").toPandas()
    held = got[got.held_out]
    assert (held.score - held.base_score).sum() / held.n_tokens.sum() >= 0.2
    assert (held.score < held.base_score).mean() < 0.05


def test_no_token_falls_far_below_the_unigram(spark):
    known = [" ".join(f"{a}{r}" for r in range(k % 7 + 1) for a in "abc") + f" once{k}" for k in range(60)]
    df = spark.createDataFrame([*enumerate(known), (99, "never seen words at all")], "doc_id long, text string")
    got = brown_lm.score_documents(df, F.col("doc_id") == 99, clustered=10, classes=3).where("held_out").first()
    assert got.n_known == 1 and got.score >= got.base_score + got.n_tokens * math.log10(1 - brown_lm.CLASS_SHARE)


def test_exchange_against_a_plain_one(spark):
    r = random.Random(21)
    size, classes = 48, 4
    after = [[(k + 1) % classes, (k + 2) % classes] for k in range(classes)]
    chain, kind = [], 0
    for _ in range(6000):
        kind = r.choice(after[kind]) if r.random() < 0.9 else r.randrange(classes)
        chain.append(kind + classes * min(int(r.expovariate(0.3)), size // classes - 1))
    seen = collections.Counter(zip(chain, chain[1:]))

    def value(of):
        sums = np.zeros((classes + 2, classes + 2))
        for (a, b), n in seen.items():
            sums[of[a], of[b]] += n
        f = lambda m: float((m * np.log(np.maximum(m, 1e-300))).sum())
        return f(sums) - f(sums.sum(0)) - f(sums.sum(1))

    # a start that knows nothing of the kinds, in both
    name = r.sample(range(size), size)
    seen = collections.Counter({(name[a], name[b]): n for (a, b), n in seen.items()})
    plain = [k % classes for k in range(size)]
    first = value(plain)
    for _ in range(12):
        for w in range(size):
            plain[w] = max(range(classes), key=lambda c: value(plain[:w] + [c] + plain[w + 1 :]))
    pairs = spark.createDataFrame([(a * (size + 2) + b, n) for (a, b), n in seen.items()], "pair long, n long")
    of, _ = brown_lm.exchange_classes(pairs, size, classes, 12)
    assert value(of.tolist()) - first >= 0.95 * (value(plain) - first) > 0


# 4 lines


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def line_components(texts, percent=80):
    """Components of distinct lines by all pairs of shingle sets."""
    sets = [{s[j : j + 8] for j in range(max(1, len(s) - 7))} for s in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_copies_of_lines_over_several_blocks(spark):
    """Large groups of near copies, of short lines, accents, indents and null ids, dealt to blocks of a few."""
    r = random.Random(12)
    texts = []
    for g in range(6):
        base = [r.choice("abcdefgé ") for _ in range(r.choice([3, 20, 60, 150]))]
        for _ in range(r.choice([3, 40, 70])):
            t = list(base)
            for _ in range(r.randrange(4)):
                t[r.randrange(len(t))] = r.choice("xyzü")
            texts.append("".join(t))
    rows = [(None if i % 7 == 0 else i, ("  " if i % 5 == 0 else "") + t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stripped = [ascii_lower(t.strip(" ")) for t in texts]
    number = {s: i for i, s in reversed(list(enumerate(stripped)))}
    distinct = sorted(set(number.values()))
    want = dict(zip(distinct, line_components([stripped[i] for i in distinct])))
    for options in ({}, {"block": 4}):
        got = line_dedup.fuzzy_lines(df, **options).join(df, "doc_id").select("component", "text").collect()
        of = collections.defaultdict(set)
        for x in got:
            of[x.component].add(want[number[ascii_lower(x.text.strip(" "))]])
        assert all(len(s) == 1 for s in of.values())
        assert len({next(iter(s)) for s in of.values()}) == len(of)

def test_lines_against_brute_force(spark):
    got = line_dedup.dedup_lines(documents(spark)).toPandas().set_index("doc_id")
    docs = documents(spark).toPandas().sort_values("doc_id")
    lines = [(d, i, ascii_lower(l.strip(" \t\r\x0b\x0c"))) for d, t in zip(docs.doc_id, docs.text) for i, l in enumerate(t.split("\n"))]
    number, sets = {}, []
    for _, _, s in lines:
        if s not in number:
            number[s] = len(sets)
            sets.append({s[j : j + 8] for j in range(max(1, len(s) - 7))})
    up, inv = list(range(len(sets))), collections.defaultdict(list)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in enumerate(sets):
        for b, k in collections.Counter(b for g in s for b in inv[g]).items():
            if 100 * k >= 80 * (len(s) + len(sets[b]) - k):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
        for g in s:
            inv[g].append(a)
    seen, dropped = set(), collections.defaultdict(list)
    for d, i, s in lines:
        k = find(number[s])
        if s and k in seen:
            dropped[d].append(i)
        seen.add(k)
    assert {d: list(x) for d, x in got.dropped.items() if len(x)} == dict(dropped)


# 5 contamination


def test_windows_by_hand(spark, odd):
    got = {r.doc_id: r for r in decontamination.contamination(odd, bench(spark)).collect() if r.doc_id}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (17, 11, 1, True)
    assert got[1].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert (got[5].n_hit, got[6].n_hit, got[4].n_hit) == (2, 2, 0)
    assert got[4].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_contamination_equals_sql_and_blocks(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.sql(decontamination.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    for options in ({}, {"block_shingles": 400}, {"block_shingles": 90}):
        got = decontamination.contamination(documents(spark), b, **options).toPandas().sort_values("doc_id").reset_index(drop=True)
        assert all((got[c] == want[c]).all() for c in want.columns)


def test_blocks_do_not_depend_on_the_order_of_scans(spark):
    """Blocks of the benchmark scan the documents again: their rows may then come in another order and number of tasks."""
    docs, b = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    shuffled = docs.select(*[F.col(c) for c in docs.columns]).repartition(3, F.rand())
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    assert rows(decontamination.contamination(shuffled, b, block_shingles=400)) == rows(decontamination.contamination(docs, b))


# 6 mixing


@pytest.mark.parametrize("options", [{}, {"max_repetition": 3.0}, {"max_repetition": None, "target_entropy": 0.99}, {"budget": 20_000, "max_repetition": 2.0}])
def test_mixture(spark, options):
    docs = documents(spark).where("doc_id % 20 <> 3 or doc_id < 40").select("doc_id", "text", F.concat(F.lit("s"), (F.col("doc_id") % 10 * (F.col("doc_id") % 3) % 4).cast("string")).alias("source"))
    got = mixing.draws(docs, block_docs=8, **options).toPandas()
    text = docs.toPandas().set_index("doc_id")
    text["n"] = [len(x.encode().split()) for x in text.text]
    total = text.groupby("source").n.sum()
    if "budget" not in options:
        assert set(got.doc_id) == set(text.index)
    drawn, weight, passes = (got.groupby("source")[c].agg(f) for c, f in (("mix_tokens", "sum"), ("mix_weight", "first"), ("mix_passes", "first")))
    assert abs(weight.sum() - 1) < 1e-9
    if options.get("max_repetition", 1.5):
        assert passes.max() <= options.get("max_repetition", 1.5) + 1e-6
    else:
        assert abs(-(weight * np.log(weight)).sum() - 0.99 * math.log(len(weight))) < 1e-6
    quota = passes * total
    longest = text.groupby("source").n.max()
    assert ((drawn <= quota + 1) & (drawn > quota - longest - 1)).all()
    copies = got.groupby("doc_id").size()
    assert all(g.max() - g.min() <= 1 for _, g in copies.groupby(text.source[copies.index].values))


# 7 personal data


def test_spans():
    field = pii.Field({"phone:bias": 3.0, "card:bias": 3.0, "email:bias": 3.0, "ip:bias": 3.0})
    text = "mail a.b@x.org. or +1 (269) 555-3296 4539578763621486 and 10.0.0.1, 999.1.1.1"
    base, spans = pii.find(text, field)
    assert [(k, text[a:b]) for k, a, b in base] == [("email", "a.b@x.org"), ("ip", "10.0.0.1")]
    assert {(k, text[a:b]) for k, a, b in spans} == {("email", "a.b@x.org"), ("ip", "10.0.0.1"), ("card", "4539578763621486"), ("phone", "+1 (269) 555-3296")}


def test_base_spans_equal_patterns():
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice("ab@@..-+ 1234567890()0%é") for _ in range(r.randrange(60)))
        assert pii.base_spans(t) == [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if good(k, m[0])], t


def planted(r, n):
    """Texts with entities that the base patterns miss and some that they find: (text, {(kind, start, end)})."""
    prose = [f"{a}{b}" for a in ("ba", "do", "ri", "ka", "mu", "te") for b in ("n", "lo", "ris", "ma", "")]
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    card = lambda: next(c for c in iter(lambda: "4" + digits(15), None) if pii.luhn(c))
    make = {
        "email": lambda: r.choice(["{}@{}.org", "{} [at] {} [dot] com", "{} (at) {} (dot) net"]).format(r.choice(prose), r.choice(prose)),
        "phone": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}" if r.random() < 0.7 else f"({digits(3)}) {digits(3)}-{digits(4)}",
        "card": lambda: card() if r.random() < 0.7 else f"+1 ({digits(3)}) {digits(3)}-{digits(4)} {card()}",
        "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        "secret": lambda: r.choice(['password={0}', 'token = "{0}"', "{0}"]).format("".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 40])))),
    }
    out = []
    for _ in range(n):
        text, spans = "", set()
        for _ in range(r.randrange(1, 5)):
            text += " ".join(r.choice(prose) for _ in range(r.randrange(2, 12))) + " "
            kind = r.choice(list(make))
            entity = make[kind]()
            if kind == "card" and "+" in entity:
                spans.add(("phone", len(text), len(text) + len(entity) - 17))
                spans.add(("card", len(text) + len(entity) - 16, len(text) + len(entity)))
            elif kind == "secret":
                value = entity.split("=")[-1].strip(' "')
                spans.add((kind, len(text) + entity.index(value), len(text) + entity.index(value) + len(value)))
            else:
                spans.add((kind, len(text), len(text) + len(entity)))
            text += entity + " " + r.choice(prose) + ". "
        out.append((text, spans))
    return out


def test_field_learns_what_the_patterns_miss(spark):
    """Trained on one half of the planted texts, it finds nine tenths of the other half's entities, and hardly anything else."""
    r = random.Random(5)
    texts, held = planted(r, 600), planted(r, 300)
    source = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    field = pii.Field(pii.learn(source, 10_000, 10_000))
    found = {kind: [0, 0] for kind in ("email", "phone", "card", "ip", "secret")}
    extra = 0
    for text, want in held:
        base, got = pii.find(text, field)
        assert set(base) <= set(got)
        for span in want:
            found[span[0]][0] += span in got
            found[span[0]][1] += 1
        extra += len(set(got) - want)
    assert all(hit >= 0.9 * n for hit, n in found.values()), found
    assert extra <= 0.05 * sum(n for _, n in found.values())
    missed = sum(len(want - set(pii.base_spans(text))) for text, want in held)
    assert missed > 100  # so the base patterns alone would fail this test
    small = pii.Field(pii.learn(source, 100, 100))
    assert sum(len(want & set(pii.find(text, small)[1])) for text, want in held) > 0.8 * sum(n for _, n in found.values())


def test_found_spans_by_enumeration():
    """The spans are those of the best of all segmentations of each run, beside the base spans."""
    r = random.Random(11)
    field = pii.Field(pii.train([e for t, _ in planted(random.Random(1), 200) for e in pii.examples(t)]))
    for text, _ in planted(r, 60):
        base, got = pii.find(text, field)
        extra = set()
        for run in pii.clusters(text):
            found = [c for c in pii.segments(text, run) if pii.sound(c[2], text[c[3] : c[4]]) and not any(a < c[4] and c[3] < b for _, a, b in base)]
            score = [field.score(pii.span_features(text, k, s, e, j - i)) - 1.0 for i, j, k, s, e in found]
            best, chosen = 0.0, ()
            stack = [(0, 0.0, ())]
            while stack:
                at, value, own = stack.pop()
                if value > best + 1e-9:
                    best, chosen = value, own
                stack += [(found[k][1], value + score[k], (*own, k)) for k in range(len(found)) if found[k][0] >= at and score[k] > 0]
            extra |= {found[k][2:] for k in chosen}
        assert sum(field.score(pii.span_features(text, k, s, e, len(text[s:e].split()))) for k, s, e in set(got) - set(base)) >= sum(field.score(pii.span_features(text, k, s, e, len(text[s:e].split()))) for k, s, e in extra) - 1e-6
        assert len(set(got) - set(base)) == len(extra)


def test_sample_is_even_bounded_and_never_empty(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 2).alias("kind"))
    for n in (1, 300, 50_000):
        got = common.first_by_hash(rows, F.col("id"), n).toPandas()
        assert abs(len(got) - min(n, 20_000)) <= 5 * min(n, 20_000) ** 0.5
        assert n != 300 or 100 < got.kind.sum() < 200
    assert common.first_by_hash(rows.select(F.lit(1).alias("id")), F.col("id"), 10).count() <= 1  # copies count once
    huge = int(15_000 * 2**64 / 2**40) - 2**63  # the bound at a million million rows
    assert huge > -(2**63)


def test_best_segmentation_by_enumeration():
    r = random.Random(6)
    for _ in range(100):
        n = r.randrange(1, 7)
        spans = [(a := r.randrange(n), r.randrange(a + 1, n + 1), r.uniform(-2, 3)) for _ in range(r.randrange(6))]
        every = [[]]
        for k in range(len(spans)):
            every += [e + [k] for e in every if all(spans[k][1] <= spans[j][0] or spans[j][1] <= spans[k][0] for j in e)]
        value = lambda e: sum(spans[k][2] for k in e)
        assert abs(value(pii.Field({}).best(n, spans)) - max(map(value, every))) < 1e-9
        z = sum(math.exp(value(e)) for e in every)
        for k, p in enumerate(pii.Field.marginals(n, spans)):
            assert abs(p - sum(math.exp(value(e)) for e in every if k in e) / z) < 1e-9


# 8 near duplicates


def test_components_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 30, 120, 300]))]
        for _ in range(r.choice([1, 2, 9, 40])):
            t = list(base)
            for _ in range(r.randrange(4)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(" ".join(t))
    texts += ["", None, "a b", "A b"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*[w[i:] for i in range(5)])) if w else frozenset())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"block": 4, "posting_block": 8}, {"block": 1, "posting_block": 2}):
        got = near_dedup.near_duplicates(df, **options).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_rows_of_one_id_are_one_document(spark):
    """An id with two texts has the links of both; with none it is its own component."""
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, one), (5, two), (6, one), (7, two), (8, None), (8, "c d e f g h"), (None, one)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in got) == [(0, 0, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True), (8, 8, True)]


def test_groups_of_several_blocks_by_brute_force(spark):
    """Every pair of a key counts, however the key is dealt; a chain of links over many blocks is one component."""
    from bazaarflow.llm import grouping

    r = random.Random(3)
    rows = [(key, unit, [v], blocks) for key, blocks in ((1, 1), (2, 7), (3, 30)) for unit, v in ((key * 1000 + i, r.randrange(40 * key)) for i in range(60))]
    near = lambda payload: (lambda v: lambda i, others: abs(v[others] - v[i]) <= 1)(payload.flatten().to_numpy(zero_copy_only=False))
    got = grouping.linked(spark.createDataFrame(rows, "key long, unit long, payload array<bigint>, blocks long"), near, "test").collect()
    up = {u: u for _, u, _, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for ka, a, va, _ in rows:
        for kb, b, vb, _ in rows:
            if ka == kb and abs(va[0] - vb[0]) <= 1:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    sizes = collections.Counter(map(find, up))
    assert {x.node: x.root for x in got} == {u: find(u) for u in up if sizes[find(u)] > 1}


# 9 licenses


def test_licenses(spark):
    texts = ["foo under the bar. Released under the MIT License. the end", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache license, version 2.0", "released mit under", None, ""]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [list(x.licenses) for x in got] == [["MIT"], ["CC-BY-NC-4.0"], ["Apache-2.0"], [], [], []]
    assert (got[0].found[0].first_word, got[0].found[0].end_word) == (4, 9)


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


def test_alignment_is_a_common_subsequence():
    """Patience alignment keeps both orders and never has more words than the longest common subsequence; without repeats it has all of them."""
    r = random.Random(13)
    for _ in range(300):
        a, b = (r.choices("abcdef", k=r.randrange(12)) for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:]))
        assert len(got) <= common_words(a, b)
        p, q = (r.sample("abcdefgh", k=r.randrange(9)) for _ in range(2))
        assert len(licenses.align(p, q)) == common_words(p, q)


def test_whole_licences_planted_damaged_and_reordered(spark):
    """Whole licences in prose are found with a twentieth of their words changed, left out or added; shuffled ones are not."""
    r = random.Random(14)
    prose = lambda n: " ".join(r.choice(["the", "of", "to", "and", "sea", "tree", "copy", "software", "in"]) for _ in range(n))
    texts, want = [], []
    for name in ("MIT", "ISC", "BSD-3-Clause"):
        words = licenses.TEMPLATES[name][-1].split()
        for kind in ("whole", "changed", "cut", "added", "shuffled", "half"):
            for _ in range(6):
                t = list(words)
                for k in r.sample(range(len(t)), len(t) // 20):
                    t[k] = {"changed": "other", "cut": "", "added": f"{t[k]} extra"}.get(kind, t[k])
                t = r.sample(t, len(t)) if kind == "shuffled" else t[: len(t) // 2] if kind == "half" else t
                texts.append(f"{prose(40)} {' '.join(t)} {prose(40)}")
                want.append(name if kind in ("whole", "changed", "cut", "added") else None)
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    last = {name: len(licenses.TEMPLATES[name]) - 1 for name in licenses.TEMPLATES}
    whole = [{f.license for f in x.found if f.template == last[f.license] and f.license in ("MIT", "ISC", "BSD-3-Clause")} for x in got]
    assert sum(w in found for w, found in zip(want, whole) if w) == sum(w is not None for w in want)
    assert not any(found for w, found in zip(want, whole) if w is None)


def test_longest_increasing():
    import itertools

    r = random.Random(1)
    for _ in range(200):
        v = [r.randrange(8) for _ in range(r.randrange(8))]
        got = licenses.longest_increasing(v)
        assert all(v[a] < v[b] for a, b in itertools.pairwise(got))
        assert len(got) == max(k for k in range(len(v) + 1) for c in itertools.combinations(v, k) if all(a < b for a, b in itertools.pairwise(c)))


# 10 media


def test_recordings_align(spark):
    r = np.random.default_rng(3)
    song = [r.normal(size=64) for _ in range(12)]
    rows = [(i, v.tolist()) for i, v in enumerate(song)]
    rows += [(20, np.roll(song[3], 12).tolist()), (40, (song[4] + r.normal(size=64) * 0.01).tolist()), (41, None), (42, [1.0]), (60, song[5].tolist()), (60, song[5].tolist()), (None, song[6].tolist())]
    got = chroma.align_recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, "vec_id", "embedding", chroma.melody).toPandas()
    by = {x.id: x for x in got.itertuples()}
    assert any(m["class_id"] == 3 and abs(m["shift"]) > 10 for m in by[20].matches)
    assert any(m["class_id"] == 4 and m["shift"] == 0 for m in by[40].matches)
    assert by[60].class_id == 5 and by[1].matches is None and by[42].n_prints == 0 and None not in by


def test_recordings_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert chroma.align_recordings(none, lambda i: i % 20 == 0, "vec_id", "embedding", chroma.melody).count() == 0


# the pipeline


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    docs, tables = documents(spark), SF
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialise(stage(spark, docs, tables), name)
        assert out.columns == docs.columns
        docs = out
    assert docs.count() > 100
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, tables), name)
        assert docs.columns == odd.columns
    assert docs.where("doc_id is null").count() >= 2
    assert common.materialise(corpus_pipeline.STAGES[-1][1](spark, docs, tables), "last").count() == docs.count()


def test_pipeline_decisions(spark):
    import corpus_pipeline

    bad = {r.doc_id for r in toxicity.score_toxicity(documents(spark), spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, documents(spark), SF).collect()}
    assert kept == {r.doc_id for r in documents(spark).collect()} - bad
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "shard", "slot"} <= set(got.columns) and got.count() > 100
