"""Conversation repair, quality by lines and hard negatives: brute force, odd rows, held-out labels."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from bazaarflow.llm import conversations, hard_negatives, quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

# 11 conversation repair

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
LEGAL = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}


def cheapest(rows, faults):
    """(cost, audit) by dynamic programming over whole strings."""

    def inserted(values):
        for _ in range(3):
            for s in range(4):
                to = values[NEXT[s]]
                if to is not None:
                    values[s] = min(values[s] or (math.inf, ""), (5 + to[0], "I" + to[1]))
        return values

    after = inserted([(0, ""), None, None, (0, "")])
    for (_, role, _), fault in reversed(list(zip(rows, faults))):
        here = []
        for s in range(4):
            options = [(2 + after[s][0], "D" + after[s][1])]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if (role[:1], s) in LEGAL:
                    to = after[LEGAL[role[:1], s]]
                    options.append((extra + to[0], "K" + to[1]))
                options.append((1 + extra + after[NEXT[s]][0], "R" + after[NEXT[s]][1]))
            here.append(min(options))
        after = inserted(here)
    return after[0]


def plain_report(rows, damage):
    """{conv_id: figures} of (conv_id, turn, role, text) rows, one by one."""
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20 if damage else 19
        now = found[conv]
        if hit == 0:
            continue
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        now += [(turn, "user" if hit == 4 else role, text)] * (1 + (hit == 3))
    out = {}
    for conv, here in found.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, faults = [t for t, _, _ in here if t is not None], []
        for n, (_, role, text) in enumerate(here):
            shown = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in [r[1:] for r in here[:n]] else "" if shown[-1] in ".!?" else "truncated")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(here))
        cost, audit = cheapest(here, faults)
        state, left, repaired = 0, iter(here), []
        for letter in audit:
            row = next(left) if letter != "I" else (None, "", "")
            if letter == "K":
                state = LEGAL[row[1][:1], state]
                repaired.append(f"{row[1]}:{row[2]}")
            elif letter != "D":
                state = NEXT[state]
                repaired.append(f"{'user' if state == 2 else 'assistant'}:{row[2]}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def reported(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def made(r, n):
    texts = ["a.", "b!", "c", "d?", "", " \t", "long text without a stop", "e.\n", None]
    return [(r.choice([1, 2, 3, 4, 5, None]), r.choice([*range(30), None]), r.choice(["user", "user", "assistant", "system", "tool", "", None]), r.choice(texts)) for _ in range(n)]


def test_repairs_equal_brute_force(spark):
    rows = made(random.Random(3), 400)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert reported(conversations.repair_report(df)) == plain_report(rows, False)
    assert reported(conversations.repair_report(conversations.damaged(df), rows_a_segment=7)) == plain_report(rows, True)


def test_repair_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reported(conversations.query(spark, SF)) == plain_report(rows, True)


def test_long_conversation_is_cut(spark):
    r = random.Random(4)
    rows = [(1, k, r.choice(["user", "assistant", "assistant", "system"]), r.choice([f"{k}.", f"{k}", "again.", ""])) for k in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert reported(conversations.repair_report(df, rows_a_segment=50)) == plain_report(rows, False)


def test_repaired_rows_have_their_digest(spark):
    df = spark.createDataFrame(made(random.Random(5), 200), "conv_id long, turn long, role string, text string")
    rows = conversations.repair(df, rows_a_segment=9).orderBy("conv_id", "place").collect()
    lines = collections.defaultdict(list)
    for x in rows:
        assert x.place == len(lines[x.conv_id])
        lines[x.conv_id].append(f"{x.role}:{x.text}")
    for conv, got in reported(conversations.repair_report(df)).items():
        assert got[-1] == hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest()


def test_prices_are_feasible_and_exact():
    r = random.Random(6)
    for _ in range(200):
        codes = bytes(r.choice(range(9)) for _ in range(r.randrange(1, 80)))
        price = conversations.prices(codes, conversations.ENDS)
        for at, code in enumerate(codes):
            for state, here in enumerate(conversations.arcs(code)):
                assert all(price[at][state] <= cost + price[at + step][then] for _, step, then, cost in here)
        rows = [(0, {0: "s", 1: "u", 2: "a", 3: "x", 4: "x"}[c >> 1], "") for c in codes]
        faults = ["blank" if c == 8 else "truncated" if c & 1 else "" for c in codes]
        assert (price[0][0], conversations.traces(codes, conversations.ENDS)[0][0] + conversations.SUFFIX[conversations.traces(codes, conversations.ENDS)[0][1]]) == cheapest(rows, faults)


def test_conversations_with_clashing_columns_and_none(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y.")], "conv_id long, turn long, role string, text string")
    clash = df.withColumns({n: F.lit("clash") for n in ("segment", "open", "late", "ends", "turns", "faults", "_copy", "_c", "_hit")})
    assert reported(conversations.repair_report(clash))[1][5:7] == (0, "KK")
    assert conversations.repair_report(df.limit(0)).count() == 0 and conversations.repair(df.limit(0)).count() == 0


# 12 quality


def test_line_features_by_hand():
    column = pa.array(["AB CD\nab ab ab\n\nab ab ab", None, "", "one | two!\n"])
    places, length, lines = quality.line_features(column)
    assert lines.tolist() == [0, 4, 5, 6, 8] and length.tolist() == [6, 9, 1, 9, 1, 1, 11, 1]
    value = lambda line, name: places[line][list(quality._BINS).index(name)] - quality._AT[list(quality._BINS).index(name)]
    assert value(0, "upper") == 4 and value(1, "upper") == 0 and value(1, "same") == 4 and value(0, "same") == 0
    assert [value(k, "again") for k in range(4)] == [0, 1, 0, 1] and value(3, "before") == 0 and value(2, "bytes") == 0
    assert value(6, "bar") == 3 and value(6, "ended") == 1
    sliced = quality.line_features(column.slice(1, 3))
    assert sliced[0].tolist() == places[4:].tolist() and sliced[2].tolist() == [0, 1, 2, 4]


def test_marginals_by_enumeration():
    r = np.random.default_rng(7)
    lines = np.array([0, 3, 4, 4, 9])
    odds, transition = r.normal(size=9), r.normal(size=(2, 2))
    good, pairs, whole = quality.marginals(odds, lines, transition)
    filled = [(a, b) for a, b in itertools.pairwise(lines.tolist()) if b > a]
    for z, (a, b) in zip(whole, filled):
        total, ones = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            p = math.exp(sum(odds[a + k] * v for k, v in enumerate(y)) + sum(transition[u, v] for u, v in itertools.pairwise(y)))
            total, ones = total + p, ones + p * np.array(y)
        assert abs(z - math.log(total)) < 1e-9 and np.allclose(good[a:b], ones / total)
        assert np.allclose(pairs[a + 1 : b].sum((1, 2)), 1)


def test_fit_climbs_the_likelihood():
    r = np.random.default_rng(8)
    texts = ["\n".join("THE!! OLD!! FOX!!" if r.random() < bad else "The old fox went home." for _ in range(6)) for bad in [0.9] * 30 + [0.1] * 30]
    places, _, lines = quality.line_features(pa.array(texts))
    columns, labels, weight = quality.chained(places, lines), np.array([0] * 30 + [1] * 30), np.ones(60)

    def likelihood(w, t):
        odds = quality.emissions(columns, w)
        y = np.repeat(labels, np.diff(lines))
        _, _, whole = quality.marginals(odds, lines, t)
        return (odds * y).sum() + sum(t[v, v] * (b - a - 1) for v, a, b in zip(labels, lines, lines[1:])) - whole.sum()

    w, t = quality.fit(columns, lines, labels, weight)
    assert likelihood(w, t) > likelihood(np.zeros(quality.WIDTH), np.zeros((2, 2))) + 50


def test_neighbouring_lines_matter():
    """The same line is worse among bad lines than among good ones."""
    bad, good, plain = "AAA!! BBB!! CCC!!", "The old fox went home today.", "x y"
    texts = [f"{bad}\n{bad}\n{bad}"] * 20 + [f"{good}\n{good}\n{good}"] * 20
    places, _, lines = quality.line_features(pa.array(texts))
    w, t = quality.fit(quality.chained(places, lines), lines, np.array([0] * 20 + [1] * 20), np.ones(40))
    places, _, lines = quality.line_features(pa.array([f"{bad}\n{plain}\n{bad}", f"{good}\n{plain}\n{good}"]))
    p, _, _ = quality.marginals(quality.emissions(quality.chained(places, lines), w), lines, t)
    assert p[1] < 0.5 < p[4]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_on_held_out_labels(spark, sf):
    got = quality.query(spark, f"/root/testdata/{sf}").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out)) and ((got.score >= 0.3) == (got.predicted == 1)).all()
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    bad, good = held[held.quality == 0], held[held.quality == 1]
    assert (bad.predicted == 0).mean() >= 0.95 and (good.predicted == 1).mean() >= 0.99
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean() >= 0.99


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (11, 1), (11, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.score_quality(odd, labels).toPandas()
    assert len(got) == odd.count() and got.doc_id.isna().sum() == 2 and got.score.between(0, 1).all()
    assert got[got.doc_id == 2].score.nunique() == 1 and got[got.doc_id == 3].score.iloc[0] == got[got.doc_id == 4].score.iloc[0]
    assert (quality.score_quality(odd, labels.limit(0)).toPandas().score == 0.5).all()
    assert quality.score_quality(empty, labels).count() == 0


# 13 hard negatives


def plain_negatives(rows, anchor, scale=256):
    """Triples by sorting all rows of each anchor."""
    rows = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in rows:
        if anchor(i):
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == lab) for i, other, w in rows if i != a)
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            near = [s for s in scored if not s[2] and -50 * p <= -100 * s[0] <= -95 * p]
            out += [(a, positive, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(near[:3])]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.collect())


VECTORS = "vec_id long, embedding array<float>, label int"


def test_negatives_with_ties_nulls_and_repeats(spark, monkeypatch):
    r = random.Random(11)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(r.choice([3, 3, 2]))], r.randrange(3)) for i in range(300)]
    rows += r.sample(rows, 60) + [(50, [0.5, 0.5, 0.5], 2), (None, [1.0, 1.0, 1.0], 1), (7, None, 1), (8, [1.0, None, 0.0], 1), (9, [float("nan")] * 3, 0), (10, [float("inf"), 0.0, 0.0], 0), (11, [1.0, 0.0, 0.0], None), (12, [], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit("clash") for n in ("id", "anchor", "down", "kind", "scores", "group", "share")})
    want = plain_negatives([(i, lab, v) for i, v, lab in rows], lambda i: i % 10 == 0)
    assert want and mined(hard_negatives.mine_hard_negatives(hard_negatives.usable(df), F.col("id") % 10 == 0)) == want
    monkeypatch.setattr(hard_negatives, "ROWS_A_BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "BLOCKS_A_TILE", 1)
    assert mined(hard_negatives.mine_hard_negatives(hard_negatives.usable(df), F.col("id") % 10 == 0)) == want


def test_negatives_none(spark):
    df = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], VECTORS)
    assert hard_negatives.mine_hard_negatives(hard_negatives.usable(df), F.col("id") == 50).count() == 0
    assert hard_negatives.mine_hard_negatives(hard_negatives.usable(df.limit(0)), F.col("id") == 50).count() == 0


def test_tiles_are_not_sent_to_all_tasks(spark):
    """Copies of the anchors for all groups go through a shuffle, whatever Spark expects of their size, and there are no more groups than blocks."""
    frame = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(20)], "id long, vector array<double>, label long").select("id", "label", "vector")
    packed = hard_negatives.materialise(frame.repartition(2).mapInArrow(hard_negatives._pack(256.0), hard_negatives._PACKED), "test-blocks")
    tiles = hard_negatives._tiled(packed, packed, 600)
    plan = tiles._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "sequence(0, 1" in plan and tiles.count() == packed.count() ** 2 == 4


def test_negatives_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = sorted(tuple(int(v) for v in r) for r in con.sql(hard_negatives.ORACLE_SQL).df()[names].itertuples(index=False))
    assert mined(hard_negatives.query(spark, SF).select(*names)) == want


def test_products_are_exact():
    r = random.Random(12)
    for top in (1 << 8, 1 << 29, 1 << 40):
        x, y = (np.array([[r.randrange(-top, top) >> k for _ in range(4)] for _ in range(5)], np.int64) for k in (0, 20 if top > 1 << 30 else 0))
        want = [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y] for p in x]
        assert hard_negatives.product(x, y).tolist() == want
    with pytest.raises(OverflowError):
        hard_negatives.product(np.full((1, 4), 1 << 40), np.full((1, 4), 1 << 40))


@pytest.mark.parametrize("p", [-7, -1, 0, 1, 2, 99, 100, 101, 12345])
def test_windows_are_the_inequalities(p):
    low, high = hard_negatives.window(p, 50, 95)
    assert [s for s in range(-200, 13000) if 50 * p <= 100 * s <= 95 * p] == list(range(low, high + 1))
