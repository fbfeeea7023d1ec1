"""The whole job against brute force: cases that candidate keys, prefixes or bounds once left out."""

import itertools
import random

import corpus_pipeline
import numpy as np
from bazaarflow.llm import chroma, licenses

SF = "/root/testdata/sf0.001"


def test_pipeline_drops_near_copies_from_80_percent(spark):
    r = random.Random(9)
    texts = []
    for _ in range(25):
        base = [f"w{r.randrange(10_000)}" for _ in range(r.choice([60, 100, 150]))]
        for _ in range(3):
            t = list(base)
            for k in r.sample(range(len(t)), len(t) // r.choice([40, 45, 50, 60])):
                t[k] = f"x{r.randrange(10_000)}"
            texts.append(" ".join(t))
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    up, between = list(range(len(texts))), 0

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        between += 80 * either <= 100 * both < 85 * either
        if 100 * both >= 80 * either:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SF)
    assert {x.doc_id for x in got.collect()} == {i for i in range(len(texts)) if find(i) == i} and between >= 5


def test_nearest_alignment_by_enumeration():
    r = random.Random(10)
    for _ in range(300):
        text, template, gap = r.choices("abcx", k=r.randrange(12)), r.choices("abc", k=r.randrange(1, 6)), r.randrange(1, 5)
        best = 0
        for n in range(1, len(template) + 1):
            for p in itertools.combinations(range(len(text)), n):
                if all(b - a <= gap for a, b in itertools.pairwise(p)):
                    left = iter(template)
                    best = max(best, n * all(text[i] in left for i in p))
        n, first, end = licenses.nearest(text, [i for i, w in enumerate(text) if w in template], template, gap)
        assert n == best and (not n or text[first] in template and text[end - 1] in template)


def test_notices_twice_and_with_changed_words(spark):
    gpl, apache = licenses.TEMPLATES["GPL-3.0"][1], licenses.TEMPLATES["Apache-2.0"][1]
    prose = "the part of it that you may go on to read as the end of this is to be the one by the side of any"
    changed = apache.replace("file", "work").replace("compliance", "accord")
    four = gpl.replace("program", "thing").replace("redistribute", "share").replace("modify", "alter").replace("Foundation", "Group")
    texts = [f"{prose} {gpl} {prose} {gpl} {prose}", f"{prose} {changed} {prose}", f"{prose} {four} {prose}", f"{prose} {apache} {apache} {prose}", prose * 9]
    texts.append(f"{prose} {changed.replace('use', 'read')} {prose}")
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [list(x.licenses) for x in rows] == [["GPL-3.0"], ["Apache-2.0"], ["GPL-3.0"], ["Apache-2.0"], [], ["Apache-2.0"]]
    assert [f.template for f in rows[5].found] == [0]  # 19 of 22 words of the long notice, but the short one is whole
    assert [round(max(f.coverage for f in x.found), 3) for x in rows[:4]] == [1.0, 0.909, 0.905, 1.0]


def test_recordings_with_bit_errors_against_brute_force():
    r = np.random.default_rng(11)
    songs = [r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) for n in (118, 118, 90, 60, 30, 20)]
    chorus = songs[0][20:60]
    songs.append(np.concatenate([chorus, r.integers(0, 1 << 32, 30, dtype=np.uint64).astype(np.uint32), chorus]))
    songs.append(np.full(70, songs[1][5], np.uint32))  # one held tone

    def noisy(p, share):
        flips = (r.random((len(p), 32)) < share) @ (1 << np.arange(32, dtype=np.uint64))
        return p ^ flips.astype(np.uint32)

    clips = [noisy(songs[k][a : a + 50], share) for k in range(4) for a in (0, 9) for share in (0.05, 0.1, 0.15, 0.18, 0.2)]
    clips += [noisy(songs[6][70:], 0.1), noisy(songs[7][:40], 0.1)]
    want = {}
    for i, a in enumerate(clips):
        for j, b in enumerate(songs):
            for shift in range(-len(b) + 1, len(a)):
                x, y = (a[shift:], b) if shift >= 0 else (a, b[-shift:])
                n = min(len(x), len(y))
                errors = np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n)
                if n >= 24 and errors <= 0.2:
                    key = (errors, -n, abs(shift), shift)
                    want[i, j] = min(want.get((i, j), key), key)
    got = chroma.alignments(np.arange(len(clips)), clips, np.arange(len(songs)), songs, 0.2, 24)
    assert {(x.query, x.record): (x.errors, -x.overlap, abs(x.offset), x.offset) for x in got.rename(columns={"shift": "offset"}).itertuples()} == want
    assert len({i for i, _ in want}) >= 36


def test_noisy_recordings_are_all_found(spark):
    r = np.random.default_rng(12)
    songs = [r.normal(size=64) for _ in range(30)]
    rows = [(20 * i + 1, v.tolist()) for i, v in enumerate(songs)] + [(20 * i, (v + r.normal(size=64) * 0.12).tolist()) for i, v in enumerate(songs)]
    prints = {i: chroma.fingerprint(chroma.chroma(chroma.melody(v))) for i, v in rows}
    queries = [i for i in prints if i % 20 == 0]
    want = chroma.alignments(np.array(queries), [prints[i] for i in queries], np.array(list(prints)), list(prints.values()), 0.2, 24)
    for options in ({}, {"block": 7}):
        got = chroma.align_recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0, "vec_id", "embedding", chroma.melody, **options).where("is_query").collect()
        assert {(x.id, m.class_id, m["shift"]) for x in got for m in x.matches} == set(zip(want["query"], want.record, want["shift"]))
    assert len(want) > 30


def test_pipeline_drops_exactly_the_contaminated(spark):
    """Documents with a window of ten successive words of an item, or a whole shorter item, told word by word."""
    import re

    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows: dict = {}
    for r in items.collect():
        w = words(r.text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(len(w[k : k + 10]), set()).add(tuple(w[k : k + 10]))
    bad = set()
    for r in docs.collect():
        w = words(r.text)
        if any(tuple(w[k : k + n]) in some for n, some in windows.items() for k in range(len(w) - n + 1)):
            bad.add(r.doc_id)
    kept = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - bad and bad


def test_pipeline_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_mixture_reads_every_document(spark):
    """Each row at least once, none more often than its source's passes allow, sources of equal shares alike."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    drawn = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    times = {i: drawn.count(i) for i in set(drawn)}
    assert set(times) == before and set(times.values()) <= {1, 2}
    assert sorted(drawn) == sorted(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs.repartition(3), SF).collect())


def test_recall_of_offset_histograms(spark):
    """Noisy copies, parts and loops: votes find at least nine of ten pairs that every offset finds, with the same best offset."""
    r = np.random.default_rng(15)
    songs = [r.normal(size=64) for _ in range(60)]
    play = lambda v: chroma.fingerprint(chroma.chroma(chroma.melody(v)))
    asked = [play(v + r.normal(size=64) * noise) for v, noise in zip(songs, np.linspace(0, 0.25, 60))]
    asked += [play(np.concatenate([r.normal(size=20), v[10:50]])) for v in songs[:20]] + [play(np.concatenate([v[:24], v[:24]])) for v in songs[20:30]] + [np.zeros(90, np.uint32)]
    known = [play(v) for v in songs] + [np.zeros(117, np.uint32), np.zeros(0, np.uint32), np.zeros(5, np.uint32)]
    sides = np.arange(len(asked)), asked, np.arange(len(known)) + 1000, known, 0.2, 24
    want = {(x.query, x.record): (x.shift_, round(x.errors, 9)) for x in chroma.alignments(*sides).rename(columns={"shift": "shift_"}).itertuples()}
    got = {(x.query, x.record): (x.shift_, round(x.errors, 9)) for x in chroma.voted(*sides).rename(columns={"shift": "shift_"}).itertuples()}
    hit = sum(got.get(k) == v for k, v in want.items())
    assert len(want) > 40 and set(got) <= set(want) and hit >= 0.9 * len(want), (hit, len(want))
    assert (90, 1060) in got


def test_many_votes_are_aligned_at_every_offset(monkeypatch):
    monkeypatch.setattr(chroma, "MOST_VOTES", 10)
    asked, known = [np.arange(40, dtype=np.uint32)], [np.arange(60, dtype=np.uint32)]
    sides = [7], asked, [8], known, 0.2, 24
    assert chroma.voted(*sides).values.tolist() == chroma.alignments(*sides).values.tolist() != []


def test_media_query_equals_every_offset(spark):
    got = sorted((x.vec_id, [(m.class_id, m["shift"], m.errors) for m in x.matches]) for x in chroma.query(spark, SF).where("is_query").collect())
    media = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = chroma.align_recordings(media, lambda i: i % 20 == 0, "vec_id", "embedding", chroma.melody).where("is_query").collect()
    assert got == sorted((x.id, [(m.class_id, m["shift"], m.errors) for m in x.matches]) for x in want)
