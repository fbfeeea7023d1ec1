"""Pages from one template: alike, mostly not linked, and more than a block."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarflow.llm import grouping, near_dedup


def _pages(n: int, words: int, changed: int, seed: int) -> list[str]:
    """One template with a few words changed; every tenth page is the page before it with one more change."""
    r = random.Random(seed)
    template = [f"t{i}" for i in range(words)]
    out: list[list[str]] = []
    for i in range(n):
        page = list(out[-1]) if i % 10 == 9 else list(template)
        for at in r.sample(range(words), 1 if i % 10 == 9 else changed):
            page[at] = f"own{r.randrange(10**9)}"
        out.append(page)
    return [" ".join(p) for p in out]


def _shingles(text: str) -> set[str]:
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def _overlaps(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, intersections of all pairs) of the texts' shingle sets."""
    sets = [_shingles(t) for t in texts]
    number = {s: k for k, s in enumerate(set().union(*sets))}
    grid = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        grid[i, [number[x] for x in s]] = 1
    return grid.sum(1).astype(int), (grid @ grid.T).astype(int)


def _components(linked: np.ndarray) -> list[int]:
    root = list(range(len(linked)))
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = root[i], root[j]
        if a != b:
            root = [min(a, b) if x in (a, b) else x for x in root]
    return root


@pytest.mark.parametrize("changed", [1, 2, 4])
def test_components_of_templates_by_brute_force(spark, changed):
    """With one word changed nearly all pages are linked through others, with two or four only the planted copies are."""
    texts = _pages(900, 100, changed, changed)
    size, both = _overlaps(texts)
    want = _components(100 * both >= 85 * (size[:, None] + size[None, :] - both))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs, block=64).collect()}
    assert got == dict(enumerate(want))


def _mixed_sets(r: random.Random) -> list[list[int]]:
    """Sets of unlike sizes over common and own elements, with copies, subsets and sets of common elements alone."""
    out = [list(range(60))]
    for i in range(160):
        own = [10_000 * i + k for k in range(1000, 1000 + r.choice([0, 1, 3, 6, 9, 20]))]
        common = r.sample(range(60), r.choice([20, 50, 56, 60]))
        out.append(own + common if i % 5 else r.sample(out[-1], max(1, int(len(out[-1]) * 0.9))))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_every_similar_pair_meets_in_a_posting(spark, percent):
    sets = _mixed_sets(random.Random(percent))
    rows = spark.createDataFrame([(i % 2, i, i, sorted(s)) for i, s in enumerate(sets)], "key long, unit long, tree long, elements array<bigint>")
    postings, _ = grouping._prefixes(rows.drop("elements"), lambda rest: rest.join(rows.select("unit", "elements"), "unit"), percent, 16, 16)
    met: dict[int, list] = {}
    for x in postings.collect():
        met.setdefault(x.key, []).append(x)
    pairs = {tuple(sorted((x.unit, y.unit))) for xs in met.values() for x in xs for y in xs if x.unit < y.unit and (x.role or y.role)}
    for i, a in enumerate(sets):
        for j in range(i + 2, len(sets), 2):
            both = len(set(a) & set(sets[j]))
            if 100 * both >= percent * (len(set(a) | set(sets[j]))):
                assert (i, j) in pairs


def test_rows_of_templates_grow_with_the_pages(spark):
    """Pages with two changed places, none of them linked, have next to no posting in common: hardly anything is compared across blocks."""
    r = random.Random(7)
    texts = [" ".join(f"own{i}" if k in (a, a + b) else f"t{k}" for k in range(100)) for i in range(1500) for a, b in [(r.randrange(5, 45), r.randrange(5, 45))]]
    sets = [(1, i, i, [hash(s) for s in _shingles(t)]) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(sets, "key long, unit long, tree long, elements array<bigint>")
    postings, _ = grouping._prefixes(rows.drop("elements"), lambda rest: rest.join(rows.select("unit", "elements"), "unit"), 85, 256, 16)
    more = grouping._across_trees(postings)
    assert more is None or more.count() < 2 * len(texts)


def test_roles_and_large_trees_in_blocks(spark):
    """Every pair of two trees with a true role meets in a group, none of one large tree alone does, and copies stay few."""
    rows = [(1, i, 0 if i < 500 else i, i % 7 == 0, 10) for i in range(600)] + [(2, i, 5, True, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "key long, unit long, tree long, role boolean, blocks long")
    groups: dict[int, list] = {}
    for x in grouping._across_trees(df).collect():
        assert x.key == 1
        groups.setdefault(x.group, []).append(x)
    met = {(min(x.unit, y.unit), max(x.unit, y.unit)) for xs in groups.values() for x in xs for y in xs if x.unit != y.unit}
    for _, i, tree, role, _ in rows[:600]:
        for _, j, other, second, _ in rows[i + 1 : 600]:
            if tree != other and (role or second):
                assert (i, j) in met
    assert all(len({x.tree for x in xs}) > 1 for xs in groups.values())


def test_rows_of_one_id_and_repeats_in_a_template(spark):
    """An id with two texts links both, repeated rows count once, and odd rows stay as they are."""
    texts = _pages(400, 100, 2, 3)
    rows = [*enumerate(texts), (0, texts[0]), (0, texts[9]), (500, None), (None, texts[5]), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("key", "set", "role", "elements")})
    got = near_dedup.near_duplicates(docs, block=64).collect()
    by_id = {x.doc_id: x.component_id for x in got if x.doc_id is not None}
    assert by_id[9] == by_id[8] == by_id[0] == 0 and by_id[500] == 500 and by_id[501] == 501
    assert [x.component_id for x in got if x.doc_id is None] == [None] and len(got) == len(rows)
