"""How many steps components take, and in how many bands similar lines are compared."""

import random

from pyspark.sql import functions as F

from bazaarflow.llm import common, grouping, line_dedup


def _counted(monkeypatch) -> list[str]:
    labels: list[str] = []
    plain = common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, label: (labels.append(label), plain(df, label))[1])
    return labels


def test_a_chain_in_one_task_is_joined_at_once(spark, monkeypatch):
    labels = _counted(monkeypatch)
    n = 3000
    chain = spark.range(1, n, 1, 1).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = {x.node: x.root for x in common.components(chain).collect()}
    assert got == dict.fromkeys(range(n), 0)
    assert len(labels) <= 3


def test_chains_and_repeats_over_tasks(spark, monkeypatch):
    """Shuffled chains of all lengths, loops and repeated edges over many tasks, with negative nodes."""
    monkeypatch.setattr(common, "NODES_HELD", 20)
    monkeypatch.setattr(common, "FEW_NODES", 10)
    monkeypatch.setattr(common, "EDGES_A_TASK", 50)
    r, edges, want = random.Random(4), [], {}
    for k in range(40):
        nodes = r.sample(range(-10_000 + 1000 * k, -9000 + 1000 * k), 1 + k)
        edges += [(a, b) if r.random() < 0.5 else (b, a) for a, b in zip(nodes, nodes[1:])]
        want |= dict.fromkeys(nodes, min(nodes)) if k else {}
    edges += [(a, a) for a, _ in edges[:50]] + edges[:200]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(16)
    assert {x.node: x.root for x in common.components(df).collect()} == want


def test_pairs_of_lines_are_compared_in_one_band(spark, monkeypatch):
    """Each pair of near copies shares several bands, all with the same two lines, and is sent to be compared once."""
    r = random.Random(8)
    texts = []
    for _ in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(40)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    sent, plain = {}, common.materialise

    def counted(df, label):
        out = plain(df, label)
        sent[label] = out.count()
        return out

    monkeypatch.setattr(grouping, "materialise", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_kept for x in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: 1 - i % 2 for i in range(120)}
    assert sent["line-links-rows"] == 120
