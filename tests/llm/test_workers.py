"""How many Python workers a task of the pipeline takes: each holds its libraries and batches beside the executor's heap."""

import corpus_pipeline
from bazaarflow.llm import common, decontamination, grouping, line_dedup, mixing, near_dedup, sharding, toxicity

SF = "/root/testdata/sf0.001"


def _plans(monkeypatch) -> list[tuple[str, object]]:
    """Label and physical plan of each table that is written from now on."""
    seen, plain = [], common.materialise

    def kept(df, label):
        plan = df._jdf.queryExecution().executedPlan()
        seen.append((label, plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan))
        return plain(df, label)

    for module in (common, decontamination, grouping, line_dedup, mixing, near_dedup, sharding, toxicity):
        monkeypatch.setattr(module, "materialise", kept)
    return seen


def _most_in_a_task(plan) -> int:
    """The most Python stages between two exchanges."""
    most = 0

    def inside(node) -> int:
        nonlocal most
        own = sum(inside(node.children().apply(i)) for i in range(node.children().size())) + ("InArrow" in node.nodeName())
        most = max(most, own)
        return 0 if "Exchange" in node.nodeName() else own

    inside(plan)
    return most


def test_a_task_of_the_pipeline_takes_one_python_worker(spark, monkeypatch):
    seen = _plans(monkeypatch)
    assert corpus_pipeline.run(spark, SF).count() > 100
    most = {(label, _most_in_a_task(plan)) for label, plan in seen}
    assert {("near-sets", 1), ("near-matches", 1), ("near-links", 1), ("leak-probes", 1)} <= most
    assert {x for x in most if x[1] > 1} == set()


def test_a_task_of_line_dedup_takes_one_python_worker(spark, monkeypatch):
    seen = _plans(monkeypatch)
    line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert max(_most_in_a_task(plan) for _, plan in seen) == 1


def test_shards_are_planned_without_python_rows(spark, monkeypatch):
    """A table made of Python objects is read by Python workers of a second kind, which mapInArrow cannot use."""
    seen = _plans(monkeypatch)
    sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    plans = dict(seen)
    assert "LocalTableScan" in plans["shard-placed"].toString() and "ExistingRDD" not in plans["shard-placed"].toString()
