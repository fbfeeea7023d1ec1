"""Work on pairs stays in its tasks: what queries write for shuffles grows with their rows, not with the pairs of alike texts."""

import random

from bazaarflow.operators import items, match
from bazaarflow.plans import scratch
from pyspark.sql import functions as F


def shuffled(spark, name, run):
    """What ``run`` gives, and the records and bytes that its jobs wrote for shuffles."""
    spark.sparkContext.setJobGroup(name, name)
    out, status, store = run(), spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {k for j in status.getJobIdsForGroup(name) for k in status.getJobInfo(j).stageIds}
    done = [store.lastStageAttempt(k) for k in stages]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, sum(s.shuffleWriteRecords() for s in done), sum(s.shuffleWriteBytes() for s in done)


def alike(spark, n=300):
    """Messages and FAQs of one shop that share most of their words, with plain pairs of each."""
    r = random.Random(5)
    text = lambda: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(1, 16)))
    asks, known = [(i, "s", text()) for i in range(n)] + [(n, "s", "..."), (n + 1, "s", None), (n + 2, "u", "a")], [(i, "s", text()) for i in range(n)] + [(n, "s", "?"), (n + 1, "s", None)]
    return spark.createDataFrame(asks, "msg_id long, slug string, message string"), spark.createDataFrame(known, "pos long, slug string, text string"), asks, known


def words(text):
    return {w for w in (text or "").split() if w.isalnum()}


def test_f1_of_alike_texts_makes_no_pairs(spark):
    m, f, asks, known = alike(spark)
    faqs = f.select("slug", F.col("pos").alias("faq_pos"), F.col("text").alias("q"), F.array().cast("array<string>").alias("variants"))
    got, records, _ = shuffled(spark, "f1", lambda: {x.msg_id: (x.faq_pos, x.score) for x in match.faq_f1(m, faqs).collect()})
    want = {}
    for i, slug, message in asks:
        scores = [(round(2 * len(words(message) & words(t)) / (len(words(message)) + len(words(t))) + 1e-12, 4), -p) for p, s, t in known if s == slug and words(message) and words(t)]
        if scores and max(scores)[0] >= match.F1_LEAST:
            want[i] = (-max(scores)[1], max(scores)[0])
    assert got == want and len(want) > 200
    assert records < 20 * len(asks)
    assert {x.msg_id: (x.faq_pos, x.score) for x in match.faq_f1(m, faqs, block=7).collect()} == want


def test_chunks_of_alike_texts_make_no_pairs(spark):
    m, f, asks, known = alike(spark)
    chunks = f.withColumnRenamed("pos", "chunk_pos")
    rows = lambda **options: {(x.msg_id, x.chunk_pos, x.score) for x in match.chunks_for(m, chunks, 3, ["a", "b"], **options).collect()}
    got, records, _ = shuffled(spark, "chunks", rows)
    want = set()
    for i, slug, message in asks:
        own = words(message) - {"a", "b"}
        scores = [(-round(len(own & words(t)) / len(own), 6) if own else -0.1, p) for p, s, t in known if s == slug and (own & words(t) or not own)]
        want |= {(i, p, -score) for score, p in sorted(scores)[:3] if message is not None}
    assert got == want and len(want) > 800
    assert records < 20 * len(asks)
    assert rows(block=7) == want


def test_lists_are_kept_once_however_many_ask(spark, monkeypatch):
    """A whole category's answer joins its messages last: no table holds it once for a message."""
    rows = spark.createDataFrame([("s", i, f"Ring {i}", "r", None, 80) for i in range(300)], "slug string, item_pos int, name string, category string, description string, price bigint")
    asks = spark.createDataFrame([(i, "s", f"all rings{'!' * (i % 7)}", "english") for i in range(200)], "msg_id int, slug string, message string, lang string")
    letters, table = [], scratch.table

    def counted(df, label):
        out = table(df, label)
        letters.extend(out.agg(F.coalesce(F.sum(F.length(c)), F.lit(0))).first()[0] for c, kind in df.dtypes if kind == "string")
        return out

    monkeypatch.setattr(scratch, "table", counted)
    got = items.item_answers(asks, rows, None).collect()
    assert len(got) == 200 and {x.n for x in got} == {300} and len({x.reply for x in got}) == 1
    reply = got[0].reply
    assert reply.split("\n")[1:3] == ["• Ring 0 — ₹80", "• Ring 1 — ₹80"] and len(reply.split("\n")) == 302
    assert len(reply) * 2 > sum(letters)


def test_settings_of_shops_share_files(spark):
    """The settings come back as they are, and are not a file and a folder for each shop."""
    from pathlib import Path

    from bazaarflow.sources import queries

    base = Path(scratch.folder(spark).removeprefix("file:"))
    before = set(base.glob("files-config-*"))
    got = queries.src_config(spark, "/root/testdata/sf0.001").collect()
    (written,) = set(base.glob("files-config-*")) - before
    assert len(got) > 8 and {x.branch for x in got} == {x.slug.removeprefix("shop-") for x in got}
    assert len(list(written.rglob("*.txt"))) < len(got) / 4


def test_blocks_of_pairs_keep_their_tasks(spark):
    """Blocks of few bytes hold much work, so they are dealt to a fixed number of tasks, which Spark does not merge."""
    m, f, _, _ = alike(spark, 20)
    faqs = f.select("slug", F.col("pos").alias("faq_pos"), F.col("text").alias("q"), F.array().cast("array<string>").alias("variants"))
    for found in (match.faq_fuzzy(m, faqs), match.faq_f1(m, faqs)):
        assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
