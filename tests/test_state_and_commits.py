"""Committed versions, daily counts, language of whole shops, and streams over several micro-batches."""

import datetime
import random

import pytest
from bazaarflow.operators import analytics, messages
from bazaarflow.sources import files
from bazaarflow.streaming import jobs, queries
from pyspark.sql import functions as F

BEGIN = datetime.datetime(2026, 1, 1)


def values(df):
    return sorted(tuple(r) for r in df.collect())


# commits


def test_commits_replace_keys_and_keep_versions(spark, tmp_path):
    path = str(tmp_path / "faqs")
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "slug string, n int")
    assert files.commit(one, path, "slug") == 1
    assert files.commit(spark.createDataFrame([("b", 9), ("b", 10), ("c", 4)], one.schema), path, "slug") == 2
    assert files.commit(spark.createDataFrame([(None, 5)], one.schema), path, "slug") == 3
    now = files.read_committed(spark, path, "slug")
    assert now.columns == ["slug", "n"] and {(r.slug, r.n) for r in now.collect()} == {("a", 1), ("b", 9), ("b", 10), ("c", 4), (None, 5)}
    assert {(r.slug, r.n) for r in files.read_committed(spark, path, "slug", 1).collect()} == {("a", 1), ("b", 2), (None, 3)}
    with pytest.raises(FileNotFoundError):
        files.read_committed(spark, path, "slug", 7)


def test_an_aborted_rewrite_is_never_read(spark, tmp_path):
    path = str(tmp_path / "faqs")
    good = spark.createDataFrame([("a", 1)], "slug string, n int")
    files.commit(good, path, "slug")
    broken = good.select("slug", F.raise_error(F.lit("stop")).cast("int").alias("n"))
    with pytest.raises(Exception):
        files.commit(broken, path, "slug")
    assert values(files.read_committed(spark, path, "slug")) == [("a", 1)]
    # data and manifest written, but the job stops before its log row
    good.withColumn("n", F.lit(7)).write.parquet(f"{path}/data/{'0' * 32}")
    spark.createDataFrame([("a", "0" * 32)], "key string, folder string").write.parquet(f"{path}/manifest/{'0' * 32}")
    assert values(files.read_committed(spark, path, "slug")) == [("a", 1)]
    assert files.commit(good.withColumn("n", F.lit(2)), path, "slug") == 2
    assert values(files.read_committed(spark, path, "slug")) == [("a", 2)]


def test_two_writers_of_a_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "faqs")
    rows = spark.createDataFrame([(1,)], "n int")
    seen = files._versions

    def other_first(spark_, path_):
        found = seen(spark_, path_)
        if not found:  # another writer commits between our look and our log row
            spark.range(1).select(F.lit(1).alias("version"), F.lit("0" * 32).alias("name")).write.mode("append").json(f"{path_}/log")
        return found

    monkeypatch.setattr(files, "_versions", other_first)
    with pytest.raises(files.Conflict):
        files.commit(rows, path)


# daily counts


def log(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, source string, lang string, sentiment string, bypass string, faq_source string, faq_id string")


def random_log(r, days, n):
    pick = lambda *v: r.choice(v)
    return [(BEGIN + datetime.timedelta(days=r.choice(days), seconds=r.randrange(86_400)), pick("faq", "ollama", "greeting", "rag"), pick("english", "manglish"), pick("a", "", None), pick("", "x", "y"), pick("s", None), pick(None, *(f"f{k}" for k in range(40)))) for _ in range(n)]


def test_counts_of_days_add_up_and_a_day_is_replaced(spark, tmp_path):
    r, path = random.Random(1), str(tmp_path / "days")
    first, again = random_log(r, [0, 1, 2], 400), random_log(r, [1], 150)
    analytics.write_days(analytics.daily_counts(log(spark, first)), path)
    analytics.write_days(analytics.daily_counts(log(spark, again)), path)
    counts = spark.read.parquet(path)
    whole = log(spark, [x for x in first if x[0].date() != datetime.date(2026, 1, 2)] + again)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, analytics.stats_of_days(counts).collect())) == sorted(map(key, analytics.log_stats(whole).collect()))
    assert [tuple(x) for x in analytics.top_faqs_of_days(counts, 7).collect()] == [tuple(x) for x in analytics.top_faqs(whole, 7).collect()]


# language of a shop


def by_window(rows):
    """{msg_id: held} one by one; rows: (slug, session, msg_id, order, preference)."""
    held, out = {}, {}
    for slug, session, msg, _, preference in sorted(rows, key=lambda x: (x[3] is not None, x[3] or 0, x[2])):
        out[msg] = held.get((slug, session))
        held[slug, session] = preference or held.get((slug, session))
    return out


@pytest.mark.parametrize("partitions", [1, 8])
def test_language_without_sessions_equals_one_by_one(spark, partitions):
    r = random.Random(partitions)
    rows = [(r.choice(["a", "b", None]), r.choice([None, None, 1, 2]), k, r.choice([*range(0, 6000, 7), None]), r.choice([None] * 6 + ["manglish", "english"])) for k in range(1500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "slug string, session_id long, msg_id long, at long, p string").withColumn("message", F.lit("hello")).repartition(partitions)
    got = messages.sticky_language(df, F.col("p"), F.lit("english"), "at")
    assert {x.msg_id: x.held for x in got.collect()} == by_window(rows)


def test_a_shop_of_a_million_messages_spreads(spark):
    rows = spark.range(1_000_000).select(F.lit("a").alias("slug"), F.col("id").alias("msg_id"), F.when(F.col("id") % 1000 == 3, F.when(F.col("id") % 2000 == 3, "manglish").otherwise("english")).alias("p"))
    held = messages.held_as_of(rows, ["slug"], "msg_id", F.col("p"), F.floor(F.col("msg_id") / 10_000))
    spread = held.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("held") == "manglish").alias("m")).collect()
    assert sum(x.n for x in spread) == 1_000_000 and max(x.n for x in spread) < 600_000
    assert sum(x.m for x in spread) == 500_000


# streams


def arriving(spark, folder, batches, schema):
    """A stream that takes one of the batches at a time, in order."""
    import os

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        for f in os.listdir(f"{folder}/{k}"):
            os.utime(f"{folder}/{k}/{f}", (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/*")


EVENTS = "slug string, session_id long, msg_id long, ts timestamp, preference string"


def events_held(spark, tmp_path, batches, **options):
    out = str(tmp_path / "out")
    frame = jobs.sticky_language_events(arriving(spark, str(tmp_path / "in"), batches, EVENTS), "1 hour", **options)
    with queries.rocksdb(spark):
        frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(frame.schema).parquet(out).collect()
    assert len(rows) == len({x.msg_id for x in rows})
    return {x.msg_id: x.held for x in rows}


def test_language_of_shuffled_micro_batches_equals_the_window(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"s{r.randrange(2)}", r.choice([1, 2]), k, BEGIN + datetime.timedelta(seconds=r.randrange(20_000)), r.choice([None] * 5 + ["m", "e"])) for k in range(200)]
    come = sorted(rows, key=lambda x: x[3].timestamp() + r.uniform(0, 3000))  # each less than the hour late
    got = events_held(spark, tmp_path, [come[k : k + 50] for k in range(0, 200, 50)])
    want, passed = by_window(rows), max(x[3] for x in rows) - datetime.timedelta(hours=1)
    assert got == {x[2]: want[x[2]] for x in rows if x[3] <= passed} and len(got) > 100


def test_late_rows_and_forgotten_preferences(spark, tmp_path):
    at = lambda minutes: BEGIN + datetime.timedelta(minutes=minutes)
    first = [("s", 1, 1, at(0), "m"), ("s", 1, 2, at(10), None), ("s", 1, 3, at(50), None), ("s", 1, 4, at(500), None)]
    late = [("s", 1, 5, at(20), "e"), ("s", 1, 6, at(460), None), ("s", 1, 7, at(900), None)]
    got = events_held(spark, tmp_path, [first, late], ttl_ms=30 * 60_000)
    # 5 comes after the watermark (440 minutes) and is left out; 3 and later ones come after the preference was forgotten
    assert got == {1: None, 2: "m", 3: None, 6: None, 4: None}


def test_settings_change_between_batches_and_open_messages_are_answered(spark, tmp_path):
    settings = str(tmp_path / "settings")
    put = lambda word, answer: files.commit(spark.createDataFrame([("a", word, answer)], "slug string, word string, answer string"), settings)
    put("red", "first")

    def read(session):
        return files.read_committed(session, settings)

    def routed(batch, config):
        rows = batch.join(config, "slug", "left")
        hit = F.col("message").contains(F.col("word"))
        return rows.select("msg_id", "message", F.when(hit, "blocked").otherwise("open").alias("route"), F.when(hit, "guard").otherwise("open").alias("source"), F.lit(None).cast("string").alias("faq_id"), F.lit(None).cast("double").alias("faq_score"))

    def answered(open_, config):
        found = open_.join(config, "slug").where(F.col("message").contains("help"))
        return found.select("msg_id", F.lit("match").alias("route"), F.lit("faq").alias("source"), F.col("answer").alias("faq_id"), F.lit(1.0).alias("faq_score"))

    schema = "msg_id long, slug string, message string"
    texts = ["red", "blue", "help", "none"]
    stream = arriving(spark, str(tmp_path / "in"), [[(k, "a", m) for k, m in enumerate(texts)]], schema)
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    jobs.route_batches(stream, read, routed, out, state, answered).awaitTermination()
    put("blue", "second")
    more = spark.createDataFrame([(10 + k, "a", m) for k, m in enumerate(texts)], schema).coalesce(1)
    more.write.parquet(str(tmp_path / "in" / "1"))
    jobs.route_batches(stream, read, routed, out, state, answered).awaitTermination()
    got = {x.msg_id: (x.route, x.source, x.faq_id) for x in spark.read.parquet(out).collect()}
    free, one, two = ("open", "open", None), ("match", "faq", "first"), ("match", "faq", "second")
    guard = ("blocked", "guard", None)
    assert got == {0: guard, 1: free, 2: one, 3: free, 10: free, 11: guard, 12: two, 13: free}


class Calls:
    """A stand-in for a handle, its states and its timers, which counts what is asked of them."""

    def __init__(self):
        self.n, self.value, self.rows = 0, None, {}

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            if name in ("getValueState", "getMapState"):
                return self
            if name == "exists":
                return self.value is not None
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            elif name == "updateValue":
                self.rows[args[0]] = args[1]
            elif name == "getValue":
                return self.rows[args[0]]
            elif name == "keys":
                return list(self.rows)
            elif name == "getCurrentWatermarkInMs":
                return 0
            elif name == "getExpiryTimeInMs":
                return 10_000

        return call


def test_a_session_is_read_and_written_once_a_batch():
    import pandas as pd

    calls, held = Calls(), jobs.HeldLanguage(0)
    held.init(calls)
    part = pd.DataFrame({"msg_id": range(500), "ms": range(1, 501), "preference": ["m" if k == 3 else None for k in range(500)]})
    assert list(held.handleInputRows(("s",), iter([part, part]), calls)) == []
    out = pd.concat(held.handleExpiredTimer(("s",), calls, calls))
    assert out.msg_id.tolist() == list(range(500)) and out.held.tolist() == [None] * 4 + ["m"] * 496
    assert calls.n < 30
