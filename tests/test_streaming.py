"""Streams against the same work on whole tables."""

import collections
import datetime

from pyspark.sql import functions as F

from bazaarflow.operators import message_queries as mq
from bazaarflow.operators import messages as m
from bazaarflow.plans import registry
from bazaarflow.plans import tables as t

SF = "/root/testdata/sf0.001"


def test_windowed_counts_equal_a_plain_count(spark):
    """Every window that the watermark has closed, with the counts of all its rows."""
    log = t.read(spark, SF, "events").selectExpr("cast(ts as timestamp) as ts", "event_type").collect()
    hour = lambda ts: ts.replace(minute=0, second=0, microsecond=0)
    count, escalated = collections.Counter((hour(r.ts), r.event_type) for r in log), collections.Counter(hour(r.ts) for r in log if r.event_type == "error")
    closed = max(r.ts for r in log) - datetime.timedelta(hours=2)
    got = {(r.start, r.source): (r.n, r.escalated) for r in registry.queries()["str_stats"](spark, SF).collect()}
    want = {k: (n, escalated[k[0]] if k[1] == "error" else 0) for k, n in count.items() if k[0] + datetime.timedelta(hours=1) <= closed}
    assert got == want and len(want) > 300


def test_language_state_equals_the_window(spark):
    pref = F.when(F.lower("message").rlike("anou"), "english").when(F.lower("message").rlike("enver|thoring"), "manglish")
    batch = m.sticky_language(t.messages(spark, SF), pref, F.lit("english")).select("msg_id", "held")
    stream = registry.queries()["str_sticky_lang"](spark, SF)
    rows = lambda df: sorted((r.msg_id, r.held or "") for r in df.collect())
    assert rows(batch) == rows(stream)


def test_routes_of_the_stream_equal_those_of_the_batch(spark):
    flagged = m.flags(t.messages(spark, SF), mq.config(spark, SF).drop("shop_name", "city"), mq.PATTERNS, mq.LEXICON, mq.BROAD, mq.TOPICS, mq.FOREIGN, mq.BLOCKS, mq.BARRED)
    batch = m.route(flagged, mq.detected()).drop("message")
    stream = registry.queries()["str_route"](spark, SF)
    assert sorted(map(str, batch.collect())) == sorted(map(str, stream.select(batch.columns).collect()))


def test_replayed_rows_pass_once(spark):
    got = registry.queries()["str_dedup"](spark, SF)
    assert got.count() == got.distinct().count() == t.read(spark, SF, "events").count()
