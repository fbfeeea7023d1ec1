"""Registered streaming queries: the given tables as file streams, run to the end, and what they wrote."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import message_queries as mq
from ..plans import scratch
from ..plans import tables as t
from . import jobs


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = t.read(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parquet*")


def drained(frame: DataFrame) -> DataFrame:
    """Write a stream's appended rows until its source is exhausted and read them back."""
    spark = frame.sparkSession
    base = f"{scratch.folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    query = frame.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{base}/out")


def _messages(spark, sf_dir):
    return stream(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id * 1000 + turn as msg_id", "concat('shop-', conv_id % 10) as slug", "conv_id as session_id", "turn", "text as message")


def str_route(s, d):
    routed = jobs.route_stream(_messages(s, d), mq.config(s, d).drop("shop_name", "city"), mq.detected(), mq.PATTERNS, mq.LEXICON, mq.BROAD, mq.TOPICS, off_domain=mq.FOREIGN, blocked=mq.BLOCKS, barred=mq.BARRED)
    return drained(routed.drop("message"))


def str_sticky_lang(s, d):
    pref = F.when(F.lower("message").rlike("anou"), "english").when(F.lower("message").rlike("enver|thoring"), "manglish")
    return drained(jobs.sticky_language_stream(_messages(s, d).select("slug", "session_id", "turn", "msg_id", pref.alias("preference"))))


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams that begin within keep their state in RocksDB, as keyed state with timers needs it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def str_sticky_events(s, d):
    """The language in force before each event of a user, as far as the watermark has come."""
    rows = stream(s, d, "events").selectExpr("concat('shop-', user_id % 10) as slug", "user_id as session_id", "event_id as msg_id", "cast(ts as timestamp) as ts", "case event_type when 'signup' then 'manglish' when 'error' then 'english' end as preference")
    with rocksdb(s):
        return drained(jobs.sticky_language_events(rows))


def _log(s, d):
    return stream(s, d, "events").selectExpr("event_id as msg_id", "cast(ts as timestamp) as ts", "event_type as source", "event_type = 'error' as escalate")


def str_stats(s, d):
    """Windows closed by the watermark, by source."""
    return drained(jobs.stats_stream(_log(s, d)))


def str_dedup(s, d):
    return drained(jobs.dedup_stream(_log(s, d).unionByName(_log(s, d)))).select("msg_id", "source")


QUERIES = {"str_route": str_route, "str_sticky_lang": str_sticky_lang, "str_sticky_events": str_sticky_events, "str_stats": str_stats, "str_dedup": str_dedup}
_PREF = mq._PREF
SQL = {
    "str_route": mq.STREAMED,
    "str_sticky_lang": f"select msg_id, last_value(pref ignore nulls) over (partition by slug, session_id order by turn, msg_id rows between unbounded preceding and 1 preceding) as held from (select *, {_PREF} as pref from {t.MESSAGES})",
    "str_sticky_events": """select msg_id, held from (select event_id as msg_id, ts, max(ts) over () as newest, last_value(case event_type when 'signup' then 'manglish' when 'error' then 'english' end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as held from events)
        where date_trunc('milliseconds', ts) <= date_trunc('milliseconds', newest) - interval 2 hours""",
    "str_dedup": "select event_id as msg_id, event_type as source from events",
}
