"""Views of the given tables in the shapes of the library: messages, FAQ pairs, items, shops, chat log, vectors.

Each has a Spark form and the same as SQL text for oracles. Ten shops share the tables; order columns are explicit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id * 1000 + turn as msg_id", "concat('shop-', conv_id % 10) as slug", "conv_id as session_id", "turn", "text as message")


def faqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it."""
    turns = read(spark, sf_dir, "conversations")
    q = turns.where("role = 'user'").selectExpr("conv_id", "turn", "text as q")
    a = turns.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 as turn", "text as a")
    return q.join(a, ["conv_id", "turn"]).selectExpr("concat('shop-', conv_id % 10) as slug", "conv_id * 1000 + turn as faq_pos", "concat('faq_', conv_id, '_', turn) as faq_id", "q", "a")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("concat('shop-', p_partkey % 10) as slug", "p_partkey as item_pos", "p_name as name", "p_type as category", "p_brand as brand", "cast(floor(p_retailprice) as bigint) as price", "p_size as size")


#: Other wordings of a question: its last two thirds, its first half, the rest from a quarter on.
PRIMARY = "substring(q, cast(floor(length(q) / 3) as int) + 1) as q"
VARIANTS = "{0}(substring(q, 1, cast(floor(length(q) / 2) as int)), ' ', lower(substring(q, cast(floor(length(q) / 4) as int) + 1))) as variants"


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FAQs in other wordings than the messages that they come from."""
    return faqs(spark, sf_dir).selectExpr("slug", "faq_pos", "faq_id", PRIMARY, VARIANTS.format("array"), "a", "if(faq_pos % 6 = 0, 'disclaimer', null) as faq_type")


#: A short description of an item; the words that ask about one; both as SQL of either engine.
DESCRIPTION = "concat(lower(replace(brand, '#', ' ')), 'x', size)"
ASK = """case item_pos % 7 when 0 then concat('Do you have ', name, '?') when 1 then concat(lower(category), ' undo') when 2 then concat('price of ', name, 's please')
  when 3 then concat('all ', split_part(name, ' ', 1), ' ', lower(category), ' ', lower(split_part(brand, '#', 2)), 'x', size, ' items') when 4 then concat('Is polish included in ', name, ' ', size, '?')
  when 5 then concat(split_part(name, ' ', 2), ' undo') else concat('list of ', split_part(name, ' ', 2), 's') end"""


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a description; some are named as the opposite of another."""
    return items(spark, sf_dir).selectExpr("slug", "item_pos", "if(size % 9 = 0, concat('Non-', name), name) as name", "category", f"{DESCRIPTION} as description", "price", "brand", "size")


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message about each item."""
    return items(spark, sf_dir).selectExpr("item_pos as msg_id", "slug", f"{ASK} as message", "if(item_pos % 2 = 0, 'manglish', 'english') as lang")


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).selectExpr("concat('shop-', s_suppkey) as slug", "s_suppkey as shop_pos", "s_name as shop_name", "lower(n_name) as city", "s_acctbal as balance")


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id as msg_id", "concat('shop-', user_id % 10) as slug", "user_id as session_id", "ts", "event_type as source", "value as confidence",
        "case when user_id % 3 = 0 then 'manglish' else 'english' end as lang",
        "case event_id % 5 when 0 then 'negative' when 1 then 'positive' when 2 then null when 3 then '' else 'neutral' end as sentiment",
        "case when event_type in ('click', 'view') then concat('faq_', user_id % 50) end as faq_id",
        "case when event_type = 'error' then 'blocked_topic' when event_type = 'signup' then 'social_chat' else '' end as bypass", "event_type = 'error' as escalate",
    )


MESSAGES = "(select conv_id * 1000 + turn as msg_id, 'shop-' || (conv_id % 10) as slug, conv_id as session_id, turn, text as message from conversations where role = 'user')"
FAQS = "(select 'shop-' || (q.conv_id % 10) as slug, q.conv_id * 1000 + q.turn as faq_pos, 'faq_' || q.conv_id || '_' || q.turn as faq_id, q.text as q, a.text as a from conversations q join conversations a on q.conv_id = a.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant')"
PHRASED = f"(select slug, faq_pos, faq_id, {PRIMARY}, {VARIANTS.format('list_value')}, a from {FAQS})"
ITEMS = "(select 'shop-' || (p_partkey % 10) as slug, p_partkey as item_pos, p_name as name, p_type as category, p_brand as brand, cast(floor(p_retailprice) as bigint) as price, p_size as size from part)"
DESCRIBED = f"(select slug, item_pos, case when size % 9 = 0 then 'Non-' || name else name end as name, category, {DESCRIPTION} as description, price, brand, size from {ITEMS})"
ASKS = f"(select item_pos as msg_id, slug, {ASK} as message, case when item_pos % 2 = 0 then 'manglish' else 'english' end as lang from {ITEMS})"
SHOPS = "(select 'shop-' || s_suppkey as slug, s_suppkey as shop_pos, s_name as shop_name, lower(n_name) as city, s_acctbal as balance from supplier join nation on s_nationkey = n_nationkey)"
LOG = """(select event_id as msg_id, 'shop-' || (user_id % 10) as slug, user_id as session_id, ts, event_type as source, value as confidence,
  case when user_id % 3 = 0 then 'manglish' else 'english' end as lang,
  case event_id % 5 when 0 then 'negative' when 1 then 'positive' when 2 then null when 3 then '' else 'neutral' end as sentiment,
  case when event_type in ('click', 'view') then 'faq_' || (user_id % 50) end as faq_id,
  case when event_type = 'error' then 'blocked_topic' when event_type = 'signup' then 'social_chat' else '' end as bypass, event_type = 'error' as escalate from events)"""
