"""Readers and writers: FAQ packs, items, shop settings, chat logs; versioned rewrites."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAQ = "array<struct<category: string, question: string, questions: array<string>, answer: string, q: string, a: string>>"
ITEM = "name string, category string, description string, price bigint, price_min bigint, price_max bigint, gender string"
CONFIG = (
    "bot_name string, shop_name string, shop_type string, location string, city string, state string, hours struct<weekdays: string, sunday: string, holiday: string>, contact struct<whatsapp: string, phone: string, email: string>, "
    "delivery struct<areas: string, free_above: string, days: string>, returns struct<days: int, condition: string, refund_days: string>, first_offer struct<code: string, description: string>, escalate struct<whatsapp: string, email: string>, "
    "payment array<string>, allowed_categories array<string>, escalate_topics array<string>, blocked_topics array<string>, blocked_reply struct<manglish: string, english: string>, off_domain_signals array<string>, is_veg boolean, shop_gender string"
)
LOG = "timestamp timestamp, lang string, message string, sentiment string, confidence double, sent_source string, faq_source string, source string, faq_id string, faq_score double, escalate boolean, bypass string, reply string"
LISTS = ("faqs", "questions", "items", "data")


def _slug(path: F.Column) -> F.Column:
    """The folder that holds the file, without a partition's name."""
    return F.regexp_extract(path, r"(?:[^/=]*=)?([^/=]+)/[^/]+$", 1)


def read_faq_packs(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """FAQ files: an array, or an object that holds it; byte order marks and trailing commas are forgiven.

    shop_type and lang come from the file's name ``<type>_<lang>.json``, by ``types`` for aliases. ``from_list`` marks a
    question taken from a list. Unreadable files give no rows.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    text = F.regexp_replace(F.regexp_replace(F.trim("value"), "^﻿", ""), r",(\s*[\]}])", "$1")
    stem = F.regexp_replace(F.regexp_replace("file", r"\.json$", ""), "%20", " ")
    held = [F.get_json_object("text", f"$.{k}") for k in LISTS]
    rows = raw.withColumn("text", text).withColumn("array", F.when(F.col("text").startswith("["), F.col("text")).otherwise(F.coalesce(*held)))
    rows = rows.withColumn("lang", F.regexp_extract(stem, "_([A-Za-z]+)$", 1)).withColumn("shop_type", F.regexp_replace(stem, "_[A-Za-z]+$", ""))
    if types:
        rows = rows.withColumn("shop_type", F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in types.items() for v in kv]), F.col("shop_type")), F.col("shop_type")))
    out = rows.select("shop_type", "lang", F.posexplode(F.from_json("array", FAQ)).alias("pos", "f"))
    first = F.try_element_at("f.questions", F.lit(1))
    return out.select("shop_type", "lang", "pos", "f.category", F.coalesce("f.question", "f.q", first).alias("question"), F.coalesce("f.answer", "f.a").alias("answer"), F.coalesce("f.question", "f.q").isNull().alias("from_list"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item lists ``<slug>/<file>.json`` of many shops, in file order."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.select(_slug(F.col("path")).alias("slug"), F.posexplode(F.from_json("value", f"array<struct<{ITEM.replace(' string', ': string').replace(' bigint', ': bigint')}>>")).alias("item_pos", "i")).select("slug", "item_pos", "i.*")


def read_configs(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """Nested shop settings ``<slug>/<file>.json``; plain keys fall back to ``defaults``, and keys beyond ``CONFIG`` are kept as texts in ``extra``."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return _configs(raw.select(_slug(F.col("path")).alias("slug"), "value"), defaults)


def read_config_packs(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """``read_configs`` for many shops: files of lines, each the settings of a shop with its ``slug`` among the keys."""
    raw = spark.read.text(path).select(F.get_json_object("value", "$.slug").alias("slug"), "value")
    rows = _configs(raw, defaults)
    return rows.withColumn("extra", F.map_filter("extra", lambda k, v: k != "slug"))


def _configs(raw: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Settings of (slug, value)."""
    rows = raw.select("slug", F.from_json("value", CONFIG).alias("c"), F.from_json("value", "map<string, string>").alias("every"))
    known = F.array(*[F.lit(f.name) for f in rows.schema["c"].dataType.fields])
    rows = rows.select("slug", "c.*", F.map_filter(F.coalesce("every", F.create_map().cast("map<string, string>")), lambda k, v: ~F.array_contains(known, k)).alias("extra"))
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Chat log in CSV with a header; quotes are doubled, messages may span lines, malformed rows are skipped."""
    return spark.read.csv(path, schema=LOG, header=True, multiLine=True, escape='"', mode="DROPMALFORMED")


def append_log(rows: DataFrame, path: str, chars: int = 300, shops: str | None = None) -> None:
    """Append log rows by day to the log of all shops, replies cut to ``chars``; with ``shops`` also by shop and day to the shops' own logs."""
    cut = rows.withColumn("reply", F.substring("reply", 1, chars)).withColumn("log_date", F.to_date("timestamp"))
    cut.write.mode("append").partitionBy("log_date").parquet(path)
    if shops:
        cut.where("slug is not null").write.mode("append").partitionBy("slug", "log_date").parquet(shops)


class Conflict(Exception):
    """Another writer committed the same version first."""


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Committed versions with the names of their manifests, in order; of one version the first name counts."""
    try:
        rows = spark.read.schema("version int, name string").json(f"{path}/log").groupBy("version").agg(F.min("name").alias("name")).collect()
    except AnalysisException:
        return []
    return sorted((r["version"], r["name"]) for r in rows)


def commit(rows: DataFrame, path: str, by: str | None = None) -> int:
    """Write ``rows`` as the next version of the table at ``path`` and return its number; with ``by``, only the keys in ``rows`` are replaced.

    Data go to a folder of their own. A manifest then lists which folder holds which key, and a row in the log, one file that
    appears at once, makes the version readable. A job that stops before leaves the last version as it was, and folders
    that no manifest names. Earlier versions stay. Two writers of one version: the later one gets a ``Conflict``.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.write.mode("errorifexists").parquet(f"{path}/data/{name}")
    versions = _versions(spark, path)
    version = versions[-1][0] + 1 if versions else 1
    key = F.col(by).cast("string") if by else F.lit(None).cast("string")
    listed = spark.read.schema(rows.schema).parquet(f"{path}/data/{name}").select(key.alias("key")).distinct().withColumn("folder", F.lit(name))
    if by and versions:
        before = spark.read.parquet(f"{path}/manifest/{versions[-1][1]}").alias("b")
        listed = before.join(listed.select(F.col("key").alias("k")), F.col("key").eqNullSafe(F.col("k")), "left_anti").unionByName(listed)
    listed.write.parquet(f"{path}/manifest/{name}")
    spark.range(1).select(F.lit(version).cast("int").alias("version"), F.lit(name).alias("name")).coalesce(1).write.mode("append").json(f"{path}/log")
    if dict(_versions(spark, path))[version] != name:
        raise Conflict(f"version {version} of {path}")
    return version


def read_committed(spark: SparkSession, path: str, by: str | None = None, version: int | None = None) -> DataFrame:
    """The last committed version of a table, or the ``version`` asked for; ``by`` as it was committed."""
    versions = dict(_versions(spark, path))
    if not versions or version is not None and version not in versions:
        raise FileNotFoundError(f"no version {version or ''} of {path}")
    listed = spark.read.parquet(f"{path}/manifest/{versions[version or max(versions)]}")
    names = [r[0] for r in listed.select("folder").distinct().collect()]  # at most one for each commit
    rows = spark.read.parquet(*[f"{path}/data/{n}" for n in names]).withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]+)/", 1))
    if not by:
        return rows.drop("_folder")
    held = listed.select(F.col("key").alias("_key"), F.col("folder").alias("_held"))
    return rows.join(held, (F.col("_folder") == F.col("_held")) & F.col(by).cast("string").eqNullSafe(F.col("_key")), "left_semi").drop("_folder")
