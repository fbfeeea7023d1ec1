"""Intermediate tables in the folder that the cluster shares: lineage is cut, and a lost executor costs one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for an unset local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if shared:
        return f"{shared.rstrip('/')}/bazaarflow-{app}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-bazaarflow-")
    return _local[app]


def table(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``table`` and its number of rows, which the files' footers tell."""
    written = table(df, label)
    return written, written.count()
