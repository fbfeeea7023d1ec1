import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeats and ties, with extra columns whose names clash with internal ones."""
    base = "the quick brown fox jumps over the lazy dog and runs away from all of them again"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, "two words", "en", "b"),
        (6, "TWO\twords", "en", "b"),
        (None, base + " null id", "en", None),
        (None, None, "en", "b"),
        (7, " ".join(f"word{i}" for i in range(60_000)), "en", "a"),
        (8, " \n\t ", "en", "c"),
        (9, "naïve ÉCOLE straße ＩＤＩＯＴ 日本語のテキスト", "de", "c"),
        (10, "x" * 300_000, "en", "c"),
        (11, "line one of the text\nline two of the text\nline one of the text", "en", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["row", "key", "shard", "tokens", "group", "node", "_gone", "_bad", "md5", "size", "mix_source", "d", "component", "score"]
    return df.withColumns({n: F.lit("clash") for n in names}).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
