"""The three places where a model plugs in: an encoder, a scorer of labels, a generator of replies. Each is a plain function of a batch.

The functions run in Arrow batches inside tasks and are loaded once for a batch of rows; a failing batch fails its task, which Spark
repeats elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import tables as t
from . import match
from . import messages as m


def encoded(rows: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], out: str = "vec") -> DataFrame:
    """Rows with a unit vector of ``text`` by ``encode(texts) -> matrix``; a null text is encoded as an empty one, a zero vector stays."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        v = np.asarray(encode([v or "" for v in texts]), np.float32).reshape(len(texts), -1)
        return pd.Series(list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)))

    return rows.withColumn(out, run(F.col(text)))


def scored(rows: DataFrame, key: str, text: str, labels: list[str], score: Callable[[list[str], list[str]], np.ndarray]) -> DataFrame:
    """(key, label, score) of each row and label by ``score(texts, labels) -> matrix``."""
    schema = T.StructType([rows.schema[key], T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = np.asarray(score([v or "" for v in b[text]], labels), float).reshape(len(b), len(labels))
            yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), len(labels)), "label": np.tile(labels, len(b)), "score": s.reshape(-1)})

    return rows.select(key, text).mapInPandas(run, schema)


def replied(requests: DataFrame, generate: Callable[[pd.DataFrame], list[str | None]]) -> DataFrame:
    """(msg_id, reply, ok) of model requests by ``generate(batch) -> replies``; a null reply is one of a degraded model."""
    schema = T.StructType([requests.schema["msg_id"], T.StructField("reply", T.StringType()), T.StructField("ok", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies = list(generate(b))
            yield pd.DataFrame({"msg_id": b.msg_id, "reply": [r or "" for r in replies], "ok": [r is not None for r in replies]})

    return requests.mapInPandas(run, schema)


def letters(texts: list[str]) -> np.ndarray:
    """A plain encoder: how often each letter from a to z occurs."""
    return np.array([[v.lower().count(chr(97 + k)) for k in range(26)] for v in texts], float)


def word_share(texts: list[str], labels: list[str]) -> np.ndarray:
    """A plain scorer: the share of words that hold the label."""
    return np.array([[sum(label in w for w in v.lower().split()) / max(1, len(v.split())) for label in labels] for v in texts])


def _encoded(s, d):
    v = encoded(t.messages(s, d), "message", letters)
    return v.select("msg_id", F.size("vec").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double")), 3).alias("norm"), F.round(F.get("vec", F.lit(4)).cast("double") ** 2, 3).alias("e"))


def _scored(s, d):
    rows = scored(t.messages(s, d), "msg_id", "message", ["ti", "th"], word_share)
    return m.model_sentiment(rows, "msg_id", {"ti": "positive", "th": "negative"})


def _replied(s, d):
    """Every request of the messages answered by its kind, and the answers cleaned."""
    answers = replied(match._requests(s, d), lambda b: [None if k == "free" else f"Sure! {k}" for k in b.kind])
    rows = answers.select("msg_id", "reply", "ok", F.lit(True).alias("had_facts"), F.lit(None).cast("string").alias("offer_code"), F.lit(None).cast("string").alias("answer"))
    return match.clean_replies(rows, "^Sure! ", "never", "Please ask us.")


QUERIES = {"plug_encode": _encoded, "plug_score": _scored, "plug_generate": _replied}
_COUNTS = "list_transform(range(97, 123), lambda k: length(regexp_replace(lower(message), '[^' || chr(k::int) || ']', '', 'g')))"
SQL = {
    "plug_encode": f"select msg_id, cast(26 as int) as dims, case when list_sum(c) > 0 then 1.0 else 0.0 end::double as norm, round(case when list_sum(c) > 0 then c[5] * c[5] / list_sum(list_transform(c, lambda v: v * v)) else 0 end, 3) as e from (select msg_id, {_COUNTS} as c from {t.MESSAGES})",
    "plug_score": f"""select msg_id, case when greatest(a, b) < 0.45 then 'neutral' when a >= b and not (a = b) then 'positive' when a = b then 'positive' else 'negative' end as sentiment, round(greatest(a, b), 3) as confidence from (
        select msg_id, len(list_filter(w, lambda v: contains(v, 'ti'))) / greatest(1, len(w)) as a, len(list_filter(w, lambda v: contains(v, 'th'))) / greatest(1, len(w)) as b from (select msg_id, list_filter(regexp_split_to_array(trim(lower(message)), '\\s+'), lambda v: v <> '') as w from {t.MESSAGES}))""",
    "plug_generate": f"select msg_id, case when kind = 'free' then 'Please ask us.' else kind end as reply from ({match.SQL['gen_llm_requests']})",
}
