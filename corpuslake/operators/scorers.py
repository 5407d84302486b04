"""Encoders and pair scorers that a caller plugs in: made once a worker, called with batches of Arrow columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..session import ship

#: Texts in, a matrix of one row each out; or questions and texts in, a score each out.
Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], np.ndarray]
CALL_ROWS = 256
_made: dict[tuple, Callable] = {}


def _ready(make: Callable, options: dict) -> Callable:
    key = (make.__module__, make.__qualname__, *sorted(options.items()))
    if key not in _made:
        _made[key] = make(**options)
    return _made[key]


def words_of(text: str, stop: frozenset = frozenset(rules.STOP_WORDS)) -> list[str]:
    """functions.text.tokens() for one text."""
    import regex

    return [w for w in regex.findall(r"[\p{L}\p{N}\p{M}_]{2,}", text.lower()) if w not in stop]


def hashed_words(dims: int = 64) -> Encoder:
    """Bags of words: each word adds 1 or -1 to one of dims components, both by its crc32; texts without words are zero vectors, others have length 1."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, text in enumerate(texts):
            for w in words_of(text):
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1 if h >> 31 else -1
        norms = np.sqrt((out * out).sum(1))
        return out / np.where(norms > 0, norms, 1)[:, None]

    return encode


def shared_words() -> Scorer:
    """The share of a question's distinct words that the text has (0 without words)."""

    def score(questions: list[str], texts: list[str]) -> np.ndarray:
        sets: dict[str, frozenset] = {}
        out = np.zeros(len(texts))
        for i, (q, t) in enumerate(zip(questions, texts, strict=True)):
            asked = sets.setdefault(q, frozenset(words_of(q)))
            out[i] = len(asked & set(words_of(t))) / len(asked) if asked else 0.0
        return out

    return score


def _mapped(names: list[str], inputs: list[int], make: Callable, options: dict, kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = _ready(make, options)
        for batch in batches:
            for at in range(0, batch.num_rows, CALL_ROWS):
                part = batch.slice(at, CALL_ROWS)
                values = call(*([x or "" for x in part.column(i).to_pylist()] for i in inputs))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(values), kind)], names=names)

    return run


def encode(df: DataFrame, text: str, make: Callable[..., Encoder] = hashed_words, out: str = "embedding", **options) -> DataFrame:
    """df with the encoder's vector of a text column (null: empty). make(**options) is called once a worker process."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(_mapped([*df.columns, out], [df.columns.index(text)], make, options, pa.list_(pa.float64())), schema)


def score_pairs(df: DataFrame, question: str, text: str, make: Callable[..., Scorer] = shared_words, out: str = "ce_score", **options) -> DataFrame:
    """df with the scorer's value for a question and a text column (null: empty)."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return df.mapInArrow(_mapped([*df.columns, out], [df.columns.index(question), df.columns.index(text)], make, options, pa.float64()), schema)


def rerank(hits: DataFrame, question_key: str, key: str, k: int = 3, ce: str | None = None, weight: float = 0.8) -> DataFrame:
    """The k best hits of each question, with their rank; ties go by key. With the column ce, score is first weight parts of ce, put between 0 and 1 by
    the least and greatest of the question (1 where they are the same), and the rest of score. Where ce is null for a hit of a question, its hits keep their scores."""
    if ce:
        all_ = Window.partitionBy(question_key)
        low, high = F.min(ce).over(all_), F.max(ce).over(all_)
        cross = F.when(high > low, (F.col(ce) - low) / (high - low)).otherwise(1.0)
        whole = F.count(ce).over(all_) == F.count("*").over(all_)
        hits = hits.withColumn("score", F.when(whole, F.round(weight * cross + (1 - weight) * F.col("score") + 1e-9, 6)).otherwise(F.col("score")))
    w = Window.partitionBy(question_key).orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
