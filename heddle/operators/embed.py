"""Text encoders: a table with text in, the same with unit vectors out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[DataFrame, str], DataFrame]
DIMENSIONS = 512


def hashed_words(df: DataFrame, column: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """df with ``embedding``: counts of lower-cased words and their last dotted parts, hashed, damped and normalised."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    names = df.columns

    def fill(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            places = [np.asarray(at, dtype=np.int64) for at in frame["_places"]]
            row = np.repeat(np.arange(len(places)), [len(at) for at in places])
            cell = row * dimensions + np.concatenate([np.zeros(0, np.int64), *places])
            v = np.log1p(np.bincount(cell, minlength=len(places) * dimensions).reshape(len(places), dimensions).astype(np.float64))
            size = np.linalg.norm(v, axis=1, keepdims=True)
            yield frame[names].assign(embedding=list(v / np.where(size > 0, size, 1)))

    return df.withColumn("_places", places).mapInPandas(fill, schema)


@lru_cache(maxsize=2)
def _model(name: str):
    """A sentence model, kept by the worker's process for its later tasks."""
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


def model_encoder(name: str) -> Encoder:
    """An encoder of the named sentence model, loaded once in each worker; needs its library there."""

    def encode(df: DataFrame, column: str) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _model(name)
            for frame in frames:
                v = model.encode(frame[column].fillna("").tolist(), batch_size=64, normalize_embeddings=True)
                yield frame.assign(embedding=[x.astype(float).tolist() for x in v])

        return df.mapInPandas(run, schema)

    return encode
