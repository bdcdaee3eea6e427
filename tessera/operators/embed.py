"""Embedding providers: hashed (the default), constant, or any function of texts; each distinct text is embedded once."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed(text: str, dim: int = 384) -> np.ndarray:
    """A unit vector made of SHA-256(text, counter) words, each scaled to [-1, 1]: portable and the same everywhere."""
    words: list[int] = []
    counter, read = 0, hashlib.sha256(text.encode())
    while len(words) < dim:
        each = read.copy()  # the text is read once
        each.update(struct.pack("<I", counter))
        words += struct.unpack("<8I", each.digest())
        counter += 1
    v = (np.array(words[:dim], dtype=np.float64) / 0xFFFFFFFF * 2 - 1).astype(np.float32)
    n = np.linalg.norm(v)
    return v / n if n else v


def provider(name: str = "hashed", dim: int = 384, encode: Callable[[list[str]], np.ndarray] | None = None) -> Callable[[list[str]], np.ndarray]:
    """'hashed', 'constant', or 'custom' with a function such as a model's session; a wrong dimension fails."""
    if name == "hashed":
        return lambda texts: np.array([hashed(t, dim) for t in texts], dtype=np.float32).reshape(-1, dim)
    if name == "constant":
        return lambda texts: np.full((len(texts), dim), 0.1, dtype=np.float32)
    if encode is None:
        raise ValueError(f"no provider named {name}")

    def checked(texts: list[str]) -> np.ndarray:
        out = np.asarray(encode(texts), dtype=np.float32)
        if out.shape != (len(texts), dim):
            raise ValueError(f"vectors of shape {out.shape}, not {(len(texts), dim)}")
        return out

    return checked


def embed(df: DataFrame, text: str = "content", into: str = "embedding", make: Callable[[], Callable[[list[str]], np.ndarray]] = provider) -> DataFrame:
    """df with vectors of its texts, null for null. make() is called once in each task, as a model is loaded there."""
    distinct = df.select(F.col(text).alias("__t")).where("__t is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in batches:
            yield pd.DataFrame({"__t": pdf["__t"], "__v": list(encode(pdf["__t"].tolist()))})

    return df.join(distinct.mapInPandas(run, "__t string, __v array<float>"), F.col(text) == F.col("__t"), "left").drop("__t", into).withColumnRenamed("__v", into)


def backfill(df: DataFrame, text: str, limit: int = 100, make: Callable = provider, into: str = "embedding") -> DataFrame:
    """(id, vector) of up to `limit` rows that have text and no vector, the smallest ids first; a patch for the table."""
    todo = df.where(F.col(into).isNull() & (F.coalesce(F.col(text), F.lit("")) != "")).select("id", text).orderBy("id").limit(limit)
    return embed(todo, text, into, make).select("id", into)
