"""Deterministic hash embeddings, and a batch interface for real models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Bytes of a digest.
DIGEST = 32


def hash_embedding(text: str, dimension: int) -> np.ndarray:
    """Bytes of SHA-256 of the text and a big-endian counter, scaled to -1 .. 1, at unit length."""
    data, counter = b"", 0
    while len(data) < dimension:
        data += hashlib.sha256(text.encode() + counter.to_bytes(4, "big")).digest()
        counter += 1
    values = np.frombuffer(data[:dimension], np.uint8) / 127.5 - 1.0
    length = float(np.sqrt((values * values).sum()))
    return values / length if length else values


def embed(text: Column, model: Callable[[], Callable[[list[str]], list[np.ndarray]]], batch: int = 16) -> Column:
    """Vectors of texts by a model that is made once for each Python worker and takes lists."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for series in batches:
            found: list[np.ndarray] = []
            for at in range(0, len(series), batch):
                found += run(series.iloc[at : at + batch].fillna("").tolist())
            yield pd.Series([list(map(float, x)) for x in found])

    return vectors(text)


def hashed(text: Column, dimension: int = 64) -> Column:
    """``hash_embedding`` of texts, nulls as empty ones; Python gets their digests alone, whatever their length."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    digests = [F.unhex(F.sha2(F.concat(data, F.lit(bytearray(i.to_bytes(4, "big")))), 256)) for i in range(-(-dimension // DIGEST))]

    @F.pandas_udf("array<double>")
    def scaled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            data = np.frombuffer(b"".join(series), np.uint8).reshape(len(series), -1)
            values = np.ascontiguousarray(data[:, :dimension]) / 127.5 - 1.0
            length = np.sqrt((values * values).sum(axis=1, keepdims=True))
            yield pd.Series(list(values / np.where(length > 0, length, 1.0)))

    return scaled(F.concat(*digests))
