"""Embedding providers. The default hashes tokens into a fixed number of dimensions; a model can take its place."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Provider(Protocol):
    dim: int
    tag: str
    max_tokens: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...

    def count_tokens(self, text: str) -> int: ...


class HashingProvider:
    """Signed feature hashing of words and word pairs, L2-normalised; the same everywhere."""

    def __init__(self, dim: int = 384) -> None:
        self.dim, self.tag, self.max_tokens = dim, f"hashing-{dim}", 512

    def count_tokens(self, text: str) -> int:
        return len(re.findall(r"\w+|[^\w\s]", text))

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", (t or "").lower())
            for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_table(df: DataFrame, provider: Provider, text_col: str, out_col: str, size: int = 256, most_tokens: int = 8192) -> DataFrame:
    """Adds the vectors of a column, made in calls of at most ``size`` texts and, as far as single texts allow, ``most_tokens`` tokens.

    A call that fails is made once more, text by text.
    """

    def calls(texts: list[str]) -> Iterator[list[str]]:
        held, tokens = [], 0
        for t in texts:
            n = min(provider.count_tokens(t), provider.max_tokens)
            if held and (len(held) == size or tokens + n > most_tokens):
                yield held
                held, tokens = [], 0
            held.append(t)
            tokens += n
        if held:
            yield held

    def made(texts: list[str]) -> list[np.ndarray]:
        try:
            return list(provider.embed_batch(texts))
        except Exception:
            return [provider.embed_batch([t])[0] for t in texts]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = pdf[text_col].fillna("").tolist()
            yield pdf.assign(**{out_col: [v for c in calls(texts) for v in made(c)]})

    fields = [f for f in df.schema.fields if f.name != out_col]
    return df.mapInPandas(run, T.StructType([*fields, T.StructField(out_col, T.ArrayType(T.FloatType()))]))


def embed(text: Column, provider: Provider) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(provider.embed_batch(texts.tolist())), index=texts.index)

    return run(text)
