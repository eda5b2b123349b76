"""Services outside the engine: embedding vectors and language-model answers, behind two small protocols.

A provider is pickled to the executors and called with one Arrow batch's texts at a time. The fakes are
deterministic and serve tests; nothing tested depends on a real service.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class Answerer(Protocol):
    def answer(self, prompts: list[str]) -> list[str | None]: ...


class HashEmbedder:
    """Unit vectors from a hash of the text."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).normal(size=self.dim)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


class EchoAnswerer:
    """Answers each prompt by a function of it."""

    def __init__(self, f=lambda p: p):
        self.f = f

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [self.f(p) for p in prompts]


class FirstThatWorks:
    """Embedders tried in turn (keys, models, addresses): what one fails at, or gives another length for, the next is asked."""

    def __init__(self, *providers: Embedder):
        self.providers, self.dim = providers, providers[0].dim

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = [None] * len(texts)
        error = None
        for p in self.providers:
            todo = [i for i, v in enumerate(out) if v is None]
            try:
                got = p.embed([texts[i] for i in todo])
            except Exception as e:  # noqa: BLE001
                error = e
                continue
            for i, v in zip(todo, got):
                out[i] = v if v is not None and len(v) == self.dim else None
            if None not in out:
                return out
        if error is not None and all(v is None for v in out):
            raise error
        return out


def _patient(call, texts: list[str], attempts: int, wait: float) -> tuple[list, str | None]:
    error = None
    for i in range(attempts):
        try:
            return call(texts), None
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            if i + 1 < attempts:
                time.sleep(wait * 2**i)
    return [None] * len(texts), error


def embedded(df: DataFrame, text_col: str, provider: Embedder, key: str = "id", attempts: int = 4, wait: float = 2.0, budget: float | None = None, at_once: int = 64) -> DataFrame:
    """``(key, embedding, error)``: a vector for each text, null with an error where the service fails or gives another length.

    budget: seconds that a task may take; the texts that it has not come to by then have the error 'out of time', and the rest is kept.
    """
    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started = time.monotonic()
        for whole in frames:
            for at in range(0, len(whole), at_once):
                pdf = whole.iloc[at : at + at_once]
                if budget is not None and time.monotonic() - started >= budget:
                    got, error = [None] * len(pdf), "out of time"
                else:
                    got, error = _patient(provider.embed, list(pdf[text_col].fillna("")), attempts, wait)
                bad = [error or "no vector" if g is None else None if len(g) == provider.dim else f"{len(g)} numbers" for g in got]
                yield pd.DataFrame({key: pdf[key], "embedding": [g if b is None else None for g, b in zip(got, bad)], "error": bad})

    return df.select(key, text_col).mapInPandas(run, schema)


def answered(df: DataFrame, prompt_col: str, provider: Answerer, key: str = "id", attempts: int = 4, wait: float = 2.0) -> DataFrame:
    """``(key, answer, error)`` for each prompt."""
    schema = T.StructType([df.schema[key], T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got, error = _patient(provider.answer, list(pdf[prompt_col].fillna("")), attempts, wait)
            yield pd.DataFrame({key: pdf[key], "answer": got, "error": [error if g is None else None for g in got]})

    return df.select(key, prompt_col).mapInPandas(run, schema)


def missing_vectors(df: DataFrame, n: int | None = None, by: str = "created_at") -> DataFrame:
    """Rows without a vector, oldest first, at most n a run."""
    out = df.where(F.col("embedding").isNull()).orderBy(by, "id")
    return out if n is None else out.limit(n)
