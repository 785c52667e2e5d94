"""Embeddings of texts: a provider protocol, a local deterministic provider, and a client of an embedding service."""

from __future__ import annotations

import json
import time
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    model_name: str
    model_version: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashProvider:
    """Hashed bags of words with signs, of length one: needs no model and gives the same everywhere. Blank texts give zeros."""

    dimension: int = 64
    model_name: str = "hashed-words"
    model_version: str = "1"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[k, h % self.dimension] += 1 if h & 0x80000000 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).astype(np.float32).tolist()


@dataclass(frozen=True)
class ServiceProvider:
    """A service that takes {"inputs", "normalize", "truncate"} at /embed: a timeout, and retries with growing pauses."""

    url: str
    model_name: str
    model_version: str
    timeout_s: float = 30.0
    retries: int = 3
    growth: float = 1.5

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"inputs": texts, "normalize": True, "truncate": False}).encode()
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(f"{self.url}/embed", body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                    return json.load(answer)
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(self.growth**attempt)
        raise AssertionError


#: Texts that a provider gets at once.
BATCH = 10


def embedded(chunks: DataFrame, make: Callable[[], Provider], text: str = "chunk_text") -> DataFrame:
    """chunks with embedding, model_name and model_version. Null texts have a null embedding.

    One provider is made in each Python worker. A provider that answers fewer vectors than it got texts is an error:
    silently missing embeddings would be lost chunks.
    """

    @F.pandas_udf("struct<embedding:array<float>,model_name:string,model_version:string>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = make()
        for texts in batches:
            known = [k for k, t in enumerate(texts) if t is not None]
            out: list[list[float] | None] = [None] * len(texts)
            for at in range(0, len(known), BATCH):
                some = known[at : at + BATCH]
                answer = provider.embed([texts.iloc[k] for k in some])
                if len(answer) != len(some):
                    raise ValueError(f"{len(some)} texts were sent, {len(answer)} vectors came back")
                for k, v in zip(some, answer, strict=True):
                    out[k] = v
            yield pd.DataFrame({"embedding": out, "model_name": provider.model_name, "model_version": provider.model_version})

    return chunks.withColumn("_e", embed(F.col(text))).select("*", "_e.*").drop("_e")
