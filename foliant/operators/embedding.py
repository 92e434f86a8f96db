"""Embedding chunks through a provider, in batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import boilerplate
from foliant.operators.chunker import count_tokens, truncate

# Chunks a batch, tokens of an input and of a request.
BATCH, MAX_TOKENS, MAX_REQUEST_TOKENS = 50, 8192, 8192


class Provider(Protocol):
    """Turns texts into vectors.  It is sent to the executors, and does its own retries."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def requests(texts: Iterable[str], most: int = MAX_REQUEST_TOKENS, each: int = MAX_TOKENS) -> Iterator[list[str]]:
    """Groups of neighbouring texts within a request's tokens; longer texts are cut to `each`."""
    group, held = [], 0
    for text in texts:
        n = count_tokens(text)
        if n > each:
            text, n = truncate(text, each), each
        if group and held + n > most:
            yield group
            group, held = [], 0
        group.append(text)
        held += n
    if group:
        yield group


def embeddable(chunks: DataFrame) -> DataFrame:
    """Chunks that are not front or back matter and not blank."""
    return chunks.where(~boilerplate(F.col("section_path")) & F.col("content").rlike(r"\S"))


def embed(chunks: DataFrame, provider: Provider) -> DataFrame:
    """(chunk_id, embedding) of the embeddable chunks, normalised to length 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in batched(batch.itertuples(index=False), BATCH):
                vectors = [v for group in requests([r.content for r in rows]) for v in provider.embed(group)]
                if len(vectors) != len(rows):
                    raise ValueError("the provider gave another number of vectors")
                norms = [max(sum(x * x for x in v) ** 0.5, 1e-12) for v in vectors]
                yield pd.DataFrame({"chunk_id": [str(r.chunk_id) for r in rows], "embedding": [[x / n for x in v] for v, n in zip(vectors, norms, strict=True)]})

    return embeddable(chunks).select("chunk_id", "content").mapInPandas(run, "chunk_id string, embedding array<float>")
