"""Embedding chunks in batches with an encoder that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.audits import norm_gate
from foliant.operators.upserts import resume, update

BATCH, DIGITS = 64, 5
#: Makes an encoder of texts to vectors; called once a task, so that a model is loaded there and not sent.
Factory = Callable[[], Callable[[list[str]], list[list[float]]]]


def embed(chunks: DataFrame, factory: Factory, batch: int = BATCH, digits: int = DIGITS) -> DataFrame:
    """(chunk_id, embedding) of (chunk_id, text), rounded."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for pdf in pdfs:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": encode(part["text"].tolist())})

    raw = chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, embedding array<double>")
    return raw.select("chunk_id", F.transform("embedding", lambda x: F.round(x, digits).cast("float")).alias("embedding"))


def embed_missing(chunks: DataFrame, checkpoint: DataFrame | None, factory: Factory) -> DataFrame:
    """Embeddings of the chunks that have none and are not in the checkpoint yet."""
    todo = chunks.filter(F.col("embedding").isNull())
    return embed(todo if checkpoint is None else resume(todo, checkpoint, "chunk_id"), factory)


def apply_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``chunks`` with the embeddings written; an error if their norms are not about 1."""
    gate = norm_gate(embeddings).first()
    if gate.n and not gate.ok:
        raise ValueError(f"mean norm {gate.mean:.4f} of {gate.n} embeddings is not 1")
    return update(chunks, embeddings, "chunk_id", ["embedding"])
