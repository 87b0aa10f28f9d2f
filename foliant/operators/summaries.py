"""Summaries on demand, with both success and failure cached."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.functions.udfs import pieces
from foliant.operators.upserts import update

ATTEMPTS = 2
STUB = "지적사항 한 문장\n원인 한 문장\n조치사항 한 문장\n처리결과 한 문장"


def needs(docs: DataFrame) -> DataFrame:
    """Which of both summaries a document still needs: none is there and none has failed."""
    return docs.withColumn("needs_structured", F.col("summary_point").isNull() & ~F.col("summary_failed")).withColumn("needs_freeform", F.col("summary_freeform").isNull() & ~F.col("freeform_failed"))


def stub(text: str) -> str:
    """A summariser without a model, for tests."""
    return STUB


def stub_tokens(text: str) -> tuple[int, int]:
    return max(1, len(text) // 2), 40


def structured(answer: str | None) -> list[str] | None:
    lines = [x for x in (answer or "").strip().split("\n") if x.strip()]
    usable = len(lines) == 4 and not all(any(p in x for p in X.FALLBACK_PHRASES) for x in lines)
    return lines if usable else None


def summarise(docs: DataFrame, summariser: Callable[[str], str | None]) -> DataFrame:
    """(doc_id, point, cause, action, result, failed): the first usable of ATTEMPTS answers, or failed."""

    def one(text: str | None) -> tuple:
        got = next((x for _ in range(ATTEMPTS) if (x := structured(summariser(text)))), None)
        return (*(got or [None] * 4), got is None)

    return _answers(docs, one, "point string, cause string, action string, result string, failed boolean")


def _answers(docs: DataFrame, one: Callable[[str | None], tuple], columns: str) -> DataFrame:
    """doc_id and what ``one`` makes of the text, by pieces of the batches (:func:`pieces`)."""
    names = [x.split()[0] for x in columns.split(", ")]
    kinds = [pa.bool_() if x.endswith(" boolean") else pa.string() for x in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in pieces(batch["text"]):
                own = batch.slice(a, n)
                got = zip(*map(one, own["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays([own["doc_id"].cast(pa.int64()), *(pa.array(list(x), k) for x, k in zip(got, kinds))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {columns}")


def summarise_freeform(docs: DataFrame, summariser: Callable[[str], str | None], fallback: str) -> DataFrame:
    """(doc_id, freeform, failed): any answer that is not blank and has not the fallback phrase."""

    def one(text: str | None) -> tuple:
        got = next((x for _ in range(ATTEMPTS) if (x := (summariser(text) or "").strip()) and fallback not in x), None)
        return got, got is None

    return _answers(docs, one, "freeform string, failed boolean")


def cache(docs: DataFrame, results: DataFrame) -> DataFrame:
    """``docs`` with the results written: four lines, or nulls and the mark of failure."""
    new = results.select("doc_id", *[F.when(~F.col("failed"), F.col(n)).alias(f"summary_{n}") for n in X.SUMMARY_LABELS], F.col("failed").alias("summary_failed"))
    return update(docs, new, "doc_id", [*(f"summary_{n}" for n in X.SUMMARY_LABELS), "summary_failed"])


def ensure(docs: DataFrame, texts: DataFrame, summariser: Callable[[str], str | None]) -> DataFrame:
    """``docs`` with structured summaries of all that still need one; what is there or has failed stays."""
    todo = needs(docs).filter("needs_structured").select("doc_id").join(texts.select("doc_id", "text"), "doc_id")
    return cache(docs, summarise(todo, summariser))
