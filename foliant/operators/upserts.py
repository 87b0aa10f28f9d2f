"""Writes as new snapshots: insert-ignore, changed rows, compare-and-swap, cascading deletes, resumption, re-chunking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(seq)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def insert_ignore(target: DataFrame, rows: DataFrame, key: str, seq: str) -> DataFrame:
    """``target`` and the first of the new rows of each key that it lacks."""
    new = first_per_key(rows, key, seq).join(target.select(key), key, "left_anti")
    return target.unionByName(new.select(target.columns))


def changed(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``updates`` that differ from the target in any of the columns."""
    old = target.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns])
    return updates.join(old, key).filter(differs).select(updates.columns)


def update(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` with the columns of ``updates`` where it has the key; null there is a value."""
    new = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(new, key, "left")
    value = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
    return joined.select([value(c) for c in target.columns])


def cascade_delete(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def cas_status(target: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``changes`` (key, old, new) with status: apply, mismatch, missing."""
    current = target.select(key, F.col(column).alias("_now"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_now").eqNullSafe(F.col("old")), "apply").otherwise("mismatch")
    return changes.join(current, key, "left").withColumn("status", status).drop("_now", "_there")


def cas_apply(target: DataFrame, changes: DataFrame, key: str, column: str, plan_only: bool = False) -> DataFrame:
    """``target`` after the changes whose old value is still there; or, with ``plan_only``, the changes and what becomes of them."""
    plan = cas_status(target, changes, key, column)
    return plan if plan_only else update(target, plan.filter("status = 'apply'").select(key, F.col("new").alias(column)), key, [column])


def resume(rows: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    return rows.join(checkpoint.select(key), key, "left_anti")


def rechunk_replace(chunks: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """``chunks`` with all of the documents in ``fresh`` replaced by its rows, whose embeddings are to come."""
    kept = chunks.join(fresh.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh.withColumn("embedding", F.lit(None).cast(chunks.schema["embedding"].dataType)).select(chunks.columns))


def id_union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def id_except(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def changed_texts(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """Rows whose text a repair has changed, with the new text: what has to be embedded again."""
    return rows.withColumn("_new", new).filter(~F.col("_new").eqNullSafe(old)).withColumnRenamed("_new", "new_text")
