"""Tables that are read by key: sorted, in small row groups with bloom filters, so that a lookup reads the row groups of its keys and no more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a row group, about: what one lookup reads.
GROUP_BYTES = 1 << 20
#: Keys in a filter at most. Longer lists are joined: their equalities would be more code than a stage can be compiled to, and they want most row groups anyway.
MOST_KEYS = 500


def write_points(rows: DataFrame, path: str, key: str, group_bytes: int = GROUP_BYTES) -> None:
    """``rows`` in the order of ``key``. Wide columns that lookups do not want belong into a store of their own. Null keys cannot be looked up."""
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    ordered.write.option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def one_of(key: str, values: list) -> Column:
    """That a column has one of the values, as a balanced tree of equalities: each can be held against the statistics of a row group."""
    if len(values) == 1:
        return F.col(key) == F.lit(values[0])
    return one_of(key, values[: len(values) // 2]) | one_of(key, values[len(values) // 2 :])


def read_points(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """The rows that have one of the values, by their row groups. Repeated values count once, nulls not at all; an empty list gives no rows."""
    rows, wanted = spark.read.parquet(path), sorted({v for v in values if v is not None})
    if not wanted:
        return rows.filter(F.lit(False))
    if len(wanted) <= MOST_KEYS:
        return rows.filter(one_of(key, wanted))
    keys = spark.createDataFrame([(v,) for v in wanted], T.StructType([T.StructField("_key", rows.schema[key].dataType)]))
    return rows.join(F.broadcast(keys), F.col(key) == F.col("_key"), "left_semi")
