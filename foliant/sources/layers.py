"""Tables that change without being rewritten: layers, and a list of versions.

A change is a layer: what it adds, as one or several Parquet tables, and the keys that it takes away from all layers before it. A version is a small file that names its layers in order. It is put down only
if no file of its number is there, so of two writers that start from one version the first wins and the other gets :class:`Conflict`; readers have the version that they
opened, whole, whatever is written meanwhile. What is written follows what is changed. :func:`merge` makes one layer of many.

A row is visible if no later layer takes its key away. Keys taken away are broadcast while they are few (BROADCAST_KEYS, counted when they are written) and joined by a shuffle beyond.

Null keys are never taken away. Writing a layer that is not committed leaves files that no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_KEYS = 500_000
VERSIONS = "versions"


class Conflict(Exception):
    """Another writer has committed the next version."""


@dataclass(frozen=True)
class Version:
    """number, 0 before the first commit; layers: the folder of each and how many keys it takes away, oldest first."""

    number: int
    layers: tuple[tuple[str, int], ...]


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def version(spark: SparkSession, folder: str, number: int) -> Version | None:
    """None if there is no such version, or if its file is still being written."""
    fs, p = _at(spark, f"{folder}/{VERSIONS}/{number:020d}")
    if number == 0 or not fs.exists(p):
        return None if number else Version(0, ())
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(number, tuple((a, n) for a, n in json.loads(text))) if text.endswith("\n") else None


def latest(spark: SparkSession, folder: str) -> Version:
    fs, p = _at(spark, f"{folder}/{VERSIONS}")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    for number in sorted((int(n) for n in names if n.isdigit()), reverse=True):
        if found := version(spark, folder, number):
            return found
    return Version(0, ())


def commit(spark: SparkSession, folder: str, base: Version, layers: tuple[tuple[str, int], ...]) -> Version:
    """The version after ``base``, unless there is one already."""
    number = base.number + 1
    fs, p = _at(spark, f"{folder}/{VERSIONS}/{number:020d}")
    try:
        stream = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise Conflict(f"version {number} of {folder} is there already") from e
        raise
    try:
        stream.write(bytearray(json.dumps(layers).encode() + b"\n"))
    finally:
        stream.close()
    return Version(number, layers)


def add(spark: SparkSession, folder: str, write: Callable[[str], None], gone: DataFrame | None = None, base: Version | None = None, alone: bool = False) -> Version:
    """A version with one layer more: what ``write(path)`` puts under its path, without the keys in the one column of ``gone`` in layers before. With ``alone`` no layer before
    it stays: the table is replaced. ``base`` is the version that the change was made from; the latest one if it is not given."""
    base = base or latest(spark, folder)
    write(path := f"{folder}/{(name := f'layer-{uuid.uuid4().hex}')}")
    n = 0
    if gone is not None:
        gone.toDF("gone").filter("gone is not null").distinct().write.parquet(f"{path}/gone")
        n = spark.read.parquet(f"{path}/gone").count()
    return commit(spark, folder, base, (() if alone else base.layers) + ((name, n),))


def _rows(spark: SparkSession, folder: str, layers, table: str, read) -> DataFrame | None:
    fs = _at(spark, folder)[0]
    parts = [(k, f"{folder}/{name}/{table}") for k, (name, _) in layers if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/{table}"))]
    rows = [read(path).withColumn("_layer", F.lit(k)) for k, path in parts]
    return reduce(lambda a, b: a.unionByName(b), rows) if rows else None


def read(spark: SparkSession, folder: str, table: str, key: str, at: Version | None = None, read: Callable[[str], DataFrame] | None = None, layers: range | None = None) -> DataFrame:
    """The visible rows of one table of a version; ``read(path)`` reads it in a layer, else Parquet is read whole. ``layers`` limits it to some of them."""
    at = at or latest(spark, folder)
    numbered = list(enumerate(at.layers))
    rows = _rows(spark, folder, [x for x in numbered if layers is None or x[0] in layers], table, read or spark.read.parquet)
    if rows is None:
        raise ValueError(f"version {at.number} of {folder} has no table {table}")
    if (gone := _gone(spark, folder, numbered)) is None:
        return rows.drop("_layer")
    return rows.join(gone, rows[key] == gone["gone"], "left").filter("gone is null or _layer >= _until").drop("gone", "_layer", "_until")


def _gone(spark: SparkSession, folder: str, numbered) -> DataFrame | None:
    """(gone, _until): keys, and the last layer that takes each away."""
    takers = [(k, x) for k, x in numbered if x[1]]
    if not takers:
        return None
    keys = _rows(spark, folder, takers, "gone", spark.read.parquet).groupBy("gone").agg(F.max("_layer").alias("_until"))
    return F.broadcast(keys) if sum(n for _, (_, n) in takers) <= BROADCAST_KEYS else keys


def merge(spark: SparkSession, folder: str, write: Callable[[str, Version], None]) -> Version:
    """One layer of all: ``write(path, version)`` puts down what the version shows. A change committed meanwhile is a conflict, and nothing is lost."""
    at = latest(spark, folder)
    return add(spark, folder, lambda path: write(path, at), base=at, alone=True)


def diff(spark: SparkSession, folder: str, table: str, key: str, old: Version, new: Version) -> DataFrame:
    """(key, change): keys whose rows were inserted, deleted or replaced from one version to another that has the same first layers. Layers that both have are read for the keys in question only."""
    same = next((k for k, (a, b) in enumerate(zip(old.layers, new.layers)) if a != b), min(len(old.layers), len(new.layers)))
    late = _rows(spark, folder, [x for v in (old, new) for x in list(enumerate(v.layers))[same:]], table, spark.read.parquet)
    taken = _rows(spark, folder, [x for v in (old, new) for x in list(enumerate(v.layers))[same:] if x[1][1]], "gone", spark.read.parquet)
    touched = [x.select(c) for x, c in ((late, F.col(key)), (taken, F.col("gone").alias(key))) if x is not None]
    if not touched:
        return read(spark, folder, table, key, old).select(key, F.lit("same").alias("change")).limit(0)
    touched = reduce(lambda a, b: a.unionByName(b), touched).distinct()
    own = lambda v, c: read(spark, folder, table, key, v).select(key).join(touched, key, "left_semi").distinct().withColumn(c, F.lit(True)) if v.layers else touched.limit(0).withColumn(c, F.lit(True))
    both = own(old, "_old").join(own(new, "_new"), key, "full_outer")
    return both.select(key, F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").otherwise("replaced").alias("change"))
