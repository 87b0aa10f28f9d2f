"""Sharding by a two-pass external shuffle.

First pass: every record is scattered by a seeded hash to one of a number of buckets, each of about ``bucket_bytes``, through Spark's shuffle, whose files are
the external storage. Second pass: every bucket, small enough for a task's memory, is shuffled by Fisher-Yates with a generator of its own seed and written. The
buckets one behind the other are a random order of all records, and that order is cut into shards of sizes that differ by one record at most. Records per bucket
are counted beforehand, on hashes alone, so each bucket knows the places of its records.

Texts move once, and a task holds one bucket at a time, however many it is given. Which bucket a record comes to, and where it stands there, depend on the
record and the seed only, so reruns agree on any number of executors. Records equal in all columns cannot be told apart by a hash; where so many are equal that they overfill a bucket, each is scattered by its
place in the input as well.

What moves to the driver is a count for each bucket, at most MOST_BUCKETS.

Defined cases: a null text has no bytes and is a record like any other, as is an empty one; ids may be null and may repeat. A very long text makes its bucket
longer by itself. Rows that are equal are each kept. Columns may have any names: those that are added get an underscore more where theirs is taken.
An empty table gives no shards and reads as an empty table. Columns of maps take no part in hashes. The input must give the same rows whenever it is read, which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, shipped, written

SHARDS, SEED = 8, 17
#: Bytes of text of a bucket, and the buckets that there are at most; above that, they grow.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 200_000
#: Partitions of the shuffle at most; each takes its buckets one after the other.
MOST_PARTITIONS = 50_000
#: Equal records that one bucket may get.
MOST_EQUAL = 1000
#: Bytes of an Arrow batch that goes out, about.
OUT_BYTES = 4 << 20


def record_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text, and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def identity(docs: DataFrame, seed: int) -> Column:
    """64 bits of all columns; which of them are null counts too."""
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed), F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in own], F.lit("")), *own)


def free(taken: list[str], name: str) -> str:
    low = {x.lower() for x in taken}
    while name in low:
        name += "_"
    return name


@dataclass
class Plan:
    """How records go to buckets: how many, records of each, and which equal records are spread."""

    buckets: int
    counts: np.ndarray
    spread: DataFrame | None
    seed: int

    def bucket(self, df: DataFrame, h: str, lot: str) -> DataFrame:
        """``df`` with its bucket, from the columns of the hash and of the place in the input."""
        of = lambda c: F.pmod(c, F.lit(self.buckets)).cast("int")
        alone = of(F.xxhash64(F.lit(self.seed), h))
        if self.spread is None:
            return df.withColumn("_bucket", alone)
        joined = df.join(self.spread, F.col(h) == F.col("_equal"), "left")
        return joined.withColumn("_bucket", F.when(F.col("_equal").isNull(), alone).otherwise(of(F.xxhash64(F.lit(self.seed), h, lot)))).drop("_equal")


def _numbered(docs: DataFrame, seed: int, text: str) -> DataFrame:
    """Records as one column, whatever theirs are called, beside their hash, place in the input and bytes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_record"), identity(docs, seed).alias("_h"), F.monotonically_increasing_id().alias("_lot"), record_bytes(text).alias("_size"))


def plan(docs: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> Plan:
    base = written(_numbered(docs, seed, text).drop("_record"), "records")
    total = base.agg(F.sum("_size").alias("b")).first().b or 0
    size = max(bucket_bytes, -(-total // MOST_BUCKETS))
    out = Plan(max(1, -(-total // size)), np.zeros(0, np.int64), None, seed)
    per = written(out.bucket(base, "_h", "_lot").groupBy("_bucket").agg(F.count("*").alias("n"), F.sum("_size").alias("b")), "buckets")
    full = per.filter(F.col("b") > 2 * size).select("_bucket")
    equal = out.bucket(base, "_h", "_lot").join(F.broadcast(full), "_bucket", "left_semi").groupBy(F.col("_h").alias("_equal")).count().filter(F.col("count") > MOST_EQUAL)
    equal = written(equal.select("_equal"), "equal")
    if equal.limit(1).count():
        out.spread = broadcast_if_small(equal)
        per = out.bucket(base, "_h", "_lot").groupBy("_bucket").agg(F.count("*").alias("n"))
    out.counts = np.zeros(out.buckets, np.int64)
    for r in per.select("_bucket", "n").collect():
        out.counts[r["_bucket"]] = r.n
    return out


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A random order of n places: the generator's shuffle swaps each place, from the last one down, with one at or before it."""
    order = np.arange(n)
    np.random.default_rng([seed, bucket]).shuffle(order)
    return order


def cuts(n: int, shards: int) -> np.ndarray:
    """Where shards begin in the order of all records, and its end."""
    return np.array([k * n // shards for k in range(shards + 1)], np.int64)


def shuffled(docs: DataFrame, shards: int = SHARDS, text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``docs`` with shard and slot, buckets in order and each in its shuffled order."""
    own = plan(docs, text, bucket_bytes, seed)
    first = np.concatenate(([0], np.cumsum(own.counts)))
    begin, counts = cuts(int(first[-1]), shards), own.counts
    parts = min(own.buckets, MOST_PARTITIONS)
    names = [free(docs.columns, "shard"), free(docs.columns, "slot")]
    width = len(docs.columns)

    def placed(bucket: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).select(list(range(width)))
        if len(rows) != counts[bucket]:
            raise ValueError(f"bucket {bucket} has {len(rows)} records, {counts[bucket]} were counted: the input changes from one reading to the next")
        order = fisher_yates(len(rows), seed, bucket)
        step = max(1, len(rows) * OUT_BYTES // max(1, rows.nbytes))
        for k in range(0, len(rows), step):
            place = first[bucket] + np.arange(k, min(len(rows), k + step))
            shard = np.searchsorted(begin, place, side="right") - 1
            more = [pa.array(shard.astype(np.int32)), pa.array(place - begin[shard])]
            out = rows.take(pa.array(order[k : k + step])).combine_chunks()
            for b in out.append_column(names[0], more[0]).append_column(names[1], more[1]).to_batches():
                yield b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            bucket = b.column(width).to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if now is not None and bucket[lo] != now:
                    yield from placed(now, held)
                    held = []
                now = int(bucket[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from placed(now, held)

    at = (F.col("_bucket").cast("long") * parts / F.lit(own.buckets)).cast("int")
    scattered = own.bucket(_numbered(docs, seed, text), "_h", "_lot").select("_record", "_h", "_bucket").repartitionById(parts, at).sortWithinPartitions("_bucket", "_h")
    fields = T.StructType(docs.schema.fields + [T.StructField(names[0], T.IntegerType()), T.StructField(names[1], T.LongType())])
    return shipped(scattered).select("_record.*", F.col("_bucket").alias(free(docs.columns, "bucket"))).mapInArrow(run, fields)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **how) -> None:
    """A folder of Parquet files for each shard; records of a file are in the order of their slots, and files, by name, too."""
    out = shuffled(docs, shards, **how)
    shard, slot = out.columns[-2:]
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The shards at ``path`` of documents of this schema, with shard and slot; their order is that of the slots."""
    shard, slot = (free(schema.names, n) for n in ("shard", "slot"))
    return spark.read.schema(T.StructType(schema.fields + [T.StructField(slot, T.LongType()), T.StructField(shard, T.IntegerType())])).parquet(path)
