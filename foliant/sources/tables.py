"""Readers and writers: tables of a data folder, line-delimited JSON strict and tolerant, JSON objects, vectors by position."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.sources.ship import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, if they come in fewer partitions than twice these: a small file may be one row group, and all work on it one task's. Larger inputs are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < 2 * cores else rows


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """Line-delimited JSON under a schema, missing keys null; ``tolerant`` leaves undecodable lines out, else they are an error."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_json_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(id, *fields of value) of files that each are one JSON object of id to record."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("id", "r")).select("id", "r.*")


def zip_vectors(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, embedding) of ids and vectors with equal positions ``pos``; of a repeated id the last counts."""
    both = ids.join(vectors, "pos")
    last = Window.partitionBy("id").orderBy(F.desc("pos"))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("id", "embedding")


def read_originals(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of original files from any store that Spark reads: what a fetch by URL would bring."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_column(rows: DataFrame, key: str, column: str, path: str) -> None:
    """A backup of one column before it is changed."""
    rows.select(key, column).write.mode("errorifexists").json(path)


def append_checkpoint(rows: DataFrame, folder: str) -> str:
    """One directory a batch, each committed as a whole."""
    rows.write.parquet(path := f"{folder}/batch={uuid.uuid4().hex}")
    return path


def read_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def replace_checkpoint(rows: DataFrame, folder: str) -> None:
    """Writes beside the folder, moves the old one aside and takes its place; the old one goes last. A move that fails is an error and
    leaves the old rows where they were, and a crash in between leaves them beside the folder, under a name that begins like its own."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    name = uuid.uuid4().hex
    new, old, aside = path(f"{folder}.new-{name}"), path(folder), path(f"{folder}.old-{name}")
    rows.write.parquet(new.toString())
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(old)
    if there and not fs.rename(old, aside):
        raise OSError(f"{folder} cannot be moved aside")
    if not fs.rename(new, old):
        if there:
            fs.rename(aside, old)
        raise OSError(f"{new.toString()} cannot take the place of {folder}")
    if there:
        fs.delete(aside, True)
