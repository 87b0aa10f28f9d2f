"""Incremental loading over Structured Streaming: new files are chunked as they come, each id once.

The reference runs in batches and resumes by id. Here a keyed state remembers the ids, so what a batch costs follows the batch and not what is stored: the target is read once, by the first batch
of a new checkpoint, for the ids that others have put there. A batch writes a folder of its own, named after query and batch, so one that is run again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from foliant.operators.structure import chunk_rows
from foliant.sources.ship import ship

DOCUMENTS = "doc_id long, text string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Of each id the row that comes first, by file and place in it, and nothing of ids that were there before."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))
        if not self.seen.exists():
            self.seen.update((True,))
            yield own.sort_values(["file", "place"]).head(1)[["doc_id", "text"]]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append(batch: DataFrame, number: int, target: str) -> None:
    name = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
    chunk_rows(batch).write.mode("overwrite").parquet(f"{target}/load={name}")


def load_incrementally(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Chunks every document under ``source`` into ``target`` once, now and on each later call. Rows without an id are left out."""
    ship(spark)
    stream = spark.readStream.schema(DOCUMENTS).parquet(source).select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).filter("doc_id is not null")
    known = spark.createDataFrame([], "doc_id long")
    if there(spark, target) and not there(spark, f"{checkpoint}/offsets/0"):
        known = spark.read.parquet(target).select(F.col("document_id").alias("doc_id")).distinct()
    first = stream.groupBy("doc_id").transformWithStateInPandas(FirstOfKey(), DOCUMENTS, "append", "none", initialState=known.groupBy("doc_id"))
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return first.writeStream.foreachBatch(lambda b, n: append(b, n, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
