"""What the operators of this subpackage share: reading tables, writing to the shared folder, word hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from foliant.sources.shared import shared_dir
from foliant.sources.ship import ship

#: Largest written size (bytes of Parquet) of a side that may be broadcast; above it the join shuffles.
BROADCAST_BYTES = 24 << 20
#: Texts are hashed in slices of about this many bytes, so that memory does not follow the Arrow batch.
SLICE_BYTES = 1 << 20

U64 = np.uint64
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, under that of the application (see :func:`clear`)."""
    ship(spark)
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes the tables that operators of this application have written. Results that were not stored elsewhere go with them."""
    drop_path(spark, _own(spark))


def shipped(df: DataFrame) -> DataFrame:
    """``df``, with this package sent to the workers that its Python functions run on."""
    ship(df.sparkSession)
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, lost executors cost only their running tasks."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.foliant_path = path
    return out


def task_lot() -> int:
    """A number that differs from task to task, to deal out what a task numbers from 0."""
    return int(mix(np.array([TaskContext.get().partitionId()], U64))[0] >> U64(34))


_states: dict[str, dict] = {}


def state(owner: str) -> dict:
    """What an operator keeps in a Python worker from one task to the next. Workers are reused, also by other operators: what those have kept goes first."""
    if others := [k for k in _states if k != owner]:
        for k in others:
            del _states[k]
        give_back()
    return _states.setdefault(owner, {})


def give_back() -> None:
    """What is freed, to the system: else it stays with the process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _let_go() -> None:
    state("")
    _powers.clear()
    give_back()


def release(spark: SparkSession) -> None:
    """Has idle workers let go of what operators keep in them, by a job of empty tasks: executors hand these to the worker that has been idle longest."""

    def run(batches):
        _let_go()
        yield from batches

    tasks = 6 * spark.sparkContext.defaultParallelism
    ship(spark)
    spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long").count()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written_bytes(df: DataFrame) -> int:
    fs, p = _fs(df.sparkSession, df.foliant_path)
    return fs.getContentSummary(p).getLength()


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` (of :func:`written`) with a broadcast hint if its files are under BROADCAST_BYTES; as it is otherwise."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if written_bytes(df) <= BROADCAST_BYTES else df


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by a scan."""
    from pyspark.sql import functions as F

    return df.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0


# --- word hashes ---------------------------------------------------------------------------------------------------


def _mixed(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, by element."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


BYTE_VALUES = _mixed(256, 77)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
_BASE = 0x2545F4914F6CDD1D
_powers: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    if _powers.get("n", 0) < n:
        size = -(-n // 65_536) * 65_536
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, U64)
            x[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(x))
        if n > 4 * SLICE_BYTES:  # one very long text: do not keep its tables
            return out[0], out[1]
        _powers.update(n=size, both=out)
    return _powers["both"][0], _powers["both"][1]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: hash of each word (A-Z lower-cased), and where each text's words begin.

    first: n + 1 offsets into hashes; text i has hashes[first[i]:first[i + 1]].
    """

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
        ends = np.cumsum([len(x) + 1 for x in texts]) if texts else np.zeros(0, int)
        inside = ~SEPARATORS[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        up, down = powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(buf) + 1, U64)
            np.cumsum(LOWER_VALUES[buf] * up[: len(buf)], out=sums[1:])
            self.hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U64))
        self.starts, self.stops, self.buf = starts, stops, buf
        self.first = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each position, and whether they are of one text."""
        return fold(self.hashes, k), self._whole(k)

    def _whole(self, k: int) -> np.ndarray:
        n = len(self.hashes)
        ok = np.zeros(n, bool)
        ok[: max(0, n - k + 1)] = True
        for back in range(1, k):
            at = self.first[1:] - back
            ok[at[(at >= self.first[:-1]) & (at >= 0)]] = False
        return ok

    def shingles(self, k: int = 5) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text; fewer than k words are one shingle, no word none."""
        h, ok = self.grams(k)
        out = []
        for a, b in zip(self.first[:-1], self.first[1:]):
            if b - a >= k:
                out.append(distinct(h[a : b - k + 1]))
            elif b > a:
                out.append(fold_short(self.hashes[a:b]))
            else:
                out.append(np.zeros(0, U64))
        return out


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def fold(hashes: np.ndarray, k: int) -> np.ndarray:
    """At each position the hash of the next k words (what lies past the end counts as zeros)."""
    out = np.full(len(hashes), k, U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            word = np.zeros(len(hashes), U64)
            word[: max(0, len(hashes) - i)] = hashes[i:]
            out = (out ^ word) * U64(0x9E3779B97F4A7C15)
            out ^= out >> U64(29)
    return mix(out)


def fold_short(hashes: np.ndarray) -> np.ndarray:
    return fold(hashes, len(hashes))[:1]


def utf8(texts) -> list[bytes]:
    """Arrow strings as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in texts.cast("binary").to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES):
    """(from, to) ranges of texts with about ``most`` bytes each; a longer text has one of its own."""
    a = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield a, i
            a, size = i, 0
        size += len(x) + 1
    if a < len(texts):
        yield a, len(texts)
